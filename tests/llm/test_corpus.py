import base64
import os
import random

import numpy as np
import pytest

from blockloom.llm import mixing, scans, subjects, tokens
from blockloom.llm.queries import VOCABULARY

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_tokens_against_the_library():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    signs = "abcdefghij  \n\t'’éüß水厂管网测，。0123456789<|endoftext|>\u2003\u0085\x1c👩‍🔧=-_"
    texts = [None, "", " ", "<|endoftext|>", "a" * 30_000, "=" * 5000, "水" * 3000] + ["".join(random.choices(signs, k=random.randint(1, 80))) for _ in range(3000)]
    encoder = tokens.Encoder(*tokens.load(VOCABULARY))
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        values, offsets = encoder.encode(part)
        for i, t in enumerate(part):
            assert values[offsets[i] : offsets[i + 1]].tolist() == (library.encode_ordinary(t) if t else [])


@needs_vocabulary
def test_token_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello hello"), (3, "hello hello")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df, VOCABULARY).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert tokens.encode(df.limit(0), VOCABULARY).count() == 0


def test_fill_against_brute_force():
    random.seed(2)
    for _ in range(200):
        counts = {random.randint(1, 12): random.randint(1, 3) for _ in range(random.randint(0, 5))}
        target = random.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = mixing.fill(target, counts)
        assert all(n <= counts[x] for x, n in got.items()) and sum(x * n for x, n in got.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize(("target", "counts"), [(200_000, {70_000: 1, 90_000: 1, 110_000: 1}), (131_072, {131_072: 1, 65_536: 2, 100_000: 3}), (131_072, {100_000: 3, 65_536: 2})])
def test_long_texts_are_fitted_too(target, counts):
    for seed in range(20):
        got = mixing.draw(target, counts, str(seed))
        assert sum(x * n for x, n in got.items()) == target and all(n <= counts[x] for x, n in got.items())


@needs_vocabulary
def test_last_bucket_is_divided(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_TEXTS", 5)
    monkeypatch.setattr(mixing, "MOST_TEXTS", 20)
    monkeypatch.setattr(mixing, "MOST_BUCKETS", 4)
    monkeypatch.setattr(mixing, "WINDOW", 8)
    random.seed(6)
    docs = spark.createDataFrame([(i, " ".join(random.choices(["water", "pump", "valve", "town"], k=random.randint(3, 12))) + f" {i}", "ab"[i % 4 == 0]) for i in range(1200)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, targets, path=VOCABULARY)
    assert all(0 <= r.budget_tokens - r.actual_tokens < 8 < r.budget_tokens for r in shares.collect())
    assert mixed.groupBy("source").max("repeats").orderBy("source").collect()[0][1] == 1


@needs_vocabulary
def test_mix(spark):
    random.seed(1)
    words = ["water", "pump", "valve", "report", "town", "council", "pipe"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(3, 40))), "abc"[i % 3]) for i in range(300)]
    rows += [(1000, rows[0][1], "b"), (1001, None, "a"), (1002, "", "a"), (1003, "only", None), (1004, "free", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, targets, path=VOCABULARY)
    most = {"a": 2, "b": 1, "c": 3}
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= most[r.source] for r in got) and 1000 not in {r.doc_id for r in got}
    share = {r.source: r for r in shares.collect()}
    assert all(0 <= share[s].budget_tokens - share[s].actual_tokens < 5 and abs(share[s].actual_share - share[s].target_share) < 1e-3 for s in most) and share["none"].actual_tokens == 0
    assert mixing.mix(docs.limit(0), targets, path=VOCABULARY)[0].count() == 0


def test_subjects(spark):
    random.seed(3)
    areas = {"law": ["court", "statute", "verdict", "clause"], "sport": ["match", "league", "striker", "trophy"]}
    common = ["the", "town", "report", "shared", "today", "office"]

    def sentence(a=None):
        return " ".join(random.choices(common, k=4) + (random.choices(areas[a], k=3) if a else [])).capitalize() + "."

    rows, labels = [], []
    for i in range(200):
        a = ["law", "sport"][i % 2]
        rows.append((i, " ".join(sentence(a) for _ in range(4)) + " " + sentence(), "s"))
        labels.append((i, a, 1))
    rows += [(900, " ".join([sentence("law")] + [sentence() for _ in range(9)]), "s"), (901, " ".join([sentence("law"), sentence("sport"), sentence()]), "s"), (902, None, "s"), (903, "", None), (904, "!!", "s"), (901, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    names = spark.createDataFrame([("law", ""), ("sport", "")], "area string, description string")
    labs = spark.createDataFrame(labels, "doc_id bigint, area string, annotator int")
    got = {tuple(r) for r in subjects.found(docs.where("doc_id <> 901 or text not like '%zzz%'"), names, labs).collect()}
    assert {(i, ["law", "sport"][i % 2]) for i in range(200)} <= got
    assert {a for i, a in got if i == 901} == {"law", "sport"} and not any(i in (900, 902, 903, 904) for i, _ in got)
    assert subjects.found(docs.limit(0), names, labs).count() == 0


BODY = ["The water council approved the annual report on the river pressure.", "Every summer the water council reviews the annual report.", "The council will publish the river report before winter.", "操作员检查了管网压力并记录结果。", "操作员在水厂检测了管网压力。", "水厂操作员记录了检测结果。"]


def test_scans(spark, make_blocks):
    rows = [{"document_id": f"c{i}", "block_id": f"c{i}", "block_type": "paragraph", "text": BODY[i % len(BODY)], "block_order": 1} for i in range(600)]
    noisy = {
        "cut": "The water council approved the ann-\nual report on the river pressure.", "cut2": "The water council approved the annual rep¬", "mis": "The water c0uncil approved the annua1 report.", "run": "ANNUAL REPORT 2020: WATER   12", "run2": "first words of it\nAnnual report 2020: water\nand more words.",
        "num": "- 12 -", "num2": "The river\n[13]\npressure.", "fine": "Every summer the water council reviews the annual report.", "zh": "操作员检查了菅网压力并记录结果。", "zh2": "操作员在水厂检测了菅网压力。", "zh3": "结果：操作员检查了菅网压力并记录结果。", "zh4": "今天操作员检查了菅网压力并记录结果。",
    }
    rows += [{"document_id": "s", "block_id": k, "block_type": "paragraph", "text": t, "block_order": i + 2} for i, (k, t) in enumerate(noisy.items())]
    rows += [{"document_id": "s", "block_id": "head", "block_type": "heading", "text": "Annual report 2020: water", "block_order": 1}, {"document_id": "s", "block_id": "null", "block_type": "paragraph", "block_order": 99}, {"document_id": "c1", "block_id": "notscanned", "block_type": "paragraph", "text": "- 12 -", "block_order": 5}]
    docs = spark.createDataFrame([("s", "Annual report 2020: water", '{"scanned": true}'), ("s", None, None), ("c1", "x", '{"scanned": false}'), ("c2", "x", "no json")], "document_id string, title string, metadata string")
    got = {tuple(r) for r in scans.found(make_blocks(rows), docs).collect()}
    want = {("cut", "cut_word"), ("cut2", "cut_word"), ("mis", "misread"), ("run", "running_line"), ("run2", "running_line"), ("num", "page_number"), ("num2", "page_number"), *((f"zh{x}", "misread") for x in ("", "2", "3", "4"))}
    assert got == want
    text = {r.block_id: r.text for r in scans.repaired(make_blocks(rows), docs).collect()}
    assert text["cut"] == "The water council approved the annual report on the river pressure." and text["mis"] == "The water council approved the annual report." and text["zh"] == "操作员检查了管网压力并记录结果。" and text["run2"] == "first words of it and more words."
    assert scans.found(make_blocks([]), docs).count() == 0


def test_tables_are_the_same_for_any_partitions(make_blocks):
    blocks = make_blocks([{"document_id": "d", "block_id": f"b{i}", "block_type": "paragraph", "text": BODY[i % len(BODY)] + f" the{i % 7} word"} for i in range(300)])
    few, many = (scans.learn(blocks.repartition(n)) for n in (3, 17))
    for a, b in zip((few[0], few[1], *few[2], few[3]), (many[0], many[1], *many[2], many[3])):
        assert np.array_equal(a, b)


def test_context_decides():
    reader = scans.Reader((np.zeros(scans.WORD_ROWS << scans.WORD_BITS, np.float32), np.zeros(1, np.float32), None, np.zeros((scans.VECTORS, scans.DIM), np.float32)))
    counts = {"clean": 200.0, "dean": 1.0, "water": 500.0, "the": 900.0, "green": 300.0}
    reader.count = lambda w: counts.get(w, 0.0)
    reader.memo["dean"] = ["clean"]
    near = scans._signs()[scans._word_id("water") % scans.VECTORS]
    for sign, found in ((1, 1), (-1, 0)):
        reader.vec[scans._word_id("clean") % scans.VECTORS] = sign * near / np.linalg.norm(near)
        assert len(reader.misread_words("water dean")) == found


def test_running_line_with_a_shifted_beginning():
    tables = (np.zeros(scans.WORD_ROWS << scans.WORD_BITS, np.float32), np.zeros(1, np.float32), None, None)
    reader = scans.Reader(tables)
    title = "Water supply of the northern towns"
    assert reader.running("- . " + title, [title]) and reader.running("7 " + title, [title]) and reader.running(title[1:], [title])
    assert not reader.running("Power demand in the southern parts", [title]) and not reader.running("The pump was put in order again.", [title])


def test_bound_of_distance():
    random.seed(4)
    for _ in range(2000):
        a, b = ("".join(random.choices("abcde", k=random.randint(0, 9))) for _ in range(2))
        assert scans._unlike(a, b) <= scans._distance(a, b, 99)


def test_expected_signs_of_all_neighbours(spark, make_blocks):
    # So many pairs of neighbours that some would share one of 2^20 hashed gaps.
    signs = [chr(0x4E00 + i) for i in range(100)]
    pairs = [(a, b) for a in signs for b in signs]
    text = [a + chr(0x6E00 + (i * 7919) % 5000) + b for i, (a, b) in enumerate(pairs)]
    blocks = make_blocks([{"document_id": "d", "block_id": f"b{k}", "block_type": "paragraph", "text": "，".join(text[k :: 20] * 3)} for k in range(20)])
    reader = scans.Reader(scans.learn(blocks))
    got = reader.wanted(*(np.array([ord(p[k]) for p in pairs], np.uint32) for k in (0, 1)))
    assert got.tolist() == [ord(t[1]) for t in text]
    assert reader.wanted(np.array([65], np.uint32), np.array([66], np.uint32)).tolist() == [0]
