"""Text that went through the wrong character encoding: finding it and bringing the original back (problem 1).

Method.  (1) Adjacent character pairs of the whole corpus are counted into a table of fixed size and scored by mutual
information, discounted for rare pairs.  (2) In each text the maximum-scoring segments of improbability are isolated.
(3) Only inside those segments inverse mappings (encode with the wrong codec, decode with the right one) are tried;
one is accepted if the restored segment is far more probable than the garbled one.  What has marks that no decoding of
right bytes can leave (replacement characters, control codes of the range 80-9F, a replacement character itself
decoded wrongly) counts as a case even where the original is lost.

The table has 2**PAIR_BITS hashed buckets whatever the corpus, so what is collected and broadcast is bounded (16 MB).

Defined results: null and empty text is no case and stays as it is; texts of any length are scored whole; repeated
rows give equal results; columns other than the ones named are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow import code_points
from blockloom.llm.letters import LATIN_LOOKALIKES

PAIR_BITS = 21
CHARS = 0x110000
#: Pairs with this share of the corpus keep half of their mutual information.
HALF = 2e-5
#: A pair scored below this adds to the improbability of a segment.
LEVEL = 2.0
#: (wrong codec, right codec) for segments that hold signs of East Asian sets, and for all others, tried in this order.
WIDE = (("gbk", "utf-8"), ("gb18030", "utf-8"), ("cp932", "utf-8"), ("big5hkscs", "utf-8"), ("cp949", "utf-8"), ("big5hkscs", "gb18030"), ("cp932", "gb18030"), ("cp949", "gb18030"))
NARROW = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp1250", "utf-8"), ("koi8-r", "utf-8"),
    ("latin-1", "gb18030"), ("cp1252", "gb18030"), ("latin-1", "big5hkscs"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252")
)
#: The least score of a segment that is looked at, by whether its signs are East Asian.
LEAST_WIDE, LEAST_NARROW = 7.0, 1.0
_MARKS = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")
_SCRIPTS = re.compile("[\u2e80-\uffff]+|[\x80-\u2e7f](?:[\x00-\u2e7f]*[\x80-\u2e7f])?")
_C1 = re.compile("[\x80-\x9f]")
_SCHEMA = "bucket int, n bigint"


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _plain(codes: np.ndarray) -> np.ndarray:
    """Digits are one sign, blanks are one sign: numbers say nothing about an encoding."""
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
    return np.where((codes == 10) | (codes == 13) | (codes == 9), np.uint32(32), codes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((1 << PAIR_BITS) + CHARS, np.int64)
    for batch in batches:
        codes, offsets = code_points(batch.column(0).to_pylist())
        if len(codes) < 2:
            continue
        codes = _plain(codes)
        inside = np.ones(len(codes) - 1, bool)
        cut = offsets[1:-1] - 1
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        table[: 1 << PAIR_BITS] += np.bincount(_hash(codes[:-1], codes[1:])[inside], minlength=1 << PAIR_BITS)
        table[1 << PAIR_BITS :] += np.bincount(codes, minlength=CHARS)
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["bucket", "n"])


def _of_lost(codec: str) -> str:
    """What a replacement character looks like after one more wrong decoding."""
    return ("\ufffd" * 4).encode().decode(codec, "ignore")


def _lost_pairs() -> np.ndarray:
    codes = [np.frombuffer(_of_lost(w).encode("utf-32-le"), np.uint32) for w in dict.fromkeys(w for w, _ in WIDE + NARROW)]
    return np.unique(np.concatenate([_hash(c[:-1], c[1:]) for c in codes if len(c) > 1]))


class PairScores:
    """Discounted mutual information of adjacent characters, from the counts of the whole corpus."""

    def __init__(self, buckets: np.ndarray, counts: np.ndarray) -> None:
        table = np.zeros((1 << PAIR_BITS) + CHARS)
        table[buckets] = counts
        self.total = max(1.0, table[1 << PAIR_BITS :].sum())
        self.pair = table[: 1 << PAIR_BITS].astype(np.float32)
        self.char = table[1 << PAIR_BITS :].astype(np.float32)

    def packed(self) -> tuple[np.ndarray, np.ndarray, float]:
        return self.pair, self.char, self.total

    @classmethod
    def shared(cls, broadcast) -> PairScores:
        """The scores of a broadcast, without copying its arrays."""
        self = cls.__new__(cls)
        self.pair, self.char, self.total = broadcast.value
        return self

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The score of each pair of neighbours."""
        codes = _plain(codes)
        n = self.pair[_hash(codes[:-1], codes[1:])].astype(np.float64)
        one = self.char[codes].astype(np.float64)
        mutual = np.log2(np.maximum(n, 0.25)) + math.log2(self.total) - np.log2(np.maximum(one[:-1], 0.5)) - np.log2(np.maximum(one[1:], 0.5))
        known = n / (n + HALF * self.total)
        common = np.log2(1 + n / (HALF * self.total))
        return np.where(mutual > 0, mutual, 0) * known + common


def _bytes(text: str, codec: str) -> bytes:
    """The bytes that a lenient decoder turned into the text: codes it has no sign for stayed as control codes."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if ord(c) >= 256:
                raise
            out.append(ord(c))
    return bytes(out)


def _unmapped(text: str, wrong: str, right: str) -> tuple[str, int] | None:
    """The text with the mapping undone, and how many of its signs are lost; None if it doesn't come from it."""
    text = text.replace("\ufffd", "\x1a")
    try:
        raw = text.encode(wrong)
    except UnicodeEncodeError:
        if wrong != "cp1252" or not _C1.search(text):
            return None
        try:
            raw = _bytes(text, wrong)
        except UnicodeEncodeError:
            return None
    try:
        out, lost = raw.decode(right), 0
    except UnicodeDecodeError:
        out = raw.decode(right, "replace")
        lost = out.count("\ufffd")
    if "\x1a" in out:
        lost += out.count("\x1a")
        out = out.replace("\x1a", "\ufffd")
    return out, lost


class Restorer:
    """Finds the garbled segments of a text and undoes them, given the pair scores of the corpus."""

    def __init__(self, scores: PairScores) -> None:
        self.scores = scores
        self.memo: dict = {}
        self.lost = np.zeros(1 << PAIR_BITS, bool)
        self.lost[_lost_pairs()] = True

    def suspects(self, texts: list[str | None]) -> np.ndarray:
        """Which texts of a batch have a segment worth a look: the best segment of each by one pass over all pairs."""
        codes, offsets = code_points(texts)
        out = np.zeros(len(texts), bool)
        if len(codes) < 2:
            return np.array([bool(t and _MARKS.search(t)) for t in texts], bool)
        plain = codes < 128
        w = np.append(self.improbable(codes), 0.0)
        last = offsets[1:] - 1
        w[last[last >= 0]] = -1e6  # no segment leads into the next text
        total = np.cumsum(w)
        before = np.minimum.accumulate(np.append(0.0, total[:-1]))
        best = total - before
        wide = self.wide(codes)
        narrow = ~plain & ~wide
        look = (best >= LEAST_WIDE) | (((narrow[:-1] | narrow[1:]) & (w[:-1] >= LEAST_NARROW)).tolist() + [False])
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        out[row[look & ((wide | narrow) | (best >= LEAST_WIDE))]] = True
        some = np.zeros(len(texts), bool)
        some[row[~plain]] = True
        marks = (codes == 0xFFFD) | (codes >= 0x80) & (codes < 0xA0) & (codes != 0x85) | (codes >= 0xE000) & (codes < 0xF900)
        out &= some
        out[row[marks]] = True
        return out

    def trusted(self, text: str) -> np.ndarray:
        """Scores of the pairs of a text, where the signs of garbling itself count nothing however frequent they are."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(self.of_garbling(codes), 0.0, self.scores.of(codes))

    def of_garbling(self, codes: np.ndarray) -> np.ndarray:
        narrow = (codes >= 128) & (codes < 0x2E80)
        return narrow[:-1] & narrow[1:] | self.lost[_hash(codes[:-1], codes[1:])]

    def improbable(self, codes: np.ndarray) -> np.ndarray:
        """How improbable each pair is.  Garbling is itself frequent in some corpora, so its own signs never count as usual:
        two signs in a row that are neither ASCII nor East Asian, and replacement characters decoded wrongly."""
        w = np.clip(LEVEL - self.scores.of(codes), -4.0, 2.0)
        return np.where(self.of_garbling(codes), 2.0, w)

    @staticmethod
    def wide(codes: np.ndarray) -> np.ndarray:
        return (codes >= 0x2E80) & (codes < 0x1F000)

    def segments(self, codes: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximum-scoring segments of improbability: (first character, end, score); close ones are one."""
        out: list[tuple[int, int, float]] = []

        def add(start: int, end: int, score: float) -> None:
            if out and start - out[-1][1] <= 3:
                start, end, score = out[-1][0], end, out.pop()[2] + score
            out.append((start, end, score))

        start, run, best, end = 0, 0.0, 0.0, -1
        for i, x in enumerate(self.improbable(codes).tolist()):
            if run <= 0:
                if best > 0:
                    add(start, end + 2, best)
                start, run, best, end = i, 0.0, 0.0, -1
            run += x
            if run > best:
                best, end = run, i
            elif run < best - 6:
                add(start, end + 2, best)
                run, best = 0.0, 0.0
        if best > 0:
            add(start, end + 2, best)
        return out

    def undo(self, text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, str, bool] | None:
        """The best range with its most probable original, and whether that is whole; None if none is garbled."""
        key = tuple((text[max(0, a - 1) : b + 1], a > 0, b < len(text)) for a, b in ranges)
        if key in self.memo:
            got = self.memo[key]
            return got and (*ranges[got[0]], *got[1:])
        best, tried = None, {}
        for k, (a, b) in enumerate(ranges):
            part = text[a:b]
            wide = any(0x2E80 <= ord(c) < 0x1F000 for c in part)
            if part.isascii():
                continue
            for wrong, right in WIDE if wide else NARROW:
                got = _unmapped(part, wrong, right)
                if got is None or got[0] == part or got[1] > 0.34 * len(got[0]):
                    continue
                new, lost = got
                if not lost and new.count("\ufffd") > 1:  # a replacement character, decoded once more
                    best = best if best and best[0] > 9 else (9.0, k, new, False)
                    continue
                left, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
                if wide and len(part) < 3 and not (all(c < "\u0250" for c in new) and (left + after).isascii() and (left.isalpha() or after.isalpha())):
                    continue  # one or two ideographs have many readings; only a Latin letter in a Latin word is none by chance
                if k not in tried:
                    tried[k] = float(self.trusted(left + part + after).mean())
                pairs = self.trusted(left + new + after)
                gain = float(pairs.mean()) * (1 - lost / len(new)) - tried[k]
                if right != "utf-8":
                    if not wide and right == "cp1252" and pairs.min() < (2.5 if (left.isalpha() or after.isalpha()) and all(c in LATIN_LOOKALIKES for c in part if not c.isascii()) else 0.6):
                        continue  # between single bytes every text has a mapping: no pair of the original may be rare
                    gain += 1.0 if not wide and right == "cp1252" else -3.0 if right == "gb18030" and len(new) < 6 else -1.5
                else:
                    gain += 3.0 if not lost else -1.0  # valid sequences of several bytes are no accident
                if gain > (best[0] if best else 2.0):
                    best = (gain, k, new, not lost)
        if len(self.memo) > 20_000:
            self.memo.clear()
        self.memo[key] = best and best[1:]
        return best and (*ranges[best[1]], *best[2:])

    def restore(self, text: str, deep: int = 3) -> tuple[str, bool, bool]:
        """(text with all garbled parts undone, is a case, everything came back)."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        marked = bool(_MARKS.search(text))
        if len(codes) < 2:
            return text, marked, not marked
        case, whole, out, done = False, True, [], 0
        for start, end, score in self.parts(text, codes):
            start = max(start, done)
            if start >= end or score < LEAST_WIDE and self.wide(codes[start:end]).any():
                continue
            if got := self.undo(text, self.cuts(text, start, end, done)):
                out += [text[done : got[0]], got[2]]
                done, case, whole = got[1], True, whole and got[3]
        if self.lost[_hash(codes[:-1], codes[1:])].sum() > 2:  # replacement characters, decoded once more
            case, whole = True, False
        out.append(text[done:])
        final = "".join(out)
        if case and deep > 1 and not final.isascii():  # decoded wrongly more than once
            again, more, all_of_it = self.restore(final, deep - 1)
            if more and len(again) < len(final):
                final, whole = again, whole and all_of_it
        return final, case or marked, whole and not _MARKS.search(final)

    def parts(self, text: str, codes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """The segments, divided where East Asian signs meet others, without ASCII at their ends."""
        for start, end, score in self.segments(codes):
            for m in _SCRIPTS.finditer(text, start, end):
                yield m.start(), m.end(), score

    @staticmethod
    def cuts(text: str, start: int, end: int, least: int) -> list[tuple[int, int]]:
        """Ranges to try: the segment grown over the signs beside it that aren't ASCII, itself, and with its ends moved."""
        a, b = start, end
        wide = text[start] > "\u2e7f"
        same = lambda c: not c.isascii() and (c > "\u2e7f") == wide
        while a > least and same(text[a - 1]):
            a -= 1
        while b < len(text) and same(text[b]):
            b += 1
        ranges = [(a, b), (start, end)]
        if wide:  # several bytes a sign: the ends must fit
            ranges += [(a, end), (start, b), (start, end + 1), (start - 1, end), (start + 1, end), (start, end - 1), (start + 1, end - 1)]
        return list(dict.fromkeys((x, y) for x, y in ranges if least <= x < y <= len(text)))


def count_pairs(texts: list[DataFrame]) -> PairScores:
    """Pair counts over every text given (frames of one string column)."""
    all_texts = reduce(DataFrame.unionAll, texts)
    got = all_texts.mapInArrow(_count, _SCHEMA).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    return PairScores(got["bucket"].to_numpy(), got["n"].to_numpy())


def _scan(broadcast, restoring: bool):
    """mapInArrow function: the last column is the text; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(PairScores.shared(broadcast))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            look = np.flatnonzero(restorer.suspects(texts))
            got = {i: restorer.restore(texts[i]) for i in look.tolist()}
            if restoring:
                new = pa.array([got[i][0] if i in got else t for i, t in enumerate(texts)], pa.string())
                case = pa.array([i in got and got[i][1] for i in range(len(texts))], pa.bool_())
                whole = pa.array([i not in got or got[i][2] for i in range(len(texts))], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, new, case, whole], names=[*batch.schema.names, "restored", "garbled", "recovered"])
            else:
                keep = pa.array([i for i, x in got.items() if x[1]], pa.int64())
                yield batch.select(batch.schema.names[:-1]).take(keep)

    return run


def _values(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    text = blocks.select(F.lit("text").alias("field"), F.col("block_id").alias("record_key"), F.col("text").alias("value"))
    title = documents.select(F.lit("title").alias("field"), F.col("document_id").alias("record_key"), F.col("title").alias("value"))
    return text.unionAll(title)


def corpus_scores(blocks: DataFrame, documents: DataFrame) -> PairScores:
    return count_pairs([blocks.select("text"), documents.select("title")])


def restore(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(field, record_key, value, restored, garbled, recovered) of every text and title."""
    shared = blocks.sparkSession.sparkContext.broadcast(corpus_scores(blocks, documents).packed())
    schema = "field string, record_key string, value string, restored string, garbled boolean, recovered boolean"
    return _values(blocks, documents).mapInArrow(_scan(shared, True), schema)


def found(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of p1_found."""
    shared = blocks.sparkSession.sparkContext.broadcast(corpus_scores(blocks, documents).packed())
    return _values(blocks, documents).where("value is not null").mapInArrow(_scan(shared, False), "field string, record_key string").distinct()


def garbled_keys(blocks: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of candidates (key, value), the keys whose value is garbled, by the statistics of the whole corpus."""
    shared = blocks.sparkSession.sparkContext.broadcast(corpus_scores(blocks, documents).packed())
    return candidates.mapInArrow(_scan(shared, False), f"{candidates.columns[0]} string")
