import numpy as np
import pytest

from blockloom.llm import mojibake as M

GOOD = ["Die Prüfung der Öffnung für Müller fand im März statt.", "操作员检查了管网压力，结果正常。", "L'équipe a vérifié la pression à l'été.", "The operator checked 30 °C and £5."]


@pytest.fixture(scope="module")
def restorer():
    import pyarrow as pa

    texts = GOOD * 500
    got = list(M._count([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))[0]
    return M.Restorer(M.PairScores(got.column(0).to_numpy(), got.column(1).to_numpy()))


@pytest.mark.parametrize(("wrong", "right"), [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("gbk", "utf-8"), ("latin-1", "gbk")])
def test_round_trip(restorer, wrong, right):
    text = GOOD[1] if right == "gbk" or wrong == "gbk" else GOOD[0]
    try:
        garbled = text.encode(right).decode(wrong)
    except UnicodeDecodeError:
        garbled = text.encode(right).decode(wrong, "replace")
    assert restorer.suspects([garbled])[0]
    out, case, whole = restorer.restore(garbled)
    assert case and (out == text or "�" in garbled)


def test_twice_and_lost(restorer):
    twice = GOOD[0].encode().decode("cp1252").encode().decode("cp1252", "replace")
    assert restorer.restore(twice)[1]
    lost = GOOD[1].encode("gbk").decode("utf-8", "replace").encode().decode("gbk", "replace")
    assert restorer.suspects([lost])[0] and restorer.restore(lost)[1]
    assert restorer.restore("caf� bar")[1:] == (True, False)


def test_correct_text_is_no_case(restorer):
    odd = ["Ångström, Ærø, Ðakovo", "ГОСТ 42, μ = 0.002", "", "plain", "龜", "Código: SÃO TOMÉ", "👩‍🔧 👍🏽"]
    for t in GOOD + odd:
        assert not restorer.restore(t)[1], t
    assert not restorer.suspects([None, "", "plain"]).any()


def test_counts_add_up():
    import pyarrow as pa

    got = list(M._count([pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "ab"])], names=["t"])]))[0]
    n = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    assert n[int(M._hash(np.array([97]), np.array([98]))[0])] == 2 and sum(v for k, v in n.items() if k >= 1 << M.PAIR_BITS) == 4


def test_frames(spark, make_blocks):
    docs = spark.createDataFrame([("d", None), ("e", GOOD[0].encode().decode("latin-1")), ("e", None)], "document_id string, title string")
    rows = [{"block_id": f"g{i}", "text": t} for i, t in enumerate(GOOD * 100)] + [{"block_id": "bad", "text": GOOD[0].encode().decode("cp1252")}] * 2 + [{"block_id": "null"}, {"block_id": "long", "text": "x" * 200_000}]
    got = M.found(make_blocks(rows), docs)
    assert sorted(map(tuple, got.collect())) == [("text", "bad"), ("title", "e")]
    assert M.found(make_blocks([]), docs.limit(0)).count() == 0
