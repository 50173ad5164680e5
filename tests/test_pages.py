from blockloom.operators import pdf


def words(spark, rows):
    return spark.createDataFrame([("d", 1, *r) for r in rows], "document_id string, page int, text string, x0 double, top double, x1 double, bottom double")


def test_lines(spark):
    w = words(spark, [("world", 40.0, 101.0, 60.0, 110.0), ("Hello", 10.0, 100.0, 30.0, 109.0), ("水", 10.0, 120.0, 20.0, 130.0), ("厂", 26.0, 122.0, 34.0, 130.0), (" ", 1.0, 300.0, 2.0, 301.0)])
    got = pdf.lines(w).orderBy("line").collect()
    assert [(r.text, r.word_count) for r in got] == [("Hello world", 2), ("水厂", 2)]


def test_words_outside_tables(spark):
    w = words(spark, [("in", 10.0, 10.0, 20.0, 20.0), ("out", 100.0, 10.0, 120.0, 20.0)])
    box = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 50.0)], "document_id string, page int, x0 double, top double, x1 double, bottom double")
    assert [r.text for r in pdf.words_outside(w, box).collect()] == ["out"]


def test_paragraphs_and_pictures(spark):
    w = words(spark, [("first exam-", 10.0, 100.0, 90.0, 110.0), ("ple line", 10.0, 114.0, 90.0, 124.0), ("apart.", 10.0, 200.0, 90.0, 210.0)])
    got = pdf.paragraphs(pdf.lines(w)).orderBy("first_line").collect()
    assert [r.text for r in got] == ["first example line", "apart."]
    p = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 0.0, 12.0, 10.0, 20.0), ("d", 1, 0.0, 90.0, 10.0, 99.0)], "document_id string, page int, x0 double, top double, x1 double, bottom double")
    assert sorted((r.bbox, r.n) for r in pdf.group_pictures(p).collect()) == [([0.0, 0.0, 10.0, 20.0], 2), ([0.0, 90.0, 10.0, 99.0], 1)]
    assert pdf.lines(words(spark, [])).count() == 0
