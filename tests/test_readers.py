"""Matrix and dot plot files: odd layouts, and no cell crosses a shuffle."""

from pairscope.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_files_are_judged_inside_their_row(spark):
    texts = {
        "good": "2\n0 1\n 2 3 \n# end", "crlf": "1\r\n0.5\r\n", "short": "3\n1 2 3\n4 5 6", "wide": "2\n1 2 3\n4 5", "narrow": "2\n1\n2 3", "word": "2\n1 x\n2 3",
        "nan": "1\nNaN", "empty": "", "zero": "0\n", "negative": "-1\n5", "no_number": "x\n1", "null": None}
    files = spark.createDataFrame(list(texts.items()), "path string, value string")
    cells, rejects = readers.ingest_scores(files)
    assert sorted(map(tuple, cells.collect())) == [
        ("crlf", 0, 0, 0.5), ("good", 0, 0, 0.0), ("good", 0, 1, 1.0), ("good", 1, 0, 2.0), ("good", 1, 1, 3.0)]
    assert dict(map(tuple, rejects.collect())) == {
        "short": "layout", "wide": "matrix", "narrow": "matrix", "word": "matrix", "nan": "matrix", "empty": "layout", "zero": "layout",
        "negative": "layout", "no_number": "layout", "null": "layout"}
    assert "Exchange" not in plan_of(cells)


def test_dot_plots_are_judged_inside_their_row(spark):
    full = "% i j\n1 2 0.5 ubox\r\n 1 3  1 ubox \n2\t3 0 ubox\n1 2 0.9 lbox"
    texts = {
        "full": (3, full), "missing": (3, "1 2 0.5 ubox\n1 3 1 ubox"), "twice": (2, "1 2 0.5 ubox\n1 2 0.5 ubox"), "large": (2, "1 2 1.5 ubox"),
        "lower": (2, "2 1 0.5 ubox"), "outside": (2, "1 3 0.5 ubox"), "word": (2, "1 2 x ubox"), "long": (2, "1 99999999999 0.5 ubox"),
        "one": (1, "nothing"), "none": (2, ""), "null": (2, None)}
    files = spark.createDataFrame([(k, *v) for k, v in texts.items()], "path string, sequence_length int, value string")
    cells, rejects = readers.ingest_dotplot(files)
    assert sorted(map(tuple, cells.collect())) == [("full", 0, 1, 0.25), ("full", 0, 2, 1.0), ("full", 1, 2, 0.0)]
    assert dict(map(tuple, rejects.collect())) == {
        "missing": "incomplete", "twice": "duplicate", "large": "invalid_record", "lower": "invalid_record", "outside": "invalid_record",
        "word": "invalid_record", "long": "invalid_record", "none": "incomplete", "null": "incomplete"}
    assert "Exchange" not in plan_of(cells)
