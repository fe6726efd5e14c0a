import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long and repeated texts; null ids and sources; extra
    columns whose names clash with outputs."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, "a", 0), (2, "", "a", 0), (3, " \t\n", "b", 3), (4, "one", "b", 3), (5, long_text, "b", len(long_text)),
        (6, "same words here and there", None, 25), (7, "same words here and there", None, 25),
        (7, "same words here and there", None, 25), (None, "no id at all", "c", 12), (8, "été ß 漢字 🙂 ok", "c", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("score", "fp", "size", "n", "part", "h", "c0", "key", "place"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
