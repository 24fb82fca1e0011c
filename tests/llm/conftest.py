import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names clash with inner ones."""

    def make(rows, parts=3):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCUMENT)
        for name in ("n", "key", "bands", "gone", "hits", "pattern", "score", "anchor", "rep", "hit_doc", "a.b"):
            frame = frame.withColumn(name, frame["doc_id"] if name != "key" else frame["text"])
        return frame.repartition(parts)

    return make
