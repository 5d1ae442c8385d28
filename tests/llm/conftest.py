import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text)`` rows, with columns whose names clash with the results'."""

    def make(rows, extra=True):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, schema)
        if not extra:
            return frame
        clash = ("keep_id kept group_size text_sha256 score key rank shard start ids spans found row owner value "
                 "host path rule verdict listed class_id n_links block bucket").split()  # fmt: skip
        from pyspark.sql import functions as F

        return frame.withColumns({c: F.lit("x") for c in clash})

    return make
