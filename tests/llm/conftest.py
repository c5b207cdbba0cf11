import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) tuples, with an extra column
    whose name clashes with what the operators return."""
    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "src0"][len(r) - 2:]), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        return df.withColumn("size", F.lit("extra")).withColumn("keep", F.lit(1)).withColumn("component_id", F.lit("x"))
    return make


@pytest.fixture(scope="session")
def words():
    """Text of n pseudo-random words, the same for a seed."""
    import random

    def make(n, seed, vocab=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))
    return make
