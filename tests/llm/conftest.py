import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind: nulls, empty, blank, long, repeated rows, and extra columns whose names clash."""
    line = "the same footer line of the site, seen everywhere"
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "short text", "en", None), (5, own(5), "en", "a"), (5, own(5), "en", "a"),
        (6, own(5), "en", "b"), (None, own(7), "en", "a"), (None, None, None, None), (8, own(8) + "\n" + line, "en", "a"), (9, "word " * 30_000, "en", "b"), (10, "é" * 5000 + " ü", "de", "b"),
    ]
    rows += [(20 + k, own(20 + k) + "\n" + line, "en", "a") for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_words": F.lit("clash"), "size": F.lit(1), "kept": F.lit("x"), "shard": F.lit(None).cast("string"), "score": F.lit("s"), "host": F.lit(0), "_id": F.lit("i"), "offset": F.lit(9)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
