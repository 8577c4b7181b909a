import pytest
from pyspark.sql import functions as F

#: Documents of every awkward kind: null and empty texts, null ids, repeated rows, ties, long texts, other scripts.
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PASSAGE), (2, PASSAGE), (3, PASSAGE + " tail"), (3, PASSAGE + " tail"), (4, None), (5, ""), (None, PASSAGE + " other ending"), (None, None),
    (6, "Ünï 😀 x\r\ny"), (7, "a " * 3000), (8, "日本語のテキスト。" * 40), (9, " \t\n "), (10, "x" * 5000), (11, "one two three"), (12, "One TWO three"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The documents with extra columns whose names clash with common internal ones."""
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    return d.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "s0"), "n_chars": F.length("text").cast("long"), "d": F.lit(1), "k": F.lit("k"), "h": F.lit(2), "id": F.lit("i"), "n": F.lit(0), "spans": F.lit("s"), "key": F.lit(0)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
