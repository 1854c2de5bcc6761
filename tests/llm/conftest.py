import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, near copies, and a column with an awkward name."""
    words = [f"w{k % 97}x{k % 13}" for k in range(400)]
    base = " ".join(words[:120])
    near = base.replace(words[60], "changed", 1)
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base.replace(" ", "\n  "), "b"), (4, near, "b"), (5, None, "a"), (6, "", None), (7, "one two three", "c"),
        (8, "one two three", "c"), (9, "one two three four", "c"), (None, base, "a"), (None, None, None), (10, " ".join(words * 60), "hot"), (11, "ünï ÇÖDE 日本語 <|endoftext|> don't", "hot"), (12, " ".join(reversed(words)), "hot"),
    ]
    return spark.createDataFrame([(*r, "kept?") for r in rows], "doc_id long, text string, source string, `ke.pt` string").withColumn("Score", F.lit(1)).withColumn("n_words", F.lit("x"))


@pytest.fixture
def empty(docs):
    return docs.limit(0)
