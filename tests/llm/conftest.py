import random

import pytest

from pyspark.sql import functions as F

#: Rows that every operator must take: nulls, empty and odd texts, repeated rows, ties.
ODD = [(None, "no id at all, but words enough to make a shingle or two", None), (900, None, "en"), (901, "", "de"), (902, "...", None), (903, "word", "en"), (904, "tie of ids", "en"), (904, "tie of ids", "en"), (904, "tie of ids with another text", None), (905, "é😀 ünïcode — ﬁn", "fr"), (906, "long " * 4000, "en"), (907, "x" * 3000, None)]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    """Prose with copies, near copies and shared passages, the odd rows, and columns whose names operators use themselves."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)] + ["the", "of", "and"] * 40
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, rows = prose(60), []
    for i in range(60):
        rows.append((i, prose(rnd.randrange(3, 120)), "en"))
    for i in range(60, 75):
        rows.append((i, rows[i % 7][1], "en"))
    for i in range(75, 95):
        w = rows[40 + i % 4][1].split()
        w[rnd.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "de"))
    for i in range(95, 105):
        rows.append((i, f"{prose(20)} {passage} {prose(10)}", None))
    return spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string").select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(x) for x in ("row", "n", "ref", "key", "start", "spans", "h", "range", "hash", "gone", "other_id", "other_h", "email", "at")]).repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
