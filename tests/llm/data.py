"""Small tables with the cases that every operator must bear."""

import random

SYLLABLES = "re tion an the of ing en ou er le ver ge ich que".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(30_000, 1)
BASE = prose(120, 2)

#: Ids repeat and are null; texts are null, empty, blank, very long, equal and nearly equal.
DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, BASE), (5, BASE), (6, BASE + " end"), (7, "X" + BASE[1:].upper()),
    (8, "two words"), (9, "TWO words"), (10, prose(60, 3)), (None, prose(80, 4)), (None, BASE), (11, "!"), (12, "12 34"),
    (13, prose(40, 5) + "\nmail a.b@c.example.org now\n" + prose(10, 6)),
]

#: Names that operators use inside.
CLASHING = ["score", "items", "label", "n", "bucket", "shard", "slot", "start", "sid", "part", "size", "base", "ids", "_text"]


def docs(spark, rows=DOCS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})
