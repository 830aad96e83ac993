from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 3000 + "end."
EDGES = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one two"), (900005, "one two"), (900006, LONG), (900007, LONG + " more words at the end"),
    (900008, "𝔸stral 😀 émoji's don't we'll\r\n\r\n  x  \n 's"), (900008, "𝔸stral 😀 émoji's don't we'll\r\n\r\n  x  \n 's"), (None, "no id here, but words enough to be seen"),
    (900009, "Mail a.b@c.de or +49 (30) 1234-567 or 4111 1111 1111 1111 or 1.2.3.256 or 10.0.0.1 token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\"."),
    (900010, "GNU General Public License and the MIT License, CC BY 4.0, cc by, gnu general public license version 3 or later"),
]


@pytest.fixture(scope="session")
def rows(spark, sf) -> list[tuple]:
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return docs + [(i, t, None, None) for i, t in EDGES]


@pytest.fixture(scope="session")
def folder(spark, sf, rows, tmp_path_factory) -> str:
    """The small tables with hard rows added, and columns whose names clash with those that operators use."""
    out = str(tmp_path_factory.mktemp("edges"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumns({"n_chars": F.length("text").cast("long"), **{c: F.lit("x") for c in ("id", "h", "node", "score", "bucket", "votes", "ids", "start", "key", "label")}})
    df.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="session")
def none(spark, folder, tmp_path_factory) -> str:
    """Empty tables of the same schemas."""
    out = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out
