from __future__ import annotations

from quarry.llm import session


def test_tables_between_steps_are_small(spark):
    rows = spark.range(2000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 40), x -> sha2(cast(id % 7 * x as string), 256))) AS text")
    table = session.cut(rows, "texts")
    assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
