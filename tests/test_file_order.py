"""File order of staged rows: one large unsplittable file, many small ones, and one that is read in blocks."""

import gzip

import pytest
from pyspark.sql import functions as F

from reckoner.operators.ordering import durable
from reckoner.sources import readers


def _write(path, name, start, n, packed=True):
    lines = "user_id,parent_asin,rating,timestamp\n" + "".join(f"u{i},p{i % 7},{i % 5}.0,{i}\n" for i in range(start, start + n))
    (path / name).write_bytes(gzip.compress(lines.encode()) if packed else lines.encode())


@pytest.mark.parametrize("packed", [True, False])
def test_rows_keep_the_order_of_their_files(spark, tmp_path, packed):
    ending = ".csv.gz" if packed else ".csv"
    sizes = {f"a-large{ending}": 20_000, **{f"b-{i:03d}{ending}": i % 4 for i in range(60)}}
    at, expected = 0, {}
    for name, n in sizes.items():
        _write(tmp_path, name, at, n, packed)
        for i in range(n):
            expected[at + i] = (name, i, at + i)
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        staged = readers.staged_in_file_order(readers.read_ratings(spark, str(tmp_path)), rows_per_file=3000)
        rows = staged.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["timestamp"]: (r["source_file"].split("/")[-1], r["row_in_file"], r["row_order"]) for r in rows} == expected
    assert staged.columns == ["user_id", "parent_asin", "rating", "timestamp", "source_file", "row_in_file", "row_order"]


def test_a_task_writes_files_of_bounded_rows(spark):
    staged = durable(spark.range(1000).coalesce(1), rows_per_file=300)
    per_file = staged.groupBy(F.col("_metadata.file_path")).count().collect()
    assert sorted(r["count"] for r in per_file) == [100, 300, 300, 300]
