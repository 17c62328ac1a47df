"""The catalogue as the sink of a stream: batches that run again, totals."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.operators import catalog
from terraspan.plans import registry
from terraspan.sources import encoders, readers
from terraspan.streaming import catalogue


def image(k):
    return encoders.tiff(np.full((4, 5, k % 3 + 1), k, np.uint8))


def test_batches_that_run_twice_change_nothing(spark, tmp_path):
    folder, out, check = tmp_path / "files", str(tmp_path / "catalogue"), str(tmp_path / "check")
    folder.mkdir()
    for run in range(3):
        for k in range(6):
            (folder / f"r{run}_{k}.tif").write_bytes(image(4 * run + k))  # two of each run are copies of the next one's
        (folder / f"empty{run}.tif").write_bytes(b"")
        (folder / f"text{run}.png").write_bytes(b"no image")
        catalogue.ingest_stream(catalogue.read_files(spark, str(folder), 3), out, check).awaitTermination()
        seen = {r.file_hash: r.file_name for r in catalogue.scenes(spark, out).collect()}
        assert len(seen) == catalogue.scenes(spark, out).count() == 4 * run + 6
    assert {r.outcome: r.files for r in catalogue.outcomes(spark, out).collect()} == {"NEW": 14, "UNSUPPORTED": 3}  # Spark's file sources pass over empty files
    before = sorted(map(str, catalogue.totals(spark, out).drop("latest").collect()))
    scan = catalog.archive_stats(catalogue.scenes(spark, out), geo=F.col("epsg").isNotNull())
    assert sorted(map(str, catalogue.totals(spark, out).collect())) == sorted(map(str, scan.collect()))
    # the last batch again, as after a failure between its writes and the commit
    number = max(int(p.name.split("=")[1]) for p in (tmp_path / "catalogue" / "scenes").iterdir())
    kept = spark.read.parquet(f"{out}/scenes/batch={number}").drop("ingested_at")
    rows = spark.createDataFrame(kept.collect(), kept.schema)
    catalogue.keep_batch(rows, number, out)
    assert sorted(map(str, catalogue.totals(spark, out).drop("latest").collect())) == before


def test_broken_files_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "scenes")
    assert readers.scenes(spark, path).count() == 0 and readers.vector_index(spark, path).count() == 0
    spark.createDataFrame([(f"s{k}",) for k in range(20)], "scene_id string").repartition(4).write.parquet(path)
    part = sorted((tmp_path / "scenes").glob("part*"))[0]
    lost = spark.read.parquet(str(part)).count()
    for p in (tmp_path / "scenes").glob(f".{part.name}.crc"):
        p.unlink()
    part.write_bytes(b"broken")
    assert readers.scenes(spark, path).select("scene_id").distinct().count() == 20 - lost > 0


@pytest.mark.parametrize("name", ["src_stream_totals", "src_stream_ingest"])
def test_keys_that_look_like_days(spark, tmp_path, name):
    """Keys of eight digits, as large tables have them, with 20000230 and 20000231."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey < 300")
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 20_000_100).write.parquet(str(tmp_path / "orders.parquet"))
    found = duckdb.execute(registry.ORACLE_SQL[name].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.select([c[0] for c in found.description]).collect()))) == sorted(map(str, found.fetchall()))
