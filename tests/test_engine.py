"""Fixtures of the column-expression libraries and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import gates, geo, language, raster
from terraspan.operators import discovery, evidence, temporal
from terraspan.sources import readers
from terraspan.streaming import observations


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_geo(spark):
    t = F.array(*[F.lit(x) for x in (272000.0, 10.0, 0.0, 2108000.0, 0.0, -10.0)])
    r = one(
        spark, p=geo.pixel_to_projected(F.lit(10), F.lit(20), t), w=geo.to_wgs84(F.lit(272000.0), F.lit(2108000.0), F.lit(32643)),
        b=geo.bounds_of(F.lit(100), F.lit(100), t, F.lit(32643)), a=geo.ground_area(F.lit(10000), F.lit(10.0), F.lit(-10.0), F.lit(32633)),
        n=geo.to_wgs84(F.lit(1.0), F.lit(1.0), F.lit(2154)),
    )
    assert tuple(r.p) == (272100.0, 2107800.0) and 72 < r.w.lng < 73.5 and 18.5 < r.w.lat < 19.5 and r.n is None
    assert (r.b.min_x, r.b.max_x, r.b.min_y, r.b.max_y) == (272000.0, 273000.0, 2107000.0, 2108000.0)
    assert (r.a.status, r.a.m2, r.a.ha) == ("CALCULATED", 1_000_000.0, 100.0)


def test_query_plan(spark):
    q = F.lit("Find newly built structures near rivers between 2022 and 2024")
    r = one(spark, p=language.parse_query(q), bare=language.parse_query(F.lit("structures near rivers")), compat=language.parse_query(F.lit("structures near rivers"), True))
    assert r.p.intent == "TEMPORAL_CHANGE_DISCOVERY" and r.p.objects == ["built structures"] and r.p.date_range.end == "2024-12-31"
    assert r.p.spatial_relation.feature == "rivers" and r.bare.spatial_relation.feature == "rivers" and r.compat.spatial_relation is None
    assert len(r.p.operations) == 8


def test_band_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 50)] + [("b", math.nan)], "s string, value double")
    got = {r.s: r for r in raster.band_statistics(df, ["s"]).collect()}
    assert (got["a"].min, got["a"].max, got["a"].mean, got["a"].n) == (10, 50, 30, 5) and round(got["a"].std_dev, 4) == 14.1421
    assert (got["b"].min, got["b"].n) == (0.0, 0)


def test_season_and_cloud(spark):
    d = lambda m: F.lit(f"2024-{m:02d}-01").cast("date")
    r = one(spark, a=gates.seasonality(d(7), d(1)), b=gates.seasonality(d(3), d(6)), c=gates.seasonality(d(12), d(1)), e=gates.cloud(F.lit(None).cast("double"), F.lit(41.0)))
    assert (r.a, r.b, r.c, r.e) == ("HIGH", "HIGH", "NONE", "CONTAMINATED")


def test_clusters(spark):
    base = [(0.9, 0.1, 0), (0.85, 0.15, 0), (0.88, 0.12, 0), (0, 0.1, 0.9), (0, 0.15, 0.85), (0, 0.12, 0.88)]
    rows = [(k, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for k, v in enumerate(base)]
    got = discovery.spherical_kmeans(spark.createDataFrame(rows, "id long, v array<double>"), F.col("v"), "id", 2).collect()
    cluster = {r.id: r.cluster for r in got}
    assert len({cluster[k] for k in (0, 1, 2)}) == len({cluster[k] for k in (3, 4, 5)}) == 1 and cluster[0] != cluster[3]
    assert all(r.similarity > 0.9 for r in got) and sum(r.medoid for r in got) == 2


def test_days_between(spark):
    r = one(spark, d=temporal.days_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2023-12-30 11:00:00").cast("timestamp")))
    assert r.d == 2


def test_ingest_folder(spark, tmp_path):
    for name, data in (("s2_20240315_a.png", b"one"), ("b.png", b"two"), ("c.tif", b"one"), ("notes.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files = readers.raster_folder(spark, str(tmp_path))
    none = spark.createDataFrame([], "file_hash string")
    got = {r.file_name: r for r in readers.ingested(files, none).collect()}
    assert {n: r.outcome for n, r in got.items()} == {"s2_20240315_a.png": "DUPLICATE", "b.png": "NEW", "c.tif": "NEW"}
    blank = spark.createDataFrame([("corrupt.tif", bytearray())], "file_name string, content binary")
    assert readers.ingested(blank, none).first().outcome == "EMPTY_BUFFER"
    again = readers.ingested(files, spark.createDataFrame([(got["b.png"].file_hash,)], "file_hash string"))
    assert {r.file_name: r.outcome for r in again.collect()}["b.png"] == "DUPLICATE"


@pytest.mark.parametrize("mode", ["strict", "clamp", "evidence"])
def test_boxes(spark, mode):
    def reason(*box, label="x"):
        return one(spark, r=geo.check_box(*[F.lit(float(b)) for b in box], F.lit(label), mode))["r"]["reason"]

    assert reason(100, 100, 500, 500) is None and reason(500, 100, 100, 500) == "EMPTY"
    assert reason(0, 0, 1000, 1000) == (None if mode == "strict" else "WHOLE_IMAGE")


def test_audit_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "event_id long, event_type string, value double").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    events = observations.read_events(spark, str(tmp_path / "in"), df.schema)
    observations.append_audit(observations.distinct_events(events), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_language_queries_take_every_row(spark, tmp_path):
    import re

    from terraspan.functions import language as lang
    from terraspan.plans import catalog_queries, language_queries  # noqa: F401
    from terraspan.plans._base import QUERIES

    said = ["Houses near the river", "ships along the coast in 2021", "fields  within  a delta during monsoon", "roads near indus plain", "hello you there", "", None]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(said)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    asked = dict(enumerate(language_queries.QUESTIONS)) | {1_000_000 + 1000 * k: t for k, t in enumerate(said)}

    def rows(name):
        return {r[0]: r[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}

    pattern = r"(near|along|around|close to|adjacent to|within)\s+([a-z\s]+?)(?=\s+(?:between|from|in|using|with|during)\b|\s*$)"
    found = {k: re.search(pattern, (t or "").strip().lower()) for k, t in asked.items()}
    relations = rows("str_spatial_relation")
    assert relations == {k: (m[1], m[2].strip()) if m else (None, None) for k, m in found.items()}
    assert relations[1_000_000] == ("near", "the river") and relations[1] == ("near", "rivers")
    meaning, intent = rows("str_semantic_query"), rows("str_search_intent")
    assert meaning.keys() == intent.keys() == asked.keys()
    stops = r"(?a:\b)(" + "|".join(lang.STOP_WORDS) + r")(?a:\b)"
    assert meaning[1_004_000][0] == re.sub(r"\s+", " ", re.sub(stops, " ", said[4])).strip()
    assert intent[1_003_000][0] == "RELATIONAL_SEARCH" and intent[1_004_000][0] == "GENERAL_SEMANTIC"

    sizes = [0, 1023, 1024, 1280, 1_048_064, 1_048_576, 1_073_000_000, 2 << 30, 1300 << 30]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long")
    texts = [r.t for r in df.select("doc_id", lang.bytes_text(F.col("n_chars")).alias("t")).orderBy("doc_id").collect()]
    assert texts == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1023.5 KB", "1.0 MB", "1023.3 MB", "2.00 GB", "1300.00 GB"]


def test_clusters_odd_vectors(spark):
    """Items that can't be compared stay in the result, in no cluster."""
    rows = [(0, None), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [])]
    for n in (1, 16):  # tasks without rows, too
        got = {r.id: r for r in discovery.spherical_kmeans(spark.createDataFrame(rows, "id long, v array<double>").repartition(n), F.col("v"), "id", 2).collect()}
        assert sorted(got) == list(range(9))
        assert got[1].cluster == got[2].cluster == 1 and got[3].cluster == 2 and sum(r.medoid for r in got.values()) == 2
        assert all(got[k].cluster is None and got[k].similarity is None and got[k].medoid is False for k in (0, 4, 5, 6, 7, 8))


def test_cross_modal_of_copies(spark):
    """Regions alike in class and box meet once: 5,000 by 5,000 make one pair."""
    box = [F.lit(x).alias(n) for n, x in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 0.3), ("ymax", 0.3))]
    a = spark.range(5000).select(F.lit(1).alias("s"), F.lit("WATER_CANDIDATE").alias("category"), *box)
    b = spark.range(5000).select(F.lit(1).alias("s"), F.lit("LOW_BACKSCATTER_SPECULAR").alias("kind"), *box)
    a, b = (spark.createDataFrame(x.collect(), x.schema) for x in (a, b))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = evidence.cross_modal(a, b, "s")
        plan = found._jdf.queryExecution().executedPlan()
        assert [tuple(r) for r in found.collect()] == [(1, "AGREEMENT")]

        def joined(p):
            out = [p.metrics().apply("numOutputRows").value()] if "Join" in p.nodeName() else []
            return out + [n for k in range(p.children().size()) for n in joined(p.children().apply(k))]

        found._jdf.collectToPython()
        assert max(joined(plan)) <= 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sql_rounds_as_the_texts_do(spark, tmp_path):
    """Numbers that lie about half-way between two texts."""
    import duckdb

    from terraspan.plans import registry

    spark.range(0, 2_000_000, 5000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["str_area_text"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(db.execute(registry.ORACLE_SQL["str_area_text"]).fetchall())
    sim = [k / 20000 for k in range(10001, 20000, 2)]
    shown = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(sim)], "k int, sim double").orderBy("k").select(F.format_number(F.col("sim") * 100, 1)).collect()]
    assert "printf('%.1f', sim * 100)" in registry.ORACLE_SQL["str_match_reasons"]
    assert shown == [db.execute("SELECT printf('%.1f', ?::DOUBLE * 100)", [x]).fetchone()[0] for x in sim]


def test_embedding_sql_compares_rounded_values(spark, tmp_path):
    """Values that exceed the limit of 0.001 before they are rounded only."""
    import duckdb

    from terraspan.plans import registry

    first, shift = 82 * 6272, 450_000  # of the 6,272 orders of an image, in the fourth copy of the table
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + shift)
    orders.where(F.col("o_orderkey").between(first, first + 6271)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["vec_image_embedding"](spark, str(tmp_path)).collect()]
    assert got and sorted(got) == sorted(db.execute(registry.ORACLE_SQL["vec_image_embedding"]).fetchall())


def test_grid_cells_look_at_every_pixel(spark):
    """One bright pixel between those that a stride of 8 would meet."""
    p = raster.grid(spark, 224, 224).withColumn("r", F.when((F.col("x") == 61) & (F.col("y") == 3), 255.0).otherwise(0.0)).withColumns({"g": F.lit(0.0), "b": F.lit(0.0)})
    means = {r.cell: r.mean_value for r in raster.grid_cells(p.withColumn("s", F.lit(1)), ["s"]).collect()}
    dark = -sum(m / s for m, s in zip(raster.CHANNEL_MEAN, raster.CHANNEL_STD, strict=True))
    assert len(means) == 16 and means[1] == pytest.approx(dark + 1 / 0.229 / 56**2) and means[0] == pytest.approx(dark)
    sampled = {r.cell: r.mean_value for r in raster.grid_cells(p.withColumn("s", F.lit(1)), ["s"], stride=8).collect()}
    assert sampled == pytest.approx(dict.fromkeys(range(16), dark))
