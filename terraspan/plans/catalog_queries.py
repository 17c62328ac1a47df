"""Catalogue queries; documents stand for scenes (lang: modality, source:
sensor, n_chars: file size)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan import schemas
from terraspan.lineage import own_path
from terraspan.operators import catalog
from terraspan.plans._base import query, table
from terraspan.sources import readers

COLUMNS = {"file_name": "text", "scene_id": "doc_id", "sensor": "source", "satellite": "source", "modality": "lang", "format": "lang", "status": "lang"}


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def flt_text_search(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(catalog.text_search(" License ", "text", "source")).select("doc_id", "n_chars")


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'de' AND contains(lower(source), 'src1')")
def flt_modality_sensor(spark, sf):
    return catalog.filter_scenes(table(spark, sf, "documents"), modality="de", sensor="SRC1", satellite="all", columns=COLUMNS).select("doc_id", "source", "lang")


@query("SELECT doc_id, lang FROM documents")
def flt_all_bypass(spark, sf):
    return catalog.filter_scenes(table(spark, sf, "documents"), modality="all", format="all", columns=COLUMNS).select("doc_id", "lang")


GEO = "CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN 'unavailable' ELSE 'EPSG:32643' END"


def _with_crs(docs):
    n = F.col("n_chars")
    crs = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, "unavailable").otherwise("EPSG:32643")
    return docs.withColumns({"crs": crs, "geo_status": F.when(n % 3 == 0, "UNAVAILABLE").otherwise("AVAILABLE")})


@query(f"""SELECT doc_id, false AS geo FROM documents WHERE NOT coalesce(({GEO}) <> 'unavailable' AND n_chars % 3 <> 0, false)
UNION ALL SELECT doc_id, true FROM documents WHERE coalesce(({GEO}) <> 'unavailable' AND n_chars % 3 <> 0, false)""")
def flt_georeferenced(spark, sf):
    docs = _with_crs(table(spark, sf, "documents"))
    cols = COLUMNS | {"geo_status": "geo_status"}
    parts = [catalog.filter_scenes(docs, has_crs=g, columns=cols).select("doc_id", F.lit(g).alias("geo")) for g in (False, True)]
    return parts[0].unionByName(parts[1])


DATED = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END"


def _dated(orders):
    return orders.withColumn("d", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp")))


@query(f"SELECT o_orderkey FROM orders WHERE ({DATED}) >= TIMESTAMP '1995-01-01' AND ({DATED}) <= TIMESTAMP '1996-12-31'")
def flt_date_range(spark, sf):
    orders = _dated(table(spark, sf, "orders"))
    start, end = F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")
    return orders.where(catalog.in_range(F.col("d"), start, end)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE ({DATED}) IS NULL OR (({DATED}) >= TIMESTAMP '1995-01-01' AND ({DATED}) <= TIMESTAMP '1996-12-31')")
def flt_date_range_keep_null(spark, sf):
    orders = _dated(table(spark, sf, "orders"))
    start, end = F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")
    return orders.where(catalog.in_range(F.col("d"), start, end, keep_null=True)).select("o_orderkey")


@query("""SELECT doc_id FROM documents WHERE lower(source) LIKE '%src3%' AND lower(lang) = 'fr'""")
def flt_override(spark, sf):
    """Filters override what a query implies where they are set: the sensor is
    the plan's, the modality the filter's."""
    from terraspan.operators.search import Plan, prefilter

    plan = Plan(sensor="src3", modality="en").with_filters(sensor="", modality="fr")
    docs = table(spark, sf, "documents")
    return prefilter(docs, plan, {"sensor": "source", "modality": "lang", "acquisition_date": "lang"}).select("doc_id")


@query("""SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents
ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100""")
def srt_page(spark, sf):
    docs = table(spark, sf, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    top = catalog.page(catalog.sort_scenes(docs, "n_chars", "desc", "doc_id"), offset=100, limit=0)
    return top.select("doc_id", "n_chars").join(F.broadcast(total))


@query("""SELECT CASE WHEN GROUPING(lang) = 0 THEN 'modality' WHEN GROUPING(source) = 0 THEN 'format' ELSE 'all' END AS facet,
  CASE WHEN GROUPING(lang) = 0 THEN lang WHEN GROUPING(source) = 0 THEN source END AS value, count(*) AS scenes,
  sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE n_chars % 2 = 0) AS georeferenced, max(doc_id) AS latest
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def agg_archive_stats(spark, sf):
    docs = table(spark, sf, "documents")
    return catalog.archive_stats(docs, "lang", "source", "n_chars", F.col("n_chars") % 2 == 0, "doc_id")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id = 42)")
def src_point_lookup_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    key = F.broadcast(docs.where("doc_id = 42").select("file_hash"))  # one row, found by a filter at the scan
    return docs.join(key, "file_hash", "left_semi").select("doc_id", "file_hash")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
def src_point_lookup_id(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("doc_id", "source", "lang", "n_chars")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars)::BIGINT AS chars FROM documents")
def src_full_scan(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash, count(*) AS copies FROM documents GROUP BY text""")
def set_hash_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return docs.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""WITH known AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en'),
fresh AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT min(doc_id) AS doc_id, h AS file_hash FROM fresh WHERE h NOT IN (SELECT h FROM known) GROUP BY h""")
def jn_ingest_anti_join(spark, sf):
    docs = table(spark, sf, "documents").withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    new = catalog.only_new(docs.select("doc_id", "file_hash"), docs.where("lang = 'en'"), "file_hash", [F.col("doc_id")])
    return new.select("doc_id", "file_hash")


@query("""SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def snk_upsert_latest(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return catalog.latest_per_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "value")


@query("""SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 5) UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label IN (2, 5)""")
def snk_upsert_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    changes = e.where("label IN (2, 5)").select("vec_id", (F.col("label") + 100).cast("int").alias("label"))
    return catalog.upsert(e, changes, "vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk_remove(spark, sf):
    return catalog.remove(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT vec_id, len(embedding) AS dimension FROM embeddings")
def snk_vector_dimension(spark, sf):
    rows = catalog.checked_vectors(table(spark, sf, "embeddings"), 64, "embedding")
    return rows.select("vec_id", F.size("embedding").cast("long").alias("dimension"))


@query("""SELECT doc_id AS scene_id, 'NO_VECTOR' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'NO_SCENE' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def qc_catalog_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("scene_id"))
    return catalog.consistency(docs, table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id")))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def st_session_history(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return c.withColumn("n", n).where("n <= 3").select("conv_id", "turn", "role")


@query("""SELECT event_id, ts::VARCHAR AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def win_newest_n(spark, sf):
    e = catalog.newest(table(spark, sf, "events"), 1000, "ts", "event_id")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")) if False else e.select("event_id", F.col("ts").cast("string").alias("at"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(tif|tiff|geotiff)$') THEN 'GeoTIFF' WHEN ends_with(lower(url), '.png') THEN 'PNG'
  WHEN regexp_matches(lower(url), '\\.jpe?g$') THEN 'JPEG' ELSE 'UNKNOWN' END AS format FROM pages""")
def src_format_detection(spark, sf):
    from terraspan.functions.language import file_format

    p = table(spark, sf, "pages")
    return p.select("page_id", file_format(F.col("url"), F.lit(None).cast("string"), F.col("html").cast("binary")).alias("format"))


@query("""SELECT d.doc_id, coalesce(l.quality, 70) AS score, CASE WHEN l.quality IS NULL THEN 'manifest' ELSE 'annotation' END AS origin
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn_manifest_annotations(spark, sf):
    from terraspan.operators.training import with_annotations

    docs = table(spark, sf, "documents").select("doc_id", F.lit(70).alias("score"), F.lit("manifest").alias("origin"))
    ann = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("score"), F.lit("annotation").alias("origin"))
    return with_annotations(docs, ann, "doc_id", ["score", "origin"])


@query("""SELECT p.p_partkey, coalesce(s.s_suppkey, (SELECT min(s_suppkey) FROM supplier)) AS s_suppkey, s.s_suppkey IS NOT NULL AS named FROM part p
LEFT JOIN (SELECT lower('Brand#' || (s_suppkey % 60)) AS brand, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON lower(p.p_brand) = s.brand""")
def jn_text_match(spark, sf):
    scenes = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 60).cast("string")).alias("file_name"))
    images = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("image"))
    return catalog.match_by_name(images, "image", scenes, "file_name", "s_suppkey").select("p_partkey", "s_suppkey", "named")


@query("""SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey""")
def jn_lookup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    dim = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(dim, c.c_nationkey == dim.n_nationkey).select("c_custkey", "n_name", "r_name")


@query("""SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en' AND contains(lower(text), 'the')""")
def flt_format_status(spark, sf):
    columns = {"format": "source", "status": "lang", "file_name": "text", "scene_id": "lang", "sensor": "lang", "satellite": "lang"}
    return catalog.filter_scenes(table(spark, sf, "documents"), format="src3", status="en", search="THE", columns=columns).select("doc_id")


@query("""SELECT p_partkey, CASE WHEN a > 1000000 THEN format('{:,.2f} km²', a / 1000000) ELSE format('{:,}', round(a)::BIGINT) || ' m²' END AS area
FROM (SELECT p_partkey, p_partkey * 1237.0::DOUBLE AS a FROM part)""")
def str_area_text(spark, sf):
    from terraspan.functions.language import area_text

    return table(spark, sf, "part").select("p_partkey", area_text(F.col("p_partkey") * F.lit(1237.0)).alias("area"))


@query("""SELECT doc_id, times, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10)
 WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE printf('%.2f GB', floor(n / 1073741824 * 100 + 0.5) / 100) END AS size
FROM (SELECT doc_id, times, n_chars * times AS n FROM documents, (VALUES (1), (300), (90000), (30000000)) v(times))""")
def str_byte_format(spark, sf):
    from terraspan.functions.language import bytes_text

    each = F.explode(F.array(*[F.lit(x) for x in (1, 300, 90000, 30000000)]))
    d = table(spark, sf, "documents").select("doc_id", "n_chars", each.alias("times"))
    return d.select("doc_id", "times", bytes_text(F.col("n_chars").cast("long") * F.col("times")).alias("size"))


@query("""WITH s AS (SELECT unnest(['GeoTIFF', 'PNG', 'JPEG', 'UNKNOWN']) AS format), d AS (
 SELECT CASE WHEN lang = 'en' THEN 'GeoTIFF' WHEN lang = 'de' THEN 'PNG' ELSE 'UNKNOWN' END AS format FROM documents)
SELECT s.format, count(d.format) AS n FROM s LEFT JOIN d USING (format) GROUP BY s.format""")
def agg_zero_filled(spark, sf):
    d = table(spark, sf, "documents")
    fmt = F.when(F.col("lang") == "en", "GeoTIFF").when(F.col("lang") == "de", "PNG").otherwise("UNKNOWN")
    counts = d.groupBy(fmt.alias("format")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(f,) for f in ("GeoTIFF", "PNG", "JPEG", "UNKNOWN")], "format string")
    return every.join(counts, "format", "left").select("format", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT count(*) AS received, count(*) FILTER (WHERE n = 1) AS stored, count(*) FILTER (WHERE n > 1) AS duplicates
FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)""")
def agg_ingest_counters(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("received"), F.count(F.lit(1)).alias("stored"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def _written(df, name: str):
    """Where ``df`` is written as a table of the engine, in the shared folder."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query("""SELECT 's' || o_orderkey AS scene_id, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS is_georeferenced, CASE WHEN o_orderkey % 3 <> 0 THEN 'EPSG:32643' END AS crs,
 CASE WHEN o_orderkey % 5 <> 0 THEN 'MSI' END AS sensor, o_orderkey % 10 / 10.0 AS enl FROM orders""")
def src_catalogue(spark, sf):
    """Scenes written and read by the catalogue's schema, sentinels as null."""
    k = F.col("o_orderkey")
    kind = schemas.schema(schemas.SCENE)
    quality = F.struct(F.when(k % 2 == 0, "AVAILABLE").otherwise("MISSING").alias("georeferencing_status"), F.struct((k % 10 / 10.0).alias("enl")).alias("sar_quality"))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("s"), k.cast("string")).alias("scene_id"), F.when(k % 3 == 0, "unavailable").otherwise("EPSG:32643").alias("crs"), F.when(k % 5 == 0, "UNKNOWN").otherwise("MSI").alias("sensor"),
        quality.alias("quality"), F.lit(None).cast("string").alias("satellite"),
    )
    s = schemas.missing_as_null(readers.scenes(spark, _written(rows, "scenes")))
    assert [f.name for f in kind][:2] == s.columns[:2]
    return s.select("scene_id", "is_georeferenced", "crs", "sensor", F.col("quality.sar_quality.enl").alias("enl"))


@query("""SELECT vec_id::VARCHAR AS scene_id, md5(vec_id::VARCHAR) AS file_hash, len(embedding) AS dimension, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings""")
def src_vector_index(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("scene_id"), F.md5(F.col("vec_id").cast("string")).alias("file_hash"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dimension")
    )
    v = readers.vector_index(spark, _written(e, "vectors"))
    return v.select("scene_id", "file_hash", "dimension", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'r' || doc_id END AS id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'S1' ELSE 'S2' END AS modality,
 CASE WHEN doc_id % 11 <> 0 THEN text END AS question, doc_id % 11 = 0 AS broken FROM documents""")
def src_training_records(spark, sf):
    """Documents as JSON lines, every eleventh cut off, read as training records."""
    d = F.col("doc_id")
    image = F.struct(F.lit("a.png").alias("path"), F.when(d % 2 == 0, "S1").otherwise("S2").alias("modality"))
    line = F.to_json(F.struct(F.concat(F.lit("r"), d.cast("string")).alias("id"), F.array(image).alias("images"), F.col("text").alias("question")))
    path = own_path(spark, "records")
    table(spark, sf, "documents").select(F.when(d % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    r = readers.training_records(spark, path)
    return r.select("id", F.get("images.modality", F.lit(0)).alias("modality"), "question", F.col("_corrupt_record").isNotNull().alias("broken"))
