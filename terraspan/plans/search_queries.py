"""Vector search, scoring, reranking and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions import scoring, vectors
from terraspan.operators import discovery, search
from terraspan.plans._base import query, table

COS = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, sf, vec_id: int = 0) -> list[float]:
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


@query(f"""WITH {Q0} SELECT e.vec_id, e.label, round({COS}, 6) AS similarity FROM embeddings e, q WHERE e.label IN (1, 3, 5)
ORDER BY similarity DESC, e.vec_id LIMIT 20""")
def vector_topk_filtered(spark, sf):
    e = table(spark, sf, "embeddings").where(F.col("label").isin(1, 3, 5))
    return vectors.top_k(e, _query_vector(spark, sf), 20, places=6).select("vec_id", "label", "similarity")


@query(f"""WITH {Q0} SELECT e.vec_id, round({COS}, 4) AS similarity FROM embeddings e, q ORDER BY similarity DESC, e.vec_id LIMIT 10""")
def top_cosine(spark, sf):
    return vectors.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 10).select("vec_id", "similarity")


@query(f"""WITH {Q0} SELECT vec_id, similarity FROM (SELECT e.vec_id, round({COS}, 4) AS similarity FROM embeddings e, q
ORDER BY similarity DESC, e.vec_id LIMIT 11) WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10""")
def vec_image_to_image(spark, sf):
    near = vectors.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 11)
    return near.where("vec_id <> 0").orderBy(F.col("similarity").desc(), "vec_id").limit(10).select("vec_id", "similarity")


@query(f"""WITH {Q0} SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, q""")
def vec_cosine_all(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.cosine_to(F.col("embedding"), _query_vector(spark, sf)), 6).alias("similarity"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, round(u[1], 5) AS first_value FROM (
 SELECT vec_id, embedding::DOUBLE[] AS v, [x * 3 FOR x IN embedding::DOUBLE[]] AS t, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM embeddings)""")
def vec_unit(spark, sf):
    v = vectors.doubles(F.col("embedding"))
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    u = vectors.unit(F.transform("v", lambda x: x * 3), None)
    return e.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("length"), F.round(F.element_at(u, 1), 5).alias("first_value"))


@query("SELECT vec_id, sha256(vec_id || ':m1:p1') AS cache_key FROM embeddings")
def vec_cache_key(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vectors.cache_key(F.col("vec_id").cast("string"), "m1", "p1").alias("cache_key"))


@query("SELECT vec_id FROM embeddings WHERE label >= 4")
def vec_cache_misses(spark, sf):
    e = table(spark, sf, "embeddings")
    key = vectors.cache_key(F.col("vec_id").cast("string"), "m1", "p1")
    cache = e.where("label < 4").select(key.alias("cache_key"))
    return vectors.missing_embeddings(e, cache, key).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn_semi_candidates(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id")


SCORED = f"""WITH {Q0}, allowed AS (SELECT doc_id FROM documents WHERE lang = 'en'),
hits AS (SELECT e.vec_id, round({COS}, 4) AS similarity FROM embeddings e, q WHERE e.vec_id IN (SELECT doc_id FROM allowed)
 ORDER BY similarity DESC, e.vec_id LIMIT 30),
s AS (SELECT h.vec_id AS doc_id, d.source, greatest(0, least(1, (similarity + 1) / 2)) AS sim,
  0.5 + CASE WHEN contains(lower(d.source), 'src1') THEN 0.3 ELSE 0 END + CASE WHEN d.lang = 'en' THEN 0.2 ELSE 0 END AS meta,
  0.5 AS temp, coalesce(nullif(d.n_chars % 101, 0), 70) / 100.0 AS qual FROM hits h JOIN documents d ON d.doc_id = h.vec_id),
r AS (SELECT *, round((sim * 0.5 + meta * 0.25 + temp * 0.15 + qual * 0.1)::DOUBLE::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS score FROM s)"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").withColumn("ts", F.lit(None).cast("timestamp"))
    plan = search.Plan(sensor="src1", modality="en")
    allowed = search.prefilter(docs, search.Plan(modality="en"), {"modality": "lang", "sensor": "source"})
    index = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = search.vector_hits(index, allowed, _query_vector(spark, sf), 15, "doc_id", "embedding")
    return search.rerank(hits, docs, plan, 15, "doc_id", sensor="source", modality="lang", ts="ts", completeness=F.col("n_chars") % 101)


@query(SCORED + """ SELECT doc_id, source, round(sim, 6) AS sim, meta::DOUBLE AS meta, temp::DOUBLE AS temp, qual::DOUBLE AS qual, score::DOUBLE AS score,
 CASE WHEN qual >= 0.75 THEN 'USABLE' WHEN qual >= 0.5 THEN 'DEGRADED' ELSE 'UNUSABLE' END AS quality_band,
 row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r ORDER BY score DESC, doc_id LIMIT 15""")
def search_composite(spark, sf):
    return _scored(spark, sf).select("doc_id", "source", F.round("sim", 6).alias("sim"), "meta", "temp", "qual", "score", "quality_band", F.col("rank").cast("long").alias("rank"))


@query(SCORED + """ SELECT doc_id, array_to_string([x FOR x IN ['similarity ' || printf('%.1f', sim * 100) || '%', CASE WHEN contains(lower(source), 'src1') THEN 'sensor ' || source END,
 'modality EN', 'quality ' || CASE WHEN qual >= 0.75 THEN 'USABLE' WHEN qual >= 0.5 THEN 'DEGRADED' ELSE 'UNUSABLE' END] IF x IS NOT NULL], '; ') AS why
FROM r ORDER BY score DESC, doc_id LIMIT 15""")
def str_match_reasons(spark, sf):
    return _scored(spark, sf).select("doc_id", F.array_join("why", "; ").alias("why"))


FEEDBACK_SQL = SCORED + """, top AS (SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 15),
c AS (SELECT t.doc_id, arg_max(CASE WHEN l.toxic = 1 THEN 'REJECTED' WHEN l.quality = 1 THEN 'CONFIRMED' ELSE 'UNCERTAIN' END, l.doc_id) AS decision
 FROM top t JOIN labels l ON (l.doc_id % 2 = 0 AND l.doc_id = t.doc_id) OR contains('cand_' || (l.doc_id * 37) || '_x', t.doc_id::VARCHAR) GROUP BY 1),
f AS (SELECT t.*, decision FROM top t LEFT JOIN c USING (doc_id)),
a AS (SELECT *, CASE decision WHEN 'CONFIRMED' THEN 0.05 WHEN 'REJECTED' THEN -0.10 ELSE 0.0 END AS adj FROM f)
SELECT doc_id, decision, adj::DOUBLE AS adjustment, round(least(1, greatest(0, score + adj)), 4)::DOUBLE AS final_score,
 row_number() OVER (ORDER BY round(least(1, greatest(0, score + adj)), 4) DESC, doc_id) AS final_rank FROM a"""


@query(FEEDBACK_SQL)
def search_feedback_rerank(spark, sf):
    results = _scored(spark, sf)
    labels = table(spark, sf, "labels")
    decision = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "CONFIRMED").otherwise("UNCERTAIN")
    feedback = labels.select(
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("reference_scene_id"), F.concat(F.lit("cand_"), (F.col("doc_id") * 37).cast("string"), F.lit("_x")).alias("candidate_id"), F.lit("x").alias("change_type"),
        decision.alias("analyst_decision"), F.lit(0).cast("timestamp").alias("timestamp"), F.col("doc_id").alias("feedback_id"),
    )
    decisions = search.scene_feedback(feedback, results.select(F.col("doc_id")), "doc_id")
    out = search.with_feedback(results, decisions, key="doc_id")
    return out.select("doc_id", "decision", F.col("adjustment").cast("double").alias("adjustment"), "final_score", F.col("final_rank").cast("long").alias("final_rank"))


@query("""SELECT lower(d.lang) AS concept, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS confirmed, count(*) FILTER (WHERE toxic = 1) AS rejected,
 CASE WHEN count(*) FILTER (WHERE quality = 1 AND toxic = 0) > count(*) FILTER (WHERE toxic = 1) AND count(*) FILTER (WHERE quality = 1 AND toxic = 0) >= 2
 THEN 0.02 ELSE 0.0 END::DOUBLE AS gain FROM labels JOIN documents d USING (doc_id) GROUP BY 1""")
def agg_concept_feedback(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    decision = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "CONFIRMED").otherwise("UNCERTAIN")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(F.col("lang").alias("change_type"), decision.alias("analyst_decision"))
    c = search.concept_feedback(rows)
    gain = scoring.feedback_adjustment(F.lit(None).cast("string"), F.col("confirmed"), F.col("rejected"))
    return c.select("concept", "confirmed", "rejected", gain.cast("double").alias("gain"))


@query("""SELECT DISTINCT ON (h) vec_id, h AS file_hash, similarity FROM (SELECT e.vec_id, md5((e.vec_id % 40)::VARCHAR) AS h,
 round(list_dot_product(e.embedding::DOUBLE[], q.v), 4) AS similarity FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q)
ORDER BY h, similarity DESC, vec_id""")
def win_duplicate_hits(spark, sf):
    q = vectors.literal(_query_vector(spark, sf))
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.md5((F.col("vec_id") % 40).cast("string")).alias("file_hash"), F.round(vectors.dot(vectors.doubles(F.col("embedding")), q), 4).alias("similarity")
    )
    return discovery.distinct_hits(e, "file_hash", [F.col("similarity").desc(), F.col("vec_id")])


@query()
def clu_spherical_kmeans(spark, sf):
    e = table(spark, sf, "embeddings")
    out = discovery.spherical_kmeans(e, F.col("embedding"), "vec_id", 5)
    return out.select("vec_id", "cluster", F.round("similarity", 4).alias("similarity"), "medoid")


@query()
def discovery_similar_sites(spark, sf):
    e = table(spark, sf, "embeddings")
    x, y = (F.col("vec_id") % 37) * 0.5, (F.col("vec_id") % 23) * 0.5
    return discovery.discover(
        e, 0, 20, 3, id_col="vec_id", vector="embedding", hash_col=F.md5((F.col("vec_id") % 211).cast("string")), box=[x, y, x + 1, y + 1]
    )


@query("""SELECT doc_id, 20 * (n_chars > 0)::INT + 15 * (n_chars % 3 > 0)::INT + 25 * (lang <> 'en')::INT + 15 + 0 + 10 * (n_chars % 2 = 0)::INT
 + 5 * (source <> 'src0')::INT AS score FROM documents""")
def sc_completeness(spark, sf):
    n = F.col("n_chars")
    score = scoring.completeness(
        n, n, n % 3, F.when(F.col("lang") == "en", "unavailable").otherwise("EPSG:1"), F.array(F.lit(1.0)), F.lit(None).cast("double"),
        F.when(n % 2 == 0, n), F.when(F.col("source") == "src0", "UNKNOWN").otherwise(F.col("source")),
    )
    return table(spark, sf, "documents").select("doc_id", score.cast("int").alias("score"))


@query("""SELECT conv_id, round(sum(CASE WHEN role = 'user' THEN n ELSE 0 END) * 0.075 / 1e6 + sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) * 0.30 / 1e6, 9) AS actual,
 round((sum(CASE WHEN role = 'user' THEN n ELSE 0 END) * 1.25 + sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) * 5.0) * 3 / 1e6, 9) AS baseline
FROM (SELECT conv_id, role, length(text) // 4 AS n FROM conversations) GROUP BY conv_id""")
def sc_token_cost(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.floor(F.length("text") / 4))
    g = c.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("o")
    ).withColumn("cost", scoring.token_cost(F.col("i"), F.col("o")))
    return g.select("conv_id", F.round("cost.actual", 9).alias("actual"), F.round("cost.baseline", 9).alias("baseline"))


WORDS = ", ".join(f"('{w}', {first}, {count}, {weight})" for w, (first, count, weight) in vectors.CONCEPTS.items())


@query(f"""WITH t AS (SELECT item_id, unnest([x FOR x IN regexp_split_to_array(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '[\\s,.;:!?_/\\-]+') IF x <> '']) AS token FROM benchmark),
k AS (SELECT row_number() OVER () AS k, * FROM t), c AS (SELECT * FROM (VALUES {WORDS}) v(word, first, n, weight)),
h AS (SELECT k, item_id, first, n, weight FROM k JOIN c ON contains(token, word) OR contains(word, token)),
p AS (SELECT item_id, (first + d) % 512 AS dim, weight * cos(d * pi() / n) AS v FROM (SELECT *, unnest(range(n)) AS d FROM h)
 UNION ALL SELECT item_id, 440 + (b + i * 17) % 72, (b / 128.0 - 1) * 0.5 FROM (SELECT item_id, i, ('0x' || substr(md5(token), (i * 2 + 1)::INT, 2))::INT AS b FROM k, range(16) r(i) WHERE k NOT IN (SELECT k FROM h))),
s AS (SELECT item_id, dim, sum(v) AS v FROM p GROUP BY ALL), l AS (SELECT item_id, sqrt(sum(v * v)) AS length FROM s GROUP BY 1)
SELECT item_id, dim::INT AS dim, round(v / length * 1000000)::BIGINT AS millionths FROM s JOIN l USING (item_id) WHERE abs(v / length) > 0.001""")
def vec_text_embedding(spark, sf):
    v = vectors.embed_text(table(spark, sf, "benchmark"), "item_id", "text")
    each = v.where(F.size("vector") == vectors.DIMENSION).select("item_id", F.posexplode("vector").alias("dim", "x"))
    return each.where(F.abs("x") > 0.001).select("item_id", "dim", F.round(F.col("x") * 1000000).cast("long").alias("millionths"))
