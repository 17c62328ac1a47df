"""Review, audit, evidence, catalogue-search and training queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.lineage import own_path, spread
from terraspan.operators import evidence, review, training
from terraspan.plans._base import query, table
from terraspan.streaming import reviews

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'NEW' WHEN 'P' THEN 'ARCHIVED' ELSE 'IN_REVIEW' END"


def _queue(spark, sf):
    o = table(spark, sf, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "NEW").when(F.col("o_orderstatus") == "P", "ARCHIVED").otherwise("IN_REVIEW")
    return o.select(
        F.col("o_orderkey").alias("candidate_id"), s.alias("status"), F.col("o_orderpriority").alias("change_type"),
        F.array(F.col("o_orderpriority"), F.lit("C-SAR")).alias("sensors"), F.col("o_orderstatus").alias("quality"), F.col("o_totalprice").alias("similarity"),
        F.col("o_orderdate").alias("enqueued"), F.col("o_custkey").cast("string").alias("location"),
    )


COLS = {"id": "candidate_id", "status": "status", "change_type": "change_type", "sensors": "sensors", "quality": "quality", "location": "location",
        "file_name": "location", "query": "change_type", "enqueued": "enqueued", "change": "similarity", "similarity": "similarity"}


@query(f"""SELECT v.s AS status, count(o_orderkey) AS n FROM (VALUES ('NEW'), ('IN_REVIEW'), ('CONFIRMED'), ('REJECTED'), ('UNCERTAIN'), ('ARCHIVED')) v(s)
LEFT JOIN (SELECT o_orderkey, {STATUS} AS s FROM orders) o USING (s) GROUP BY v.s""")
def agg_status_counts(spark, sf):
    return review.status_counts(_queue(spark, sf))


@query(f"""SELECT o_orderkey AS candidate_id, {STATUS} AS status FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND contains(lower(o_orderpriority || ' c-sar'), 'sar')
 AND {STATUS} = 'NEW'""")
def flt_review_queue(spark, sf):
    q = review.query_queue(_queue(spark, sf), status="NEW", change_type="1-Urgent", sensor="sar", quality="ALL", columns=COLS)
    return q.select("candidate_id", "status")


@query("SELECT o_orderkey AS candidate_id, o_totalprice AS similarity FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_review_relevance(spark, sf):
    return review.query_queue(_queue(spark, sf), columns=COLS).limit(25).select("candidate_id", "similarity")


@query("SELECT o_orderkey AS candidate_id, o_totalprice AS similarity FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def top_review_relevance_compat(spark, sf):
    return review.query_queue(_queue(spark, sf), columns=COLS, compat=True).limit(25).select("candidate_id", "similarity")


#: Sort, order and the SQL of both forms: as it should be, and with the signs that four sorts turn round.
SORTS = [
    ("RELEVANCE", "DESC", "o_totalprice DESC", "o_totalprice"), ("RELEVANCE", "ASC", "o_totalprice", "o_totalprice DESC"), ("CHANGE_PERCENTAGE", "DESC", "o_totalprice DESC", "o_totalprice"),
    ("NEWEST", "DESC", "o_orderdate DESC", "o_orderdate"), ("NEWEST", "ASC", "o_orderdate", "o_orderdate DESC"), ("OLDEST", "DESC", "o_orderdate", "o_orderdate DESC"),
    ("STATUS", "ASC", "s", "s"), ("STATUS", "DESC", "s DESC", "s DESC"), ("QUALITY", "ASC", "o_orderstatus", "o_orderstatus"), ("QUALITY", "DESC", "o_orderstatus DESC", "o_orderstatus DESC"),
]


def _sort_sql(k: int) -> str:
    parts = [f"SELECT '{x[0]} {x[1]}' AS sorted, o_orderkey AS candidate_id FROM (SELECT *, {STATUS} AS s FROM orders ORDER BY {x[k]}, o_orderkey LIMIT 40)" for x in SORTS]
    return " UNION ALL ".join(f"({p})" for p in parts)


def _sorted(spark, sf, compat):
    q, out = _queue(spark, sf), None
    for by, order, *_ in SORTS:
        part = review.query_queue(q, sort_by=by, order=order, columns=COLS, compat=compat).limit(40).select(F.lit(f"{by} {order}").alias("sorted"), "candidate_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(_sort_sql(2))
def top_review_sorts(spark, sf):
    return _sorted(spark, sf, False)


@query(_sort_sql(3))
def top_review_sorts_compat(spark, sf):
    return _sorted(spark, sf, True)


@query("""SELECT o_orderkey AS candidate_id FROM orders WHERE contains(o_orderkey::VARCHAR, '12') OR contains(o_custkey::VARCHAR, '12') OR contains(lower(o_orderpriority), '12')""")
def flt_review_search(spark, sf):
    return review.query_queue(_queue(spark, sf), search="12", columns=COLS).select("candidate_id")


EV = """ev AS (SELECT event_id AS seq, user_id AS candidate_id, ts, CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'UNCERTAIN' ELSE 'NOTE' END AS decision FROM events),
qq AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 10 = 0 THEN 'ARCHIVED' ELSE 'NEW' END AS status FROM customer)"""


def _log(spark, sf):
    e = F.col("event_type")
    d = F.when(e == "purchase", "CONFIRMED").when(e == "error", "REJECTED").when(e == "view", "UNCERTAIN").otherwise("NOTE")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("candidate_id"), F.col("ts").cast("timestamp").alias("ts"), d.alias("decision"))


@query(f"""WITH {EV}, l AS (SELECT candidate_id, max_by(decision, (ts, seq)) AS decision, count(*) AS n FROM ev WHERE decision <> 'NOTE' GROUP BY 1)
SELECT qq.candidate_id, CASE WHEN l.decision IS NOT NULL AND status <> 'ARCHIVED' THEN l.decision ELSE status END AS status,
 CASE WHEN l.decision IS NOT NULL AND status <> 'ARCHIVED' THEN l.n ELSE 0 END AS decisions FROM qq LEFT JOIN l USING (candidate_id)""")
def st_current_state(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 10 == 0, "ARCHIVED").otherwise("NEW").alias("status"))
    return review.current_state(q, _log(spark, sf)).select("candidate_id", "status", "decisions")


@query("""SELECT s_suppkey + 0 AS candidate_id, s_suppkey % 10 <> 0 AND s_suppkey IN (SELECT c_custkey FROM customer) AS updated FROM supplier""")
def st_bulk_decision(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 10 == 0, "ARCHIVED").otherwise("NEW").alias("status"))
    return review.bulk_decision(q, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate_id")), "CONFIRMED").select("candidate_id", "updated")


@query(f"""WITH {EV} SELECT seq, candidate_id, CASE decision WHEN 'CONFIRMED' THEN 'CANDIDATE_CONFIRMED' WHEN 'REJECTED' THEN 'CANDIDATE_REJECTED' ELSE 'CANDIDATE_MARKED_UNCERTAIN' END AS operation
FROM ev WHERE decision <> 'NOTE'""")
def st_audit_events(spark, sf):
    e = _log(spark, sf).withColumns({"run_id": F.col("seq").cast("string"), "scene_id": F.lit("s")})
    return review.decision_events(e).select(F.col("run_id").cast("long").alias("seq"), "candidate_id", "operation")


@query("""SELECT event_id, ts::VARCHAR AS at FROM events WHERE event_type = 'view' AND user_id % 5 = 2 AND event_id % 7 = 1 ORDER BY ts DESC, event_id LIMIT 100""")
def flt_audit_events(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"), (F.col("user_id") % 5).cast("string").alias("scene_id"), (F.col("event_id") % 7).cast("string").alias("run_id"),
    )
    got = review.events_where(e, 100, tie="event_id", operation="view", scene_id="2", run_id="1", candidate_id="ALL")
    return got.select("event_id", F.col("timestamp").cast("string").alias("at"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS decision, ts::VARCHAR AS at FROM events
WHERE event_type = 'click' AND event_id % 3 = 0 AND user_id % 4 = 1 ORDER BY ts DESC, event_id LIMIT 50""")
def flt_feedback(spark, sf):
    decision = F.when(F.col("event_id") % 3 == 0, "CONFIRMED").otherwise("REJECTED")
    f = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("change_type"), decision.alias("analyst_decision"), (F.col("user_id") % 4).cast("string").alias("reference_scene_id"),
    )
    got = review.events_where(f, 50, tie="event_id", analyst_decision="CONFIRMED", change_type="click", reference_scene_id="1")
    return got.select("event_id", F.col("analyst_decision").alias("decision"), F.col("timestamp").cast("string").alias("at"))


@query("""SELECT event_id, 'RUN-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || upper(substr(sha256(event_id::VARCHAR), 1, 4)) AS run_id FROM events""")
def dt_run_id(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", review.run_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("run_id"))


def _candidates(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    n, null = F.col("o_orderkey"), F.lit(None).cast("string")
    stamp = F.when(n % 3 == 0, F.lit("2024-05-06 07:08:09")).cast("timestamp")
    return o.select(
        k.alias("candidate_id"), F.when(n % 3 == 0, "CONFIRMED").otherwise("NEW").alias("status"), F.lit("SEARCH").alias("source_type"), F.concat(F.lit("R"), k).alias("source_run_id"),
        F.struct(F.concat(F.lit('Lo"c '), k).alias("location_name"), F.when(n % 2 == 0, "EPSG:32643").alias("crs"),
                 F.array(F.lit("MSI"), F.lit("C-SAR")).alias("sensors"), F.lit("optical").alias("modality"), F.array(F.lit("2020"), F.lit("2024")).alias("acquisition_dates")).alias("identity"),
        F.struct((n % 1000 / 1000.0).alias("similarity_score")).alias("retrieval"), F.struct(F.when(n % 5 == 0, "2021-06").alias("earliest_supported")).alias("temporal"),
        F.struct(F.lit("ROAD").alias("change_classification"), (n % 100 / 1.0).alias("change_percentage"), F.lit(5).alias("changed_pixel_count"),
                 F.lit(100).alias("total_scene_pixels")).alias("change"),
        F.struct(F.lit("USABLE").alias("overall_status"), F.lit("ALIGNED").alias("registration_status"), F.when(n % 4 == 1, "HIGH").alias("seasonal_severity"), null.alias("cloud_status")).alias("quality"),
        F.struct(F.when(n % 3 == 0, "CONFIRMED").alias("decision"), stamp.alias("timestamp"), F.when(n % 7 == 0, 'too "cloudy"').alias("rejection_reason")).alias("analyst_decision"),
    )


@query("""SELECT o_orderkey::VARCHAR AS candidate_id, '"' || o_orderkey || '","' || CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' ELSE 'NEW' END || '","SEARCH","ROAD","' || (o_orderkey % 100) || '.0","'
 || CASE WHEN o_orderkey % 5 = 0 THEN '2021-06' ELSE 'N/A' END || '","MSI; C-SAR","2020 to 2024","Lo""c ' || o_orderkey || '","'
 || CASE WHEN o_orderkey % 2 = 0 THEN 'EPSG:32643' ELSE 'UNREFERENCED' END || '","0.' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '","USABLE","ALIGNED","'
 || CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED","2024-05-06T07:08:09Z' ELSE 'PENDING","' END || '","' || CASE WHEN o_orderkey % 7 = 0 THEN 'too ""cloudy""' ELSE '' END || '","R' || o_orderkey || '"' AS line FROM orders""")
def snk_csv_export(spark, sf):
    return review.csv_lines(_candidates(spark, sf))


#: Every leaf of the exported JSON, in order.
LEAVES = """status source_type source_run_id identity.location_name identity.crs identity.sensors identity.modality identity.acquisition_dates retrieval.similarity_score
temporal.earliest_supported change.change_classification change.change_percentage change.changed_pixel_count change.total_scene_pixels quality.overall_status
quality.registration_status quality.seasonal_severity quality.cloud_status analyst_decision.decision analyst_decision.timestamp analyst_decision.rejection_reason""".split()


@query("""SELECT o_orderkey::VARCHAR AS candidate_id, concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' ELSE 'NEW' END, 'SEARCH', 'R' || o_orderkey, 'Lo"c ' || o_orderkey,
 CASE WHEN o_orderkey % 2 = 0 THEN 'EPSG:32643' ELSE '-' END, '["MSI","C-SAR"]', 'optical', '["2020","2024"]', (o_orderkey % 1000 / 1000.0)::DOUBLE, CASE WHEN o_orderkey % 5 = 0 THEN '2021-06' ELSE '-' END,
 'ROAD', (o_orderkey % 100)::DOUBLE, 5, 100, 'USABLE', 'ALIGNED', CASE WHEN o_orderkey % 4 = 1 THEN 'HIGH' ELSE '-' END, '-', CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' ELSE '-' END,
 CASE WHEN o_orderkey % 3 = 0 THEN '2024-05-06T07:08:09.000Z' ELSE '-' END, CASE WHEN o_orderkey % 7 = 0 THEN 'too "cloudy"' ELSE '-' END) AS leaves FROM orders""")
def snk_json_export(spark, sf):
    j = review.json_lines(_candidates(spark, sf))
    leaves = [F.coalesce(F.get_json_object("json", f"$.{x}"), F.lit("-")) for x in LEAVES]
    k = LEAVES.index("retrieval.similarity_score"), LEAVES.index("change.change_percentage")
    leaves = [x.cast("double").cast("string") if i in k else x for i, x in enumerate(leaves)]
    return j.select(F.get_json_object("json", "$.candidate_id").alias("candidate_id"), F.concat_ws("|", *leaves).alias("leaves"))


@query("""SELECT o_orderkey::VARCHAR AS candidate_id, '# Evidence and audit report ' || o_orderkey || chr(10) || '- Location: Lo"c ' || o_orderkey || chr(10)
 || '- CRS: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'EPSG:32643' ELSE 'Unreferenced' END || chr(10) || '- Dates: 2020 → 2024' || chr(10) || '- Sensors: MSI, C-SAR (OPTICAL)' || chr(10)
 || '## Change' || chr(10) || '- Class: ROAD' || chr(10) || printf('- Extent: %.2f%% (5 of 100 pixels)', (o_orderkey % 100)::DOUBLE) || chr(10)
 || '- First supported: ' || CASE WHEN o_orderkey % 5 = 0 THEN '2021-06' ELSE 'Single Observation' END || chr(10) || '## Quality' || chr(10) || '- Overall: USABLE, registration: ALIGNED' || chr(10)
 || '- Season: ' || CASE WHEN o_orderkey % 4 = 1 THEN 'HIGH' ELSE 'NONE' END || ', cloud: n/a' || chr(10) || '## Decision' || chr(10)
 || CASE WHEN o_orderkey % 3 = 0 THEN '- CONFIRMED, CONFIRMED' ELSE '- NEW, PENDING ANALYST VERIFICATION' END AS report FROM orders""")
def snk_markdown_report(spark, sf):
    return review.markdown(_candidates(spark, sf))


def _claims(spark, sf):
    c = table(spark, sf, "customer")
    n = F.col("c_nationkey") % 3
    return c.select(
        F.col("c_custkey").alias("claim_id"), F.col("c_name").alias("query"),
        F.when(F.col("c_acctbal") > 5000, "VERIFIED").when(F.col("c_acctbal") < 0, "EVIDENCE_CONFLICT").otherwise("INCONCLUSIVE").alias("status"),
        F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("req "), i.cast("string"))).alias("requirements"), F.array(F.col("c_mktsegment")).alias("measurements"),
    )


@query("""SELECT node_type, count(*) AS n FROM (SELECT unnest(['QUERY', 'CLAIM', 'DECISION', 'MEASUREMENT']) AS node_type FROM customer
 UNION ALL SELECT 'REQUIREMENT' FROM (SELECT unnest(range(c_nationkey % 3 + 1)) FROM customer)) GROUP BY 1""")
def gr_evidence_nodes(spark, sf):
    return evidence.graph(_claims(spark, sf))[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT edge_type, count(*) AS n FROM (SELECT unnest(['STATES', 'LEADS_TO', 'SUPPORTS']) AS edge_type FROM customer
 UNION ALL SELECT 'REQUIRES' FROM (SELECT unnest(range(c_nationkey % 3 + 1)) FROM customer)) GROUP BY 1""")
def gr_evidence_edges(spark, sf):
    return evidence.graph(_claims(spark, sf))[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def _audited(spark, sf):
    c, n = table(spark, sf, "customer"), (F.col("c_nationkey") % 3).cast("int")

    def parts(count, of, label, status):
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(of(i).alias("of"), F.concat(F.lit(label), i.cast("string")).alias("label"), status(i).alias("status")))

    ok = F.when(F.col("c_acctbal") > 0, "VERIFIED").otherwise("FAILED")
    return c.select(
        F.col("c_custkey").alias("claim_id"), F.col("c_name").alias("text"), ok.alias("status"), F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("req "), i.cast("string"))).alias("requirements"),
        parts(n, lambda i: i, "m", lambda i: ok).alias("measurements"), parts(n, lambda i: n - i, "r", lambda i: F.lit("VERIFIED")).alias("regions"),
        parts(F.lit(1), lambda i: F.lit(0), "g", lambda i: ok).alias("gates"), parts(F.lit(0), lambda i: F.lit(1), "d", lambda i: ok).alias("decisions"),
    )


AUDITED = "c AS (SELECT c_custkey AS k, c_nationkey % 3 AS n, c_name, CASE WHEN c_acctbal > 0 THEN 'VERIFIED' ELSE 'FAILED' END AS ok FROM customer), p AS (SELECT *, unnest(range(n + 1)) AS i FROM c)"


@query(f"""WITH {AUDITED} SELECT k AS claim_id, 'claim/' || k AS node_id, 'CLAIM' AS node_type, c_name AS label, ok AS status FROM c
UNION ALL SELECT k, 'claim/' || k || '/required_evidence/' || i, 'REQUIRED_EVIDENCE', 'req ' || i, 'PENDING' FROM p
UNION ALL SELECT k, 'claim/' || k || '/measured_evidence/' || i, 'MEASURED_EVIDENCE', 'm' || i, ok FROM p
UNION ALL SELECT k, 'claim/' || k || '/spatial_region/' || i, 'SPATIAL_REGION', 'r' || i, 'VERIFIED' FROM p
UNION ALL SELECT k, 'claim/' || k || '/verification_gate/' || i, 'VERIFICATION_GATE', 'g' || i, ok FROM c, range(2) r(i)
UNION ALL SELECT k, 'claim/' || k || '/decision/0', 'DECISION', 'd0', ok FROM c""")
def gr_audit_nodes(spark, sf):
    return evidence.audit_graph(_audited(spark, sf))[0]


@query(f"""WITH {AUDITED} SELECT k AS claim_id, 'claim/' || k AS source, 'claim/' || k || '/required_evidence/' || i AS target, 'REQUIRES' AS edge_type FROM p
UNION ALL SELECT k, 'claim/' || k || '/measured_evidence/' || i, 'claim/' || k || '/required_evidence/' || i, 'PROVES' FROM p
UNION ALL SELECT k, 'claim/' || k || '/measured_evidence/' || (n - i), 'claim/' || k || '/spatial_region/' || i, 'LOCATED_AT' FROM p
UNION ALL SELECT k, 'claim/' || k || '/measured_evidence/0', 'claim/' || k || '/verification_gate/' || i, 'VERIFIED_BY' FROM c, range(2) r(i)
UNION ALL SELECT k, 'claim/' || k || '/verification_gate/1', 'claim/' || k || '/decision/0', 'YIELDS' FROM c""")
def gr_audit_edges(spark, sf):
    return evidence.audit_graph(_audited(spark, sf))[1]


@query(f"""WITH {AUDITED}, g AS (SELECT 'claim/' || k || '/decision/0' AS start, 'claim/' || k AS c, n FROM c)
SELECT start, c || '/verification_gate/1' AS node_id, 'VERIFICATION_GATE' AS node_type, 1 AS steps FROM g UNION ALL SELECT start, c || '/measured_evidence/0', 'MEASURED_EVIDENCE', 2 FROM g
UNION ALL SELECT start, c || '/spatial_region/' || n, 'SPATIAL_REGION', 3 FROM g""")
def gr_rests_on(spark, sf):
    """All that each decision rests on."""
    return evidence.rests_on(*evidence.audit_graph(_audited(spark, sf)))


@query(f"""WITH {AUDITED} SELECT 'claim/' || k AS start, count(*) AS supports, max(steps) AS farthest FROM (
SELECT k, 1 AS steps FROM p UNION ALL SELECT k, 2 FROM p UNION ALL SELECT k, 3 FROM p) GROUP BY k""")
def gr_claim_support(spark, sf):
    """How much each claim rests on: its requirements, what proves them, and where."""
    found = evidence.rests_on(*evidence.audit_graph(_audited(spark, sf)), "CLAIM")
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("supports"), F.max("steps").alias("farthest"))


@query(f"""WITH {AUDITED} SELECT 'claim/' || k || '/measured_evidence/' || i AS node_id, c_name || '.tif' AS source_file, length(c_name) + 2 AS file_size_bytes, sha256(c_name || '/' || i) AS file_sha256, 'measureChange' AS tool,
 '2.0.0-evidence-engine' AS tool_version, 'delta' AS operation, 'threshold=' || i AS parameters FROM p
UNION ALL SELECT 'claim/' || k || '/required_evidence/' || i, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p""")
def gr_provenance(spark, sf):
    a = _audited(spark, sf)
    nodes = evidence.audit_graph(a)[0]
    each = a.select("claim_id", "text", F.posexplode("measurements").alias("i", "m"))
    name = F.concat_ws("/", F.lit("claim"), F.col("claim_id").cast("string"), F.lit("measured_evidence"), F.col("i").cast("string"))
    record = evidence.provenance(
        F.concat("text", F.lit(".tif")), F.concat_ws("/", "text", F.col("i").cast("string")), F.lit("measureChange"), F.lit("delta"),
        F.create_map(F.lit("threshold"), F.col("i").cast("string")), F.lit("2024-01-01").cast("timestamp"),
    )
    found = evidence.with_provenance(nodes, each.select(name.alias("node_id"), record.alias("provenance"))).where(F.col("node_type").isin("MEASURED_EVIDENCE", "REQUIRED_EVIDENCE"))
    p = F.col("provenance")
    parameters = F.array_join(F.transform(F.map_entries(p["parameters"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("node_id", *[p[c].alias(c) for c in ("source_file", "file_size_bytes", "file_sha256", "tool", "tool_version", "operation")], parameters.alias("parameters"))


@query("""SELECT count(*) AS claims, count(*) FILTER (WHERE c_acctbal > 5000) AS verified, count(*) FILTER (WHERE c_acctbal < 0) AS conflicts,
 count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 5000) AS open FROM customer""")
def agg_claim_summary(spark, sf):
    return evidence.summary(_claims(spark, sf))


XM = """o AS (SELECT p_partkey % 400 AS s, CASE WHEN p_size % 2 = 0 THEN 'WATER_CANDIDATE' ELSE 'BUILT_UP_CANDIDATE' END AS category, (p_size % 7) / 10.0 AS x0, (p_size % 5) / 10.0 AS y0 FROM part WHERE p_size < 25),
r AS (SELECT p_partkey % 400 AS s, CASE WHEN p_size % 3 = 0 THEN 'LOW_BACKSCATTER_SPECULAR' ELSE 'HIGH_BACKSCATTER_DOUBLE_BOUNCE' END AS kind, (p_size % 6) / 10.0 AS x0, (p_size % 4) / 10.0 AS y0 FROM part WHERE p_size >= 25)"""


@query(f"""WITH {XM}, p AS (SELECT o.s, category, kind, greatest(0, least(o.x0, r.x0) + 0.3 - greatest(o.x0, r.x0)) * greatest(0, least(o.y0, r.y0) + 0.3 - greatest(o.y0, r.y0)) AS m FROM o JOIN r USING (s)),
a AS (SELECT s, bool_or((category = 'BUILT_UP_CANDIDATE') = (kind = 'LOW_BACKSCATTER_SPECULAR')) AS conflict, bool_or((category = 'WATER_CANDIDATE') = (kind = 'LOW_BACKSCATTER_SPECULAR')) AS confirm
 FROM p WHERE round(m / (0.18 - m), 4) > 0.15 OR round(m / 0.09 * 100, 1) > 25 GROUP BY s)
SELECT k.s, CASE WHEN conflict THEN 'CONFLICT' WHEN confirm THEN 'AGREEMENT' ELSE 'COMPLEMENTARY' END AS agreement FROM (SELECT s FROM o UNION SELECT s FROM r) k LEFT JOIN a USING (s)""")
def gt_cross_modal(spark, sf):
    p = table(spark, sf, "part")
    s, z = (F.col("p_partkey") % 400).alias("s"), F.col("p_size")

    def boxed(df, a, b):
        x, y = z % a / 10.0, z % b / 10.0
        return [x.alias("xmin"), y.alias("ymin"), (x + 0.3).alias("xmax"), (y + 0.3).alias("ymax")]

    o = p.where("p_size < 25").select(s, F.when(z % 2 == 0, "WATER_CANDIDATE").otherwise("BUILT_UP_CANDIDATE").alias("category"), *boxed(p, 7, 5))
    r = p.where("p_size >= 25").select(s, F.when(z % 3 == 0, "LOW_BACKSCATTER_SPECULAR").otherwise("HIGH_BACKSCATTER_DOUBLE_BOUNCE").alias("kind"), *boxed(p, 6, 4))
    return evidence.cross_modal(o, r, "s")


@query("""SELECT event_id, CASE WHEN (dark AND event_id % 3 = 0) OR (built AND event_id % 5 = 0) THEN 'CONFLICT' WHEN dark OR built THEN 'AGREEMENT' ELSE 'COMPLEMENTARY' END AS agreement
FROM (SELECT event_id, value > 60 AS dark, value < 20 AS built FROM events)""")
def gt_cross_modal_metrics(spark, sf):
    from terraspan.functions.gates import cross_modal_metrics

    i, v = F.col("event_id"), F.col("value")
    a = cross_modal_metrics(F.when(v > 60, 0.5).otherwise(0.05), F.when(v < 20, 0.2).otherwise(0.0), F.when(v < 20, 0.2).otherwise(0.0),
                            F.when(i % 3 == 0, 0.01).otherwise(0.5), F.when(i % 5 == 0, 0.01).otherwise(0.5))
    return table(spark, sf, "events").select("event_id", a.alias("agreement"))


PROD = "(SELECT l_orderkey, l_linenumber, l_shipdate AS t, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 400 END AS cloud, l_shipmode_ AS sensor, l_returnflag AS access FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'C-SAR' ELSE 'LISS' END AS l_shipmode_ FROM lineitem))"


def _products(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("t"), F.when(F.col("l_discount") != 0, F.col("l_discount") * 400).alias("cloud"),
        F.when(F.col("l_linestatus") == "O", "C-SAR").otherwise("LISS").alias("sensor"), F.when(F.col("l_returnflag") == "R", "restricted").otherwise("open").alias("access"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN cloud > 20 AND sensor <> 'C-SAR' THEN 'CLOUD_COVER' WHEN access = 'R' THEN 'RESTRICTED' END AS reason FROM {PROD}""")
def flt_select_reject(spark, sf):
    from terraspan.sources.catalogs import with_reason

    return with_reason(_products(spark, sf), 20.0, "cloud").select("l_orderkey", "l_linenumber", "reason")


@query(f"""SELECT l_orderkey, l_linenumber FROM {PROD} WHERE NOT (coalesce(cloud, 0) > 20 AND sensor <> 'C-SAR') AND access <> 'R'
ORDER BY coalesce(cloud, 0), t DESC, l_orderkey, l_linenumber LIMIT 3""")
def top_lowest_cloud(spark, sf):
    from terraspan.sources.catalogs import best_products, with_reason

    ok = with_reason(_products(spark, sf), 20.0, "cloud").where("reason IS NULL")
    return best_products(ok, 3, "cloud", "t", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM {PROD} WHERE access <> 'R' AND contains(sensor, 'SAR') AND coalesce(cloud, 0) <= 10")
def flt_facets(spark, sf):
    from terraspan.sources.catalogs import faceted

    return faceted(_products(spark, sf), open_access=True, modality="SAR", max_cloud=10, cloud="cloud").select("l_orderkey", "l_linenumber")


#: Parts as products: their themes, regions and tags take turns.
PRODUCT_THEMES = [
    ("glacier", "OPTICAL", "retreat of a mountain glacier", ["glacier", "ice", "snow line"]), ("dune", "OPTICAL", "dunes that wander along a desert road", ["dune", "desert", "road"]),
    ("orchard", "MSI", "orchards and vineyards through the season", ["orchard", "vegetation", "ndvi"]), ("reservoir", "C-SAR", "level of a reservoir behind a dam", ["reservoir", "flood", "radar"]),
    ("suburb", "MSI", "houses and streets at the edge of a town", ["suburb", "urban", "built-up"]), ("quay", "C-SAR", "ships at the quays of a harbour at night", ["quay", "port", "coastal", "radar"]),
    ("cyclone eye", "IMAGER", "clouds around the eye of a storm", ["storm", "cloud", "weather"]),
]
PRODUCT_REGIONS = ["Alda", "Brin", "Coro"]


def _part_products(spark, sf):
    k, own = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type").repartition(spread(spark), "p_partkey")

    def turn(values, by):
        return F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), (k % by + 1).cast("int"))

    pair = k % 3 == 2
    tags = turn([t[3] for t in PRODUCT_THEMES], 7)
    return own.select(
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"), F.concat_ws(" ", turn([t[0] for t in PRODUCT_THEMES], 7), F.lit("of"), turn(PRODUCT_REGIONS, 3)).alias("title"),
        F.col("p_brand").alias("satellite"), turn([t[1] for t in PRODUCT_THEMES], 7).alias("sensor"), F.col("p_type").alias("product_type"), pair.alias("is_temporal_pair"),
        F.concat_ws(" ", turn([t[2] for t in PRODUCT_THEMES], 7), F.col("p_name")).alias("semantic_description"), F.when(pair, F.concat(tags, F.array(F.lit("before after")))).otherwise(tags).alias("semantic_tags"),
    )


def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else f"'{v}'" for v in values) + "]"


PRODUCT_SQL = f"""SELECT 'P' || p_partkey AS product_id, {_list([t[0] for t in PRODUCT_THEMES])}[p_partkey % 7 + 1] || ' of ' || {_list(PRODUCT_REGIONS)}[p_partkey % 3 + 1] AS title, p_brand AS satellite,
 {_list([t[1] for t in PRODUCT_THEMES])}[p_partkey % 7 + 1] AS sensor, p_type AS product_type, p_partkey % 3 = 2 AS pair, {_list([t[2] for t in PRODUCT_THEMES])}[p_partkey % 7 + 1] || ' ' || p_name AS description,
 {_list([t[3] for t in PRODUCT_THEMES])}[p_partkey % 7 + 1] || CASE WHEN p_partkey % 3 = 2 THEN ['before after'] ELSE [] END AS tags FROM part"""


SEARCHES = ["Urban suburb, before after", "radar quay port ships at night", "vegetation growth in Coro", "cloud weather storm", "reservoir flood level", "?"]


@query(f"""WITH p AS ({PRODUCT_SQL}),
s AS (SELECT unnest({SEARCHES!r}) AS query), t AS (SELECT *, lower(query) AS q, [x FOR x IN regexp_split_to_array(lower(query), '[\\s,.;:!?]+') IF length(x) > 1] AS terms,
 lower(concat_ws(' ', title, description, array_to_string(tags, ' '), satellite, sensor, product_type)) AS words, array_to_string(tags, '|') AS tag FROM p, s),
r AS (SELECT query, product_id, 20 + coalesce(list_sum([CASE WHEN NOT contains(words, x) THEN 0 WHEN contains(tag, x) THEN 15 ELSE 8 END FOR x IN terms]), 0)
 + CASE WHEN len(terms) > 0 THEN len([x FOR x IN terms IF contains(words, x)]) / len(terms) * 25 ELSE 0 END
 + CASE WHEN pair AND regexp_matches(q, 'change|temporal|before|after|expansion|growth|increase|decrease|transition|difference|over time|year') THEN 30 ELSE 0 END
 + CASE WHEN (contains(sensor, 'SAR') OR contains(tag, 'radar')) AND regexp_matches(q, 'sar|radar|microwave|backscatter|speckle|polarization|c-band|all-weather') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(q, 'urban|city|building|construction|road|infrastructure|built|expansion|settlement') AND regexp_matches(tag, 'urban|built-up') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(q, 'port|harbor|coastal|ship|vessel|dock|pier|breakwater|sea|ocean|maritime') AND regexp_matches(tag, 'port|coastal|breakwater') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(q, 'agri|vegetation|ndvi|crop|farm|chlorophyll|forest|green') AND regexp_matches(tag, 'agri|vegetation|ndvi') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(q, 'cloud|monsoon|penetration|obscured|weather') AND regexp_matches(tag, 'cloud') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(q, 'flood|water|inundation|river|lake|overflow') AND regexp_matches(tag, 'flood|inundation') THEN 25 ELSE 0 END AS s, len(terms) AS n FROM t),
f AS (SELECT query, product_id, CASE WHEN n = 0 THEN 80 ELSE least(99, floor(s + 0.5)) END::DOUBLE AS score FROM r)
SELECT query, product_id, score FROM f WHERE score >= 35""")
def src_eo_catalogue_search(spark, sf):
    from terraspan.sources.catalogs import search_products

    found = [search_products(_part_products(spark, sf), q).select(F.lit(q).alias("query"), "product_id", "score") for q in SEARCHES]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'all', NULL FROM documents) GROUP BY 1, 2""")
def agg_training_counts(spark, sf):
    return training.counts(table(spark, sf, "documents"), "lang", "source")


@query("""SELECT source AS task_type, count(*) AS n, round(avg((contains(lower(trim(lang || ' ' || doc_id)), 'e'))::INT), 6) AS accuracy FROM documents GROUP BY ROLLUP (source)""")
def agg_accuracy(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("task_type"), F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("predicted"), F.lit("E ").alias("truth"))
    a = training.accuracy(d)
    return a.select("task_type", "n", F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT id, line, CASE WHEN line % 9 = 0 THEN 'MISSING_FIELD' WHEN line % 7 = 0 THEN 'NO_IMAGES' WHEN line % 5 = 0 THEN 'BAD_MODALITY'
 WHEN row_number() OVER (PARTITION BY id ORDER BY line) > 1 THEN 'DUPLICATE_ID' END AS rejected FROM (SELECT ('r' || doc_id % 500) AS id, doc_id AS line FROM documents)""")
def set_training_validation(spark, sf):
    d = F.col("doc_id")
    img = F.struct(F.lit("a.png").alias("path"), F.lit(None).cast("string").alias("tensor_path"), F.when(d % 5 == 0, "xray").otherwise("optical").alias("modality"))
    r = table(spark, sf, "documents").select(
        F.concat(F.lit("r"), (d % 500).cast("string")).alias("id"), d.alias("line"), F.lit("vqa").alias("task_type"), F.when(d % 9 == 0, " ").otherwise("q").alias("question"),
        F.lit("a").alias("answer"), F.when(d % 7 == 0, F.array().cast("array<struct<path:string,tensor_path:string,modality:string>>")).otherwise(F.array(img)).alias("images"),
        F.array().cast("array<string>").alias("choices"),
    )
    return training.validated(r).select("id", "line", "rejected")


#: Events as reviews of a user's candidate: the type tells the action, every
#: seventh one enqueues and every 31st archives.
STEPS = """a AS (SELECT user_id AS candidate_id, event_id::VARCHAR AS event_id, ts, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'ENQUEUED' WHEN event_id % 31 = 0 THEN 'ARCHIVED' WHEN event_type = 'click' THEN 'CONFIRMED'
 WHEN event_type = 'view' THEN 'REJECTED' WHEN event_type = 'purchase' THEN 'UNCERTAIN' ELSE upper(event_type) END AS action FROM events),
b AS (SELECT *, coalesce(max((action = 'ENQUEUED')::INT) OVER (PARTITION BY candidate_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queued FROM a),
c AS (SELECT *, coalesce(max((action = 'ARCHIVED' AND queued = 1)::INT) OVER (PARTITION BY candidate_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM b),
d AS (SELECT *, CASE WHEN action NOT IN ('ENQUEUED', 'ARCHIVED', 'CONFIRMED', 'REJECTED', 'UNCERTAIN') THEN 'UNKNOWN_ACTION' WHEN action = 'ENQUEUED' AND queued = 1 THEN 'ALREADY_QUEUED'
 WHEN action <> 'ENQUEUED' AND queued = 0 THEN 'NOT_FOUND' WHEN action <> 'ENQUEUED' AND closed = 1 THEN 'ARCHIVED' END AS reason FROM c),
s AS (SELECT candidate_id, event_id, ts, action, last_value(CASE WHEN reason IS NULL THEN action END IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_status,
 last_value(CASE WHEN reason IS NULL THEN action END IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY ts, seq) AS to_status, reason IS NULL AS accepted, reason,
 count(CASE WHEN reason IS NULL THEN 1 END) OVER (PARTITION BY candidate_id ORDER BY ts, seq) AS step FROM d)"""
STEP_COLUMNS = ["candidate_id", "event_id", "ts", "action", "from_status", "to_status", "accepted", "reason", "step"]


def _review_events(events):
    kind, i = F.col("event_type"), F.col("event_id")
    action = F.when(i % 7 == 0, "ENQUEUED").when(i % 31 == 0, "ARCHIVED").when(kind == "click", "CONFIRMED").when(kind == "view", "REJECTED").when(kind == "purchase", "UNCERTAIN").otherwise(F.upper(kind))
    return events.select(F.col("user_id").alias("candidate_id"), i.cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"), action.alias("action"))


@query(f"WITH {STEPS} SELECT * FROM s")
def st_review_steps(spark, sf):
    return reviews.steps_of_log(_review_events(table(spark, sf, "events"))).select(*STEP_COLUMNS)


@query(f"WITH {STEPS} SELECT * FROM s WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def st_review_stream(spark, sf):
    """The same by the state machine over the table as a stream: all that the
    watermark has passed."""
    home = own_path(spark, "reviews")
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")  # a pattern may also be one file
    reviews.keep_steps(_review_events(stream), f"{home}/steps", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/steps").select(*STEP_COLUMNS)


#: Fixed value: the bands of a stack.
S2_BANDS = ["B01", "B02", "B05"]
#: Customers as patches of three bands with 2, 8 and 4 pixels a side; every
#: seventh lacks the second.
BANDS = """b AS (SELECT c_custkey AS patch, band, side FROM customer, (VALUES ('B01', 2), ('B02', 8), ('B05', 4)) t(band, side) WHERE c_custkey % 7 <> 0 OR band <> 'B02'),
v AS (SELECT patch, band, side, i, j, ((patch * 31 + i * 7 + j * 13 + side) % 200)::DOUBLE AS value FROM b, range(8) s(i), range(8) t(j) WHERE i < side AND j < side),
k AS (SELECT side, n, least(side - 1, greatest(0, tap)) AS o, sum(CASE WHEN d <= 1 THEN 1.25 * pow(d, 3) - 2.25 * d * d + 1 WHEN d < 2 THEN -0.75 * pow(d, 3) + 3.75 * d * d - 6 * d + 3 ELSE 0 END) AS w
 FROM (SELECT side, n, floor(c) + t AS tap, abs(c - floor(c) - t) AS d FROM (SELECT side, n, (n + 0.5) * side / 8 - 0.5 AS c FROM (VALUES (2), (4), (8)) a(side), range(8) b(n)), (VALUES (-1), (0), (1), (2)) e(t)) GROUP BY ALL),
f AS (SELECT patch, band, y.n AS i, x.n AS j, sum(value * y.w * x.w) AS value FROM v JOIN k y ON v.side = y.side AND v.i = y.o JOIN k x ON v.side = x.side AND v.j = x.o GROUP BY ALL)"""


@query(f"""WITH {BANDS} SELECT patch, CASE WHEN patch % 7 = 0 THEN 'B02' ELSE '' END AS missing, CASE WHEN patch % 7 <> 0 THEN string_agg(round(value * 1000)::BIGINT::VARCHAR, ',' ORDER BY band, i, j) END AS stack
FROM f GROUP BY patch""")
def ras_band_stack(spark, sf):
    names = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("side")) for b, n in zip(S2_BANDS, (2, 8, 4), strict=True)])
    c = table(spark, sf, "customer").select("c_custkey").repartition(spread(spark), "c_custkey").select(F.col("c_custkey").alias("patch"), F.explode(names).alias("b")).select("patch", "b.*").where("patch % 7 <> 0 OR band <> 'B02'")
    places = F.sequence(F.lit(0), F.col("side") * F.col("side") - 1)
    value = F.transform(places, lambda k: ((F.col("patch") * 31 + F.floor(k / F.col("side")) * 7 + k % F.col("side") * 13 + F.col("side")) % 200).cast("double"))
    s = training.stack_bands(c.withColumn("values", value), "patch", S2_BANDS, 8)
    text = F.array_join(F.transform(F.flatten(F.flatten("stack")), lambda v: F.round(v * 1000).cast("long").cast("string")), ",")
    return s.select("patch", F.array_join("missing", ",").alias("missing"), text.alias("stack"))


@query("SELECT doc_id, array_distinct_ AS n FROM (SELECT doc_id, CASE WHEN lang = source THEN 1 ELSE 2 END AS array_distinct_ FROM documents)")
def set_array_union(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.array_union(F.array("lang"), F.array("source", "lang"))).alias("n"))


@query("SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_relational(spark, sf):
    e, d, lab = (table(spark, sf, t) for t in ("embeddings", "documents", "labels"))
    ids = e.select(F.col("vec_id").alias("id")).union(d.select("doc_id")).distinct()
    return ids.join(lab.select(F.col("doc_id").alias("id")), "id", "left_anti")
