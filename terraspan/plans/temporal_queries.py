"""Time series, gates and decisions; events stand for observations (user_id:
place, value: change in per cent or cloud cover)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions import gates
from terraspan.operators import temporal
from terraspan.plans._base import query, table


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END, event_id)
 AS ord FROM events""")
def win_chronological(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.when(F.col("event_id") % 13 != 0, F.col("ts")))
    return temporal.ordered(e, "user_id", "ts", "event_id").select("event_id", "user_id", F.col("ord").cast("long").alias("ord"))


QUAL = """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events),
q AS (SELECT *, CASE WHEN value > 50 THEN 'CLOUD_COVER' WHEN event_type = 'error' THEN 'UNREADABLE' END AS reason FROM o),
s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'EXCLUDED' WHEN ord = 1 THEN 'USABLE_BASELINE' ELSE 'POSSIBLE_CHANGE_ONSET' END AS status FROM q)"""


def _qualified(spark, sf):
    e = temporal.ordered(_events(spark, sf), "user_id", "ts", "event_id")
    return temporal.qualified(e, "value", F.col("event_type") != "error")


@query(f"WITH {QUAL} SELECT event_id, status, reason AS exclusion_reason FROM s")
def flt_observation_status(spark, sf):
    return _qualified(spark, sf).select("event_id", "status", "exclusion_reason")


WIN = "ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 20 DAY FROM events)"


@query(f"""WITH {QUAL} SELECT event_id, CASE WHEN {WIN} THEN status ELSE 'EXCLUDED' END AS status, CASE WHEN {WIN} THEN reason ELSE 'OUTSIDE_WINDOW' END AS exclusion_reason FROM s""")
def flt_window_split(spark, sf):
    q = _qualified(spark, sf)
    low = q.agg(F.min("ts").alias("t")).first()["t"]
    import datetime as dt

    if low is None:
        return q.select("event_id", "status", "exclusion_reason")
    start, end = (str(low + dt.timedelta(days=d)) for d in (10, 20))
    return temporal.in_window(q, "ts", start, end).select("event_id", "status", "exclusion_reason")


@query(f"""WITH {QUAL}, u AS (SELECT * FROM s WHERE status <> 'EXCLUDED')
SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS baseline_id,
 value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM u""")
def jn_baseline(spark, sf):
    u = _qualified(spark, sf).where("status <> 'EXCLUDED'")
    b = temporal.against_baseline(u, "user_id", ["event_id", "value"], ["ts", "event_id"])
    return b.select("event_id", F.col("baseline.event_id").alias("baseline_id"), (F.col("value") - F.col("baseline.value")).alias("change"))


LINE = f"""{QUAL}, u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM s WHERE status <> 'EXCLUDED'),
h AS (SELECT *, epoch > 0 AND value >= 10 AND event_type = 'purchase' AS hit FROM u),
l AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hits FROM h),
t AS (SELECT *, CASE WHEN epoch = 0 THEN 'BASELINE' WHEN hit AND hits = 1 THEN 'SUPPORTED_CHANGE' WHEN hit THEN 'PERSISTENT_CHANGE'
 WHEN value >= 4 THEN 'POSSIBLE_CHANGE' ELSE 'NO_CHANGE' END AS timeline_status FROM l)"""


def _line(spark, sf):
    u = _qualified(spark, sf).where("status <> 'EXCLUDED'").withColumn("strong", F.col("event_type") == "purchase")
    return temporal.timeline(u, "user_id", "ts", "event_id", "value", "strong")


@query(f"WITH {LINE} SELECT event_id, epoch, timeline_status FROM t")
def win_onset_timeline(spark, sf):
    return _line(spark, sf).select("event_id", F.col("epoch").cast("long").alias("epoch"), "timeline_status")


@query(f"""WITH {LINE}, a AS (SELECT user_id, count(*) AS epochs, min(ts) AS b, min(ts) FILTER (WHERE timeline_status = 'SUPPORTED_CHANGE') AS o,
 min(event_id) FILTER (WHERE timeline_status = 'SUPPORTED_CHANGE') AS onset_id FROM t GROUP BY user_id)
SELECT user_id, epochs, onset_id, o IS NOT NULL AS supported, CASE WHEN o IS NOT NULL THEN 'Between ' || strftime(b, '%Y-%m') || ' and ' || strftime(o, '%Y-%m') END AS range FROM a""")
def dt_onset_range(spark, sf):
    return temporal.onset(_line(spark, sf), "user_id", "ts", "event_id").select("user_id", "epochs", "onset_id", "supported", "range")


@query("""SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_id,
 floor(abs(epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400.0 + 0.5)::BIGINT AS gap_days FROM orders GROUP BY o_custkey""")
def win_first_last(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return temporal.first_and_last(o, "o_custkey", "ts", "o_orderkey").select("o_custkey", "first_id", "last_id", "gap_days")


PAIRS = """p AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS b, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
 o_totalprice AS v, o_orderstatus AS s FROM orders)"""
SEASON = """CASE WHEN a IS NULL THEN 'NONE' WHEN (month(a) BETWEEN 6 AND 9 AND (month(b) = 12 OR month(b) <= 3)) OR ((month(a) = 12 OR month(a) <= 3) AND month(b) BETWEEN 6 AND 9)
 OR least(abs(month(a) - month(b)), 12 - abs(month(a) - month(b))) >= 5 THEN 'HIGH' WHEN least(abs(month(a) - month(b)), 12 - abs(month(a) - month(b))) >= 3 THEN 'MEDIUM' ELSE 'NONE' END"""


def _pairs(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("b"), F.lag("o_orderdate").over(w).alias("a"),
        F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"),
    )


@query(f"WITH {PAIRS} SELECT k, {SEASON} AS season, least(abs(month(a) - month(b)), 12 - abs(month(a) - month(b))) AS months FROM p")
def dt_seasonality(spark, sf):
    p = _pairs(spark, sf)
    return p.select("k", gates.seasonality(F.col("a"), F.col("b")).alias("season"), gates.month_distance(F.col("a"), F.col("b")).cast("long").alias("months"))


CLOUD = "CASE WHEN k % 7 = 0 THEN 'NOT_AVAILABLE' WHEN greatest((k % 50)::DOUBLE, (c % 45)::DOUBLE) > 40 THEN 'CONTAMINATED' ELSE 'USABLE' END"
REG = """CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN 'PARTIALLY_ALIGNED' WHEN k % 4 = 0 THEN 'REGISTRATION_UNCERTAIN' WHEN k % 5 = 0 THEN 'PARTIALLY_ALIGNED'
 WHEN k % 9 = 0 THEN 'REGISTRATION_UNCERTAIN' ELSE 'ALIGNED' END"""


def _checks(p):
    k, c = F.col("k"), F.col("c")
    crs = F.when(k % 4 == 0, "unavailable").otherwise("EPSG:32643")
    w = F.when(k % 8 == 0, 128).otherwise(256)
    reg = gates.registration(crs, F.lit("EPSG:32643"), F.lit(32643), F.when(k % 5 == 0, 32644).otherwise(32643), F.lit(128), F.lit(128), w, F.lit(128),
                             F.lit(10.0), F.when(k % 9 == 0, 30.0).otherwise(10.0))
    cloud_a = F.when(k % 7 != 0, (k % 50).cast("double"))
    cloud_b = F.when(k % 7 != 0, (c % 45).cast("double"))
    return p.withColumns({"registration": reg, "cloud": gates.cloud(cloud_a, cloud_b), "season": gates.seasonality(F.col("a"), F.col("b"))})


@query(f"WITH {PAIRS} SELECT k, {REG} AS registration FROM p")
def gt_registration(spark, sf):
    return _checks(_pairs(spark, sf)).select("k", "registration")


@query(f"WITH {PAIRS} SELECT k, {CLOUD} AS cloud FROM p")
def gt_cloud(spark, sf):
    return _checks(_pairs(spark, sf)).select("k", "cloud")


REL = "CASE WHEN s = 'F' THEN 'CROSS_SENSOR_COMPARISON' ELSE 'SAME_SENSOR' END"


@query(f"""WITH {PAIRS}, g AS (SELECT k, {REG} AS r, {CLOUD} AS cl, {SEASON} AS se, {REL} AS rel FROM p)
SELECT k, CASE WHEN cl = 'CONTAMINATED' THEN 'UNUSABLE' WHEN r IN ('REGISTRATION_UNCERTAIN', 'PARTIALLY_ALIGNED') OR se = 'HIGH' OR rel = 'CROSS_SENSOR_COMPARISON'
 THEN 'DEGRADED' ELSE 'USABLE' END AS overall FROM g""")
def gt_overall_quality(spark, sf):
    p = _checks(_pairs(spark, sf))
    rel = gates.sensor_relationship(F.lit("MSI"), F.when(F.col("s") == "F", "SAR").otherwise("MSI"), F.lit("optical"), F.lit("optical"))
    return p.select("k", gates.overall_quality(F.col("registration"), F.col("season"), F.col("cloud"), rel).alias("overall"))


@query(f"""WITH {PAIRS}, g AS (SELECT k, {REG} AS r, {CLOUD} AS cl, {SEASON} AS se, s = 'F' AS xs, (v / 10000) % 30 AS pct, k % 3 AS n, (k % 6 = 0) AS strong, (k % 12 = 0) AS build FROM p)
SELECT k, CASE WHEN cl = 'CONTAMINATED' THEN 'LOW_QUALITY' WHEN xs THEN 'CROSS_SENSOR_UNCERTAIN' WHEN pct < 2 AND n = 0 THEN 'NO_SIGNIFICANT_CHANGE'
 WHEN se = 'HIGH' AND pct < 18 AND NOT build THEN 'LIKELY_SEASONAL_VARIATION' WHEN r IN ('ALIGNED', 'PARTIALLY_ALIGNED') AND strong AND pct >= 8 THEN 'SUPPORTED_CHANGE'
 WHEN pct >= 4 THEN 'POSSIBLE_CHANGE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
 CASE WHEN cl = 'CONTAMINATED' THEN 2 WHEN xs THEN 3 WHEN pct < 2 AND n = 0 THEN 4 WHEN se = 'HIGH' AND pct < 18 AND NOT build THEN 5
 WHEN r IN ('ALIGNED', 'PARTIALLY_ALIGNED') AND strong AND pct >= 8 THEN 6 WHEN pct >= 4 THEN 7 ELSE 8 END AS rule FROM g""")
def gt_false_alarm_cascade(spark, sf):
    p = _checks(_pairs(spark, sf))
    k = F.col("k")
    cross = F.col("s") == "F"
    d = gates.decision(
        F.col("registration"), F.col("cloud"), F.when(cross, "CROSS_SENSOR_COMPARISON").otherwise("SAME_SENSOR"), F.lit("optical"),
        F.when(cross, "sar").otherwise("optical"), F.col("season"), (F.col("v") / 10000) % 30, k % 3, (k % 6 == 0).cast("int"), k % 12 == 0,
        F.lit("CONSTRUCTION"), F.lit("ROAD_DEVELOPMENT"),
    )
    return p.select("k", d["status"].alias("status"), d["rule"].alias("rule"))


@query(f"""WITH {PAIRS}, d AS (SELECT k, k % 5 AS dw, k % 200 AS dh, k % 6 = 0 AS other, k % 10 = 0 AS coarse, k % 17 = 0 AS apart FROM p)
SELECT k, CASE WHEN apart THEN 'INCOMPATIBLE_RASTERS' WHEN dw > 2 OR dh > 2 OR other OR coarse THEN 'REGISTRATION_REQUIRED' ELSE 'ALIGNED' END AS status,
 CASE WHEN apart OR ((dw > 2 OR dh > 2) AND dh > 100) OR other THEN 'HIGH' WHEN dw > 2 OR dh > 2 OR coarse THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d""")
def gt_evidence_registration(spark, sf):
    k = F.col("k")
    r = gates.evidence_registration(
        k % 5, k % 200, F.lit("A"), F.when(k % 6 == 0, "B").otherwise("A"), F.lit(10.0), F.lit(10.0), F.when(k % 10 == 0, 11.0).otherwise(10.2), F.lit(10.0),
        F.when(k % 17 == 0, 0.0).otherwise(0.8),
    )
    return _pairs(spark, sf).select("k", r["status"].alias("status"), r["risk"].alias("risk"))


@query("""SELECT event_id, value > 22 AND abs(value * 1.1 - value) < 12 AS illumination, event_type <> 'click' AND value * 10 > 210 AND value / 100 > 0.35 AS cloud,
 value / 100 > 0.04 AND NOT (value > 22 AND abs(value * 1.1 - value) < 12) AS changed FROM events""")
def gt_confounders(spark, sf):
    v = F.col("value")
    c = gates.confounders(v * 1.1, v / 100, v, v * 10, v, F.col("event_type") == "click")
    return _events(spark, sf).select("event_id", c["illumination"].alias("illumination"), c["cloud"].alias("cloud"), c["changed"].alias("changed"))


@query("""SELECT event_id, CASE WHEN value % 7 < 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN event_type = 'error' THEN 'LIKELY_SEASONAL_VARIATION' WHEN value < 5 THEN 'NO_SIGNIFICANT_CHANGE'
 WHEN event_id % 5 = 0 THEN 'REGISTRATION_UNCERTAIN' WHEN value / 200 BETWEEN 0.015 AND 0.25 THEN 'SUPPORTED_CHANGE' ELSE 'POSSIBLE_CHANGE' END AS answer FROM events""")
def gt_two_image_answer(spark, sf):
    v = F.col("value")
    season = F.when(F.col("event_type") == "error", "HIGH").otherwise("NONE")
    a = gates.two_image_answer(season, F.when(v % 7 >= 1, v), F.col("event_id") % 5 != 0, v / 200)
    return _events(spark, sf).select("event_id", a.alias("answer"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 4 = 2 THEN 'ESCALATE_CONFLICT' WHEN event_id % 4 = 1 THEN 'ESCALATE_EVIDENCE'
 WHEN value < 10 THEN 'ESCALATE_CONFIDENCE' ELSE 'ACCEPT' END AS gate,
 CASE WHEN event_id % 3 = 0 AND (event_type = 'view' OR event_id % 2 = 0) THEN 'INCONCLUSIVE' WHEN event_id % 3 = 0 THEN 'VERIFIED' ELSE 'INCONCLUSIVE' END AS decision FROM events""")
def gt_escalation(spark, sf):
    i = F.col("event_id")
    s = F.when(i % 4 == 2, "CONFLICTING").when(i % 4 == 1, "WEAK").otherwise("STRONG")
    gate = gates.escalation(s, F.when(F.col("value") < 10, "Low").otherwise("High"), F.col("event_type") == "error")
    d = gates.attribution(F.when(i % 3 == 0, "VERIFIED").otherwise("INCONCLUSIVE"), F.col("event_type") == "view", F.when(i % 2 == 0, 1).otherwise(0), F.lit(1))
    return _events(spark, sf).select("event_id", gate.alias("gate"), d.alias("decision"))


@query("""SELECT o_custkey, CASE WHEN n = 1 THEN 'SINGLE_IMAGE' WHEN ar > 2.5 THEN 'INCOMPATIBLE' WHEN bands THEN 'MULTISPECTRAL' WHEN sar AND opt THEN 'OPTICAL_SAR'
 WHEN ba THEN 'TEMPORAL' WHEN sar THEN 'MULTI_SAR' ELSE 'MULTIPLE_VIEWS' END AS relationship FROM (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS sar,
 bool_or(o_orderstatus = 'O') AS opt, max(o_totalprice) / min(o_totalprice) / 10 AS ar, bool_and(o_orderpriority LIKE '1%') AS bands, bool_or(o_orderstatus = 'P') AS ba
 FROM orders GROUP BY o_custkey)""")
def gt_image_relationship(spark, sf):
    s = F.col("o_orderstatus")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(s == "F").alias("sar"), F.bool_or(s == "O").alias("opt"), F.bool_or(s == "P").alias("ba"),
        (F.max("o_totalprice") / F.min("o_totalprice") / 10).alias("ar"), F.bool_and(F.startswith("o_orderpriority", F.lit("1"))).alias("bands"),
    )
    r = gates.image_relationship(*[F.col(c) for c in ("n", "sar", "opt", "ba")], F.lit(False), F.col("ar"), F.lit(False), F.col("bands"))
    return g.select("o_custkey", r.alias("relationship"))


@query(f"""WITH {PAIRS} SELECT k, CASE WHEN count(*) OVER (PARTITION BY c) >= 3 THEN 'PERSISTENT' ELSE 'UNCERTAIN' END AS persistence FROM p""")
def gt_persistence(spark, sf):
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("c"))
    return _pairs(spark, sf).select("k", gates.persistence(n).alias("persistence"))


@query("""SELECT u.user_id, coalesce(m.n, 0) AS epochs, CASE WHEN m.n IS NULL OR m.n < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SERIES' END AS status
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) m USING (user_id)""")
def jn_group_membership(spark, sf):
    e = _events(spark, sf)
    m = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    j = e.select("user_id").distinct().join(m, "user_id", "left")
    return j.select("user_id", F.coalesce("n", F.lit(0)).alias("epochs"), F.when(F.coalesce("n", F.lit(0)) < 2, "INSUFFICIENT_EVIDENCE").otherwise("SERIES").alias("status"))
