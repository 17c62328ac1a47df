"""Evidence graphs and cross-modal agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions import gates, geo
from terraspan.operators.graph import reached

#: Fixed values.
OVERLAP_IOU, OVERLAP_PCT = 0.15, 25.0


def graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims: claim_id, query, status, requirements,
    measurements (arrays of text), confidence.

    A query states a claim, a claim needs requirements, measurements support
    it, and it leads to a decision.
    """
    c = F.col("claim_id").cast("string")

    def part(name: str, kind: str):
        return claims.select(c.alias("claim"), F.posexplode(name).alias("pos", "label")).select(
            F.concat(c_name("claim"), F.lit(f"/{kind}/"), F.col("pos").cast("string")).alias("node_id"), F.lit(kind.upper()).alias("node_type"), "label", "claim"
        )

    def c_name(col: str):
        return F.concat(F.lit("claim/"), F.col(col))

    base = claims.select(c.alias("claim"), "query", "status")
    nodes = [
        base.select(F.concat(c_name("claim"), F.lit("/query")).alias("node_id"), F.lit("QUERY").alias("node_type"), F.col("query").alias("label"), "claim"),
        base.select(c_name("claim").alias("node_id"), F.lit("CLAIM").alias("node_type"), F.col("status").alias("label"), "claim"),
        base.select(F.concat(c_name("claim"), F.lit("/decision")).alias("node_id"), F.lit("DECISION").alias("node_type"), F.col("status").alias("label"), "claim"),
        part("requirements", "requirement"), part("measurements", "measurement"),
    ]
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    to_claim = F.col("node_type").isin("QUERY", "MEASUREMENT")
    kind = F.create_map(*[F.lit(x) for x in ("QUERY", "STATES", "MEASUREMENT", "SUPPORTS", "REQUIREMENT", "REQUIRES", "DECISION", "LEADS_TO")])
    edges = every.where("node_type <> 'CLAIM'").select(
        F.when(to_claim, F.col("node_id")).otherwise(c_name("claim")).alias("source"),
        F.when(to_claim, c_name("claim")).otherwise(F.col("node_id")).alias("target"), kind[F.col("node_type")].alias("edge_type"),
    )
    return every.drop("claim"), edges


#: Part of a claim, its node type, and the edge that ties it (from the part's owner, or to it).
PARTS = {
    "requirements": ("REQUIRED_EVIDENCE", "REQUIRES"), "measurements": ("MEASURED_EVIDENCE", "PROVES"), "regions": ("SPATIAL_REGION", "LOCATED_AT"),
    "gates": ("VERIFICATION_GATE", "VERIFIED_BY"), "decisions": ("DECISION", "YIELDS"),
}


def audit_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the full audit graph of claims.

    ``claims``: claim_id, text, status, requirements (array of text), and
    arrays of struct(of, label, status): measurements prove the requirement
    number ``of``; regions and gates belong to a measurement, decisions to a
    gate.  Nodes: claim_id, node_id, node_type, label, status.  Edges:
    claim_id, source, target, edge_type.  Missing arrays (null) give nothing.
    """
    def name(kind: str, place) -> Column:
        return F.concat_ws("/", F.lit("claim"), F.col("claim_id").cast("string"), F.lit(kind.lower()), place.cast("string"))

    root = F.concat(F.lit("claim/"), F.col("claim_id").cast("string"))
    nodes = claims.select("claim_id", root.alias("node_id"), F.lit("CLAIM").alias("node_type"), F.col("text").alias("label"), "status")
    edges = None
    owner = {"measurements": "requirements", "regions": "measurements", "gates": "measurements", "decisions": "gates"}
    for part, (kind, edge) in PARTS.items():
        each = claims.select("claim_id", F.posexplode(part).alias("pos", "e"))
        own = name(kind, F.col("pos"))
        if part == "requirements":
            label, status, above = F.col("e"), F.lit("PENDING"), root
        else:
            label, status, above = F.col("e.label"), F.col("e.status"), name(PARTS[owner[part]][0], F.col("e.of"))
        nodes = nodes.unionByName(each.select("claim_id", own.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), status.alias("status")))
        source, target = (own, above) if part == "measurements" else (above, own)
        tied = each.select("claim_id", source.alias("source"), target.alias("target"), F.lit(edge).alias("edge_type"))
        edges = tied if edges is None else edges.unionByName(tied)
    return nodes, edges


#: Fixed value: version of the tools in a provenance record.
TOOL_VERSION = "2.0.0-evidence-engine"
#: Edges along which the target rests on the source; along others the source rests on the target.
BACKWARDS = ("YIELDS", "VERIFIED_BY", "PROVES")


def provenance(source_file: Column, content: Column, tool: Column, operation: Column, parameters: Column, ts: Column) -> Column:
    """The record of how a measurement was made; the content is hashed whole."""
    data = content.cast("binary")
    return F.struct(
        source_file.alias("source_file"), F.coalesce(F.length(data), F.lit(0)).cast("long").alias("file_size_bytes"), F.sha2(F.coalesce(data, F.lit("").cast("binary")), 256).alias("file_sha256"),
        tool.alias("tool"), F.lit(TOOL_VERSION).alias("tool_version"), operation.alias("operation"), parameters.alias("parameters"), ts.alias("timestamp"),
    )


def with_provenance(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes with the ``provenance`` of their record (node_id, provenance);
    only measured evidence has one."""
    found = nodes.join(records.select("node_id", "provenance"), "node_id", "left")
    return found.select(*nodes.columns, F.when(F.col("node_type") == "MEASURED_EVIDENCE", F.col("provenance")).alias("provenance"))


def rests_on(nodes: DataFrame, edges: DataFrame, kind: str = "DECISION") -> DataFrame:
    """start, node_id, node_type, steps: all that each node of a kind rests on.

    A decision rests on the gate that yields it, a gate on the measurement that
    it verifies, a requirement on what proves it, a claim on its requirements,
    and a measurement on the regions where it lies.
    """
    back = F.col("edge_type").isin(*BACKWARDS)
    support = edges.select(F.when(back, F.col("target")).otherwise(F.col("source")).alias("a"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("b"))
    starts = nodes.where(F.col("node_type") == kind).select(F.col("node_id").alias("node"))
    found = reached(support, starts).where("steps > 0")
    return found.join(nodes.select(F.col("node_id").alias("node"), "node_type"), "node").select("start", F.col("node").alias("node_id"), "node_type", "steps")


def summary(claims: DataFrame) -> DataFrame:
    s = F.col("status")
    return claims.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(s == "VERIFIED").alias("verified"), F.count_if(s == "EVIDENCE_CONFLICT").alias("conflicts"),
        F.count_if(~s.isin("VERIFIED", "EVIDENCE_CONFLICT")).alias("open"),
    )


def cross_modal(optical: DataFrame, radar: DataFrame, by: str) -> DataFrame:
    """Agreement of optical (category) and radar (kind) regions of a scene;
    boxes xmin, ymin, xmax, ymax on the 0-1 scale.  The join is by scene; whether
    a pair agrees follows from classes and boxes, so regions alike in these
    count once."""
    a = optical.select(by, "category", *[F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    b = radar.select(by, "kind", *[F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    box = [tuple(F.col(f"{p}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")) for p in "ab"]
    pairs = a.distinct().join(b.distinct(), by).withColumn("o", geo.box_overlap(*box))
    pairs = pairs.where((F.col("o.iou") > OVERLAP_IOU) | (F.col("o.pct_a") > OVERLAP_PCT) | (F.col("o.pct_b") > OVERLAP_PCT))
    pairs = pairs.withColumn("agreement", gates.cross_modal_pair(F.col("category"), F.col("kind")))
    found = pairs.groupBy(by).agg(
        F.bool_or(F.col("agreement").eqNullSafe("CONTRADICTING")).alias("conflict"), F.bool_or(F.col("agreement").eqNullSafe("CONFIRMING")).alias("confirm"),
    )
    n_a = optical.groupBy(by).agg(F.count(F.lit(1)).alias("n_optical"))
    n_b = radar.groupBy(by).agg(F.count(F.lit(1)).alias("n_sar"))
    df = n_a.join(n_b, by, "full_outer").join(found, by, "left")
    zero, no = F.lit(0), F.lit(False)
    return df.select(by, gates.cross_modal_status(
        F.coalesce("conflict", no), F.coalesce("confirm", no), F.coalesce("n_optical", zero), F.coalesce("n_sar", zero)
    ).alias("agreement"))
