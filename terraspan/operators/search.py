"""Plain-language retrieval: filter, top k, score, rank, feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions import scoring, vectors
from terraspan.operators import catalog


@dataclass(frozen=True)
class Plan:
    """What a query asks for; explicit filters override what it implies."""

    sensor: str | None = None
    modality: str | None = None
    start: str | None = None
    end: str | None = None
    has_crs: bool | None = None

    def with_filters(self, sensor: str = "", modality: str = "", start: str = "", end: str = "", has_crs: bool | None = None) -> Plan:
        return Plan(sensor or self.sensor, modality or self.modality, start or self.start, end or self.end, has_crs)


def prefilter(scenes: DataFrame, plan: Plan, columns: dict[str, str] | None = None) -> DataFrame:
    """Scenes a search may return; scenes without a date pass a date range."""
    return catalog.filter_scenes(
        scenes, sensor=plan.sensor, modality=plan.modality, start=plan.start, end=plan.end, has_crs=plan.has_crs, keep_null_dates=True, columns=columns
    )


def over_fetch(k: int) -> int:
    """How many vectors are fetched to rerank k."""
    return max(2 * k, 20)


def vector_hits(index: DataFrame, allowed: DataFrame, query: list[float], k: int, key: str, vector: str, compat: bool = False) -> DataFrame:
    """The over-fetched nearest vectors among the allowed scenes.  With
    ``compat`` an empty set of allowed scenes stands for all scenes."""
    if compat and allowed.isEmpty():
        kept = index
    else:
        kept = index.join(allowed.select(key), key, "left_semi")
    return vectors.top_k(kept, query, over_fetch(k), vector, key)


def rerank(hits: DataFrame, scenes: DataFrame, plan: Plan, k: int, key: str, *, sensor: str, modality: str, ts: str, completeness: Column) -> DataFrame:
    """Composite score, explanation and rank of the hits; at most k rows.

    The hits are few, so the scenes are what a broadcast of the hits probes.
    """
    df = F.broadcast(hits.select(key, "similarity")).join(scenes, key)
    sensor_hit = catalog.contains(F.col(sensor), plan.sensor) if plan.sensor else F.lit(False)
    modality_hit = F.coalesce(F.col(modality) == plan.modality, F.lit(False)) if plan.modality else F.lit(False)
    start = F.lit(plan.start).cast("timestamp") if plan.start else F.lit(None).cast("timestamp")
    end = F.lit(plan.end).cast("timestamp") if plan.end else F.lit(None).cast("timestamp")
    df = df.withColumns({
        "sim": scoring.unit_similarity(F.col("similarity")), "meta": scoring.metadata_score(sensor_hit, modality_hit),
        "temp": scoring.temporal_score(F.col(ts), start, end), "qual": scoring.quality_score(completeness),
    })
    df = df.withColumn("score", F.round(scoring.composite(F.col("sim"), F.col("meta"), F.col("temp"), F.col("qual")), 4))
    why = F.array_compact(F.array(
        F.concat(F.lit("similarity "), F.format_number(F.col("sim") * 100, 1), F.lit("%")),
        F.when(sensor_hit, F.concat(F.lit("sensor "), F.col(sensor))),
        F.when(modality_hit, F.concat(F.lit("modality "), F.upper(modality))),
        F.when(F.col("temp") > 0.5, F.concat(F.lit("date "), F.date_format(F.col(ts), "yyyy-MM-dd"))),
        F.concat(F.lit("quality "), scoring.quality_band(F.col("qual"))),
    ))
    df = df.withColumns({"quality_band": scoring.quality_band(F.col("qual")), "why": why})
    top = df.orderBy(F.col("score").desc(), F.col(key)).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col(key))))


def scene_feedback(feedback: DataFrame, scenes: DataFrame, key: str = "scene_id") -> DataFrame:
    """scene, decision: the newest feedback on each scene, by its reference
    scene or by a candidate id that contains the scene's id.

    Two equi-joins: by the reference scene, and by the parts of the candidate
    id that are as long as one of the scenes' ids.
    """
    known = scenes.select(key, F.col(key).cast("string").alias("__name")).distinct()
    lengths = sorted(r[0] for r in known.select(F.char_length("__name")).distinct().collect() if r[0])  # of ids, so a few
    fields = [F.col(key), "timestamp", "analyst_decision", "feedback_id"]
    direct = feedback.join(known, F.col("reference_scene_id") == F.col(key)).select(*fields)
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("candidate_id"))
    own = feedback.where("candidate_id <> ''").withColumn("__n", F.explode(fits))
    own = own.withColumn("__at", F.explode(F.sequence(F.lit(1), F.char_length("candidate_id") - F.col("__n") + 1)))
    own = own.withColumn("__part", F.substring(F.col("candidate_id"), F.col("__at"), F.col("__n")))
    by_name = own.join(known, F.col("__part") == F.col("__name")).select(*fields)
    both = direct.unionByName(by_name)
    return both.groupBy(key).agg(F.max_by("analyst_decision", F.struct("timestamp", "feedback_id")).alias("decision"))


def concept_feedback(feedback: DataFrame) -> DataFrame:
    """concept, confirmed, rejected."""
    return feedback.groupBy(F.lower("change_type").alias("concept")).agg(
        F.count_if(F.col("analyst_decision") == "CONFIRMED").alias("confirmed"),
        F.count_if(F.col("analyst_decision") == "REJECTED").alias("rejected"),
    )


def with_feedback(results: DataFrame, decisions: DataFrame, concepts: DataFrame | None = None, concept: str | None = None, key: str = "scene_id") -> DataFrame:
    """Results with adjusted score and new rank.  The cut to k came before, so
    feedback reorders rows but adds none."""
    df = results.join(decisions, key, "left")
    if concepts is not None and concept:
        one = concepts.where(F.col("concept") == concept.lower())
        counts = one.agg(F.coalesce(F.max("confirmed"), F.lit(0)).alias("confirmed"), F.coalesce(F.max("rejected"), F.lit(0)).alias("rejected"))
        df = df.join(F.broadcast(counts))
    else:
        df = df.withColumns({"confirmed": F.lit(0), "rejected": F.lit(0)})
    gain = scoring.feedback_adjustment(F.col("decision"), F.col("confirmed"), F.col("rejected"))
    df = df.withColumn("adjustment", gain).withColumn(
        "final_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + F.col("adjustment"))), 4)
    ).drop("confirmed", "rejected")
    return df.withColumn("final_rank", F.row_number().over(W.orderBy(F.col("final_score").desc(), F.col(key))))
