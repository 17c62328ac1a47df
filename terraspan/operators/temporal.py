"""Series of observations per location: order, windows, onset of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions import gates
from terraspan.functions import geo as geo_functions
from terraspan.functions.geo import bbox_join
from terraspan.functions.rules import cascade
from terraspan.lineage import as_table
from terraspan.operators.graph import AT_ONCE, FIRST, LEAST, first_come_in_turns

#: Fixed value: overlap as a share of the smaller footprint that makes one place.
SAME_PLACE = 0.35
#: Scenes of a stem from which its pairs are made by several tasks.
ALIKE = 2048


def ordered(obs: DataFrame, loc: str, ts: str, id_col: str) -> DataFrame:
    """Adds ``ord`` from 1; observations without a time come first."""
    epoch = F.coalesce(F.col(ts), F.timestamp_seconds(F.lit(0)))
    return obs.withColumn("ord", F.row_number().over(W.partitionBy(loc).orderBy(epoch, id_col)))


def qualified(obs: DataFrame, cloud: str, readable: Column | None = None, limit: float = gates.SERIES_MAX_CLOUD) -> DataFrame:
    """Adds status and exclusion_reason: too cloudy or unreadable is EXCLUDED,
    the first is the baseline."""
    readable = readable if readable is not None else F.lit(True)
    reason = cascade([(F.col(cloud) > limit, "CLOUD_COVER"), (~readable, "UNREADABLE")])
    status = cascade([(reason.isNotNull(), "EXCLUDED"), (F.col("ord") == 1, "USABLE_BASELINE")], "POSSIBLE_CHANGE_ONSET")
    return obs.withColumns({"exclusion_reason": reason, "status": status})


def in_window(obs: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Marks observations outside the window EXCLUDED with that reason."""
    t = F.col(ts)
    inside = F.lit(True)
    if start:
        inside = inside & (t >= F.lit(start).cast("timestamp"))
    if end:
        inside = inside & (t <= F.lit(end).cast("timestamp"))
    outside = ~F.coalesce(inside & t.isNotNull(), F.lit(False))
    return obs.withColumns({
        "status": F.when(outside, "EXCLUDED").otherwise(F.col("status")),
        "exclusion_reason": F.when(outside, "OUTSIDE_WINDOW").otherwise(F.col("exclusion_reason")),
    })


def against_baseline(usable: DataFrame, loc: str, columns: list[str], order: list[str]) -> DataFrame:
    """Every usable observation beside the first of its place (no join)."""
    w = W.partitionBy(loc).orderBy(*order)
    return usable.withColumn("baseline", F.first_value(F.struct(*columns)).over(w))


def timeline(usable: DataFrame, loc: str, ts: str, id_col: str, change: str, strong: str) -> DataFrame:
    """epoch (from 0) and status of each usable observation: the first change
    of 10 % with a strong region is SUPPORTED, later ones are PERSISTENT, from
    4 % on POSSIBLE."""
    w = W.partitionBy(loc).orderBy(ts, id_col)
    df = usable.withColumn("epoch", F.row_number().over(w) - 1)
    hit = (F.col("epoch") > 0) & (F.col(change) >= gates.ONSET_FROM) & F.col(strong)
    df = df.withColumn("__hits", F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    status = cascade([
        (F.col("epoch") == 0, "BASELINE"), (hit & (F.col("__hits") == 1), "SUPPORTED_CHANGE"), (hit, "PERSISTENT_CHANGE"),
        (F.col(change) >= gates.POSSIBLE_FROM, "POSSIBLE_CHANGE"),
    ], "NO_CHANGE")
    return df.withColumn("timeline_status", status).drop("__hits")


def onset(line: DataFrame, loc: str, ts: str, id_col: str) -> DataFrame:
    """Per place: whether a change is supported, where and between which months."""
    hit = F.col("timeline_status") == "SUPPORTED_CHANGE"
    out = line.groupBy(loc).agg(
        F.count(F.lit(1)).alias("epochs"), F.min(ts).alias("baseline_ts"),
        F.min(F.when(hit, F.col(ts))).alias("onset_ts"), F.min(F.when(hit, F.col(id_col))).alias("onset_id"),
    )
    month = "yyyy-MM"
    span = F.concat(F.lit("Between "), F.date_format("baseline_ts", month), F.lit(" and "), F.date_format("onset_ts", month))
    return out.withColumns({"supported": F.col("onset_ts").isNotNull(), "range": F.when(F.col("onset_ts").isNotNull(), span)})


def first_and_last(usable: DataFrame, loc: str, ts: str, id_col: str) -> DataFrame:
    """Per place the first and last observation and the days between."""
    key = F.struct(ts, id_col)
    return usable.groupBy(loc).agg(
        F.min_by(id_col, key).alias("first_id"), F.max_by(id_col, key).alias("last_id"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    ).withColumn("gap_days", days_between(F.col("first_ts"), F.col("last_ts")))


def days_between(a: Column, b: Column) -> Column:
    """Whole days, rounded, without sign."""
    seconds = F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))
    return F.floor(F.abs(seconds) / 86400.0 + 0.5).cast("long")


def overlaps(boxes: DataFrame, names: bool = True) -> DataFrame:
    """a_id, b_id: distinct scenes at the same place.

    Scenes (id, x0, y0, x1, y1, and if there are such columns epsg, px0, py0,
    px1, py1, stem) are compared by the first rule that both allow: geographic
    boxes that share SAME_PLACE of the smaller one; projected boxes (px0 to
    py1) likewise, under one EPSG code; equal stems of the file names, unless
    ``names`` is false.  All three are equi-joins, of boxes on cells.
    """
    columns = boxes.columns
    out = _near(boxes, boxes, merge=True).where("a_id < b_id")
    if names and "stem" in columns:
        named = _named(boxes).where("key IS NOT NULL")
        # a stem's scenes are dealt over several tasks, each with a part of them beside all
        counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        parts = as_table(counts.select(F.col("key").alias("of"), F.ceil(F.col("n") / ALIKE).cast("int").alias("parts")).where("parts > 1"), "stems")
        named = named.join(parts, F.col("key") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("of")
        a, b = (named.select(*[F.col(c).alias(f"{p}{c}") for c in named.columns]) for p in ("a_", "b_"))
        a = a.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
        b = b.withColumn("b_part", F.pmod(F.xxhash64("b_id"), F.col("b_parts")).cast("int"))
        alike = a.join(b.hint("merge"), (F.col("a_key") == F.col("b_key")) & (F.col("a_part") == F.col("b_part"))).where("a_id < b_id AND NOT (a_geo AND b_geo) AND NOT coalesce(a_code = b_code, false)")
        out = out.unionByName(alike.select("a_id", "b_id"))
    return out


def overlap_counts(boxes: DataFrame, names: bool = True) -> DataFrame:
    """id (a number), class_id, links, linked of every scene: the smallest id at
    exactly its place, the number of scenes that ``overlaps`` pairs it with, and
    the sum of their ids.

    Exactly one place: the same geographic box, else the same code and
    projected box, else the same stem.  Scenes alike in what a rule compares
    meet others once, with their number, so copies make no pairs; no row is
    kept per pair.
    """
    columns, geo = boxes.columns, _geographic()
    plane = {c: F.when(_projected(boxes), F.col(c) if "epsg" in columns else None) for c in ("epsg", "px0", "py0", "px1", "py1")}
    stem = F.when(F.col("stem") != "", F.col("stem")) if names and "stem" in columns else F.lit(None).cast("string")
    scenes = boxes.select("id", geo.alias("geo"), *[F.when(geo, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")], *[x.alias(c) for c, x in plane.items()], stem.alias("key"))
    box, projected = ["x0", "y0", "x1", "y1"], ["px0", "py0", "px1", "py1"]
    rules = [(["geo", *box], F.col("geo"), box, [])]
    if "epsg" in columns:
        rules.append((["geo", "epsg", *projected], F.col("epsg").isNotNull(), projected, ["epsg"]))
    if names and "stem" in columns:
        rules.append((["geo", "epsg", "key"], F.col("key").isNotNull(), [], []))
    out, zero = scenes, F.lit(0).cast("long")
    place, links, linked = [], zero, zero
    for k, (by, have, corners, same) in enumerate(rules):
        alike = as_table(scenes.where(have).groupBy(*by).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")), "alike")
        if corners:
            placed = alike.select("id", "geo", "n", "total", *same, *[F.col(c).cast("double").alias(x) for c, x in zip(corners, box, strict=True)])
            sums = geo_functions.share_sums(placed, SAME_PLACE, same, "geo" if same else None)
        else:
            sums = _sums_by_key(alike)
        found = alike.select("id", *by).join(sums, "id", "left")
        found = found.select(F.struct("id", "n", "total", "own").alias(f"__{k}"), *[F.col(c).alias(f"__{k}{c}") for c in by])
        equal = F.lit(True)
        for c in by:
            equal = equal & F.col(c).eqNullSafe(F.col(f"__{k}{c}"))
        out = out.join(found, equal, "left").drop(*[f"__{k}{c}" for c in by])
        own = F.when(F.col(f"__{k}.own"), 1).otherwise(0)  # alike with itself
        links = links + F.coalesce(F.col(f"__{k}.n"), zero) - own
        linked = linked + F.coalesce(F.col(f"__{k}.total"), zero) - own * F.col("id")
        place.append(F.col(f"__{k}.id"))
    return out.select("id", F.coalesce(*place, "id").alias("class_id"), links.alias("links"), linked.alias("linked"))


def _sums_by_key(alike: DataFrame) -> DataFrame:
    """id, n, total, own of classes (id, geo, epsg, key, n, total): what the
    classes of the same stem that it pairs with each add up to."""
    a, b = (alike.select(*[F.col(c).alias(p + c) for c in alike.columns]) for p in ("a_", "b_"))
    found = a.join(b, F.col("a_key") == F.col("b_key")).where("NOT (a_geo AND b_geo) AND NOT coalesce(a_epsg = b_epsg, false)")
    return found.groupBy(F.col("a_id").alias("id")).agg(F.sum("b_n").alias("n"), F.sum("b_total").alias("total"), F.max(F.col("a_id") == F.col("b_id")).alias("own"))


def _near(first: DataFrame, second: DataFrame, merge: bool = False) -> DataFrame:
    """a_id, b_id: scenes of two tables whose boxes share SAME_PLACE of the
    smaller one, by the first rule of ``overlaps`` that both allow."""

    def pairs(box: list[str], extra: list[str], have) -> DataFrame:
        sides = []
        for rows, p in ((first, "a_"), (second, "b_")):
            kept = rows.where(have(rows)).select("id", _geographic().alias("geo"), *extra, *[F.col(n).alias(c) for n, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
            sides.append(kept.select(*[F.col(c).alias(f"{p}{c}") for c in kept.columns]))
        found = bbox_join(*sides, keys=extra, merge=merge).where("a_id <> b_id")
        corners = [tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")) for p in ("a_", "b_")]
        return found.where(geo_functions.share_of_smaller(*corners) >= SAME_PLACE)

    out = pairs(["x0", "y0", "x1", "y1"], [], lambda _: _geographic()).select("a_id", "b_id")
    if "epsg" in first.columns:
        near = pairs(["px0", "py0", "px1", "py1"], ["epsg"], _projected)
        out = out.unionByName(near.where("NOT (a_geo AND b_geo)").select("a_id", "b_id"))
    return out


def _meetings(scenes: DataFrame) -> int:
    """The pairs that ``_near`` of a table with itself looks at, about."""
    n = geo_functions.meetings(scenes.where(_geographic()))
    if "epsg" in scenes.columns:
        n += geo_functions.meetings(scenes.where(_projected(scenes)).select("epsg", *[F.col(f"p{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]), ["epsg"])
    return n


def _geographic() -> Column:
    return F.col("x0").isNotNull() & F.col("x1").isNotNull()


def _projected(boxes: DataFrame) -> Column:
    return F.coalesce((F.col("epsg") > 0) & F.col("px0").isNotNull() & F.col("px1").isNotNull(), F.lit(False)) if "epsg" in boxes.columns else F.lit(False)


def _named(boxes: DataFrame) -> DataFrame:
    """id, key (the stem), geo, code: what decides whether stems pair scenes."""
    code = F.when(_projected(boxes), F.col("epsg") if "epsg" in boxes.columns else F.lit(None).cast("int"))
    return boxes.select("id", F.when(F.col("stem") != "", F.col("stem")).alias("key"), _geographic().alias("geo"), code.alias("code"))


def seed_groups(scenes: DataFrame, at_once: int = AT_ONCE, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """id, seed: greedy groups of scenes (as for ``overlaps``, and ord) by place.
    A group is a star around its seed: two members needn't overlap.  Scenes of
    one stem are kept together by that key, and pairs of boxes are made for a
    part of the scenes at a time, so that their number doesn't grow with the
    square of those at a place."""
    if "stem" in scenes.columns:
        scenes = scenes.drop("stem").join(_named(scenes), "id")
    return first_come_in_turns(scenes, _near, _meetings, at_once, first, least)
