"""Mixing sources to target weights by fitting word budgets exactly.

Per source the documents are counted by exact size.  The budget is met by
whole passes over the source, then by a seeded share of every size, and what
is left (less than a few documents) by a bounded-knapsack dynamic program
over the sizes that still have documents.  Which documents of a size are
taken is decided by a seeded hash of the id: whole hash buckets first, and
only one bucket per size is ranked row by row, so a hot size never meets in
one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.llm._spark import WORD, cut, ensure_importable, text_or_empty

MAX_PASSES = 3
#: Hash buckets per (source, size).
BUCKETS = 256
#: The dynamic program covers at least this budget (and two largest sizes).
DP_WORDS = 1 << 16


def source_targets(totals: DataFrame, cap: float = MAX_PASSES, cycle: int = 3) -> DataFrame:
    """source, source_size, target: the budget of each source.

    ``totals`` has one row per source.  Sources in code-point order (null
    last) weigh 1..``cycle``, repeating, and share the sum of all sizes;
    a target above ``cap`` times its source's size is cut to that and the
    excess is shared again by weight until none is above.  With sources
    ordered by cap/weight this is one prefix sum: the first sources are
    capped as long as their cap is below their share of what is left.
    """
    one = W.partitionBy(F.lit(0))
    df = totals.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    df = df.withColumns({
        "weight": F.pmod("place", F.lit(cycle)) + 1.0,
        "limit": F.lit(float(cap)) * F.col("source_size"),
    })
    order = one.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({
        "rest": F.sum("source_size").over(one) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    level = F.col("rest") / F.col("weights")
    df = df.withColumn("level", F.when(F.col("limit") / F.col("weight") >= level, level))
    # the first uncapped source sets the level for all sources after it
    df = df.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    target = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit"))
    return df.select("source", "source_size", target.cast("double").alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: float, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size to take so that the sum of sizes comes
    nearest to ``budget``.

    A share of every size is taken first, rounding down with the error
    carried to the next smaller size; that leaves a budget of about two
    documents, which the dynamic program fits with the documents left.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    take = np.zeros(len(sizes), np.int64)
    use = np.flatnonzero((sizes > 0) & (counts > 0))
    total = int((sizes[use] * counts[use]).sum())
    if not len(use) or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    use = use[np.argsort(-sizes[use], kind="stable")]
    largest = int(sizes[use[0]])
    window = max(dp_words, 2 * largest)
    bulk, carry = max(0.0, budget - window / 2), 0.0
    for k in use:
        want = counts[k] * (bulk / total) + carry / sizes[k]
        n = int(min(counts[k], max(0, np.floor(want + 1e-9))))
        take[k] = n
        carry = (want - n) * sizes[k]
    rest = budget - int((sizes * take).sum())
    reach_to = int(rest) + largest + 1
    if rest < 0:
        return take
    # first[v]: the size whose documents first made sum v reachable; used[v]: how many of them
    first = np.full(reach_to + 1, -1, np.int64)
    used = np.zeros(reach_to + 1, np.int64)
    reached = np.zeros(reach_to + 1, bool)
    reached[0] = True
    goal = int(round(rest))
    for k in use:
        left, s = int(counts[k] - take[k]), int(sizes[k])
        if left <= 0 or s > reach_to:
            continue
        if reached[goal]:
            break
        add, have = 1, 0
        new = reached.copy()
        while have < left:
            step = min(add, left - have)
            if step * s > reach_to:
                if have:
                    break
                step = min(left, max(1, reach_to // s))
            shifted = np.zeros_like(new)
            shifted[step * s:] = new[: reach_to + 1 - step * s]
            fresh = shifted & ~new
            if not fresh.any():
                break
            at = np.flatnonzero(fresh)
            used[at] = used[at - step * s] * (first[at - step * s] == k) + step
            first[at] = k
            new |= fresh
            have += step
            add *= 2
        reached = new
    sums = np.flatnonzero(reached)
    v = int(sums[np.argmin(np.abs(sums - rest))])
    while v > 0:
        k, n = first[v], used[v]
        take[k] += n
        v -= int(n * sizes[k])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    target, source_size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = int(min(MAX_PASSES, target // source_size)) if source_size else 0
    take = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - passes * source_size)
    return pd.DataFrame({
        "group": pdf["group"], "size": pdf["size"], "passes": passes, "take": take,
        "source_size": source_size, "target": target,
    })


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies.

    ``size`` is the number of words (null text: 0), ``copies`` how often the
    mix repeats the document (0 to 3), ``taken`` = size * copies.  Documents
    without words are never taken (copies 0).  Repeated rows count each.  With
    no words at all every target is 0.  Equal seeds give equal mixes.  Rows with
    a null id are rows like any other.  Texts of any length count whole.  An
    empty table gives an empty one.  Extra columns are ignored, whatever their
    names.
    """
    ensure_importable(docs.sparkSession)
    base = cut(docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_or_empty(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    # a source's key that is never null
    group = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    rows = base.select("id", group.alias("group"), "source", "size", F.xxhash64(F.lit(seed), "id").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    cells = cut(rows.groupBy("group", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    spectrum = cells.groupBy("group", "source", "size").agg(F.sum("n").alias("n"))
    totals = spectrum.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals)
    plan = spectrum.join(
        targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))
    ).select("group", "size", "n", "source_size", "target")
    plan = plan.groupBy("group").applyInPandas(
        _fit_source, "group string, size long, passes int, take long, source_size long, target double"
    )
    order = W.partitionBy("group", "size").orderBy("bucket")
    cells = cells.withColumn("before", F.sum("n").over(order) - F.col("n"))
    cells = cells.join(plan, ["group", "size"]).select(
        "group", "size", "bucket", "n", "passes", "source_size", "target",
        F.greatest(F.least(F.col("take") - F.col("before"), F.col("n")), F.lit(0)).alias("picks"),
    )
    full = rows.select("id", "group", "size", "bucket", "h").join(cells, ["group", "size", "bucket"])
    whole = full.where((F.col("picks") == 0) | (F.col("picks") == F.col("n")))
    whole = whole.withColumn("picked", F.col("picks") > 0)
    part = full.where((F.col("picks") > 0) & (F.col("picks") < F.col("n")))
    rank = F.row_number().over(W.partitionBy("group", "size", "bucket").orderBy("h", "id"))
    part = part.withColumn("picked", rank <= F.col("picks"))
    out = whole.unionByName(part)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") + F.col("picked").cast("int"))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
    )
