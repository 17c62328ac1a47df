"""Connected groups and greedy choice over tables of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraspan.lineage import as_table, drop_tables

#: Rounds at most; their number is about the logarithm of the longest path.
ROUNDS = 60
#: Links that one task joins up at once.
FEW = 200_000


def connected(links: DataFrame) -> DataFrame:
    """node, group for every node of ``links`` (a, b), of any type with an
    order: the smallest node that can be reached.

    Every node points to a smaller one of its group.  A round lets the links
    meet at what their ends point to and the paths shrink by half, so that
    only links between different groups are left; all are equi-joins and
    aggregations that combine before the shuffle.  As soon as no more than
    FEW links are left, one task joins them up.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ends = as_table(ends.distinct(), "links")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    state = as_table(nodes.withColumn("group", F.col("node")), "groups")
    for _ in range(ROUNDS):
        left = ends.count()
        if not left:
            drop_tables(ends)
            return state
        # each root takes the smallest root that it is linked with
        step = ends.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "root")
        chain = as_table(_shortened(step) if left > FEW else _joined(ends), "roots")
        moved = state.join(chain.withColumnRenamed("root", "group"), "group", "left").select("node", F.coalesce("to", "group").alias("group"))
        new_state = as_table(moved, "groups")
        if left <= FEW:
            drop_tables(state, ends, chain)
            return new_state
        hop = chain.select(F.col("root").alias("a"), F.col("to").alias("x"))
        met = ends.join(hop, "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
        met = met.join(hop.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("x", "b").alias("b")).where("a <> b")
        new_ends = as_table(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        drop_tables(state, ends, chain)
        state, ends = new_state, new_ends
    raise RuntimeError(f"groups did not settle in {ROUNDS} rounds")


def _joined(ends: DataFrame) -> DataFrame:
    """root, to: where each end of the links (a, b) goes, in one task."""
    kind, arrow = ends.schema["a"].dataType.simpleString(), to_arrow_type(ends.schema["a"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        shown: dict = {}

        def named(column: pa.Array) -> list:
            values = column.to_pylist()
            if not pa.types.is_struct(column.type):
                return values
            names = [tuple(v.values()) for v in values]
            shown.update(zip(names, values, strict=True))
            return names

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(named(batch.column(0)), named(batch.column(1)), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        moved = list(up)
        for k in range(0, len(moved), 10_000):
            part = moved[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([shown.get(x, x) for x in c], arrow) for c in (part, map(top, part))], ["root", "to"])

    return ends.select("a", "b").repartition(1).mapInArrow(run, f"root {kind}, to {kind}")


def _shortened(step: DataFrame) -> DataFrame:
    """root, to with every path (root to to, each smaller) followed to its end
    by doubling."""
    state = as_table(step, "roots")
    for _ in range(ROUNDS):
        far = state.select(F.col("root").alias("to"), F.col("to").alias("far"))
        moved = as_table(state.join(far, "to", "left").select("root", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "roots")
        drop_tables(state)
        state = moved.select("root", "to")
        if moved.where("moved").isEmpty():
            return state
    raise RuntimeError(f"paths did not end in {ROUNDS} rounds")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, steps: the nodes that can be reached from each start
    (``starts``: node) along edges (a to b), and in how few steps.  A round
    goes one edge further from what the last one has found, and what is known
    isn't found again, so circles end."""
    edges = as_table(edges.select("a", "b").distinct(), "edges")
    new = as_table(starts.select(F.col("node").alias("start"), "node").distinct(), "reached")
    found, turn = new.withColumn("steps", F.lit(0)), 0
    while not new.isEmpty():
        turn += 1
        further = new.join(edges, new["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
        new = as_table(further.join(found, ["start", "node"], "left_anti"), "reached")
        found = found.unionByName(new.withColumn("steps", F.lit(turn)))
    return found.where("steps > 0 OR start = node")


#: Rows (nodes and links) of a group that one task settles at once.
WHOLE = 1_000_000
#: Rounds in which nodes are settled by joins before groups are looked for.
PEELED = 2
#: Parts of a large group that is settled part by part.
PARTS = 256


def _agree(geo: Column, code: Column, other_geo: Column, other_code: Column) -> Column:
    """Whether a common key pairs two nodes, by their classes."""
    return ~(geo & other_geo) & ~F.coalesce(code == other_code, F.lit(False))


def first_come(pairs: DataFrame, nodes: DataFrame, whole: int = WHOLE) -> DataFrame:
    """id, seed: in order of ``ord`` (ties by id) each node (id, ord) that isn't
    taken yet is a seed and takes all later free nodes that it is paired with
    (a_id, b_id).

    If there are columns key, geo and code, nodes with the same key are paired
    too, unless both are ``geo`` or have the same code; no row is made for
    such a pair.

    Only which nodes are seeds depends on the order.  Nodes that nobody before
    them could take are seeds at once and take their neighbours; two such
    rounds leave small groups of a set in no special order.  Connected groups
    of the rest are settled whole, each in a task, by a pass in order; of one
    of more than ``whole`` rows first the earliest part, whose seeds then take
    nodes of the rest.
    """
    if "key" not in nodes.columns:
        nodes = nodes.select("id", "ord", F.lit(None).cast("string").alias("key"), F.lit(False).alias("geo"), F.lit(None).cast("int").alias("code"))
    nodes = as_table(nodes.select("id", "ord", "key", "geo", "code"), "nodes")
    place = nodes.select("id", F.struct("ord", "id").alias("place"))
    both = pairs.select("a_id", "b_id").unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).distinct()
    before = both.join(place.select(F.col("id").alias("a_id"), "place"), "a_id").join(place.select(F.col("id").alias("b_id"), F.col("place").alias("other")), "b_id")
    before = as_table(before.where("other < place").select(F.col("a_id").alias("id"), F.col("b_id").alias("near"), "other"), "before")
    free, links, seeds, turn = nodes, before.select("id", "near"), None, 0
    while True:
        if turn < PEELED:
            first = free.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("ord", "id")).alias("first"))
            ready = free.join(links.select("id").distinct(), "id", "left_anti").join(first, "key", "left").where("key IS NULL OR first.id = id")
            settled = ready.select("id", F.lit(True).alias("seed"))
        else:
            settled = _settled(free, links, whole)
        settled = as_table(settled, "settled")
        new = as_table(free.join(settled.where("seed").select("id"), "id", "left_semi"), "seeds")
        by_link = links.join(new.select(F.col("id").alias("near")), "near", "left_semi").select("id")
        kept = new.where("key IS NOT NULL").select("key", F.col("geo").alias("g"), F.col("code").alias("c")).distinct()
        by_key = free.join(kept, "key").where(_agree(F.col("geo"), F.col("code"), F.col("g"), F.col("c"))).select("id")
        gone = as_table(settled.select("id").unionByName(by_link).unionByName(by_key).distinct(), "gone")
        old, seeds = (free, links), new if seeds is None else as_table(seeds.unionByName(new), "seeds")
        free = as_table(free.join(gone, "id", "left_anti"), "free")
        links = as_table(links.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("near")), "near", "left_anti").select("id", "near"), "open")
        drop_tables(settled, gone, *(old if turn else ()))
        turn += 1
        if free.isEmpty():
            break
    # a node goes to the first of the seeds before it that it is paired with
    rank = F.struct("ord", "id")
    named = before.join(seeds.select(F.col("id").alias("near")), "near", "left_semi").select("id", "other")
    earliest = seeds.where("key IS NOT NULL").groupBy("key", F.col("geo").alias("g"), F.col("code").alias("c")).agg(F.min(rank).alias("other"))
    alike = nodes.join(earliest, "key").where(_agree(F.col("geo"), F.col("code"), F.col("g"), F.col("c")) & (F.col("other") < rank)).select("id", "other")
    taken = named.unionByName(alike).groupBy("id").agg(F.min("other").alias("other"))
    own = seeds.select("id", F.lit(True).alias("own"))
    every = nodes.select("id").join(own, "id", "left").join(taken, "id", "left")
    return every.select("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("other.id")).alias("seed"))


#: Nodes of the first turn, and of any at least.
FIRST, LEAST = 50_000, 1_000
#: Pairs that a turn looks at, about.
AT_ONCE = 5_000_000


def first_come_in_turns(nodes: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame], work: Callable[[DataFrame], int],
                        at_once: int = AT_ONCE, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """id, seed as ``first_come`` gives them, where the pairs may be too many to
    be made: ``pairs(a, b)`` are those of rows of two tables (a_id, b_id),
    ``work`` tells how many it takes about to pair a table with itself.

    A turn settles the earliest free nodes, so many that their pairs are about
    ``at_once``; its seeds then take what they are paired with of all later
    nodes, which needs no pairs among these.  Since seeds aren't paired with
    each other there are few of them at any place.  Nodes with the same
    ``ord`` are settled together.
    """
    free, done, turn = as_table(nodes, "free"), [], first
    keyed = "key" in nodes.columns
    place = F.struct("ord", "id")
    n = free.count()
    while n:
        while True:
            turn = min(turn, n)
            limit = None if turn == n else free.agg(F.percentile_approx("ord", turn / n, F.lit(10_000))).first()[0]
            batch = free if limit is None else free.where(F.col("ord") <= F.lit(limit))
            looked_at = work(batch) if turn * turn > at_once else 0
            if looked_at <= at_once or turn <= least:
                break
            turn = max(least, int(turn * max(1 / 16, 0.9 * (at_once / looked_at) ** 0.5)))
        chosen = as_table(first_come(pairs(batch, batch).where("a_id < b_id"), batch.select("id", "ord", *(["key", "geo", "code"] if keyed else []))), "chosen")
        done.append(chosen)
        if limit is None:
            break
        seeds = as_table(batch.join(chosen.where("id = seed").select("id"), "id", "left_semi"), "seeds")
        rest = free.where(F.col("ord") > F.lit(limit))
        taken = pairs(seeds, rest).join(seeds.select(F.col("id").alias("a_id"), place.alias("other")), "a_id").select(F.col("b_id").alias("id"), "other")
        if keyed:
            earliest = seeds.where("key IS NOT NULL").groupBy("key", F.col("geo").alias("g"), F.col("code").alias("c")).agg(F.min(place).alias("other"))
            alike = rest.join(earliest, "key").where(_agree(F.col("geo"), F.col("code"), F.col("g"), F.col("c")))
            taken = taken.unionByName(alike.select("id", "other"))
        taken = as_table(taken.groupBy("id").agg(F.min("other").alias("other")).select("id", F.col("other.id").alias("seed")), "chosen")
        done.append(taken)
        left = as_table(rest.join(taken.select("id"), "id", "left_anti"), "free")
        drop_tables(free, seeds)
        free, n = left, left.count()
        turn = max(least, int(turn * min(8, 0.9 * (at_once / looked_at) ** 0.5 if looked_at else 8)))
    out = done[0] if done else free.select("id", F.col("id").alias("seed"))
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _settled(free: DataFrame, links: DataFrame, whole: int) -> DataFrame:
    """id, seed (whether it is one) for the groups of the free nodes, or of
    large groups for their first part."""
    first = free.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("b"))
    stars = free.join(first, "key").select(F.col("id").alias("a"), "b")
    groups = connected(links.select(F.col("id").alias("a"), F.col("near").alias("b")).unionByName(stars)).withColumnRenamed("node", "id")
    # a node is a row without ``near``, which comes before its links
    rows = free.select("id", F.lit(None).cast(links.schema["near"].dataType).alias("near")).unionByName(links.select("id", "near")).join(free, "id")
    rows = as_table(rows.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id")), "rows")
    cuts = [k / PARTS for k in range(1, PARTS + 1)]
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ord", cuts).alias("cuts")).where(F.col("n") > whole)
    limit = F.element_at("cuts", F.greatest(F.lit(1), F.floor(F.lit(whole) * PARTS / F.col("n"))).cast("int"))
    rows = rows.join(sizes.select("group", limit.alias("limit")), "group", "left").where("limit IS NULL OR ord <= limit")
    names = ["group", "ord", "id", "near", "key", "geo", "code"]
    ordered = rows.select(*names).repartition("group").sortWithinPartitions("group", "ord", "id", F.col("near").isNotNull())
    kind = free.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pass in order: a node is a seed unless one before it takes it."""
        group, known, held = None, {}, {}
        node = None

        def close():
            if node is not None and known[node[0]] and node[1] is not None:
                held.setdefault(node[1], set()).add(node[2:])

        for batch in batches:
            done: dict = {}
            for g, _, i, near, key, geo, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if near is None:
                    close()
                    if node is not None:
                        done[node[0]] = known[node[0]]
                    if g != group:
                        group, known, held = g, {}, {}
                    node = i, key, geo, code
                    known[i] = not any(not (geo and x) and (code is None or code != c) for x, c in held.get(key, ())) if key is not None else True
                elif known.get(near, True):
                    known[i] = False
            yield pa.RecordBatch.from_arrays([pa.array(list(done), out), pa.array(list(done.values()), pa.bool_())], ["id", "seed"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], out), pa.array([known[node[0]]], pa.bool_())], ["id", "seed"])

    out = to_arrow_type(free.schema["id"].dataType)
    return ordered.mapInArrow(run, f"id {kind}, seed boolean")
