"""Location groups, clusters and vector search against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geo, vectors
from terraspan.functions.geo import bbox_join
from terraspan.operators import discovery, graph, temporal


def same_place(a, b):
    def share(k):
        w = max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
        h = max(0, min(a[k + 3], b[k + 3]) - max(a[k + 1], b[k + 1]))
        small = min((x[k + 2] - x[k]) * (x[k + 3] - x[k + 1]) for x in (a, b))
        return small > 0 and w * h / small >= 0.35

    if a[2] is not None and b[2] is not None:
        return share(2)
    if a[6] and a[6] == b[6]:
        return share(7)
    return bool(a[11]) and a[11] == b[11]


def scenes(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        x, y = rng.uniform(0, 40), rng.uniform(0, 40)
        box = [x, y, x + rng.uniform(2, 9), y + rng.uniform(2, 9)]
        code = rng.choice([None, 1, 2])
        yield (i, rng.randrange(n), *(box if rng.random() < 0.6 else [None] * 4), code, *([10 * c for c in box] if code else [None] * 4), rng.choice(["", "a", "b", f"s{i}"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_location_groups_are_greedy(spark, seed):
    rows = list(scenes(120, seed))
    df = spark.createDataFrame(rows, "id long, ord long, x0 double, y0 double, x1 double, y1 double, epsg int, px0 double, py0 double, px1 double, py1 double, stem string")
    got = {(r.a_id, r.b_id) for r in temporal.overlaps(df).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and same_place(a, b)}
    want = {}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for a in order:
        if a[0] not in want:
            want[a[0]] = a[0]
            for b in order:
                if b[0] not in want and same_place(a, b):
                    want[b[0]] = a[0]
    assert {r.id: r.seed for r in temporal.seed_groups(df).collect()} == want
    assert temporal.seed_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [geo.DENSE, 3])
def test_overlaps_are_counted(spark, monkeypatch, dense):
    """Number and sum of a scene's pairs, with copies, points and boxes of many
    sizes; 3,000 copies make as many rows, not their square."""
    monkeypatch.setattr(geo, "DENSE", dense)
    rows = list(scenes(150, 4))
    rows += [(200 + k, 0, *r[2:]) for k, r in enumerate(rows[:40])] + [(300, 0, 1.0, 1.0, 1.0, 1.0, None, *[None] * 4, "a"), (301, 0, -900.0, -900.0, 900.0, 900.0, 1, 10.0, 10.0, 90.0, 90.0, "b")]
    names = "id long, ord long, x0 double, y0 double, x1 double, y1 double, epsg int, px0 double, py0 double, px1 double, py1 double, stem string"
    got = {r.id: r for r in temporal.overlap_counts(spark.createDataFrame(rows, names)).collect()}
    assert len(got) == len(rows)

    def place(r):
        return r[2:6] if r[2] is not None else r[6:11] if r[6] else r[11] or r[0]

    for a in rows:
        near = [b[0] for b in rows if a[0] != b[0] and same_place(a, b)]
        assert (got[a[0]].links, got[a[0]].linked) == (len(near), sum(near))
        assert got[a[0]].class_id == min(b[0] for b in rows if place(a) == place(b))
    copies = spark.range(3000).select("id", *[F.lit(x).alias(c) for c, x in (("x0", 0.0), ("y0", 0.0), ("x1", 1.0), ("y1", 2.0))])
    out = temporal.overlap_counts(copies).collect()
    assert len(out) == 3000 and all((r.class_id, r.links, r.linked) == (0, 2999, 2999 * 1500 - r.id) for r in out)


@pytest.mark.parametrize("alike", [2048, 3])
def test_overlaps_are_pairs(spark, monkeypatch, alike):
    """Every pair is a row, however many tasks a stem's scenes are dealt over."""
    monkeypatch.setattr(temporal, "ALIKE", alike)
    rows = list(scenes(150, 4))
    rows += [(200 + k, 0, *r[2:]) for k, r in enumerate(rows[:40])]
    names = "id long, ord long, x0 double, y0 double, x1 double, y1 double, epsg int, px0 double, py0 double, px1 double, py1 double, stem string"
    got = sorted((r.a_id, r.b_id) for r in temporal.overlaps(spark.createDataFrame(rows, names)).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and same_place(a, b))


def test_overlap_query_gives_every_pair(spark):
    """The query returns the pairs themselves, and broadcasts no scenes."""
    from terraspan.plans import geo_queries, registry

    sf, some = "/root/testdata/sf0.001", 1500
    df = registry.QUERIES["jn_spatial_overlap"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 5  # two directions of two rules, and stems
    rows = geo_queries._placed(spark, sf).where(F.col("id") < some).select("id", "ord", "x0", "y0", "x1", "y1", "epsg", "px0", "py0", "px1", "py1", "stem").collect()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and same_place(a, b))
    assert want and sorted((r.a_id, r.b_id) for r in df.where(f"a_id < {some} AND b_id < {some}").collect()) == want


def test_boxes_of_all_sizes(spark, monkeypatch):
    """Points, boxes from 1/1000 to 10,000 wide, reversed and missing ones."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        x, y, w = rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-3, 4) if k % 3 else rng.choice([0, 1, 2, 4])
        rows.append((k, x, y, x + w, y + rng.choice([0, w / 2, w]), k % 2))
    rows += [(200, 0.0, 0.0, 0.0, 0.0, 0), (201, 0.0, 0.0, 1.0, 1.0, 0), (202, 1.0, 1.0, 2.0, 2.0, 0), (203, 5.0, 5.0, 4.0, 6.0, 1), (204, None, 0.0, 1.0, 1.0, 0)]
    whole = [r for r in rows if r[1] is not None and r[1] <= r[3] and r[2] <= r[4]]
    want = sorted((a[0], b[0]) for a in whole for b in whole if a[5] == b[5] and a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, k int")
    sides = [df.select(*[F.col(c).alias(p + c) for c in df.columns]) for p in ("a_", "b_")]
    for dense in (geo.DENSE, 2):
        monkeypatch.setattr(geo, "DENSE", dense)
        assert sorted((r.a_id, r.b_id) for r in bbox_join(*sides, keys=["k"]).collect()) == want


def test_touching_boxes_of_copies(spark):
    """Pairs of equal boxes' smallest ids and their members give all pairs; 2,000
    by 2,000 copies make one."""
    rng = random.Random(5)

    def boxes(n, at):
        return [(at + k, x := rng.randrange(9) / 1.0, y := rng.randrange(9) / 1.0, x + rng.choice([0, 1, 3]), y + 1.0) for k in range(n)]

    a, b = boxes(90, 0), boxes(120, 1000) + [(2000, None, 0.0, 1.0, 1.0), (2001, 5.0, 0.0, 4.0, 1.0)]
    names = "id long, x0 double, y0 double, x1 double, y1 double"
    rows = geo.touching(spark.createDataFrame(a, names), spark.createDataFrame(b, names), ("A", "B")).collect()
    of = {k: [(r.a, r.b) for r in rows if r.kind == k] for k in ("PAIR", "A", "B")}
    assert sorted(x for _, x in of["A"]) == [r[0] for r in a] and sorted(x for _, x in of["B"]) == [r[0] for r in b]
    whole = [r for r in b if r[1] is not None and r[1] <= r[3]]
    want = sorted((p[0], q[0]) for p in a for q in whole if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert sorted((p, q) for s, t in of["PAIR"] for f, p in of["A"] if f == s for g, q in of["B"] if g == t) == want
    assert len(of["PAIR"]) < len(want)
    same = spark.range(2000).select("id", *[F.lit(x).alias(c) for c, x in (("x0", 0.0), ("y0", 0.0), ("x1", 1.0), ("y1", 2.0))])
    assert geo.touching(same, same, ("A", "B")).count() == 4001


@pytest.mark.parametrize("listed", [1024, 2])
def test_touching_pairs_are_all_rows(spark, monkeypatch, listed):
    """Every pair is a row, copies too, however many lists equal boxes make."""
    monkeypatch.setattr(geo, "LISTED", listed)
    rng = random.Random(6)

    def boxes(n, at):
        return [(at + k, x := rng.randrange(9) / 1.0, y := rng.randrange(9) / 1.0, x + rng.choice([0, 1, 3]), y + 1.0) for k in range(n)]

    a, b = boxes(120, 0) + [(500, None, 0.0, 1.0, 1.0), (501, 5.0, 0.0, 4.0, 1.0)], boxes(120, 1000) + [(2000, None, 0.0, 1.0, 1.0), (2001, 5.0, 0.0, 4.0, 1.0)]
    names = "id long, x0 double, y0 double, x1 double, y1 double"
    got = sorted((r.a, r.b) for r in geo.touching_pairs(spark.createDataFrame(a, names), spark.createDataFrame(b, names)).collect())
    whole = [[r for r in rows if r[1] is not None and r[1] <= r[3]] for rows in (a, b)]
    assert got == sorted((p[0], q[0]) for p in whole[0] for q in whole[1] if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert len({r[1:] for r in whole[0]}) < len(whole[0])
    assert geo.touching_pairs(spark.createDataFrame(a, names).limit(0), spark.createDataFrame(b, names)).count() == 0


def test_viewport_query_gives_every_pair(spark, tmp_path):
    """Four copies of the viewports make four times the rows."""
    from terraspan.plans import registry

    sf = "/root/testdata/sf0.001"
    once = registry.QUERIES["flt_bbox_intersects"](spark, sf)
    assert once.columns == ["q", "id"]
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    supplier.crossJoin(spark.range(4)).withColumn("s_suppkey", F.col("s_suppkey") + 336 * F.col("id")).drop("id").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((r.q + 336 * k, r.id) for r in once.collect() for k in range(4))
    assert want and sorted((r.q, r.id) for r in registry.QUERIES["flt_bbox_intersects"](spark, str(tmp_path)).collect()) == want


def plain_first_come(pairs, nodes, agree=None):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, seed = sorted(nodes, key=lambda n: (n[1], n[0])), {}
    for n in order:
        if n[0] not in seed:
            seed[n[0]] = n[0]
            for m in order:
                if m[0] not in seed and (m[0] in near.get(n[0], ()) or (agree is not None and agree(n, m))):
                    seed[m[0]] = n[0]
    return seed


@pytest.mark.parametrize("whole", [60, 10**6])
def test_first_come_in_parts(spark, whole):
    """Chains, cliques and random pairs; groups over the bound go part by part."""
    rng = random.Random(9)
    nodes = [(k, rng.randrange(30) if k > 80 else k, rng.choice(["", "s", "t"]), rng.random() < 0.5, rng.choice([None, 1, 2])) for k in range(140)]
    pairs = [(k, k + 1) for k in range(80)] + [(k, k + 2) for k in range(0, 80, 3)] + [(rng.randrange(140), rng.randrange(140)) for _ in range(70)]
    pairs = [p for p in pairs if p[0] != p[1]]
    links = spark.createDataFrame(pairs, "a_id long, b_id long")
    df = spark.createDataFrame(nodes, "id long, ord long, key string, geo boolean, code int").withColumn("key", F.nullif("key", F.lit("")))
    got = {r.id: r.seed for r in graph.first_come(links, df.select("id", "ord"), whole).collect()}
    assert got == plain_first_come(pairs, nodes)

    def agree(a, b):
        return a[2] == b[2] != "" and not (a[3] and b[3]) and (a[4] is None or a[4] != b[4])

    assert {r.id: r.seed for r in graph.first_come(links, df, whole).collect()} == plain_first_come(pairs, nodes, agree)


def test_a_long_strip_takes_few_rounds(spark, monkeypatch):
    """10,000 footprints in a strip, each on its neighbours, in order."""
    rounds = []
    settled = graph._settled
    monkeypatch.setattr(graph, "_settled", lambda *a: rounds.append(1) or settled(*a))
    n = 10_000
    scenes_ = spark.range(n).select("id", F.col("id").alias("ord"), (F.col("id") * 0.5).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 0.5 + 1).alias("x1"), F.lit(1.0).alias("y1"))
    got = {r.id: r.seed for r in temporal.seed_groups(scenes_).collect()}
    assert got == {k: k - k % 2 for k in range(n)} and len(rounds) + graph.PEELED <= 20


def test_one_stem_for_all_makes_no_pairs(spark):
    n = 20_000
    df = spark.range(n).select("id", F.col("id").alias("ord"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit("site").alias("stem"))
    assert temporal.seed_groups(df).where("seed = 0").count() == n


def plain_kmeans(v, k):
    """(cluster from 0, similarity) of unit vectors in order."""
    c = [v[0]]
    while len(c) < min(k, len(v)):
        c.append(v[np.argmin((v @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(discovery.ITERATIONS if len(c) > 1 else 0):
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == j].sum(0) / np.linalg.norm(v[own == j].sum(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return (v @ c.T).argmax(1), (v @ c.T).max(1)


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 8))
    v = np.concatenate([c + 0.2 * rng.normal(size=(30, 8)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(5)
    got = {r.id: r for r in discovery.spherical_kmeans(df, F.col("v"), "id", 3).collect()}
    own, sims = plain_kmeans(v, 3)
    assert [got[k].cluster for k in range(90)] == (own + 1).tolist() and np.allclose([got[k].similarity for k in range(90)], sims)
    assert {k for k, r in got.items() if r.medoid} == {int(np.flatnonzero(own == j)[sims[own == j].argmax()]) for j in range(3)}
    assert discovery.cluster_count(5, 4) == 2 and discovery.cluster_count(5, 1) == 1


@pytest.mark.parametrize("k", [4, 15])
def test_discovery_of_similar_sites(spark, k):
    """The whole of it against a loop: copies, the own scene, a filter, too
    little likeness, overlapping footprints, clusters."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, 10))
    v = np.array([base[i % 3] + 0.7 * rng.normal(size=10) for i in range(70)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), f"h{i % 50}", float(i % 9), float(i % 7), "sar" if i % 6 == 5 else "optical") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>, h string, x double, y double, modality string").repartition(4)
    box = [F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 2]
    got = {r.id: r for r in discovery.discover(df, 3, k, 3, id_col="id", vector="v", hash_col=F.col("h"), box=box, keep=F.col("modality") != "sar").collect()}
    cos = [round(float(x @ v[3]), 4) for x in v]
    best = {}
    for i in sorted(range(70), key=lambda i: (-cos[i], i))[: 3 * k]:
        if i != 3 and rows[i][2] != rows[3][2]:
            best.setdefault(rows[i][2], i)
    kept = []
    for i in sorted(best.values(), key=lambda i: (-cos[i], i)):
        if rows[i][5] == "sar" or (cos[i] + 1) / 2 < discovery.MIN_SIMILARITY:
            continue

        def iou(a, b):
            w, h = max(0, 2 - abs(a[3] - b[3])), max(0, 2 - abs(a[4] - b[4]))
            return w * h / (8 - w * h)

        if all(iou(rows[i], rows[j]) <= discovery.DUPLICATE_IOU for j in kept):
            kept.append(i)
    kept = sorted(kept[:k])
    own, sims = plain_kmeans(v[kept], discovery.cluster_count(3, len(kept)))
    assert sorted(got) == kept and [got[i].cluster for i in kept] == (own + 1).tolist()
    assert [got[i].similarity_to_reference for i in kept] == pytest.approx([(cos[i] + 1) / 2 for i in kept], abs=1e-4)
    assert {i for i in kept if got[i].medoid} == {kept[int(np.flatnonzero(own == j)[sims[own == j].argmax()])] for j in set(own)}
    with pytest.raises(ValueError, match="no vector"):
        discovery.discover(df, 999, k, 3, id_col="id", vector="v", hash_col=F.col("h"))


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 16))
    v[7] = 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = rng.normal(size=16).tolist()
    cos = np.array([round(float(x @ q / (np.linalg.norm(x) * np.linalg.norm(q))), 4) if x.any() else 0.0 for x in v])
    want = sorted(range(200), key=lambda k: (-cos[k], k))[:10]
    assert [r.vec_id for r in vectors.top_k(df, q, 10).collect()] == want


def test_greedy_dedup_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(k, k % 17, x := rng.uniform(0, 9), y := rng.uniform(0, 9), x + 3, y + 3) for k in range(60)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        def iou(a, b):
            m = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
            return m / (18 - m)

        if all(iou(r, k) <= discovery.DUPLICATE_IOU for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "id long, rank long, x0 double, y0 double, x1 double, y1 double")
    assert {r.id for r in discovery.greedy_dedup(df).collect()} == {r[0] for r in kept}


@pytest.mark.parametrize("seed", [1])
def test_location_groups_in_turns(spark, monkeypatch, seed):
    """A few scenes at a time, with the groups of one pass over all."""
    turns = []
    whole = temporal.first_come_in_turns.__globals__["first_come"]
    monkeypatch.setitem(temporal.first_come_in_turns.__globals__, "first_come", lambda p, n: turns.append(n.count()) or whole(p, n))
    df = _crowd(spark, seed)
    want = {r.id: r.seed for r in temporal.seed_groups(df).collect()}
    assert turns == [240]
    assert {r.id: r.seed for r in temporal.seed_groups(df, at_once=400, first=60, least=20).collect()} == want
    assert len(turns) > 3 and max(turns[1:]) < 120


def _crowd(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(240):
        x, y, w = rng.uniform(0, 6), rng.uniform(0, 6), rng.choice([1.0, 2.0, 4.0])
        g, p = rng.random() < 0.6, rng.random() < 0.6
        box = [x, y, x + w, y + w]
        rows.append((k, 240 - k, *(box if g else [None] * 4), rng.choice([1, 2]) if p else None, *([v * 10 for v in box] if p else [None] * 4), rng.choice(["", "", "a", "b"])))
    return spark.createDataFrame(rows, "id long, ord long, x0 double, y0 double, x1 double, y1 double, epsg int, px0 double, py0 double, px1 double, py1 double, stem string")
