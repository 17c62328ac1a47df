"""Regions of masks, cut into any tiles, against a plain flood fill; connected
groups against union-find."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terraspan.operators import graph, regions


def flood(pixels):
    """The first pixel in row order of each pixel's region."""
    left, out = set(pixels), {}
    for start in sorted(pixels, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        stack = [start]
        left.discard(start)
        while stack:
            x, y = stack.pop()
            out[(x, y)] = start[1] * regions.ROW + start[0]
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
    return out


def masks():
    rng = random.Random(7)
    for scene, share in (("sparse", 0.4), ("half", 0.6), ("dense", 0.9)):
        yield scene, [(x, y) for x in range(23) for y in range(17) if rng.random() < share]
    yield "comb", [(x, y) for x in range(20) for y in range(20) if x % 2 == 0 or y == 19]
    yield "snake", [(x, y) for x in range(21) for y in range(21) if y % 2 == 0 or x == (20 if y % 4 == 1 else 0)]
    yield "full", [(x, y) for x in range(16) for y in range(16)]
    yield "one", [(5, 9)]


@pytest.mark.parametrize(("tile", "few"), [(1, graph.FEW), (4, 0), (7, graph.FEW), (512, graph.FEW)])
def test_regions_of_tiles(spark, tile, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    want = {(s, x, y): r for s, pixels in masks() for (x, y), r in flood(pixels).items()}
    rows = [(s, x, y, float(x * y % 13), "d") for s, pixels in masks() for x, y in pixels]
    rows += [("one", 5, 9, 2.0, "again"), (None, 1, 1, 1.0, "d"), ("one", None, 1, 1.0, "d"), ("one", 9, None, 1.0, "d"), ("gap", 0, 0, None, "d")]
    df = spark.createDataFrame(rows, "scene string, x int, y int, delta double, region string").repartition(6)
    got = regions.components(df, tile=tile).collect()
    assert {(r.scene, r.x, r.y): r.region for r in got} == want | {("gap", 0, 0): 0} and len(got) == len(want) + 1
    table = {(r.scene, r.region): r for r in regions.region_table(regions.region_runs(df, tile=tile)).collect()}
    for key in {(s, r) for (s, _, _), r in want.items()}:
        own = [(x, y) for (s, x, y), r in want.items() if (s, r) == key]
        assert (key in table) == (len(own) >= 15)
        if key in table:
            r, deltas = table[key], [x * y % 13 for x, y in own]
            assert (r.pixels, r.min_x, r.max_x, r.min_y, r.max_y) == (len(own), *(f(p[k] for p in own) for k in (0, 1) for f in (min, max)))
            assert r.max_delta == max(deltas) and r.mean_delta == pytest.approx(sum(deltas) / len(own))
    assert regions.components(df.limit(0)).count() == 0


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1))
@settings(max_examples=150, deadline=None)
def test_runs_of_a_tile(pixels):
    order = sorted(pixels, key=lambda p: (p[1], p[0]))
    x, y = (np.array([p[k] for p in order]) for k in (0, 1))
    first, last = regions.runs_of(x, y)
    root = regions.label_runs(y[first], x[first], x[last])
    got = {(int(c), int(y[a])): int(y[first][r] * regions.ROW + x[first][r]) for a, b, r in zip(first, last, root, strict=True) for c in range(x[a], x[b] + 1)}
    assert got == flood(pixels)


@pytest.mark.parametrize("few", [0, 60, graph.FEW])
def test_connected(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(100)] + [(999, 600 + k) for k in range(50)] + [(7, 7)]
    rng.shuffle(links)
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.group for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in nodes}
    assert graph.connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
