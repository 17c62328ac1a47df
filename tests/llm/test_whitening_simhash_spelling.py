"""Whitening, SimHash and spelling variants against brute force, on nulls,
empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from terraspan.llm import simhash, spelling, whitening

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- whitening ---------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, component string, width int").repartition(5)


def exact(rows):
    """(ids, x, covariance) by plain integers and numpy's eigenvalues."""
    good = [(i, v) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in good])
    s = x.sum(0)
    y = (x * len(x) - s) / len(x)
    return [i for i, _ in good], x, s, y, y.T @ y / len(x)


@pytest.fixture(scope="module")
def embedded():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(k, [float(c) for c in v], k, "c", 0) for k, v in enumerate(base)]
    rows += [rows[5], rows[5], (None, rows[6][1], 1, "c", 0), (900, None, 1, "c", 0), (901, [1.0] * 11 + [None], 1, "c", 0)]
    rows += [(902, [float("nan")] * 12, 1, "c", 0), (903, [float("inf")] + [0.0] * 11, 1, "c", 0), (904, [], None, None, None)]
    return rows


def test_whitening(spark, embedded):
    ids, x, s, y, cov = exact(embedded)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = whitening.whiten(vectors(spark, embedded)).collect()
    assert len(got) == 8 * len(ids)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i in ids for c in range(1, 9))
    deviations = {i: int(d) for i, d in zip(ids, ((x * len(x) - s) ** 2).sum(1), strict=True)}
    white = {i: row for i, row in zip(ids, y @ v[:, :8] / np.sqrt(e[:8]), strict=True)}
    sign = {r.component: np.sign(r.whitened * white[7][r.component - 1]) for r in got if r.vec_id == 7}
    for r in got:
        assert r.n == len(ids) and r.deviation == deviations[r.vec_id]
        assert r.whitened == pytest.approx(sign[r.component] * white[r.vec_id][r.component - 1], rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-10)
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_whitening_in_many_tasks(spark, embedded):
    """Triangles, sums and moments are merged in groups over several levels."""
    few = {(r.vec_id, r.component): (r.deviation, round(abs(r.whitened), 8)) for r in whitening.whiten(vectors(spark, embedded)).collect()}
    wide = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        many = whitening.whiten(vectors(spark, embedded).repartition(40)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.vec_id, r.component): (r.deviation, round(abs(r.whitened), 8)) for r in many} == few


def test_whitening_without_variance(spark):
    flat = [(k, [float(k), 2.0 * k, 5.0], 0, "", 0) for k in range(9)] + [(50, [1.0, 2.0], 0, "", 0)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert len(got) == 27 and {r.n for r in got} == {9}  # the vector of another length is left out
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 9) for r in got if r.component == 1} == {1.0}
    one = whitening.whiten(vectors(spark, flat[:1])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 3
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, flat[:1])).columns == whitening.whiten(vectors(spark, [])).columns


def test_whitening_of_large_entries(spark):
    rows = [(k, [1e30 * (-1) ** k, float(k)], 0, "", 0) for k in range(4)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and all(np.isfinite(r.whitened) for r in got)
    x = np.array([[1 << 46, 5]], np.int64)
    assert whitening.scaled_deviations(x, 1 << 40, [7, 9])[0].tolist() == [(1 << 86) - 7, (5 << 40) - 9]


@pytest.mark.parametrize("width", [1, 2, 5, 16, 33])
def test_rotations(width):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(60, width)) * 10.0 ** -np.arange(width)[::-1].clip(0, 12)
    norms, v = whitening.rotations(whitening.fold(None, a))
    assert norms == pytest.approx(np.linalg.svd(a, compute_uv=False), rel=1e-9)
    assert np.abs(v.T @ v - np.eye(width)).max() < 1e-13
    b = a @ v / norms
    assert np.abs(b.T @ b - np.eye(width)).max() < 1e-9


# --- simhash -----------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(rows):
    first = {}
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2 and top(a) != top(b):
                up[top(b)] = top(a)
    for d, f in rows:
        if d is not None:
            first[top(f)] = min(d, first.get(top(f), d))
    return [(d, f"{f:016x}", first.get(top(f))) for d, f in rows]


def texts():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(200)] + ["Ärger", "ÄRGER", "Ünïcode", "ABC", "abc"]
    out = [None, "", " \t\r\n", "one", "One", "two words", "two words x y", "a b c"]
    for _ in range(60):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 400))))
    for k in range(8, 30):
        words = out[k].split()
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    return [*out, out[20], out[20], "long word " * 30_000, "x" * 100_000]


def documents(spark, values):
    rows = [(k, t, "a", k, "q") for k, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, id long, word string").repartition(4)


def test_shingles_in_pieces():
    for t in texts()[:40]:
        whole = [h for part in simhash.shingle_hashes((t or "").encode()) for h in part]
        assert [h for part in simhash.shingle_hashes((t or "").encode(), step=7) for h in part] == whole
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("tile", [5, 1 << 14])
def test_simhash(spark, tile):
    docs = documents(spark, texts())
    docs = docs.unionByName(docs.where("doc_id in (3, 20)")).unionByName(docs.where("doc_id in (1, 5)").selectExpr("null as doc_id", "text", "fp", "id", "word"))
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    got = [tuple(r) for r in simhash.near_duplicates(docs, tile=tile).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(set(want)) - 3


def test_simhash_links_are_whole(spark):
    """Chains and clouds of fingerprints, cut into tiles of any size."""
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2, 7, (1 << 64) - 1, 1 << 63}
    for v in list(values)[:20]:
        for _ in range(15):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
        values |= {v ^ (1 << b) for b in range(30)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    group = {int(f, 16): c for _, f, c in plain_components(list(enumerate(sorted(values))))}
    for tile in (3, 40, 10_000):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
        up = {v: v for (v,) in signed}

        def top(v, up=up):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in found:
            assert group[a & ((1 << 64) - 1)] == group[b & ((1 << 64) - 1)]
            up[top(a)] = top(b)
        assert len({top(v) for v in up}) == len(set(group.values()))


def test_simhash_alone(spark):
    empty = documents(spark, ["a"]).where("doc_id < 0")
    assert simhash.near_duplicates(empty).count() == 0
    assert [tuple(r) for r in simhash.near_duplicates(documents(spark, [None])).collect()] == [(0, "0" * 16, 0)]


# --- spelling ----------------------------------------------------------------


def plain_variants(rows, length, least):
    n = Counter()
    for d, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            m = m.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{m}".encode())
            if h % 199 == 0:
                m = m[: h % len(m)] + m[h % len(m) + 1 :]
            n[m] += 1
    vocab = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    letters = sorted(set("".join(vocab)))
    out = {}
    for w, c in vocab.items():
        near = {w[:i] + a + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for a in letters if j <= len(w)}
        near |= {w[:i] + w[i + 1 :] for i in range(len(w))}
        near = {x for x in near if x in vocab and x != w}
        best = min(near, key=lambda x: (-vocab[x], x), default=None)
        form = best if best and vocab[best] >= 5 * c else None
        out[w] = form, c, len(near), vocab.get(form)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted(((w, f, root(w), c, k, fn) for w, (f, c, k, fn) in out.items()), key=repr)


@pytest.mark.parametrize(("length", "least"), [(6, 5), (3, 2)])
def test_spelling(spark, length, least):
    rng = random.Random(4)
    words = ["colour", "harbour", "Straße", "élèvent", "mañana", "aaaaaa", "bookkeeper", "parallel", "été"]
    bag = []
    for w in words:
        forms = [w]
        for _ in range(12):
            v, i = rng.choice(forms), rng.randrange(len(w))
            forms.append(rng.choice([v[:i] + rng.choice("abéÀ×z") + v[i + 1 :], v[:i] + v[i + 1 :], v[:i] + v[i : i + 1] * 2 + v[i + 1 :]]))
        for k, f in enumerate(forms):
            bag += [f] * (200 // (k * k * 3 + 1) + 5)
    bag += ["chainedword"] * 600 + ["chainedwort"] * 60 + ["chaineewort"] * 7
    rng.shuffle(bag)
    rows = [(k, rng.choice([" ", "1", "_", "\n"]).join(bag[k::60])) for k in range(60)]
    rows += [(None, "harbour colour harboor"), (60, None), (61, ""), (62, "x" * 50_000 + " " + "longestword" * 40), (63, "Colour " * 20_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(4)
    want = plain_variants(rows, length, least)
    got = sorted((tuple(r) for r in spelling.variants(docs, length=length, least=least).collect()), key=repr)
    assert got == want
    assert sum(w[1] is not None for w in want) > 20 and ("chaineewort", "chainedwort", "chainedword") in {w[:3] for w in want}


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = spelling.variants(docs)
    assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0
