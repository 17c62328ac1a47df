"""LMDB files written page by page, read back in several partitions."""

import io
import pickle
import random

import numpy as np
import pytest

from terraspan.operators import training
from terraspan.sources import encoders, lmdb


def items(n, seed=1):
    rng = random.Random(seed)
    return {f"k{rng.randrange(10**6)}".encode() * rng.randrange(1, 4): rng.randbytes(rng.choice([0, 1, 30, 300, 1900, 3000, 20_000])) for _ in range(n)}


@pytest.mark.parametrize(("n", "page", "most"), [(0, 4096, 99), (1, 4096, 99), (7, 4096, 3), (400, 4096, 5), (900, 4096, 1 << 30), (300, 16384, 8)])
def test_tree(n, page, most):
    have = items(n)
    tree = lmdb.Tree(io.BytesIO(encoders.lmdb(list(have.items()), page, most)))
    assert tree.page == page and tree.entries == len(have)
    for least in (1, 3, 50):
        pages = tree.subtrees(least)
        assert [x for p in pages for x in tree.items(p)] == sorted(have.items())
        assert len(pages) >= min(least, n // most)


def test_newest_meta_counts_and_damage():
    a = bytearray(encoders.lmdb([(b"a", b"1")]))
    assert lmdb.Tree(io.BytesIO(bytes(a))).entries == 1
    a[4096:8192] = bytes(4096)  # the newer one is lost: the state before it
    assert lmdb.Tree(io.BytesIO(bytes(a))).entries == 0
    with pytest.raises(lmdb.Damaged):
        lmdb.Tree(io.BytesIO(bytes(9000)))
    b = encoders.lmdb(list(items(50).items()))
    tree = lmdb.Tree(io.BytesIO(b[:8192]))
    with pytest.raises(lmdb.Damaged):
        tree.subtrees(5)


def test_source(spark, tmp_path):
    have = items(500)
    for k in range(2):
        (tmp_path / f"part{k}").mkdir()
        (tmp_path / f"part{k}" / "data.mdb").write_bytes(encoders.lmdb(sorted(have.items())[k::2], most=6))
    df = lmdb.read(spark, str(tmp_path), 4)
    assert {bytes(r.key): bytes(r.value) for r in df.collect()} == have and 4 <= df.rdd.getNumPartitions() <= 8
    one = lmdb.read(spark, str(tmp_path / "part0" / "data.mdb"), 100)
    assert one.count() == 250


def test_many_files(spark, tmp_path, monkeypatch):
    """Of many files a partition reads some whole ones, and large ones are split."""
    monkeypatch.setattr(lmdb, "MOST", 6)
    have = items(900)
    for k, kept in enumerate([sorted(have.items())[:400], *[sorted(have.items())[400 + k :: 30] for k in range(30)]]):
        (tmp_path / f"part{k}").mkdir()
        (tmp_path / f"part{k}" / "data.mdb").write_bytes(encoders.lmdb(kept, most=6))
    opened = []
    monkeypatch.setattr(lmdb, "_opened", lambda path, f=lmdb._opened: opened.append(path) or f(path))
    reader = lmdb.LmdbReader({"path": str(tmp_path), "partitions": "8"})
    parts = reader.partitions()
    assert len(opened) == 1 and 4 <= len(parts) <= 8
    assert {k.as_py(): v.as_py() for p in parts for b in reader.read(p) for k, v in zip(b.column(0), b.column(1), strict=True)} == have


def test_files_exist_for_a_turn_only(spark, monkeypatch):
    """The query's files are removed before those of the next keys are written."""
    from pathlib import Path

    from terraspan.plans import ingest_queries as plans

    monkeypatch.setattr(plans, "KEYS_OF_A_FILE", 50)
    want = sorted(plans.src_lmdb(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(plans, "KEYS_OF_A_TURN", 300)
    files = []

    def drop(spark, path, f=plans.drop_path):
        files.append(len(list(Path(path.removeprefix("file://")).rglob("data.mdb"))))
        f(spark, path)
        assert not Path(path.removeprefix("file://")).exists()

    monkeypatch.setattr(plans, "drop_path", drop)
    assert sorted(plans.src_lmdb(spark, "/root/testdata/sf0.001").collect()) == want
    assert len(want) == 1500 and sum(files) == 30 and len(files) == 5 and max(files) <= 8


def test_patches(spark, tmp_path):
    rng = np.random.default_rng(1)
    patch = {"B02": rng.integers(0, 9, (4, 4), np.uint16), "B01": rng.normal(size=(2, 2))}

    class Bad:
        def __reduce__(self):
            return (print, ("never",))

    rows = [(b"p1", pickle.dumps(patch)), (b"p2", pickle.dumps({"B02": patch["B02"]}, 2)), (b"evil", pickle.dumps(Bad())), (b"junk", b"junk"), (b"list", pickle.dumps([1]))]
    (tmp_path / "data.mdb").write_bytes(encoders.lmdb(rows))
    bands = lmdb.patch_bands(lmdb.read(spark, str(tmp_path)))
    got = bands.collect()
    assert {r.patch for r in got if r.problem} == {"evil", "junk", "list"}
    assert {(r.patch, r.band): np.array(r.values).reshape(r.side, -1).tolist() for r in got if not r.problem} == {("p1", k): v.tolist() for k, v in patch.items()} | {("p2", "B02"): patch["B02"].tolist()}
    stacks = {r.patch: r for r in training.stack_bands(bands.where("problem IS NULL"), "patch", ["B01", "B02"], 4).collect()}
    assert np.array(stacks["p1"].stack).shape == (2, 4, 4) and stacks["p2"].missing == ["B01"]
