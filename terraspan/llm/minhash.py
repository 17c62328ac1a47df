"""Near duplicates by an inverted join of MinHash signature coordinates.

A document is its set of word shingles; documents of equal sets are one
*node*.  Every node has a signature of ``COORDS`` minima and is posted under
each (coordinate, value) of the first ``POSTED``.  Two sets of similarity 0.75
agree in three quarters of the coordinates on average; ``MATCHES`` of the
posted ones are asked for, and ``FULL_MATCHES`` of all before the full sets
are compared; that misses such a pair once in about 800,000 times, and more
similar pairs far more rarely.

Collisions are counted with prefix and skip merging.  A pair with ``MATCHES``
common postings has one among the first POSTED - MATCHES + 1 of either node,
in order of rising frequency, so only those are joined; a node that shares
fewer than ``MATCHES`` postings with anyone is skipped before.  Rare postings
come first, so passages that many documents share are seldom joined.

Members of one posting list aren't all paired.  In each round every member is
paired with one seeded hub of its list unless both are known to be connected;
pairs are kept if enough coordinates match, then confirmed on the full sets.
Copies grow together in these rounds.  The nodes whose lists still hold more
than one group are settled in ``_settled``: a list (long ones as pairs of
blocks of bounded size) is one unit of work that counts the collisions of its
members, confirms those above the threshold on the full sets by an inverted
index of its shingles, and returns links between different groups only, at
most one fewer than it has members.  So a passage that thousands of documents
share makes no row per pair, and no link between groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm import _features as ft
from terraspan.llm._components import components, join_in_place
from terraspan.llm._spark import as_table, cut, ensure_importable, text_or_empty

WORDS = 5
PERCENT = 75
COORDS = 128
#: Coordinates that are posted, and how many of them have to match.
POSTED = 128
MATCHES = 72
#: Of all coordinates so many have to match before the full sets are compared.
FULL_MATCHES = 72
#: Coordinates counted first, to find the nodes worth a closer look.
FIRST_COORDS = 58
#: Rounds of pairing members with a hub of their list; any number gives the
#: same groups, more leave less for the last step and cost more by themselves.
ROUNDS = 1
#: Coordinates whose lists settle what the rounds leave: two sets of similarity
#: 0.75 agree in none of them once in 16 million times.
LAST_COORDS = 12
#: Members, and shingles of all members, of a block of a list at most.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
#: Bits of the filter that keeps most texts out of the second pass; its size
#: doesn't depend on the data.
FILTER_BITS = 1 << 23

_U = np.uint64
_TAPS = ft.mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_A = ft.mix(np.arange(1001, 1001 + 256, dtype=_U)) | _U(1)
_B = ft.mix(np.arange(5001, 5001 + 256, dtype=_U))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets): sorted distinct 64-bit shingle hashes of each text.

    A-Z is lower-cased.  With fewer words than ``words`` the whole sequence is
    the one shingle; without words the set is empty.
    """
    none = np.zeros(0, _U)
    for first, last, buf, offsets in ft.joined(texts):
        buf = ft.lower_ascii(buf)
        starts, ends = ft.words(buf, ft.is_space(buf))
        h = ft.word_hashes(buf, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        m = max(len(h) - words + 1, 0)
        s = np.zeros(m, _U)
        for k in range(words):
            s += h[k : k + m] * _TAPS[k]
        s = ft.mix(s)
        sets = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(s[a : b - words + 1]))
            elif b > a:
                short = (h[a:b] * _TAPS[: b - a]).sum(dtype=_U) + _U(b - a)
                sets.append(ft.mix(np.array([short], _U)))
            else:
                sets.append(none)
        yield first, sets


def signatures(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """int32 array (sets, coords) of the minima; empty sets give zeros."""
    out = np.zeros((len(sets), coords), np.int32)
    full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    values = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
    for c in range(coords):
        h = ((values * _A[c] + _B[c]) >> _U(32)).astype(np.uint32)
        out[full, c] = np.minimum.reduceat(h, starts).view(np.int32)
    return out


def packed(s: np.ndarray) -> bytes:
    """A set as the upper six bytes of its hashes, in order.  Two sets of m
    and n different shingles seem to share one with odds of m * n / 2**48:
    1 in 10**10 for 150 each, 1 in 700,000 for 20,000 each."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(_U).ravel()


def _measure(docs: DataFrame, words: int) -> DataFrame:
    """k (a number for the row), id, n, digest, sig; written to a table."""
    ensure_importable(docs.sparkSession)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from terraspan.llm.minhash import shingle_sets, signatures

        k = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                m = len(sets)
                minima = signatures(sets)

                def rows_of(x: np.ndarray) -> pa.ListArray:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))

                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(k, k + m, dtype=np.int64)), batch.column(0).slice(first, m),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), rows_of(minima),
                    ],
                    ["k", "id", "n", "digest", "sig"],
                )
                k += m

    schema = f"k long, id {id_type}, n long, digest binary, sig array<int>"
    return as_table(docs.mapInArrow(run, schema), "signatures")


def _postings(nodes: DataFrame, coords: int) -> DataFrame:
    each = nodes.select(F.col("k"), F.posexplode(F.slice("sig", 1, coords)).alias("i", "v"))
    token = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return each.select("k", token.alias("token"))


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that more than one node has, with their number f."""
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    return postings.join(counts, "token")


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """token, k: the postings that have to be joined."""
    need_first = MATCHES - (POSTED - FIRST_COORDS)
    first = _shared(_postings(nodes, FIRST_COORDS)).groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    near = nodes.join(first.where(F.col("m") >= need_first), "k", "left_semi")
    near = cut(near.select("k", "sig"))
    mine = _shared(_postings(near, POSTED)).groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("p")
    )
    length = F.size("p") - (MATCHES - 1)  # prefix less the postings nobody shares
    mine = mine.where(length > 0).select("k", F.explode(F.slice("p", F.lit(1), length)).alias("p"))
    return cut(mine.select("k", F.col("p.token").alias("token")))


def _bitmap_filter(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be in ids: a bitmap of FILTER_BITS bits in at
    most FILTER_BITS / 64 rows is joined by broadcast."""
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    word, bit = (spot / 64).cast("long"), F.pmod(spot, F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, b)")
    bitmap = (
        ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or(one).alias("bits"))
    )
    marked = docs.withColumns({"w": word, "b": bit}).join(F.broadcast(bitmap), "w")
    return marked.where(F.expr("(shiftright(bits, b) & 1L) = 1L")).drop("w", "b", "bits")


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """k, bag: the packed sets of the given nodes (k, id, digest), from their
    texts; those of nodes without an id by the digest."""
    named, nameless = nodes.where("id IS NOT NULL"), nodes.where("id IS NULL").select("k", "digest")
    rows = _bitmap_filter(docs, named.select("id")).join(named.select("k", "id", "digest"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.minhash import packed, shingle_sets

        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), words):
                # an id may stand for several texts: only the node's own counts
                own = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d
                    for s, d in zip(sets, batch.column(1).slice(first, len(sets)).to_pylist(), strict=True)
                ]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([packed(s) for s in sets], pa.binary())], ["k", "bag"]
                )
                yield out.filter(pa.array(own))

    def by_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.minhash import packed, shingle_sets

        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), words):
                own = [s for s in sets if len(s)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([packed(s) for s in own], pa.binary())], ["digest", "bag"])

    found = rows.select("k", "digest", "text").mapInArrow(run, "k long, bag binary").dropDuplicates(["k"])
    if not nameless.isEmpty():
        bags = docs.where("id IS NULL").select("text").mapInArrow(by_digest, "digest binary, bag binary")
        found = found.unionByName(bags.dropDuplicates(["digest"]).join(nameless, "digest").select("k", "bag"))
    return as_table(found, "sets")


def _matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree in at least FULL_MATCHES coordinates."""
    sigs = nodes.select("k", "sig")
    both = pairs.join(sigs.select(F.col("k").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("k").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.where(same >= FULL_MATCHES).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("bag").alias("x")), "a")
    both = both.join(sets.select(F.col("k").alias("b"), F.col("bag").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.minhash import unpacked

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                inter = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * inter >= percent * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Sizes that the threshold allows at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _pair(df: DataFrame) -> DataFrame:
    """Each unordered pair once, as one of the lists has it (member a, hub b)."""
    both = df.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "b")).alias("p"))
    return both.select("p.a", "p.b")


class _List:
    """The members of one list (or of two of its blocks) in a task."""

    def __init__(self, rows: pa.RecordBatch):
        self.k, self.c, self.n, side = (rows.column(j).to_numpy(zero_copy_only=False) for j in range(4))
        self.second = side == 1
        self.sig = rows.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(self.k), -1)
        self.bags = [unpacked(x.as_buffer()) for x in rows.column(5)]
        self.index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """Shingles that the row has in common with each of the others."""
        mine = self.bags[row]
        if len(others) <= 4:
            return np.array([len(np.intersect1d(mine, self.bags[x], assume_unique=True)) for x in others], np.int64)
        if self.index is None:
            values = np.concatenate(self.bags)
            order = np.argsort(values, kind="stable")
            owners = np.repeat(np.arange(len(self.bags)), [len(b) for b in self.bags])[order]
            distinct, starts = np.unique(values[order], return_index=True)
            self.index = distinct, np.append(starts, len(values)), owners
        distinct, starts, owners = self.index
        at = np.searchsorted(distinct, mine)
        sizes = starts[at + 1] - starts[at]
        ends = np.cumsum(sizes)
        posts = owners[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(ends[-1])]
        return np.bincount(posts, minlength=len(self.bags))[others]

    def links(self, coord: int, percent: int) -> list[tuple[int, int]]:
        """Links that join the groups ``c`` of the members; none that follows
        from the others.  A pair counts in the list of the first coordinate in
        which it agrees, so it is looked at once."""
        names, group, sizes = np.unique(self.c, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return []
        two = self.second.any()
        major = group == np.argmax(sizes)
        found = []
        for row in np.flatnonzero(~major):
            other = group != group[row]
            # of two members outside the largest group, the later one meets the earlier
            other[row:] &= major[row:]
            if two:
                other &= self.second != self.second[row]
            x = np.flatnonzero(other)
            small, large = np.minimum(self.n[x], self.n[row]), np.maximum(self.n[x], self.n[row])
            x = x[100 * small >= percent * large]
            if not len(x):
                continue
            same = self.sig[x] == self.sig[row]
            x = x[(np.count_nonzero(same, axis=1) >= MATCHES) & ~same[:, :coord].any(axis=1)]
            if not len(x):
                continue
            inter = self.common(row, x)
            for y in x[100 * inter >= percent * (self.n[x] + self.n[row] - inter)]:
                if group[y] != group[row]:
                    found.append((int(self.k[row]), int(self.k[y])))
                    group[group == group[row]] = group[y]
        return found


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first key, rows) of each run of equal values in the first columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(j).to_numpy() for j in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for x in cols:
            new[1:] |= x[1:] != x[:-1]
        new[0] = last is not None and tuple(x[0] for x in cols) != last
        at = 0
        for cut_at in np.flatnonzero(new):
            rows = [*held, *([batch.slice(at, cut_at - at)] if cut_at > at else [])]
            held, at = [], cut_at
            whole = pa.concat_batches(rows) if len(rows) > 1 else rows[0]
            yield int(whole.column(0)[0].as_py()), whole
        held.append(batch.slice(at))
        last = tuple(x[-1] for x in cols)
    if held:
        whole = pa.concat_batches(held)
        yield int(whole.column(0)[0].as_py()), whole


def _settled(left: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different groups among the nodes ``left`` (k, c, n)."""
    posts = cut(_postings(left.join(sigs, "k"), LAST_COORDS).join(left, "k"))
    size, shingles = F.count(F.lit(1)), F.sum("n")
    blocks = F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    lists = posts.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), blocks.alias("blocks"), size.alias("__ts_n"))
    posts = cut(join_in_place(posts, lists.where("lo <> hi").select("token", "blocks", "__ts_n"), "token", posts.count()))
    own = F.pmod(F.xxhash64("k", "token"), F.col("blocks")).cast("int")
    # a member goes to the pairs of its block with every block
    posts = posts.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    units = posts.select(
        "k", "c", "n", "token", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"),
        (F.col("own") > F.col("to")).cast("int").alias("side"),
    )
    units = units.join(sigs, "k").join(sets, "k").select("token", "i", "j", "k", "c", "n", "side", "sig", "bag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.minhash import _List, _runs

        found: list[tuple[int, int]] = []
        for token, rows in _runs(batches, 3):
            found += _List(pa.RecordBatch.from_arrays(rows.columns[3:], names=list("kcnsxy"))).links(token >> 32, percent)
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    units = units.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return units.mapInArrow(run, "a long, b long")


def linked_nodes(docs: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame | None:
    """k, comp for the nodes that are linked with any other; None if none is.

    ``docs``: id, text.  ``nodes``: k, id, n, digest, sig, one row per
    distinct set.
    """
    lists = prefix_lists(nodes)
    active = lists.select("k").distinct()
    near = cut(nodes.join(active, "k", "left_semi"))
    if near.isEmpty():
        return None
    sets = _full_sets(docs, near, words)
    sigs = near.select("k", "sig")
    members = cut(lists.join(near.select("k", "n"), "k"))
    n_members = members.count()
    comps: DataFrame | None = None

    def labelled(turn: int) -> DataFrame:
        """Members of the lists that still hold more than one group."""
        if comps is None:
            df = members.withColumn("c", F.col("k"))
        else:
            df = cut(members.join(comps, "k", "left").withColumn("c", F.coalesce("comp", "k")).drop("comp"))
        open_lists = df.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("__ts_n"))
        # after a round the one pair of a list of two is known
        open_lists = open_lists.where("lo <> hi").where(F.col("__ts_n") > (2 if turn else 1))
        return cut(join_in_place(df, open_lists.select("token", "__ts_n"), "token", n_members))

    def merged(links: DataFrame) -> DataFrame:
        """The groups after the links are added."""
        if comps is None:
            return as_table(components(links).select(F.col("node").alias("k"), "comp"), "groups")
        known = comps.withColumnRenamed("comp", "c")
        up = links.join(known.withColumnRenamed("k", "a").withColumnRenamed("c", "ca"), "a", "left")
        up = up.join(known.withColumnRenamed("k", "b").withColumnRenamed("c", "cb"), "b", "left")
        top = components(up.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        moved = comps.join(top.withColumnRenamed("comp", "top"), F.col("comp") == F.col("node"), "left")
        moved = moved.select("k", F.coalesce("top", "comp").alias("comp"))
        added = top.select(F.col("node").alias("k"), "comp").join(comps, "k", "left_anti")
        return as_table(moved.unionByName(added), "groups")

    for turn in range(ROUNDS):
        lab = labelled(turn)
        draw = F.struct(F.xxhash64(F.lit(turn), "k").alias("h"), F.col("k").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
        hubs = lab.groupBy("token").agg(F.min(draw).alias("x"), F.count(F.lit(1)).alias("__ts_n")).select("token", "x.b", "x.cb", "x.nb", "__ts_n")
        found = join_in_place(lab, hubs, "token", n_members).where((F.col("c") != F.col("cb")) & _fits(F.col("n"), F.col("nb"), percent))
        pairs = _pair(found.select(F.col("k").alias("a"), "b"))
        links = cut(_confirmed(_matching(pairs, sigs), sets, percent))
        if not links.isEmpty():
            comps = merged(links)
    left = cut(labelled(ROUNDS).select("k", "c", "n").distinct())
    links = cut(_settled(left, sigs, sets, percent))
    return comps if links.isEmpty() else merged(links)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links between documents
    whose shingle sets have at least ``percent`` per cent of their union in
    common.  Null and empty texts have no shingle and link with nothing.  Rows
    with a null id take part, but never give a component its id; a component
    of such rows only has component_id null.  Rows that repeat an id and text
    are returned each; kept is true for every row whose id is its
    component_id.  Texts of any length count whole.  An empty table gives an
    empty one.  Extra columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = _measure(base, words)
    # a row with an id stands for its class, if there is any
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "k"))
    classes = rows.where("n > 0").groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.k").alias("rep"))
    placed = rows.join(classes, "digest", "left")
    nodes = cut(placed.where("k = rep").select("k", "id", "n", "digest", "sig"))
    comps = linked_nodes(base, nodes, words, percent)
    members = placed.select("k", "id", "n", "rep")
    if comps is None:
        group = members.withColumn("g", F.col("rep"))
    else:
        group = members.join(comps.withColumnRenamed("k", "rep"), "rep", "left").withColumn("g", F.coalesce("comp", "rep"))
    # rows without shingles are groups of their own; negative, so no other has the number
    group = cut(group.select("id", "n", F.coalesce("g", -1 - F.col("k")).alias("g")))
    least = group.groupBy("g").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("__ts_n"))
    placed = join_in_place(group, least, "g", group.count())
    return placed.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
