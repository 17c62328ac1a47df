"""Operators against brute force, on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from terraspan.llm import (
    _components,
    _sample,
    exact_dedup,
    html_extract,
    langid,
    minhash,
    mixing,
    packing,
    quality_model,
    quality_rules,
    stages,
    toxicity,
    url_filter,
)

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def texts():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    out = [None, "", "   ", "one", "a b  c", "a b\tc", "A b c", "é ü", "é  ü"]
    for _ in range(40):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))))
    out += out[12:20] + [out[12] + " ", "long " * 20_000, "x" * 50_000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, "d", k) for k, t in enumerate(texts())]
    rows += [(3, rows[3][1], "s0", "d", 0), (None, "a b c", "s1", "d", 1), (None, None, None, None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, id long").repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, digest string, id long")


def dedup_expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(SPACE.sub(" ", r.text or ""), []).append(r.doc_id)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        seen = set()
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and i not in seen, sha))
            seen.add(i)
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_exact_dedup(docs, hot_rows):
    got = exact_dedup.exact_dedup(docs, hot_rows=hot_rows, hot_share=10**6, salts=4).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got], key=repr) == dedup_expected(docs.collect())


def test_exact_dedup_with_colliding_digests(docs):
    got = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.md5(t), 1, 1), hot_rows=2, hot_share=10**6, salts=3).collect()
    want = dedup_expected(docs.collect())
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=repr) == sorted([w[:4] for w in want], key=repr)


def test_exact_dedup_rows_and_empty(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({SPACE.sub(" ", r.text or "") for r in docs.collect()})
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 7)))
        counts = rng.integers(1, 4, len(sizes))
        items = [s for s, c in zip(sizes, counts, strict=True) for _ in range(c)]
        sums = {0}
        for s in items:
            sums |= {x + s for x in sums}
        budget = float(rng.uniform(0, sum(items)))
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * sizes).sum())
        assert abs(got - budget) == pytest.approx(min(abs(x - budget) for x in sums))


def shares(sizes, weights, cap=3.0):
    """Targets by sharing the excess again until none is above its cap."""
    total, capped = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(cap * sizes[k] for k in capped)
        w = sum(weights[k] for k in free)
        t = {k: rest * weights[k] / w for k in free}
        over = [k for k in free if t[k] > cap * sizes[k]]
        if not over:
            return [cap * sizes[k] if k in capped else t[k] for k in range(len(sizes))]
        capped |= set(over)


def test_targets(spark):
    sizes = {"a": 500, "b": 10, "c": 40, "d": 3000, "e": 0, "f": 25, None: 77}
    names = sorted([s for s in sizes if s is not None]) + [None]
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = shares([sizes[n] for n in names], [k % 3 + 1 for k in range(len(names))])
    for n, w in zip(names, want, strict=True):
        assert got[n] == pytest.approx(w)


def test_mix(docs, none):
    rows = mixing.mix_sources(docs, buckets=2).collect()
    again = mixing.mix_sources(docs.repartition(7), buckets=2).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    source = {r.doc_id: r.source for r in docs.collect() if r.doc_id is not None}
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    taken, target, largest = {}, {}, {}
    for r in sorted(rows, key=key):
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        if r.doc_id is not None:
            assert r.size == size[r.doc_id]
            s = source[r.doc_id]
        else:
            s = "s1" if r.size else None
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 60), r.size)
        target[s] = r.target
    for s, t in taken.items():
        assert abs(t - target[s]) <= largest[s], (s, t, target[s])
    assert mixing.mix_sources(none).count() == 0


def rules_expected(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams, covered = {}, set()
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered |= {p for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    odd = ["a b c d e f g h " * 3, "x\nx\n \ny\nx", "### $$$ a|b <c>", "w " * 8, "one two three four five six seven eight nine one two three four five six seven eight"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = sorted(tuple(r) for r in quality_rules.ledger(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(rules_expected(r.text) for r in df.collect())
    judged = quality_rules.apply_policy(quality_rules.ledger(df), "base")
    assert judged.where("kept = (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words)").count() == df.count()
    each = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(df), "base").collect()}
    assert each["few_words"].failing == judged.where("n_words < 20").count() and each["few_words"].rows == df.count()
    assert quality_rules.ledger(none).count() == 0


def test_ledger_filters(spark):
    """Filters on any measurement end, for very long texts too."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh#", "ij"]) + str(rng.randrange(50)) for _ in range(100_000))
    rows = [(1, long), (2, "a b c"), (3, None), (None, "one two three four five six seven eight nine ten " * 3)]
    entries = quality_rules.ledger(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int"))
    assert "kept" not in entries.columns
    judged = quality_rules.apply_policy(entries, "v1")
    want = {i: rules_expected(t) for i, t in rows}
    for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
        for i, t in rows:
            got = {r.doc_id for r in judged.where(F.col(name) == want[i][k]).collect()}
            assert got == {j for j, v in want.items() if v[k] == want[i][k]}
    assert {r.doc_id for r in judged.where("kept").collect()} <= {1}
    assert {r.doc_id for r in judged.where("NOT kept").collect()} >= {2, 3, None}


def url_expected(url, rules):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://example.org/es/x", "http://A.Example.ORG/en/17?x#y", "https://example.org", "https://org/", "http://x.com/fr/1", "http://x.com/de/",
        "http://x.com:80/fr/", "http://notexample.org/es/", "a://b.com?q=/fr/", "http://sub.example.org/en/", "http://ex.com/fr", "http://é.org/ü/..//", "http://example.org/es/x",
    ]
    rules = [*url_filter.RULES, ("com", "/fr/1", "block"), ("x.com", "/fr/", "block"), ("", "", "allow"), ("ex", "ample.org/e", "block"), ("example", ".org/es/", "block")]
    df = spark.createDataFrame([(k % 14, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, url_filter.rules_frame(spark, rules)).collect()
    want = sorted([(k % 14, *url_expected(u, rules)) for k, u in enumerate(urls)], key=repr)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=repr) == want
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert url_filter.judge_urls(df, url_filter.rules_frame(spark).limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


def language_rows():
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "th", "and"], "de": ["sch", "ung", "ü", "der"], "fr": ["eau", "que", "é", "les"]}
    for k in range(240):
        lang = list(parts)[k % 3]
        yield k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang


def test_language(spark):
    rows = list(language_rows()) + [(900, None, "en"), (901, "123 !!", "de"), (902, "the and ing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert (model.weights != 0).mean() < 0.2 and 0.05 <= model.temperature <= 20
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    known = [(k, y) for k, t, y in rows if k < 900]
    assert np.mean([got[k].lang_pred == y for k, y in known]) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0.0 and got[902].lang_pred == "en"
    assert langid.predict(df.limit(0), model).count() == 0
    empty = langid.fit(df.where("lang IS NULL"))
    assert langid.predict(df, empty).where("lang_pred = 'und' AND score = 0").count() == len(rows)


def plain_grams(text, buckets):
    """Bucket counts of the n-grams, in plain Python integers."""
    low = (text or "").lower() + " "
    codes = [ord(c) if c.isalpha() else 0 for c in low]
    m32, out = 0xFFFFFFFF, {}
    for n in langid.GRAMS:
        for i in range(len(codes) - n + 1):
            g = codes[i : i + n]
            if (n == 1 and not g[0]) or (n == 2 and not any(g)) or (n == 3 and not g[1]):
                continue
            h = sum(c * int(t) for c, t in zip(g, langid._TAPS, strict=False)) + (n * 0x68E31DA4 & m32) & m32
            h ^= h >> 16
            h = h * 0x7FEB352D & m32
            h ^= h >> 15
            h = h * 0x846CA68B & m32
            h >>= 32 - buckets.bit_length() + 1
            out[h] = out.get(h, 0) + 1
    return out


def test_language_scores_against_plain_loops(spark):
    rows = list(language_rows())[:90]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs, buckets=1 << 10)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    df = np.zeros(1 << 10)
    for _, t, _ in known:
        for b in plain_grams(t, 1 << 10):
            df[b] += 1
    assert np.allclose(model.idf, np.log((1 + len(known)) / (1 + df)) + 1, atol=1e-5)
    odd = [(500, "Das der " * 30_000), (501, "x"), (502, "éÉ1é"), (503, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(*r[:2],) for r in rows + odd], "doc_id long, text string"), model).collect()}
    for k, t, *_ in rows + odd:
        counts = plain_grams(t, 1 << 10)
        if not counts:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        x = {b: np.log1p(n) * float(model.idf[b]) for b, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * float(model.weights[b][y]) for b, v in x.items()) + float(model.bias[y])) / model.temperature for y in range(len(model.langs))]
        p = np.exp(z) / np.exp(z).sum()
        assert got[k].score == pytest.approx(p.max(), abs=1e-4) and got[k].lang_pred == model.langs[int(np.argmax(p))]


def test_language_training_is_ftrl_proximal():
    texts, langs, buckets = ["ab ba", "ca ac c", "ab", "cc ca", "bab", "acc"], ["x", "y", "x", "y", "x", "y"], 1 << 6
    idf = np.ones(buckets)
    got = langid.train(texts, langs, idf, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=2, seed=5)
    z, s = np.zeros((buckets + 1, 2)), np.zeros((buckets + 1, 2))

    def weight(i, y):
        if abs(z[i, y]) <= 0.02:
            return 0.0
        return -(z[i, y] - np.sign(z[i, y]) * 0.02) / ((1.0 + np.sqrt(s[i, y])) / 0.5 + 0.02)

    fit = [k for k in range(6) if k % 5]
    rng = np.random.default_rng(5)
    for _ in range(2):
        for k in rng.permutation(len(fit)):
            counts = plain_grams(texts[fit[k]], buckets)
            x = {b: np.log1p(n) for b, n in counts.items()}
            norm = np.sqrt(sum(v * v for v in x.values()))
            x = {b: v / norm for b, v in x.items()} | {buckets: 1.0}
            scores = np.array([sum(v * weight(b, y) for b, v in x.items()) for y in range(2)])
            p = np.exp(scores) / np.exp(scores).sum()
            steps = {(b, y): v * (p[y] - (langs[fit[k]] == "xy"[y])) for b, v in x.items() for y in range(2)}
            for (b, y), g in steps.items():
                sigma = (np.sqrt(s[b, y] + g * g) - np.sqrt(s[b, y])) / 0.5
                z[b, y] += g - sigma * weight(b, y)
                s[b, y] += g * g
    assert np.allclose(got.weights, [[weight(b, y) for y in range(2)] for b in range(buckets)], atol=1e-5)


def test_samples_are_bounded_whatever_repeats(spark):
    """Null, repeated and equal rows don't make the sample larger."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("id"), F.lit("same").alias("text"))
    assert _sample.bounded_sample(docs, ("id", "text"), 100, 20_000).count() <= 51
    docs = docs.withColumn("text", F.rand(1).cast("string"))
    assert 20 <= _sample.bounded_sample(docs, ("id", "text"), 100, 20_000).count() <= 250
    known = spark.range(50).select("id", F.lit(1).alias("label"))
    assert _sample.labelled_rows(docs, known, 100).count() <= 400


def labelled(bad):
    rng = random.Random(7)
    good = ["the", "quiet", "river", "bends", "north", "again", "slowly"]
    for k in range(160):
        w = [rng.choice(good) for _ in range(25)]
        yield k, " ".join(bad(w, rng)) if k % 4 == 0 else " ".join(w), int(k % 4 == 0)


def test_quality_model(spark):
    rows = list(labelled(lambda w, r: [x.upper() + "###" for x in w]))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - y, "x") for k, _, y in rows] + [(900, None, "x")], "doc_id long, quality int, text string")
    model = quality_model.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert all((got[k] >= 0.3) == (y == 0) for k, _, y in rows)
    assert got[900] == got[901] == pytest.approx(model.prior)
    one = quality_model.fit(docs, labels.where("quality = 1"))
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, one).collect())
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_quality_features_match_a_plain_count():
    text = "ab  AB ab ab\n é#"
    (buf, offsets) = [quality_model.ft.characters(b, o) for _, _, b, o in quality_model.ft.joined(pa.array([text]))][0]
    assert bytes(buf.astype("<u4")).decode("utf-32-le") == text + " " and offsets.tolist() == [0, len(text) + 1]
    kinds = list(quality_model.features(buf, offsets))
    assert len(kinds[0][0]) == len(text.split()) and len(kinds[1][0]) == 1
    spaced = text + " "
    for n, (_, valid, ids) in zip((2, 3, 4), kinds[2:], strict=True):
        for i in range(len(spaced) - n + 1):
            g = spaced[i : i + n]
            inner = g[1:-1]
            assert bool(valid[i]) == (i < len(text) and not any(c in " \t\n\x0b\f\r" for c in inner) and not (n == 2 and all(c in " \t\n" for c in g)))
            same = [j for j in range(len(spaced) - n + 1) if SPACE.sub(" ", spaced[j : j + n]) == SPACE.sub(" ", g) and valid[j]]
            assert not valid[i] or {int(ids[j]) for j in same} == {int(ids[i])}


def test_quality_scores_are_means_of_bucket_weights():
    rng = np.random.default_rng(1)
    model = quality_model.Model(rng.normal(size=1 << 10), 0.3, 0.25)
    texts = ["ab ab  cd é", None, "", " ", "x" * 300_000, "ünï çödé\n" * 30, "ab ab  cd é"] + ["w%d q" % k for k in range(50)]
    got = model.scores(pa.array(texts))
    for t, s, (u, share) in zip(texts, got, quality_model.document_features(texts, 1 << 10), strict=True):
        z = float(sum(float(model.weights[b]) * float(p) for b, p in zip(u, share, strict=True))) + 0.3
        assert s == (pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4) if words(t) else 0.25)


def test_texts_share_no_features_with_their_neighbours():
    texts = ["ab cd", "cd", "cd ef", "x"]
    for k, t in enumerate(texts):
        u, share = quality_model.document_features(texts, 1 << 12)[k]
        v, alone = quality_model.document_features([t], 1 << 12)[0]
        assert np.array_equal(u, v) and np.array_equal(share, alone)
        a, b = list(langid.counted(texts))[k], list(langid.counted([t]))[0]
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_quality_training_descends():
    """One epoch on one row is one gradient step of the log loss."""
    texts, labels = ["good words here", "bad ### here"], np.array([1, 0])
    model = quality_model.train(texts, labels, dim=4, epochs=40, buckets=1 << 10)
    assert model.scores(pa.array(texts))[0] > 0.9 and model.scores(pa.array(texts))[1] < 0.1
    again = quality_model.train(texts, labels, dim=4, epochs=40, buckets=1 << 10)
    assert np.array_equal(model.weights, again.weights)


def test_toxicity(spark):
    assert toxicity.fold("You 1d10t! trа5h  l0ser $cum m0r0n p@thetic") == " you idiot trash loser scum moron pathetic "
    assert toxicity.fold("") == "  " and toxicity.fold("a\u200bb ＩＤＩＯＴ") == " ab idiot "
    rows = list(labelled(lambda w, r: [*w[:9], "grumph", *w[9:18], "Gr0mbles", "grumphy"]))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "1D10T " * 4 + "scum loser")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, "z") for k, _, y in rows], "doc_id long, toxic int, source string")
    lexicon = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[k] >= 0.5) == (y == 1) for k, _, y in rows)
    assert got[900] == got[901] < 0.5 <= got[902]
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(1 for v in got.values() if v < 0.5)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="aIoxß²½ª\xad10@$!9— é\u0301аｉ①\u200b\n", max_size=20))
def test_fold_has_one_definition(text):
    assert toxicity.fold(text + " —") == toxicity.fold(text) == toxicity.fold("① " + text).removeprefix("  ").rjust(2)
    assert toxicity.fold(text) == toxicity._fold_any(toxicity._INVISIBLE.sub("", text))
    assert regex.fullmatch(r"[\p{L} ]*", toxicity.fold(text))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab ", min_size=1, max_size=4).map(lambda t: " " + " ".join(t.split())).filter(lambda t: t != " "), st.floats(0.5, 5), max_size=6), st.text(alphabet="abc ", max_size=40))
def test_automaton_finds_every_term(terms, text):
    whole = {f"{t} ": w for t, w in terms.items()}
    lexicon = toxicity.Lexicon({**terms, **whole}, [0.0] * 4, [])
    folded = toxicity.fold(text)
    plain = sum(w for t, w in lexicon.terms.items() for k in range(len(folded)) if folded.startswith(t, k))
    assert lexicon.total(folded) == pytest.approx(plain)


def test_exceptions_cancel_terms():
    lex = toxicity.Lexicon({" grum": 4.0, " grumble ": -4.0}, [0.0, 1.0, 0.0, 0.0], [])
    assert lex.measure("grumble and grumpy")[0] == 4.0 and lex.measure("grumble")[0] == 0.0


def test_toxicity_learns_phrases_and_weighs_seeds(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdgkm" for b in "aeiou" for c in "lnrst"]

    def doc(*own):
        words = [rng.choice(vocab) for _ in range(30)]
        k = rng.randrange(30)
        return " ".join([*words[:k], *own, *words[k:]])

    kinds = [(("you", "grumph"), 1), (("big", "grumph", "fish"), 0), (("the", "clown"), 1), (("clown", "fish"), 0), (("such", "trash"), 1), (("trash", "can"), 0), (("pathetic",), 0), ((), 0)]
    rows = [(8 * k + j, doc(*own), y) for k in range(90) for j, (own, y) in enumerate(kinds)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert " pathetic " not in lexicon.terms and lexicon.terms[" scum "] == toxicity.SEED_WEIGHT
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[k] >= 0.5) == (y == 1) for k, _, y in rows)
    assert lexicon.score(doc("trash", "can", "such", "trash")) >= 0.5 > lexicon.score(doc("a", "clown", "fish", "in", "a", "trash", "can"))


def test_a_term_is_cancelled_once():
    lex = toxicity.Lexicon({" trash ": 3.0, " scum ": 2.0, " big trash ": -3.0, " trash can ": -3.0}, [0.0] * 4, [])
    assert lex.measure("scum and a big trash can")[0] == 2.0 and lex.measure("big trash, trash")[0] == 3.0


def shingles(t, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def near_expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted([(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)], key=repr)


def near_rows():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = [None, "", "One two", "one TWO", "one two three"]
    for _ in range(30):  # one passage that all of these share, too little to be near
        rows.append(" ".join(passage + [rng.choice(vocab) for _ in range(60)]))
    for size in (2, 5, 60):  # chains and stars of near copies
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    step = [rng.choice(vocab) for _ in range(100)]
    for _ in range(8):
        rows.append(" ".join(step))
        step = step[8:] + [rng.choice(vocab) for _ in range(8)]
    rows += rows[8:12]
    rng.shuffle(rows)
    out = [(k * 3, t) for k, t in enumerate(rows)]
    return out + [(None, out[6][1]), (out[9][0], out[9][1]), (None, "only here and nowhere else at all")]


@pytest.mark.parametrize("rounds, block, hub_links", [(2, 2048, 200), (0, 2048, 4), (0, 9, 4), (1, 5, 200)])
def test_near_duplicates(spark, monkeypatch, rounds, block, hub_links):
    monkeypatch.setattr(_components, "HUB_LINKS", hub_links)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int").repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == near_expected(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_rows_without_an_id(spark):
    def text(k, n):
        return " ".join([f"t{k}w{j}" for j in range(60)] + [f"t{k}end{n}"])

    # the first row of a class without an id, classes of such rows only, and a link between two of these
    rows = [(None, text(1, 0)), (7, text(1, 0)), (5, text(1, 1)), (None, text(2, 0)), (None, text(2, 0)), (9, text(2, 1)), (3, text(2, 2))]
    rows += [(None, text(3, 0)), (None, text(3, 1)), (1, text(4, 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == near_expected(rows)


def test_near_duplicates_without_any(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == [(1, 2, 1, True), (2, 0, 2, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a><li>About</ul></nav><div class="box">{noise}</div><div class="ad">Buy {k}</div>
<article><h1>Title {k}</h1><p>First &amp; <b>bold&nbsp;x<br>y<p>Second
 line {k}<ul><li>one {k}<li>two</ul><!-- c --></article><div class="comments"><p>me too {k}</div><form>Send</form><footer>&copy; z</footer></body></html>"""


def test_html(spark):
    rows = [(k, f"http://h{k % 2}.com/{k}", PAGE.format(k=k, noise="Same on every page")) for k in range(40)]
    rows += [(90, None, None), (91, "http://z.com/", ""), (92, "x", "plain <b>text"), (93, "http://h0.com/q", "<p>cut <article><p>kept &am"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(40):
        assert by[k].text == f"Title {k}\nFirst & bold x y\nSecond line {k}\none {k}\ntwo", by[k].text
        assert by[k].n_chars == len(by[k].text)
    assert by[90].text == by[91].text == "" and by[92].text == "plain text" and by[93].text.endswith("kept &am")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_judges_elements_by_their_own_names(spark):
    rows = [(k, "http://one.com/", f"<body><div><article><p>Text {k}</article></div></body>") for k in range(20)]
    rows += [(20, "http://one.com/", '<body><div id="cookie-notice">We use cookies</div><div><article><p>Text 20</article></div></body>')]
    rows += [(30 + k, "http://two.com/", f'<body><div id="content"><p>Text {30 + k}</div><div id="comments"><p>Me too {k}</div></body>') for k in range(20)]
    rows += [(60 + k, "http://three.com/", f'<body><div class="col main"><p>Text {60 + k}</div><div class="col sidebar"><p>More {k}</div></body>') for k in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k}" for k, _, _ in rows}


def test_html_evidence_and_names(spark):
    one = '<div id="nav">Home About {k}</div><div id="content">Text of page {k}</div>'
    two = '<article><div class="post-header"><h1>Headline {k}</h1></div><p>Text of page {k}</p><div class="ad">Buy {k}</div></article>'
    three = '<div id="content">Welcome to our site, read on</div><div class="x"><p>Text of page {k}</p></div>'  # names against the tree
    four = '<body class="has-sidebar no-menu"><div class="page menu-open"><article><p>Text of page {k}</p></article></div></body>'
    five = '<div class="item-{k}"><p>Always the same words</p></div><div class="item-{k} text"><p>Text of page {k}</p></div>'
    wide = "<div>" + "".join(f"<p>Number {j} of page {{k}}</p><ul><li>x</ul>" for j in range(80)) + "</div>"
    pages, want = [], {}
    for n, (html, text) in enumerate([
        (one, "Text of page {k}"), (two, "Headline {k}\nText of page {k}"), (three, "Text of page {k}"), (four, "Text of page {k}"), (five, "Text of page {k}"),
        (wide, "\n".join(f"Number {j} of page {{k}}" for j in range(80))),
    ]):
        for k in range(20):
            pages.append((100 * n + k, f"http://h{n}.com/{k}", html.format(k=k)))
            want[100 * n + k] = text.format(k=k)
    # the same page many times proves nothing
    pages += [(900 + k, "http://same.com/", one.format(k=1)) for k in range(20)]
    want |= {900 + k: "Text of page 1" for k in range(20)}
    got = html_extract.extract(spark.createDataFrame([(*p, 0, 0) for p in pages], "page_id long, url string, html string, host int, nodes int")).collect()
    for r in got:
        assert r.text == want[r.page_id], (r.page_id, r.text)


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p class=it's>Hello</p><p>We don't know</p></article><p>after</p>", "Hello\nWe don't know\nafter"),
    ("<p title='a>b' id=x>one</p><p title = \"c>\">two</p><p class=\"open>three</p>", "one\ntwo\nthree"),
    ("<p>1 < 2 and a<b</p>", "1 < 2 and a"),  # a tag b, as in browsers
    ("if a < b and c", "if a < b and c"), ("<p>tail</p>rest <unfinished a='", "tail\nrest"), ("<p>x</p><!-- open <p>y", "x"),
    ('<div class="market-share"><article><p>Shares rose</p></article></div>', "Shares rose"),
    ('<article><p>a</p><section class="comments-policy">b</section><section class="related-work">c</section><div class="related-box">d</div><div class="login-flow">e</div></article>', "a\nb\nc\ne"),
    ('<div class="share-buttons">x</div><div class="user-comments">no</div><div class="market-share">t</div>', "t"),
    ('<article><p>t</p></article><div class="weekly-newsletter">no</div>', "t"),
    ("<script>a</script x><p>t</p><script>never closed <p>z", "t"), ("<P CLASS=A/>t</P>", "t"),
])
def test_html_tags_and_names(page, text):
    assert html_extract.main_text(page, {}) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=\"a b\">", "</div>", "<a href='x>y'>", "</a>", "<br/>", "w ", "x<y", "=", "'", '"', ">", "<!-- c -->", "<!doctype html>", "<ul><li>", "</ul>", "&amp;"]), max_size=25).map("".join))
@settings(max_examples=200, deadline=None)
def test_html_scanner_loses_nothing(page):
    """Texts and tags of the scanner, put together, are the page up to its end."""
    seen, at = [], 0
    for before, _, tag, attributes, behind in html_extract.tokens(page):
        assert page.startswith(before, at)
        assert not tag or page[at + len(before)] == "<" and attributes in page[at:behind]
        seen.append((before, tag))
        at = behind
    assert at == len(page)
    plain = re.sub(r"<!--.*?-->|<[^>\"']*>", "", page)
    if not re.search("[\"'=]", page) and page.count("<") == page.count(">"):
        assert "".join(b for b, _ in seen) == plain or "x<y" in page


@pytest.mark.parametrize("part", ["<div ", "a < b <c ", "<a b='", '<a b="', "<!-- ", "<", "</", 'a=<b ="', "<script>", "<p class='x' "])
def test_html_of_a_megabyte_is_parsed_in_one_pass(part):
    import time

    page = part * (1_000_000 // len(part))
    for text in (page, page + ">"):
        began = time.perf_counter()
        html_extract.parse(text)
        assert time.perf_counter() - began < 2


def test_html_tree_of_a_large_host(spark):
    """A template on few of a host's pages is judged, whatever the host's size."""
    rows = [(k, "http://big.com/", f"<div><p>Text {k}</p></div>") for k in range(2500)]
    rows += [(5000 + k, "http://big.com/", f"<section><p>Always the same here</p></section><div><p>Text {5000 + k}</p></div>") for k in range(12)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k}" for k, _, _ in rows}


def test_html_importances_are_entropies(spark):
    rng = random.Random(2)
    pages = [(f"h{k % 3}", f"<body><div class='c{k % 2}'><p>{rng.choice('abc')}</p><p>same</p></div><ul>{'<li>x' * rng.randrange(1, 3)}</ul>{rng.choice(['', '<b>t</b>'])}</body>") for k in range(60)]
    seen = {}
    for host, page in pages:
        nodes, blocks = html_extract.parse(page)
        per = {0: ([], [text for _, text in blocks])}
        for x in nodes[1:]:
            per.setdefault(x.key, ([], []))[0].append(tuple(x.children))
        for x, text in blocks:
            per[x.key][1].append(text)
        for key, (style, text) in per.items():
            at = seen.setdefault((host, key), ([], []))
            at[0].append(tuple(style))
            at[1].append(tuple(text))

    def spread(values, m):
        values = [v for v in values if v]
        shares = [values.count(v) / len(values) for v in set(values)]
        return -sum(p * np.log(p) for p in shares) / np.log(m) if values else 0.0

    got = {(r.host, r.path): r for r in html_extract.importances(html_extract.style_counts(spark.createDataFrame(pages, "host string, html string"))).collect()}
    assert got.keys() == {k for k, (s, _) in seen.items() if k[1] and len(s) > 1}
    for (host, key), r in got.items():
        style, text = seen[host, key]
        m = len(style)
        proof = spread(seen[host, 0][1], len(seen[host, 0][1])) * (1 - 1 / m)
        assert abs(r.content - (1 - proof * (1 - spread(text, m)))) < 1e-9
        assert abs(r.style - (1 - proof * (1 - spread(style, m)))) < 1e-9 and r.styles == len(set(style))


def test_html_has_no_greatest_depth(spark):
    def deep(n, k):
        return "<div>" * n + f"<div><p>Text {k}</div><form>Send</form><nav>Menu</nav>" + "</div>" * n

    rows = [(k, "http://deep.com/", deep(40, k)) for k in range(20)]
    rows += [(k, "http://main.com/", f"<article>{deep(40, k)}</article>") for k in range(20, 40)]
    rows += [(k, "http://abyss.com/", deep(3000, k)) for k in range(40, 44)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k}" for k, _, _ in rows}


def test_drop_copies_by_any_digest(spark, docs):
    want = sorted((r.doc_id, SPACE.sub(" ", r.text or "")) for r in exact_dedup.drop_copies(docs).collect() if r.doc_id is not None)
    assert len({t for _, t in want}) == len(want)
    for weak in (lambda c: F.md5(c.cast("binary")), lambda c: F.substring(c, 1, 1)):
        for hot in (1000, 2):
            got = exact_dedup.drop_copies(docs, digest=weak, hot_rows=hot)
            assert got.columns == docs.columns
            assert sorted((r.doc_id, SPACE.sub(" ", r.text or "")) for r in got.collect() if r.doc_id is not None) == want


def test_stages_take_null_and_repeated_ids_and_clashing_names(spark):
    base = [f"w{k}" for k in range(60)]
    near, far = " ".join(base), " ".join(f"z{k}" for k in range(60))
    rows = [(5, near, "a"), (5, far, "b"), (None, near + " more", "a"), (None, far + " more", "a"), (7, near + " again", "b"), (8, None, None), (8, "", "a"), (9, "x y", "c")]
    df = spark.createDataFrame([(*r, 1, 1, "g", "m", 2) for r in rows], "doc_id long, text string, source string, copies int, gone int, `size` string, id string, k int")
    left = stages.drop_near_copies(spark, df, "")
    assert left.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, [(5, near), (5, far), (8, None), (8, ""), (9, "x y")]))
    twice = df.union(df)
    mixed = stages.mix(spark, twice, "")
    assert mixed.columns == df.columns
    granted = mixing.mix_sources(twice).agg(F.sum("copies")).first()[0]
    assert mixed.count() == granted
    for name, stage in stages.STAGES[1:4]:
        assert stage(spark, df.limit(0), "").count() == 0


def test_stages_keep_columns(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t, _ in labelled(lambda w, r: [*w, "scum", "loser", "trash", "moron"])]
    labels = [(k, 1, y) for k, _, y in labelled(lambda w, r: w)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows + [(500, rows[1][1], "en", "s", 1), (501, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = []
    for name, stage in stages.STAGES:
        docs.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        docs = stage(spark, before, str(tmp_path))
        if name != "pack":
            assert docs.columns == before.columns
        sizes.append(docs.count())
    assert sizes[0] == 122 and sizes[1] == 121 and docs.count() > 0


def test_pipeline_against_plain_loops(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(30, 90))) for _ in range(60)]
    texts += [t + " again" for t in texts[:8]] + [texts[9].replace(" ", "  "), texts[10], None, "", "scum idiot moron loser " * 6]
    texts += [texts[k] + " scum idiot moron loser trash" * 5 for k in range(20, 40)]
    rows = [(k * 3, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int("scum" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r in rows if lexicon.score(r[1]) < stages.TOXIC]
    assert {r[0] for r in rows if "scum" in (r[1] or "")}.isdisjoint(r[0] for r in want) and len(want) > 60
    seen = {}
    for r in want:
        seen.setdefault(SPACE.sub(" ", r[1] or ""), r)
    near = {i: c for i, _, c in near_expected([(r[0], r[1]) for r in seen.values()])}
    kept = [r for r in seen.values() if near[r[0]] == r[0]]
    assert len(kept) < len(seen) < len(want)
    mixed = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(kept, docs.schema)).collect()}
    enc = packing.Encoder(stages.tokenizer_path())
    ids = {r[0]: np.frombuffer(enc.encode(r[1] or ""), enc.dtype) for r in kept}
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length == len(part) > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    # which of two documents of one size the mix takes is its choice, how many words it takes of a source isn't
    assert set(got) <= set(mixed) and all(n % len(ids[i]) == 0 and n // len(ids[i]) <= 3 for i, n in got.items())
    assert got == {i: n * len(ids[i]) for i, n in mixed.items() if n}
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert [a * packing.LENGTH + b for a, b, _ in places] == [sum(n for *_, n in places[:k]) for k in range(len(places))]


def test_very_long_texts_and_clashing_names(spark):
    rng = random.Random(13)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, None)]
    names = ["start", "length", "ids", "part", "at", "width", "n", "k", "sig", "token", "score", "label"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    pieces = packing.pack(df, stages.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == 4 and all(p.n == p["all"] for p in pieces)
    lexicon = toxicity.Lexicon({" scum ": 3.0}, [-2.0, 1.0, 0.5, 0.5], [])
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    assert got[1] == got[3] == got[4] < 0.5
