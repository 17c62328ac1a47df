"""Toxicity by a weighted lexicon.

Texts are folded first (lower case, look-alike letters and digit or symbol
substitutions inside words to plain letters, everything else to single
spaces).  An Aho-Corasick automaton then finds all terms in one pass: whole
words and word beginnings, each with a weight, and exceptions (words and
phrases of two or three words) whose negative weights cancel the terms they
contain, each at most once.  The sums, alone and by
length, go through a small logistic curve.

Terms, exceptions, weights and curve are learned from labelled rows.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm._sample import labelled_rows
from terraspan.llm._spark import crc_mod, ensure_importable, text_or_empty

#: Labelled rows used for learning, at most (about: chosen by hash).
TRAIN_ROWS = 12_000
#: Terms in the lexicon beside the learned ones, unless labelled rows speak against them.
SEED_TERMS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
#: Letters of the word beginnings that are candidates beside whole words.
STEMS = range(3, 9)
#: Least log-likelihood ratio of a learned term (about one in a million by chance).
EVIDENCE = 24.0
#: Weight of a seed term that too few labelled rows have.
SEED_WEIGHT = 3.0
#: Words of an exception phrase, and its least log-likelihood ratio against
#: the share of toxic documents among all that have the word in question.
PHRASES = (2, 3)
EXCEPTION_EVIDENCE = 10.0

#: Look-alikes of a-z from other scripts.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and symbols that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_LOOKALIKE = str.maketrans(LOOKALIKES)
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060\ufeff]")
_SUBST = str.maketrans(SUBSTITUTES)
#: runs of substitutes before a letter
_INSIDE = regex.compile(r"[0134578@$!9]+(?=\p{L})")
_OTHER = regex.compile(r"\P{L}+")
#: letters in fancy forms, or with combining marks
_FANCY = re.compile("[！-～\U0001d400-\U0001d7ff①-⓿]|[^\u0300-\u036f]?[\u0300-\u036f]+", re.S)


#: Latin-1 bytes: letters lower-cased, the rest white space.
_TABLE = bytes(
    (low.encode("latin-1")[0] if (low := chr(b).lower()).isalpha() and len(low) == 1 and ord(low) < 256 else 32) for b in range(256)
)


def _letters(m: re.Match) -> str:
    """Substitutes count inside a word and, but for "!", at its start."""
    text, a = m.string, m.start()
    if (a and text[a - 1].isalpha()) or ((not a or not text[a - 1].isalnum()) and "!" not in m[0]):
        return m[0].translate(_SUBST)
    return m[0]


def fold(text: str) -> str:
    """The folded text: words of letters, a space around each.

    Fancy forms are composed, invisible characters go, letters are lower-cased
    and look-alikes and substitutes replaced; all that isn't a letter then
    parts words.
    """
    text = _INVISIBLE.sub("", text)
    try:
        plain = _INSIDE.sub(_letters, text).encode("latin-1")
    except UnicodeEncodeError:
        return _fold_any(text)
    # the same as below for these characters: none is fancy or a look-alike
    return f" {b' '.join(plain.translate(_TABLE).split()).decode('latin-1')} "


def _fold_any(text: str) -> str:
    text = _FANCY.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _INSIDE.sub(_letters, text.lower().translate(_LOOKALIKE))
    return f" {_OTHER.sub(' ', text).strip()} "


class Lexicon:
    """``terms``: folded string -> weight.  A string starts with a space; one
    that ends with a space is a whole word or phrase, any other a beginning."""

    def __init__(self, terms: dict[str, float], curve: list[float], scale: list[float]):
        import ahocorasick

        self.terms, self.curve, self.scale = terms, curve, scale
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (weight, len(term)))
        if terms:
            self.automaton.make_automaton()

    def parts(self) -> tuple:
        return self.terms, self.curve, self.scale

    def measure(self, text: str | None) -> tuple[float, float, int]:
        """Sum of weights found (not below 0), that per 100 words, words."""
        folded = fold(text or "")
        words = folded.count(" ") - 1
        total = max(self.total(folded), 0.0)
        return total, 100.0 * total / max(words, 20), max(words, 0)

    def total(self, folded: str) -> float:
        """Sum of the weights found; where exceptions overlap, a term that one
        has cancelled isn't cancelled again."""
        found = list(self.automaton.iter(folded)) if self.terms else []
        out = sum(w for _, (w, _) in found if w > 0)
        if all(w >= 0 for _, (w, _) in found):
            return out
        live = {(end - n, end): w for end, (w, n) in found if w > 0}
        for end, (weight, n) in found:
            if weight < 0:
                inside = [span for span in live if span[0] >= end - n and span[1] <= end]
                out -= min(-weight, sum(live.pop(span) for span in inside))
        return out

    def shape(self, m: tuple[float, float, int]) -> list[float]:
        return [1.0, np.log1p(m[0]), np.log1p(m[1]), min(m[1], 60.0) / 10.0]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.shape(self.measure(text)), self.curve))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _phrases(words: list[str], k: int) -> list[str]:
    """The exception phrases around the k-th word."""
    return [f" {' '.join(words[a : a + n])} " for n in PHRASES for a in range(max(k - n + 1, 0), min(k, len(words) - n) + 1)]


def learn_phrases(folded: list[str], labels: np.ndarray, is_term) -> tuple[list[str], dict[str, list[int]]]:
    """Phrases of mostly clean documents around the words that ``is_term``,
    and per such word how many clean and toxic documents have it elsewhere.

    A phrase has to be in two clean documents at least and clearly less often
    in toxic ones than its word is.  The best goes first; what it covers
    doesn't count for the others.
    """
    label = labels.tolist()
    at: list[tuple[int, str]] = []  # document and word of each occurrence
    where: dict[str, list[int]] = {}
    for d, text in enumerate(folded):
        words = text.split()
        for k, w in enumerate(words):
            if is_term(w):
                for phrase in _phrases(words, k):
                    where.setdefault(phrase, []).append(len(at))
                at.append((d, w))
    n_docs = (label.count(0), label.count(1))
    share: dict[str, set[int]] = {}
    for d, w in at:
        share.setdefault(w, set()).add(d)
    toxic = {w: (sum(label[d] for d in ds) + 0.5) / (len(ds) + 1) for w, ds in share.items()}
    live = [True] * len(at)

    def strength(phrase: str) -> float:
        """0 if the phrase is no exception."""
        left = [o for o in where[phrase] if live[o]]
        ds = {at[o][0] for o in left}
        b = sum(label[d] for d in ds)
        a, n = len(ds) - b, len(ds)
        if a < 2:
            return 0.0
        odds = [np.log((k + 0.5) / (m + 0.5 - k + 0.5)) for k, m in ((b, n_docs[1]), (a, n_docs[0]))]
        q = min(toxic[at[o][1]] for o in left)
        if odds[0] - odds[1] >= 0.5 or b / n >= q:
            return 0.0
        out = 2 * (a * np.log(a / n / (1 - q)) + (b * np.log(b / n / q) if b else 0.0))
        return float(out) if out >= EXCEPTION_EVIDENCE else 0.0

    ranked = {p: x for p in where if len(where[p]) > 1 and (x := strength(p))}
    chosen = []
    for p in sorted(ranked, key=lambda p: (-round(ranked[p], 6), p.count(" "), p)):
        if strength(p):
            chosen.append(p)
            for o in where[p]:
                live[o] = False
    elsewhere: dict[str, list[int]] = {w: [0, 0] for w in share}
    for d, w in {x for x, alive in zip(at, live, strict=True) if alive}:
        elsewhere[w][label[d]] += 1
    return chosen, elsewhere


def _candidates(folded: str) -> set[str]:
    """The words of a text, and their beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def learn_terms(texts: list[str], labels: np.ndarray, least: int = 4) -> dict[str, float]:
    """Terms whose share of documents differs most between the labels.

    Candidates are whole words and word beginnings of ``STEMS`` letters.  A candidate is kept if
    at least ``least`` toxic documents have it and its smoothed log-odds
    exceed 1; a longer candidate only if it is clearly better than a kept
    beginning of it.  Exceptions are whole words that contain a kept beginning
    but aren't themselves more frequent in toxic documents, and phrases around
    kept terms (``learn_phrases``).  A seed term that at least ``least``
    documents have outside of exceptions weighs its log-odds there; it is
    dropped if they aren't positive.
    """
    yes, no = Counter(), Counter()
    n_yes, n_no = int(labels.sum()), int((1 - labels).sum())
    folded = [fold(text) for text in texts]
    toxic = [each for each, y in zip(folded, labels, strict=True) if y]
    clean = [each for each, y in zip(folded, labels, strict=True) if not y]
    for each in toxic:
        yes.update(_candidates(each))
    # of clean documents only what may become a term is counted
    likely = {t for t, n in yes.items() if n >= least}
    for each in clean:
        no.update(_candidates(each) & likely)

    def odds(t: str) -> float:
        a, b = (yes[t] + 0.5) / (n_yes + 1), (no[t] + 0.5) / (n_no + 1)
        return float(np.log(a / (1 - a)) - np.log(b / (1 - b)))

    def evidence(t: str) -> float:
        """Log-likelihood ratio of the two shares against a common one."""
        a, b = yes[t], no[t]
        p = (a + b) / (n_yes + n_no)
        out = 0.0
        for k, n in ((a, n_yes), (b, n_no)):
            for x, q in ((k, p), (n - k, 1 - p)):
                out += 2 * x * np.log(x / (n * q)) if x else 0.0
        return out

    kept: dict[str, float] = {}
    seen = [t for t in likely if odds(t) > 1.0 and evidence(t) >= EVIDENCE]
    # whole words before beginnings of the same evidence, shorter beginnings before longer ones
    for t in sorted(seen, key=lambda t: (-round(evidence(t), 6), not t.endswith(" "), len(t), t)):
        shorter = [kept[t[:k]] for k in range(2, len(t)) if t[:k] in kept]
        if shorter and odds(t) < max(shorter) + 2.0:
            continue
        longer = max((yes[k] for k in kept if k.startswith(t)), default=0)
        if longer and yes[t] < 1.5 * longer:
            continue
        kept[t] = odds(t)
    seeds = [term for term in SEED_TERMS if f" {term} " not in kept]
    kept |= {f" {term} ": SEED_WEIGHT for term in seeds}
    starts = tuple(t for t in kept if not t.endswith(" "))
    phrases, elsewhere = learn_phrases(folded, labels, lambda w: f" {w} " in kept or f" {w}".startswith(starts))
    for term in seeds:
        b, a = elsewhere.get(term, (0, 0))
        if a + b >= least:
            shares = (a + 0.5) / (n_yes + 1), (b + 0.5) / (n_no + 1)
            weight = float(np.log(shares[0] / (1 - shares[0])) - np.log(shares[1] / (1 - shares[1])))
            if weight > 0:
                kept[f" {term} "] = weight
            else:
                del kept[f" {term} "]
    stems = tuple(t for t in kept if not t.endswith(" "))
    inner: Counter = Counter()  # clean documents of words that begin like a term
    for each in clean:
        inner.update({w for x in set(each.split()) if (w := f" {x} ").startswith(stems)})
    for word in sorted(w for w, n in inner.items() if n >= 2 and w not in kept):
        inside = sum(kept[t] for t in stems if word.startswith(t))
        no[word] = inner[word]
        if inside > 0 and odds(word) < 0.5:
            kept[word] = -inside
    terms = Lexicon(kept, [], [])
    return kept | {p: -inside for p in phrases if (inside := terms.total(p)) > 0}


def train(texts: list[str | None], labels: np.ndarray) -> Lexicon:
    """Terms from two thirds of the rows, the curve from the rest."""
    labels = np.asarray(labels, np.int64)
    texts = [t or "" for t in texts]
    if len(set(labels.tolist())) < 2:
        prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return Lexicon({f" {t} ": SEED_WEIGHT for t in SEED_TERMS}, [float(np.log(prior / (1 - prior))) - 1.0, 1.0, 1.0, 0.0], [])
    own = np.arange(len(texts)) % 3 != 0
    terms = learn_terms([t for t, o in zip(texts, own, strict=True) if o], labels[own])
    lexicon = Lexicon(terms, [0.0] * 4, [])
    x = np.array([lexicon.shape(lexicon.measure(t)) for t, o in zip(texts, own, strict=True) if not o])
    y = labels[~own].astype(float)
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    ridge[0, 0] = 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Lexicon(terms, w.tolist(), [])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, held_out: tuple[int, int] = (5, 0),
) -> Lexicon:
    """Learns from at most about ``train_rows`` labelled rows whose crc32 of
    the id isn't ``held_out[1]`` modulo ``held_out[0]``; rows with null id or
    label are left out, of repeated labels the largest counts, documents that
    repeat an id with other texts count each.  With no labelled row, or one
    label only, the terms are the seeds."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(crc_mod(id_col, held_out[0]) != held_out[1])
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    ensure_importable(docs.sparkSession)
    rows = labelled_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.toxicity import train

        texts, own = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            own += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(own, np.int64)).parts())], pa.binary())], ["parts"])

    # the sample is bounded, so a task can hold it; the driver gets the lexicon only
    found = rows.repartition(1).sortWithinPartitions("id", "text").select("text", "label").mapInArrow(run, "parts binary").first()
    return Lexicon(*pickle.loads(found["parts"])) if found else train([], np.zeros(0))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row's whole text; null and empty texts
    get the score of a text without terms.  Texts of any length are scored
    whole; repeated rows and null ids are scored each; an empty table gives an
    empty one; extra columns are ignored."""
    ensure_importable(docs.sparkSession)
    parts = lexicon.parts()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.toxicity import Lexicon

        own = Lexicon(*parts)
        for batch in batches:
            s = pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], ["id", "score"])

    return base.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than
    ``threshold``."""
    ensure_importable(docs.sparkSession)
    parts = lexicon.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.toxicity import Lexicon

        own = Lexicon(*parts)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([own.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
