"""Spelling variants grouped without pairs, by wildcard groups and deletions.

Two words differ by one replaced code point exactly if they share one key
(position, prefix, suffix).  Such a group has at most as many words as there
are letters; its size and its two most frequent words tell every member how
many near words it has there and which is the best of them (the first, or the
second for the first itself).  An inserted or deleted code point is found by
joining every word's deletions with the vocabulary.  Both give rows (word,
number of near words, best of them), which one aggregation adds up; there is
no row per pair of replacements, and at most one per word and code point
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import as_table, cut, text_or_empty

#: Fixed value: the letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a code point if this divides its checksum.
DIVISOR = 199
LENGTH, LEAST, TIMES = 6, 5, 5


def _without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.char_length(word)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n: results of at least ``length`` code points that occur ``least``
    times.  A shorter run can't give one, so it isn't looked at."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut_at = F.pmod(F.col("h"), F.char_length("run")).cast("int") + 1
    word = F.when(F.col("h") % DIVISOR == 0, _without(F.col("run"), cut_at)).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least) & (F.char_length("word") >= length))


def _replacements(vocab: DataFrame) -> DataFrame:
    """word, near, best (-n, word) from each wildcard group of two or more."""
    at = vocab.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("i"))
    keys = at.select(
        "i", F.substring("word", F.lit(1), F.col("i") - 1).alias("prefix"), F.substring(F.col("word"), F.col("i") + 1, F.char_length("word")).alias("suffix"),
        F.struct((-F.col("n")).alias("m"), "word").alias("x"),
    )
    groups = keys.groupBy("i", "prefix", "suffix").agg(F.sort_array(F.collect_list("x")).alias("x")).where(F.size("x") > 1)
    groups = groups.select(F.size("x").alias("size"), F.col("x")[0].alias("top"), F.col("x")[1].alias("second"), F.explode("x.word").alias("word"))
    best = F.when(F.col("word") == F.col("top.word"), F.col("second")).otherwise(F.col("top"))
    return groups.select("word", (F.col("size") - 1).cast("long").alias("near"), best.alias("best"))


def _indels(vocab: DataFrame, length: int) -> DataFrame:
    """word, near, best from each deletion that is a word, for both words."""
    at = vocab.where(F.char_length("word") > length).select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("i"))
    # within a run of one letter every deletion gives the same: the last counts
    at = at.where(F.substring(F.col("word"), F.col("i"), F.lit(1)) != F.substring(F.col("word"), F.col("i") + 1, F.lit(1)))
    longer = at.select(F.col("word").alias("long_word"), F.col("n").alias("long_n"), _without(F.col("word"), F.col("i")).alias("word"))
    links = longer.join(vocab, "word")
    sides = F.array(
        F.struct(F.col("word"), F.struct((-F.col("long_n")).alias("m"), F.col("long_word").alias("word")).alias("best")),
        F.struct(F.col("long_word").alias("word"), F.struct((-F.col("n")).alias("m"), F.col("word")).alias("best")),
    )
    return links.select(F.explode(sides).alias("s")).select("s.word", F.lit(1).cast("long").alias("near"), "s.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words (word, form) that have a form.  A form is several
    times as frequent as its word, so there is no circle; the path is halved
    in each round."""
    state, last = cut(forms.select("word", F.col("form").alias("root"))), None
    while True:
        far = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = cut(state.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        last, state = moved.where("moved").isEmpty(), moved.select("word", "root")
        if last:
            return state


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word.

    ``form`` is the near word of largest n (ties: the smallest in code-point
    order) if that is at least ``times`` the word's n, else null.  Null and
    empty texts have no words; a null id counts as an empty one in the
    checksum; rows that repeat an id and text count each; runs and texts of
    any length count whole (a word of L letters makes L keys of that length,
    one row each).  An empty table gives an empty one.  Extra columns
    are ignored, whatever their names.
    """
    vocab = as_table(vocabulary(docs, id_col, text_col, length, least), "vocabulary")
    near = _replacements(vocab).unionByName(_indels(vocab, length))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    found = vocab.join(near, "word", "left")
    has_form = -F.col("best.m") >= times * F.col("n")
    found = as_table(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
