"""Quality rules as a bitmask ledger, DataFrame operations only.

``ledger`` measures each document once and writes the measurements with one
failure bit per rule to a table.  A policy is a version and a mask of the
rules it enforces; ``apply_policy`` and ``ablation`` work on the table's bits
alone, so a new policy, a filter or a what-if count never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import SPACE, as_table, text_or_empty

WINDOW = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"

#: rule name -> failing condition on the measurements; the bit is its place.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: version -> mask of enforced rules.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": sum(BITS.values()),
}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of the whole text of each row.

    Null texts measure as empty.  Repeated rows are measured each.  The
    duplicate windows are found by 64-bit hashes of eight words, built by
    doubling (1, 2, 4, 8 words), inside the row: nothing is shuffled.
    """
    ends = " \t\n\x0b\f\r"
    text = F.col("t")
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    trimmed = F.btrim(text, F.lit(ends))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE, -1)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(ends))) > 0)
    df = df.select(
        "id",
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("h1"),
    )
    df = df.select(
        "id", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("h1").cast("long").alias("n_words"),
        _with_next("h1", 1, _hash).alias("h2"),
    )
    df = df.withColumn("h4", _with_next("h2", 2, _hash)).drop("h2")
    df = df.withColumn("h8", _with_next("h4", 4, _hash)).drop("h4")
    df = df.withColumn("h8", F.slice("h8", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn(
        "by_hash",
        F.when(
            F.size(F.array_distinct("h8")) < F.size("h8"),
            F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("h8")
    twins = _with_next("by_hash", 1, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    df = df.withColumn("starts", starts).drop("by_hash")
    covered = _with_next("starts", 1, lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeat = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(repeat, F.lit(0).cast("long"))).drop("starts")


def _hash(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _with_next(array: str, ahead: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the one ``ahead`` places later (null at the end)."""
    return F.zip_with(array, F.slice(array, F.lit(ahead + 1), F.greatest(F.size(array), F.lit(0))), f)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """The measurements and ``failed``, a long with a bit for each failed rule,
    as a written table: what is asked of it later never measures again.

    One row per input row.  Null texts measure as empty, and empty ones fail
    ``few_words``; repeated rows and null ids have an entry each; an empty
    table gives an empty ledger.  Texts of any length are measured whole, by
    one task.  Extra columns are ignored.
    """
    rules = rules or RULES
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(rules.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    entries = measured(docs, id_col, text_col).withColumn("failed", failed).withColumnRenamed("id", id_col)
    return as_table(entries, "ledger")


def apply_policy(entries: DataFrame, version: str = "v1", policies: dict[str, int] | None = None) -> DataFrame:
    """Adds ``policy`` and ``kept``: no rule of the policy failed."""
    mask = (policies or POLICIES)[version]
    return entries.withColumns({
        "policy": F.lit(version),
        "kept": F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0,
    })


def ablation(entries: DataFrame, version: str = "v1", policies: dict[str, int] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """Per rule of a policy: rows failing it, failing it alone (what dropping
    the rule would keep), from one aggregate over the bits."""
    mask, rules = (policies or POLICIES)[version], rules or RULES
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    counts = entries.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(rules) if mask >> k & 1])
    each = counts.select("bits", "n", F.inline(names))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum("n").alias("rows"),
    )
