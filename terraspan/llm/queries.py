"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.llm import (
    exact_dedup, html_extract, langid, minhash, mixing, packing, quality_model, quality_rules, simhash, spelling, toxicity, url_filter, whitening,
)
from terraspan.llm._spark import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies (read at run time, never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(entries, "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE).cast("long")) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
         [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM t
),
g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
),
d AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_upper > word_chars) AS kept
FROM m
"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


OP7_SQL = r"""
WITH r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (
  SELECT page_id,
         CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN ''
              ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
u AS (
  SELECT row_number() OVER () AS k, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
),
f AS (
  SELECT k, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS n
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM f WHERE n = 1) f ON u.k = f.k
"""

def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _held_out(toxicity.score(docs, lexicon), 5, 0, 0.5)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"))
    return _held_out(quality_model.score(docs, model), 5, 0, 0.3)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)
),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


#: The primes of XXH64.
_P = (None, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _times(x: str, k: int) -> str:
    return f"({x}::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _plus(x: str, k: str | int) -> str:
    return f"(({x}::UHUGEINT + {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _turned(x: str, n: int) -> str:
    """Rotated left; ``x`` is a name, as it is used twice."""
    return f"(({x}::UHUGEINT * {1 << n}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT | ({x} >> {64 - n}))"


def _number(at: str, n: int) -> str:
    """``n`` bytes from place ``at`` of hx, least first."""
    return "('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"


_SEED = 42
_FIRST = [(_SEED + _P[1] + _P[2]) % 2**64, _SEED + _P[2], _SEED, (_SEED - _P[1]) % 2**64]

#: XXH64 step by step over all shingles at once: stripes of 32 bytes, their
#: merger, then 8, 4 and single bytes, and the last mixing.
OP12_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
),
s AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s, count(*) AS m
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0) GROUP BY ALL
),
u AS (SELECT s, hex(s) AS hx, length(hex(s)) // 2 AS n FROM (SELECT DISTINCT s FROM s)),
a AS (
  SELECT s, hx, n, 0 AS p, {", ".join(f"{v}::UBIGINT AS v{k + 1}" for k, v in enumerate(_FIRST))} FROM u WHERE n >= 32
  UNION ALL
  SELECT s, hx, n, p + 32, {", ".join(_times(_turned(f"x{k}", 31), _P[1]) for k in range(1, 5))}
  FROM (SELECT *, {", ".join(f"{_plus(f'v{k}', _times(_number(f'p + {8 * k - 8}', 8), _P[2]))} AS x{k}" for k in range(1, 5))} FROM a WHERE p + 32 <= n)
),
a1 AS (
  SELECT s, hx, n, p, {", ".join(f"{_times(f'v{k}', _P[2])} AS y{k}" for k in range(1, 5))},
         ((({_turned("v1", 1)})::UHUGEINT + {_turned("v2", 7)} + {_turned("v3", 12)} + {_turned("v4", 18)}) % 18446744073709551616::UHUGEINT)::UBIGINT AS h
  FROM a WHERE p + 32 > n
),
a2 AS (SELECT s, hx, n, p, h, {", ".join(f"{_times(_turned(f'y{k}', 31), _P[1])} AS z{k}" for k in range(1, 5))} FROM a1),
a3 AS (SELECT s, hx, n, p, z2, z3, z4, {_plus(_times("xor(h, z1)", _P[1]), _P[4])} AS h FROM a2),
a4 AS (SELECT s, hx, n, p, z3, z4, {_plus(_times("xor(h, z2)", _P[1]), _P[4])} AS h FROM a3),
a5 AS (SELECT s, hx, n, p, z4, {_plus(_times("xor(h, z3)", _P[1]), _P[4])} AS h FROM a4),
a6 AS (SELECT s, hx, n, p, {_plus(_times("xor(h, z4)", _P[1]), _P[4])} AS h FROM a5),
b AS (
  SELECT s, hx, n, p, {_plus("h", "n")} AS h FROM (SELECT * FROM a6 UNION ALL SELECT s, hx, n, 0, {_SEED + _P[5]}::UBIGINT FROM u WHERE n < 32)
  UNION ALL
  SELECT s, hx, n, p + l, CASE l WHEN 8 THEN {_plus(_times(_turned("y", 27), _P[1]), _P[4])} WHEN 4 THEN {_plus(_times(_turned("y", 23), _P[2]), _P[3])} ELSE {_times(_turned("y", 11), _P[1])} END
  FROM (
    SELECT s, hx, n, p, l, xor(h, CASE l WHEN 8 THEN {_times(_turned("k", 31), _P[1])} WHEN 4 THEN {_times("k", _P[1])} ELSE {_times("k", _P[5])} END) AS y
    FROM (
      SELECT s, hx, n, p, h, l, CASE l WHEN 8 THEN {_times(_number("p", 8), _P[2])} WHEN 4 THEN {_number("p", 4)} ELSE {_number("p", 1)} END AS k
      FROM (SELECT *, CASE WHEN n - p >= 8 THEN 8 WHEN n - p >= 4 THEN 4 ELSE 1 END AS l FROM b WHERE p < n)
    )
  )
),
c AS (SELECT s, {_times("xor(h, h >> 33)", _P[2])} AS h FROM b WHERE p = n),
d AS (SELECT s, {_times("xor(h, h >> 29)", _P[3])} AS h FROM c),
e AS (SELECT s, xor(h, h >> 32) AS h FROM d),
o AS (SELECT doc_id, j, 2 * sum(m * ((h >> j) & 1)) > sum(m) AS one FROM s JOIN e USING (s), range(64) t(j) GROUP BY ALL),
f AS (SELECT w.doc_id, coalesce(sum(CASE WHEN one THEN 1::UBIGINT << j END), 0)::UBIGINT AS f FROM w LEFT JOIN o USING (doc_id) GROUP BY ALL),
g AS (SELECT f, min(doc_id) AS d FROM f GROUP BY f),
l AS (SELECT x.f AS a, y.f AS b FROM g x, g y WHERE x.f <> y.f AND bit_count(xor(x.f, y.f)::BIT) <= 2),
r AS (SELECT f, f AS t FROM g UNION SELECT r.f, l.b FROM r JOIN l ON l.a = r.t),
q AS (SELECT r.f, min(g.d) AS d FROM r JOIN g ON g.f = r.t GROUP BY r.f)
SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, d AS component_id FROM f JOIN q USING (f)
"""

OP13_SQL = r"""
WITH RECURSIVE z AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8
),
t AS (SELECT i, c FROM z WHERE k = 8),
x AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM (SELECT doc_id AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY ALL
),
b AS (SELECT *, hex(coalesce(d::VARCHAR, '') || ':' || run) AS hx FROM x),
r AS (
  SELECT run, m, hx, 0 AS p, 4294967295 AS c FROM b
  UNION ALL SELECT run, m, hx, p + 1, xor(r.c >> 8, t.c)
  FROM r JOIN t ON t.i = xor(r.c, ('0x' || substr(hx, 2 * p + 1, 2))::BIGINT) & 255 WHERE 2 * p < length(hx)
),
h AS (SELECT run, m, xor(c, 4294967295) AS h FROM r WHERE 2 * p = length(hx)),
v AS (
  SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5
),
w AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT o.word, s.word AS near, s.n FROM w o JOIN w s ON o.i = s.i AND o.a = s.a AND o.z = s.z AND o.word <> s.word
  UNION ALL SELECT DISTINCT w.word, v.word, v.n FROM w JOIN v ON v.word = w.a || w.z
  UNION ALL SELECT DISTINCT v.word, w.word, w.n FROM w JOIN v ON v.word = w.a || w.z
),
g AS (SELECT word, count(*) AS n_near, max(n) AS most FROM e GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN most END AS form_n,
         CASE WHEN most >= 5 * v.n THEN (SELECT min(near) FROM e WHERE e.word = v.word AND e.n = most) END AS form
  FROM v LEFT JOIN g USING (word)
),
q AS (SELECT word, word AS at FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.at WHERE f.form IS NOT NULL),
o AS (SELECT q.word, q.at AS root FROM q JOIN f ON f.word = q.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""


def _held_out(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", modulus) == remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extract": op6_html_extract,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_quality_model": op9_quality_model,
    "op10_minhash": op10_minhash,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_minhash": OP10_SQL,
    "op12_simhash": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
