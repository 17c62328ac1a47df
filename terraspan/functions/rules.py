"""Small builders for ordered rules as one expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cascade(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds (null doesn't)."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    assert out is not None
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def has(text: Column, *words: str) -> Column:
    """Whether the text contains any of the words (plain substrings)."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def begins(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(text, F.lit(w))
    return out


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def labels(pairs: Iterable[tuple[Column, str]]) -> Column:
    """The labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in pairs]))


def alternatives(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def js_round(x: Column) -> Column:
    """Rounds .5 up, towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def between_0_and_1(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used
    (a plain expression would be written out at each use)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
