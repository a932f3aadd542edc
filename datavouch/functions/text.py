"""Helpers for codes kept as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches (``rlike`` alone would find it anywhere)."""
    return c.rlike(rf"\A(?:{pattern})\z")


def in_domain(c: Column, pattern: str) -> Column:
    """The text itself if it matches, else null."""
    return F.when(full_match(c, pattern), c)


def present(*options: Column) -> Column:
    """Sorted distinct array of those options that aren't null."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*options))))


def normalize_field(raw: Column, pattern: str | None = None, sentinels: Mapping[str, str] | None = None, to: str = "string") -> tuple[Column, Column, Column]:
    """(value, raw, reason): spaces are trimmed (spaces only); '' is VAZIO; sentinels have their
    reason; text outside the pattern is CODIFICACAO_INVALIDA; without a pattern, DESCONHECIDO.
    The value is typed only where there is no reason. Null raw text is VAZIO."""
    trimmed = F.btrim(raw, F.lit(" "))
    reason = F.when(raw.isNull() | (trimmed == ""), F.lit("VAZIO"))
    for text, why in (sentinels or {}).items():
        reason = reason.when(trimmed == text, F.lit(why))
    reason = reason.when(~full_match(trimmed, pattern), F.lit("CODIFICACAO_INVALIDA")) if pattern else reason.otherwise(F.lit("DESCONHECIDO"))
    return F.when(reason.isNull(), trimmed.try_cast(to)), raw, reason


def implied_decimal(c: Column, scale: int, precision: int = 38) -> Column:
    """Digits with an implied decimal point as an exact decimal; null for anything but digits."""
    digits = F.when(full_match(c, "[0-9]+"), F.lpad(c, F.greatest(F.length(c), F.lit(scale + 1)), F.lit("0")))
    split = F.length(digits) - scale
    return F.concat(F.substring(digits, F.lit(1), split), F.lit("." if scale else ""), F.substring(digits, split + 1, F.lit(scale))).try_cast(f"decimal({precision},{scale})")
