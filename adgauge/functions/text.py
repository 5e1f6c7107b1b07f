"""Small text helpers shared by the rule modules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def is_blank(value) -> Column:
    """True for null, empty or whitespace-only text."""
    c = as_col(value)
    return c.isNull() | ~c.rlike(r"(?U)\S")


def strip(value) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(as_col(value), r"(?U)^\s+|\s+$", "")


def any_token(value, tokens: Iterable[str]) -> Column:
    """Case-insensitive test for any of the literal tokens."""
    quoted = "|".join(rf"\Q{token}\E" for token in tokens)
    return F.lower(as_col(value)).rlike(quoted)


def first_label(rules: Iterable[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule whose condition holds."""
    ladder = None
    for label, condition in rules:
        ladder = F.when(condition, label) if ladder is None else ladder.when(condition, label)
    return ladder.otherwise(default)


def lookup(value, table: Mapping[str, object], default) -> Column:
    """Literal map lookup with a default."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(value)), F.lit(default))


def split_list(value, separator: str = ",") -> Column:
    """Separated text to a list of trimmed, non-empty items."""
    parts = F.transform(F.split(as_col(value), separator), strip)
    return F.filter(parts, lambda item: item != "")


def metric_label(value) -> Column:
    """`brand_awareness` -> `Brand Awareness`."""
    return F.initcap(F.replace(as_col(value), F.lit("_"), F.lit(" ")))


def stable_id(prefix: str, *parts) -> Column:
    """Deterministic id from a natural key; nulls are kept apart from empty text."""
    marked = [F.coalesce(as_col(p).cast("string"), F.lit("\u0000")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0001", *marked), 256), 1, 32))
