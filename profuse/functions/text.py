"""String rules for sample and feature labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_blanks(label: Column) -> Column:
    return F.trim(label)


def prefix_and_drop(label: Column, start: str, end: str) -> Column:
    """Prefix ``start`` and remove every occurrence of ``end``."""
    kept = F.replace(label, F.lit(end), F.lit("")) if end else label
    return F.concat(F.lit(start), kept)


def truncate_label(label: Column, length: int = 15) -> Column:
    return F.substring(label, 1, length)


def replace_all(label: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace each ``old`` by ``new`` in the order given."""
    for old, new in pairs:
        label = F.replace(label, F.lit(old), F.lit(new))
    return label


def add_suffix(label: Column, suffix: str = "-01") -> Column:
    return F.concat(label, F.lit(suffix))


def to_number(text: Column, strict: bool = False) -> Column:
    """Text to double: ``strict`` raises on bad text, otherwise it becomes NULL."""
    return text.cast("double") if strict else text.try_cast("double")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
