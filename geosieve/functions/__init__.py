"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no speed (fixed values).
NO_SPEED = ("none", "signals", "variable", "walk")
LEGACY_NO_SPEED = ("none", "signals", "variable", "implicit")


def parse_maxspeed(value: Column, stop: tuple = NO_SPEED, strip: bool = True) -> Column:
    """The first number in a speed tag as it is written; null for the words in `stop`, or without a number.

    White space of any kind around a word doesn't matter, unless strip=False.
    """
    text = F.lower(F.regexp_replace(value, r"^\s+|\s+$", "") if strip else value)
    return F.when(text.isin(*stop), None).otherwise(F.nullif(F.regexp_extract(text, r"(\d+(\.\d+)?)", 1), F.lit("")).cast("double"))


def finite(value: Column) -> Column:
    """0 for nulls, NaN and infinities."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def draw(seed: Column | int, *parts) -> Column:
    """A reproducible random key: the md5 of seed and parts, joined by colons. Equal in any engine and partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", *(x.cast("string") for x in (seed, *parts))))


def euclid(ax, ay, bx, by) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by)))


def edge_strength(length: Column) -> Column:
    """Closeness for clustering."""
    return 1 / (length + 1e-6)


def strength_of(columns: list[str]) -> Column:
    """Closeness from `length`, else the edge's own `weight`, else 1 for all."""
    return edge_strength(F.col("length")) if "length" in columns else F.col("weight").cast("double") if "weight" in columns else F.lit(1.0)


def flatten_tag(tags: Column) -> Column:
    """A list of tags as one text."""
    return F.array_join(tags, ",")
