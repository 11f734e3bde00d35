"""Lenient number parsing and integer draws from hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from staffmart.functions.text import matches, strip

INTEGER = r"[+-]?\d+"
DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parse_float(text: Column) -> Column:
    """Number in the text, else NULL."""
    bare = strip(text)
    return F.when(matches(bare, DECIMAL), bare.try_cast("double"))


def safe_float(text: Column, default: Column | float = 0.0) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(parse_float(text), default.cast("double"))


def safe_int(text: Column, default: Column | int = 0) -> Column:
    """Long with the fraction cut off towards zero; text that is no number gives the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(parse_float(text).try_cast("long"), default.cast("long"))


def clip(value: Column, low: Column | int, high: Column | int) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


# --- random values that depend on the row only --------------------------------------------
#
# A row gets two random words from one md5 of its key. Each purpose mixes them with its own
# constants modulo a prime, so draws for different purposes are independent of each other,
# cost a few integer operations, and are the same on every engine and in every retry.

PRIME = 2147483647


def words(seed: int, key: Column) -> list[Column]:
    """Columns ``w0`` and ``w1``, which the draws below read."""
    bits = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return [F.conv(F.substring(bits, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(2)]


def draw_sql(purpose: str) -> str:
    """Uniform whole number from 0 to PRIME - 1."""
    mixed = hashlib.md5(purpose.encode()).hexdigest()
    a, b, c = (int(mixed[i:i + 7], 16) for i in (0, 7, 14))
    return f"((w0 * {a} + w1 * {b} + {c}) % {PRIME})"


def between_sql(purpose: str, low: int, high: int) -> str:
    """Uniform whole number from low to high, both included."""
    return f"({low} + {draw_sql(purpose)} % {high - low + 1})"


def draw(purpose: str) -> Column:
    return F.expr(draw_sql(purpose))


def between(purpose: str, low: int, high: int) -> Column:
    return F.expr(between_sql(purpose, low, high))


def pick(purpose: str, values: list[str]) -> Column:
    """One of the values, all equally likely."""
    options = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"element_at(array({options}), cast({draw_sql(purpose)} % {len(values)} as int) + 1)")


def pick_weighted(purpose: str, weights: list[int]) -> Column:
    """Position 1, 2, … with the given whole-number weights."""
    slots = ", ".join(str(place + 1) for place, weight in enumerate(weights) for _ in range(weight))
    return F.expr(f"element_at(array({slots}), cast({draw_sql(purpose)} % {sum(weights)} as int) + 1)")


def normal_sql(purpose: str, spread: int, divide: str) -> str:
    """Sum of twelve draws, less its mean, scaled to the standard deviation ``spread``."""
    total = " + ".join(draw_sql(f"{purpose}-{part}") for part in range(12))
    return f"((({total}) * {spread}) {divide} {PRIME} - {6 * spread})"


def normal(purpose: str, spread: int) -> Column:
    """Bell-shaped whole number around 0 with standard deviation ``spread``."""
    return F.expr(normal_sql(purpose, spread, "div"))
