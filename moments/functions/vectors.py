"""Scalar functions on vectors and boxes, all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a norm of zero counts as one, different widths give -1."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(dot(a, b) / (one(norm(a)) * one(norm(b))))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines do it on doubles: the nearest of x times a power of ten, halves away from zero, with the sign
    of x, so a small negative number is -0.0 (F.round goes by the decimal digits and knows no -0.0)."""
    size = F.abs(x) * F.lit(10.0**places)
    even = F.rint(size)
    found = F.signum(x) * F.when(size - even == 0.5, even + 1).otherwise(even) / F.lit(10.0**places)
    return F.when(size < float("inf"), found).otherwise(x)  # NaN counts as greater


def clipped(a: Column, b: Column) -> Column:
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))


def parsed(text: Column) -> Column:
    """A vector written as [..]; malformed text is an empty vector."""
    ok = text.rlike(r"^\s*\[([-+0-9.eE,\s]|NaN|Infinity|null)*\]\s*$")
    return F.coalesce(F.when(ok, F.from_json(text, "array<double>")), F.array().cast("array<double>"))


def area(b: Column) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def proximity(a: Column, b: Column) -> Column:
    """1 / (1 + distance of centres in mean diagonals), times the agreement in size; other classes do not match."""
    cx = lambda p: (p.x1 + p.x2) / 2
    cy = lambda p: (p.y1 + p.y2) / 2
    diagonal = lambda p: F.sqrt((p.x2 - p.x1) * (p.x2 - p.x1) + (p.y2 - p.y1) * (p.y2 - p.y1))
    far = F.sqrt((cx(a) - cx(b)) * (cx(a) - cx(b)) + (cy(a) - cy(b)) * (cy(a) - cy(b)))
    mean = F.greatest((diagonal(a) + diagonal(b)) / 2, F.lit(1e-9))
    size = F.sqrt(F.least(area(a), area(b)) / F.greatest(F.greatest(area(a), area(b)), F.lit(1e-9)))
    return F.when(a.label != b.label, 0.0).otherwise(1 / (1 + far / mean) * size)


def crop(b: Column, width: Column, height: Column, pad: float = 0.08) -> Column:
    """The padded rectangle inside the image; null below two pixels."""
    dx, dy = (b.x2 - b.x1) * pad, (b.y2 - b.y1) * pad
    left, top = F.greatest(F.floor(b.x1 - dx), F.lit(0)), F.greatest(F.floor(b.y1 - dy), F.lit(0))
    right, low = F.least(F.ceil(b.x2 + dx), width), F.least(F.ceil(b.y2 + dy), height)
    return F.when((right - left >= 2) & (low - top >= 2), F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), low.alias("y2")))
