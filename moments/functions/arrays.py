"""Functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed together; keeps the copies of growing arrays short.
CHUNK = 256


def running_sums(values: Column) -> Column:
    """For each element the sum of all up to it, as longs. Sums grow inside chunks of CHUNK elements and then over the chunks, so
    an array of n elements costs about n * (CHUNK + n / CHUNK^2) and not n^2 steps."""
    none = F.array().cast("array<long>")

    def grown(total: Column, sums: Column, x: Column) -> Column:
        return F.struct((total + x).alias("total"), F.concat(sums, F.array(total + x)).alias("sums"))

    def summed(of: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("sums"))
        return F.aggregate(of, start, lambda a, x: grown(a.total, a.sums, x.cast("long")))

    last = F.call_function("div", F.size(values) - 1, F.lit(CHUNK)).cast("int")
    chunks = F.transform(
        F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK))), summed
    )

    def joined(parts: Column) -> Column:
        ends = summed(F.transform(parts, lambda p: p.total)).sums
        return F.flatten(
            F.zip_with(parts, ends, lambda p, end: F.transform(p.sums, lambda x: x + end - p.total))
        )

    whole = F.element_at(F.transform(F.array(chunks), joined), 1)
    return F.when(F.size(values) > 0, whole).otherwise(none)
