"""All matches of a pattern with their places, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def gaps(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ends(text: Column, pattern: str) -> Column:
    """Where each match ends, in characters: a running total of gaps and matches."""
    steps = F.zip_with(gaps(text, pattern), found(text, pattern),
                       lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0)))
    # totals of blocks of 256 first, so that long lists stay far from quadratic
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 256).cast("int")),
                         lambda b: F.slice(steps, b * 256 + 1, F.lit(256)))
    state = F.struct(F.lit(0).alias("total"), F.expr("CAST(array() AS array<array<int>>)").alias("out"))

    def block(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s["total"].alias("total"), F.expr("CAST(array() AS array<int>)").alias("out")),
                            lambda t, n: F.struct((t["total"] + n).alias("total"), F.array_append(t["out"], t["total"] + n).alias("out")))
        return F.struct(inner["total"].alias("total"), F.array_append(s["out"], inner["out"]).alias("out"))

    return F.flatten(F.aggregate(blocks, state, block, lambda s: s["out"]))
