"""Credentials in texts: known forms, and stretches of high entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.common import pick
from auctionflow.llm.matches import characters, ends, found

#: The known forms, with the group whose length counts and that length.
FORMS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A cheap sign that a text may hold the form at all.
SIGNS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: Per class of characters the candidates, their alphabet, window and least bits a character.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])[0-9a-fA-F]{16,}(?![A-Za-z0-9])", "0123456789abcdef", 16, 2.9),
    "entropy_mixed": (r"[A-Za-z0-9+/_=-]{20,}", None, 20, 3.75),
}
#: What looks random but is no secret.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers made at random
    r"(?i)example|sample|dummy|placeholder|changeme|lorem",
    r"(?i)abcdefgh|qwertyui|01234567|12345678|87654321",
    r"(.)\1{5}",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _places(text: Column, pattern: str) -> Column:
    """(end, match) of every match."""
    return F.zip_with(ends(text, pattern), found(text, pattern), lambda e, m: F.struct(e.alias("end"), m.alias("m")))


def _no_spans() -> Column:
    return F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)")


def _known(text: Column, kind: int, name: str) -> Column:
    pattern, group, least = FORMS[name]
    if group:
        places = F.zip_with(_places(text, pattern), found(text, pattern, group), lambda p, g: F.struct(p["end"], p["m"], g.alias("g")))
        places = F.filter(places, lambda p: F.char_length(p["g"]) >= least)
    else:
        places = F.filter(_places(text, pattern), lambda p: F.char_length(p["m"]) >= least)
    return F.when(text.rlike(SIGNS[name]), F.transform(places, lambda p: _span(kind, p["end"] - F.char_length(p["m"]), p["end"]))).otherwise(_no_spans())


def dense_stretches(word: Column, window: int, bits: float) -> Column:
    """(start, end) of the stretches of `word` covered by windows with `bits` of entropy a character.

    The window moves on by one character at a time. Entropy is log2(w) - sum(n * log2(n)) / w over
    the counts n of its characters; of the counts and of the sum, only what enters and leaves the
    window is changed."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    codes = F.transform(characters(word), lambda c: F.ascii(c))
    none = F.expr("CAST(array() AS array<struct<start: int, end: int>>)")
    start = F.struct(F.expr("array_repeat(0, 128)").alias("n"), F.lit(0.0).cast("double").alias("sum"), none.alias("out"))
    steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("enter"), F.when(i >= window, codes[i - window]).otherwise(-1).alias("leave")))

    def step(s: Column, e: Column) -> Column:
        grown = s["sum"] + weight[s["n"][e["enter"]] + 1] - weight[s["n"][e["enter"]]]
        shrunk = grown + weight[s["n"][e["leave"]] - 1] - weight[s["n"][e["leave"]]]
        total = F.when(e["leave"] == e["enter"], s["sum"]).when(e["leave"] < 0, grown).otherwise(shrunk)
        counts = F.transform(s["n"], lambda n, k: n + (k == e["enter"]).cast("int") - (k == e["leave"]).cast("int"))
        first, last = (e["i"] - window + 1).cast("int"), F.try_element_at(s["out"], F.lit(-1))
        full = (e["i"] >= window - 1) & (math.log2(window) - total / window >= bits)
        joined = F.when(first <= last["end"], F.concat(
            F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(last["start"].alias("start"), (e["i"] + 1).cast("int").alias("end")))))
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(full, F.coalesce(joined, F.array_append(
            s["out"], F.struct(first.alias("start"), (e["i"] + 1).cast("int").alias("end"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def _dense(text: Column, kind: int, name: str) -> Column:
    pattern, alphabet, window, bits = CLASSES[name]
    places = F.filter(_places(text, pattern), lambda p: ~F.array_contains(F.array(*[p["m"].rlike(a) for a in ALLOWED]), True))
    spans = F.flatten(F.transform(places, lambda p: F.transform(
        dense_stretches(F.lower(p["m"]) if alphabet else p["m"], window, bits),
        lambda s: _span(kind, p["end"] - F.char_length(p["m"]) + s["start"], p["end"] - F.char_length(p["m"]) + s["end"]))))
    return F.when(text.rlike(pattern), spans).otherwise(_no_spans())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), sorted, in characters with open ends.

    `base` has the known forms (kinds 0 to 2 in the order of FORMS), leftmost and without overlaps
    within a kind; `spans` adds stretches of high entropy (kinds 3 and 4 in the order of CLASSES),
    found by a sliding window over candidate strings that no pattern of ALLOWED suppresses. Spans of
    different kinds may overlap. Texts are read whole; a NULL or empty text has no spans. One row per
    input row, no shuffle; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", *[_known(text, i, name).alias(name) for i, name in enumerate(FORMS)],
                       *[_dense(text, len(FORMS) + i, name).alias(name) for i, name in enumerate(CLASSES)])
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS],
                       F.array_sort(F.concat(*FORMS)).alias("base"), F.array_sort(F.concat(*FORMS, *CLASSES)).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts of the known forms, a checksum of their places, and all places as text."""
    kinds = F.array(*[F.lit(k) for k in (*FORMS, *CLASSES)])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found_spans.select("doc_id", *[f"n_{k}" for k in FORMS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
                              text("spans").alias("spans"))
