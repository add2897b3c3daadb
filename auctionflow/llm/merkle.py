"""Fingerprints of documents as hash trees: equal roots, equal texts; differing branches show edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionflow.llm.common import pick

#: A leaf is up to four words of one paragraph and ends with a sentence.
LEAF = r"\s*(?:\S*[^\s.!?]\s+){0,3}\S+|\s+\z"
#: A section ends with a paragraph whose hash begins with 0, or with the text.
SECTION_END = r"(?<=(?:^|,)0[0-9a-f]{31}),"
LOWEST = -(1 << 63)


def _hash(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def tree(text: Column) -> Column:
    """root, sections, paragraphs and leaves of a text.

    Paragraphs are lines, cut into leaves; sections are runs of paragraphs that end by content, so
    an insertion doesn't move what follows into other branches. `paragraphs` is an array of structs
    with the hash and the leaves' hashes of each."""
    lines = F.transform(F.split(text, "\n", -1), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.lower(F.lpad(F.hex(F.xxhash64(leaf)), 16, "0"))))
    return F.transform(lines, lambda leaves: F.struct(_hash(F.concat_ws(",", leaves), 32).alias("hash"), leaves.alias("leaves")))


def fingerprint(text: Column) -> Column:
    """The tree written as root/sections/leaves: 64, 16 and 8 hex digits each, joined by commas.

    A tree of one level less is told by its root alone: equal texts have equal fingerprints, and
    the sections and leaves that two fingerprints don't share locate where their texts differ."""
    levels = F.transform(F.array(tree(text)), lambda paragraphs: F.struct(
        F.transform(F.split(F.array_join(F.transform(paragraphs, lambda p: p["hash"]), ","), SECTION_END),
                    lambda s: _hash(s, 64)).alias("sections"),
        F.transform(F.flatten(F.transform(paragraphs, lambda p: p["leaves"])), lambda leaf: F.substring(leaf, 1, 8)).alias("leaves")))
    return F.transform(levels, lambda t: F.concat_ws(
        "/", _hash(F.array_join(t["sections"], ","), 64), F.array_join(F.transform(t["sections"], lambda s: F.substring(s, 1, 16)), ","),
        F.array_join(t["leaves"], ",")))[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves that two fingerprints have in common, 1 for equal roots."""
    x, y = (F.array_distinct(F.split(F.element_at(F.split(f, "/"), 3), ",")) for f in (a, b))
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.lit(1.0)).otherwise(
        F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)), F.lit(0.0)))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of fingerprint `a` that `b` doesn't have."""
    x, y = (F.split(F.element_at(F.split(f, "/"), 2), ",") for f in (a, b))
    return F.filter(F.transform(x, lambda s, i: F.when(~F.array_contains(y, s), i)), lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; a NULL text is empty. No shuffle."""
    return pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """`rows` (doc_id, text and more) with next_<c> for each column: its value in the row that
    follows by descending doc_id, after the last one in the first.

    Rows with equal ids follow by ascending text; NULL ids come last. The ids are cut into ranges of
    about equally many rows at percentiles; each range is sorted on its own, with a copy of the
    following range's first row at its end."""
    spark = rows.sparkSession
    rows = rows.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    n = min(2000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = rows.agg(F.percentile_approx("__key", [i / n for i in range(1, n)]).alias("marks")).first()["marks"]
    marks = sorted(set(marks or []), reverse=True)
    bounds = F.array(*[F.lit(m) for m in marks]).cast("array<bigint>")
    rows = rows.withColumn("__range", F.size(F.filter(bounds, lambda m: m > F.col("__key"))))
    heads = sorted((r["__range"], r["head"]) for r in rows.groupBy("__range").agg(F.max("__key").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    firsts = rows.filter(F.col("__key").isin(*before) if before else F.lit(False))
    least = firsts.groupBy("__key").agg(*[F.min_by(c, F.col("text")).alias(c) for c in carried])
    place = F.coalesce(*[F.when(F.col("__key") == head, F.lit(r)) for head, r in before.items()], F.lit(0))
    ghosts = least.select(*carried, place.alias("__range"), F.lit(True).alias("__ghost"), F.lit(LOWEST).alias("__key"))
    order = Window.partitionBy("__range").orderBy("__ghost", F.desc("__key"), "text")
    joined = rows.withColumn("__ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    return joined.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter("NOT __ghost").drop("__ghost", "__key", "__range")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text (see the query) and the next document, by their fingerprints.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has the last half of the characters replaced by the first ones of the next document
    by descending doc_id. Texts are whole; a NULL text is empty, and an only row is its own next.
    Repeated rows follow each other. An empty table gives no rows; other columns are not read."""
    rows = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), "text", "fingerprint")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
