"""Groups of documents whose word n-gram sets are nearly equal, found exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.common import LOWER, M1, M2, M3, Hashed, batch, chosen, lists, mix, pick, word_hashes
from auctionflow.operators.graph import connected_components
from auctionflow.session import arrow_rows, forget, store

BITS = 1024          # of a signature at least
BLOCK = 1024         # documents of one tile that meet in one task at a time
TEXTS, PAIRS = 1000, 250   # documents, and pairs of sets, that are sent to Python at a time
BAND_GROWTH = 1.3    # upper size of a band over that of the band below

SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
    ("bits", pa.list_(pa.int64())), ("tiles", pa.list_(pa.int64()))])


def grams(text: str | None, words: int, seen: Hashed) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole text if it has fewer words."""
    h = word_hashes((text or "").encode().translate(LOWER).split(), seen)
    if not len(h):
        return h
    k = min(words, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * M1 + h[i:len(h) - k + 1 + i])
    return np.unique(total)


class Bands:
    """Bands of set sizes and the number of parts the sets of a band are cut into.

    Sets a, b with overlap >= percent / 100 of their union differ in at most
    d = (|a| + |b|) * (100 - percent) / (100 + percent) elements. Cut into d + spare + 1 parts by hash
    range, they agree on spare + 1 parts or more. A set is filed under every part that has elements in it, and
    under its empty parts, which many sets share, only if there are more than `spare` of them; so if
    the parts two such sets agree on are all empty, both are filed there. `spare` is two deviations more
    than the empty parts one expects of the smallest sets that come into the band, so few sets are. Sets meet in the
    band of the larger one.
    """

    def __init__(self, percent: int):
        self.percent, self.tops, self.parts, self.spare = percent, [], [], []

    def _grow(self, n: int) -> None:
        while not self.tops or self.tops[-1] < n:
            least = self.tops[-1] + 1 if self.tops else 1
            top = int(self.tops[-1] * BAND_GROWTH) + 1 if self.tops else 4
            differ = 2 * top * (100 - self.percent) // (100 + self.percent)
            smallest = max(1, -(-least * self.percent // 100))
            expected = lambda spare: (m := differ + spare + 1) * math.exp(-smallest / m)
            enough = (e for e in range(1, 2 * differ + 2) if expected(e) + 2 * math.sqrt(expected(e)) <= e)
            self.spare.append(next(enough, 1))
            self.tops.append(top)
            self.parts.append(differ + self.spare[-1] + 1)

    def tiles(self, s: np.ndarray) -> np.ndarray:
        n, found = len(s), []
        self._grow(2 * n + 4)
        own = next(b for b in count() if self.tops[b] >= n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
        for band in range(own, len(self.tops)):
            if band > own and n * 100 < self.percent * (self.tops[band - 1] + 1):
                break  # every set of this band is too large
            m = self.parts[band]
            if m == self.spare[band] + 1:
                continue  # no difference allowed: equal sets only
            edges = (np.arange(1, m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m) << np.uint64(32)
            at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            part = sums[at[1:]] - sums[at[:-1]]
            empty = at[1:] == at[:-1]
            key = mix(part + mix((np.arange(m, dtype=np.uint64) + (np.uint64(band) << np.uint64(32))) * M1))
            found.append(key if empty.sum() > self.spare[band] else key[~empty])
        return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the elements hashed to i, so two sets that differ in d elements
    differ in at most d bits. There are twice as many bits as elements, or up to four times, so
    that long sets don't fill them; halves laid over each other by XOR are the signature of half
    the length."""
    bits = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    where = (mix(s ^ M3) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(where, minlength=bits) & 1, bitorder="little").view(np.int64)


def _halved(bits: np.ndarray, length: int) -> np.ndarray:
    while len(bits) > length:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def sign(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: size, 128-bit digest, bit signature and tiles of its n-gram set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen, bands = Hashed(), Bands(percent)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                sets = [grams(t.as_py(), words, seen) for t in part.column(1)]
                sums = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8")
                yield batch(SIGNED, doc_id=part.column(0), n_shingles=[len(s) for s in sets], set_a=sums[::2],
                            set_b=sums[1::2], bits=lists([signature(s) for s in sets], pa.int64()),
                            tiles=lists([bands.tiles(s) for s in sets], pa.int64()))

    return _ids(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, tiles array<long>")


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _gram_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, grams) with the sorted hashes as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashed()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield batch(schema, doc_id=part.column(0),
                            grams=[grams(t.as_py(), words, seen).tobytes() for t in part.column(1)])

    return docs.mapInArrow(run, "doc_id long, grams binary")


def _overlaps(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, grams_a, grams_b) the pairs (src, dst) whose sets overlap enough, by intersection."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(c)
            yield batch(schema, src=left, dst=right)

    return pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "src long, dst long")


def _bounded(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose sizes and signatures leave room for the overlap.

    Sets that differ in d elements overlap in (|a| + |b| - d) / 2, and d is at least the number of
    differing bits."""
    for side in "ab":
        pairs = pairs.join(signs.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                                        F.col("bits").alias(f"bits_{side}")), side)
    # sizes that can link are less than a factor of 4 apart, and signatures at most two steps
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    halve = lambda c: F.when(F.size(c) > size, F.zip_with(
        F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")),
        lambda x, y: x.bitwiseXOR(y))).otherwise(c)
    differ = F.aggregate(F.zip_with(halve(halve(F.col("bits_a"))), halve(halve(F.col("bits_b"))), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda total, bits: total + F.coalesce(bits, F.lit(0)))
    near = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return near.filter((differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link; only their documents are cut into n-grams again."""
    pairs = kept = store(pairs, "pairs")
    needed = store(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")
    with arrow_rows(texts.sparkSession, TEXTS):
        sets = store(_gram_sets(chosen(texts, needed, "left_semi"), words), "grams")
    for side in "ba":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    with arrow_rows(texts.sparkSession, PAIRS):
        found = store(_overlaps(pairs, percent).distinct(), "links")
    forget(kept, needed, sets)
    return found


MEMBERS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("edge", pa.bool_())])


def _members(tiles: DataFrame) -> DataFrame:
    """key, doc_id, first, second of the tiles (key, doc_id) that hold more than one document; `whole` if
    first and second are those of the whole tile.

    Rows are dealt out by ranges of (key, doc_id), so a tile of any size lies in as many tasks as it needs, each
    with a first and a second of its own. Nine of ten tiles hold one document, whose rows go no further. A tile at the
    edge of a task may have other rows elsewhere; there are two of them a task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 2  # the rows of the last tile while they are less than two
        going = None  # (key, first, second) of the last tile if it had two
        edges: list[int] = []
        for b in batches:
            key, doc = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
            if not len(key):
                continue
            edges = [edges[0] if edges else int(key[0]), int(key[-1])]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            first, second = doc[starts], doc[np.minimum(starts + 1, len(doc) - 1)]
            full = sizes > 1
            if going is not None and going[0] == key[0]:
                first[0], second[0], full[0] = going[1], going[2], True
            last = starts[-1]
            going = (int(key[-1]), int(first[-1]), int(second[-1])) if full[-1] else None
            held = (key[last:], doc[last:]) if not full[-1] else (key[:0], doc[:0])
            # a single row at the front edge stays; the one at the back is held
            keep = full | ((key[starts] == edges[0]) & (np.arange(len(starts)) < len(starts) - 1))
            rows = np.repeat(keep, sizes)
            if rows.any():
                yield batch(MEMBERS, key=key[rows], doc_id=doc[rows], first=np.repeat(first, sizes)[rows],
                            second=np.repeat(second, sizes)[rows], edge=np.zeros(int(rows.sum()), bool))
        if len(held[0]):
            yield batch(MEMBERS, key=held[0], doc_id=held[1], first=held[1], second=held[1], edge=[False])
        if edges:
            ends = list(dict.fromkeys(edges))
            yield batch(MEMBERS, key=ends, doc_id=[None] * len(ends), first=[None] * len(ends), second=[None] * len(ends), edge=[True] * len(ends))

    kind = "key long, doc_id long, first long, second long, edge boolean"
    found = store(tiles.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(run, kind), "members")
    torn = found.filter("edge").select("key").distinct().withColumn("torn", F.lit(True))  # two a task at most
    return found.filter("NOT edge").join(F.broadcast(torn), "key", "left").select(
        "key", "doc_id", "first", "second", F.col("torn").isNull().alias("whole"))


def _crowded(members: DataFrame, links: DataFrame | None, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs of tiles' members that didn't meet as first or second of their tile; if `links` are given,
    only pairs that these don't connect.

    A tile of more than BLOCK documents is dealt out as blocks, two of which meet in one task; the
    rows of a block stream through, so no tile is ever whole in a task. Pairs are compared by
    their signatures where they meet, and only those that pass leave the task."""
    rest = members.filter("NOT whole OR (doc_id <> first AND doc_id <> second)").select("key", "doc_id")
    if links is None:
        rest = rest.withColumn("part", F.col("doc_id"))
    else:
        groups = connected_components(links).withColumnRenamed("node", "doc_id")
        rest = rest.join(groups, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    rest = store(rest, "rest")
    mixed = rest.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"),
                                    F.count("*").alias("n")).filter("x < y").select("key", "n")
    crowd = rest.join(mixed, "key").join(signs.select("doc_id", "n_shingles", "bits"), "doc_id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        crowd.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                "own", "doc_id", "part", "n_shingles", "bits")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            flat, at = b.column(7).flatten().to_numpy().view(np.uint64), b.column(7).offsets.to_numpy()
            bits = np.empty(b.num_rows, object)
            bits[:] = np.split(flat, at[1:-1] - at[0])
            cols = [b.column(i).to_numpy() for i in range(7)] + [bits]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            ends = _ends(rest)
            if len(ends) > 1:
                yield _meet(rest, ends[:-1], percent, schema)
                rest = [c[ends[-2]:] for c in rest]
        if rest is not None and len(rest[0]):
            yield _meet(rest, _ends(rest), percent, schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _ends(cols: list[np.ndarray]) -> np.ndarray:
    """Where the rows of each (key, i, j) end."""
    new = np.zeros(len(cols[0]) - 1, bool)
    for c in cols[:3]:
        new |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new) + 1, len(cols[0]))


def _meet(cols: list[np.ndarray], ends: np.ndarray, percent: int, schema: pa.Schema) -> pa.RecordBatch:
    _, i, j, own, doc, part, size, signs = cols
    left, right, at = [], [], 0
    for end in ends:
        least = min(map(len, signs[at:end]))
        bits = np.stack([_halved(x, least) for x in signs[at:end]])
        split = at + int(np.searchsorted(own[at:end], j[at])) if i[at] != j[at] else end
        for x in range(at, split):
            first = split if i[at] != j[at] else x + 1
            y = first + np.flatnonzero(part[first:end] != part[x])
            total = size[y] + size[x]
            y = y[(100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))
                  & (np.bitwise_count(bits[y - at] ^ bits[x - at]).sum(axis=1, dtype=np.int64) * (100 + percent)
                     <= total * (100 - percent))]
            left.append(np.minimum(doc[y], doc[x]))
            right.append(np.maximum(doc[y], doc[x]))
        at = end
    none = [np.zeros(0, np.int64)]
    return batch(schema, a=np.concatenate(left or none), b=np.concatenate(right or none))


def links(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id",
          text_col: str = "text", every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles, rep, n_equal of every row, and links (src, dst) between reps.

    Documents with equal n-gram sets share the smallest id as `rep`; n_equal counts their ids. The
    links are all pairs of reps that overlap in percent / 100 of their union. Without `every` they
    only connect all such pairs, directly or over other links: pairs that are already connected
    need no link of their own.
    """
    texts = _ids(docs, id_col, text_col)
    with arrow_rows(docs.sparkSession, TEXTS):
        signs = store(sign(docs, words, percent, id_col, text_col), "signs")
    sets = ["n_shingles", "set_a", "set_b"]
    reps = store(signs.filter("n_shingles > 0").groupBy(*sets).agg(
        F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("n_equal")), "reps")
    copies = store(signs.select("doc_id", *sets).join(reps, sets).filter("doc_id <> rep").select("doc_id", "rep"), "copies")
    tiles = chosen(signs.filter("doc_id IS NOT NULL").select("doc_id", "tiles"), copies.select("doc_id").distinct(), "left_anti").select(
        F.explode("tiles").alias("key"), "doc_id")
    members = store(_members(tiles), "tiles")
    signs, filed = store(signs.select("doc_id", "n_shingles", "bits"), "signs"), signs
    forget(filed)  # the tiles are most of what is on disk
    pairs = members.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).union(
        members.filter("doc_id <> first AND doc_id <> second").select("second", "doc_id")).distinct()
    first = _verified(_bounded(pairs, signs, percent), texts, words, percent)
    second = _verified(_crowded(members, None if every else first, signs, percent), texts, words, percent)
    forget(members)
    rows = signs.select("doc_id", "n_shingles").join(copies.distinct(), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")).join(
        reps.filter("n_equal > 1").groupBy("rep").agg(F.max("n_equal").alias("n_equal")), "rep", "left").select(
        "doc_id", "n_shingles", "rep", F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
    return rows, first.union(second).distinct()


def ngram_join(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    Words are runs of bytes other than space and \x09 to \x0D, with A-Z lower-cased. The set of a
    document is its distinct n-grams, the whole sequence if it has fewer words. Two documents link
    when 100 * overlap >= percent * union; component_id is the smallest doc_id reachable.
    `n_links` counts all other documents that the document links with, those of equal sets too.

    NULL, empty and blank texts have an empty set and are linked with nothing, as are rows without
    an id (their component is NULL). Rows with the same id count as one document. Texts are read
    whole. An empty table gives no rows; other columns are not read.
    """
    rows, edges = links(docs, words, percent, id_col, text_col)
    sizes = rows.filter("n_equal > 1").select("rep", "n_equal").distinct()
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("rep")).union(edges.select("dst", "src"))
    degree = both.join(sizes, "rep", "left").groupBy(F.col("node").alias("rep")).agg(
        F.sum(F.coalesce("n_equal", F.lit(1))).alias("n_linked"))
    groups = connected_components(edges).withColumnRenamed("node", "rep")
    return rows.join(groups.join(degree, "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("n_linked", F.lit(0)) + F.col("n_equal") - 1).cast("long").alias("n_links"))


def ngram_groups(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, as `ngram_join` has them, without looking for
    the links inside what is connected already."""
    rows, edges = links(docs, words, percent, id_col, text_col, every=False)
    groups = connected_components(edges).withColumnRenamed("node", "rep")
    return rows.join(groups, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
