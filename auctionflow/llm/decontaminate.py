"""Documents that contain passages of a benchmark, substitutions allowed, found by spaced seeds."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auctionflow.llm.common import M1, Hashed, batch, mix, pick, word_hashes

FILTER_BITS = 22
STEP = 1 << 20          # seeds or words that are compared at a time
#: ASCII characters that aren't letters or digits separate words, A-Z are lower-cased.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                 ("matched", pa.int64()), ("item_words", pa.int64())])


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PLAIN).split()


Mask = tuple[int, ...]  # 1 where words must agree, 0 where they are ignored


def missed(masks: list[Mask], least: int, longest: int, p: int, q: int) -> Mask | None:
    """A shortest pattern of agreeing (1) and other words that counts though no mask fits into it; None if there is none.

    A pattern counts with `least` agreeing words that are more than p / q of it; `longest` is its greatest
    length, 0 for any. Patterns are extended word by word and told apart by what can still matter:
    their last words, what they have gained (q - p by an agreeing word, -p by another) and how many agree. One that has lost more than `least` words can
    gain is passed over, since what makes it count again counts by itself."""
    span = max((len(m) for m in masks), default=1)
    sought = [(int("".join(map(str, m)), 2), len(m)) for m in masks]
    start = (0, 0, 0, 0, 0)  # last words, how many of them there are, gain, agreeing words, length
    before: dict[tuple, tuple | None] = {start: None}
    todo = deque([start])
    while todo:
        state = todo.popleft()
        last, known, gain, agreeing, length = state
        if longest and length == longest:
            continue
        for same in (1, 0):
            bits, n = last << 1 | same, min(known + 1, span)
            if any(size <= n and bits & m == m for m, size in sought):
                continue
            now, count = gain + (q - p if same else -p), min(agreeing + same, least)
            if now < -least * (q - p):
                continue
            new = (bits & (1 << span - 1) - 1, min(n, span - 1), min(now, least * (q - p)), count, length + 1 if longest else 0)
            if new in before:
                continue
            before[new] = (state, same)
            if now > 0 and count >= least:
                pattern = []
                while before[new] is not None:
                    new, same = before[new]
                    pattern.append(same)
                return tuple(reversed(pattern))
            todo.append(new)
    return None


def fits(mask: Mask, pattern: Mask) -> bool:
    return any(all(pattern[at + i] >= x for i, x in enumerate(mask)) for at in range(len(pattern) - len(mask) + 1))


@cache
def mask_family(least: int, longest: int, p: int, q: int, weight: int = 6, most: int = 4) -> tuple[Mask, ...]:
    """Spaced seeds of which one fits into every pattern that counts: at most `most` masks of the greatest possible
    weight, each with ignored places if it has three words or more. For the usual limits and items of 15 words or more these are
    11101101, 1011111 and 11110011.

    Patterns that escape are looked for, the masks are chosen anew so that they meet all of them, those that meet most first, and so on
    until none escapes; so the family is complete by construction."""
    for w in range(min(weight, least), 1, -1):
        spans = range(w + (w > 2), w + 3)
        able = [(1, *(int(i in inner) for i in range(1, span - 1)), 1) for span in spans for inner in combinations(range(1, span - 1), w - 2)]
        escaped: list[Mask] = []
        masks: list[Mask] | None = []
        while masks is not None and len(masks) <= most:
            pattern = missed(masks, least, longest, p, q)
            if pattern is None:
                return tuple(masks)
            escaped.append(pattern)
            masks, left = [], escaped
            while left and masks is not None:
                best = max(able, key=lambda m: (sum(fits(m, x) for x in left), -len(m), m))
                rest = [x for x in left if not fits(best, x)]
                masks = [*masks, best] if len(rest) < len(left) else None
                left = rest
    return ((1,),)


def seeds(h: np.ndarray, mask: Mask) -> np.ndarray:
    """Hash of the words that the mask doesn't ignore, from every place on."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int("".join(map(str, mask)), 2), np.uint64)
    for i in np.flatnonzero(mask).tolist():
        total = (total + h[i:i + n]) * M1
        total ^= total >> np.uint64(29)
    return mix(total)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each of `n` values in a row."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Items:
    """The seeds of a block of benchmark items, to be looked up from documents.

    The seeds of an item are its words under every mask of its length's family, at every place; so whatever
    words are substituted, a stretch that counts shares a seed with it.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int, identity: float):
        share = Fraction(identity).limit_denominator(10_000)
        self.p, self.q, self.min_words = share.numerator, share.denominator, min_words
        seen = Hashed()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(words(t), seen) for _, t in items]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if items else np.zeros(0, np.uint64)
        self.least = np.minimum(min_words * self.q, self.p * self.size)  # agreeing words times q
        families = [self._family(len(w)) for w in self.words]
        self.masks = sorted({m for f in families for m in f})
        placed = [(seeds(h, m), k) for k, (h, f) in enumerate(zip(self.words, families)) for m in f]
        found = [(s, k) for s, k in placed if len(s)]
        self.seed = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.item = np.repeat([f[1] for f in found], [len(f[0]) for f in found]).astype(np.int64)[order] if found else order
        self.place = np.concatenate([np.arange(len(f[0])) for f in found])[order] if found else order
        self.seed = self.seed[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _family(self, n: int) -> tuple[Mask, ...]:
        if not n:
            return ()
        enough = -(-self.min_words * self.q // self.p)  # in longer items min_words decides
        least = max(1, -(-min(self.min_words * self.q, self.p * n) // self.q))
        return mask_family(least, 0 if n >= enough else n, self.p, self.q)

    def _lines(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, shift) of the diagonals that some seed hits."""
        lines = np.zeros(0, np.int64)  # item and shift in one number
        for mask in self.masks:
            s = seeds(h, mask)
            at = np.flatnonzero(self.filter[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seed, s[at]), np.searchsorted(self.seed, s[at], "right")
            at, lo, n = at[lo < hi], lo[lo < hi], (hi - lo)[lo < hi]
            step = np.cumsum(n) // STEP
            for cut in np.split(np.arange(len(at)), np.flatnonzero(step[1:] != step[:-1]) + 1) if len(at) else ():
                x = _spread(lo[cut], n[cut])
                lines = np.union1d(lines, (self.item[x] << 32) + (np.repeat(at[cut], n[cut]) - self.place[x] + (1 << 31)))
        return lines >> 32, (lines & ((1 << 32) - 1)) - (1 << 31)

    def look_up(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, length, matched, item words) of the items that overlap the words `h`,
        the best place of each."""
        item, shift = self._lines(h)
        first = np.maximum(0, shift)
        n = np.minimum(len(h), shift + self.size[item]) - first
        step = np.cumsum(n) // STEP
        best: dict[int, tuple] = {}
        for cut in np.split(np.arange(len(item)), np.flatnonzero(step[1:] != step[:-1]) + 1) if len(item) else ():
            own = self.begin[item[cut]] + first[cut] - shift[cut]
            same = h[_spread(first[cut], n[cut])] == self.flat[_spread(own, n[cut])]
            ends = np.cumsum(n[cut])
            agree = np.add.reduceat(same, ends - n[cut], dtype=np.int64)
            for x in np.flatnonzero(agree * self.q >= self.least[item[cut]]).tolist():
                k, a = int(item[cut[x]]), int(first[cut[x]])
                found = self.overlap(same[ends[x] - n[cut[x]]:ends[x]], k, a)
                if found and found > best.get(k, (0,)):
                    best[k] = found
        return [(self.ids[k], start, length, matched, len(self.words[k])) for k, (matched, length, start) in sorted(best.items())]

    def overlap(self, same: np.ndarray, k: int, a: int) -> tuple[int, int, int] | None:
        """(matched, length, start) of the stretch with most agreeing words among those in which more
        than the share agree, from the words `same` that agree on a diagonal from word `a` on.

        A word that agrees gains q - p and another loses p, so the share is met where a stretch gains
        anything. From each start the farthest such end has most agreeing words. Words at the ends
        that don't agree are left out."""
        gain = np.concatenate([[0], np.cumsum(np.where(same, self.q - self.p, -self.p))])
        count = np.concatenate([[0], np.cumsum(same)])
        after = np.maximum.accumulate(gain[::-1])[::-1]  # most that is gained at any later end
        stop = np.searchsorted(-after, -gain, "left") - 1
        matched = np.where(stop > np.arange(len(gain)), count[stop] - count, 0)
        most = int(matched.max())
        if not most or most * self.q < self.least[k]:
            return None
        agree = np.flatnonzero(same)
        starts = np.flatnonzero(matched == most)
        begin, end = agree[count[starts]], agree[count[stop[starts]] - 1] + 1
        length, start = max(zip((end - begin).tolist(), begin.tolist()))
        return most, length, a + start


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_words` words, so that neither driver nor workers hold more."""
    block, size = [], 0
    for i, text in pick(benchmark, item_id, item_text).toLocalIterator():
        block.append((i, text))
        size += len(words(text))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id: str = "item_id", item_text: str = "text", min_words: int = 12, identity: float = 0.8,
             block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, start, length, matched, item_words: benchmark items that a document repeats.

    Words are letters and digits, lower-cased; start and length count words of the document. A hit
    of any spaced seed is extended along its diagonal over the whole item; a stretch counts if it agrees in
    more than `identity` of its words and in `min_words` words, or in that share of an item that is
    shorter. Every such stretch is found. One row per document row and item, the place with most agreeing words, the longest and
    last of equal ones. NULL and empty texts and items overlap with nothing; repeated rows give
    repeated rows; an empty table on either side gives none. Texts are read whole, without a shuffle.

    The benchmark is the stated query set: it goes to the tasks in blocks of `block_words` words,
    with one pass over the documents for each.
    """
    spark = docs.sparkSession
    texts = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, items = Hashed(), block.value
            for b in batches:
                rows = [(d, *hit) for d, text in zip(b.column(0).to_pylist(), b.column(1))
                        for hit in items.look_up(word_hashes(words(text.as_py()), seen))]
                yield batch(HIT, **{f.name: [r[i] for r in rows] for i, f in enumerate(HIT)})
        return run

    kind = StructType([StructField(f.name, LongType()) for f in HIT])
    found = spark.createDataFrame([], kind)
    for block in _blocks(benchmark, item_id, item_text, block_words):
        found = found.unionByName(texts.mapInArrow(search(spark.sparkContext.broadcast(Items(block, min_words, identity))), kind))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", min_words: int = 12, identity: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """The rows of `docs`, with all columns, that repeat no benchmark item (see `overlaps`)."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def keep(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, items = Hashed(), block.value
            for b in batches:
                yield b.filter(pa.array([not items.look_up(word_hashes(words(t.as_py()), seen)) for t in b.column(at)], pa.bool_()))
        return run

    for block in _blocks(benchmark, item_id, item_text, block_words):
        docs = docs.mapInArrow(keep(spark.sparkContext.broadcast(Items(block, min_words, identity))), docs.schema)
    return docs
