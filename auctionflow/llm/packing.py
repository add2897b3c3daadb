"""Documents packed into fixed-length sequences, over several context sizes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.common import batch, pick

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int64()), ("step", pa.int64())])


class Rests:
    """Pieces of documents by their length."""

    def __init__(self, longest: int):
        self.of: list[list] = [[] for _ in range(longest + 1)]
        self.mask = 0  # bit n: a piece of n tokens is there

    def push(self, piece: tuple) -> None:
        n = piece[3] - piece[2]
        self.of[n].append(piece)
        self.mask |= 1 << n

    def longest(self, most: int) -> int:
        """The greatest length there is up to `most`, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def pop(self, n: int) -> tuple:
        piece = self.of[n].pop()
        if not self.of[n]:
            self.mask &= ~(1 << n)
        return piece


class Tiers:
    """Packs documents into windows of `tiers` tokens (powers of two, ascending).

    A document goes to the smallest tier that holds it. Tiers are packed one after the other, the
    shortest first: a window opens with the tier's longest document and is filled with the longest ones that
    fit, of the same tier where two can fit, else with what shorter tiers have left over. What is still
    open then is cut from the documents that are longer than any window and have to be cut anyway,
    and only when there are none from the longest document that waits. What the long documents have left fills the
    longest windows. Windows are therefore full, save the last of a run, which `finish` closes at powers of two.

    `step` numbers groups of `step_tokens` tokens of one tier, so that every group is the same work.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.waiting = Rests(tiers[-1])   # documents on the way to their tier
        self.left = Rests(tiers[-1])      # documents that their tier had no full window for
        self.long: deque = deque()        # what has been cut, or has to be: (doc, ids, start, stop)
        self.long_tokens = 0
        self.sequences = 0
        self.filled = dict.fromkeys(tiers, 0)
        self.out: list[tuple] = []

    def _close(self, pieces: list, tokens: int) -> None:
        tier = next(t for t in self.tiers if t >= tokens)
        step, at = self.filled[tier] // self.step_tokens, 0
        for doc, ids, start, stop in pieces:
            self.out.append((doc, start, stop - start, ids[start:stop].tobytes(), len(ids), self.sequences, at, tier, step))
            at += stop - start
        self.filled[tier] += tier
        self.sequences += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        if len(ids) > self.tiers[-1]:
            self._loosen((doc, ids, 0, len(ids)))
        else:
            self.waiting.push((doc, ids, 0, len(ids)))

    def _loosen(self, piece: tuple) -> None:
        self.long.append(piece)
        self.long_tokens += piece[3] - piece[2]

    def _cut(self, tokens: int) -> list[tuple]:
        """So many tokens of what may be cut."""
        out = []
        self.long_tokens -= tokens
        while tokens:
            doc, ids, start, stop = self.long.popleft()
            cut = min(stop, start + tokens)
            out.append((doc, ids, start, cut))
            tokens -= cut - start
            if cut < stop:
                self.long.appendleft((doc, ids, cut, stop))
        return out

    def pack(self) -> None:
        """Place what waits; leftovers of less than a window stay."""
        shortest, longest = self.tiers[0], self.tiers[-1]
        for tier in self.tiers:
            while self.waiting.longest(tier):
                piece = self.waiting.pop(self.waiting.longest(tier))
                pieces, gap = [piece], tier - (piece[3] - piece[2])
                # two documents of a tier fit into its window in the shortest one only
                for store in ([self.waiting] if tier == shortest else []) + [self.left]:
                    while gap and (n := store.longest(gap)):
                        pieces.append(store.pop(n))
                        gap -= n
                while gap > self.long_tokens and (n := self.waiting.longest(longest)) > tier:
                    self._loosen(self.waiting.pop(n))
                if gap <= self.long_tokens:
                    self._close(pieces + self._cut(gap), tier)
                else:  # nothing to fill it with so far
                    for piece in pieces:
                        self.left.push(piece)
        while self.long_tokens >= longest:
            self._close(self._cut(longest), longest)

    def finish(self) -> None:
        """Pack what is left over by itself; the last window is closed as sequences of powers of two, without padding."""
        self.pack()
        longest = self.tiers[-1]
        while n := self.left.longest(longest):
            pieces, gap = [], longest
            while gap and (n := self.left.longest(gap)):
                pieces.append(self.left.pop(n))
                gap -= n
            for _ in range(2):
                if gap <= self.long_tokens:
                    self._close(pieces + self._cut(gap), longest)
                    pieces = []
                    break
                if n := self.left.longest(longest):  # too long for the gap
                    self._loosen(self.left.pop(n))
            for piece in pieces:
                self._loosen(piece)
        while self.long_tokens:
            size = min(longest, 1 << (self.long_tokens.bit_length() - 1))
            self._close(self._cut(size), size)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def tokenizer(name: str):
    """The byte-level BPE vocabulary file `name`, as a function from a text to its ids.

    The same vocabulary as ranks, which gives the ids of the tokenizer's JSON file beside it several
    times faster (tests compare both). That file's added tokens have their own ids wherever they
    stand in a text.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(name.replace(".tiktoken", ".json")), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    coding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return coding.encode(text, allowed_special="all")
        return coding.encode_ordinary(text)

    return encode


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken",
         end_id: int = 0, tiers: tuple[int, ...] = (128, 256, 512, 1024), step_tokens: int = 1 << 16,
         buffer_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier, step.

    A document is its text's ids and then `end_id`; a NULL or empty text is `end_id` alone, so every
    row has a piece, repeated rows too. Texts are tokenized whole. Every input partition is packed
    on its own, `buffer_tokens` tokens at a time, without a shuffle; sequence ids carry the
    partition's number, and a task that is run again gives the same rows. Documents that fit into a
    window are cut only where nothing longer is left to cut; only the last window of a partition is split, at powers of two.
    An empty table gives no rows. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tiled, waiting = tokenizer(vocabulary), Tiers(tiers, step_tokens), 0
        base = TaskContext.get().partitionId() << 36

        def rows() -> pa.RecordBatch:
            doc, start, length, ids, total, sequence, offset, tier, step = zip(*tiled.take())
            return batch(PIECES, doc_id=doc, start=start, length=length, ids=ids, doc_tokens=total,
                         sequence_id=[base + s for s in sequence], offset=offset, tier=tier,
                         step=[base + s for s in step])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                tiled.add(doc, ids)
                waiting += len(ids)
                if waiting >= buffer_tokens:
                    tiled.pack()
                    waiting = 0
                    yield rows()
        tiled.finish()
        if tiled.out:
            yield rows()

    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step long"
    return pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, kinds)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step")
