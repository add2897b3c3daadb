"""Document scores by masked pseudo-likelihood: each word predicted from the words on both sides."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.common import LOWER, batch, pick
from auctionflow.session import fits_broadcast, store

SIDE = 64               # an id is two digits to this base
IDS = SIDE * SIDE
KNOWN = 3 * IDS // 4    # ids of frequent words; the others stand for groups of rare ones
REACH = 3               # words on either side
WIDTH = 16              # hidden units
STEP = 1024             # words scored at a time
LEARN = 512             # words of one step of the training
COMMON = 1 << 19        # a word with one in so many of the rare words' occurrences is common: tasks are sent its count
SHARD = 4096            # parameters of one row on their way to the sum


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has; the same words as `words`."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    lists = pc.ascii_split_whitespace(lower)
    full = pc.not_equal(lower, "").to_numpy(zero_copy_only=False)  # a blank text is split into one empty word
    sizes = np.where(full, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    found = lists.flatten().cast(pa.large_binary()).cast(pa.binary())
    return found if full.all() else found.filter(pc.greater(pc.binary_length(found), 0)), sizes


def shared_id(word: bytes) -> int:
    return KNOWN + crc32(word) % (IDS - KNOWN)


def shared_ids(words: pa.Array) -> np.ndarray:
    return KNOWN + np.fromiter(map(crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % (IDS - KNOWN)


class Ids(dict):
    """Word to id: frequent words have one of their own, rare ones share by checksum. `common` are rare words to look up
    rather than to compute."""

    def __init__(self, known: list[bytes], common: pa.Array | None = None):
        super().__init__((w, i) for i, w in enumerate(known))
        common = pa.array([], pa.binary()) if common is None else common
        self.table = pa.concat_arrays([pa.array(known, pa.binary()), common])
        self.ids = np.concatenate([np.arange(len(known)), shared_ids(common)]).astype(np.int32)

    def __missing__(self, word: bytes) -> int:
        return shared_id(word)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        """The ids of all words and their places in the table, -1 for the others; where these are, and they as a dictionary array."""
        found = pc.fill_null(pc.index_in(words, value_set=self.table), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found < 0)
        others = words.take(pa.array(at)).dictionary_encode()
        ids = np.append(self.ids, np.int32(0)).take(found, mode="wrap")
        ids[at] = shared_ids(others.dictionary)[others.indices.to_numpy()]
        return ids, found, at, others


class Network:
    """Window network: hidden = tanh(sum of the neighbours' vectors, scaled by place, + bias).

    A word's id has two digits. The first is predicted from the hidden units, the second from them
    and the first, so that all ids' probabilities add up to 1. The digits' biases start from the
    corpus counts, so an untrained network is the unigram model. `output` has the weights of both digits side by
    side, and the first one's biases in its last row.
    """

    SHAPES = {"vectors": (IDS + 1, WIDTH), "places": (2 * REACH, WIDTH), "hidden": (WIDTH,), "output": (WIDTH + 1, 2 * SIDE),
              "second_bias": (SIDE, SIDE)}

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def start(cls, counts: np.ndarray, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        vectors, _, _, first, _, second = ((draw.standard_normal(s) * 0.1).astype(np.float32) for s in (
            (IDS + 1, WIDTH), (2 * REACH, WIDTH), WIDTH, (WIDTH, SIDE), SIDE, (WIDTH, SIDE)))
        n = counts.reshape(SIDE, SIDE) + 0.1
        biases = np.append(np.log(n.sum(axis=1) / n.sum()), np.zeros(SIDE)).astype(np.float32)
        return cls({"vectors": vectors, "places": np.ones(cls.SHAPES["places"], np.float32), "hidden": np.zeros(WIDTH, np.float32),
                    "output": np.concatenate([np.concatenate([first, second], axis=1), biases[None]]),
                    "second_bias": np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Network:
        p, at = {}, 0
        for k, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            p[k] = values[at:at + n].reshape(shape).astype(np.float32)
            at += n
        return cls(p)

    def _units(self, x: np.ndarray) -> np.ndarray:
        """Hidden units of what goes into them, and a unit that is always 1."""
        h = np.ones((len(x), WIDTH + 1), np.float32)
        np.tanh(x, out=h[:, :WIDTH])
        return h

    def _inputs(self, around: np.ndarray) -> np.ndarray:
        """What goes into the hidden units of all words of a stream with REACH words on either side, from the stream's vectors."""
        before, after = _beside(around)
        return (np.einsum("njk,jk->nk", before, self.p["places"][:REACH]) + np.einsum("njk,jk->nk", after, self.p["places"][REACH:])
                + self.p["hidden"])

    def _scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = (h @ self.p["output"]).reshape(-1, 2, SIDE)
        scores[:, 1] += self.p["second_bias"].take(first, axis=0)
        return scores

    def _digits(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each target: its first digit, the indexes of both digits' scores, both logarithms, both digits' distributions."""
        first, second = np.divmod(target, SIDE)
        scores = self._scores(h, first)
        own = np.arange(0, scores.size, SIDE).reshape(-1, 2) + np.stack([first, second], axis=1)
        logs = scores.ravel().take(own)
        sums = np.exp(scores, out=scores).reshape(-1, SIDE) @ np.ones(SIDE, np.float32)
        if len(sums) and not (sums.min() > 1e-30 and sums.max() < 1e30):  # out of the range of plain floats
            scores = self._scores(h, first)
            scores -= scores.max(axis=2, keepdims=True)
            logs = scores.ravel().take(own)
            sums = np.exp(scores, out=scores).reshape(-1, SIDE) @ np.ones(SIDE, np.float32)
        sums = sums.reshape(-1, 2)
        return first, own, logs - np.log(sums), scores, sums

    def log_probability(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        x = (self.p["vectors"][near] * self.p["places"]).sum(axis=1) + self.p["hidden"]
        return self._digits(self._units(x), target)[2].sum(axis=1, dtype=np.float64)

    def along(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same for the words at places `at` of a stream: each word's vector is looked up once."""
        x = self._inputs(self.p["vectors"].take(stream, axis=0))
        return self._digits(self._units(x if len(at) == len(x) else x[at - REACH]), stream[at])[2].sum(axis=1, dtype=np.float64)

    def learn(self, near: tuple[np.ndarray, np.ndarray], target: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> None:
        """One step along the gradient of the mean log-probability, sized by the squares so far.

        `near` is a stream and the targets' places in it. The gradient of a word's vector is added up over its
        neighbours along the stream first, then by word; the vectors of other words stay as they are."""
        p, n, (stream, at) = self.p, len(target), near
        around = p["vectors"].take(stream, axis=0)
        x = self._inputs(around)
        h = self._units(x if n == len(x) else x[at - REACH])
        first, own, _, d, sums = self._digits(h, target)
        d *= (np.float32(-1 / n) / sums)[:, :, None]
        d.ravel()[own] += np.float32(1 / n)
        d = d.reshape(n, 2 * SIDE)
        units = h[:, :WIDTH]
        dx = np.zeros((len(stream) + 2 * REACH, WIDTH), np.float32)  # by place in the stream, with room on both sides
        dx[at + REACH] = (d @ p["output"][:WIDTH].T) * (1 - units * units)
        inner = dx[2 * REACH:len(stream)]
        before, after = _beside(dx)
        back = p["places"][::-1]
        outer = np.einsum("njk,jk->nk", before, back[:REACH]) + np.einsum("njk,jk->nk", after, back[REACH:])
        output = h.T @ d
        output[WIDTH, SIDE:] = 0
        gradient = {"places": np.concatenate([np.einsum("njk,nk->jk", x, inner) for x in _beside(around)]), "hidden": inner.sum(axis=0),
                    "output": output, "second_bias": EYE.take(first, axis=0).T @ d[:, SIDE:]}
        for k, g in gradient.items():
            squares[k] += g * g
            p[k] += rate * g / (np.sqrt(squares[k]) + 1e-8)
        order = np.arange(len(stream))
        last = np.empty(IDS + 1, np.int64)
        last[stream] = order  # one place of each word stands for it
        of = last.take(stream)
        chosen = np.flatnonzero(of == order)
        ids = stream[chosen]
        g = np.bincount((of[:, None] * WIDTH + np.arange(WIDTH)).ravel(), outer.ravel(), len(stream) * WIDTH)
        g = g.reshape(-1, WIDTH).take(chosen, axis=0).astype(np.float32)
        size = squares["vectors"].take(ids, axis=0) + g * g
        squares["vectors"][ids] = size
        p["vectors"][ids] = around.take(chosen, axis=0) + rate * g / (np.sqrt(size) + 1e-8)


def _beside(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row with REACH rows on either side, those before it and those after it, as views."""
    step = rows.strides[0]
    shape, strides = (len(rows) - 2 * REACH, REACH, rows.shape[1]), (step, step, rows.strides[1])
    return (np.ndarray(shape, rows.dtype, rows, 0, strides), np.ndarray(shape, rows.dtype, rows, (REACH + 1) * step, strides))


def _windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array with room between them, and the places of words."""
    room = REACH * np.cumsum(sizes > 0)
    places = np.arange(len(ids)) + np.repeat(room, sizes)
    stream = np.full(len(ids) + REACH + (room[-1] if len(room) else 0), IDS, np.int32)
    stream[places] = ids
    return stream, places


EYE = np.eye(SIDE, dtype=np.float32)


def _parts(stream: np.ndarray, places: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`step` places at a time: the piece of the stream that holds their neighbours, and the places in it."""
    for i in range(0, len(places), step):
        at = places[i:i + step]
        yield stream[at[0] - REACH:at[-1] + REACH + 1], at - (at[0] - REACH)


def _groups(batches: Iterator[pa.RecordBatch], at: int, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows in slices of about `chars` characters."""
    for b in batches:
        start, texts, size = 0, [], 0
        for i, text in enumerate(b.column(at)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= chars or i + 1 == b.num_rows:
                yield b.slice(start, len(texts)), texts
                start, texts, size = i + 1, [], 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, added up in each task before the shuffle, a bounded number at a time."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 0, 1 << 23):
            found = split(group)[0].value_counts()
            yield batch(schema, word=found.field("values"), n=found.field("counts"))

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, counts: DataFrame | None = None) -> tuple[list[bytes], np.ndarray]:
    """The KNOWN most frequent words of the corpus and the count of every id, over all texts."""
    counts = counts or store(word_counts(texts), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = [bytes(r["word"]) for r in top]
    n = np.zeros(IDS)
    n[:len(known)] = [r["n"] for r in top]
    n[KNOWN:] = _shared(counts, known)
    return known, n


def _shared(counts: DataFrame, known: list[bytes]) -> np.ndarray:
    """How often the words of each shared id occur."""
    n = np.zeros(IDS)
    group = F.lit(KNOWN) + F.crc32("word") % (IDS - KNOWN)
    for r in counts.groupBy(group.alias("id")).agg(F.sum("n").alias("n")).collect():
        n[r["id"]] = r["n"]
    for r in counts.filter(F.col("word").isin(known)).collect() if known else ():
        n[shared_id(bytes(r["word"]))] -= r["n"]
    return np.maximum(n[KNOWN:], 0)


def _common(counts: DataFrame, known: list[bytes], totals: np.ndarray) -> pa.Table:
    """The rare words with at least one in COMMON of the rare words' occurrences, so at most COMMON words, and their counts."""
    often = counts.filter(F.col("n") >= max(2, float(totals.sum()) / COMMON)).select("word", "n").toArrow()
    often = often.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())]))
    return often.filter(pc.invert(pc.is_in(often["word"], value_set=pa.array(known, pa.binary()))))


def learn_all(network: Network, texts: list[str | None], ids: Ids, squares: dict[str, np.ndarray], rate: float) -> int:
    """Train on every word of the texts; the number of words."""
    found, sizes = split(texts)
    stream, places = _windows(ids.of(found)[0], sizes)
    for part, at in _parts(stream, places, LEARN):
        network.learn((part, at), part[at], squares, rate)
    return len(places)


def _round(texts: DataFrame, known: list[bytes], start: Network, rate: float) -> Network:
    """Every task goes on from `start` over all words of its part; the results are averaged,
    weighted by their words."""
    sent = texts.sparkSession.sparkContext.broadcast((known, start.flat()))
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])
    kinds = "shard int, part int, weight double, values binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        ids, network, total = Ids(known), Network.from_flat(values), 0
        squares = {k: np.full(s, 1e-4, np.float32) for k, s in Network.SHAPES.items()}
        for _, group in _groups(batches, 0):
            total += learn_all(network, group, ids, squares, rate)
        if total:
            flat = network.flat().astype(np.float64) * total
            shards = range(0, len(flat), SHARD)
            yield batch(schema, shard=[i // SHARD for i in shards], part=[TaskContext.get().partitionId() % 64] * len(shards),
                        weight=[float(total)] * len(shards), values=[flat[i:i + SHARD].tobytes() for i in shards])

    def add(table: pa.Table) -> pa.Table:
        values = sum(np.frombuffer(v.as_py(), np.float64) for v in table["values"])
        return pa.table({"shard": table["shard"][:1], "part": table["part"][:1],
                         "weight": pa.array([sum(table["weight"].to_pylist())]), "values": pa.array([values.tobytes()], pa.binary())}, schema=schema)

    sums = texts.mapInArrow(run, kinds).groupBy("shard", "part").applyInArrow(add, kinds).groupBy("shard").applyInArrow(add, kinds)
    rows = sorted(sums.collect(), key=lambda r: r["shard"])
    return Network.from_flat(np.concatenate([np.frombuffer(r["values"], np.float64) / r["weight"] for r in rows])) if rows else start


def train(docs: DataFrame, text_col: str = "text", rounds: int = 1, rate: float = 0.1, seed: int = 3,
          counts: DataFrame | None = None) -> tuple[list[bytes], Network]:
    """Vocabulary and network of a corpus.

    Counts (`word_counts`, if given) cover all words of all texts, and in each round every task
    predicts each word of the texts of its part. The tasks' networks are averaged in Spark, so that
    they depend on how the texts are dealt to tasks; the driver sees the vocabulary and one network,
    both of a fixed size."""
    texts = pick(docs, text_col)
    known, of_ids = vocabulary(texts, counts)
    network = Network.start(of_ids, seed)
    for _ in range(rounds):
        network = _round(texts, known, network, rate)
    return known, network


def score(docs: DataFrame, model: tuple[list[bytes], Network] | None = None, id_col: str = "doc_id", text_col: str = "text",
          counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_probability (sum of ln p of each word given the words around it),
    per_word (their mean) of every row.

    A word that shares its id has the id's probability times its share of the id's words in `counts`
    (`word_counts` of the model's corpus); a word that isn't there counts as if it were there once.
    With a `model` but no `counts`, such a word has the probability of its id.

    Words are runs of non-blank bytes with A-Z lower-cased; texts are scored whole. A NULL, empty or
    blank text has 0 words, 0.0 and NULL. Equal texts have equal scores up to rounding; one row per
    input row, an empty table gives none; other columns are not read."""
    if model is None:
        counts = store(word_counts(pick(docs, text_col)), "words")
        model = train(docs, text_col, counts=counts)
    known, network = model
    totals, common = np.zeros(IDS - KNOWN), None
    if counts is not None:
        totals = _shared(counts, known)
        common = _common(counts, known, totals)
    sent = docs.sparkSession.sparkContext.broadcast((known, network.flat(), totals, common))
    rare = pa.struct([("word", pa.binary()), ("times", pa.int64()), ("total", pa.float64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_probability", pa.float64()),
                        ("rare", pa.list_(rare))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values, totals, common = sent.value
        net, row = Network.from_flat(values), TaskContext.get().partitionId() << 36
        ids = Ids(known, None if common is None else common["word"].combine_chunks())
        shares = np.zeros(len(ids.table) + 1)  # the last one is that of words outside the table
        if common is not None:
            shares[len(known):-1] = np.log(common["n"].to_numpy()) - np.log(totals[ids.ids[len(known):] - KNOWN])
        for rows, group in _groups(batches, 1):
            found, sizes = split(group)
            own, place, at, others = ids.of(found)
            chances = [net.along(part, places) for part, places in _parts(*_windows(own, sizes), STEP)]
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate([*chances, np.zeros(0)]) + shares.take(place, mode="wrap"))])
            stop = np.cumsum(sizes)
            total = sums[stop] - sums[stop - sizes]
            # the other words of each text, with how often they occur in it
            pairs, times = np.unique(np.searchsorted(stop, at, "right") * len(found) + others.indices.to_numpy(), return_counts=True)
            text, code = np.divmod(pairs, max(len(found), 1))
            ends = np.searchsorted(text, np.arange(len(group) + 1)).astype(np.int32)
            shared = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [others.dictionary.take(pa.array(code)), pa.array(times, pa.int64()),
                 pa.array(totals[shared_ids(others.dictionary)[code] - KNOWN], pa.float64())], fields=list(rare)))
            yield batch(schema, row=row + np.arange(len(group)), doc_id=rows.column(0), n_words=sizes, log_probability=total,
                        rare=shared)
            row += len(group)

    kinds = "row long, doc_id long, n_words long, log_probability double, rare array<struct<word binary, times long, total double>>"
    scored = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")).mapInArrow(run, kinds)
    own = F.col("log_probability")
    if counts is not None:
        scored = store(scored, "scored")
        words_of = scored.select("row", F.inline("rare"))
        share = F.when(F.col("n").isNull(), -F.log(F.col("total") + 1)).otherwise(F.log("n") - F.log("total"))
        shares = words_of.join(F.broadcast(counts) if fits_broadcast(counts, 500_000) else counts, "word", "left").groupBy("row").agg(
            F.sum(F.col("times") * share).alias("share"))
        scored = scored.drop("rare").join(shares, "row", "left")
        own = own + F.coalesce("share", F.lit(0.0))
    return scored.select("doc_id", "n_words", own.alias("log_probability")).withColumn(
        "per_word", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
