"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from auctionflow.llm.common import batch, pick

BUCKETS = 1 << 16
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def ngram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the 1- to 3-grams of letters, None without a letter.

    Text is lower-cased and runs of anything but letters are one space, also at both ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letter = letter | ((points == c) & chr(c).isalpha())
    if not letter.any():
        return None
    spaced = np.concatenate([[32], np.where(letter, points, np.uint32(32)), [32]]).astype(np.uint32)
    spaced = spaced[np.append(True, (spaced[1:] != 32) | (spaced[:-1] != 32))]
    total = np.zeros(BUCKETS, np.int32) if len(spaced) > 1 << 20 else None
    parts = []
    for begin in range(0, len(spaced), 1 << 20):
        c = spaced[begin:begin + (1 << 20) + 2]
        own = min(len(c), 1 << 20)
        value, found = np.zeros(own, np.uint32), []
        for n in range(1, 4):
            value = value[:max(0, min(own, len(c) - n + 1))]
            value = (value + c[n - 1:n - 1 + len(value)]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
            found.append(((value * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16))
        part = np.concatenate(found)
        if total is None:
            parts.append(part)
        else:
            total += np.bincount(part, minlength=BUCKETS).astype(np.int32)
    if total is not None:
        at = np.flatnonzero(total)
        return at.astype(np.uint16), total[at]
    found = np.sort(parts[0], kind="stable")
    first = np.append(0, np.flatnonzero(found[1:] != found[:-1]) + 1)
    return found[first], np.diff(np.append(first, len(found))).astype(np.int32)


def held_out(id_col: str) -> Column:
    """One document in five, by its id; rows without an id are neither held out nor learned from."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


class Ftrl:
    """Multinomial logistic regression trained row by row: follow the regularised leader, with
    per-coordinate steps, an L1 penalty that keeps weights at zero and an L2 penalty."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001):
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes held-back labels most likely, by golden section on its log.

    The labels count as right with probability (n + 1) / (n + 2), so that a sample without an error
    doesn't ask for certainty."""
    rows, classes = scores.shape
    wrong = 1 / (rows + 2)
    aim = np.full(scores.shape, wrong / max(1, classes - 1))
    aim[np.arange(rows), labels] = 1 - wrong

    def loss(t: float) -> float:
        return -(aim * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-300))).sum(axis=1).mean()

    lo, hi, ratio = -5.0, 5.0, (5 ** 0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """Learned languages, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, scale: float):
        self.languages, self.idf, self.weights, self.scale = languages, idf, weights, scale

    def row(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (and the constant's) with unit-length TF-IDF values."""
        at, n = counts
        x = (1 + np.log(n)) * self.idf[at]
        return np.append(at.astype(np.int64), BUCKETS), np.append(x / np.sqrt(x @ x), 1.0)

    def predict(self, counts: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = self.row(counts)
        p = softmax(x @ self.weights[at] / self.scale)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _document_frequency(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs, over all of them; the last value is their number."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, n = letter_table(), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                counts = ngram_counts(text.as_py(), letters)
                if counts is not None:
                    n[counts[0]] += 1
                    n[BUCKETS] += 1
        at = np.flatnonzero(n)
        yield batch(schema, bucket=at.astype(np.int32), n=n[at])

    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[bucket] = n
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = 1500, epochs: int = 3, seed: int = 7) -> Model:
    """A model of the labelled documents that are not held out.

    Document frequencies cover all of them. The weights are fitted on a sample of about
    `per_language` documents of each language, chosen by a hash of the id; a fifth of it is held
    back to set the temperature. The driver gets the sample's n-gram counts and one number per
    bucket, whatever the size of the corpus. Without labelled documents the model knows no language.
    """
    labelled = pick(docs, id_col, text_col, lang_col).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(id AS binary)) % 5 <> 0")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    df = _document_frequency(labelled.select("text"))
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_language / n)) for k, n in rows.items()])
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for b in batches:
            found = [(lang, key, ngram_counts(text.as_py(), letters))
                     for lang, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
            found = [(lang, key, *c) for lang, key, c in found if c is not None]
            yield batch(schema, lang=[f[0] for f in found], key=[f[1] for f in found],
                        at=[f[2].tobytes() for f in found], n=[f[3].tobytes() for f in found])

    sample = labelled.filter(share < wanted).select("lang", F.xxhash64("id", F.lit(seed)).alias("key"), "text")
    taken = sorted(tuple(r) for r in sample.mapInArrow(run, "lang string, key long, at binary, n binary").collect())
    languages = sorted({r[0] for r in taken})
    model = Model(languages, idf, np.zeros((BUCKETS + 1, len(languages))), 1.0)
    ready = [(key, languages.index(lang), *model.row((np.frombuffer(at, np.uint16), np.frombuffer(n, np.int32))))
             for lang, key, at, n in taken]
    ready.sort(key=lambda r: (r[0], r[1]))
    fit, back = [r for r in ready if r[0] % 5], [r for r in ready if r[0] % 5 == 0]
    learner, order = Ftrl(len(languages)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            learner.learn(fit[i][2], fit[i][3], fit[i][1])
    model.weights = learner.weights(slice(None))
    if back:
        model.scale = temperature(np.array([x @ model.weights[at] for _, _, at, x in back]), np.array([r[1] for r in back]))
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred (a learned language, or `und`) and score, columns of that name replaced.

    The prediction reads the whole text and nothing else. `und` and 0 stand for a NULL text, one
    without a letter, and any text if the model knows no language. Equal texts get equal rows; of
    equally likely languages the first in alphabetical order is taken. Empty tables stay empty.
    """
    docs = docs.drop("lang_pred", "score")
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = letter_table(), shared.value
        for b in batches:
            found = [known.predict(ngram_counts(t.as_py(), letters)) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType(docs.schema.fields + added))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                per_language: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    model = train(docs, id_col, text_col, lang_col, per_language)
    rows = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                                               F.col(f"`{text_col}`").alias("text"))
    return identify(rows, model, "text").drop("text")
