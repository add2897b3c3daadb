"""Operators over documents against brute-force versions, and their defined results on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from auctionflow.llm import language, lm_score, merkle, ngram_join, packing, repeats
from tests.llm.conftest import LONG


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# language ---------------------------------------------------------------------------------------

def test_language_held_out_accuracy(tables):
    docs = tables["documents"]
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_not_learned_from_held_out_or_unlabelled(spark):
    rows = [(i, "aaa bbb", "x") for i in range(40)] + [(i, "ccc ddd", "y") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([*rows, (99, "eee", None)], "doc_id long, text string, lang string")
    assert language.train(docs).languages == ["x"]


def test_language_odd_rows(odd, none):
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.language_id(odd).collect()}
    assert {f[1:] for f in found} == {("und", 0.0)}  # no labels: no language is known
    labelled = odd.withColumn("lang", odd["key"])
    rows = language.language_id(labelled).collect()
    assert len(rows) == 11
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6, 8)} == {"k"}
    assert language.language_id(none).collect() == []


def test_language_weights_are_sparse_and_counts_exact():
    letters = language.letter_table()
    at, n = language.ngram_counts("ab ab", letters)
    assert n.sum() == 7 + 6 + 5 and len(at) < 18  # " ab ab " has 7 places, each n-gram counts
    assert language.ngram_counts("1 2!", letters) is None
    long = language.ngram_counts("ab " * 600_000, letters)
    short = language.ngram_counts("ab " * 200, letters)
    assert set(long[0]) == set(short[0]) and long[1].sum() > 5_000_000
    f = language.Ftrl(2)
    for _ in range(50):
        f.learn(np.array([1, 2]), np.array([1.0, 0.0]), 1)
    assert (f.weights(slice(None)) != 0).sum() == 2


# n-gram join -------------------------------------------------------------------------------------

def _components(rows, words, percent):
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().translate(ngram_join.LOWER).split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in by_gram[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for g in sets[i]:
            by_gram[g].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(tables, words, percent):
    docs = tables["documents"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, words, percent).collect()}
    assert got == _components(_pairs(docs), words, percent)


def test_ngram_join_large_family(spark):
    """Near copies of one text, whose links don't all pass through one document, and a chain."""
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in draw.choice(150, draw.integers(0, 5), replace=False):
            w[p] = f"x{draw.integers(60)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):
        chain[i] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == _components(rows, 3, 90)


def test_ngram_join_counts_every_link(spark):
    """Near copies that are all connected through one of them, and copies of some."""
    draw = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        w = list(base)
        for p in draw.choice(150, draw.integers(0, 5), replace=False):
            w[p] = f"x{draw.integers(60)}"
        rows += [(len(rows) + k, " ".join(w)) for k in range(1 + 2 * (i % 9 == 0))]
    sets = {i: {tuple(t.split()[j:j + 3]) for j in range(148)} for i, t in rows}
    want = {i: sum(i != j and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and max(want.values()) > 20
    groups = ngram_join.ngram_groups(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {r["doc_id"]: r["component_id"] for r in got} == {
        i: c for i, (_, c) in _components(rows, 3, 90).items()}


def test_ngram_join_odd_rows(odd, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 2, 8)} <= rows
    assert ngram_join.ngram_join(odd).count() == 11
    assert ngram_join.ngram_join(none).collect() == []


# LM scores ---------------------------------------------------------------------------------------

def test_lm_score_learns_and_is_a_distribution(tables):
    docs = tables["documents"]
    known, network = lm_score.train(docs)
    _, counts = lm_score.vocabulary(docs.select("text"))
    assert counts.sum() == sum(len(lm_score.words(t)) for _, t in _pairs(docs))
    near = np.tile([5, 7, 11, 13, 17, 19], (lm_score.IDS, 1))
    assert abs(np.exp(network.log_probability(near, np.arange(lm_score.IDS))).sum() - 1) < 1e-4
    mean = lambda n: (lambda r: sum(x["log_probability"] for x in r) / sum(x["n_words"] for x in r))(
        lm_score.score(docs, (known, n)).collect())
    assert mean(network) > mean(lm_score.Network.start(counts, 3)) + 0.05


def test_lm_score_equals_word_by_word(tables):
    docs = tables["documents"].limit(5)
    known, network = lm_score.train(docs, rounds=1)
    ids = lm_score.Ids(known)
    for r in lm_score.score(docs, (known, network)).collect():
        text = next(t for i, t in _pairs(docs) if i == r["doc_id"])
        line = [lm_score.IDS] * 3 + [ids[w] for w in lm_score.words(text)] + [lm_score.IDS] * 3
        want = sum(float(network.log_probability(np.array([line[i - 3:i] + line[i + 1:i + 4]]), np.array([line[i]]))[0])
                   for i in range(3, len(line) - 3))
        assert abs(want - r["log_probability"]) < 1e-3 * max(1, abs(want))


def test_lm_score_trains_on_every_word():
    class Seen(lm_score.Network):
        def learn(self, near, target, squares, rate):
            seen.extend(target.tolist())

    seen, texts = [], ["a b c " * 700, None, "", "d a"]
    ids = lm_score.Ids([b"a", b"b", b"c", b"d"])
    assert lm_score.learn_all(Seen({}), texts, ids, {}, 0.1) == 2102
    assert Counter(seen) == {0: 701, 1: 700, 2: 700, 3: 1}


def test_lm_score_tells_rare_words_apart(spark):
    group = defaultdict(list)
    for i in range(5000):
        group[zlib.crc32(f"r{i}".encode()) % (lm_score.IDS - lm_score.KNOWN)].append(f"r{i}")
    six, one, unseen = next(g for g in group.values() if len(g) > 2)[:3]
    docs = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(lm_score.KNOWN)) * 1)] * 8 + [(2, f"{six} " * 6 + one)], "doc_id long, text string")
    counts = lm_score.word_counts(docs.select("text"))
    model = lm_score.train(docs)
    asked = spark.createDataFrame(list(enumerate([six, one, unseen, f"{six} {one}", "k5"])), "doc_id long, text string")
    plain, got = ({r["doc_id"]: r["log_probability"] for r in lm_score.score(asked, model, counts=c).collect()} for c in (None, counts))
    more = [got[i] - plain[i] for i in range(5)]
    assert np.allclose(more, [np.log(6 / 7), np.log(1 / 7), np.log(1 / 8), np.log(6 / 7) + np.log(1 / 7), 0])
    assert {r["n_words"]: r["log_probability"] for r in lm_score.score(docs).collect()}.keys() == {7, lm_score.KNOWN}


def test_lm_score_steps_touch_only_their_words():
    """A step gives the plain gradient's network, and leaves the table of vectors where it is."""
    def plain(p, near, target, squares, rate):
        n, rows = len(target), np.arange(len(target))
        h = np.tanh((p["vectors"][near] * p["places"]).sum(axis=1) + p["hidden"])
        one, two = np.divmod(target, lm_score.SIDE)
        scores = (h @ p["output"][:-1] + p["output"][-1]).reshape(n, 2, -1)
        scores[:, 1] += p["second_bias"][one]
        d = np.exp(scores) / np.exp(scores).sum(axis=2, keepdims=True) / -n
        d[rows, 0, one] += 1 / n
        d[rows, 1, two] += 1 / n
        bias = np.zeros_like(p["second_bias"])
        np.add.at(bias, one, d[:, 1])
        d = d.reshape(n, -1)
        dx = d @ p["output"][:-1].T * (1 - h * h)
        vectors = np.zeros_like(p["vectors"])
        np.add.at(vectors, near, dx[:, None] * p["places"])
        output = np.concatenate([h.T @ d, np.append(d[:, :lm_score.SIDE].sum(axis=0), np.zeros(lm_score.SIDE))[None]])
        for k, g in {"vectors": vectors, "places": (p["vectors"][near] * dx[:, None]).sum(axis=0), "hidden": dx.sum(axis=0),
                     "output": output, "second_bias": bias}.items():
            squares[k] = squares[k] + g * g
            p[k] = p[k] + rate * g / (np.sqrt(squares[k]) + 1e-8)

    draw = random.Random(5)
    names = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(names, k=k)) for k in (1, 700, 2, 0, 5, 400)] + [None, " "] + ["w1"] * 40
    ids = lm_score.Ids([w.encode() for w in names[:200]])
    network = lm_score.Network.start(np.arange(lm_score.IDS, 0, -1.0), 3)
    want = {k: v.astype(np.float64) for k, v in network.p.items()}
    squares, wanted = ({k: np.full(s, 1e-4) for k, s in lm_score.Network.SHAPES.items()} for _ in range(2))
    table = network.p["vectors"]
    assert lm_score.learn_all(network, texts, ids, squares, 0.1) == 1148
    gap, line = [lm_score.IDS] * 3, [lm_score.IDS] * 3
    for t in texts:
        line += [ids[w] for w in lm_score.words(t)] + gap
    line = np.array(line)
    at = np.flatnonzero(line != lm_score.IDS)
    beside = np.array([-3, -2, -1, 1, 2, 3])
    for i in range(0, len(at), lm_score.LEARN):
        places = at[i:i + lm_score.LEARN]
        plain(want, line[places[:, None] + beside], line[places], wanted, 0.1)
    assert all(np.abs(network.p[k] - want[k]).max() < 1e-4 for k in want)
    assert network.p["vectors"] is table


def test_lm_score_common_words_need_no_join(spark, monkeypatch):
    """Shares of words whose counts are sent to the tasks are those that the join gives."""
    draw = random.Random(6)
    names = [f"w{i}" for i in range(lm_score.KNOWN + 2000)]
    texts = [" ".join([*names, *draw.choices(names[-2000:-500], k=400)]) for _ in range(3)] + [f"{names[-1]} once", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm_score.word_counts(docs.select("text"))
    known, totals = [w.encode() for w in names[:lm_score.KNOWN]], np.full(lm_score.IDS - lm_score.KNOWN, 10.0)
    sent = lm_score._common(counts, known, totals)
    assert {w.as_py().decode() for w in sent["word"]} == set(names[lm_score.KNOWN:])
    model = known, lm_score.Network.start(np.ones(lm_score.IDS), 3)
    got = {r["doc_id"]: r["log_probability"] for r in lm_score.score(docs, model, counts=counts).collect()}
    monkeypatch.setattr(lm_score, "COMMON", 1)
    joined = {r["doc_id"]: r["log_probability"] for r in lm_score.score(docs, model, counts=counts).collect()}
    assert got.keys() == joined.keys() and all(abs(got[i] - joined[i]) < 1e-6 * max(1, abs(joined[i])) for i in got)


def test_lm_score_splits_as_bytes_do():
    texts = ["", None, " \t\n", "a  B c\x0bd\x0ce", " x ", "\u00c9t\u00e9\u00a0\u2003z\x1cy\x85", "one"]
    found, sizes = lm_score.split(texts)
    assert found.to_pylist() == [w for t in texts for w in lm_score.words(t)]
    assert sizes.tolist() == [len(lm_score.words(t)) for t in texts]


def test_lm_score_odd_rows(odd, none):
    rows = lm_score.score(odd).collect()
    assert len(rows) == 11
    assert {(r["n_words"], r["log_probability"], r["per_word"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 0.0, None)}
    assert {r["n_words"] for r in rows if r["doc_id"] == 4} == {40_000}
    assert lm_score.score(none).collect() == []


# repeats -----------------------------------------------------------------------------------------

def _removed(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, tree", [(400, 4096), (400, 1), (150, 4096)])
def test_remove_repeats_equals_brute_force(tables, length, tree):
    docs = tables["documents"]
    got = repeats.digest(repeats.remove_repeats(docs, length, tree=tree)).collect()
    assert sorted(map(tuple, got), key=str) == _removed(_pairs(docs), length)


def test_remove_repeats_within_and_across(spark):
    draw = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + c) for c in draw.integers(0, 26, n))
    a, b, c = word(500), word(700), word(300)
    rows = [(1, word(50) + a + word(80) + a + word(9)), (2, b + word(100)), (3, word(200) + b[100:600] + word(7)), (4, c), (5, c + "é" * 300),
            (6, "é" * 500), (7, a[:399]), (8, b[:50] + word(1) + b[51:450]), (8, word(60)), (9, "z" * 450), (10, word(300_000) + a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.digest(repeats.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=str) == _removed(rows, 400)


def test_repeats_lists_all_occurrences(spark):
    text = " ".join(f"w{i * i % 997}" for i in range(120))[:450]
    rows = [(i, "ABCDEF"[i] * 80 + text + "GHIJKL"[i] * 45) for i in range(6)]
    found = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(set)
    for r in found:
        assert (rows[r["doc_id"]][1][r["start"]:r["stop"]]) in text
        by[r["repeat"]].add(r["doc_id"])
    assert set(range(6)) in by.values()


def test_remove_repeats_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 3, 0), (4, 200_000, 200_000), (5, 200_000, 200_000), (6, 3, 0), (None, 18, 0)} <= got
    assert repeats.remove_repeats(odd).count() == 11
    assert repeats.remove_repeats(none).collect() == []


# packing -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_is_an_exact_cut(tables, tokens):
    docs = tables["documents"]
    texts = dict(_pairs(docs))
    rows = packing.digest(packing.pack(docs, buffer_tokens=20_000)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*tokens(text or ""), 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 1024 and at <= pieces[0]["tier"]
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    steps = Counter()
    for pieces in by_sequence.values():
        steps[pieces[0]["tier"], pieces[0]["step"]] += pieces[0]["tier"]
    assert max(steps.values()) <= 1 << 16


def test_packing_vocabularies_agree(tokens):
    encode = packing.tokenizer("byte_bpe_50k.tiktoken")
    for text in ("It's 12 o'clock!  \n\n x", "naïve Übermut, ça va? 北京 🙂", "a" * 3000, " \t \x00 end ", "THE!! && ###"):
        assert encode(text) == tokens(text)


def test_packing_knows_added_tokens(spark, tokens):
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext|", "it's  <|endoftext|>  12\n"]
    encode = packing.tokenizer("byte_bpe_50k.tiktoken")
    assert encode(texts[0]) == [64, 50256, 65]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        assert encode(text) == tokens(text)
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert list(memoryview(b"".join(p for _, p in pieces)).cast("I")) == [*tokens(text), 0]


def test_packing_odd_rows(odd, none):
    rows = packing.digest(packing.pack(odd)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 4)
    assert len([r for r in rows if r["doc_id"] == 6 and r["start"] == 0]) == 2
    assert packing.pack(none).collect() == []


# fingerprints ------------------------------------------------------------------------------------

def test_fingerprints_of_edits_and_neighbours(tables):
    docs = tables["documents"]
    ordered = sorted(_pairs(docs), reverse=True)
    got = {r["doc_id"]: r for r in merkle.compared(docs).collect()}
    prints, likely = {}, []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        likely.append(got[i]["near_edited"] >= got[i]["near_next"])
    assert len(set(prints.values())) == len(prints)
    assert sum(likely) >= 0.97 * len(likely)


def test_fingerprint_locates_an_edit(spark):
    from pyspark.sql import functions as F

    lines = [f"This is line {i}. It has words." for i in range(200)]
    other = [*lines]
    other[120] = "Something else stands here."
    row = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(
        merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = row.select(merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.differing_sections(F.col("a"), F.col("b")).alias("at"),
                     F.size(F.split(F.element_at(F.split("a", "/"), 2), ",")).alias("sections")).first()
    assert 0.95 < got["near"] < 1 and len(got["at"]) == 1 and got["sections"] > 4


def test_fingerprints_odd_rows(odd, none):
    rows = merkle.compared(odd).collect()
    assert len(rows) == 11 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert {r["n_chars"] for r in rows if r["doc_id"] == 4} == {len(LONG)}
    assert merkle.compared(none).collect() == []
    assert merkle.compared(odd.filter("doc_id = 8")).first()["near_next"] == 1.0


def test_tiles_torn_over_tasks_keep_all_members(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    g = np.random.default_rng(1)
    rows = [(int(k), int(d)) for k, d in {(int(g.integers(40)) ** 2, int(g.integers(500))) for _ in range(300)}]
    rows += [(777, i) for i in range(2000)] + [(10_000 + i, i) for i in range(400)]
    got = ngram_join._members(own.createDataFrame(rows, "key long, doc_id long")).collect()
    tiles, found = defaultdict(set), defaultdict(set)
    for k, d in rows:
        tiles[k].add(d)
    for r in got:
        found[r["key"]].add(r["doc_id"])
        if r["whole"]:
            assert [r["first"], r["second"]] == sorted(tiles[r["key"]])[:2]
    assert {k: v for k, v in found.items() if len(v) > 1} == {k: v for k, v in tiles.items() if len(v) > 1}
    assert len(got) == sum(map(len, found.values())) and len(got) < len(rows) - 250
    assert not any(r["whole"] for r in got if r["key"] == 777) and len({r["first"] for r in got if r["key"] == 777}) > 1


def test_ngram_join_with_torn_tiles_equals_brute_force(spark, tables):
    docs = tables["documents"].select("doc_id", "text")
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "40")
    frame = own.createDataFrame(docs.collect(), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(frame, 5, 80).collect()}
    want = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_groups(docs, 5, 80).collect()}
    assert got == want


def _words(seed, n):
    g = np.random.default_rng(seed)
    return "".join(chr(97 + int(c)) for c in g.integers(0, 26, n))


def _groups(df):
    by = defaultdict(set)
    for r in df.collect():
        by[r["repeat"], r["stop"] - r["start"]].add((r["doc_id"], r["start"]))
    return by


def test_repeats_nested_in_longer_ones_list_everybody(spark):
    inner = _words(1, 500)
    outer = _words(2, 50) + inner + _words(3, 50)
    rows = [(1, _words(4, 100) + outer + _words(5, 100)), (2, _words(6, 200) + outer + _words(7, 80)), (3, _words(8, 60) + inner + _words(9, 300))]
    got = _groups(repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    members = {frozenset(d for d, _ in v) for v in got.values()}
    assert members == {frozenset({1, 2, 3}), frozenset({1, 2})}
    for (_, n), places in got.items():  # one string each
        assert len({rows[d - 1][1][s:s + n] for d, s in places}) == 1


def test_repeats_of_copied_texts_list_everybody(spark):
    inner = _words(1, 500)
    whole = _words(2, 50) + inner + _words(3, 50)
    rows = [(1, whole), (2, whole), (3, _words(8, 60) + inner + _words(9, 300)), (4, _words(10, 900))]
    got = _groups(repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    members = {frozenset(d for d, _ in v) for v in got.values()}
    assert members == {frozenset({1, 2, 3}), frozenset({1, 2})}


def test_groups_of_one_anchor_are_all_maximal_repeats():
    g = np.random.default_rng(11)
    for _ in range(60):
        n = int(g.integers(2, 9))
        left = [bytes(g.integers(97, 99, int(g.integers(0, 7))).tolist()) for _ in range(n)]
        right = [b"##" + bytes(g.integers(97, 99, int(g.integers(0, 7))).tolist()) for _ in range(n)]
        texts = {(l, r) for l, r in zip(left, right)}
        left, right = [l for l, _ in texts], [r for _, r in texts]
        found = repeats.RepeatGroups(right, left, 4)
        got = {(l, h, frozenset(i for i in range(len(left)) if a <= found.left_rank[i] <= b and c <= found.right_rank[i] <= d))
               for l, h, a, b, c, d in found.groups}
        want = set()
        for l in range(8):
            for h in range(2, 10):
                by = defaultdict(set)
                for i, (x, y) in enumerate(zip(left, right)):
                    if len(x) >= l and len(y) >= h:
                        by[x[:l], y[:h]].add(i)
                for who in by.values():
                    ahead = {right[i][h:h + 1] or i.to_bytes(2) for i in who}
                    behind = {left[i][l:l + 1] or i.to_bytes(2) for i in who}
                    if len(who) > 1 and l + h >= 4 and len(ahead) > 1 and len(behind) > 1:
                        want.add((l, h, frozenset(who)))
        # places whose text ends on one side count as differing there
        assert got == want


def test_repeat_tables_grow_with_the_texts_only(spark):
    """Near copies of each other share nested repeats; the two tables stay linear, the pairs are not."""
    base = _words(1, 600)
    rows = [(i, base[:100 + i] + _words(50 + i, 3) + base[103 + i:]) for i in range(120)]
    groups, members = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    n = members.count()
    assert groups.count() <= 4 * n
    assert members.join(groups, "anchor").count() > 20 * n


def test_packing_keeps_documents_whole_and_in_their_tier():
    draw = np.random.default_rng(2)

    def packed(sizes, buffer=1 << 20):
        tiled, waiting, out = packing.Tiers((128, 256, 512, 1024), 1 << 16), 0, []
        for i, n in enumerate(sizes):
            tiled.add(i, np.arange(n, dtype="<u4"))
            waiting += n
            if waiting >= buffer:
                tiled.pack()
                out, waiting = out + tiled.take(), 0
        tiled.finish()
        pieces, full = defaultdict(list), Counter()
        for doc, start, length, ids, total, sequence, offset, tier, _ in out + tiled.take():
            assert offset == full[sequence] and total == sizes[doc]
            full[sequence] += length
            pieces[doc].append((start, length, tier, np.frombuffer(ids, "<u4")))
        assert all(n & (n - 1) == 0 for n in full.values())
        for i, n in enumerate(sizes):
            assert np.concatenate([p[3] for p in sorted(pieces[i], key=lambda p: p[0])]).tolist() == list(range(n))
        short = [i for i, n in enumerate(sizes) if n <= 1024]
        whole = [i for i in short if len(pieces[i]) == 1]
        own = [i for i in whole if pieces[i][0][2] == next(t for t in (128, 256, 512, 1024) if t >= sizes[i])]
        return len(whole) / max(1, len(short)), len(own) / max(1, len(short))

    assert packed([int(n) for n in draw.integers(1, 1500, 3000)]) == (1.0, 1.0)  # what is too long fills the gaps
    assert packed([int(n) + 1 for n in draw.lognormal(5, 1.2, 3000)]) == (1.0, 1.0)
    whole, own = packed([int(n) for n in draw.integers(1, 1000, 3000)])  # nothing is too long: some have to be cut
    assert whole > 0.8 and own > 0.8
    for _ in range(200):
        packed([int(n) for n in draw.integers(1, draw.choice([3, 130, 600, 3000]), draw.integers(0, 40))], int(draw.choice([500, 5000, 1 << 20])))


def _print(text):
    """The fingerprint of a text, level by level, and its leaves."""
    hashed = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    paragraphs, leaves = [], []
    for line in text.split("\n"):
        own = []
        for m in re.finditer(r"\s*(?:\S*[^\s.!?]\s+){0,3}\S+|\s+\Z", line, re.A):
            own.append(f"{xxhash.xxh64_intdigest(m[0].encode(), seed=42):016x}")
        paragraphs.append(hashed(",".join(own), 32))
        leaves += own
    sections, part = [], []
    for i, p in enumerate(paragraphs):
        part.append(p)
        if p[0] == "0" or i + 1 == len(paragraphs):
            sections.append(hashed(",".join(part), 64))
            part = []
    leaves = [x[:8] for x in leaves]
    return "/".join([hashed(",".join(sections), 64), ",".join(s[:16] for s in sections), ",".join(leaves)]), leaves


def test_fingerprints_equal_trees_built_anew(spark, tables):
    texts = [(i, t or "") for i, t in _pairs(tables["documents"]) if i % 7 == 0]
    texts += [(10_000 + i, t) for i, t in enumerate(["", " ", "one", "a b c d e. f\n\n g! h\n", "\n" * 40, "é ü.\tx\r\nß " * 30])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.compared(docs).collect()}
    ordered = sorted(texts, reverse=True)
    like = lambda a, b: 1.0 if a[0].split("/")[0] == b[0].split("/")[0] else (
        2 * len(set(a[1] or [""]) & set(b[1] or [""])) / (len(set(a[1] or [""])) + len(set(b[1] or [""]))))
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        own, edited, following = _print(text), _print(text[:len(text) - half] + after[:half]), _print(after)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own[0], edited[0]), text
        assert abs(got[i]["near_edited"] - like(own, edited)) < 1e-9 and abs(got[i]["near_next"] - like(own, following)) < 1e-9


def test_language_equals_a_score_worked_out_gram_by_gram(tables):
    """Every prediction from its definition: n-grams of letters, their buckets, TF-IDF, weights, temperature."""
    docs = tables["documents"]
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}

    def bucket(gram):
        value = 0
        for c in gram:
            value = (value + ord(c)) * 0x9E3779B1 % 2**32
            value ^= value >> 15
        return (value * 0x85EBCA6B % 2**32) >> 16

    for i, text in _pairs(docs):
        spaced = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        n = Counter(bucket(spaced[j:j + k]) for k in (1, 2, 3) for j in range(len(spaced) - k + 1))
        x = {b: (1 + np.log(c)) * model.idf[b] for b, c in n.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        scores = sum(v / size * model.weights[b] for b, v in x.items()) + model.weights[language.BUCKETS]
        p = np.exp((scores - scores.max()) / model.scale)
        p /= p.sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-6
