"""Search and compression of vectors against brute-force versions, and their results on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from auctionflow.llm import codes, topk

FIELDS = "vec_id long, embedding array<float>, label int, score double, rank int, code string, cell int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 7, "x", 1) for i, v, l in rows], FIELDS)


def _whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def _search(rows, k, every, scale):
    kept = [(i, _whole(v, scale)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, qv in {(i, tuple(v)) for i, v in kept}:
        if q is not None and q % every == 0:
            scored = [(-sum(a * b for a, b in zip(qv, v)), math.inf if i is None else i) for i, v in kept if i != q]
            out.setdefault(q, []).extend((q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k]))
    return sorted(sum(out.values(), []), key=str)


def _found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_search_is_exact(spark, spread):
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] + spread * g.normal(size=12)).tolist()) for i in range(3000)]
    df = _frame(spark, [(i, v, 0) for i, v in rows])
    assert _found(topk.search(df, every=50)) == _search(rows, 10, 50, 1024)


def test_search_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(2500)] + [(5000, [2.0, 0.0]), (6000, [-3.0, 0.0])]
    df = _frame(spark, [(i, v, 0) for i, v in rows])
    assert _found(topk.search(df, every=500)) == _search(rows, 10, 500, 1024)


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []),
            (None, [3.0, 1.0]), (None, [3.0, 1.0]), (6, [1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 9.0]), (-100, [0.5, -0.5])]
    padded = [(i, None if v is None else v + [0.0] * (3 - len(v))) for i, v in rows]
    assert _found(topk.search(_frame(spark, [(i, v, 1) for i, v in rows]))) == _search(padded, 10, 100, 1024)
    assert topk.search(_frame(spark, [])).collect() == []
    assert topk.search(_frame(spark, [(0, None, 1)])).collect() == []
    assert topk.search(_frame(spark, [(0, [1.0], 1)])).collect() == []  # nobody else
    assert topk.search(_frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])).collect() == []  # nobody asks


def test_search_stops_early_and_fails_rather_than_round(spark):
    g = np.random.default_rng(2)
    rows = np.concatenate([g.normal(size=(500, 8)), g.normal(size=(500, 8)) + 40]).round(2) * 100 // 1
    pivots = topk.choose_pivots(rows[::7])
    d, norms = topk.distances(rows, pivots), (rows * rows).sum(1)
    starts, ids = np.array([0, 500, 1000]), np.arange(1000)
    lo, hi = (np.stack([f(d[a:b], 0) for a, b in zip(starts, starts[1:])]) for f in (np.min, np.max))
    places, scores, seen = topk.search_shard(rows[700], norms[700], d[700], 700, -np.inf, 5, rows, norms, d, ids, lo, hi, starts)
    all_scores = rows @ rows[700]
    all_scores[700] = -np.inf
    assert scores.tolist() == np.sort(all_scores)[::-1][:5].tolist() and seen < 500
    known = scores[-1]
    assert topk.search_shard(rows[700], norms[700], d[700], 700, known, 5, rows, norms, d, ids, lo, hi, starts)[0].tolist() == places.tolist()
    with pytest.raises(Exception, match="too large"):
        topk.search(_frame(spark, [(0, [3e30], 0), (1, [1.0], 0)])).collect()


def _compress(rows, parts, entries, scale, rounds):
    rows = sorted(((math.inf if i is None else i), v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = max(-(-max(len(v) for _, v, _ in rows) // parts) * parts, parts)
    whole = [_whole(v, scale) + [0] * (width - len(v)) for _, v, _ in rows]
    w = width // parts
    books = [[r[p * w:p * w + w] for r in whole[:entries]] for p in range(parts)]
    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p * w:p * w + w], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for r in whole]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [r[p * w:p * w + w] for r, a in zip(whole, near) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    sums = {}
    for (_, _, label), a in zip(rows, near):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((None if i == math.inf else i), "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), sums[label], sha)
                  for (i, _, label), a in zip(rows, near)) if all(i != math.inf for i, _, _ in rows) else sorted(
        (("" if i == math.inf else str(i)), "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), sums[label], sha) for (i, _, label), a in zip(rows, near))


def _coded(df, text=False):
    rows = df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((("" if r[0] is None else str(r[0])) if text else r[0], *r[1:]) for r in rows)


def test_codes_equal_full_scans(spark):
    g = np.random.default_rng(8)
    rows = [(i, g.normal(size=12).round(1).tolist(), int(g.integers(3)) if i % 9 else None) for i in range(700)]  # many ties
    got = codes.digest(*codes.compress(_frame(spark, rows), parts=4, entries=20, scale=16, rounds=4))
    assert _coded(got) == _compress(rows, 4, 20, 16, 4)


def test_active_entries_equal_a_rescan():
    g = np.random.default_rng(3)
    for _ in range(200):
        part, old = g.integers(-3, 4, (60, 2)).astype(float), g.integers(-3, 4, (8, 2)).astype(float)
        new = np.where(g.random((8, 1)) < 0.3, g.integers(-3, 4, (8, 2)), old).astype(float)
        near, dist = codes.follow(part, new, (new != old).any(1), *codes.rescan(part, old))
        want = codes.rescan(part, new)
        assert near.tolist() == want[0].tolist() and dist.tolist() == want[1].tolist()


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 5, None), (3, [0.5] * 5, None), (1, None, 2), (2, [nan], 2), (4, [inf], 2), (5, [None], 2), (6, [], 2),
            (None, [0.25] * 16, 2), (7, [-0.1] * 17, None), (8, [0.5] * 5, 2)]
    got = codes.digest(*codes.compress(_frame(spark, rows)))
    assert _coded(got, True) == _compress(rows, 16, 64, 256, 2)
    for none in ([], [(1, None, 1)]):
        out = codes.digest(*codes.compress(_frame(spark, none)))
        assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="too large"):
        codes.compress(_frame(spark, [(0, [3e30], 0)]))
