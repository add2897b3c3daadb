"""Repair of conversations against a search over all edits, and its results on odd rows."""

import hashlib
import random
import re
from functools import lru_cache

import pytest

from auctionflow.llm import conversations as C

FIELDS = "conv_id long, turn long, role string, text string, key string, fault int, copies2 int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], FIELDS)


def _cheapest(symbols):
    """(cost, edits) by trying everything; up to three inserts in front of a row."""
    @lru_cache(None)
    def go(i, said, inserts):
        ways = []
        last = said[-1:]
        if i == len(symbols):
            if re.fullmatch("(s?(ua)+)?", said):
                ways.append((0, ""))
        else:
            s = symbols[i]
            initial, extra = "sua-"[(s - 1) // 2] if s else "", (s - 1) % 2
            cost, rest = go(i + 1, said, 0)
            ways.append((3 + cost, "D" + rest))
            for to, price, edit in [(initial, extra, "K"), ("u", 2 + extra, "R"), ("a", 2 + extra, "R")] if s else []:
                if re.fullmatch("s?(ua)*u?", said + to) and to not in ("", "-"):
                    cost, rest = go(i + 1, said + to, 0)
                    ways.append((price + cost, edit + rest))
        if inserts < 3:
            to = "a" if last == "u" else "u"
            cost, rest = go(i, said + to, inserts + 1)
            ways.append((2 + cost, "I" + rest))
        return min(ways) if ways else (10**9, "")

    return go(0, "", 0)


def _by_state(symbols):
    """The same over grammar states, for longer sequences."""
    @lru_cache(None)
    def go(i, state, inserts):
        ways = [(0, "")] if i == len(symbols) and state in "0a" else []
        turn = "a" if state == "u" else "u"
        if i < len(symbols):
            s = symbols[i]
            ways.append((3, "D", i + 1, state, 0))
            if s:
                initial, extra = "sua-"[(s - 1) // 2], (s - 1) % 2
                if initial == turn or (initial == "s" and state == "0"):
                    ways.append((extra, "K", i + 1, initial, 0))
                ways.append((2 + extra, "R", i + 1, turn, 0))
        if inserts < 3:
            ways.append((2, "I", i, turn, inserts + 1))
        done = [w if len(w) == 2 else (w[0] + (r := go(*w[2:]))[0], w[1] + r[1]) for w in ways]
        return min(done) if done else (10**9, "")
    return go(0, "0", 0)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_block_tables_find_the_cheapest_edits(length):
    tables, random_ = C.BlockTables(length), random.Random(length)
    for _ in range(800):
        symbols = bytes(random_.randrange(C.SYMBOLS) for _ in range(random_.randrange(14)))
        assert tables.repair(symbols) == _by_state(symbols)
        if len(symbols) < 5:
            assert tables.repair(symbols) == _cheapest(symbols)


def _report(rows):
    """What `report` gives, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, hashlib.sha256((" " if x is None else x).encode()).hexdigest(), " " if x is None else x, t)
                       for c, t, r, x in rows if c == conv))
        said, symbols, seen, counts, roles, lines = [], [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}, [], []
        for _, _, role, _, text, _ in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            roles.append(role[:1])
            symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".find(role[:1]) if role[:1] in list("sua") else 3) + (fault == "truncated"))
        cost, audit = _by_state(tuple(symbols))
        i, last = 0, ""
        for edit in audit:
            turn = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{turn}:")
            else:
                role, text = mine[i][2], mine[i][4]
                i += 1
                if edit != "D":
                    lines.append(f"{role if edit == 'K' else turn}:{text}")
            if edit != "D":
                last = lines[-1][:1]
        turns = [m[5] for m in mine if m[5] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_report_of_made_up_conversations(spark):
    g = random.Random(4)
    rows = [(g.choice([None, *range(40)]), g.choice([None, *range(9)]), g.choice(["system", "user", "assistant", "tool", "", None, "User"]),
             g.choice(["Yes.", "No!", "cut", "cut", "", " \n", None, "Why? \t", "ü.", "a.b"])) for _ in range(900)]
    assert _got(C.report(_frame(spark, rows))) == _report(rows)


def test_report_of_long_conversations(spark):
    g = random.Random(6)
    rows = [(1, t, g.choice(["user", "assistant"]), f"{t % 2500} {g.choice('.x')}") for t in range(5000)]
    rows += [(2, 7, "user", "same.")] * 3000 + [(3, t, "user", "same.") for t in range(3000)]
    got = _got(C.report(_frame(spark, rows)))
    assert got[2][:5] == (0, 0, 2999, 0, 2999) and got[2][6] == "K" + "D" * 2999 + "I"
    assert got[3][:5] == (0, 0, 2999, 0, 2999)
    assert got[1][0] == 0 and set(got[1][6]) <= set("KRDI")
    tables, mine = C.block_tables(), [r for r in rows if r[0] == 1]
    seen, symbols = set(), bytearray()
    for _, _, role, text in mine:
        symbols.append(0 if (role, text) in seen else 1 + 2 * "sua".index(role[0]) + (text[-1] != "."))
        seen.add((role, text))
    assert got[1][5:7] == tables.repair(bytes(symbols))


def test_repaired_rows_read_as_the_grammar_says(spark, data):
    rows = C.damage(spark.read.parquet(f"{data}/conversations.parquet"))
    found, said = _got(C.report(rows)), {}
    for r in C.repair(rows).orderBy("conv_id", "place").collect():
        said.setdefault(r["conv_id"], []).append(r)
    for conv, values in found.items():
        mine = said.get(conv, [])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))
        assert values[7] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest()
        assert "".join(r["edit"] for r in mine) == values[6].replace("D", "")


def test_conversations_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert C.report(_frame(spark, [])).collect() == [] and C.repair(_frame(spark, [])).collect() == []
    gone = _frame(spark, [(i, i, "user", "a.") for i in range(300)])
    damaged = C.damage(gone)
    dropped = {r["conv_id"] for r in damaged.filter("copies = 0").collect()}
    got = _got(C.report(damaged))
    assert len(got) == 300 and dropped
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", empty) for c in dropped)
    long = _frame(spark, [(1, 0, "user", "wort " * 400_000), (1, 1, "assistant", "." * 1_000_000 + " " * 1_000_000)])
    assert _got(C.report(long))[1][:7] == (0, 0, 0, 1, 0, 1, "KK")
    none = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert _got(C.report(C.damage(none)))[None][5:] == (3, "D", empty)
