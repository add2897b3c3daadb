"""Cheapest repairs of conversations, read off block tables.

What a repair costs from a row to the end depends on the grammar state the row meets: nothing said
yet, after the system row, after a user row, after an answer. The four costs, less their minimum,
take a few values only. So they are numbered once, and a table holds, for every such vector and
every block of BLOCK row symbols, the vector in front of the block and what it adds. A conversation
is read from its end, one lookup a block; then its blocks are expanded again, each from the vector
behind it, to choose the edits from the front, the ASCII-least among the cheapest at every row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auctionflow.llm.common import batch, pick
from auctionflow.session import fits_broadcast

#: Costs of the edits, what counts as blank, what ends a sentence, who may follow whom.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
FOLLOWS = {("s", "u"), ("u", "a"), ("a", "u")}

NONE, SYSTEM, USER, ANSWER = range(4)
INSERTED = (USER, USER, ANSWER, USER)  # the state after an inserted row, which is also that after a new role
ROLES = "sua"  # initials with a place in the grammar; any other is number 3
GONE = 0  # symbol of a row that must go; others are 1 + 2 * initial + truncated
SYMBOLS = 9
BLOCK = 4
FAULTS = ("", "blank", "duplicate", "truncated")

REPORT = pa.schema([
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROWS = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done with a row."""
    out = [("D", DELETE, state)]
    if symbol == GONE:
        return out
    initial, extra = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
    stays = {0: SYSTEM if state == NONE else None, 1: USER if state != USER else None,
             2: ANSWER if state == USER else None}.get(initial)
    if stays is not None:
        out.append(("K", KEEP + extra, stays))
    return [*out, ("R", REROLE + extra, INSERTED[state])]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs of the states when rows may be inserted first; a third insert leads back."""
    once = [min(c, INSERT + costs[INSERTED[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[INSERTED[s]]) for s, c in enumerate(costs))


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return _with_inserts([min(c + after[to] for _, c, to in _options(symbol, s)) for s in range(4)])


END = _with_inserts([0, 99, 99, 0])


class BlockTables:
    """The numbered cost vectors, their transitions by symbol and by block, and the edits of each row."""

    def __init__(self, length: int = BLOCK):
        self.length = length
        self.vectors, number = [END], {END: 0}
        for v in self.vectors:  # grows as it goes
            for symbol in range(SYMBOLS):
                raw = _before(v, symbol)
                norm = tuple(c - min(raw) for c in raw)
                if norm not in number:
                    number[norm] = len(self.vectors)
                    self.vectors.append(norm)
        raws = [[_before(v, s) for s in range(SYMBOLS)] for v in self.vectors]
        self.one = np.array([[number[tuple(c - min(r) for c in r)] for r in rs] for rs in raws], np.int32)
        self.add = np.array([[min(r) for r in rs] for rs in raws], np.int32)
        to, cost = np.arange(len(self.vectors), dtype=np.int32)[:, None], np.zeros((len(self.vectors), 1), np.int32)
        for _ in range(length):  # a block's number has its last symbol in the lowest place
            grown = self.one[to]  # vector behind, symbols so far, one more in front
            cost = (cost[:, :, None] + self.add[to]).transpose(0, 2, 1).reshape(len(to), -1)
            to = grown.transpose(0, 2, 1).reshape(len(to), -1)
        self.block_to, self.block_add = to.tolist(), cost.tolist()
        self.steps = [[[self._edits(v, s, state) for state in range(4)] for s in range(SYMBOLS)] for v in self.vectors]
        self.ends = [self._last(state) for state in range(4)]
        self.one = self.one.tolist()

    def _edits(self, after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
        """The ASCII-least edits up to this row's own, and the state they leave."""
        here, done = _before(after, symbol), ""
        while True:
            ways = [(edit, to) for edit, cost, to in _options(symbol, state) if cost + after[to] == here[state]]
            if INSERT + here[INSERTED[state]] == here[state]:
                ways.append(("I", INSERTED[state]))
            edit, state = min(ways)
            done += edit
            if edit != "I":
                return done, state

    @staticmethod
    def _last(state: int) -> str:
        done = ""
        while END[state]:
            done, state = done + "I", INSERTED[state]
        return done

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair."""
        n, length = len(symbols), self.length
        whole = n // length
        vector = cost = 0
        for s in reversed(symbols[whole * length:]):
            cost += int(self.add[vector, s])
            vector = self.one[vector][s]
        codes = np.frombuffer(symbols, np.uint8, whole * length).reshape(whole, length).astype(np.int32) @ (
            SYMBOLS ** np.arange(length - 1, -1, -1, dtype=np.int32))
        behind = np.zeros(whole, np.int16)
        for k in range(whole - 1, -1, -1):
            behind[k] = vector
            code = codes[k]
            cost += self.block_add[vector][code]
            vector = self.block_to[vector][code]
        cost += self.vectors[vector][NONE]
        out, state = [], NONE
        for k in range(whole + 1):
            part = symbols[k * length:(k + 1) * length]
            vector, after = int(behind[k]) if k < whole else 0, []
            for s in reversed(part):
                after.append(vector)
                vector = self.one[vector][s]
            for s in part:
                edits, state = self.steps[after.pop()][s][state]
                out.append(edits)
        return cost, "".join(out) + self.ends[state]


@lru_cache(maxsize=1)
def block_tables() -> BlockTables:
    return BlockTables()


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults put in, and `copies`: 0 of a row that is dropped, 2 of one that is repeated.

    The crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes out
    its stops, 3 repeats it, 4 makes it the user's. NULL counts as one space, in ids and in what is said."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_text("text"), STOPS, "")).otherwise(_text("text"))
    return pick(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Every row twice, in the task of its conversation: `text` is NULL in the first, which all come
    before the second ones. `fault` knows earlier turns; repeats within a turn are neighbours."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    said = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _text("role").alias("role"), _text("text").alias("text"),
                       copies.cast("int").alias("copies")).withColumn("key", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # what is said in several turns; copies are counted together before they are shuffled
    again = said.filter("copies > 0").groupBy("conv_id", "role", "key").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"), "first")
    again = F.broadcast(again) if fits_broadcast(again, 100_000) else again
    marked = said.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                       & (F.col("key") == F.col("_key")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), 2).when(
        ~F.right(bare, F.lit(1)).isin(*STOPS), 3).otherwise(0)
    full = marked.select("conv_id", "turn", "role", "key", "copies", fault.alias("fault"), "text")
    both = full.withColumn("text", F.explode(F.array(F.lit(None).cast("string"), "text")))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(width, "conv_id").sortWithinPartitions(
        "conv_id", F.col("text").isNotNull(), "turn", "role", "key", "fault")


class Conversation:
    """Reads a conversation's symbols, then its texts, and keeps a few bytes a row."""

    def __init__(self, conv_id, collect: bool):
        self.conv_id, self.collect = conv_id, collect
        self.codes, self.before, self.initial = bytearray(), None, None
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.low = self.high = self.turn = None
        self.turns = 0
        self.audit = None
        self.rows: list[tuple] = []

    def symbol(self, turn, role: str, key: bytes, copies: int, fault: int) -> None:
        for _ in range(copies):
            same, self.before = self.before == (turn, role, key), (turn, role, key)
            fault = 2 if same and fault != 1 else fault
            self.counts[fault] += 1
            initial = role[:1]
            if self.initial is not None and (self.initial, initial) not in FOLLOWS:
                self.illegal += 1
            self.initial = initial
            number = ROLES.find(initial) if initial else 3
            self.codes.append(GONE if fault in (1, 2) else 1 + 2 * (number if number >= 0 else 3) + (fault == 3))
        if copies and turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.low = turn if self.low is None else self.low  # turns ascend
            self.high = turn

    def _plan(self) -> None:
        self.cost, self.audit = block_tables().repair(bytes(self.codes))
        self.codes, self.at, self.last, self.place = bytearray(), 0, "", 0
        self.hash = hashlib.sha256()

    def _say(self, edit: str, turn, role: str, text: str) -> None:
        self.hash.update((("\n" if self.place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.place += 1
        self.last = role[:1]
        if self.collect:
            self.rows.append((self.conv_id, self.place, edit, turn, role, text))

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._say("I", None, self._role(), "")

    def _role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def text(self, turn, role: str, copies: int, text: str) -> None:
        if self.audit is None:
            self._plan()
        for _ in range(copies):
            self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._say(edit, turn, role if edit == "K" else self._role(), text)

    def result(self) -> tuple:
        if self.audit is None:
            self._plan()
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _streamed(rows: DataFrame, collect: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    ordered = _ordered(rows)
    id_type = pa.string() if kind.typeName() == "string" else pa.int64()
    schema = pa.schema([("conv_id", id_type), *(ROWS if collect else REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def filled(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out and len(out) >= least:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*out)))))
                out = []

        for b in batches:
            for conv, turn, role, key, copies, fault, text in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done = now.result()
                        out.extend(now.rows if collect else [done])
                    now = Conversation(conv, collect)
                if text is None:
                    now.symbol(turn, role, key, copies, fault)
                else:
                    now.text(turn, role, copies, text)
                    if collect and len(now.rows) >= 1000:
                        out.extend(now.rows)
                        now.rows = []
                yield from filled(1000)
        if now is not None:
            done = now.result()
            out.extend(now.rows if collect else [done])
        yield from filled(1)

    return ordered.mapInArrow(run, from_arrow_schema(schema))


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `rows` has conv_id, turn, role, text, and may have `copies`, how often a row counts in its
    place; 0 keeps the conversation without the row. A row's first fault counts: nothing but blanks,
    role and text said before, no stop at the end. `audit` are the initials of the cheapest edits
    (Keep 0, Rerole 2, Insert 2, Delete 3, and 1 for a truncated row that stays; blank and repeated
    rows must go) after which the role initials read `(s?(ua)+)?`, the ASCII-least of equal cost.

    Rows go by turn, NULL first, those of one turn by role and the SHA-256 of their text. NULL in role
    or text counts as one space; a NULL conv_id is a conversation of its own. A conversation
    without rows has zeros, no edits and the hash of nothing. Empty tables give no rows; other
    columns are not read. A conversation is read by one task, since its hash is one; it keeps
    a few bytes a row, never the texts.
    """
    return _streamed(rows, False)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), turn, role, text: the repaired conversations, row by row.

    `rows` and odd cases as for `report`; inserted rows have no turn."""
    return _streamed(rows, True)


#: Fixed values below follow the contract; the DP runs over all conversations at once, from their ends.
_CRC = ("(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), "
        "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)))")


def _sql_option(edit: str, cost: str, to: int, role: str | None) -> str:
    said = f"list_prepend({role}, b.s{to}.rep)" if role else f"b.s{to}.rep"
    return f"{{'c': b.s{to}.c + {cost}, 'a': '{edit}' || b.s{to}.a, 'rep': {said}}}"


def _sql_state(state: int) -> str:
    role = "'assistant:'" if state == USER else "'user:'"
    name = f"({role} || r.text)"
    keep = {NONE: f"CASE r.i WHEN 's' THEN {_sql_option('K', 'r.t', SYSTEM, 'r.said')} WHEN 'u' THEN {_sql_option('K', 'r.t', USER, 'r.said')} END",
            USER: f"CASE r.i WHEN 'a' THEN {_sql_option('K', 'r.t', ANSWER, 'r.said')} END"}.get(
        state, f"CASE r.i WHEN 'u' THEN {_sql_option('K', 'r.t', USER, 'r.said')} END")
    return (f"list_min(list_filter([{_sql_option('D', '3', state, None)}, CASE WHEN NOT r.x THEN {keep} END, "
            f"CASE WHEN NOT r.x THEN {_sql_option('R', '2 + r.t', INSERTED[state], name)} END], lambda o: o IS NOT NULL))")


def _sql_insert(state: int, prefix: str = "n") -> str:
    role = "'assistant:'" if state == USER else "'user:'"
    to = f"{prefix}.s{INSERTED[state]}"
    return f"list_min([{prefix}.s{state}, {{'c': {to}.c + 2, 'a': 'I' || {to}.a, 'rep': list_prepend({role}, {to}.rep)}}]) AS s{state}"


def _sql_end(state: int) -> str:
    steps = {NONE: ("", []), SYSTEM: ("II", ["user:", "assistant:"]), USER: ("I", ["assistant:"]), ANSWER: ("", [])}[state]
    said = "[" + ", ".join(f"'{r}'" for r in steps[1]) + "]"
    return f"{{'c': CAST({2 * len(steps[0])} AS BIGINT), 'a': '{steps[0]}', 'rep': CAST({said} AS VARCHAR[])}} AS s{state}"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""WITH RECURSIVE crc AS (SELECT {_CRC} AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1),
    lambda j: CAST(ascii(k[j]) AS BIGINT))), lambda c, v: xor(c // 256, t[1 + xor(c % 256, v)])), CAST(4294967295 AS BIGINT)) % 20 AS h
    FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
    rtrim(text, {_WS}) AS bare FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM placed),
rows AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup,
    bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
r AS (SELECT c, n, i, role || ':' || text AS said, text, blank OR dup AS x, CAST(cut AS BIGINT) AS t FROM rows),
sums AS (SELECT c, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
b AS (SELECT c, rows AS n, {', '.join(_sql_end(s) for s in range(4))} FROM sums UNION ALL
    SELECT c, n, {', '.join(_sql_insert(s, 'm') for s in range(4))} FROM (
    SELECT c, n, {', '.join(_sql_insert(s) for s in range(4))} FROM (
    SELECT b.c, b.n - 1 AS n, {', '.join(f'{_sql_state(s)} AS s{s}' for s in range(4))}
    FROM b JOIN r ON r.c = b.c AND r.n = b.n) n) m)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
    sha256(coalesce(array_to_string(s0.rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations) o
LEFT JOIN sums ON sums.c = o.c LEFT JOIN b ON b.c = o.c AND b.n = 0"""
