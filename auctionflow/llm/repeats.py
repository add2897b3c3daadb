"""Strings of a given length that occur more than once in a corpus, and their removal."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.common import M1, M2, batch, chosen, mix, pick
from auctionflow.session import forget, store

SEED = 64          # bytes that are hashed to choose anchors
CHUNK = 1 << 18    # windows looked at at a time
NO_ID = -(1 << 63)
TREE = 4096        # most distinct contexts of one anchor that one tree is built of

ANCHORED = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int32()), ("lo", pa.int32()), ("size", pa.int32()), ("at", pa.int32()),
    ("anchor", pa.int64()), ("context", pa.int64())])


class Anchors:
    """Cuts a text's windows of `length` bytes into runs that share an anchor.

    The anchor of a window is its first SEED-byte string of smallest hash. Equal windows have equal
    anchors at equal places, so equal windows are found among runs of one anchor. The context of a
    run is every byte that its windows cover.
    """

    def __init__(self, length: int):
        self.length, self.span = length, length - SEED + 1
        n = CHUNK + length + 1
        self.powers = np.full(n, M1)
        self.powers[0] = 1
        self.inverse = np.full(n, np.uint64(pow(int(M1), -1, 1 << 64)))
        self.inverse[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * M2)

    def _slides(self, values: np.ndarray) -> np.ndarray:
        """Smallest of each `span` values in a row, from running minima of blocks in both directions."""
        w = self.span
        padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max)
        padded[:len(values)] = values
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(values) - w + 1
        return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])

    def runs(self, text: bytes) -> list[tuple[np.ndarray, ...]]:
        """(lo, size, at, anchor, context) arrays: the context is text[lo:lo + size], its anchor
        starts `at` bytes into it."""
        found = []
        for begin in range(0, len(text) - self.length + 1, CHUNK):
            part = np.frombuffer(text, np.uint8, min(CHUNK + self.length - 1, len(text) - begin), begin)
            n = len(part)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.letters[part] * self.powers[:n], out=sums[1:])
            seeds = mix((sums[SEED:] - sums[:-SEED]) * self.inverse[:n - SEED + 1])
            mask = np.uint64((1 << 19) - 1)
            place = (self._slides((seeds & ~mask) | np.arange(len(seeds), dtype=np.uint64)) & mask).astype(np.int64)
            first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
            last = np.append(first[1:] - 1, len(place) - 1)
            stop = last + self.length
            context = mix((sums[stop] - sums[first]) * self.inverse[first] + mix((stop - first).astype(np.uint64)))
            found.append((first + begin, stop - first, place[first] - first, seeds[place[first]], context))
        return found


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """The runs of all texts (doc_id, mark, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)

        def rows(doc: list, mark: list, found: list) -> pa.RecordBatch:
            lens = [len(f[0]) for f in found]
            lo, size, at, anchor, context = (np.concatenate(c) for c in zip(*found))
            return batch(ANCHORED, doc_id=np.repeat(doc, lens), mark=np.repeat(mark, lens).astype(np.int32),
                         lo=lo.astype(np.int32), size=size.astype(np.int32), at=at.astype(np.int32),
                         anchor=anchor.view(np.int64), context=context.view(np.int64))

        for b in batches:
            doc, mark, found, total = [], [], [], 0
            for d, m, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for f in anchors.runs(text.as_py()):
                    doc.append(d)
                    mark.append(m)
                    found.append(f)
                    total += len(f[0])
                if total > 100_000:
                    yield rows(doc, mark, found)
                    doc, mark, found, total = [], [], [], 0
            if found:
                yield rows(doc, mark, found)

    return texts.filter(F.octet_length("bytes") >= length).mapInArrow(
        run, "doc_id long, mark int, lo int, size int, at int, anchor long, context long")


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])).bit_length() + 7) // 8


class PrefixTree:
    """The common-prefix intervals of texts that share an anchor, with their left extensions.

    `right[i]` is what follows the anchor's start and `left[i]` what precedes it, backwards. The
    texts sorted by `right`, with the common prefixes of neighbours, are an enhanced suffix array of
    the anchors; a stack scan closes its intervals bottom up. Where two intervals join at prefix
    length h, the smaller one's members are put into the order of `left` of the larger one's: the
    longest left extension a member shares with any other of the interval is that with one of its
    two neighbours in this order, and only the newcomers and their neighbours can gain one. Members
    of one branch with the same left extension add nothing; those that differ to the right at h
    and share l bytes to the left are occurrences of a maximal repeat of l + h bytes.
    """

    def __init__(self, right: list[bytes], left: list[bytes], length: int):
        n = len(right)
        self.length, self.best = length, [{} for _ in range(n)]  # of a member: right length -> left length
        by_left = sorted(range(n), key=left.__getitem__)
        self.at_rank = by_left
        self.shared = [common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])]
        rank = [0] * n
        for place, i in enumerate(by_left):
            rank[i] = place
        order = sorted(range(n), key=right.__getitem__)
        stack: list[tuple[int, list[int]]] = []
        for place, i in enumerate(order):
            h = common(right[i], right[order[place + 1]]) if place + 1 < n else -1
            node = [rank[i]]
            while stack and stack[-1][0] > h:
                depth, members = stack.pop()
                node = self._join(members, node, depth)
            if stack and stack[-1][0] == h:
                stack[-1] = (h, self._join(stack[-1][1], node, h))
            elif h >= 0:
                stack.append((h, node))

    def _join(self, a: list[int], b: list[int], h: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            at = bisect_left(a, x)
            for y in a[max(0, at - 1):at + 1]:
                l = min(self.shared[min(x, y):max(x, y)])
                if l + h >= self.length:
                    for z in (self.at_rank[x], self.at_rank[y]):
                        if self.best[z].get(h, -1) < l:
                            self.best[z][h] = l
            a.insert(at, x)
        return a

    def cover(self, i: int, at: int) -> list[list[int]]:
        """(start, stop) of what repeats cover of member i, whose anchor starts at `at`."""
        runs: list[list[int]] = []
        for start, stop in sorted((at - l, at + h) for h, l in self.best[i].items()):
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(stop, runs[-1][1])
            else:
                runs.append([start, stop])
        return runs


class RepeatGroups:
    """All maximal repeats of texts that share an anchor, each with all its members, nested ones too.

    `right` and `left` as for PrefixTree. The members of a repeat that reaches h bytes to the right and l
    to the left are those of an interval in the order of `right` and of one in the order of `left`. So a
    repeat is written as these two intervals, and a member as its two ranks, whatever the repeats' sizes.
    A stack scan gives the right intervals, with the branches that differ after h bytes; within each,
    a second scan gives the left intervals, and one that holds two branches is a maximal repeat.
    """

    def __init__(self, right: list[bytes], left: list[bytes], length: int):
        n = len(right)
        self.by_left, self.by_right = sorted(range(n), key=left.__getitem__), sorted(range(n), key=right.__getitem__)
        self.left_rank, self.right_rank = [0] * n, [0] * n
        for place, (i, j) in enumerate(zip(self.by_left, self.by_right)):
            self.left_rank[i] = self.right_rank[j] = place
        self.shared = [common(left[a], left[b]) for a, b in zip(self.by_left, self.by_left[1:])]
        #: (left length, right length, first and last left rank, first and last right rank)
        self.groups: list[tuple[int, int, int, int, int, int]] = []
        heights = [common(right[a], right[b]) for a, b in zip(self.by_right, self.by_right[1:])]
        stack: list[tuple[int, int, list[int]]] = []  # depth, first rank, where its branches start
        for place in range(n):
            h, first = heights[place] if place + 1 < n else -1, place
            while stack and stack[-1][0] > h:
                depth, first, starts = stack.pop()
                if depth + max(len(left[i]) for i in self.by_right[first:place + 1]) >= length:
                    self._node(depth, first, place, starts, length)
            if stack and stack[-1][0] == h:
                stack[-1][2].append(place + 1)
            elif h >= 0:
                stack.append((h, first, [first, place + 1]))

    def _node(self, h: int, first: int, last: int, starts: list[int], length: int) -> None:
        branch: dict[int, int] = {}
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], last + 1])):
            for r in range(a, b):
                branch[self.left_rank[self.by_right[r]]] = number
        ranks = sorted(branch)
        stack: list[list[int]] = []  # left length, first rank, lowest and highest branch
        for place, r in enumerate(ranks):
            l = min(self.shared[r:ranks[place + 1]]) if place + 1 < len(ranks) else -1
            here = [r, branch[r], branch[r]]
            while stack and stack[-1][0] > l:
                depth, begin, low, high = stack.pop()
                here = [begin, min(low, here[1]), max(high, here[2])]
                if here[1] != here[2] and depth + h >= length:
                    self.groups.append((depth, h, begin, r, first, last))
            if stack and stack[-1][0] == l:
                stack[-1] = [l, stack[-1][1], min(stack[-1][2], here[1]), max(stack[-1][3], here[2])]
            elif l >= 0:
                stack.append([l, *here])


def _by_anchor(contexts: DataFrame, schema: pa.Schema, kind: str, grow) -> DataFrame:
    """`grow(anchor, contexts)` gives rows for the contexts (context, at, n, bytes) of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * len(schema)
            out.clear()
            return batch(schema, **{f.name: list(cols[i]) for i, f in enumerate(schema)})

        last, group = None, []
        for b in batches:
            for anchor, *context in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != last:
                    if group:
                        out.extend(grow(last, group))
                    last, group = anchor, []
                group.append(context)
            yield rows()
        if group:
            out.extend(grow(last, group))
        yield rows()

    return (contexts.select("anchor", "context", "at", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context")
            .mapInArrow(run, kind))


def _covered(contexts: DataFrame, length: int) -> DataFrame:
    """What repeats cover (anchor, context, start, stop) of contexts that share an anchor, and occur once.

    start and stop count from the context's first byte; a context has as many rows as it has separate runs."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def grow(anchor: int, group: list) -> Iterator[tuple]:
        if len(group) > 1:
            tree = PrefixTree([t[at:] for _, at, _, t in group], [t[:at][::-1] for _, at, _, t in group], length)
            for i, (context, at, n, _) in enumerate(group):
                if n == 1:
                    for start, stop in tree.cover(i, at):
                        yield anchor, context, start, stop

    return _by_anchor(contexts, schema, "anchor long, context long, start int, stop int", grow)


GROUPS = pa.schema([
    ("anchor", pa.int64()), ("repeat", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("left_lo", pa.int64()),
    ("left_hi", pa.int64()), ("right_lo", pa.int64()), ("right_hi", pa.int64()), ("context", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])


def _grouped(contexts: DataFrame, length: int) -> DataFrame:
    """Maximal repeats as two intervals each, and contexts as two ranks each, of every anchor."""
    def grow(anchor: int, group: list) -> Iterator[tuple]:
        import xxhash

        found = RepeatGroups([t[at:] for _, at, _, t in group], [t[:at][::-1] for _, at, _, t in group], length)
        wholes = {(at, len(t) - at, found.left_rank[i], found.left_rank[i], found.right_rank[i], found.right_rank[i])
                  for i, (_, at, n, t) in enumerate(group) if n > 1}
        for before, after, *ends in [*found.groups, *sorted(wholes)]:
            one = group[found.by_right[ends[2]]] if ends[2] == ends[3] else next(
                group[found.by_right[r]] for r in range(ends[2], ends[3] + 1) if ends[0] <= found.left_rank[found.by_right[r]] <= ends[1])
            string = one[3][one[1] - before:one[1] + after]
            yield anchor, xxhash.xxh3_64_intdigest(string) - (1 << 63), before, after, *ends, None, None, None
        for i, (context, _, _, _) in enumerate(group):
            yield anchor, None, None, None, None, None, None, None, context, found.left_rank[i], found.right_rank[i]

    kind = ("anchor long, repeat long, before int, after int, left_lo long, left_hi long, right_lo long, right_hi long, "
            "context long, left long, right long")
    return _by_anchor(contexts, GROUPS, kind, grow)


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts for one tree: their windows are counted one by
    one, which needs no group in one place. Neighbouring windows stay separate repeats."""
    cut = contexts.select("anchor", "context", "bytes", F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("start")).select(
        "anchor", "context", F.col("start").cast("int"), (F.col("start") + length).cast("int").alias("stop"),
        F.expr(f"substring(bytes, start + 1, {length})").alias("window"))
    hashed = cut.select("anchor", "context", "start", "stop", F.xxhash64("window").alias("repeat"),
                        F.md5("window").alias("digest"))
    often = hashed.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return hashed.join(often, "digest").select("anchor", "context", "start", "stop", "repeat")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, bytes; the mark tells apart rows that share an id but not the text. NO_ID stands
    for a NULL id, which would find no partner in a join."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return pick(docs, id_col, text_col).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                                               (F.crc32(text) - (1 << 31)).cast("int").alias("mark"), text.alias("bytes"))


def _contexts(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, kept, pieces): the runs of all texts, the contexts that may repeat, and the bytes of those that share an anchor.

    Windows are cut into runs by anchor. Equal contexts are counted first, so a passage copied into any
    share of the documents is one context. Only anchors with several contexts need their bytes, one text for each."""
    texts = _texts(docs, id_col, text_col)
    runs = store(anchored(texts, length), "runs")
    key, place = ["anchor", "context"], ["doc_id", "mark"]
    classes = runs.groupBy(*key).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "mark", "lo", "size", "at")])
    several = classes.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    kept = store(classes.join(several, "anchor", "left").filter("n > 1 OR contexts > 1"), "contexts")
    needed = store(kept.filter("contexts > 1").select("doc_id").distinct(), "needed")
    # a text that occurs twice is one text
    pieces = kept.filter("contexts > 1").join(chosen(texts, needed, "left_semi").dropDuplicates(place), place).select(
        *key, "at", "size", "contexts", "n", F.expr("substring(bytes, lo + 1, size)").alias("bytes"))
    pieces = store(pieces.dropDuplicates(key), "pieces")
    forget(needed)
    return runs, kept, pieces


def repeat_groups(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                  tree: int = TREE) -> tuple[DataFrame, DataFrame]:
    """(groups, members): the maximal repeats of `length` bytes or more, and the places they occur at.

    A group has its anchor, `repeat` (a digest of the string), the bytes `before` and `after` the anchor's
    start, and two intervals. A member (anchor, doc_id, mark, place of the anchor's start, left, right) is in every group of its
    anchor whose intervals hold its two ranks. Both tables are linear in the texts, however many
    documents share how many nested repeats; `repeats` writes out the pairs.

    Matches do not cross documents; two places of one document count. A repeat that is longer than
    what one anchor covers comes as several overlapping ones, which together cover it. An anchor with more
    than `tree` different contexts, which one task would have to hold, gives its repeated windows of `length` bytes instead, unmerged: they
    cover the same bytes but aren't maximal.
    """
    runs, kept, pieces = _contexts(docs, length, id_col, text_col)
    alone = kept.filter("n > 1 AND contexts IS NULL").select("anchor", "context", "at", "size")
    found = store(_grouped(pieces.filter(F.col("contexts") <= tree), length), "groups")
    windows = _windows(pieces.filter(F.col("contexts") > tree), length).join(pieces.select("anchor", "context", "at"), ["anchor", "context"])
    groups = found.filter("repeat IS NOT NULL").drop("context", "left", "right").unionByName(alone.selectExpr(
        "anchor", "context AS repeat", "at AS before", "size - at AS after", "0L AS left_lo", "0L AS left_hi", "0L AS right_lo", "0L AS right_hi"))
    places = runs.select("doc_id", "mark", (F.col("lo") + F.col("at")).alias("place"), "anchor", "context")
    ranks = found.filter("context IS NOT NULL").select("anchor", "context", "left", "right").unionByName(
        alone.selectExpr("anchor", "context", "0L AS left", "0L AS right"))
    # such anchors have no ranks: a context stands for itself, and each of its windows is a group with it
    groups = groups.unionByName(windows.selectExpr("anchor", "repeat", "at - start AS before", "stop - at AS after", *[
        f"context AS {c}" for c in ("left_lo", "left_hi", "right_lo", "right_hi")]))
    ranks = ranks.unionByName(windows.selectExpr("anchor", "context", "context AS left", "context AS right").distinct())
    return store(groups, "groups"), places.join(ranks, ["anchor", "context"]).drop("context")


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
            tree: int = TREE) -> DataFrame:
    """Occurrences (doc_id, mark, start, stop, repeat) of maximal repeats of `length` bytes or more: every member of
    every group of `repeat_groups`, nested ones too. Offsets are bytes of the UTF-8 text."""
    groups, members = repeat_groups(docs, length, id_col, text_col, tree)
    inside = F.col("left").between(F.col("left_lo"), F.col("left_hi")) & F.col("right").between(F.col("right_lo"), F.col("right_hi"))
    return members.join(groups, "anchor").filter(inside).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "mark", (F.col("place") - F.col("before")).alias("start"),
        (F.col("place") + F.col("after")).alias("stop"), "repeat")


def _cover(docs: DataFrame, length: int, id_col: str, text_col: str, tree: int) -> DataFrame:
    """Places (doc_id, mark, start, stop) that repeats cover; merged within a context before they are joined to its places."""
    runs, kept, pieces = _contexts(docs, length, id_col, text_col)
    key = ["anchor", "context"]
    whole = kept.filter("n > 1").select(*key, F.lit(0).alias("start"), F.col("size").alias("stop"))
    windows = _windows(pieces.filter(F.col("contexts") > tree), length)
    crowded = windows.join(pieces.filter((F.col("contexts") > tree) & (F.col("n") == 1)).select(*key), key, "left_semi").select(*key, "start", "stop")
    cover = whole.unionByName(_covered(pieces.filter(F.col("contexts") <= tree), length)).unionByName(crowded)
    cover = store(cover, "cover")
    forget(pieces, kept)
    return runs.select("doc_id", "mark", "lo", *key).join(cover, key).select(
        "doc_id", "mark", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   tree: int = TREE) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, stop of the maximal removed runs), kept (bytes).

    Every byte goes that is covered by a string of `length` bytes which starts at another place of
    the corpus too, judged on the input; one row per input row. A NULL text is empty; texts shorter
    than `length` stay. Rows with equal id and text are repeats of each other. `kept` need not be
    whole UTF-8 characters. An empty table gives no rows; other columns are not read.
    """
    places = _cover(docs, length, id_col, text_col, tree).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("start", "stop")).alias("places"))
    joined = _texts(docs, id_col, text_col).join(places, ["doc_id", "mark"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "bytes", "places")
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sizes, gone, spans, kept = [], [], [], []
                for text, found in zip(part.column(1), part.column(2).to_pylist()):
                    text, runs = text.as_py(), []
                    for start, stop in sorted((p["start"], p["stop"]) for p in found or []):
                        if runs and start <= runs[-1][1]:
                            runs[-1][1] = max(stop, runs[-1][1])
                        else:
                            runs.append([start, stop])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])))
                    sizes.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    spans.append([{"start": i, "stop": j} for i, j in runs])
                yield batch(schema, doc_id=part.column(0), n_bytes=sizes, n_removed=gone, spans=spans, kept=kept)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start int, stop int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
