"""Streams over several micro-batches give what the batch queries give."""

import datetime
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auctionflow.operators import joins as J
from auctionflow.operators import verify as V
from auctionflow.operators import windows as W
from auctionflow.plans import streams
from auctionflow.session import new_path
from auctionflow.sources import tables as S
from auctionflow.sources.custom import Feed, ParquetFeed, register
from auctionflow.streaming import joins as SJ
from auctionflow.streaming import files, log, ordered, state
from auctionflow.streaming.carry import Carry
from auctionflow.streaming.running import running_batches, trailing_batches
from auctionflow.streaming.harness import DroppedRows, Epochs, plain, probe, run, run_batches, stream_session, zoned

DAY = 86_400


@pytest.fixture(scope="module")
def bids(spark, data):
    return S.event_bids(spark, data)


@pytest.fixture(scope="module")
def epochs(bids):
    return Epochs(zoned(bids, "date_time"), "date_time", epochs=3, closing=90 * DAY)


def test_windows_over_epochs(bids, epochs):
    seen = []
    got = run(W.window_count(epochs.stream(), "date_time", 21_600, 4, epochs.origin(21_600)), progress=seen)
    assert len([p for p in seen if p.numInputRows]) >= 3
    assert V.verify(W.window_count(bids, "date_time", 21_600, 4), plain(got)).isEmpty()


def test_hot_items_over_epochs(bids, epochs):
    got = run(W.hot_items(epochs.stream(), "date_time", "auction", 21_600, 4, epochs.origin(21_600)))
    assert V.verify(W.hot_items(bids, "date_time", "auction", 21_600, 4), plain(got)).isEmpty()


def test_late_rows_do_not_pass_silently(spark):
    # the last part is old; a batch is held against the watermark of the batch before it
    rows = spark.createDataFrame([(i, (1000, 1100, 100)[i % 3] + i, i % 3) for i in range(30)],
                                 "id long, s long, part long")
    e = Epochs(rows.select("id", F.timestamp_seconds("s").alias("t"), "part"), "t", order="part")
    counts = W.window_count(e.stream(), "t", 10, 1, e.origin(10))
    with pytest.raises(DroppedRows):
        run(counts)


def test_a_stream_needs_an_origin(epochs):
    with pytest.raises(ValueError):
        W.window_count(epochs.stream(), "date_time", 60, 2)


def test_closed_auctions_both_ways(spark, data):
    want = J.closed_auctions(S.auctions(spark, data), S.bids(spark, data))
    a = zoned(S.auctions(spark, data), "date_time", "expires")
    b = Epochs(zoned(S.bids(spark, data), "date_time"), "date_time", epochs=3, closing=4000 * DAY)
    timers = run(state.closing_auctions(
        Epochs(a, "date_time", epochs=3, closing=4000 * DAY).stream(), b.stream()))
    joined = run(SJ.closing_auctions(
        Epochs(a, "expires", epochs=3, closing=4000 * DAY).stream(), b.stream(), 730 * DAY))
    for got in (timers, joined):
        assert V.verify(want, plain(got)).isEmpty()


def test_running_sum_over_epochs(spark, data):
    rows = S.table(spark, data, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_id").alias("value"))
    e = Epochs(zoned(rows, "ts"), "ts", epochs=3, closing=90 * DAY)
    got = {(r.key, r.id): r.running for r in run(state.running_sum(e.stream())).collect()}
    total = {}
    for r in rows.orderBy("ts").collect():
        total[r.key] = total.get(r.key, 0) + r.value
        assert got[r.key, r.id] == total[r.key]


def test_counts_and_maps_survive_batches(spark, data):
    e = Epochs(zoned(S.table(spark, data, "events"), "ts"), "ts", epochs=3)
    seen = {}

    def each(batch, number):
        for r in batch.collect():
            seen.setdefault(r.key, []).append(r.n)
    run_batches(state.count_changes(e.stream().select(F.col("user_id").alias("key"))), each, "update")
    assert all(ns == sorted(ns) for ns in seen.values())
    want = {r.user_id: r["count"] for r in S.table(spark, data, "events").groupBy("user_id").count().collect()}
    assert {k: ns[-1] for k, ns in seen.items()} == want


def test_running_and_trailing_batches(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("k"), "id", F.timestamp_seconds("id").alias("ts"))
    e = Epochs(rows, "ts", epochs=3)
    sums = running_batches(e.stream(), ["k"], ["id"], {"s": ("sum", "id"), "hi": ("max", "id")})
    for r in sums.collect():
        mine = list(range(r.k, r.id + 1, 2))
        assert (r.s, r.hi) == (sum(mine), r.id)
    last = trailing_batches(e.stream(), ["k"], ["id"], 4, {"s": F.sum("id"), "n": F.count("*")})
    assert last.count() == 60
    for r in last.collect():
        mine = list(range(r.k, r.id + 1, 2))[-4:]
        assert (r.s, r.n) == (sum(mine), len(mine))


@pytest.fixture
def small_chunks(spark):
    own = stream_session(spark)
    before = own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield own
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _laid_down(spark, rows, schema, parts):
    """The rows as files in the given order, `parts` epochs of them, and a last one far ahead."""
    path, n = new_path(spark, "laid"), len(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i * n // parts:(i + 1) * n // parts], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, -1, datetime.datetime(2100, 1, 1), "")], schema).coalesce(1).write.mode("append").parquet(path)
    return stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ORDERED = "key long, id long, ts timestamp, word string"
START_OF = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("piece", [40, 512])
def test_a_fold_sees_a_hot_key_in_time_order(spark, small_chunks, piece, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", piece)
    monkeypatch.setattr(ordered, "TOGETHER", 3)
    # two epochs, 4,000 rows of one key in reverse, two rows a time
    one = [(7, i, START_OF + datetime.timedelta(milliseconds=i // 2), None if i % 5 else "x") for i in range(4000)]
    rows = one[1999::-1] + one[:1999:-1]

    def fold(key, rows, state):
        seen, out = state[0] if state else -1, []
        for i, word in zip(rows["id"], rows["word"]):
            out.append((key[0], i, seen, word))
            seen = int(i)
        return pd.DataFrame(out, columns=["key", "id", "before", "word"]), (seen,)

    stream = _laid_down(spark, rows, ORDERED, 2).withWatermark("ts", "0 seconds")
    got = run(state.state_machine(stream, ["key"], "seen long", "key long, id long, before long, word string", fold, "ts", ["id"]))
    assert sorted((r.id, r.before, r.word) for r in got.filter("key = 7").collect()) == [
        (i, i - 1, None if i % 5 else "x") for i in range(4000)]


def test_rows_that_overlap_epochs_are_folded_once_the_watermark_has_passed(spark, small_chunks):
    # every epoch covers all times but for a drift of one second; the watermark trails by an hour
    g = random.Random(3)
    ids = list(range(600))
    g.shuffle(ids)
    rows = [(i % 2, i, START_OF + datetime.timedelta(seconds=i), "") for i in ids]

    def fold(key, rows, state):
        n = state[0] if state else 0
        return rows[["key", "id"]].assign(step=range(n + 1, n + 1 + len(rows))), (n + len(rows),)

    stream = _laid_down(spark, rows, ORDERED, 4).withWatermark("ts", "1 hour")
    got = run(state.state_machine(stream, ["key"], "n long", "key long, id long, step long", fold, "ts", ["id"]))
    assert sorted((r.id, r.step) for r in got.filter("key >= 0").collect()) == [(i, i // 2 + 1) for i in range(600)]


def test_rows_and_timers_alternate_in_time_order(spark, small_chunks):
    """Every row asks for a timer 1.5 s later, which sees all rows up to its time and none after."""
    rows = [(1, i, START_OF + datetime.timedelta(seconds=i), "") for i in range(200)]
    ms = lambda t: int(t.timestamp() * 1000)

    def on_rows(key, rows, seen):
        stamps = [int(t.value // 1_000_000) for t in rows["ts"]]
        return None, (int(rows["id"].iloc[-1]),), [t + 1500 for t in stamps]

    def on_timer(key, at, seen):
        return pd.DataFrame({"key": [key[0]], "at": [at], "seen": [seen[0]]}), seen, []

    stream = _laid_down(spark, rows[::-1], ORDERED, 1).withWatermark("ts", "0 seconds")
    got = run(state.notify(stream, ["key"], "seen long", "key long, at long, seen long", on_rows, on_timer, time="ts"))
    first = ms(START_OF.replace(tzinfo=datetime.timezone.utc))
    want = [(first + i * 1000 + 1500, min(i + 1, 199)) for i in range(200)]
    assert sorted((r.at, r.seen) for r in got.filter("key = 1").collect()) == want


def test_rows_without_a_time_or_with_missing_values_keep_their_place(spark, small_chunks):
    rows = [(1, i, None if i < 3 else START_OF + datetime.timedelta(seconds=i), None) for i in range(9)]

    def fold(key, rows, state):
        n = state[0] if state else 0
        return rows[["key", "id", "ts"]].assign(step=range(n, n + len(rows))), (n + len(rows),)

    stream = _laid_down(spark, rows[::-1], ORDERED, 1).withWatermark("ts", "0 seconds")
    got = run(state.state_machine(stream, ["key"], "n long", "key long, id long, ts timestamp, step long", fold, "ts", ["id"]))
    assert sorted((r.id, r.step, r.ts is None) for r in got.filter("key = 1").collect()) == [(i, i, i < 3) for i in range(9)]


def numbers(n, trace):
    class Numbers(Feed):
        """Places are numbers; what was asked of the source is written down."""

        schema = "n long, twice long"

        def __init__(self, n, trace):
            self.n, self.trace = n, trace

        def _write(self, *what):
            with open(self.trace, "a") as f:
                f.write(" ".join(map(str, what)) + "\n")

        def end(self):
            return self.n

        def pieces(self, start, stop):
            self._write("plan", start, stop)
            return [(i, min(i + 10, stop)) for i in range(start, stop, 10)]

        def read(self, piece, columns, filters):
            n = pa.array(range(*piece), pa.int64())
            all_ = {"n": n, "twice": pa.array([2 * x.as_py() for x in n], pa.int64())}
            yield pa.RecordBatch.from_arrays([all_[c] for c in columns], names=list(columns))

    return Numbers(n, trace)


def test_a_source_is_held_back_and_goes_on_after_a_restart(spark, tmp_path):
    own, trace = stream_session(spark), str(tmp_path / "trace")
    places = {k: str(tmp_path / k) for k in ("path", "checkpoint")}
    for n, want in ((70, 70), (70, 70), (205, 205)):
        register(own, "numbers", numbers(n, trace))
        stream = own.readStream.format("numbers").option("ahead", 30).option("marks", str(tmp_path / "marks")).load()
        got = run(stream, until_idle=True, **places)
        assert sorted(r.n for r in got.collect()) == list(range(want))
    plans = [tuple(map(int, line.split()[1:])) for line in open(trace)]
    assert all(0 < b - a <= 30 for a, b in plans)  # never more than that beyond what has been processed
    assert [p[0] for p in plans] == [0, *[p[1] for p in plans[:-1]]]
    with pytest.raises(Exception, match="marks"):
        run(own.readStream.format("numbers").option("ahead", 30).load())


def test_a_source_reads_the_asked_columns_and_rows_only(spark, data, tmp_path):
    own = stream_session(spark)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("s"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "rows"))
    register(own, "some_rows", ParquetFeed(str(tmp_path / "rows"), rows.schema, rows=150))
    df = own.read.format("some_rows").load().filter("k = 3 AND id >= 900 AND s LIKE '%x'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert " = 3" not in plan and ">= 900" not in plan and "EndsWith" in plan  # Spark applies what is left
    assert sorted(r.id for r in df.collect()) == [i for i in range(900, 1000) if i % 7 == 3]
    assert own.read.format("some_rows").schema("id long").load().columns == ["id"]
    feed = ParquetFeed(str(tmp_path / "rows"), rows.schema, rows=150)
    assert feed.end() == 1000 and sum(b - a for _, a, b in feed.pieces(120, 640)) == 520
    got = [i for p in feed.pieces(120, 640) for b in feed.read(p, ["id"], ()) for i in b.column("id").to_pylist()]
    assert got == list(range(120, 640))


@pytest.mark.parametrize("together", [1, 2, 3, 9])
def test_a_log_is_replayed_in_any_epochs(spark, data, bids, together):
    e = Epochs(zoned(bids.withColumn("part", F.pmod("auction", F.lit(4))), "date_time"), "date_time", order="part", closing=90 * DAY)
    folder = log.capture(e.source(), "date_time", delay=40 * DAY)
    seen = []
    got = run(W.window_count(log.replay(e.spark, folder, together), "date_time", 21_600, 4, e.origin(21_600)), progress=seen, until_idle=True)
    assert V.verify(W.window_count(bids, "date_time", 21_600, 4), plain(got)).isEmpty()
    assert max(p.numInputRows for p in seen) >= bids.count() // 4 * min(together, 4) * 0.5
    marks = [r.frontier for r in log.progress(spark, folder).orderBy("batch").collect()]
    assert marks == sorted(marks)


def test_a_log_knows_late_rows_and_replaces_a_batch_that_is_run_again(spark):
    rows = spark.createDataFrame([(i, (1000, 1100, 100)[i % 3] + i, i % 3) for i in range(30)], "id long, s long, part long")
    e = Epochs(rows.select("id", F.timestamp_seconds("s").alias("t"), "part"), "t", order="part")
    with pytest.raises(Exception, match="frontier"):
        log.capture(e.source(), "t")
    folder = log.capture(e.source(), "t", allow_late=True)
    assert [(r.batch, r.rows, r.late) for r in log.progress(spark, folder).orderBy("batch").collect()] == [(0, 10, 0), (1, 10, 0), (2, 0, 10)]
    kept = run(log.replay(e.spark, folder), until_idle=True)
    assert sorted(r.id for r in kept.collect()) == [i for i in range(30) if i % 3 < 2]
    # a checkpoint that has gone on without the log: the log would miss a batch
    run_batches(e.source(), lambda b, i: None, checkpoint=f"{folder}/other")
    spark.createDataFrame([(99, datetime.datetime(2024, 1, 1), 0, False)], "id long, t timestamp, part long, _closing boolean").coalesce(1).write.mode(
        "append").parquet(e.path)
    with pytest.raises(Exception, match="no batch"):
        log.capture(e.source(), "t", folder=f"{folder}-new", checkpoint=f"{folder}/other")


def test_the_probe_hears_of_every_batch_and_of_errors(spark, epochs):
    heard = probe(epochs.spark)
    seen = []
    run(W.highest_bid(epochs.stream(), "date_time", "price", 3600), progress=seen)
    assert [p.batchId for p in seen] == list(range(len(seen))) and len(seen) >= 4
    bad = epochs.stream().select(F.raise_error(F.lit("no")).alias("x"))
    query = bad.writeStream.format("noop").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no"):
        query.awaitTermination()
    assert heard.wait_while(lambda: not heard.over.get(str(query.runId), False), 30)
    assert not heard.done(query) and heard.less_than(query, 0)


def test_a_row_before_earlier_ones_of_its_key_fails_a_running_value(spark):
    rows = spark.range(30).select((F.col("id") % 2).alias("k"), (40 - F.col("id")).alias("v"), F.timestamp_seconds("id").alias("ts"))
    e = Epochs(rows, "ts", epochs=3)
    with pytest.raises(Exception, match="earlier batch"):
        running_batches(e.stream(), ["k"], ["v"], {"s": ("sum", "v")})
    with pytest.raises(Exception, match="earlier batch"):
        trailing_batches(e.stream(), ["k"], ["v"], 3, {"s": F.sum("v")})


def test_a_carry_writes_what_a_batch_touches(spark, tmp_path):
    schema = "k long, n long"
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    kept = Carry(str(tmp_path), spark.createDataFrame([], schema).schema, add)
    want = {}
    for number in range(23):
        rows = [(number * 7 % 11 + j, 1) for j in range(3)] + ([(1000 + i, 1) for i in range(500)] if number == 2 else [])
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2 if number % 5 == 0 else 1):  # some batches come again
            got = dict(map(tuple, add(kept.before(spark, number, batch, ["k"])).collect()))
            assert got == {k: want[k] for k, _ in rows if k in want}
            kept.add(spark, number, batch)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
    runs = kept._runs(spark, 22)
    assert len(runs) <= 3 * 3 and dict(map(tuple, add(kept._read(spark, runs)).collect())) == want
    there = {p.name for p in tmp_path.iterdir() if p.name.startswith("run")}
    assert {name for _, name in runs} <= there and len(there) <= len(runs) + 2 * 4
    with pytest.raises(ValueError, match="no carry"):
        kept.add(spark, 40, spark.createDataFrame([(1, 1)], schema))


def test_a_failed_batch_leaves_nothing_and_a_repeated_one_counts_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    own, outlet = stream_session(spark), files.TaggedFiles(folder, "output")
    batch = lambda *rows: iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["output", "n"])])
    first = outlet.write(batch(("a", 1), ("b", 2)))
    again = outlet.write(batch(("a", 1), ("b", 2)))
    outlet.commit([first], 0)
    outlet.commit([again], 0)
    lost = outlet.write(batch(("a", 9)))
    outlet.abort([lost], 1)
    outlet.commit([outlet.write(batch(("a", 3)))], 1)
    got = lambda tag: rows_of(files.committed(spark, folder, tag, "n long"))
    assert got("a") == [1, 3] and got("b") == [2] and got("c") == []
    # a stream whose second batch fails
    path = new_path(spark, "in")
    for n in (1, 2):
        spark.createDataFrame([("a", n)], "output string, n long").coalesce(1).write.mode("append").parquet(path)
    bad = own.readStream.schema("output string, n long").option("maxFilesPerTrigger", 1).parquet(path)
    where, marks = str(tmp_path / "other"), str(tmp_path / "marks")
    with pytest.raises(Exception, match="two"):
        files.run_outputs(bad.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("two")).cast("long")).otherwise(F.col("n"))), {"a": "n long"}, where, marks)
    assert rows_of(files.committed(spark, where, "a", "n long")) == [1]
    tables = files.run_outputs(bad, {"a": "n long"}, where, marks)  # goes on with the batch that failed
    assert rows_of(tables["a"]) == [1, 2]


def rows_of(df):
    return sorted(r[0] for r in df.collect())


def test_rows_wait_for_the_clock(spark, small_chunks):
    """Ticks come in later epochs than the rows they are for; rows of one time wait in several shards."""
    at = lambda s: START_OF + datetime.timedelta(seconds=s)
    data = _laid_down(spark, [(1, i, at(i // 3), "x") for i in range(300)], ORDERED, 3).withWatermark("ts", "0 seconds").drop("key")
    ticks = _laid_down(spark, [(1, i, at(t), "") for i, t in enumerate((90, 5, 50, 5, 20))], ORDERED, 5).withWatermark("ts", "1 hour").select("ts")
    got = run(ordered.reclock(data, ticks, "ts", "tick", shards=3))
    found = {r.id: r.tick for r in got.collect() if r.id >= 0}
    want = {i: next((at(t) for t in (5, 20, 50, 90) if t >= i // 3), None) for i in range(300)}
    assert {i: t for i, t in found.items() if t.year < 2100} == {i: t for i, t in want.items() if t}


def test_state_handles(spark):
    rows = [(1, i, START_OF + datetime.timedelta(seconds=i), "") for i in range(6)]

    def on_rows(key, rows, own):
        seen = []
        assert own.map.get(("a", 1)) is None and own.map.remove(("a", 1)) is None and own.value.take() is None
        own.map.insert(("b", 2), (5,))
        own.map.insert(("a", 7), (1,))
        own.map.insert(("a", 2), (2,))
        own.map.rmw(("a", 2), 10)
        seen.append(str(own.map.iterate(("a",))))
        seen.append(str((own.map.contains(("b", 2)), own.map.remove(("b", 2)), own.map.contains(("b", 2)))))
        own.count.increase(5)
        own.count.decrease(2)
        seen.append(str((own.count.get(), own.count.set(9), own.count.get())))
        own.value.set((1, "x"))
        seen.append(str((own.value.rmw((2, "y")), own.value.get(), own.value.take(), own.value.get())))
        own.items.append((1,), (2,))
        own.items.append((3,))
        seen.append(str((own.items.get(), own.items.take(), own.items.get())))
        return pd.DataFrame({"key": key[0], "seen": seen})

    states = {"count": ordered.Count(), "value": ordered.Value("a long, b string", lambda old, new: (old[0] + new[0], old[1] + new[1])),
              "map": ordered.Map("k string, i long", "n long", lambda old, more: ((old[0] if old else 0) + more,)), "items": ordered.Items("n long")}
    stream = _laid_down(spark, rows, ORDERED, 1).withWatermark("ts", "0 seconds").filter("key = 1 OR key = -1")
    got = run(ordered.with_state(stream, ["key"], "ts", ["id"], states, "key long, seen string", on_rows))
    assert {r.seen for r in got.filter("key = 1").collect()} == {
        "[(('a', 2), (12,)), (('a', 7), (1,))]", "(True, (5,), False)", "(3, None, 9)",
        "((3, 'xy'), (3, 'xy'), (3, 'xy'), None)", "([(1,), (2,), (3,)], [(1,), (2,), (3,)], [])"}


def test_keys_share_their_state(spark):
    """Very many small keys are kept in a bounded number of entries."""
    rows = spark.range(6000).select((F.col("id") % 3000).alias("user_id"), "id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), F.col("id").alias("value"))
    e = Epochs(rows, "ts", epochs=2, closing=90 * DAY)
    seen = []
    got = run(state.running_sum(e.stream().select(F.col("user_id").alias("key"), "id", "ts", "value")), progress=seen)
    want = {(i % 3000, i): i if i < 3000 else 2 * i - 3000 for i in range(6000)}
    assert {(r.key, r.id): r.running for r in got.filter("key >= 0").collect()} == want
    assert max(s.numRowsTotal for p in seen for s in p.stateOperators) < 2.5 * 3000  # five a key before


def test_many_keys_are_handled_together(spark):
    rows = [(i % 900, i, START_OF + datetime.timedelta(seconds=i), "") for i in range(1800)]

    def on_rows(rows, kept):
        new = pd.concat([kept[["key", "n"]], rows[["key"]].assign(n=1)]).groupby("key", as_index=False)["n"].sum()
        return new.assign(timer=1_800_000_000_000 + new["key"])

    stream = _laid_down(spark, rows[::-1], ORDERED, 2).withWatermark("ts", "1 hour")
    seen = []
    got = run(ordered.together(stream, ["key"], "key long, n long, timer long", "key long, n long", on_rows, lambda due: due[["key", "n"]]), progress=seen)
    assert sorted(map(tuple, got.filter("key >= 0").collect())) == [(k, 2) for k in range(900)]


def test_ticks_are_kept_in_pieces(spark):
    """As many ticks as rows, in three shards: their state does not hold them one by one."""
    rows = [(1, i, START_OF + datetime.timedelta(seconds=i), "") for i in range(3000)]
    both = [_laid_down(spark, rows, ORDERED, 2).withWatermark("ts", "0 seconds") for _ in range(2)]
    seen = []
    got = run(ordered.reclock(both[0].select("id", "ts"), both[1].select((F.col("ts") + F.expr("INTERVAL '500' MILLISECOND")).alias("ts")), "ts", "tick", shards=3), progress=seen)
    assert all((r.tick - r.ts).total_seconds() == 0.5 for r in got.collect()) and got.count() >= 3000
    assert max(s.numRowsTotal for p in seen for s in p.stateOperators) < 100


def test_a_sink_is_found_whatever_session_is_active(spark, tmp_path):
    own, other = stream_session(spark), spark.newSession()
    path = new_path(spark, "in")
    spark.createDataFrame([("a", 1)], "output string, n long").coalesce(1).write.parquet(path)
    stream = own.readStream.schema("output string, n long").parquet(path)
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    for change in (lambda: sessions.setActiveSession(other._jsparkSession), sessions.clearActiveSession):
        change()
        try:
            tables = files.run_outputs(stream, {"a": "n long"})
        finally:
            sessions.setActiveSession(before.get() if before.isDefined() else spark._jsparkSession)
        assert rows_of(tables["a"]) == [1]


def test_rows_that_are_delayed_beyond_the_end_leave(spark, tmp_path):
    """A delay of 372 days, and times in whole milliseconds, at which the closing row would leave too."""
    rows = [(i, START_OF + datetime.timedelta(seconds=i), (9000, 3, 80)[i % 3]) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.ts for r in streams.delay_rows(spark, str(tmp_path)).collect()}
    assert got == {i: at + datetime.timedelta(hours=max(0, user - 75)) for i, at, user in rows}


def test_joins_keep_their_sides_as_tables(spark, data, tmp_path, monkeypatch):
    """Batch by batch, over several runs with the same folders; no row of a side is in Spark's state store."""
    seen, plain_run = [], SJ.run_batches
    monkeypatch.setattr(SJ, "run_batches", lambda *args, **how: seen.extend(plain_run(*args, **how)))
    a = zoned(S.auctions(spark, data), "date_time", "expires")
    b = zoned(S.bids(spark, data), "date_time")
    given = {name: str(tmp_path / name) for name in ("a", "b")}
    a.limit(0).write.parquet(given["a"])
    b.limit(0).write.parquet(given["b"])
    streams_of = lambda: [stream_session(spark).readStream.schema(df.schema).parquet(given[n]) for n, df in (("a", a), ("b", b))]
    year, cuts = lambda n: f"timestamp '{n}-01-01 00:00:00 UTC'", [1900, 1994, 1995, 1996, 1997, 1998, 2100]
    for lo, hi in zip(cuts, cuts[1:]):
        # auctions come by their expiry, up to two years after their bids
        a.filter(f"expires >= {year(lo)} AND expires < {year(hi)}").write.mode("append").parquet(given["a"])
        b.filter(f"date_time >= {year(lo)} AND date_time < {year(hi)}").write.mode("append").parquet(given["b"])
        auctions, bids = streams_of()
        closed = SJ.closing_batches(auctions, bids, 730 * DAY, folder=str(tmp_path / "closing")).run(str(tmp_path / "closed"))
        pair = SJ.join_batches(bids.selectExpr("auction AS key", "price AS val", "date_time AS ts"),
                               auctions.selectExpr("id AS key", "seller AS val", "date_time AS ts"), SJ.hash_join, str(tmp_path / "sides"))
        joined = pair.run(str(tmp_path / "joined"))
    assert len(seen) >= 12 and not any(p.stateOperators for p in seen)
    assert V.verify(b.join(a, b["auction"] == a["id"]).select(b["price"].alias("val1"), a["seller"].alias("val2")), joined).isEmpty()
    # those that were open when the rows ended are still open
    end = min(b.agg(F.max("date_time")).first()[0], a.agg(F.max("expires")).first()[0])
    want = J.closed_auctions(S.auctions(spark, data), S.bids(spark, data)).filter(F.col("expires") <= F.lit(end).cast("timestamp_ntz"))
    assert 0 < want.count() and V.verify(want, plain(closed)).isEmpty()


def test_a_repeated_batch_of_a_join_gives_the_same_and_late_rows_fail(spark, tmp_path):
    own = stream_session(spark)
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    a_kind = "id long, reserve long, seller long, category long, expires timestamp, date_time timestamp"
    b_kind = "auction long, bidder long, price long, date_time timestamp"
    for n, df in (("a", own.createDataFrame([], a_kind)), ("b", own.createDataFrame([], b_kind))):
        df.write.parquet(str(tmp_path / n))
    a, b = (own.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in (("a", a_kind), ("b", b_kind)))
    closing = SJ.closing_batches(a, b, 100, folder=str(tmp_path / "closing"))

    def batch(auctions, bids):
        sides = [("a", own.createDataFrame([(i, 5, 7, 1, at(e), at(o)) for i, e, o in auctions], "id long, reserve long, seller long, category long, expires timestamp, opened timestamp")),
                 ("b", own.createDataFrame([(i, w, p, at(t)) for i, w, p, t in bids], "auction long, bidder long, price long, bid_time timestamp"))]
        kinds = dict(zip(("a", "b"), (closing.inputs.schema[n].dataType for n in ("a", "b"))))
        parts = [df.select(*[(F.struct(*df.columns) if m == n else F.lit(None).cast(kinds[m])).alias(m) for m in ("a", "b")]) for n, df in sides]
        return parts[0].unionByName(parts[1])

    def step(n, auctions, bids):
        return sorted((r.auction, r.price, r.bidder) for r in closing.step(batch(auctions, bids), n).collect())

    for _ in range(2):
        assert step(0, [(1, 50, 0), (2, 60, 0)], [(1, 1, 9, 10), (1, 2, 9, 11), (2, 1, 4, 12), (3, 1, 8, 20)]) == []
    for _ in range(2):  # the bid on 3 was there before its auction
        assert step(1, [(3, 110, 15)], [(2, 3, 6, 40), (2, 9, 99, 70)]) == [(1, 9, 1), (2, 6, 3)]
    assert step(2, [(4, 200, 120)], [(3, 4, 8, 109), (4, 1, 5, 130)]) == [(3, 8, 1)]
    with pytest.raises(DroppedRows):
        step(3, [], [(4, 1, 50, 129)])
    with pytest.raises(DroppedRows):
        step(3, [(5, 130, 100)], [])
    with pytest.raises(ValueError, match="longer than promised"):
        step(3, [(6, 500, 140)], [])
    assert step(3, [(6, 240, 140)], [(4, 2, 7, 150), (9, 1, 1, 240)]) == [(4, 7, 2)]
