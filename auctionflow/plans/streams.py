"""Queries that run as streams over the tables, laid down in time-ordered epochs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionflow.functions import cents, int_div, start_of_day
from auctionflow.operators import windows as W
from auctionflow.operators.basic import flat_map_words
from auctionflow.operators.running import running
from auctionflow.plans.auction import NEW_SELLER, SLICES, SLIDE
from auctionflow.session import new_path
from auctionflow.sources import capture
from auctionflow.sources import tables as S
from auctionflow.sources.custom import ParquetFeed, register
from auctionflow.streaming import joins as SJ
from auctionflow.streaming import late, log, ordered, state
from auctionflow.streaming.files import run_outputs
from auctionflow.streaming.running import running_batches, trailing_batches
from auctionflow.streaming.harness import Epochs, _results, plain, probe, real, run, run_batches, stream_session, zoned

DAY = 86_400
OPEN = 730 * DAY
FAR = 4000 * DAY
FIRST_OF_2024 = 1_704_067_200_000_000  # microseconds
FAR_AHEAD = 1_100_000_000_000  # ms, after all bids and auctions and before the closing row


def _ebids(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.event_bids(spark, d), "date_time"), "date_time", closing=90 * DAY)


def _bids(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.bids(spark, d), "date_time"), "date_time", closing=FAR)


def _auctions(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.auctions(spark, d), "date_time", "expires"), "date_time", closing=FAR)


def _auctions_by_expiry(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.auctions(spark, d), "date_time", "expires"), "expires", closing=FAR)


def _persons(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.persons(spark, d), "date_time"), "date_time")


def _events(spark: SparkSession, d: str) -> Epochs:
    return Epochs(zoned(S.table(spark, d, "events"), "ts"), "ts", closing=90 * DAY)


def _read(epochs: Epochs) -> DataFrame:
    return epochs.stream()


def window_count(spark, d):
    e = _ebids(spark, d)
    return plain(run(W.window_count(_read(e), "date_time", SLIDE, SLICES, e.origin(SLIDE))))


def keyed_window_count(spark, d):
    e = _ebids(spark, d)
    return plain(run(W.keyed_window_count(_read(e), "date_time", "auction", SLIDE, SLICES, e.origin(SLIDE))))


def window_rank(spark, d):
    """A closed window leaves the stream with all its counts; its ranks follow from them."""
    counts = keyed_window_count(spark, d)
    return running(counts, ["window_end"], ["auction"], {"_upto": ("sum", "n")}).select(
        "window_start", "window_end", "auction", (F.col("_upto") - F.col("n") + 1).alias("rank"), "n")


def hot_items(spark, d):
    e = _ebids(spark, d)
    return plain(run(W.hot_items(_read(e), "date_time", "auction", SLIDE, SLICES, e.origin(SLIDE))))


def highest_bid(spark, d):
    return plain(run(W.highest_bid(_read(_ebids(spark, d)), "date_time", "price", 3600)))


def new_users(spark, d):
    return run(SJ.new_sellers(_read(_persons(spark, d)), _read(_auctions(spark, d)), NEW_SELLER))


def local_items(spark, d):
    return run(SJ.local_items(_read(_auctions(spark, d)), _read(_persons(spark, d))))


def hash_join(spark, d):
    left = real(_read(_bids(spark, d))).select(F.col("auction").alias("key"), F.col("price").alias("val"), F.col("date_time").alias("ts"))
    right = real(_read(_auctions(spark, d))).select(F.col("id").alias("key"), F.col("seller").alias("val"), F.col("date_time").alias("ts"))
    return SJ.join_batches(left, right, SJ.hash_join).run()


def _closing(spark: SparkSession, d: str) -> SJ.Joined:
    return SJ.closing_batches(_read(_auctions_by_expiry(spark, d)), _read(_bids(spark, d)), OPEN)


def closed_auctions(spark, d):
    return plain(_closing(spark, d).run())


def closed_auctions_timers(spark, d):
    return plain(run(state.closing_auctions(_read(_auctions(spark, d)), _read(_bids(spark, d)))))


def q4_running(spark, d):
    """The category averages of the closed auctions, as they close."""
    slim = _closing(spark, d).select("category", "expires", "auction", "price")
    totals = running_batches(slim, ["category"], ["expires", "auction"],
                             {"total": ("sum", "price"), "n": ("count", "*")})
    return plain(totals.select("category", "expires", "auction",
                               int_div(F.col("total"), F.col("n")).alias("avg_price")))


def q6(spark, d):
    slim = _closing(spark, d).select("bidder", "expires", "auction", "price")
    last = trailing_batches(slim, ["bidder"], ["expires", "auction"], 10,
                            {"total": F.sum("price"), "n": F.count("*")})
    return plain(last.select("bidder", "expires", "auction",
                             int_div(F.col("total"), F.col("n")).alias("avg_price")))


def state_machine(spark, d):
    rows = real(_read(_events(spark, d))).select(
        "user_id", "event_id", "ts", cents(F.col("value")).alias("price"))
    sums = running_batches(rows, ["user_id"], ["ts", "event_id"], {"running": ("sum", "price")})
    return sums.select("user_id", "event_id", "running")


def state_machine_values(spark, d):
    """The same with a state value per key."""
    rows = _read(_events(spark, d)).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", cents(F.col("value")).alias("value"))
    return run(state.running_sum(rows)).filter("key >= 0").select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"), "running")


def state_machine_fold(spark, d):
    """A user's fold: running sums that start anew once they pass 100,000."""
    def fold(key, rows, state):
        total, out = state[0] if state else 0, []
        values = rows["price"].to_numpy()
        while len(out) < len(values):
            sums = values[len(out):].cumsum() + total
            over = int((sums <= 100_000).argmin()) + 1 if sums[-1] > 100_000 else len(sums)
            out.extend(sums[:over])
            total = 0 if sums[over - 1] > 100_000 else int(sums[over - 1])
        return rows[["user_id", "event_id"]].assign(running=out), (total,) if total else None

    rows = _read(_events(spark, d)).select("user_id", "event_id", "ts", cents(F.col("value")).alias("price"))
    return run(state.state_machine(rows, ["user_id"], "total long", "user_id long, event_id long, running long", fold,
                                   "ts", ["event_id"])).filter("user_id >= 0")


def ordered_steps(spark, d):
    """Each event with its number and the event before it, in four groups that hold a quarter of all rows
    each; every epoch's rows lie in its files in no order."""
    def fold(key, rows, state):
        n, before = state or (0, -1)
        ids = rows["event_id"].tolist()
        out = pd.DataFrame({"part": key[0], "event_id": ids, "step": range(n + 1, n + len(ids) + 1), "before": [before, *ids[:-1]]})
        return out, (n + len(ids), ids[-1])

    e = Epochs(zoned(S.table(spark, d, "events"), "ts"), "ts", closing=90 * DAY, shuffled=True)
    rows = _read(e).select(F.pmod("user_id", F.lit(4)).alias("part"), "event_id", "ts").withColumn(
        "part", F.when(F.col("event_id") >= 0, F.col("part")).otherwise(-1))
    return run(state.state_machine(rows, ["part"], "n long, before long", "part long, event_id long, step long, before long", fold,
                                   "ts", ["event_id"])).filter("part >= 0")


def unary_notify(spark, d):
    """Events counted per user and day, given out when the day is over; a count needs no order."""
    def on_rows(rows, seen):
        new = rows[["user_id", "day"]].assign(n=1)
        n = pd.concat([seen[["user_id", "day", "n"]], new]).groupby(["user_id", "day"], as_index=False)["n"].sum()
        return n.assign(timer=(n["day"] + 1) * DAY * 1000)

    rows = _read(_events(spark, d)).select("user_id", int_div(F.unix_micros("ts"), F.lit(DAY * 1_000_000)).alias("day"), "ts")
    out = run(ordered.together(rows, ["user_id", "day"], "user_id long, day long, n long, timer long", "user_id long, day long, n long",
                               on_rows, lambda due: due[["user_id", "day", "n"]]))
    return out.filter("day >= 0 AND user_id >= 0")


def binary_notify(spark, d):
    """Bids and auctions per auction number, counted on both sides until the end of the streams, in any order."""
    def on_rows(rows, seen):
        new = pd.DataFrame({"auction": rows["auction"], "bids": rows["is_bid"].astype("int64"), "auctions": 1 - rows["is_bid"].astype("int64")})
        return pd.concat([seen[["auction", "bids", "auctions"]], new]).groupby("auction", as_index=False).sum().assign(timer=FAR_AHEAD)

    bids = _read(_bids(spark, d)).select("auction", "date_time", F.lit(True).alias("is_bid"))
    auctions = _read(_auctions(spark, d)).select(F.col("id").alias("auction"), "date_time", F.lit(False).alias("is_bid"))
    out = run(ordered.together(bids.unionByName(auctions), ["auction"], "auction long, bids long, auctions long, timer long",
                               "auction long, bids long, auctions long", on_rows, lambda due: due[["auction", "bids", "auctions"]]))
    return out.filter("auction >= 0")


def delay_rows(spark, d):
    later = F.col("ts") + F.expr("make_dt_interval(0, CAST(user_id - 75 AS INT))")
    events = zoned(S.table(spark, d, "events"), "ts")
    longest = events.agg(F.max(F.col("user_id") - 75)).first()[0] or 0  # hours, as the last row must pass them all
    rows = _read(Epochs(events, "ts", closing=90 * DAY + max(0, longest) * 3600)).select(
        F.pmod("event_id", F.lit(1024)).alias("key"), F.col("event_id").alias("id"), "ts",
        later.alias("new_ts"))
    return plain(run(state.hold(rows))).withColumnRenamed("id", "event_id").filter("event_id >= 0")


def reclock(spark, d):
    """Every event but errors leaves with the next error, by a stream of its own."""
    e = _events(spark, d)
    rows = _read(e).filter("event_type <> 'error'").select("event_id", "ts")
    ticks = _read(_events(spark, d)).filter("event_type = 'error' OR event_id < 0").select("ts")
    return plain(run(ordered.reclock(rows, ticks, "ts", "tick"))).filter("event_id >= 0 AND tick < TIMESTAMP_NTZ'2024-03-01 00:00:00'")


def state_count(spark, d):
    """A number per user: a click adds one, a view takes one off, an error sets it to ten."""
    def on_rows(key, rows, own):
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"]):
            if kind == "click":
                own.n.increase()
            elif kind == "view":
                own.n.decrease(1)
            elif kind == "error":
                own.n.set(10)
            out.append((key[0], event, own.n.get()))
        return pd.DataFrame(out, columns=["user_id", "event_id", "n"])

    return _handled(spark, d, {"n": ordered.Count()}, "user_id long, event_id long, n long", on_rows)


def state_value(spark, d):
    """The highest price of a user since the error before, taken at each error; none is -1."""
    def on_rows(key, rows, own):
        out = []
        for event, kind, price in zip(rows["event_id"], rows["event_type"], rows["price"]):
            if kind == "error":
                had = own.top.get()
                taken = own.top.take()
                assert had == taken and own.top.get() is None
                out.append((key[0], event, taken[0] if taken else -1))
            else:
                own.top.rmw(price)
        return pd.DataFrame(out, columns=["user_id", "event_id", "top"])

    top = ordered.Value("price long", lambda old, price: (int(price) if old is None else max(old[0], int(price)),))
    return _handled(spark, d, {"top": top}, "user_id long, event_id long, top long", on_rows)


def state_map(spark, d):
    """Events of a user counted by type and weekday since the error before; an error lists the clicks in order and removes them all."""
    def on_rows(key, rows, own):
        out = []
        for event, kind, day in zip(rows["event_id"], rows["event_type"], rows["ts"].dt.dayofweek.tolist()):
            if kind != "error":
                own.seen.rmw((kind, day), 1)
                continue
            clicks = own.seen.iterate(("click",))
            out.append((key[0], event, ",".join(f"{k[1]}={v[0]}" for k, v in clicks)))
            for k, _ in own.seen.iterate():
                own.seen.remove(k)
        return pd.DataFrame(out, columns=["user_id", "event_id", "clicks"])

    seen = ordered.Map("kind string, day long", "n long", lambda old, more: ((old[0] if old else 0) + more,))
    return _handled(spark, d, {"seen": seen}, "user_id long, event_id long, clicks string", on_rows)


def state_list(spark, d):
    """The events of a user between two errors, as a list."""
    def on_rows(key, rows, own):
        out = []
        for event, kind in zip(rows["event_id"].tolist(), rows["event_type"]):
            if kind == "error":
                out.append((key[0], event, ",".join(str(v[0]) for v in own.since.take())))
            else:
                own.since.append((event,))
        return pd.DataFrame(out, columns=["user_id", "event_id", "since"])

    return _handled(spark, d, {"since": ordered.Items("event_id long")}, "user_id long, event_id long, since string", on_rows)


def _handled(spark: SparkSession, d: str, states: dict, schema: str, on_rows) -> DataFrame:
    rows = _read(_events(spark, d)).select("user_id", "event_id", "event_type", "ts", cents(F.col("value")).alias("price"))
    return run(ordered.with_state(rows, ["user_id"], "ts", ["event_id"], states, schema, on_rows)).filter("user_id >= 0")


def many_outputs(spark, d):
    """Three inputs and two outputs of one pass: how often each user was seen so far, and which input came before another."""
    events = _read(_events(spark, d)).select("user_id", "event_id", "event_type", "ts")
    inputs = {kind: events.filter(f"event_type = '{kind}' OR event_id < 0").select("user_id", "event_id", "ts") for kind in ("click", "view", "error")}

    def on_rows(key, rows, state):
        n, last = state or (0, "")
        before = [last, *rows["input"].tolist()[:-1]]
        seen = pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "n": range(n + 1, n + 1 + len(rows))})
        turns = pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "turn": [f"{a}>{b}" for a, b in zip(before, rows["input"])]})
        changed = [a not in ("", b) for a, b in zip(before, rows["input"])]
        return {"seen": seen, "turns": turns[changed]}, (n + len(rows), rows["input"].iloc[-1]), ()

    outputs = {"seen": "user_id long, event_id long, n long", "turns": "user_id long, event_id long, turn string"}
    tables = run_outputs(ordered.operator(inputs, ["user_id"], "ts", ["event_id"], "n long, last string", outputs, on_rows), outputs)
    return tables["seen"].join(tables["turns"], ["user_id", "event_id"], "left").filter("user_id >= 0")


def counter(spark, d):
    rows = real(_read(_events(spark, d))).select(F.col("user_id").alias("key"))
    return _last(state.count_changes(rows), ["key"], "n").withColumnRenamed("key", "user_id")


def map_merge(spark, d):
    rows = real(_read(_events(spark, d))).select(
        F.col("user_id").alias("key"), F.col("event_type").alias("item"), F.lit(1).cast("bigint").alias("n"))
    return _last(state.map_changes(rows), ["key", "item"], "n").select(
        F.col("key").alias("user_id"), F.col("item").alias("event_type"), "n")


def _last(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The newest value per key of an update-mode stream whose values only grow."""
    return _batches(stream, "update").groupBy(*keys).agg(F.max(value).alias(value))


def _batches(stream: DataFrame, mode: str) -> DataFrame:
    """All rows of all micro-batches; each batch has its own folder, which a retry overwrites."""
    path = new_path(stream.sparkSession, "batches")
    run_batches(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}"), mode)
    return _results(stream.sparkSession, stream.schema, f"{path}/*")


def wordcount(spark, d):
    docs = S.table(spark, d, "documents").select(
        F.timestamp_seconds("doc_id").alias("ts"), "doc_id", "text")
    words = flat_map_words(_read(Epochs(docs, "ts")), "text", ["ts"])
    return _last(words.groupBy("word").agg(F.count("*").alias("n")), ["word"], "n")


def distinct_per_time(spark, d):
    bids = real(_read(_ebids(spark, d)))
    days = bids.select(F.window("date_time", "1 day").alias("w"), "auction")
    firsts = days.groupBy("w", "auction").agg(F.count("*").alias("n"))
    return plain(_batches(firsts, "update").select(F.col("w.start").alias("time"), "auction").distinct())


def _thirds(spark: SparkSession, d: str, **how) -> Epochs:
    """The event bids in three epochs of ten days, by the calendar."""
    rows = S.event_bids(spark, d).withColumn("third", F.least(F.lit(2), int_div(F.dayofmonth("date_time") - 1, F.lit(10))).cast("bigint"))
    return Epochs(zoned(rows, "date_time"), "date_time", order="third", **how)


def epochs(spark, d):
    """Every record with the epoch it arrived in."""
    path = new_path(spark, "epochs-seen")
    run_batches(_thirds(spark, d).stream().drop("_closing", "third"), lambda b, i: b.withColumn("epoch", F.lit(i).cast("bigint"))
                .write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return plain(spark.read.parquet(f"{path}/*"))


def out_of_order(spark, d):
    """Records arrive by event type, each type over all times; the watermark waits for all of them."""
    number = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END").cast("bigint")
    rows = zoned(S.table(spark, d, "events").select(
        F.col("user_id").alias("auction"), F.col("ts").alias("date_time"), number.alias("kind")), "date_time")
    e = Epochs(rows, "date_time", closing=90 * DAY, order="kind")
    stream = e.stream(delay="40 days")
    return plain(run(W.window_count(stream, "date_time", SLIDE, SLICES, e.origin(SLIDE))))


def watermark(spark, d):
    """Per micro-batch: rows read and how far the watermark had come."""
    seen = []
    run(W.highest_bid(_thirds(spark, d, closing=90 * DAY).stream(), "date_time", "price", 3600), progress=seen)
    rows = [(p.batchId, p.numInputRows, (p.eventTime or {}).get("watermark")) for p in seen]
    return spark.createDataFrame(rows, "batch long, input_rows long, watermark string")


def progress_report(spark, d):
    """Rows read, dropped and kept as state per micro-batch of a plain pass."""
    e, seen = _thirds(spark, d, closing=90 * DAY), []
    run(W.window_count(e.stream(), "date_time", SLIDE, SLICES, e.origin(SLIDE)), progress=seen)
    rows = [(p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
             sum(s.numRowsTotal for s in p.stateOperators)) for p in seen]
    return spark.createDataFrame(rows, "batch long, input_rows long, dropped_rows long, state_rows long")


def probe_answers(spark, d):
    """Epochs are given to a running query one by one; after each, the probe is asked of every day's start
    whether rows before it, or up to it, are still to come."""
    rows = zoned(S.event_bids(spark, d), "date_time").withColumn("third", F.least(F.lit(2), int_div(F.dayofmonth("date_time") - 1, F.lit(10))))
    own, path, answers = stream_session(spark), new_path(spark, "given"), []
    heard = probe(own)
    rows.limit(0).write.parquet(path)
    stream = own.readStream.schema(rows.schema).parquet(path).withWatermark("date_time", "0 seconds")
    query = (W.highest_bid(stream, "date_time", "price", 3600).writeStream.format("noop").outputMode("append")
             .option("checkpointLocation", new_path(own, "progress")).trigger(processingTime="0 seconds").start())
    for third in range(3):
        rows.filter(F.col("third") == third).write.mode("append").parquet(path)
        query.processAllAvailable()
        heard.catch_up(query)
        for day in range(1, 31):
            start = FIRST_OF_2024 + (day - 1) * DAY * 1_000_000
            answers.append((third, day, heard.less_than(query, start), heard.less_equal(query, start), heard.done(query)))
    query.stop()
    heard.catch_up(query)
    answers.append((3, 31, heard.less_than(query, 2**62), heard.less_equal(query, 2**62), heard.done(query)))
    return spark.createDataFrame(answers, "epoch long, day long, before boolean, upto boolean, over boolean")


def capture_live(spark, d):
    """A stream whose rows come up to three days out of order is kept as a log, and the log replayed two
    batches at a time into windows."""
    e = _disordered(spark, d)
    folder = log.capture(e.source(), "date_time", delay=4 * DAY)
    return plain(run(W.window_count(log.replay(e.spark, folder, together=2), "date_time", SLIDE, SLICES, e.origin(SLIDE)), until_idle=True))


def capture_progress(spark, d):
    """What the same log says of its batches."""
    e = _disordered(spark, d)
    return log.progress(e.spark, log.capture(e.source().drop("_closing", "part"), "date_time", delay=4 * DAY)).filter("rows > 0")


def _disordered(spark: SparkSession, d: str) -> Epochs:
    late = F.dayofmonth("date_time") + F.pmod("auction", F.lit(3))
    rows = S.event_bids(spark, d).withColumn("part", int_div(late, F.lit(8)))
    return Epochs(zoned(rows, "date_time"), "date_time", order="part", closing=90 * DAY)


def custom_stream(spark, d):
    """The events as a source of the user's, read as a stream up to a half, then by another run to the end,
    never more than a fifth of it ahead."""
    own = stream_session(spark)
    rows = zoned(S.table(spark, d, "events"), "ts")
    path, n = new_path(spark, "feed"), rows.count()
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    out, mark, marks = (new_path(spark, x) for x in ("sink", "progress", "marks"))
    for limit in (n // 2, None):
        register(own, "event_feed", ParquetFeed(path, rows.schema, rows=n // 20 + 1, limit=limit))
        stream = own.readStream.format("event_feed").option("ahead", n // 5 + 1).option("marks", marks).load()
        got = run(stream, path=out, checkpoint=mark, until_idle=True)
    return plain(got)


def custom_pushdown(spark, d):
    """Two columns of some rows of the same source; the source applies the filters itself."""
    own = stream_session(spark)
    rows, path = zoned(S.table(spark, d, "events"), "ts"), new_path(spark, "feed")
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    register(own, "event_rows", ParquetFeed(path, rows.schema))
    kept = T.StructType([rows.schema[c] for c in ("event_id", "user_id", "event_type")])
    return own.read.format("event_rows").schema(kept).load().filter("event_type = 'click' AND user_id < 40").select("event_id", "user_id")


def late_rows(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_shipdate")
    e = Epochs(zoned(rows, "l_shipdate"), "l_shipdate", order="l_linenumber")
    return plain(late.split_late(e.source().drop("_closing"), "l_shipdate", 5 * 365 * DAY)[1])


def capture_replay(spark, d):
    """Two captured streams, replayed as one."""
    bids = S.event_bids(spark, d).withColumn("time", start_of_day("date_time"))
    paths = []
    for part in (bids.filter("price % 2 = 0"), bids.filter("price % 2 <> 0")):
        paths.append(new_path(spark, "captured"))
        part.write.partitionBy("time").parquet(paths[-1])
    return run(capture.replay(spark, bids.schema, paths))


def foreach_batch_sink(spark, d):
    return plain(_batches(real(_read(_ebids(spark, d))), "append"))


def observe_metrics(spark, d):
    """Counts and extremes gathered while the rows pass by."""
    seen = Observation("bids")
    S.bids(spark, d).observe(
        seen, F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"),
    ).write.format("noop").mode("overwrite").save()
    m = seen.get
    return spark.createDataFrame([(m["n"], m["lowest"], m["highest"])], "n long, lowest long, highest long")


def stream_observe(spark, d):
    """The same per micro-batch of a stream, told with its progress while the rows go on to a sink."""
    seen = []
    stream = real(_thirds(spark, d).stream()).observe(
        "bids", F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"),
        F.min("date_time").alias("first"), F.max("date_time").alias("last"))
    run(stream, progress=seen)
    rows = [(p.batchId, *(p.observedMetrics["bids"][c] for c in ("n", "lowest", "highest"))) for p in seen if p.numInputRows]
    return spark.createDataFrame(rows, "batch long, n long, lowest long, highest long")


STREAMS = {
    "stream_window_count": window_count, "stream_keyed_window_count": keyed_window_count,
    "stream_window_rank": window_rank, "stream_hot_items": hot_items, "stream_highest_bid": highest_bid,
    "stream_new_users": new_users, "stream_local_items": local_items, "stream_hash_join": hash_join,
    "stream_closed_auctions": closed_auctions, "stream_closed_auctions_timers": closed_auctions_timers,
    "stream_state_machine": state_machine, "stream_state_machine_fold": state_machine_fold,
    "stream_ordered_steps": ordered_steps,
    "stream_unary_notify": unary_notify, "stream_binary_notify": binary_notify,
    "stream_state_machine_values": state_machine_values, "stream_q4_avg_price_running": q4_running,
    "stream_q6_last10_avg": q6, "stream_delay_rows": delay_rows, "state_counter": counter,
    "state_map_merge": map_merge, "stream_reclock": reclock, "state_count": state_count, "state_value": state_value,
    "state_map": state_map, "state_list": state_list, "stream_many_outputs": many_outputs, "stream_wordcount": wordcount, "stream_distinct": distinct_per_time,
    "stream_epochs": epochs, "stream_out_of_order": out_of_order, "stream_watermark": watermark,
    "progress_report": progress_report, "probe_answers": probe_answers, "capture_live": capture_live,
    "capture_progress": capture_progress, "stream_custom_source": custom_stream, "custom_source_pushdown": custom_pushdown, "stream_late_rows": late_rows, "capture_replay": capture_replay,
    "foreach_batch_sink": foreach_batch_sink, "observe_metrics": observe_metrics, "stream_observe_metrics": stream_observe,
}
