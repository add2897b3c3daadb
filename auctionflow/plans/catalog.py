"""Every batch query by name: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionflow import functions as X
from auctionflow.operators import aggregates as A
from auctionflow.operators import basic as B
from auctionflow.operators import graph as G
from auctionflow.operators import iterate as I
from auctionflow.operators import joins as J
from auctionflow.operators import reports as R
from auctionflow.operators import timing as T
from auctionflow.operators import udf as U
from auctionflow.operators import verify as V
from auctionflow.operators import windows as W
from auctionflow.plans import auction as Q
from auctionflow.session import spread
from auctionflow.sources import capture, kafka
from auctionflow.sources import tables as S
from auctionflow.sources.custom import from_function

SLIDE, SLICES = Q.SLIDE, Q.SLICES


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    day = X.start_of_day("date_time")
    return S.event_bids(spark, d).select(day.alias("time"), "auction", "price")


def _windowed(fn, *args, **kw):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fn(S.event_bids(spark, d).select("auction", "date_time"), "date_time", *args, SLIDE, SLICES, **kw)
    return run


def _words(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(S.table(spark, d, "documents").select(F.col("doc_id").alias("time"), "text"))
    return B.flat_map_words(docs, "text", ["time"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("ts", F.round(F.col("value") * 10_000).cast("bigint").alias("latency_ns"))


def map_project(spark, d):
    return S.bids(spark, d).select("auction", (F.col("price") + 1).alias("price_plus_one"))


def flat_map_words(spark, d):
    return _words(spark, d).withColumnRenamed("time", "doc_id")


def flat_map_range(spark, d):
    parts = S.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    return B.flat_map_range(parts, "p_size", ["p_partkey"])


def filter_mod(spark, d):
    return S.bids(spark, d).filter("price % 2 = 0")


def branch_true(spark, d):
    return B.branch(S.bids(spark, d), F.col("price") % 2 == 0)[1]


def branch_false(spark, d):
    return B.branch(S.bids(spark, d), F.col("price") % 2 == 0)[0]


def branch_when_after(spark, d):
    return B.branch_when(S.event_bids(spark, d), "date_time", "2024-01-15 00:00:00")[1]


def partition_route(spark, d):
    return B.route(S.bids(spark, d), F.col("auction"), 7).select("auction", "price", "part")


def exchange_by_key(spark, d):
    return B.exchange(S.bids(spark, d), "auction")


def exchange_by_id(spark, d):
    return B.exchange_by_id(S.bids(spark, d), "auction", 8)


def broadcast_join(spark, d):
    people = S.persons(spark, d).select(F.col("id").alias("person"), "name")
    return B.lookup_join(S.auctions(spark, d).select("id", "seller"), people, "seller", "person").select("id", "name")


def hash_join(spark, d):
    left = S.bids(spark, d).select(F.col("auction").alias("key"), F.col("price").alias("val"))
    right = S.auctions(spark, d).select(F.col("id").alias("key"), F.col("seller").alias("val"))
    return J.hash_join(left, right).select("val1", "val2")


def aggregate_sum(spark, d):
    return A.aggregate(_daily(spark, d), "time", ["auction"], total=F.sum("price"))


def aggregate_collect_len(spark, d):
    return A.aggregate(_daily(spark, d), "time", ["auction"], n=F.count("*"))


def count_per_time(spark, d):
    return A.aggregate(_daily(spark, d), "time", [], n=F.count("*"))


def accumulate_per_time(spark, d):
    return A.aggregate(_daily(spark, d), "time", [], total=F.sum("price"), top=F.max("price"))


def distinct_per_time(spark, d):
    return A.distinct_per_time(_daily(spark, d), "time", "auction")


def wordcount_final(spark, d):
    return A.word_counts(_words(spark, d))


def wordcount_running(spark, d):
    return A.running_word_counts(_words(spark, d))


def wordcount_diffs(spark, d):
    """Words come with their document and go again a hundred documents later."""
    one = F.lit(1).cast("bigint")
    come = F.struct("time", one.alias("diff"))
    go = F.struct((F.col("time") + 100).alias("time"), (-one).alias("diff"))
    return A.running_diffs(_words(spark, d).select("word", F.inline(F.array(come, go))))


def compact_diffs(spark, d):
    sign = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).cast("bigint")
    return A.compact(_events(spark, d).select("user_id", sign.alias("diff")), ["user_id"])


def window_count_sparse(spark, d):
    """One-minute slides, five slices: most windows hold few records and there are gaps."""
    return W.window_count(S.event_bids(spark, d), "date_time", 60, 5, fill_gaps=True)


def verify_equal(spark, d):
    """A pass-through against a copy whose error rows were doubled and whose views are gone."""
    correct = _events(spark, d).select("ts", "user_id", "event_type")
    output = correct.filter("event_type <> 'view'").unionByName(correct.filter("event_type = 'error'"))
    return V.verify_per_time(
        *[f.select(F.window("ts", "1 day").end.alias("day_end"), "ts", "user_id", "event_type")
          for f in (correct, output)], "day_end")


def verify_windows(spark, d):
    """Both window techniques against each other, per window; 0 and 0 where they agree."""
    bids = S.event_bids(spark, d)
    panes = W.window_count(bids, "date_time", SLIDE, SLICES)
    rows = W.window_count_rows(bids, "date_time", SLIDE, SLICES)
    bad = V.verify_per_time(panes, rows, "window_end")
    return panes.select("window_end").join(bad, "window_end", "left").select(
        "window_end", F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"),
        F.coalesce("extra", F.lit(0).cast("bigint")).alias("extra"))


def concat_two(spark, d):
    b = S.bids(spark, d).select("auction", "price")
    return B.concat(b, S.event_bids(spark, d).select("auction", "price"))


def concatenate_many(spark, d):
    return B.concatenate([
        S.bids(spark, d).select(F.col("auction").alias("id")),
        S.auctions(spark, d).select("id"), S.persons(spark, d).select("id")])


def slide_end(spark, d):
    return _events(spark, d).select("event_id", X.slide_end(F.col("event_id") * 7, 60).alias("slide_end"))


def prime_filter(spark, d):
    return S.table(spark, d, "part").select("p_partkey").filter(X.is_prime(F.col("p_partkey")))


def state_machine_sum(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "ts", X.cents(F.col("value")).alias("price"))
    return A.state_machine_sum(e, "user_id", "price", ["ts", "event_id"]).drop("price")


def delay_rows(spark, d):
    later = F.col("ts") + F.expr("make_dt_interval(0, CAST(user_id - 75 AS INT))")
    return T.delay(_events(spark, d).select("event_id", "user_id", "ts"), "ts", later)


def delay_batch(spark, d):
    return T.delay_batch(_events(spark, d).select("event_id", "ts"), "ts", 3600)


def reclock(spark, d):
    e = _events(spark, d)
    rows = e.filter("event_type <> 'error'").select("event_id", "ts")
    return T.reclock(rows, e.filter("event_type = 'error'").select(F.col("ts").alias("tick")), "ts", "tick")


def reclock_per_key(spark, d):
    e = _events(spark, d)
    rows = e.filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    ticks = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("tick"))
    return T.reclock(rows, ticks, "ts", "tick", ["user_id"])


def late_rows(spark, d):
    """Line numbers as arrival epochs, ship dates as event times, five years of delay."""
    rows = S.table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_shipdate")
    return T.late_rows(rows, "l_linenumber", "l_shipdate", 5 * 365 * 86_400)


def extract_by_time(spark, d):
    day = X.start_of_day("ts")
    return capture.extract(_events(spark, d).select(day.alias("time"), F.col("user_id").alias("data")), "time", "data")


def latency_ccdf(spark, d):
    return R.latency_ccdf(_samples(spark, d), "latency_ns")


def latency_timeline(spark, d):
    return R.latency_timeline(_samples(spark, d), "ts", "latency_ns", step_ms=86_400_000)


def collatz_steps(spark, d):
    return I.collatz_steps(S.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("n")), "n")


def collatz_two_loops(spark, d):
    return I.collatz_two_loops(S.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("n")), "n")


def iterate_bounded(spark, d):
    return I.ping_pong(S.bids(spark, d).select("auction", "price"), "price", 8)


def bfs_levels(spark, d):
    return G.bfs(S.order_edges(spark, d), spark.range(1).select(F.col("id").alias("node")))


def connected_components(spark, d):
    return G.connected_components(S.owner_edges(spark, d))


def components_one_graph(spark, d):
    return G.connected_components(S.order_edges(spark, d))


def components_epochs(spark, d):
    """The components after three epochs of edges, and how many edges joined two components when they came."""
    edges = S.order_edges(spark, d)
    epoch = F.pmod(F.col("src") + F.col("dst"), F.lit(3))
    state, joining = G.start_components(edges.filter(epoch == 0))
    for i in (1, 2):
        state, more = G.add_edges(state, edges.filter(epoch == i))
        joining = joining.unionByName(more)
    return G.components(state).withColumn("joining", joining.agg(F.count("*")).scalar())


def spanning_forest(spark, d):
    return G.spanning_forest(S.owner_edges(spark, d))


def pagerank_rounds(spark, d):
    return G.pagerank(S.order_edges(spark, d), 5)


def pagerank_changed(spark, d):
    """Three rounds, then every order of status F is withdrawn, then three more."""
    edges = S.order_edges(spark, d)
    before = G.run_ranks(G.start_ranks(edges), 3)
    n = S.table(spark, d, "customer").agg(F.count("*")).scalar()
    gone = S.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst"), F.lit(-1).cast("bigint").alias("diff"))
    return G.change_ranks(before, gone, 3).nodes.select("node", "rank")


def udf_map_batches(spark, d):
    def convert(pdf):
        return pdf.assign(price=pdf["price"] * 89 // 100)
    return U.unary(S.bids(spark, d).select("auction", "price"), convert, "auction long, price long")


def cogroup_udf(spark, d):
    def keep_valid(bids, auctions):
        both = bids.merge(auctions, left_on="auction", right_on="auction")
        ok = (both.price >= both.reserve) & (both.bid_time >= both.opened) & (both.bid_time < both.expires)
        return both.loc[ok, ["auction", "bidder", "price"]]
    b = S.bids(spark, d).withColumnRenamed("date_time", "bid_time")
    a = S.auctions(spark, d).select(F.col("id").alias("auction"), "reserve", F.col("date_time").alias("opened"), "expires")
    return U.binary(b, a, "auction", keep_valid, "auction long, bidder long, price long", distributive=True)


def udaf_fold(spark, d):
    def partial(pdf):
        kept = pdf.assign(odd=pdf["price"] % 2)
        out = kept.groupby("auction", as_index=False).agg(total=("price", "sum"), odd=("odd", "sum"))
        return out[["auction", "total", "odd"]]
    return U.fold(S.event_bids(spark, d).select("auction", "price"), ["auction"], partial,
                  "auction long, total long, odd long", total=F.sum("total"), odd=F.sum("odd"))


def udtf_explode(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return docs.lateralJoin(U.SplitWords(F.col("text").outer())).select("doc_id", F.explode("words").alias("word"))


def kafka_sink_encode(spark, d):
    out = kafka.encode(S.event_bids(spark, d).select("auction", "price"), F.col("auction"))
    return out.select(F.col("key").cast("string"), F.col("value").cast("string"))


def kafka_source(spark, d):
    return kafka.decode(kafka.encode(S.bids(spark, d)), S.BID)


def kafka_round_trip(spark, d):
    events = S.table(spark, d, "events")
    return kafka.decode(kafka.encode(events), events.schema)


def custom_source(spark, d):
    """Every order number between the first and the last one of each block of 500."""
    def numbers(row):
        for lo in range(row["lo"], row["hi"] + 1, 10_000):
            n = np.arange(lo, min(lo + 10_000, row["hi"] + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array(n)], names=["block", "number"])

    plan = S.table(spark, d, "orders").groupBy(X.int_div(F.col("o_orderkey"), F.lit(500)).alias("block")).agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return from_function(plan, numbers, "block long, number long")


QUERIES = {
    "demux_bid": lambda s, d: B.demux(S.union_events(s, d), "bid"),
    "demux_auction": lambda s, d: B.demux(S.union_events(s, d), "auction"),
    "demux_person": lambda s, d: B.demux(S.union_events(s, d), "person"),
    "map_project": map_project, "flat_map_words": flat_map_words, "flat_map_range": flat_map_range,
    "filter_mod": filter_mod, "branch_true": branch_true, "branch_false": branch_false,
    "branch_when_after": branch_when_after, "partition_route": partition_route,
    "q0_passthrough": Q.q0, "q1_currency": Q.q1, "q2_selection": Q.q2, "q3_local_items": Q.q3,
    "closed_auctions": Q.closed, "q4_avg_price_final": Q.q4, "q4_avg_price_running": Q.q4_running,
    "q5_hot_items": Q.q5, "q6_last10_avg": Q.q6, "q7_highest_bid": Q.q7, "q8_new_users": Q.q8,
    "exchange_by_key": exchange_by_key, "exchange_by_id": exchange_by_id,
    "broadcast_join": broadcast_join, "hash_join": hash_join,
    "aggregate_sum": aggregate_sum, "aggregate_collect_len": aggregate_collect_len,
    "count_per_time": count_per_time, "accumulate_per_time": accumulate_per_time,
    "distinct_per_time": distinct_per_time, "wordcount_final": wordcount_final,
    "wordcount_running": wordcount_running, "wordcount_diffs": wordcount_diffs,
    "compact_diffs": compact_diffs,
    "assign_windows": _windowed(W.assign_windows), "window_collect": lambda s, d: W.assign_windows(
        S.event_bids(s, d), "date_time", SLIDE, SLICES),
    "window_count": _windowed(W.window_count_rows), "window_count_panes": _windowed(W.window_count),
    "window_count_leading": _windowed(W.window_count, leading=True),
    "window_count_custom_slice": _windowed(W.window_count, pane=3600),
    "window_count_filled": window_count_sparse,
    "window_rank": _windowed(W.window_rank_rows, "auction"),
    "window_rank_counts": _windowed(W.window_rank, "auction"),
    "window_rank_custom_slice": _windowed(W.window_rank_rows, "auction", pane=3600),
    "keyed_window_count": _windowed(W.keyed_window_count, "auction"),
    "keyed_window_rank": _windowed(W.keyed_window_rank, "auction"),
    "verify_equal": verify_equal, "verify_windows": verify_windows,
    "concat_two": concat_two, "concatenate_many": concatenate_many,
    "slide_end": slide_end, "prime_filter": prime_filter,
    "state_machine_sum": state_machine_sum, "delay_rows": delay_rows, "delay_batch": delay_batch,
    "reclock": reclock, "reclock_per_key": reclock_per_key, "late_rows": late_rows,
    "extract_by_time": extract_by_time, "latency_ccdf": latency_ccdf, "latency_timeline": latency_timeline,
    "collatz_steps": collatz_steps, "collatz_two_loops": collatz_two_loops, "iterate_bounded": iterate_bounded,
    "bfs_levels": bfs_levels, "connected_components": connected_components,
    "components_one_graph": components_one_graph, "components_epochs": components_epochs, "spanning_forest": spanning_forest,
    "pagerank_rounds": pagerank_rounds, "pagerank_changed": pagerank_changed,
    "udf_map_batches": udf_map_batches, "cogroup_udf": cogroup_udf, "udaf_fold": udaf_fold,
    "udtf_explode": udtf_explode, "kafka_sink_encode": kafka_sink_encode, "kafka_source": kafka_source,
    "custom_source": custom_source, "kafka_round_trip": kafka_round_trip,
}
