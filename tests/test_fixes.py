"""Results that must not depend on sizes, zones, restarts or where a job runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from auctionflow.operators import basic as B
from auctionflow.operators import graph as G
from auctionflow.operators import iterate as I
from auctionflow.operators import running as R
from auctionflow.operators import skew
from auctionflow.operators import udf as U
from auctionflow.operators import windows as W
from auctionflow.plans.catalog import QUERIES
from auctionflow.plans.streams import STREAMS
from auctionflow.session import drop_stored, runs_in_one_process
from auctionflow.sources import kafka
from auctionflow.sources import tables as S
from auctionflow.streaming import late
from auctionflow.streaming.harness import Epochs, run, stream_session, zoned
from auctionflow.streaming.running import running_batches


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_user_logic_sees_whole_keys_at_any_group_size(spark):
    left = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "k long, w long")

    def best(a, b):
        return a.merge(b, on="k").groupby("k", as_index=False).agg(v=("v", "max"))[["k", "v"]]

    for size in (10, 100, 10_000):
        assert rows(U.binary(left, right, "k", best, "k long, v long", max_group=size)) == [(0, 498), (1, 499), (2, 497)]


def test_frames_longer_than_a_block(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), "id")
    got = rows(R.trailing(df, ["k"], ["id"], 20, {"s": F.sum("id")}, block=7))
    assert got == [(1, i, sum(range(max(0, i - 19), i + 1))) for i in range(50)]


def test_sparse_windows_over_decades(spark):
    first = datetime.datetime(1970, 1, 1)
    df = spark.createDataFrame([(first,), (first + datetime.timedelta(days=20_000),)], "t timestamp_ntz")
    got = W.window_count(df, "t", 600, 1, fill_gaps=True)
    assert got.count() == 20_000 * 144 + 1 and got.filter("n > 0").count() == 2


def test_long_ranges_are_unrolled_in_pieces(spark):
    got = B.flat_map_range(spark.createDataFrame([(0,), (1,), (200_000,)], "n long"), "n", ["n"])
    assert rows(got.groupBy("n").agg(F.count("*"), F.max("i"))) == [(1, 1, 0), (200_000, 200_000, 199_999)]


def test_hot_keys_with_a_wide_shuffle(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"))
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "100000")
    wide.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
    df = wide.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"))
    assert (7, 33_334) in {tuple(r) for r in skew.hot_keys(df, "k").collect()}


def test_minus_one_is_a_key_like_others(spark):
    df = spark.createDataFrame([(-1, 5, datetime.datetime(2024, 1, 1)), (2, 6, datetime.datetime(2024, 1, 2))],
                               "auction long, price long, date_time timestamp_ntz")
    from auctionflow.streaming.harness import plain, real
    e = Epochs(zoned(df, "date_time"), "date_time", closing=86_400)
    assert rows(plain(run(real(e.stream())))) == rows(df)


ZONED = ["stream_highest_bid", "stream_window_count", "stream_late_rows", "stream_hash_join", "foreach_batch_sink"]


@pytest.mark.parametrize("name", ZONED)
def test_streams_in_another_zone(spark, data, name):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    before = {k: other.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}
    assert rows(STREAMS[name](other, data)) == rows(STREAMS[name](spark, data))
    assert before == {k: other.conf.get(k) for k in before}


def test_times_do_not_depend_on_a_zone(spark):
    from auctionflow.streaming.harness import plain
    times = [datetime.datetime(2024, 3, 10, 2, 30, 0, 123456), datetime.datetime(1883, 11, 18, 12, 3, 58), datetime.datetime(2024, 11, 3, 1, 30)]
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = other.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert rows(plain(zoned(df, "t"))) == rows(df)
    micros = zoned(df, "t").select(F.unix_micros("t")).collect()
    want = [(t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) for t in times]
    assert [r[0] for r in micros] == want


def test_kafka_keeps_microseconds(spark, data):
    events = S.table(spark, data, "events")
    assert rows(kafka.decode(kafka.encode(events), events.schema)) == rows(events)


def test_rows_without_a_time_are_on_time(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else 100 * (1 - i // 6) + i, i // 6) for i in range(12)], "id long, s long, part long")
    e = Epochs(df.select("id", F.timestamp_seconds("s").alias("t"), "part"), "t", order="part")
    on_time, behind = late.split_late(e.source(), "t", 10)
    assert rows(on_time.select("id")) == [(i,) for i in range(12) if i < 6 or i % 3 == 0]
    assert rows(behind.select("id")) == [(i,) for i in range(6, 12) if i % 3]


def test_streams_run_again_after_their_tables_are_dropped(spark, data):
    first = rows(STREAMS["stream_highest_bid"](spark, data))
    drop_stored(spark)
    assert rows(STREAMS["stream_highest_bid"](spark, data)) == first


def test_a_cluster_needs_a_shared_folder():
    assert runs_in_one_process("local") and runs_in_one_process("local[8]")
    assert not any(runs_in_one_process(m) for m in ("local-cluster[2,1,1024]", "yarn", "k8s://x", "spark://h:7077"))


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    own = stream_session(spark)
    source, schema = str(tmp_path / "in"), "k long, v long, t timestamp"
    part = lambda a, b: spark.range(a, b).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.timestamp_seconds("id").alias("t"))
    stream = lambda: own.readStream.schema(schema).parquet(source)
    for a, b in ((0, 40), (40, 100)):
        part(a, b).coalesce(1).write.mode("append").parquet(source)
        plain = run(stream(), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "mark"))
        sums = running_batches(stream(), ["k"], ["v"], {"s": ("sum", "v")}, folder=str(tmp_path / "sums"))
        on_time, behind = late.split_late(stream(), "t", 5, folder=str(tmp_path / "late"))
        assert plain.count() == b
        assert rows(sums.select("v", "s")) == [(v, sum(range(v % 3, v + 1, 3))) for v in range(b)]
        assert on_time.count() == b and behind.count() == 0


def test_collatz_rejects_what_never_ends(spark):
    with pytest.raises(Exception, match="positive"):
        I.collatz_steps(spark.createDataFrame([(0,)], "n long"), "n").collect()


def test_components_of_a_long_path_and_deep_groups(spark):
    path = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tree = spark.range(1, 500).select((F.col("id") + 50_000).alias("src"), (F.floor(F.col("id") / 2) + 50_000).cast("long").alias("dst"))
    loops = spark.createDataFrame([(90_000, 90_000)], "src long, dst long")
    got = G.connected_components(path.unionByName(tree).unionByName(loops))
    assert rows(got.groupBy("component").count()) == [(0, 10_001), (50_000, 500), (90_000, 1)]


def test_custom_source_is_planned_without_reading(spark, data):
    assert QUERIES["custom_source"](spark, data).count() > 0


def test_groups_are_counted_from_both_sides(spark):
    left = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    right = spark.range(40_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("w"))
    sizes = U.binary(left, right, "k", lambda a, b: b.groupby(lambda _: 0).size().to_frame("n") if len(b) else b.assign(n=0)[["n"]], "n long", max_group=5000)
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 40_000 and max(got) < 40_000 and len(got) > 3


def test_wide_rows_are_not_broadcast(spark):
    from auctionflow.session import fits_broadcast
    narrow = spark.range(1000)
    wide = narrow.withColumn("s", F.repeat(F.lit("x"), 100_000))
    assert fits_broadcast(narrow) and fits_broadcast(narrow.withColumn("s", F.lit("x")))
    assert not fits_broadcast(wide) and not fits_broadcast(narrow, 999) and fits_broadcast(narrow.limit(0).withColumn("s", F.lit("x")))
    big = spark.range(3000).select((F.col("id") % 1000).alias("k"))
    joined = skew.skew_join(big, wide.withColumnRenamed("id", "j"), "k", "j")
    assert joined.count() == 3000


def test_a_text_comes_back_from_the_table_function_as_one_row(spark):
    df = spark.createDataFrame([(1, " a b\u2003a\n"), (2, ""), (3, None), (4, "x " * 20_000)], "id long, text string")
    got = df.lateralJoin(U.SplitWords(F.col("text").outer())).select("id", "words")
    assert rows(got.filter("id < 4")) == [(1, ["a", "b", "a"]), (2, []), (3, [])]
    assert rows(got.filter("id = 4").select(F.size("words"))) == [(20_000,)]


def test_stars_are_contracted_in_one_round_and_leave_the_loop(spark, monkeypatch):
    """Beside a path, which takes more rounds; every parent is a neighbour, and all ways lead to the smallest node."""
    made, trees = [], G._trees
    monkeypatch.setattr(G, "_trees", lambda links, number: made.append(trees(links, number)) or made[-1])
    stars = [(c, 1000 * c + i) for c in range(1, 60) for i in range(1, c + 1)] + [(100_000 * c + 1, 100_000 * c) for c in range(1, 30)]
    path = [(10**9 + i, 10**9 + i + 1) for i in range(40)] + [(10**9 + i, 10**9 + 100 + i) for i in range(0, 40, 3)]
    parents = dict(rows(G.spanning_forest(spark.createDataFrame(stars, "src long, dst long"))))
    assert len(made) == 1 and len(parents) == len(stars)
    parents = dict(rows(G.spanning_forest(spark.createDataFrame(stars + path, "src long, dst long"))))
    assert len(made) > 2 and all(made[2].select("node").toPandas()["node"] >= 10**9)  # the path is alone by then
    edges, root = {frozenset(e) for e in stars + path}, {}
    assert len(parents) == len(stars) + len(path) and all(frozenset(e) in edges for e in parents.items())
    for node in {n for e in edges for n in e}:
        at, steps = node, 0
        while at in parents and steps <= 200:
            at, steps = parents[at], steps + 1
        root.setdefault(at, set()).add(node)
    assert all(r == min(nodes) for r, nodes in root.items()) and len(root) == 59 + 29 + 1
