"""The same queries as plain SQL over the tables, for checking results with another engine."""

from __future__ import annotations

SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

VIEWS = {
    "bid": """SELECT l_orderkey AS auction, l_suppkey AS bidder,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS date_time FROM lineitem""",
    "auction": """SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS initial_bid,
        CAST(round(o_totalprice * 5) AS BIGINT) AS reserve, o_orderdate AS date_time,
        o_orderdate + INTERVAL '730' DAY AS expires, o_custkey AS seller,
        10 + o_orderkey % 5 AS category FROM orders""",
    "person": """SELECT c_custkey AS id, c_name AS name,
        CASE c_custkey % 3 WHEN 0 THEN 'phoenix' WHEN 1 THEN 'boise' ELSE 'seattle' END AS city,
        CASE c_nationkey % 6 WHEN 0 THEN 'AZ' WHEN 1 THEN 'CA' WHEN 2 THEN 'ID'
             WHEN 3 THEN 'OR' WHEN 4 THEN 'WA' ELSE 'WY' END AS state,
        CAST('1995-01-01' AS TIMESTAMP) + CAST((c_custkey * 37) % 2400 AS INT) * INTERVAL '1' DAY AS date_time
        FROM customer""",
    "ebid": """SELECT user_id AS auction, CAST(round(value * 100) AS BIGINT) AS price, ts AS date_time,
        epoch_us(ts) AS us FROM events""",
    "valid": """SELECT b.auction, b.bidder, b.price, b.date_time AS bid_time, a.seller, a.category, a.expires
        FROM bid b JOIN auction a ON b.auction = a.id
        WHERE b.price >= a.reserve AND b.date_time >= a.date_time AND b.date_time < a.expires""",
    "closed": """SELECT auction, seller, category, expires, price, bidder, bid_time FROM (
        SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, bid_time, bidder) AS rn
        FROM valid) WHERE rn = 1""",
    "word": rf"""SELECT time, word FROM (SELECT doc_id AS time,
        unnest(regexp_split_to_array(text, '{SPACE}')) AS word FROM documents) WHERE word <> ''""",
    "edge": """SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders""",
    "owner": """SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst FROM orders""",
}
NEEDS = {"valid": ["bid", "auction"], "closed": ["bid", "auction", "valid"]}


def _with(views: str, body: str) -> str:
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


def _windows(slide: int, slices: int, leading: bool = False) -> str:
    """CTE `w`: one row per record and window that holds it."""
    s, size = slide * 1_000_000, slide * slices * 1_000_000
    keep = "" if leading else f"WHERE e - {size} >= (SELECT min(us) // {s} * {s} FROM ebid)"
    return f"""w AS (SELECT make_timestamp(e - {size}) AS window_start, make_timestamp(e) AS window_end,
        auction, price, date_time FROM (SELECT ebid.*, (us // {s} + 1 + k) * {s} AS e
        FROM ebid, (SELECT unnest(range({slices})) AS k)) {keep})"""


SIX = _windows(21_600, 4)
COUNTED = f"WITH ebid AS ({VIEWS['ebid']}), {SIX}\n"
WINDOW_COUNT = COUNTED + "SELECT window_start, window_end, count(*) AS n FROM w GROUP BY ALL"
WINDOW_RANK = COUNTED + """SELECT window_start, window_end, auction,
    rank() OVER (PARTITION BY window_end ORDER BY auction) AS rank FROM w"""
COLLATZ = """, c(n, x, steps) AS (SELECT n, n, CAST(0 AS BIGINT) FROM s UNION ALL
    SELECT n, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, steps + 1 FROM c WHERE x <> 1)
    SELECT n, steps FROM c WHERE x = 1"""
DAILY = f"""WITH ebid AS ({VIEWS['ebid']}), daily AS (
    SELECT CAST(date_trunc('day', date_time) AS TIMESTAMP) AS time, auction, price FROM ebid)\n"""
LABELS = """, r(node, label) AS (SELECT node, node FROM nodes UNION
    SELECT both_ways.dst, r.label FROM r JOIN both_ways ON both_ways.src = r.node WHERE r.label < both_ways.dst)
    , comp AS (SELECT node, min(label) AS component FROM r GROUP BY node)"""


def _graph(view: str) -> str:
    return f"""WITH RECURSIVE e AS ({VIEWS[view]}),
    both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    nodes AS (SELECT DISTINCT src AS node FROM both_ways){LABELS}\n"""


def _percentiles() -> str:
    marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999, "max": 1.0}
    return ", ".join(
        f"min(CASE WHEN upto >= ceil(total * CAST({p} AS DOUBLE)) THEN latency END) AS \"{n}\""
        for n, p in marks.items())


def _pagerank_rounds(rounds: int, links: str, start: str, prefix: str) -> str:
    """CTEs `{prefix}0` to `{prefix}{rounds}`, each a (node, rank) table."""
    out = [f"{prefix}0 AS ({start})"]
    for i in range(1, rounds + 1):
        p = f"{prefix}{i - 1}"
        out.append(f"""{prefix}{i} AS (SELECT node, CASE WHEN abs(target - rank) >= 6 THEN target ELSE rank END AS rank
            FROM (SELECT p.node, p.rank, 1000 + coalesce(g.given, 0) AS target FROM {p} p LEFT JOIN (
                SELECT dst AS node, CAST(sum(mult * ((rank * 5 // 6) // degree
                    + CASE WHEN pos <= (rank * 5 // 6) % degree THEN 1 ELSE 0 END)) AS BIGINT) AS given
                FROM {links} l JOIN {p} q ON l.src = q.node GROUP BY dst) g ON p.node = g.node))""")
    return ",\n".join(out)


def _links(name: str, edges: str) -> str:
    return f"""{name} AS (SELECT src, dst, mult, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos,
        count(*) OVER (PARTITION BY src) AS degree FROM (
        SELECT src, dst, CAST(sum(diff) AS BIGINT) AS mult FROM {edges} GROUP BY src, dst HAVING sum(diff) <> 0))"""


_EDGES = f"edge AS ({VIEWS['edge']}), e1 AS (SELECT src, dst, 1 AS diff FROM edge)"
_NODES = "nodes AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge)"
_FRESH = "SELECT node, CAST(1000 AS BIGINT) AS rank FROM nodes"

ORACLE = {
    "demux_bid": _with("bid", "SELECT * FROM bid"),
    "demux_auction": _with("auction", "SELECT * FROM auction"),
    "demux_person": _with("person", "SELECT * FROM person"),
    "map_project": _with("bid", "SELECT auction, price + 1 AS price_plus_one FROM bid"),
    "flat_map_words": _with("word", "SELECT time AS doc_id, word FROM word"),
    "flat_map_range": "SELECT p_partkey, unnest(range(p_size)) AS i FROM part",
    "filter_mod": _with("bid", "SELECT * FROM bid WHERE price % 2 = 0"),
    "branch_true": _with("bid", "SELECT * FROM bid WHERE price % 2 = 0"),
    "branch_false": _with("bid", "SELECT * FROM bid WHERE (price % 2 = 0) IS NOT TRUE"),
    "branch_when_after": _with("ebid", """SELECT auction, price, date_time FROM ebid
        WHERE date_time >= TIMESTAMP '2024-01-15 00:00:00'"""),
    "partition_route": _with("bid", "SELECT auction, price, auction % 7 AS part FROM bid"),
    "q0_passthrough": _with("bid", "SELECT * FROM bid"),
    "q1_currency": _with("bid", "SELECT auction, bidder, price * 89 // 100 AS price, date_time FROM bid"),
    "q2_selection": _with("bid", "SELECT auction, price FROM bid WHERE auction % 123 = 0"),
    "q3_local_items": _with("auction person", """SELECT p.name, p.city, p.state, a.id AS auction
        FROM auction a JOIN person p ON a.seller = p.id
        WHERE a.category = 10 AND p.state IN ('OR', 'ID', 'CA')"""),
    "closed_auctions": _with("closed", "SELECT * FROM closed"),
    "q4_avg_price_final": _with("closed", """SELECT category,
        CAST(sum(price) // count(*) AS BIGINT) AS avg_price FROM closed GROUP BY category"""),
    "q4_avg_price_running": _with("closed", """SELECT category, expires, auction,
        CAST(sum(price) OVER o // count(*) OVER o AS BIGINT) AS avg_price FROM closed
        WINDOW o AS (PARTITION BY category ORDER BY expires, auction ROWS UNBOUNDED PRECEDING)"""),
    "q5_hot_items": COUNTED + """SELECT window_start, window_end, auction, n FROM (
        SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, auction DESC) AS rn FROM (
        SELECT window_start, window_end, auction, count(*) AS n FROM w GROUP BY ALL)) WHERE rn = 1""",
    "q6_last10_avg": _with("closed", """SELECT bidder, expires, auction,
        CAST(sum(price) OVER o // count(*) OVER o AS BIGINT) AS avg_price FROM closed
        WINDOW o AS (PARTITION BY bidder ORDER BY expires, auction ROWS 9 PRECEDING)"""),
    "q7_highest_bid": _with("ebid", """SELECT make_timestamp(us // 3600000000 * 3600000000) AS window_start,
        make_timestamp((us // 3600000000 + 1) * 3600000000) AS window_end, max(price) AS price FROM ebid GROUP BY 1, 2"""),
    "q8_new_users": _with("auction person", """SELECT p.id AS person FROM person p JOIN auction a ON p.id = a.seller
        WHERE a.date_time >= p.date_time AND a.date_time < p.date_time + INTERVAL '180' DAY"""),
    "exchange_by_key": _with("bid", "SELECT * FROM bid"),
    "exchange_by_id": _with("bid", "SELECT *, auction % 8 AS part FROM bid"),
    "broadcast_join": _with("auction person", "SELECT a.id, p.name FROM auction a JOIN person p ON a.seller = p.id"),
    "hash_join": _with("auction bid", "SELECT b.price AS val1, a.seller AS val2 FROM bid b JOIN auction a ON b.auction = a.id"),
    "aggregate_sum": DAILY + "SELECT time, auction, CAST(sum(price) AS BIGINT) AS total FROM daily GROUP BY time, auction",
    "aggregate_collect_len": DAILY + "SELECT time, auction, len(list(price)) AS n FROM daily GROUP BY time, auction",
    "count_per_time": DAILY + "SELECT time, count(*) AS n FROM daily GROUP BY time",
    "accumulate_per_time": DAILY + "SELECT time, CAST(sum(price) AS BIGINT) AS total, max(price) AS top FROM daily GROUP BY time",
    "distinct_per_time": DAILY + "SELECT DISTINCT time, auction FROM daily",
    "wordcount_final": _with("word", "SELECT word, count(*) AS n FROM word GROUP BY word"),
    "wordcount_running": _with("word", """SELECT time, word,
        row_number() OVER (PARTITION BY word ORDER BY time) AS n FROM word"""),
    "wordcount_diffs": _with("word", """SELECT time, word, CAST(sum(diff) OVER (PARTITION BY word ORDER BY time) AS BIGINT) AS n
        FROM (SELECT time, word, sum(diff) AS diff FROM (SELECT time, word, 1 AS diff FROM word
        UNION ALL SELECT time + 100, word, -1 FROM word) GROUP BY time, word HAVING sum(diff) <> 0)"""),
    "compact_diffs": """SELECT user_id, CAST(sum(diff) AS BIGINT) AS diff FROM (SELECT user_id,
        CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS diff FROM events)
        GROUP BY user_id HAVING sum(diff) <> 0""",
    "assign_windows": COUNTED + "SELECT window_start, window_end, auction, date_time FROM w",
    "window_collect": COUNTED + "SELECT window_start, window_end, auction, price, date_time FROM w",
    "window_count": WINDOW_COUNT,
    "window_count_panes": WINDOW_COUNT,
    "window_count_custom_slice": WINDOW_COUNT,
    "window_count_leading": f"WITH ebid AS ({VIEWS['ebid']}), {_windows(21_600, 4, True)} "
                            "SELECT window_start, window_end, count(*) AS n FROM w GROUP BY ALL",
    "window_count_filled": f"""WITH ebid AS ({VIEWS['ebid']}), {_windows(60, 5)},
        c AS (SELECT window_end, count(*) AS n FROM w GROUP BY window_end),
        spine AS (SELECT unnest(generate_series((SELECT min(window_end) FROM c), (SELECT max(window_end) FROM c),
            INTERVAL '60' SECOND)) AS window_end)
        SELECT s.window_end - INTERVAL '300' SECOND AS window_start, s.window_end, coalesce(c.n, 0) AS n
        FROM spine s LEFT JOIN c ON s.window_end = c.window_end""",
    "window_rank": WINDOW_RANK,
    "window_rank_custom_slice": WINDOW_RANK,
    "window_rank_counts": COUNTED + """SELECT window_start, window_end, auction, any_value(rank) AS rank, count(*) AS n FROM (
        SELECT *, rank() OVER (PARTITION BY window_end ORDER BY auction) AS rank FROM w)
        GROUP BY window_start, window_end, auction""",
    "keyed_window_count": COUNTED + "SELECT window_start, window_end, auction, count(*) AS n FROM w GROUP BY ALL",
    "keyed_window_rank": COUNTED + """SELECT window_start, window_end, auction,
        rank() OVER (PARTITION BY window_end, auction ORDER BY auction) AS rank FROM w""",
    "verify_equal": """WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '1' DAY AS day_end, * FROM events),
        c AS (SELECT day_end, ts, user_id, event_type FROM d),
        o AS (SELECT day_end, ts, user_id, event_type FROM d WHERE event_type <> 'view'
              UNION ALL SELECT day_end, ts, user_id, event_type FROM d WHERE event_type = 'error'),
        m AS (SELECT day_end, 1 AS missing, 0 AS extra FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM o)
              UNION ALL SELECT day_end, 0, 1 FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM c))
        SELECT day_end, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra FROM m GROUP BY day_end""",
    "verify_windows": COUNTED + """SELECT DISTINCT window_end, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM w""",
    "concat_two": _with("bid ebid", "SELECT auction, price FROM bid UNION ALL SELECT auction, price FROM ebid"),
    "concatenate_many": _with("bid auction person",
                              "SELECT auction AS id FROM bid UNION ALL SELECT id FROM auction UNION ALL SELECT id FROM person"),
    "slide_end": "SELECT event_id, (event_id * 7 // 60 + 1) * 60 AS slide_end FROM events",
    "prime_filter": """SELECT p_partkey FROM part WHERE p_partkey >= 2 AND NOT EXISTS (
        SELECT 1 FROM (SELECT unnest(range(2, 1 + (SELECT CAST(sqrt(max(p_partkey)) AS BIGINT) + 1 FROM part))) AS i)
        WHERE i * i <= p_partkey AND p_partkey % i = 0)""",
    "state_machine_sum": """SELECT user_id, event_id, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events""",
    "delay_rows": """SELECT event_id, user_id, greatest(ts, ts + CAST(user_id - 75 AS INT) * INTERVAL '1' HOUR) AS ts
        FROM events""",
    "delay_batch": "SELECT event_id, make_timestamp((epoch_us(ts) // 3600000000 + 1) * 3600000000) AS ts FROM events",
    "reclock": """SELECT e.event_id, e.ts, t.tick FROM (SELECT event_id, ts FROM events WHERE event_type <> 'error') e
        ASOF JOIN (SELECT DISTINCT ts AS tick FROM events WHERE event_type = 'error') t ON e.ts <= t.tick""",
    "reclock_per_key": """SELECT e.event_id, e.user_id, e.ts, t.tick
        FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error') e
        ASOF JOIN (SELECT DISTINCT user_id, ts AS tick FROM events WHERE event_type = 'error') t
        ON e.user_id = t.user_id AND e.ts <= t.tick""",
    "late_rows": """WITH tops AS (SELECT l_linenumber AS epoch, max(l_shipdate) AS top FROM lineitem GROUP BY 1)
        SELECT l_linenumber, l_orderkey, l_shipdate FROM lineitem l
        WHERE l_shipdate < (SELECT max(top) FROM tops WHERE epoch < l.l_linenumber) - INTERVAL '1825' DAY""",
    "extract_by_time": """SELECT time, row_number() OVER (PARTITION BY time ORDER BY data) AS position, data FROM (
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, user_id AS data FROM events)""",
    "latency_ccdf": """WITH c AS (SELECT CAST(round(value * 10000) AS BIGINT) // 65536 * 65536 AS latency, count(*) AS n
            FROM events GROUP BY 1)
        SELECT latency, CAST(sum(n) OVER (ORDER BY latency DESC) - n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share_above, n
        FROM c""",
    "latency_timeline": f"""WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '1' DAY AS step_end,
            CAST(round(value * 10000) AS BIGINT) // 65536 * 65536 AS latency, count(*) AS n FROM events GROUP BY 1, 2),
        u AS (SELECT *, sum(n) OVER (PARTITION BY step_end ORDER BY latency) AS upto,
            sum(n) OVER (PARTITION BY step_end) AS total FROM c)
        SELECT step_end, {_percentiles()} FROM u GROUP BY step_end""",
    "collatz_steps": "WITH RECURSIVE s AS (SELECT o_orderkey + 1 AS n FROM orders)" + COLLATZ,
    "collatz_two_loops": "WITH RECURSIVE s AS (SELECT p_partkey + 1 AS n FROM part)" + COLLATZ,
    "iterate_bounded": _with("bid", "SELECT auction, price + 8 AS price FROM bid"),
    "bfs_levels": f"""WITH RECURSIVE edge AS ({VIEWS['edge']}), u AS (SELECT DISTINCT src, dst FROM edge),
        r(node, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
            SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.node WHERE r.depth < 30),
        f AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
        SELECT f.node, f.depth, CASE WHEN f.depth = 0 THEN f.node ELSE
            min(CASE WHEN p.depth = f.depth - 1 THEN p.node END) END AS parent
        FROM f LEFT JOIN u ON u.dst = f.node LEFT JOIN f p ON p.node = u.src GROUP BY f.node, f.depth""",
    "connected_components": _graph("owner") + "SELECT node, component FROM comp",
    "components_epochs": _graph("edge") + """SELECT node, component, (SELECT count(*) - count(DISTINCT component) FROM comp) AS joining
        FROM comp""",
    "components_one_graph": _graph("edge") + "SELECT node, component FROM comp",
    "spanning_forest": """WITH e AS (SELECT o_custkey * 2 AS c, o_orderkey * 2 + 1 AS o FROM orders),
        root AS (SELECT c, least(c, min(o)) AS root FROM e GROUP BY c)
        SELECT o AS node, c AS parent FROM e JOIN root USING (c) WHERE o <> root
        UNION ALL SELECT c, root FROM root WHERE c <> root""",
    "pagerank_rounds": f"""WITH {_EDGES}, {_NODES}, {_links('l', 'e1')},
        {_pagerank_rounds(5, 'l', _FRESH, 'r')} SELECT node, rank FROM r5""",
    "pagerank_changed": f"""WITH {_EDGES}, {_NODES}, {_links('l', 'e1')},
        e2 AS (SELECT src, dst, diff FROM e1 UNION ALL
            SELECT o_custkey, o_orderkey % (SELECT count(*) FROM customer), -1 FROM orders WHERE o_orderstatus = 'F'),
        {_links('m', 'e2')}, {_pagerank_rounds(3, 'l', _FRESH, 'r')},
        {_pagerank_rounds(3, 'm', 'SELECT node, rank FROM r3', 's')} SELECT node, rank FROM s3""",
    "udf_map_batches": _with("bid", "SELECT auction, price * 89 // 100 AS price FROM bid"),
    "cogroup_udf": _with("valid", "SELECT auction, bidder, price FROM valid"),
    "udaf_fold": _with("ebid", """SELECT auction, CAST(sum(price) AS BIGINT) AS total,
        CAST(sum(price % 2) AS BIGINT) AS odd FROM ebid GROUP BY auction"""),
    "udtf_explode": _with("word", "SELECT time AS doc_id, word FROM word"),
    "kafka_sink_encode": _with("ebid", """SELECT CAST(auction AS VARCHAR) AS key,
        '{"auction":' || auction || ',"price":' || price || '}' AS value FROM ebid"""),
    "kafka_source": _with("bid", "SELECT * FROM bid"),
    "kafka_round_trip": "SELECT * FROM events",
    "custom_source": """SELECT block, unnest(range(lo, hi + 1)) AS number FROM (
        SELECT o_orderkey // 500 AS block, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)""",
}

# events with the number of errors of their user so far, an error itself included
_SINCE_ERROR = """parts AS (SELECT user_id, event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS price,
    count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events)"""
THIRD = "least(2, (day(date_time) - 1) // 10)"
SIX_HOURS = 21_600_000_000


def _stamp(time: str) -> str:
    return f"strftime(coalesce({time}, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S.%gZ')"


ORACLE |= {
    "stream_window_count": WINDOW_COUNT,
    "stream_out_of_order": WINDOW_COUNT,
    "stream_keyed_window_count": ORACLE["keyed_window_count"],
    "stream_window_rank": ORACLE["window_rank_counts"],
    "stream_hot_items": ORACLE["q5_hot_items"],
    "stream_highest_bid": ORACLE["q7_highest_bid"],
    "stream_new_users": ORACLE["q8_new_users"],
    "stream_local_items": ORACLE["q3_local_items"],
    "stream_hash_join": _with("auction bid", """SELECT b.price AS val1, a.seller AS val2 FROM bid b JOIN auction a
        ON b.auction = a.id"""),
    "stream_closed_auctions": ORACLE["closed_auctions"],
    "stream_closed_auctions_timers": ORACLE["closed_auctions"],
    "stream_state_machine": f"SELECT user_id, event_id, running FROM ({ORACLE['state_machine_sum']})",
    "stream_q4_avg_price_running": ORACLE["q4_avg_price_running"],
    "stream_q6_last10_avg": ORACLE["q6_last10_avg"],
    "stream_state_machine_values": f"SELECT user_id, event_id, running FROM ({ORACLE['state_machine_sum']})",
    "stream_delay_rows": f"SELECT event_id, ts FROM ({ORACLE['delay_rows']})",
    "stream_state_machine_fold": """WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS price,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, event_id, k, price AS running FROM o WHERE k = 1 UNION ALL
            SELECT o.user_id, o.event_id, o.k, CASE WHEN r.running > 100000 THEN 0 ELSE r.running END + o.price
            FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
        SELECT user_id, event_id, running FROM r""",
    "stream_ordered_steps": """SELECT user_id % 4 AS part, event_id, row_number() OVER w AS step,
        coalesce(lag(event_id) OVER w, -1) AS before FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY ts, event_id)""",
    "stream_unary_notify": """SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2""",
    "stream_binary_notify": _with("auction bid", """SELECT coalesce(a.id, b.auction) AS auction, coalesce(b.n, 0) AS bids,
        coalesce(a.n, 0) AS auctions FROM (SELECT id, count(*) AS n FROM auction GROUP BY id) a
        FULL JOIN (SELECT auction, count(*) AS n FROM bid GROUP BY auction) b ON a.id = b.auction"""),
    "stream_reclock": ORACLE["reclock"],
    "state_count": f"""WITH {_SINCE_ERROR} SELECT user_id, event_id, CAST(CASE WHEN part > 0 THEN 10 ELSE 0 END
        + sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, part
        ORDER BY ts, event_id) AS BIGINT) AS n FROM parts""",
    "state_value": f"""WITH {_SINCE_ERROR} SELECT e.user_id, e.event_id, coalesce(max(p.price), -1) AS top FROM parts e
        LEFT JOIN parts p ON p.user_id = e.user_id AND p.part = e.part - 1 AND p.event_type <> 'error'
        WHERE e.event_type = 'error' GROUP BY 1, 2""",
    "state_map": f"""WITH {_SINCE_ERROR}, n AS (SELECT user_id, part, isodow(ts) - 1 AS day, count(*) AS n FROM parts
        WHERE event_type = 'click' GROUP BY 1, 2, 3) SELECT e.user_id, e.event_id,
        coalesce(string_agg(day || '=' || n, ',' ORDER BY day), '') AS clicks FROM parts e
        LEFT JOIN n ON n.user_id = e.user_id AND n.part = e.part - 1 WHERE e.event_type = 'error' GROUP BY 1, 2""",
    "state_list": f"""WITH {_SINCE_ERROR} SELECT e.user_id, e.event_id, coalesce(string_agg(p.event_id, ',' ORDER BY p.ts, p.event_id), '') AS since
        FROM parts e LEFT JOIN parts p ON p.user_id = e.user_id AND p.part = e.part - 1 AND p.event_type <> 'error'
        WHERE e.event_type = 'error' GROUP BY 1, 2""",
    "stream_many_outputs": """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS n, event_type, lag(event_type) OVER w AS p FROM events
        WHERE event_type IN ('click', 'view', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, n, CASE WHEN p <> event_type THEN p || '>' || event_type END AS turn FROM s""",
    "state_counter": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "state_map_merge": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type",
    "stream_wordcount": ORACLE["wordcount_final"],
    "stream_distinct": ORACLE["distinct_per_time"],
    "stream_late_rows": ORACLE["late_rows"],
    "capture_replay": _with("ebid", """SELECT auction, price, date_time,
        CAST(date_trunc('day', date_time) AS TIMESTAMP) AS time FROM ebid"""),
    "foreach_batch_sink": _with("ebid", "SELECT auction, price, date_time FROM ebid"),
    "stream_epochs": _with("ebid", f"SELECT auction, price, date_time, {THIRD} AS epoch FROM ebid"),
    "stream_watermark": _with("ebid", f"""SELECT third AS batch, n AS input_rows, {_stamp("lag(top) OVER (ORDER BY third)")} AS watermark
        FROM (SELECT third, count(*) AS n, max(date_time) AS top FROM (SELECT {THIRD} AS third, date_time FROM ebid) GROUP BY third)
        UNION ALL SELECT 3, 1, {_stamp("max(date_time)")} FROM ebid
        UNION ALL SELECT 4, 0, {_stamp("max(date_time) + INTERVAL '90' DAY")} FROM ebid"""),
    # kept as state: panes that are still open, and windows of closed panes that are still open
    "progress_report": f"""WITH ebid AS ({VIEWS['ebid']}), rows AS (SELECT {THIRD} AS third, us, 1 AS n FROM ebid
            UNION ALL SELECT 3, max(us) + 90 * 86400000000, 1 FROM ebid),
        marks AS (SELECT third AS batch, n, coalesce(lag(top) OVER (ORDER BY third), 0) AS mark FROM (
                SELECT third, sum(n) AS n, max(us) // 1000 * 1000 AS top FROM rows GROUP BY third)
            UNION ALL SELECT 4, 0, max(us) // 1000 * 1000 FROM rows),
        panes AS (SELECT DISTINCT third, (us // {SIX_HOURS} + 1) * {SIX_HOURS} AS e FROM rows)
        SELECT batch, CAST(n AS BIGINT) AS input_rows, CAST(0 AS BIGINT) AS dropped_rows,
            (SELECT count(DISTINCT e) FROM panes WHERE third <= batch AND e > mark)
            + (SELECT count(DISTINCT e + k * {SIX_HOURS}) FROM panes, (SELECT unnest(range(4)) AS k)
               WHERE third <= batch AND e <= mark AND e + k * {SIX_HOURS} > mark) AS state_rows FROM marks""",
    "probe_answers": _with("ebid", f"""SELECT third AS epoch, day, top < start AS before, top <= start AS upto, false AS over FROM (
        SELECT {THIRD} AS third, date_trunc('milliseconds', max(date_time)) AS top FROM ebid GROUP BY 1),
        (SELECT d AS day, TIMESTAMP '2024-01-01' + CAST(d - 1 AS INT) * INTERVAL '1' DAY AS start FROM (SELECT unnest(range(1, 31)) AS d))
        UNION ALL SELECT 3, 31, false, false, true"""),
    "stream_observe_metrics": _with("ebid", f"""SELECT {THIRD} AS batch, count(*) AS n, min(price) AS lowest, max(price) AS highest
        FROM ebid GROUP BY 1"""),
    "capture_live": WINDOW_COUNT,
    "capture_progress": _with("ebid", """SELECT row_number() OVER (ORDER BY part) - 1 AS batch, n AS rows, CAST(0 AS BIGINT) AS late,
        max(top) OVER (ORDER BY part) - 345600000000 AS frontier FROM (SELECT (day(date_time) + auction % 3) // 8 AS part,
        count(*) AS n, max(us) AS top FROM ebid GROUP BY 1)
        UNION ALL SELECT count(DISTINCT (day(date_time) + auction % 3) // 8), 1, 0, max(us) + 90 * 86400000000 - 345600000000 FROM ebid"""),
    "stream_custom_source": "SELECT * FROM events",
    "custom_source_pushdown": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id < 40",
    "observe_metrics": _with("bid", "SELECT count(*) AS n, min(price) AS lowest, max(price) AS highest FROM bid"),
}
