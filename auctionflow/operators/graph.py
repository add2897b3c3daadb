"""Iterative graph jobs on edge tables (src, dst)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionflow.operators.running import running
from auctionflow.session import cut, forget, store, store_bucketed


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, parent) of every node reachable from `roots` (node).

    The parent is the smallest one of the level before; a root is its own parent. Each level
    joins only the last frontier with the edges and keeps the nodes not seen before.
    """
    # laid out by their start once: a level shuffles its frontier, never the edges
    links = store_bucketed(edges.select("src", "dst").distinct(), ["src"], "edges")
    level = cut(roots.select(F.col("node"), F.lit(0).cast("bigint").alias("depth"),
                             F.col("node").alias("parent")).distinct())
    seen, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = (
            level.select(F.col("node").alias("src")).join(links, "src")
            .groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        )
        level = cut(
            reached.join(seen.select("node"), "node", "left_anti")
            .select("node", F.lit(depth).cast("bigint").alias("depth"), "parent"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of its component, edges taken as undirected.

    Every round each node points at the neighbour (or itself) that comes first in an order drawn
    anew for the round, pointers are followed twice, and the edges are contracted: inner ones and
    repeats go, so the graph shrinks by a constant factor a round, paths and stars alike. Rounds
    are written as tables: what a checkpoint keeps of each plan would add up over the rounds.
    """
    links = store(edges.select("src", "dst").filter("src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("h"), F.col(c).alias("to"))
        first = store(both.groupBy("src").agg(F.min(place("dst")).alias("near")).select(
            F.col("src").alias("node"), F.least(F.col("near"), place("src"))["to"].alias("to")), "pointers")
        onward = first.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = first.join(onward, "to").select("node", F.col("next").alias("to"))
        jumped = store(jumped.join(onward, "to").select("node", F.col("next").alias("to")), "pointers")
        for end in ("src", "dst"):
            links = links.join(jumped.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        links = store(links.filter("src <> dst").select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
        rounds.append(jumped)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = rounds.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = store(roots, "roots")
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return nodes.join(roots.join(least, "to").select("node", "component"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _trees(links: DataFrame, number: int) -> DataFrame:
    """One round's trees: node, to (its root), up (the nodes on the way to the root, which is last), trails of its own edge.

    Every node points at the neighbour (or itself) that comes first in an order drawn for the round, and one with
    a single neighbour at that one, which then is a root if it points back: so a star takes one round. A
    node whose root is up to three steps away belongs to it; one further away waits for another
    round, as do all that would come over it."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("theirs").alias("mine"), F.col("mine").alias("theirs")))
    place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("to"))
    near = both.groupBy("src").agg(F.min(F.struct(place("dst").alias("at"), "mine", "theirs")).alias("near"), (F.count("*") == 1).alias("leaf"))
    inner = F.col("leaf") | (F.col("near.at") < place("src"))
    drawn = store(near.select(
        F.col("src").alias("node"), F.when(inner, F.col("near.at.to")).otherwise(F.col("src")).alias("a"),
        F.when(inner, F.col("near.mine")).alias("mine"), F.when(inner, F.col("near.theirs")).alias("theirs"), "leaf"), "pointers")
    ahead = drawn.select(F.col("node").alias("a"), F.col("a").alias("back"), F.col("leaf").alias("to_leaf"))
    # two that point at each other: one is a leaf, and the other one, or the smaller leaf, becomes a root
    root = (F.col("a") != F.col("node")) & (F.col("back") == F.col("node")) & F.col("to_leaf") & (~F.col("leaf") | (F.col("node") < F.col("a")))
    first = store(drawn.join(ahead, "a").select(
        "node", F.when(root, F.col("node")).otherwise(F.col("a")).alias("a"),
        F.when(~root, F.col("mine")).alias("mine"), F.when(~root, F.col("theirs")).alias("theirs")), "pointers")
    forget(drawn)
    step = lambda a, b: first.select(F.col("node").alias(a), F.col("a").alias(b))
    ways = step("node", "a").join(step("a", "b"), "a").join(step("b", "c"), "b").join(step("c", "d"), "c")
    ways = ways.select("node", "a", "b", "c", (F.col("c") == F.col("d")).alias("near_enough"))
    kept = first.join(ways.drop("a"), "node").withColumn(
        "up", F.when(F.col("near_enough"), F.array_distinct(F.array("a", "b", "c")))).select(
        "node", F.when(F.col("near_enough"), F.col("c")).otherwise(F.col("node")).alias("to"),
        F.when(F.col("near_enough") & (F.col("a") != F.col("node")), F.col("up")).alias("up"),
        F.when(F.col("near_enough"), F.col("mine")).alias("mine"), F.when(F.col("near_enough"), F.col("theirs")).alias("theirs"))
    out = store(kept, "trees")
    forget(first)
    return out


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(node, parent) tree edges that join every component, rooted at its smallest node; each is one of the edges.

    As for the components, every round contracts trees of a few steps, so the rounds grow with the
    logarithm of the nodes, however deep the forest is. Links keep the edge they stem from, with
    the names its ends have had in every round (a trail). Then the rounds are gone through
    backwards: a contracted node that is to hang at one of its members is unfolded into its tree, which is turned
    to hang at the part that holds this member, and so every part knows the edge it hangs by.
    """
    ends = edges.select("src", "dst").filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = store(ends.select("src", "dst", F.array("src").alias("mine"), F.array("dst").alias("theirs")), "edges")
    # the smallest member of each contracted node, with its trail
    nodes = store(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.array("node").alias("least")), "nodes")
    rounds, over = [], []
    while not links.isEmpty():
        trees = _trees(links, len(rounds))
        rounds.append(trees)
        to = trees.select("node", "to")
        # a component that is complete has no links any more and takes no part in later rounds
        over.append(store(nodes.join(to, "node", "left_anti"), "over"))
        moved = nodes.join(to, "node").groupBy(F.col("to").alias("node")).agg(F.min("least").alias("least"))
        moved = store(moved.select("node", F.concat("least", F.array("node")).alias("least")), "nodes")
        forget(nodes)
        nodes = moved
        relabelled = links
        for end, trail in (("src", "mine"), ("dst", "theirs")):
            relabelled = relabelled.join(to.select(F.col("node").alias(end), "to"), end).drop(end).withColumn(
                trail, F.concat(trail, F.array("to"))).withColumnRenamed("to", end)
        turned = F.col("src") > F.col("dst")
        swap = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
        fewer = store(relabelled.filter("src <> dst").select(swap("src", "dst"), swap("dst", "src"), swap("mine", "theirs"), swap("theirs", "mine"))
                      .groupBy("src", "dst").agg(F.min(F.struct("mine", "theirs")).alias("e")).select("src", "dst", "e.mine", "e.theirs"), "edges")
        forget(links)
        links = fewer
    kind = edges.schema["src"].dataType
    over.append(nodes)
    hung = None  # contracted nodes and the member they are to hang at, as a trail
    out = None
    for number in range(len(rounds) - 1, -1, -1):
        trees, whole = rounds[number], over[number + 1].select("node", F.col("least").alias("at"))
        hung = whole if hung is None else hung.unionByName(whole)
        inside = hung.select(F.col("node").alias("whole"), F.element_at("at", number + 1).alias("part"), "at")
        # from the part that holds the member up to the old root, the pointers are turned round
        ways = inside.join(trees.select(F.col("node").alias("part"), "up"), "part", "left")
        steps = ways.filter("up IS NOT NULL").select(F.posexplode("up").alias("i", "to"), F.concat(F.array("part"), "up").alias("way")).select(
            F.col("to").alias("node"), F.element_at("way", F.col("i") + 1).alias("by"))
        turned = steps.join(trees.select(F.col("node").alias("by"), "mine", "theirs"), "by").select(
            "node", F.col("theirs").alias("at"), F.col("mine").alias("parent"))
        fixed = turned.select("node").unionByName(inside.select(F.col("part").alias("node")))
        others = trees.filter("mine IS NOT NULL").join(fixed, "node", "left_anti").select(
            "node", F.col("mine").alias("at"), F.col("theirs").alias("parent"))
        made = store(turned.unionByName(others), "forest")
        out = made if out is None else out.unionByName(made)
        hung = store(made.select("node", "at").unionByName(inside.select(F.col("part").alias("node"), "at")), "hung")
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")).limit(0)
    return out.select(F.col("at")[0].cast(kind).alias("node"), F.col("parent")[0].cast(kind).alias("parent"))


class Components(NamedTuple):
    """Components under way: `nodes` (node, first: the component it came into) and `merged` (first, component: what
    has become of it since; components that are as they were aren't there)."""

    nodes: DataFrame
    merged: DataFrame


def _named(state: Components) -> DataFrame:
    return state.nodes.join(state.merged, "first", "left").select("node", F.coalesce("component", "first").alias("component"))


def start_components(edges: DataFrame) -> tuple[Components, DataFrame]:
    """Components of a first table of edges, and (src, dst) of the edges that join them as a forest."""
    nodes = connected_components(edges).select("node", F.col("component").alias("first"))
    none = edges.sparkSession.createDataFrame([], "first long, component long")
    forest = spanning_forest(edges).select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    return Components(store_bucketed(nodes, ["node"], "components"), none), forest


def add_edges(state: Components, edges: DataFrame) -> tuple[Components, DataFrame]:
    """The components after more edges have come, and (src, dst) of those that joined two of them, as a forest.

    Only the ends of the new edges are looked up; what is joined are components, by as many links as
    there are new edges at most. Nodes stay where they are stored, new ones are added."""
    ends = _ends(edges)
    known = ends.join(state.nodes, "node", "left").join(state.merged, "first", "left").select(
        "node", F.coalesce("component", "first", "node").alias("now"), F.col("first").isNull().alias("is_new"))
    known = store(known, "ends")
    links = edges.select("src", "dst")
    for end, now in (("src", "a"), ("dst", "b")):
        links = links.join(known.select(F.col("node").alias(end), F.col("now").alias(now)), end)
    pair = lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    links = store(links.filter("a <> b").groupBy(pair("a", "b").alias("pair")).agg(F.min(F.struct("src", "dst")).alias("edge"))
                  .select("pair", "edge.src", "edge.dst"), "links")
    between = links.select(F.col("pair.x").alias("src"), F.col("pair.y").alias("dst"))
    joined = store(connected_components(between), "joined")
    tree = spanning_forest(between).select(pair("node", "parent").alias("pair"))
    forest = store(links.join(tree, "pair").select("src", "dst"), "forest")
    # components that were merged before follow the one they went into
    later = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    before = state.merged.join(later, "component", "left").select("first", F.coalesce("into", "component").alias("component"))
    first = joined.filter("node <> component").select(F.col("node").alias("first"), "component")
    merged = store(before.unionByName(first.join(before, "first", "left_anti")), "merged")
    fresh = known.filter("is_new").select("node", F.col("node").alias("first"))
    nodes = store_bucketed(state.nodes.unionByName(fresh), ["node"], "components")
    forget(state.nodes, state.merged, known, links, joined)
    return Components(nodes, merged), forest


def components(state: Components) -> DataFrame:
    """(node, component) of what has come so far, each component by its smallest node."""
    return _named(state)


class Ranks(NamedTuple):
    """Ranks under way. `links` have src, dst, mult, pos and the number of links of src; `nodes` their rank, what their
    links give them now (`given`), and what they last gave (`share` to each link, one more to the first `extra`)."""

    links: DataFrame
    nodes: DataFrame


def rank_links(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, diff) as distinct links with multiplicity, position among those of src, and their number."""
    links = edges.groupBy("src", "dst").agg(F.sum("diff").alias("mult")).filter("mult <> 0")
    placed = running(links, ["src"], ["dst"], {"pos": ("count", "*")})
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    return store_bucketed(placed.join(degree, "src"), ["src"], "links")


def _signed(edges: DataFrame) -> DataFrame:
    return edges if "diff" in edges.columns else edges.withColumn("diff", F.lit(1).cast("bigint"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def start_ranks(edges: DataFrame, start: DataFrame | None = None) -> Ranks:
    """Ranks of 1000, or those of `start` (node, rank), before the first round; nodes of `start` stay even without edges."""
    edges = _signed(edges)
    nodes = _ends(edges).withColumn("rank", F.lit(1000).cast("bigint"))
    if start is not None:
        known = start.select("node", F.col("rank").alias("was"))
        nodes = nodes.join(known, "node", "full").select("node", F.coalesce("was", "rank").alias("rank"))
    links = rank_links(edges)
    degree = links.filter("pos = 1").select(F.col("src").alias("node"), "degree")
    state = nodes.join(degree, "node", "left").selectExpr(
        "node", "rank", "0L AS given", "coalesce(degree, 0L) AS degree", "0L AS share", "0L AS extra")
    return Ranks(links, store_bucketed(state, ["node"], "ranks"))


SHARE, EXTRA = "IF(degree > 0, ((rank * 5) div 6) div degree, 0L)", "IF(degree > 0, ((rank * 5) div 6) % degree, 0L)"


def _settle(state: Ranks, more: DataFrame | None = None) -> Ranks:
    """One round. Only nodes whose share is another than the one they last gave send anything, and only the
    difference; `more` (node, given) are other differences. Links and ranks stay where they are."""
    now = state.nodes.selectExpr("node", "rank", "given", "degree", "share", "extra", f"{SHARE} AS new_share", f"{EXTRA} AS new_extra")
    sending = now.filter("share <> new_share OR extra <> new_extra").selectExpr("node AS src", "share", "extra", "new_share", "new_extra")
    sent = state.links.join(sending, "src").selectExpr(
        "dst AS node", "mult * (new_share - share + IF(pos <= new_extra, 1, 0) - IF(pos <= extra, 1, 0)) AS given")
    changes = (sent if more is None else sent.unionByName(more)).groupBy("node").agg(F.sum("given").alias("change"))
    told = now.join(changes, "node", "left").selectExpr(
        "node", "rank", "given + coalesce(change, 0L) AS given", "degree", "new_share AS share", "new_extra AS extra")
    after = told.selectExpr("node", "IF(abs(1000 + given - rank) >= 6, 1000 + given, rank) AS rank", "given", "degree", "share", "extra")
    nodes = store_bucketed(after, ["node"], "ranks")
    forget(state.nodes)
    return Ranks(state.links, nodes)


def run_ranks(state: Ranks, rounds: int) -> Ranks:
    """`rounds` more synchronous rounds."""
    for _ in range(rounds):
        state = _settle(state)
    return state


def change_ranks(state: Ranks, edges: DataFrame, rounds: int) -> Ranks:
    """Edge changes (src, dst, diff) and then `rounds` rounds, the first of which takes them into account.

    Only the links of nodes whose own edges changed are made anew, and only what these give is taken back."""
    if rounds < 1:
        raise ValueError("changes take effect in a round")
    edges = _signed(edges)
    touched = store(edges.select("src").distinct(), "touched")
    old = state.links.join(touched, "src", "left_semi")
    kept = state.links.join(touched, "src", "left_anti")
    anew = rank_links(old.select("src", "dst", F.col("mult").alias("diff")).unionByName(edges.select("src", "dst", "diff")))
    before = state.nodes.select(F.col("node").alias("src"), "share", "extra")
    back = old.join(before, "src").selectExpr("dst AS node", "-mult * (share + IF(pos <= extra, 1, 0)) AS given")
    # nodes that are new, and those with another number of links; what they last gave is taken back
    fresh = _ends(edges).join(state.nodes, "node", "left_anti").selectExpr("node", "1000L AS rank", "0L AS given", "0L AS degree", "0L AS share", "0L AS extra")
    degree = anew.filter("pos = 1").select(F.col("src").alias("node"), F.col("degree").alias("now"))
    gone = touched.select(F.col("src").alias("node"), F.lit(True).alias("touched"))
    nodes = state.nodes.unionByName(fresh).join(gone, "node", "left").join(degree, "node", "left").selectExpr(
        "node", "rank", "given", "IF(touched, coalesce(now, 0L), degree) AS degree", "IF(touched, 0L, share) AS share", "IF(touched, 0L, extra) AS extra")
    taken_back = store(back, "back")
    links = store_bucketed(kept.unionByName(anew), ["src"], "links")
    grown = store_bucketed(nodes, ["node"], "ranks")
    forget(state.links, state.nodes, anew, touched)
    return run_ranks(_settle(Ranks(links, grown), taken_back), rounds - 1)


def pagerank(edges: DataFrame, rounds: int, start: DataFrame | None = None) -> DataFrame:
    """(node, rank) after `rounds` synchronous rounds of integer PageRank.

    Every node has 1000 of its own and passes 5/6 of its rank on: the truncated share goes to
    each link, and the remainder one by one to the first links by target. A node takes up its
    new rank only if it differs by 6 or more, so fewer and fewer nodes send anything. `edges` may carry signed
    multiplicities in `diff`; `start` (node, rank) continues from earlier ranks after the edges
    changed. For changes epoch by epoch, see `start_ranks` and `change_ranks`.
    """
    return run_ranks(start_ranks(edges, start), rounds).nodes.select("node", "rank")
