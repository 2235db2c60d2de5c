"""Full hierarchies from parent-child links of unknown depth.

Links are split into connected groups. A group of up to GROUP_MOST links is
peeled as a whole in one pass over sorted rows: leaves first, each sending the
list of what is below it (a bit set, whose bits are the subtree's size) to its
parents; what cannot be peeled holds the loops, whose strongly connected parts
are peeled in turn as nodes of their own; paths and depths are assigned in
reverse order of peeling. Larger groups are peeled round by round as tables:
each round writes its result to the shared folder, nothing is gathered on the
driver but row counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, rounds, saved, ship, together
from ..sources.tables import current, member_kind, table
from .graph import components

#: Links a connected group may have to be peeled by one task; its lists then take 2 MB at most. Larger ones are peeled as tables.
GROUP_MOST = 4096


def relation_links(spark, root: str) -> DataFrame:
    """Distinct parent, child of current members of type relation whose ends both have a current, visible row."""
    m = table(spark, root, "members").withColumn("kind", member_kind(F.col("mtype")))
    m = current(m, ["rel_id", "pos"], ["kind", "ref_id"]).where("kind = 2 and ref_id is not null")
    live = current(table(spark, root, "relations"), ["id"], ["visible"]).where("visible").select("id")
    links = m.select(F.col("rel_id").alias("parent"), F.col("ref_id").alias("child")).distinct()
    links = links.join(live.select(F.col("id").alias("parent")), "parent", "left_semi")
    return links.join(live.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")


@dataclass
class Peeled:
    """rounds: links by the round in which they were peeled; rest: links that were not; below: descendant pairs."""

    rounds: list[DataFrame]
    rest: DataFrame
    n_rest: int
    below: DataFrame | None = None


def peel(links: DataFrame, lists: bool = False) -> Peeled:
    """Peel links from the bottom, round by round.

    With lists=True each peeled node sends the distinct nodes below it to its
    parents; below then holds (node, below) of all nodes without a loop under them.
    """
    rounds, lists_sent = [], []
    rest, n = saved(links, "links")
    left = n["n"]
    while left:
        inner = rest.select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
        marked = rest.join(inner, "child", "left").select("parent", "child", F.col("inner").isNull().alias("ends"))
        marked, n = saved(marked, "peel", ends=F.count_if("ends"), left=F.count_if(~F.col("ends")))
        if not n["ends"]:
            break
        got = marked.where("ends").select("parent", "child")
        rounds.append(got)
        if lists:
            sent = got.select(F.col("parent").alias("node"), F.col("child").alias("below"))
            if lists_sent:
                # the list of a node is whole once it is peeled itself
                known = together(lists_sent).select(F.col("node").alias("child"), "below")
                sent = sent.unionByName(known.join(got, "child").select(F.col("parent").alias("node"), "below"))
            lists_sent.append(materialize(sent.distinct(), "below"))
        rest, left = marked.where("not ends").select("parent", "child"), n["left"]
    # a node reached in several ways is in lists of several rounds
    below = together(lists_sent).distinct() if lists_sent else None
    if below is not None and left:
        # lists of nodes that were not peeled lack what is behind the loop
        below = below.join(rest.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return Peeled(rounds, rest, left, below)


def _spread_max(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, color: the greatest node that reaches it within links, itself included."""
    color = nodes.select("node", F.col("node").alias("color"))
    while True:
        sent = links.join(color.select(F.col("node").alias("parent"), "color"), "parent").select(F.col("child").alias("node"), "color")
        best = sent.groupBy("node").agg(F.max("color").alias("got"))
        nxt = color.join(best, "node", "left").select("node", F.greatest("color", "got").alias("color"), (F.col("got") > F.col("color")).alias("moved"))
        color, n = saved(nxt, "color", moved=F.count_if("moved"))
        color = color.select("node", "color")
        if not n["moved"]:
            return color


def contract(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """links without most nodes that have one parent and one child, and those nodes with both (node, before, after), by rounds.

    In each round about a quarter of such nodes, no two of them in a row, gives
    way to a link from parent to child: chains and loops of any length shrink in
    a logarithmic number of rounds.
    """
    taken: list[DataFrame] = []
    rest, n = saved(links.select("parent", "child"), "links")
    left = n["n"]
    while left:
        before = rest.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("before")).where("n = 1 and before <> node")
        after = rest.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("child").alias("after")).where("n = 1 and after <> node")
        coin = (F.pmod(F.xxhash64("node", F.lit(len(taken))), F.lit(2)) == 0).alias("coin")
        single, _ = saved(before.select("node", "before").join(after.select("node", "after"), "node").select("node", "before", "after", coin), "single")
        held = single.where("coin").select(F.col("node").alias("before"), F.lit(True).alias("held"))
        out, n = saved(single.where("coin").join(held, "before", "left").where("held is null").select("node", "before", "after"), "taken")
        if n["n"] * 20 < left:
            break
        taken.append(out)
        kept = rest.join(out.select(F.col("node").alias("parent")), "parent", "left_anti").join(out.select(F.col("node").alias("child")), "child", "left_anti")
        rest, n = saved(kept.select("parent", "child").unionByName(out.select(F.col("before").alias("parent"), F.col("after").alias("child"))).distinct(), "links")
        left = n["n"]
    return rest, taken


def _reach(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """node of everything that seeds (node) reach by links (parent to child), with the seeds.

    A node that was taken out of the links is reached if its parent is.
    """
    links, taken = contract(links)
    found = _reach_step_by_step(seeds, links)
    for out in reversed(taken):
        found = materialize(found.unionByName(out.join(found.select(F.col("node").alias("before")), "before", "left_semi").select("node")).distinct(), "reach")
    return found


def _reach_step_by_step(seeds: DataFrame, links: DataFrame) -> DataFrame:
    front, n = saved(seeds.select("node").distinct(), "front")
    fronts = [front]
    while n["n"]:
        nxt = links.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front, n = saved(nxt.join(together(fronts), "node", "left_anti"), "front")
        if n["n"]:
            fronts.append(front)
    return together(fronts)


def trim(links: DataFrame) -> tuple[DataFrame, int]:
    """What is left of links when those are peeled, from both ends at once, that begin at a top or end at a leaf; and its number."""
    rest, n = saved(links, "links")
    left = n["n"]
    while left:
        kept = rest.join(rest.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        kept = kept.join(rest.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        rest, n = saved(kept.select("parent", "child"), "trim")
        if n["n"] == left:
            break
        left = n["n"]
    return rest, left


def loops(links: DataFrame) -> DataFrame:
    """node, part: the strongly connected part of each node that reaches itself, named by one of its nodes.

    A node that was taken out of the links belongs to a part if its parent and its child both do.
    """
    rest, taken = contract(links)
    parts = _loops_of(rest)
    for out in reversed(taken):
        ends = out.join(parts.select(F.col("node").alias("before"), "part"), "before").join(parts.select(F.col("node").alias("after"), F.col("part").alias("other")), "after")
        parts = materialize(parts.unionByName(ends.where("part = other").select("node", "part")), "loops")
    return parts


def _loops_of(links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    found = []
    rest = links
    while True:
        rest, left = trim(rest)
        if not left:
            break
        nodes = rest.select(F.col("parent").alias("node")).unionByName(rest.select(F.col("child").alias("node"))).distinct()
        color = _spread_max(nodes, rest)
        # back from each color's own node, within its color
        a, b = color.select(F.col("node").alias("parent"), F.col("color").alias("cp")), color.select(F.col("node").alias("child"), F.col("color").alias("cc"))
        within = materialize(rest.join(a, "parent").join(b, "child").where("cp = cc").select("parent", "child"), "within")
        back = within.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
        own = _reach_step_by_step(color.where("node = color"), back)
        part = materialize(color.join(own, "node", "left_semi").select("node", F.col("color").alias("part")), "part")
        # a part of one node is a loop only if it is linked to itself
        size = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        selfs = rest.where("parent = child").select(F.col("parent").alias("part")).distinct().withColumn("self", F.lit(True))
        real = size.join(selfs, "part", "left").where("n > 1 or self").select("part")
        found.append(materialize(part.join(real, "part", "left_semi").select("node", "part"), "loops"))
        gone = part.select("node")
        rest = rest.join(gone.select(F.col("node").alias("parent")), "parent", "left_anti")
        rest = rest.join(gone.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child")
    out = spark.createDataFrame([], "node bigint, part bigint")
    for f in found:
        out = out.unionByName(f)
    return out


def chains(links: DataFrame) -> DataFrame:
    """node, path (array from the top to the node) of each distinct chain; links must be without loops."""
    children = links.select(F.col("child").alias("node")).distinct()
    top = links.select(F.col("parent").alias("node")).distinct().join(children, "node", "left_anti")
    front, n = saved(top.select("node", F.array("node").alias("path")), "chain")
    out = [front]
    while n["n"]:
        nxt = front.select(F.col("node").alias("parent"), "path").join(links, "parent")
        front, n = saved(nxt.select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")), "chain")
        if n["n"]:
            out.append(front)
    return together(out)


@dataclass
class Group:
    """A connected group of links, peeled: nodes ascending, and by their numbers the order of peeling, lists below, and parts of loops."""

    nodes: list[int]
    parents: list[list[int]]
    order: list[int]
    below: list[int]
    loop: dict[int, list[int]]

    @classmethod
    def of(cls, links: list[tuple[int, int]]) -> Group:
        nodes = sorted({x for link in links for x in link})
        number = {x: k for k, x in enumerate(nodes)}
        parents, children = [[] for _ in nodes], [[] for _ in nodes]
        for a, b in links:
            parents[number[b]].append(number[a])
            children[number[a]].append(number[b])
        below, left = [0] * len(nodes), [len(c) for c in children]
        order = [k for k, n in enumerate(left) if not n]
        for k in order:  # grows as leaves arise
            for up in parents[k]:
                below[up] |= below[k] | 1 << k
                left[up] -= 1
                if not left[up]:
                    order.append(up)
        loop: dict[int, list[int]] = {}
        for part in strong_parts([k for k, n in enumerate(left) if n], children, left):
            got = 0
            for k in part:
                for c in children[k]:
                    got |= below[c] | 1 << c
            for k in part:
                below[k] = got
            if got >> part[0] & 1:
                loop |= dict.fromkeys(part, sorted(part))
            order.extend(part)
        return cls(nodes, parents, order, below, loop)

    def rows(self) -> Iterator[tuple[int, str, list[int], int]]:
        """rel_id, state, path and number of distinct nodes below, in reverse order of peeling."""
        under = 0
        for k in self.loop:
            under |= self.below[k]
        for k in reversed(self.order):
            node, n = self.nodes[k], self.below[k].bit_count()
            if k in self.loop:
                yield node, "cycle", [self.nodes[j] for j in self.loop[k]], n
            elif under >> k & 1:
                yield node, "below", [], n
            else:
                for chain in self.chains(k):
                    yield node, "tree", chain, n

    def chains(self, k: int) -> Iterator[list[int]]:
        """Each chain from a node without parent down to k, one at a time."""
        path, todo = [k], [iter(self.parents[k])]
        while path:
            if not self.parents[path[-1]]:
                yield [self.nodes[j] for j in reversed(path)]
            up = next(todo[-1], None)
            if up is None:
                path.pop()
                todo.pop()
            else:
                path.append(up)
                todo.append(iter(self.parents[up]))

    def lists(self) -> Iterator[tuple[int, list[int]]]:
        """Each node with the nodes below it."""
        for k in self.order:
            bits = np.unpackbits(np.frombuffer(self.below[k].to_bytes(len(self.nodes) // 8 + 1, "little"), np.uint8), bitorder="little")
            yield self.nodes[k], [self.nodes[j] for j in np.flatnonzero(bits)]


def strong_parts(nodes: list[int], children: list[list[int]], left: list[int]) -> list[list[int]]:
    """Strongly connected parts of nodes, each after all parts below it; nodes whose left is 0 do not count.

    Parts are the groups of one low point in a walk that numbers nodes as it meets them.
    """
    seen, low, held, out = {}, {}, [], []
    for start in nodes:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        held.append(start)
        walk = [(start, iter(children[start]))]
        while walk:
            at, kids = walk[-1]
            for c in kids:
                if not left[c]:
                    continue
                if c not in seen:
                    seen[c] = low[c] = len(seen)
                    held.append(c)
                    walk.append((c, iter(children[c])))
                    break
                if low[c] >= 0:  # still held
                    low[at] = min(low[at], seen[c])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == seen[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(held.pop())
                        low[part[-1]] = -1
                    out.append(part)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
    """Links of one part after the other, from rows sorted by part."""
    flat = ((p, (a, b)) for batch in batches for p, a, b in zip(*(batch.column(k).to_pylist() for k in ("part", "parent", "child"))))
    for _, rows in groupby(flat, key=lambda x: x[0]):
        yield [link for _, link in rows]


def _peel_groups(each: Callable[[Group], Iterator[tuple]], schema: pa.Schema, weight: Callable[[tuple], int]) -> Callable:
    """For mapInArrow: rows of each group, in batches of bounded weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, heavy = [], 0
        for links in _grouped(batches):
            for row in each(Group.of(links)):
                rows.append(row)
                heavy += weight(row)
                if heavy > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, heavy = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _split(links: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Links of small groups with their part, sorted for _peel_groups; links of large ones, or None; and the number of all links."""
    links, seen = saved(links.select("parent", "child").dropna().distinct(), "links")
    n = seen["n"]
    if not n:
        return links.withColumn("part", F.lit(0).cast("bigint")), None, 0
    ship(links.sparkSession)
    part = components(links.select(F.col("parent").alias("u"), F.col("child").alias("v")), n)
    with rounds(links.sparkSession, n):
        marked, seen = saved(links.join(part.withColumnRenamed("node", "parent"), "parent").select("part", "parent", "child"), "parts")
        sizes, big = saved(marked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_MOST).select("part"), "large")
    if not big["n"]:
        return marked, None, n
    return marked.join(sizes, "part", "left_anti"), materialize(marked.join(sizes, "part", "left_semi").select("parent", "child"), "large-links"), n


def _in_groups(small: DataFrame, run: Callable, schema: str) -> DataFrame:
    return small.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def hierarchy(links: DataFrame) -> DataFrame:
    """rel_id, state ('tree', 'cycle', 'below'), path (array), top, depth, n_below, of every node with a link.

    A node that reaches itself is in a cycle: path lists the nodes of its
    strongly connected part, ascending. One that a cycle reaches is below it and
    has an empty path. Any other has one row for each chain from a node without
    parent. top and depth (0 at the top) are null but for trees. n_below is the
    number of distinct nodes below. Repeated links count once, a link with a null
    end is ignored; no links give no rows.
    """
    small, large, n = _split(links)
    schema = pa.schema([("rel_id", pa.int64()), ("state", pa.string()), ("path", pa.list_(pa.int64())), ("n_below", pa.int64())])
    run = _peel_groups(Group.rows, schema, lambda row: 1 + len(row[2]))
    out = _in_groups(small, run, "rel_id bigint, state string, path array<bigint>, n_below bigint")
    if large is not None:
        with rounds(links.sparkSession, n):
            sizes = _lists_of_large(large).groupBy("rel_id").agg(F.count(F.lit(1)).alias("n_below"))
            more = _large_hierarchy(large)
        more = more.join(sizes, "rel_id", "left")
        out = out.unionByName(more.select("rel_id", "state", "path", F.coalesce("n_below", F.lit(0)).cast("bigint").alias("n_below")))
    is_tree = F.col("state") == "tree"
    return out.select(
        "rel_id", "state", "path", F.when(is_tree, F.get("path", F.lit(0))).alias("top"), F.when(is_tree, F.size("path") - 1).alias("depth"), "n_below")


def _large_hierarchy(links: DataFrame) -> DataFrame:
    """rel_id, state, path of groups too large for one task, from tables."""
    rest = peel(links)
    spark = links.sparkSession
    if rest.n_rest:
        loop = materialize(loops(rest.rest), "loop")
        under = _reach(loop.select("node"), links)
        below = materialize(under.join(loop, "node", "left_anti"), "under")
        free = links.join(under.select(F.col("node").alias("parent")), "parent", "left_anti")
        # a top whose children all are in or below cycles keeps its own chain
        tops = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")
        free = materialize(free.join(under.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child"), "free")
        lone = tops.join(free.select(F.col("parent").alias("node")), "node", "left_anti").select("node", F.array("node").alias("path"))
        tree = chains(free).unionByName(lone)
        lists = loop.groupBy("part").agg(F.array_sort(F.collect_list("node")).alias("path"))
        cyc = loop.join(lists, "part").select("node", F.lit("cycle").alias("state"), "path")
        low = below.select("node", F.lit("below").alias("state"), F.array().cast("array<bigint>").alias("path"))
    else:
        tree = chains(links)
        cyc = low = spark.createDataFrame([], "node bigint, state string, path array<bigint>")
    rows = tree.select("node", F.lit("tree").alias("state"), "path").unionByName(cyc).unionByName(low)
    return rows.select(F.col("node").alias("rel_id"), "state", "path")


def descendants(links: DataFrame) -> DataFrame:
    """rel_id, below of every node and each distinct node below it, loops or not; a node in a loop is below itself."""
    small, large, n = _split(links)
    schema = pa.schema([("rel_id", pa.int64()), ("below", pa.list_(pa.int64()))])
    run = _peel_groups(Group.lists, schema, lambda row: 1 + len(row[1]))
    out = _in_groups(small, run, "rel_id bigint, below array<bigint>").select("rel_id", F.explode("below").alias("below"))
    if large is None:
        return out
    with rounds(links.sparkSession, n):
        return out.unionByName(_lists_of_large(large))


def _lists_of_large(links: DataFrame) -> DataFrame:
    """rel_id, below of groups too large for one task.

    Each loop is condensed to one node, lists are made by peeling what that
    leaves, and the members of loops take its place in them on both sides.
    """
    part = materialize(loops(links), "parts")
    ends = links
    for side in ("parent", "child"):
        ends = ends.join(part.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part")), side, "left")
    a, b = F.coalesce("parent_part", "parent"), F.coalesce("child_part", "child")
    below = peel(ends.select(a.alias("parent"), b.alias("child")).where("parent <> child").distinct(), lists=True).below
    own = part.select("part", F.col("node").alias("rel_id")).join(part.select("part", F.col("node").alias("below")), "part").select("rel_id", "below")
    if below is None:
        return own
    up, down = part.select(F.col("part").alias("node"), F.col("node").alias("rel_id")), part.select(F.col("part").alias("below"), F.col("node").alias("member"))
    out = below.join(up, "node", "left").join(down, "below", "left")
    return out.select(F.coalesce("rel_id", "node").alias("rel_id"), F.coalesce("member", "below").alias("below")).unionByName(own)
