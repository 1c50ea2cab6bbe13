"""Partitions of graphs into parts of equal size with few edges between, level by level, and mini-batches of parts."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_anew
from .running import buckets_along, hash_order, running_sum

#: Nodes a part that the coarsest graph has, about; it is divided on the driver.
COARSE = 30


def _tie(seed: int, level: int) -> Column:
    """A number for an edge that is the same in both directions."""
    return F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed), F.lit(level))


def _matched(nodes: DataFrame, edges: DataFrame, heaviest: float, seed: int, level: int) -> DataFrame:
    """(node, super): nodes paired along heavy edges; what is left is put together with nodes of the same heaviest neighbour.

    An edge is taken if it is the heaviest, ties by hash, of both ends that are still
    free.  Pairs heavier than ``heaviest`` aren't made.
    """
    free = nodes
    taken = None
    for turn in range(3):
        ends = edges.join(free.select(F.col("node").alias("src"), F.col("n").alias("n1")), "src").join(free.select(F.col("node").alias("dst"), F.col("n").alias("n2")), "dst")
        best = ends.where(F.col("n1") + F.col("n2") <= heaviest).groupBy("src").agg(F.max_by("dst", F.struct("w", _tie(seed, level * 8 + turn))).alias("dst"))
        pairs = cut_anew(best.join(best.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst"))
        both = pairs.select(F.col("src").alias("node"), F.col("src").alias("super")).unionAll(pairs.select(F.col("dst").alias("node"), F.col("src").alias("super")))
        taken = both if taken is None else taken.unionAll(both)
        free = cut_anew(free.join(both.select("node"), "node", "left_anti"))
    around = edges.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", F.struct("w", _tie(seed, level))).alias("by"))
    left = cut_anew(free.join(around, "node", "left").withColumn("by", F.coalesce("by", F.lit(-1).cast("long"))))
    sizes = left.groupBy("by").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(heaviest)), F.ceil(F.count("*") / 2)).alias("bins"))
    dealt = left.join(sizes, "by").withColumn("bin", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("bins")))
    named = dealt.groupBy("by", "bin").agg(F.min("node").alias("super"))
    return taken.unionAll(dealt.join(named, ["by", "bin"]).select("node", "super"))


def _contracted(nodes: DataFrame, edges: DataFrame, supers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n) and edges (src, dst, w) between what nodes are put together to."""
    ends = lambda name: supers.select(F.col("node").alias(name), F.col("super").alias(f"{name}_super"))
    joined = edges.join(ends("src"), "src").join(ends("dst"), "dst").where("src_super <> dst_super")
    inner = joined.groupBy(F.col("src_super").alias("src"), F.col("dst_super").alias("dst")).agg(F.sum("w").alias("w"))
    return cut_anew(nodes.join(supers, "node").groupBy(F.col("super").alias("node")).agg(F.sum("n").alias("n"))), cut_anew(inner)


def grown(sizes: dict[int, int], around: dict[int, dict[int, float]], parts: int, slack: float) -> dict[int, int]:
    """A part for each node of a small graph: parts grow along the strongest links, then nodes move while the cut falls."""
    total = sum(sizes.values())
    target = total / parts
    part: dict[int, int] = {}
    filled = [0.0] * parts
    free = set(sizes)
    for p in range(parts):
        pull: dict[int, float] = defaultdict(float)
        while free and filled[p] < target * (1 - slack / 2):
            near = [(g, -x) for x, g in pull.items() if x in free and filled[p] + sizes[x] <= target * (1 + slack)]
            # a new start has the fewest links to what is still free
            x = -max(near)[1] if near else min(free, key=lambda y: (sum(w for z, w in around.get(y, {}).items() if z in free), y))
            part[x] = p
            filled[p] += sizes[x]
            free.discard(x)
            for y, w in around.get(x, {}).items():
                pull[y] += w
    for x in sorted(free, key=lambda y: (-sizes[y], y)):
        links = defaultdict(float)
        for y, w in around.get(x, {}).items():
            if y in part:
                links[part[y]] += w
        room = [p for p in range(parts) if filled[p] + sizes[x] <= target * (1 + slack)] or [int(np.argmin(filled))]
        part[x] = max(room, key=lambda p: (links[p], -filled[p]))
        filled[part[x]] += sizes[x]
    for _ in range(20):
        moved = False
        for x in sorted(sizes):
            links = defaultdict(float)
            for y, w in around.get(x, {}).items():
                links[part[y]] += w
            mine = part[x]
            for p, w in sorted(links.items(), key=lambda c: (-c[1], c[0])):
                better = w > links[mine] + 1e-12 or (w >= links[mine] - 1e-12 and filled[p] + sizes[x] < filled[mine])
                if p != mine and better and filled[p] + sizes[x] <= target * (1 + slack) and filled[mine] - sizes[x] >= target * (1 - slack):
                    filled[mine] -= sizes[x]
                    filled[p] += sizes[x]
                    part[x], moved = p, True
                    break
        if not moved:
            break
    return part


def _numbers(d: dict[int, float]) -> Column:
    """A number for each part."""
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (int(k), float(v))])


def _settled(wanted: DataFrame, room: dict[int, float], spare: dict[int, float]) -> DataFrame:
    """Of moves (node, n, part, to, gain) those of largest gain that every part has room for and every part can spare: (node, to)."""
    along = buckets_along(wanted.withColumn("loss", -F.col("gain")), "loss")
    order = [F.col("loss"), F.col("node")]
    both = cut_anew(running_sum(along, ["to"], "bucket", order, F.col("n"), "come"))
    both = running_sum(both, ["part"], "bucket", order, F.col("n"), "gone")
    fits = (F.col("come") + F.col("n") <= F.element_at(_numbers(room), F.col("to"))) & (F.col("gone") + F.col("n") <= F.element_at(_numbers(spare), F.col("part")))
    return both.where(fits).select("node", "to")


def _sizes(assigned: DataFrame, parts: int) -> dict[int, int]:
    found = {r["part"]: r["n"] for r in assigned.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a part
    return {p: found.get(p, 0) for p in range(parts)}


def _refined(assigned: DataFrame, edges: DataFrame, parts: int, total: int, slack: float, seed: int, sweeps: int) -> DataFrame:
    """(node, n, part) after sweeps in which half of the nodes, by hash, may move to the part they are linked with most."""
    for sweep in range(sweeps):
        sizes = _sizes(assigned, parts)
        links = edges.join(assigned.select(F.col("node").alias("dst"), F.col("part").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
        here = assigned.where(F.pmod(F.xxhash64("node", F.lit(seed)) + sweep, F.lit(2)) == 0)
        seen = links.join(here, "node")
        best = seen.groupBy("node", "n", "part").agg(F.sum(F.when(F.col("to") == F.col("part"), F.col("w")).otherwise(0.0)).alias("own"), F.max(F.when(F.col("to") != F.col("part"), F.struct("w", -F.col("to")))).alias("best"))
        wanted = best.where("best.w > own").select("node", "n", "part", (-F.col("best.col2")).cast("int").alias("to"), (F.col("best.w") - F.col("own")).alias("gain"))
        wanted = cut_anew(wanted)
        flows = wanted.groupBy("part", "to").agg(F.sum("n").alias("n")).collect()  # at most a row for two parts
        if not flows:
            if sweep % 2:
                break
            continue
        come, gone = defaultdict(float), defaultdict(float)
        for r in flows:
            come[r["to"]] += r["n"]
            gone[r["part"]] += r["n"]
        # as many of those who want to, by hash, as part and target have room for, about; _balanced sees to the rest
        free = {p: max(0.0, total / parts * (1 + slack) - s) + gone[p] / 2 for p, s in sizes.items()}
        spare = {p: max(0.0, s - total / parts * (1 - slack)) + come[p] / 2 for p, s in sizes.items()}
        odds = F.least(F.element_at(_numbers({p: free[p] / max(come[p], 1.0) for p in sizes}), F.col("to")), F.element_at(_numbers({p: spare[p] / max(gone[p], 1.0) for p in sizes}), F.col("part")))
        drawn = F.pmod(F.xxhash64("node", F.lit(f"{seed}:{sweep}")), F.lit(1 << 20)) / float(1 << 20)
        moves = wanted.where(drawn < odds).select("node", "to")
        assigned = cut_anew(assigned.join(moves, "node", "left").select("node", "n", F.coalesce("to", "part").alias("part")))
    return assigned


def _balanced(assigned: DataFrame, edges: DataFrame, parts: int, total: int, slack: float, seed: int, rounds: int = 30) -> DataFrame:
    """(node, n, part) with every part's size within ``slack`` of equal, if nodes are small enough: what costs least moves from full to empty parts."""
    low, high = total / parts * (1 - slack), total / parts * (1 + slack)
    for turn in range(rounds):
        sizes = _sizes(assigned, parts)
        mean = total / parts
        if all(low <= s <= high for s in sizes.values()):
            break
        # with full parts, they give; else parts above the mean give to the empty ones
        givers = {p for p, s in sizes.items() if s > high} or {p for p, s in sizes.items() if s > mean}
        takers = sorted((p for p, s in sizes.items() if s < low), key=lambda p: sizes[p]) or sorted((p for p, s in sizes.items() if s < mean), key=lambda p: sizes[p])
        here = assigned.where(F.col("part").isin(*givers))
        some = F.array(*[F.lit(p) for p in takers])
        drawn = F.element_at(some, (F.pmod(F.xxhash64("node", F.lit(seed + turn)), F.lit(len(takers))) + 1).cast("int"))
        links = edges.join(assigned.select(F.col("node").alias("dst"), F.col("part").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
        best = here.join(links, "node", "left").groupBy("node", "n", "part").agg(
            F.sum(F.when(F.col("to") == F.col("part"), F.col("w")).otherwise(0.0)).alias("own"), F.max(F.when(F.col("to").isin(*takers), F.struct("w", F.col("to").alias("to")))).alias("best")
        )
        wanted = best.select("node", "n", "part", F.coalesce("best.to", drawn).cast("int").alias("to"), (F.coalesce("best.w", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))).alias("gain"))
        room = {p: max(0.0, mean - s) + (0 if sizes[p] < low else mean * slack / 2) for p, s in sizes.items()}
        spare = {p: max(0.0, s - mean) for p, s in sizes.items()}
        moves = cut_anew(_settled(wanted, room, spare))
        if moves.isEmpty():
            break
        assigned = cut_anew(assigned.join(moves, "node", "left").select("node", "n", F.coalesce("to", "part").alias("part")))
    return assigned


def partition(edges: DataFrame, parts: int, nodes: DataFrame | None = None, slack: float = 0.05, seed: int = 0, sweeps: int = 4) -> DataFrame:
    """(cell, part): parts 0 to ``parts`` - 1 of sizes within ``slack`` of equal, with few edges between.

    Edges (src, dst, w) count once a pair and without direction; nodes (cell) without an
    edge are dealt out, too.  Heavy edges are contracted level by level (nodes left
    over by their heaviest neighbour), until the graph has about COARSE nodes a part; parts are
    grown there, on the driver, and on the way back nodes move to the part they are linked
    with most while sizes allow.  Nothing but the coarsest graph and a size a part reaches the driver.
    With fewer nodes than parts some are empty.  The same table and seed give the same parts.
    """
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    graph = cut_anew(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(both.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    all_nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        all_nodes = all_nodes.unionAll(nodes.select(F.col("cell").alias("node")))
    now = cut_anew(all_nodes.distinct().withColumn("n", F.lit(1).cast("long")))
    total = many = now.count()
    if not total:
        return now.select(F.col("node").alias("cell"), F.lit(0).alias("part"))
    heaviest = max(2.0, total / parts / (COARSE / 3))
    levels: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while many > COARSE * parts:
        supers = cut_anew(_matched(now, graph, heaviest, seed, len(levels)))
        levels.append((now, graph, supers))
        now, graph = _contracted(now, graph, supers)
        before, many = many, now.count()
        if many > 0.95 * before:
            break
    sizes = {r["node"]: r["n"] for r in now.collect()}  # COARSE nodes a part, about
    around: dict[int, dict[int, float]] = defaultdict(dict)
    for r in graph.collect():
        around[r["src"]][r["dst"]] = r["w"]
    placed = grown(sizes, around, parts, slack)
    assigned = now.sparkSession.createDataFrame([(x, sizes[x], placed[x]) for x in sorted(sizes)], "node long, n long, part int")
    assigned = _refined(cut_anew(assigned), graph, parts, total, slack, seed, sweeps)
    for below, around_below, supers in reversed(levels):
        carried = below.join(supers, "node").join(assigned.select(F.col("node").alias("super"), "part"), "super").select("node", "n", "part")
        assigned = _refined(cut_anew(carried), around_below, parts, total, slack, seed, sweeps)
        graph = around_below
    return _balanced(assigned, graph, parts, total, slack, seed).select(F.col("node").alias("cell"), "part")


def cut_weight(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: the weight of edges (src, dst, w) between parts (cell, part), and of all."""
    ends = edges.join(assigned.select(F.col("cell").alias("src"), F.col("part").alias("p")), "src").join(assigned.select(F.col("cell").alias("dst"), F.col("part").alias("q")), "dst")
    return ends.agg(F.coalesce(F.sum(F.when(F.col("p") != F.col("q"), F.col("w"))), F.lit(0.0)).alias("between"), F.sum("w").alias("total"))


def mini_batches(edges: DataFrame, assigned: DataFrame, per_batch: int = 10, seed: int = 0) -> DataFrame:
    """(batch, src, dst, w): parts shuffled and put together, ``per_batch`` to a batch, with all edges inside a batch."""
    parts = hash_order(assigned.select(F.col("part").alias("cell")).distinct(), [], F.concat_ws(":", F.lit(str(seed)), F.col("cell").cast("string")), "at")
    batch = assigned.join(parts.select(F.col("cell").alias("part"), F.floor((F.col("at") - 1) / per_batch).cast("int").alias("batch")), "part").select("cell", "batch")
    ends = edges.join(batch.select(F.col("cell").alias("src"), "batch"), "src").join(batch.select(F.col("cell").alias("dst"), F.col("batch").alias("other")), "dst")
    return ends.where("batch = other").select("batch", "src", "dst", "w")
