"""Clustering of points and of neighbour graphs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean_of
from ..lineage import cut, cut_anew, release, small
from . import graph, neighbours, reduce

#: Modulus of the draws that nodes are ranked by; fits products in 64 bits.
PRIME = (1 << 31) - 1
#: Resolutions that a search tries in the same joins; it changes the time, not the result.
SIDE_BY_SIDE = 128
#: Edges of a resolution's graph that one task may hold: graphs and levels of so few are finished in a task a resolution, by the same rule, with the same labels.
HELD = 3 << 20
#: What a job costs besides its climbs, in edges of a graph that is climbed meanwhile.
A_JOB = 400_000
#: Times that all may climb from where they are.
CLIMBS = 16
#: Edges of a block that stays in place, at most; fewer where many resolutions send their labels to it.
BLOCK = 1 << 17


def kmeans(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cell, cluster) of (cell, v)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select("cell", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows).select("cell", F.col("prediction").alias("cluster"))


def mixture(points: DataFrame, k: int, seed: int = 0, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(cell, cluster) of the likeliest component of a Gaussian mixture whose components share one covariance.

    Starts from k-means of the points at unit covariance.  A round sends the parameters to every partition and
    adds up each component's weight and sum; the shared covariance follows from
    these and the points' second moments, which are taken once.  Rounds end when
    the mean log likelihood rises by less than ``tol``.  A covariance that cannot
    be inverted raises LinAlgError.
    """
    n, s, g = reduce.moments(points)
    if not n:
        return points.select("cell", F.lit(0).alias("cluster"))
    values, axes = np.linalg.eigh(g / n - np.outer(s, s) / (n * n))
    if values[0] <= 1e-12 * max(values[-1], 1e-300):
        raise np.linalg.LinAlgError("the points' covariance is singular")
    start = points.join(kmeans(reduce.turned(points, axes / np.sqrt(values), "cell"), k, seed), "cell").groupBy("cluster").agg(F.count("*").alias("n"), mean_of("v", len(s)).alias("c")).orderBy("cluster").collect()  # k rows
    share, mean = np.array([r["n"] for r in start], float), np.array([r["c"] for r in start])
    last = -math.inf

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, m = v @ turn, mean @ turn
        d = (z * z).sum(axis=1)[:, None] - 2 * z @ m.T + (m * m).sum(axis=1)
        log = np.log(share / n) - 0.5 * d + 0.5 * scale
        top = log.max(axis=1, keepdims=True)
        part = np.exp(log - top)
        total = part.sum(axis=1, keepdims=True)
        return part / total, (np.log(total) + top)[:, 0]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + len(share) * (1 + len(s)))
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                part, like = parts(v)
                total += np.concatenate([[like.sum()], part.sum(axis=0), (part.T @ v).reshape(-1)])
        yield pd.DataFrame({"v": [total]})

    for _ in range(rounds):
        cov = (g - (mean.T * share) @ mean) / n
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        if values[0] <= 1e-12 * max(values[-1], 1e-300):
            raise np.linalg.LinAlgError("the shared covariance is singular")
        turn, scale = axes / np.sqrt(values), -np.log(values).sum() - len(s) * math.log(2 * math.pi)
        total = reduce.added(points.select("v").mapInPandas(add, "v array<double>"))
        share = np.maximum(total[1 : 1 + len(share)], 1e-9)
        mean = total[1 + len(share) :].reshape(len(share), len(s)) / share[:, None]
        if total[0] / n - last < tol:
            break
        last = total[0] / n

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": b["cell"], "cluster": parts(np.stack(b["v"].to_numpy()))[0].argmax(axis=1) if len(b) else []})

    return points.select("cell", "v").mapInPandas(assign, "cell long, cluster int")


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a labeling (cell, cluster) of an undirected graph whose edges come in both directions."""
    e = edges.join(clusters.select(F.col("cell").alias("src"), F.col("cluster").alias("c1")), "src").join(clusters.select(F.col("cell").alias("dst"), F.col("cluster").alias("c2")), "dst")
    # one pass: the edges are made once
    degree = e.groupBy("c1").agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("d"))
    sums = degree.agg(F.sum("inner").alias("inner"), F.sum("d").alias("m2"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return sums.select((F.col("inner") / F.col("m2") - resolution * F.col("dd") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """A block's edges in one row: sorted by the first end."""
    names = [c for c in ("at", "src", "dst", "w") if c in part.columns]
    part = part.sort_values([c for c in names if c != "w"])
    return pd.DataFrame({"block": part["block"].iloc[:1], **{c: [part[c].to_numpy().tobytes()] for c in names}})


def _offers(total: float, within: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a packed block of edges and the nodes at their ends: ``_proposals`` of the block's nodes, in numpy."""

    def offer(held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("r", "cell", "k", "mine", "target", "margin")})]
        if len(held):
            kinds = {"at": np.float64, "src": np.int64, "dst": np.int64, "w": np.float64}
            edge = {c: np.frombuffer(held[c].iloc[0], kinds[c]) for c in kinds if c in held.columns}
            for r, node in sent.groupby("r"):
                node = node.sort_values("cell")
                cell, k, label, home, s, many = (node[c].to_numpy() for c in ("cell", "k", "cluster", "home", "s", "many"))
                # of other resolutions' nodes or of some that are settled there are none
                src, dst, w = (edge[c] if "at" not in edge else edge[c][edge["at"] == r] for c in ("src", "dst", "w"))
                i, j = np.searchsorted(cell, src), np.searchsorted(cell, dst)
                names, first, c = np.unique(label, return_index=True, return_inverse=True)
                if within:
                    seen = (home[i] == home[j]) & (many[i] == 1)
                    i, j, w = i[seen], j[seen], w[seen]
                of, to, inside = _links(i, c[j], w, len(cell), len(names))
                here = to == c[of]
                stay = np.zeros(len(cell))
                stay[of[here]] = inside[here]
                gain = (inside - r * k[of] / total * s[first[to]])[~here]
                of, to = of[~here], to[~here]
                best = _best(of, gain)
                x, to = of[best], to[best]
                margin = gain[best] - (stay[x] - r * k[x] / total * (s[x] - k[x]))
                gains = margin > 1e-12 * k[x]
                x, to = x[gains], to[gains]
                out.append(pd.DataFrame({"r": float(r), "cell": cell[x], "k": k[x], "mine": label[x], "target": names[to], "margin": margin[gains]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return offer


class Blocks:
    """Edges in both directions, packed in blocks by their first ends: they stay where they are while nodes' labels come to them."""

    def __init__(self, edges: DataFrame, resolutions: int) -> None:
        own = "r" in edges.columns
        of = lambda end: F.pmod(F.xxhash64(*(["r"] if own else []), end), F.lit(blocks)).cast("int")
        blocks = max(1, math.ceil(edges.count() / min(BLOCK, (BLOCK << 5) // (1 if own else resolutions))))
        self.key = ["r", "cell"] if own else ["cell"]
        self.tasks = min(blocks, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        columns = [*([F.col("r").alias("at")] if own else []), "src", "dst", "w"]
        held = edges.select(of("src").alias("block"), *columns).repartition(self.tasks, "block").groupBy("block").applyInPandas(_packed, "block int, " + ("at binary, " if own else "") + "src binary, dst binary, w binary")
        self.held = held.repartition(self.tasks, "block").persist(StorageLevel.DISK_ONLY)
        # a node goes to its own block and to those of its neighbours
        ends = F.explode(F.array(of("src"), of("dst"))).alias("block")
        self.to = cut_anew(edges.select(*self.key[:-1], F.col("dst").alias("cell"), ends).groupBy(*self.key).agg(F.collect_set("block").alias("to")))

    def proposals(self, now: DataFrame, total: float, within: bool) -> DataFrame:
        """(r, cell, k, mine, target, margin): each node's move of largest gain, of those that gain; ``within``: of nodes alone, inside their home."""
        sums = now.groupBy("r", "cluster").agg(F.sum("k").alias("s"), F.count("*").alias("many"))
        state = now.join(sums, ["r", "cluster"]).join(self.to, self.key)
        sent = state.select(F.explode("to").alias("block"), "r", "cell", "k", "cluster", "home", "s", "many").repartition(self.tasks, "block")
        return self.held.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_offers(total, within), "r double, cell long, k double, mine long, target long, margin double")


def _draw(turn: int) -> Column:
    """A number from 0 to PRIME - 1 of a cell's id and the turn."""
    y = F.pmod(F.pmod("cell", F.lit(PRIME)) * 48271 + (turn + 1) * 1299721, F.lit(PRIME))
    return F.pmod(y.bitwiseXOR(F.shiftright(y, 13)) * 69621 + 12345, F.lit(PRIME))


def _accepted(proposals: DataFrame, total: float, turn: int) -> DataFrame:
    """(r, cell, target): proposals that raise modularity also when all of them happen.

    A community only gains or only loses nodes, as its strongest proposal does.  What
    nodes that come or go together cost each other is bounded by the degrees of those
    that rank alike or higher by a draw, which halve from rank to rank; a proposal that
    gains more than that happens.
    """
    draw = _draw(turn)
    ranked = proposals.withColumn("rank", F.length(F.bin(draw)))
    strength = F.struct("margin", draw.alias("draw"), "cell")
    ends = F.explode(F.array(F.struct(F.col("mine").alias("cluster"), F.lit(-1).alias("way")), F.struct(F.col("target").alias("cluster"), F.lit(1).alias("way")))).alias("end")
    role = proposals.select("r", strength.alias("strength"), ends).groupBy("r", "end.cluster").agg(F.max_by("end.way", "strength").alias("way"))
    as_end = lambda end, way: role.where(F.col("way") == way).select("r", F.col("cluster").alias(end))
    kept = ranked.join(as_end("mine", -1), ["r", "mine"]).join(as_end("target", 1), ["r", "target"])
    upto = lambda end: kept.groupBy("r", end, "rank").agg(F.sum("k").alias("k")).select("r", end, "rank", F.sum("k").over(Window.partitionBy("r", end).orderBy("rank")).alias(f"with_{end}"))  # noqa: E731  # 32 ranks a community
    both = kept.join(upto("mine"), ["r", "mine", "rank"]).join(upto("target"), ["r", "target", "rank"])
    others = F.col("with_mine") + F.col("with_target") - 2 * F.col("k")
    return both.where(F.col("margin") - F.col("r") * F.col("k") * others / F.lit(total) > 1e-12 * F.col("k")).select("r", "cell", "target")


def _moved(blocks: Blocks, now: DataFrame, total: float, within: bool = False) -> tuple[DataFrame, list[float]]:
    """Nodes (r, cell, k, cluster, home) after moves until none gains, and the resolutions r at which any moved.

    Every round raises the modularity at each open resolution, so it ends.
    """
    still, moved, turn, before = [], None, 0, None
    while True:
        found = cut_anew(blocks.proposals(now, total, within))
        active = sorted(row["r"] for row in found.select("r").distinct().collect())  # resolutions
        still.append(now.where(~F.col("r").isin(active)))
        moved = active if moved is None else moved
        if not active:
            return fold(DataFrame.unionAll, still), moved
        if active != before:
            now, before = now.where(F.col("r").isin(active)), active
        else:
            still.pop()
        now = cut_anew(now.join(_accepted(found, total, turn), ["r", "cell"], "left").select("r", "cell", "k", F.coalesce("target", "cluster").alias("cluster"), "home"))
        release(found)
        turn += 1


def _climbed(edges: DataFrame, start: DataFrame, total: float, refine: bool) -> tuple[DataFrame, list[float]]:
    """One way up from the labels ``start`` (r, cell, k, cluster, home) through graphs of communities: labels of the same nodes, and the resolutions at which any node moved at once."""
    level, nodes, first = edges, start, None
    at, out = start.select("r", "cell", F.col("cell").alias("node")), []
    named = lambda a, n: a.join(n.select("r", F.col("cell").alias("node"), "cluster"), ["r", "node"]).select("r", "cell", "cluster")
    while True:
        most = level.groupBy(*[c for c in ("r",) if c in level.columns]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= HELD:
            own = level if "r" in level.columns else level.crossJoin(F.broadcast(nodes.select("r").distinct()))  # a row a resolution is sent
            now = cut_anew(nodes.groupBy("r").cogroup(own.select(F.col("r").alias("at"), "src", "dst", "w").groupBy("at")).applyInPandas(_climbed_held(total, refine), "r double, cell long, cluster long, moved boolean"))
            out.append(named(at, now))
            first = first if first is not None else [row["r"] for row in now.where("moved").select("r").distinct().collect()]  # resolutions
            break
        blocks = Blocks(level, nodes.select("r").distinct().count())
        now, moved = _moved(blocks, nodes, total)
        first = moved if first is None else first
        going = F.col("r").isin(moved)
        out.append(named(at.where(~going), now.where(~going)))
        if not moved:
            blocks.held.unpersist()
            break
        at, now = at.where(going), cut_anew(now.where(going))
        part = now.withColumn("part", F.col("cluster"))
        if refine:
            parts, grown = _moved(blocks, now.select("r", "cell", "k", F.col("cell").alias("cluster"), F.col("cluster").alias("home")), total, within=True)
            # where nothing grew together, communities become nodes
            part = cut_anew(parts.select("r", "cell", "k", F.col("home").alias("cluster"), F.when(F.col("r").isin(grown), F.col("cluster")).otherwise(F.col("home")).alias("part")))
        blocks.held.unpersist()
        end = lambda name, out: part.select("r", F.col("cell").alias(name), F.col("part").alias(out))  # noqa: E731, B023
        at = cut_anew(at.join(end("node", "to"), ["r", "node"]).select("r", "cell", F.col("to").alias("node")))
        level = level.join(end("src", "p"), [c for c in ("r", "src") if c in level.columns]).join(end("dst", "q"), ["r", "dst"])
        level = cut_anew(level.where("p <> q").groupBy("r", F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.sum("w").alias("w")))
        nodes = cut_anew(part.groupBy("r", F.col("part").alias("cell")).agg(F.sum("k").alias("k"), F.first("cluster").alias("cluster")).withColumn("home", F.lit(0).cast("long")))
    return fold(DataFrame.unionAll, out), first


def _bits(cell: np.ndarray, turn: int) -> np.ndarray:
    """As ``_draw``, in numpy."""
    y = ((cell % PRIME) * 48271 + (turn + 1) * 1299721) % PRIME
    return ((y ^ (y >> 13)) * 69621 + 12345) % PRIME


def _links(src: np.ndarray, to: np.ndarray, w: np.ndarray, n: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges from ``src`` (below n) to communities ``to`` (below many): each pair once, sorted, with its summed weight."""
    if not len(src):
        return src, to, w
    key, bits = src.astype(np.int64) * many + to, len(src).bit_length()
    if (n * many).bit_length() + bits <= 62:  # an edge's place travels in the key, which is faster than sorting places
        key <<= bits
        key += np.arange(len(src))
        key.sort()
        place = key & ((1 << bits) - 1)
        key >>= bits
    else:
        place = np.argsort(key, kind="stable")
        key = key[place]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // many, key[first] % many, np.add.reduceat(w[place], first)


def _best(of: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The places of each node's largest gain, the first of equals, in rows sorted by node."""
    if not len(of):
        return np.zeros(0, np.int64)
    new = np.diff(of, prepend=-1) != 0
    top = np.flatnonzero(gain == np.maximum.reduceat(gain, np.flatnonzero(new))[np.cumsum(new) - 1])
    return top[np.diff(of[top], prepend=-1) != 0]


def _upto_rank(end: np.ndarray, rank: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each proposal the degrees of those of the same end that rank alike or lower."""
    names, at = np.unique(end, return_inverse=True)
    return np.bincount(at * 33 + rank, k, 33 * len(names)).reshape(-1, 33).cumsum(axis=1)[at, rank]


def _added(key: np.ndarray, inside: np.ndarray, more: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their sums after changes, with sorted keys as well; sums of 0 go."""
    at = np.searchsorted(key, more)
    old = np.zeros(len(more), bool)
    old[at < len(key)] = key[at[at < len(key)]] == more[at < len(key)]
    at = at[old]
    inside[at] += change[old]
    gone, new = at[inside[at] == 0], ~old & (change != 0)
    if len(gone):
        kept = np.ones(len(key), bool)
        kept[gone] = False
        key, inside = key[kept], inside[kept]
    if new.any():
        at = np.searchsorted(key, more[new])
        key, inside = np.insert(key, at, more[new]), np.insert(inside, at, change[new])
    return key, inside


def _moved_held(cell: np.ndarray, edge: tuple[np.ndarray, np.ndarray, np.ndarray], k: np.ndarray, label: np.ndarray, home: np.ndarray, r: float, total: float, within: bool = False) -> tuple[np.ndarray, bool]:
    """As ``_moved``, in numpy: the labels of a graph's nodes, whose edges (src, dst, w) go by the nodes' places and are sorted by dst.

    Links of nodes to communities are summed once; a round takes the links of those that
    moved from one community to the other.  Weights are whole numbers, so sums stay exact.
    """
    n, turn = len(cell), 0
    names, c = np.unique(label, return_inverse=True)
    s, many = np.bincount(c, k), np.bincount(c)
    src, dst, w = edge
    if within:
        seen = home[src] == home[dst]
        src, dst, w = src[seen], dst[seen], w[seen]
    if not len(src):
        return label, False
    size = np.bincount(dst, minlength=n)
    start, share, bits = np.cumsum(size) - size, r * k / total, len(names).bit_length()
    of, to, inside = _links(src, c[dst], w, n, len(names))
    key = (of << bits) + to
    while True:
        first = np.flatnonzero(np.diff(of, prepend=-1))
        gain, here = share[of], to == c[of]
        gain *= s[to]
        np.subtract(inside, gain, out=gain)
        stay = np.zeros(n)
        stay[of[here]] = inside[here]
        gain[here] = -np.inf
        x, top = of[first], np.maximum.reduceat(gain, first)
        margin = top - (stay[x] - share[x] * (s[c[x]] - k[x]))
        open_ = np.flatnonzero((margin > 1e-12 * k[x]) & (many[c[x]] == 1 if within else True))
        if not len(open_):
            return names[c], turn > 0
        links = np.diff(first, append=len(of))[open_]
        at, row = neighbours.spans(first[open_], links), np.repeat(np.arange(len(open_)), links)
        best = np.flatnonzero(gain[at] == top[open_][row])
        to = to[at[best[np.diff(row[best], prepend=-1) != 0]]]
        x, margin = x[open_], margin[open_]
        mine, draw = c[x], _bits(cell[x], turn)
        place = np.empty(len(x), np.int64)
        place[np.lexsort((cell[x], draw, margin))] = np.arange(len(x))
        role = np.full(len(names), -1)
        np.maximum.at(role, mine, 2 * place)
        np.maximum.at(role, to, 2 * place + 1)
        kept = (role[mine] % 2 == 0) & (role[to] % 2 == 1)
        x, to, margin, mine, rank = x[kept], to[kept], margin[kept], mine[kept], np.maximum(np.frexp(draw[kept].astype(float))[1], 1)
        others = _upto_rank(mine, rank, k[x]) + _upto_rank(to, rank, k[x]) - 2 * k[x]
        happens = margin - r * k[x] * others / total > 1e-12 * k[x]
        x, to, mine = x[happens], to[happens], mine[happens]
        c[x] = to
        for sums, by in ((s, k[x]), (many, 1)):
            np.subtract.at(sums, mine, by)
            np.add.at(sums, to, by)
        at = neighbours.spans(start[x], size[x])
        node, new, change = _links(np.tile(src[at], 2), np.repeat(np.concatenate([mine, to]), np.tile(size[x], 2)), np.concatenate([-w[at], w[at]]), n, len(names))
        key, inside = _added(key, inside, (node << bits) + new, change)
        of, to = key >> bits, key & ((1 << bits) - 1)
        turn += 1


def _climb(cell: np.ndarray, edge: tuple[np.ndarray, np.ndarray, np.ndarray], k: np.ndarray, label: np.ndarray, r: float, total: float, refine: bool) -> tuple[np.ndarray, bool]:
    """As ``_climbed``, in numpy, of one resolution's graph: the nodes' labels, and whether any node moved at once."""
    at, first = np.arange(len(cell)), None
    while True:
        none = np.zeros(len(cell), np.int64)
        found, moved = _moved_held(cell, edge, k, label, none, r, total)
        first = moved if first is None else first
        if not moved:
            return found[at], first
        part = found
        if refine:
            parts, grown = _moved_held(cell, edge, k, cell, found, r, total, within=True)
            part = parts if grown else found
        cell, one, of = np.unique(part, return_index=True, return_inverse=True)
        k, label, at = np.bincount(of, k), found[one], of[at]
        p, q = of[edge[0]], of[edge[1]]
        q, p, w = _links(q[p != q], p[p != q], edge[2][p != q], len(cell), len(cell))
        edge = p, q, w


def _climbed_held(total: float, refine: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """``_climb`` as a function of a resolution's nodes and edges."""

    def climb(node: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        if not len(node):
            return pd.DataFrame({"r": [], "cell": [], "cluster": [], "moved": []})
        node, r = node.sort_values("cell"), float(node["r"].iloc[0])
        cell, k, label = (node[c].to_numpy() for c in ("cell", "k", "cluster"))
        label, moved = _climb(cell, _by_end(cell, edge), k, label, r, total, refine)
        return pd.DataFrame({"r": r, "cell": cell, "cluster": label, "moved": moved})

    return climb


def _by_end(cell: np.ndarray, edge: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (src, dst, w) by the places of their ends among the sorted nodes, sorted by dst."""
    dst, src, w = _links(np.searchsorted(cell, edge["dst"]), np.searchsorted(cell, edge["src"]), edge["w"].to_numpy(), len(cell), len(cell))
    return src, dst, w


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A graph of at most HELD edges in one row: its nodes, and its edges as in ``_by_end``."""
    edge = pd.concat([pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "w": np.zeros(0)}), *batches], ignore_index=True)
    cell = np.unique(edge["src"].to_numpy())
    src, dst, w = _by_end(cell, edge)
    yield pd.DataFrame({"cell": [cell.tobytes()], "src": [src.astype(np.int32).tobytes()], "dst": [dst.astype(np.int32).tobytes()], "w": [w.tobytes()]})


def _all_climbs(graph: tuple[bytes, bytes, bytes, bytes], r: float, total: float, refine: bool) -> pd.DataFrame:
    """(resolution, cell, cluster) of a graph in one row: climbs from single nodes until no node moves at once; communities are named by their least cell."""
    cell, src, dst, w = (np.frombuffer(x, kind) for x, kind in zip(graph, (np.int64, np.int32, np.int32, np.float64), strict=True))
    k, label, moved, turn = np.bincount(src, w, len(cell)), cell, True, 0
    while moved and turn < CLIMBS:
        label, moved = _climb(cell, (src, dst, w), k, label, r, total, refine)
        turn += 1
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return pd.DataFrame({"resolution": r, "cell": cell, "cluster": cell[first][of]})


class Graph:
    """Edges (src, dst, w) in both directions whose communities are looked for, with weights rounded to 2^-24 of the largest, so that sums are exact, whatever their order.

    Loops and nodes without edges don't count.
    """

    def __init__(self, edges: DataFrame) -> None:
        edges = cut(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")))
        top = edges.agg(F.max("w")).first()[0] or 1.0
        self.edges = cut(edges.groupBy("src", "dst").agg(F.sum(F.round(F.col("w") / F.lit(top) * (1 << 24))).alias("w")).where("w > 0"))
        self.count, total = self.edges.agg(F.count("*"), F.sum("w")).first()
        self.total = float(total or 1.0)

    @cached_property
    def shared(self) -> Broadcast:
        """The graph in one row, of 16 bytes an edge, sent to every executor."""
        row = self.edges.coalesce(1).mapInPandas(_whole, "cell binary, src binary, dst binary, w binary").first()
        return self.edges.sparkSession.sparkContext.broadcast(tuple(map(bytes, row)))

    def communities_at(self, resolutions: list[float], refine: bool = True) -> DataFrame:
        """(resolution, cell, cluster); see ``communities_at``."""
        tried = [float(r) for r in sorted(set(resolutions))]
        return self._in_tasks(tried, refine) if self.count <= HELD else self._in_joins(tried, refine)

    def _in_tasks(self, tried: list[float], refine: bool) -> DataFrame:
        """A task a resolution."""
        shared, total = self.shared, self.total

        def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"]:
                    yield _all_climbs(shared.value, tried[i], total, refine)

        return self.edges.sparkSession.range(0, len(tried), 1, len(tried)).mapInPandas(climb, "resolution double, cell long, cluster long")

    def _in_joins(self, tried: list[float], refine: bool) -> DataFrame:
        """All resolutions in the same joins and aggregations, for graphs of any size."""
        rows = self.edges.sparkSession.createDataFrame([(r,) for r in tried], "r double")
        degree = self.edges.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("k"))
        state = cut_anew(degree.crossJoin(F.broadcast(rows)).select("r", "cell", "k", F.col("cell").alias("cluster"), F.lit(0).cast("long").alias("home")))  # a row a resolution is sent
        out = []
        for _ in range(CLIMBS):
            found, moved = _climbed(self.edges, state, self.total, refine)
            labels = cut_anew(found)
            if not moved:
                out.append(labels)
                break
            going = F.col("r").isin(moved)
            out.append(labels.where(~going))
            state = state.where(going).drop("cluster").join(labels, ["r", "cell"]).select("r", "cell", "k", "cluster", "home")
        else:
            out.append(labels.where(going))
        whole = fold(DataFrame.unionAll, out)
        names = whole.groupBy("r", "cluster").agg(F.min("cell").alias("name"))
        return whole.join(names, ["r", "cluster"]).select(F.col("r").alias("resolution"), "cell", F.col("name").alias("cluster"))


def communities(edges: DataFrame, resolution: float = 1.0, refine: bool = True) -> DataFrame:
    """(cell, cluster): communities of high modularity, over edges (src, dst, w) in both directions; named by their least cell."""
    return communities_at(edges, [resolution], refine).select("cell", "cluster")


def communities_at(edges: DataFrame, resolutions: list[float], refine: bool = True) -> DataFrame:
    """(resolution, cell, cluster): communities at several resolutions, of graphs of any size.

    Points move to the neighbouring community of largest gain until none gains, many at
    a time; then communities become points, and so on, and all over until no point gains
    by moving (Louvain's method).  With ``refine``, the default, communities are split,
    before they become points, into parts that grew together from single points and move
    as wholes from there (Leiden's).  Up to HELD edges a task finds a resolution's, beyond
    that all are found in the same joins, by the same rule; see ``Graph``.
    """
    return Graph(edges).communities_at(resolutions, refine)


def counts_at(graph: Graph, resolutions: list[float], refine: bool = True) -> tuple[DataFrame, dict[float, int]]:
    """A graph's communities, written once, and the number of communities at each resolution."""
    found = cut(graph.communities_at(resolutions, refine))
    return found, {r["resolution"]: r["n"] for r in found.groupBy("resolution").agg(F.count_distinct("cluster").alias("n")).collect()}  # a row a resolution


def communities_of(edges: DataFrame, wanted: int, low: float = 0.1, high: float = 3.0, step: float = 0.01, refine: bool = True) -> DataFrame:
    """(cell, cluster) at the highest resolution from ``low`` to below ``high``, in steps, that gives ``wanted`` clusters.

    From the highest down, ``SIDE_BY_SIDE`` steps in the same joins, until the number is met.  Where none gives the number, this raises.
    """
    steps = [low + k * step for k in range(math.ceil((high - low) / step - 1e-9))][::-1]
    held = Graph(edges)
    for first in range(0, len(steps), SIDE_BY_SIDE):
        found, many = counts_at(held, steps[first : first + SIDE_BY_SIDE], refine)
        hit = [r for r, n in many.items() if n == wanted]
        if hit:
            return found.where(F.col("resolution") == max(hit)).select("cell", "cluster")
    raise ValueError(f"no resolution from {low} to {high} in steps of {step} gives {wanted} clusters")


def _halves(low: float, high: float, depth: int) -> list[float]:
    """The middles that ``depth`` bisections may come to."""
    mid = low + (high - low) / 2
    return [mid, *_halves(low, mid, depth - 1), *_halves(mid, high, depth - 1)] if depth else []


def _ahead(held: Graph) -> int:
    """How many bisections are tried ahead: where a resolution is a task, what finds most of them in a time on so many cores."""
    if held.count > HELD:
        return 5
    cores = held.edges.sparkSession.sparkContext.defaultParallelism
    return min(range(1, 6), key=lambda d: (A_JOB + -(-(2**d - 1) // cores) * held.count) / d)


def communities_near(edges: DataFrame, wanted: int, low: float = 0.0, high: float = 3.0, max_steps: int = 30, tolerance: int = 0, refine: bool = True) -> DataFrame:
    """(cell, cluster) by bisection of the resolution until the clusters are ``wanted``, give or take ``tolerance``; after ``max_steps`` the last ones.

    All resolutions that the next few bisections may come to are tried side by side.
    """
    held, many = Graph(edges), {}
    ahead = _ahead(held)
    for _ in range(max_steps):
        mid = low + (high - low) / 2
        if mid not in many:
            found, many = counts_at(held, _halves(low, high, ahead), refine)
        n = many.get(mid, 0)
        if n > wanted + tolerance:
            high = mid
        elif n < wanted - tolerance:
            low = mid
        else:
            break
    return found.where(F.col("resolution") == mid).select("cell", "cluster")


def clustering(points: DataFrame, k: int, method: str = "mixture", n_components: int | None = None, neighbours_of: int = 50, seed: int = 0) -> DataFrame:
    """(cell, cluster) of points (cell, v) by mixture, kmeans, leiden or louvain, on principal components if a number is given.

    The last two look for ``k`` communities of the graph of nearest neighbours.
    """
    if n_components is not None:
        points = reduce.pca(points, n_components)[0]
    if method in ("mixture", "kmeans"):
        return {"mixture": mixture, "kmeans": kmeans}[method](points, k, seed)
    if method not in ("leiden", "louvain"):
        raise ValueError(f"no method {method}")
    near = neighbours.knn(points, points, neighbours_of, itself=False)
    return communities_of(graph.symmetric(near).withColumn("w", F.lit(1.0)), k, refine=method == "leiden")


def clusters_of(points: DataFrame, k: int, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """(cell, cluster) by k-means, or by a mixture; where that has a singular covariance, by k-means, too."""
    if method != "kmeans":
        try:
            return mixture(points, k, seed)
        except np.linalg.LinAlgError:
            pass
    return kmeans(points, k, seed)


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell, cluster): the nearest of a few centroids (cluster, c), the smallest of equals; each row looks through all of them, in one array."""
    held = small(centroids.agg(F.collect_list(F.struct("cluster", "c")).alias("held")))  # one row
    far = lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("held", lambda h: F.struct(far(h["c"]).alias("d"), h["cluster"].alias("cluster"))))
    return points.crossJoin(held).where(F.size("held") > 0).select("cell", best["cluster"].alias("cluster"))


def centroids(points: DataFrame, label: str, dim: int) -> DataFrame:
    """(cluster, c, n): mean vectors of ``dim`` numbers each; others are an error."""
    return points.groupBy(F.col(label).alias("cluster")).agg(mean_of("v", dim).alias("c"), F.count("*").alias("n"))


def covariances(points: DataFrame, label: str, dim: int | None = None, names: list | None = None) -> DataFrame:
    """(cluster, i, j, cov): covariance of the dimensions within each cluster, by count (not count - 1).

    Sums of products are taken where the points are, one small matrix a cluster and
    partition.  A cluster of ``names`` without points has 0.0005 on the diagonal.
    """
    rows = points.select(F.col(label).alias("cluster"), "v")
    kind = rows.schema["cluster"].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for c, own in b.groupby("cluster", sort=False, dropna=False):
                v = np.stack(own["v"].to_numpy())
                n, s, g = held.get(c, (0, 0.0, 0.0))
                held[c] = n + len(v), s + v.sum(axis=0), g + v.T @ v
        for c, (n, s, g) in held.items():
            yield pd.DataFrame({"cluster": [c], "t": [np.concatenate([[n], s, g.reshape(-1)])]})

    sums = rows.mapInPandas(add, f"cluster {kind}, t array<double>").select("cluster", F.posexplode("t").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("t"))  # one row a cluster
    d = F.expr("cast((sqrt(1 + 4 * (size(t) - 1)) - 1) / 2 as int)")
    cells = whole.withColumn("d", d).withColumn("i", F.explode(F.expr("sequence(0, d - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, d - 1)")))
    out = cells.select("cluster", "i", "j", F.expr("t[1 + d + i * d + j] / t[0] - t[1 + i] / t[0] * t[1 + j] / t[0]").alias("cov"))
    if names is None:
        return out
    empty = points.sparkSession.createDataFrame([(c,) for c in names], f"cluster {kind}").join(whole, "cluster", "left_anti")
    grid = empty.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    return out.unionAll(grid.select("cluster", "i", "j", F.when(F.col("i") == F.col("j"), 0.0005).otherwise(0.0).alias("cov")))
