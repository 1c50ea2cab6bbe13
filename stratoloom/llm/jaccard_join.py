"""Exact n-gram Jaccard join of documents by a token-group matrix.

Documents with equal shingle sets are one class.  Classes are partitioned into
groups of similar sets (equal least hash, in blocks of bounded size), and the
matrix keeps which tokens each group's union holds.  In one global order of
tokens, two sets that reach the similarity share DEPTH tokens among their first
ones, if they share as many at all, so the matrix needs only these first tokens
of each set.  What two groups' unions there share bounds what their members can
share: groups whose unions share fewer, or share them too late for their sizes,
are never opened, and none of their sets travels.  Where two groups meet, a
member is compared only if the other group's full union holds enough of its
tokens; members that remain are counted against each other exactly.

The order puts tokens that many documents have last, by counts in a fixed table
of counters.  Any order gives exact results; this one keeps the passages that
many documents share out of the matrix.  Tokens are 64-bit hashes, so results are
exact but for chance collisions of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.components import connected_components
from ..operators.running import bucket_count, running_sum
from .shingles import U, mix, shingle_sets
from .tables import small_batches, table

#: Bits of the counters' table (8 MB as it is sent out), dealt in parts.
BITS, PARTS = 22, 64
#: Members of a group, about, at most.
GROUP = 64
#: Bits of the filter of ids (4 MB, in the same parts) that spares texts of unopened groups a shuffle.
FILTER = 25
#: Tokens that unions share at least where groups meet (or all that a set must share).
DEPTH = 3
#: Groups of a token that are listed in one row; more are dealt into lists that meet in pairs.
LISTED = 1024
#: Sets and tokens, about, of a block of groups that meet; two blocks are opened in one place, so that a set travels once a
#: block.  Blocks get larger sets rather than more in number beyond BLOCKS, unless their tokens are too many for one place.
BLOCK_SETS, BLOCK_TOKENS, BLOCKS = 256, 1 << 23, 64
#: Shared tokens that are counted in one matrix product.
WIDTH = 4096


def needed(n, percent: int):
    """The tokens that a set of n shares at least with any set as similar as ``percent``."""
    return -(-percent * n // 100)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """Two places in the filter for each hash."""
    return [(h >> U(64 - FILTER)).astype(np.int64), (h & U((1 << FILTER) - 1)).astype(np.int64)]


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids in ``ids`` (rep): a bit table of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER, bool)
        for batch in batches:
            for at in _slots(mix(batch.column(0).to_numpy().view(U))):
                bits[at] = True
        if bits.any():
            parts = np.packbits(bits).reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "bits"])

    def join(rows: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in rows.column("bits")])
        return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "bits": pa.array([every.tobytes()], pa.binary())})

    shape = "part int, bits binary"
    found = np.zeros((PARTS, (1 << FILTER) // 8 // PARTS), np.uint8)
    for part, bits in ids.select("rep").mapInArrow(mark, shape).groupBy("part").applyInArrow(join, shape).collect():  # PARTS rows, 4 MB
        found[part] = np.frombuffer(bits, np.uint8)
    return found.reshape(-1)


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """In how many documents, about, the tokens of each counter are, as levels: a table of fixed size."""
    cells = (1 << BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            many: list[np.ndarray] = []
            for s in shingle_sets(batch.column(0), size):
                many.append(s)
                if len(many) == 512:
                    total += np.bincount((np.concatenate(many) >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
                    many = []
            if many:
                total += np.bincount((np.concatenate(many) >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        if total.any():
            parts = [_narrow(p).tobytes() for p in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(cells, np.int64)
        for b in rows.column("counts"):
            raw = b.as_buffer()
            total += np.frombuffer(raw, f"u{len(raw) // cells}")
        return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "counts": pa.array([_levels(total).tobytes()], pa.binary())})

    shape = "part int, counts binary"
    table = np.zeros((PARTS, cells), np.uint16)
    for part, counts in docs.select("text").mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape).collect():  # PARTS rows, 8 MB
        table[part] = np.frombuffer(counts, np.uint16)
    return table.reshape(-1)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in as few bytes as the largest needs."""
    return counts.astype(next(f"u{size}" for size in (1, 2, 4, 8) if counts.max() < 1 << 8 * size))


def _levels(counts: np.ndarray) -> np.ndarray:
    """16-bit levels that never fall as counts rise: exact up to 4096, then a 512th of a doubling each."""
    return np.where(counts <= 4096, counts, 4096 + np.floor(512 * (np.log2(np.maximum(counts, 1)) - 12))).astype(np.uint16)


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, hi and lo (the set's 128-bit hash), least (its least mixed token), prefix."""
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = counts.value, set()
        for batch in batches:
            n, hi, lo, least, prefixes = [], [], [], [], []
            named = batch.column("doc_id").is_valid().to_pylist()
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                if not len(s):
                    hi.append(0), lo.append(0), least.append(0), prefixes.append(s.view(np.int64))
                    continue
                mixed = mix(s ^ U(0x2545F4914F6CDD1D))
                hi.append(int(mixed.sum().view(np.int64)))
                lo.append(int(mix(s + U(0x632BE59BD9B4E019)).sum().view(np.int64)))
                least.append(int(mixed.min().view(np.int64)))
                if (hi[-1], lo[-1]) in seen:  # a copy in this task: its prefix is there already
                    prefixes.append(s[:0].view(np.int64))
                    continue
                if named[len(n) - 1]:
                    seen.add((hi[-1], lo[-1]))
                rare = np.argsort(order[(s >> U(64 - BITS)).astype(np.int64)], kind="stable")
                prefixes.append(s[rare[: len(s) - needed(len(s), percent) + DEPTH]].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, hi, lo, least)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n", "hi", "lo", "least", "prefix"],
            )

    return docs.mapInArrow(describe, "doc_id long, n long, hi long, lo long, least long, prefix array<long>")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b."""
    if len(a) == len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    left, right = np.concatenate(a), np.concatenate(b)
    rows, cols = np.repeat(np.arange(len(a)), [*map(len, a)]), np.repeat(np.arange(len(b)), [*map(len, b)])
    both = np.intersect1d(left, right)
    i, j = np.searchsorted(both, left), np.searchsorted(both, right)
    i_ok = (i < len(both)) & (both[np.minimum(i, len(both) - 1)] == left) if len(both) else np.zeros(len(left), bool)
    j_ok = (j < len(both)) & (both[np.minimum(j, len(both) - 1)] == right) if len(both) else np.zeros(len(right), bool)
    i, rows, j, cols = i[i_ok], rows[i_ok], j[j_ok], cols[j_ok]
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(both), WIDTH):
        x, y = np.zeros((len(a), WIDTH), np.float32), np.zeros((len(b), WIDTH), np.float32)
        p, q = (i >= low) & (i < low + WIDTH), (j >= low) & (j < low + WIDTH)
        x[rows[p], i[p] - low] = 1
        y[cols[q], j[q] - low] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _qualify(sets: list[np.ndarray], union: np.ndarray, percent: int) -> list[int]:
    """The sets of which the union holds enough tokens for a link to any member of its group."""
    return [k for k, s in enumerate(sets) if np.isin(s, union, assume_unique=True).sum() >= needed(len(s), percent)]


def open_groups(a: tuple[list, list, list], b: tuple[list, list, list] | None, percent: int) -> Iterator[tuple[int, int, int]]:
    """(id, least id linked within here, copies of the sets linked) for members with links.

    a and b: ids, copies and sorted token sets of two groups; without b, of one
    group against itself.
    """
    ids, copies, sets = a
    if b is None:
        x = y = list(range(len(ids)))
        pool = sets
    else:
        union = np.unique(np.concatenate(b[2]))
        x = _qualify(sets, union, percent)
        y = [k + len(ids) for k in _qualify(b[2], np.unique(np.concatenate([sets[k] for k in x])), percent)] if x else []
        ids, copies, pool = ids + b[0], copies + b[1], sets + b[2]
    if not x or not y:
        return
    shared = _shared([pool[k] for k in x], [pool[k] for k in y])
    size = np.array([*map(len, pool)])
    linked = 100 * shared >= percent * (size[x][:, None] + size[y][None, :] - shared)
    if b is None:
        np.fill_diagonal(linked, False)
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
        p, q = find(x[p]), find(y[q])
        if p != q:
            if ids[q] < ids[p]:
                p, q = q, p
            root[q] = p
    weight = np.array(copies)
    links = np.zeros(len(ids), np.int64)
    links[x] += linked @ weight[y]
    if b is not None:
        links[y] += linked.T @ weight[x]
    for k in np.flatnonzero(links).tolist():
        yield ids[k], ids[find(k)], int(links[k])


def _spread(opened: DataFrame, tasks: int) -> DataFrame:
    """``opened`` (x, y, n, ...) with ``task``: bundles laid end to end by their tokens and cut into equal parts, so that no task gets several large ones."""
    sizes = cut(opened.groupBy("x", "y").agg(F.sum(F.col("n") + F.lit(100)).alias("size")))
    total, count = sizes.agg(F.sum("size"), F.count("*")).first()
    along = sizes.withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.lit(bucket_count(count))).cast("int"))
    laid = running_sum(along, [], "bucket", [F.col("x"), F.col("y")], F.col("size"), "before")
    task = F.least(F.floor(F.col("before") / F.lit((total or 1) / tasks)).cast("int"), F.lit(tasks - 1))
    return opened.join(laid.select("x", "y", task.alias("task")), ["x", "y"])


def _verify(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Opens bundles: rows (task, x, y, gid, partners, rep, copies, tokens), of one x and y together.

    A group is opened against each of its partners, itself among them if it has
    several members.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        now, groups, partners = None, {}, {}

        def close() -> Iterator[pa.RecordBatch]:
            for a, others in partners.items():
                for b in others:
                    if b in groups:
                        out.extend(open_groups(groups[a], None if a == b else groups[b], percent))
                    if len(out) >= 10_000:
                        yield _links(out)
                        out.clear()

        for batch in batches:
            values = batch.column("tokens").values.to_numpy()
            ends = batch.column("tokens").offsets.to_numpy()
            names = [batch.column(c).to_pylist() for c in ("x", "y", "gid", "partners", "rep", "copies")]
            for k, (x, y, gid, others, rep, copies) in enumerate(zip(*names, strict=True)):
                if (x, y) != now:
                    yield from close()
                    now, groups, partners = (x, y), {}, {}
                ids, many, sets = groups.setdefault(gid, ([], [], []))
                partners[gid] = others
                if not ids or ids[-1] != rep:
                    ids.append(rep), many.append(copies), sets.append(values[ends[k] : ends[k + 1]].view(U).copy())
        yield from close()
        yield _links(out)

    dealt = rows.repartitionById(tasks, "task").sortWithinPartitions("x", "y", "gid", "rep")
    return dealt.mapInArrow(verify, "rep long, root long, links long")


def _bundles(meet: DataFrame, members: DataFrame) -> DataFrame:
    """Where groups are opened: x, y, gid, partners.

    Groups that meet, over any number of steps, are dealt into blocks of bounded
    size, and every two blocks between which groups meet are a bundle.  A set goes
    to as many bundles as its blocks have, not to each partner.
    """
    parts = connected_components(meet, "a", "b")
    met = meet.join(parts, F.col("a") == F.col("node"), "left").select("a", "b", F.coalesce("component", "a").alias("part"))
    groups = met.select("part", F.col("a").alias("gid")).unionAll(met.select("part", F.col("b").alias("gid"))).distinct()
    sizes = groups.join(members, "gid").groupBy("part").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.least(F.ceil(F.col("sets") / F.lit(BLOCK_SETS)), F.lit(BLOCKS)), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)))
    dealt = met.join(sizes.select("part", blocks.alias("blocks")), "part")
    block = lambda gid: F.pmod(F.xxhash64(gid), F.col("blocks"))
    p, q = block("a"), block("b")
    placed = cut(dealt.select("a", "b", F.col("part").alias("x"), (F.least(p, q) * F.col("blocks") + F.greatest(p, q)).alias("y")))
    partners = placed.groupBy("x", "y", F.col("a").alias("gid")).agg(F.collect_list("b").alias("partners"))
    there = placed.select("x", "y", F.col("a").alias("gid")).unionAll(placed.select("x", "y", F.col("b").alias("gid"))).distinct()
    return there.join(partners, ["x", "y", "gid"], "left").select("x", "y", "gid", F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"))


def _links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "root", "links"])


def _common(tokens: DataFrame, tasks: int) -> DataFrame:
    """(token, times): tokens that fill a twentieth of a task or more, of rows (doc_id, prefix).

    One document in 64 shows them.  Only the way that a token's rows go depends on it,
    not what comes out; at most twenty times ``tasks`` can be found.
    """
    seen = tokens.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(64)) == 0)
    rows = seen.agg(F.sum(F.size("prefix"))).first()[0] or 0
    counted = seen.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    return cut(counted.where(F.col("times") >= max(8.0, rows / (20 * tasks))))


def _met(matrix: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a < b) to open, from rows ``matrix`` (token, gid, n, k) and the ``common`` tokens.

    Sets of n and m tokens that link share t, at least percent / (100 + percent) *
    (n + m), so the r-th token they share, in the global order, has at most n (or
    m) - t + r - 1 before it.  The unions of two groups must share as many tokens,
    early enough, as any two members must; for groups the test takes the least place
    and the sizes that allow most.
    """
    joined = matrix.join(F.broadcast(common), "token", "left")
    first = [F.min("n").alias("low"), F.max("n").alias("high"), F.min("k").alias("k")]
    rare = joined.where("times IS NULL").repartition("token").groupBy("token", "gid").agg(*first).withColumn("groups", F.count("*").over(Window.partitionBy("token")))
    # rows of a common token meet nowhere: they are combined by token and group, and its groups counted by aggregation
    held = joined.where("times IS NOT NULL").groupBy("token", "gid").agg(*first)
    often = held.join(F.broadcast(held.groupBy("token").agg(F.count("*").alias("groups"))), "token")
    shared = cut(rare.unionByName(often).where("groups > 1"))
    blocks = F.ceil(F.col("groups") / F.lit(LISTED)).cast("int")
    own = F.pmod(F.xxhash64("gid"), blocks).cast("int")
    dealt = shared.select("token", F.struct("gid", "low", "high", "k").alias("x"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = lambda c: F.sort_array(F.collect_list(F.when(F.col("own") == F.col(c), F.col("x"))))
    lists = dealt.select("token", i.alias("i"), j.alias("j"), "own", "x").groupBy("token", "i", "j").agg(side("i").alias("p"), side("j").alias("q"))
    first = lists.select("i", "j", "p", "q", F.posexplode("p").alias("at", "x"))
    late = f"{{0}}.k * {100 + percent} - 100 * {{0}}.high + {percent} * {{1}}.low"  # (100 + percent) * (r - 1) at most for the r-th
    last = (DEPTH - 1) * (100 + percent)
    others = f"filter(CASE WHEN i = j THEN slice(p, at + 2, size(p)) ELSE q END, y -> {late.format('x', 'y')} <= {last} AND {late.format('y', 'x')} <= {last})"
    pairs = first.select("x", F.explode(F.expr(others)).alias("y"))
    enough = F.least(F.lit(DEPTH), F.expr(f"CAST(ceil({percent} * greatest(x.low, y.low) / 100) AS INT)"))
    judged = pairs.select(
        F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b"), enough.alias("enough"),
        F.expr(f"{late.format('x', 'y')} <= 0 AND {late.format('y', 'x')} <= 0").alias("early"),
    )
    bound = judged.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("enough").alias("enough"), F.bool_or("early").alias("early"))
    return bound.where("early AND shared >= enough").select("a", "b")


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Words are runs of anything but ASCII white space, with A-Z as a-z; a set
    holds the distinct shingles of ``size`` words.  Rows link when 100 times the
    shared tokens reach ``percent`` times those of the union; ``n_links`` counts
    the other rows that a row links with directly, and ``component_id`` is the
    smallest id reachable by links.  All links count: nothing is sampled or capped.

    Defined cases: a text without words, or null, links with nothing and is its
    own component; rows with a null id are left out of every comparison and are
    their own component (null); rows that repeat an id are rows of their own,
    each in the component of its own text.  Only the two named columns are read, whatever
    others are called; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut(_sets(docs, size, percent))
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = sets.where(usable).groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("least").alias("least"), F.first("n").alias("n"))
    classes = cut(classes)
    blocks = classes.groupBy("least").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("blocks")).where("blocks > 1")
    blocks = cut(blocks.withColumnRenamed("least", "__least"))
    if blocks.count() < 100_000:
        blocks = F.broadcast(blocks)
    # equal sets are in the same group, whichever row they come from
    gid = F.xxhash64("least", F.pmod(F.xxhash64("hi"), F.coalesce("blocks", F.lit(1))))
    members = cut(classes.join(blocks, F.col("least") == F.col("__least"), "left").select("hi", "lo", "rep", "copies", "n", gid.alias("gid")))
    tokens_of = sets.where(usable).join(blocks, F.col("least") == F.col("__least"), "left")
    matrix = tokens_of.select(gid.alias("gid"), "n", F.posexplode("prefix").alias("k", "token"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = _met(matrix, _common(sets.where(usable), tasks), percent)
    alone = members.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    meet = cut(pairs.unionAll(alone))
    opened = cut(members.join(_bundles(meet, members), "gid").select("x", "y", "gid", "partners", "rep", "copies", "hi", "n"))
    wanted = spark.sparkContext.broadcast(_id_filter(opened))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            ids = mix(batch.column("doc_id").fill_null(0).to_numpy().view(U))
            maybe = np.ones(len(ids), bool)
            for at in _slots(ids):
                maybe &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(maybe))
            for low in range(0, batch.num_rows, 500):  # a few at a time: sets take more room than texts
                part = batch.slice(low, 500)
                found = list(shingle_sets(part.column("text"), size))
                hi = [int(mix(s ^ U(0x2545F4914F6CDD1D)).sum().view(np.int64)) for s in found]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hi, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["rep", "hi", "tokens"])

    full = docs.mapInArrow(tokens, "rep long, hi long, tokens array<long>")
    # the opened sets grow with the corpus: the same join at every size, not a broadcast that stops fitting
    rows = full.join(_spread(opened, tasks).hint("merge"), ["rep", "hi"]).select("task", "x", "y", "gid", "partners", "rep", "copies", "tokens")
    found = cut(_verify(rows, percent, tasks))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    named = members.join(linked, "rep", "left").join(parts, "rep", "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    light = sets.select("doc_id", "n", F.when(usable, F.col("hi")).alias("hi"), F.when(usable, F.col("lo")).alias("lo"))
    return light.join(named, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def _of_unique(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """The rows of ``docs``, whose ids do not repeat, that have the smallest id of their component, or a null id."""
    parts = jaccard_join(docs, size, percent, key, text)
    gone = parts.where("component_id <> doc_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: one row stays of each, of its smallest id.

    Rows that repeat an id and have different texts are different documents: each
    pair of id and text gets its own number, in order of the ids; of rows equal in
    both one stays.  All columns stay; rows with a null id stay.
    """
    ids = docs.where(F.col(key).isNotNull()).select(key)
    if ids.count() == ids.distinct().count():
        return _of_unique(docs, size, percent, key, text)
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    rows = docs.where(F.col(key).isNotNull()).withColumn("__digest", digest).dropDuplicates([key, "__digest"])
    # a sort's partitions are in order, and so are the numbers
    numbers = cut(rows.select(key, "__digest").orderBy(key, "__digest").withColumn("__row", F.monotonically_increasing_id()))
    numbered = cut(rows.join(numbers, [key, "__digest"]))
    return _of_unique(numbered, size, percent, "__row", text).select(*docs.columns).unionAll(docs.where(F.col(key).isNull()))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents joined on 4-word shingles at a Jaccard similarity of 0.85 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM shared WHERE 100 * k >= 85 * (nx + ny - k)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(y, s.doc_id)) AS component_id, coalesce(d.n, 0)::BIGINT AS n_links
FROM sets s LEFT JOIN least_of l ON l.x = s.doc_id LEFT JOIN degree d ON d.x = s.doc_id
"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {"op9_jaccard_join": ORACLE_SQL}
