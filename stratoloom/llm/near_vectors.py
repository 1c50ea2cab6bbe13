"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Only codes of one byte a dimension travel to the tiles, with each vector's scale
and quantisation error.  The products and the errors prove most pairs to link or
not to; vectors of pairs that stay open go in full precision to the tiles that
need them, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.components import connected_components
from .tables import small_batches, table

#: Vectors of a block: a tile compares two blocks, so at most twice as many meet in a task.
BLOCK = 2048
#: Rows of a tile whose products are held at once.
STRIPE = 512
#: Beyond any rounding of the double products of vectors of length 1.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and each vector's quantisation error (its length)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Stripes of rows of a, with which pairs with rows of b surely link and which may.

    a and b are what ``quantise`` gives.  With codes p, q, scales s, t and errors
    d, e of unit vectors u, v the cosine u.v lies within d + (1 + d) * e of s * t *
    p.q.  The integer product p.q is exact in single precision (below 2^24 for up
    to 1040 dimensions; beyond, in double).
    """
    (p, s, d), (q, t, e) = a, b
    kind = np.float32 if p.shape[1] <= 1040 else np.float64
    q = q.astype(kind).T
    for low in range(0, len(p), STRIPE):
        part = slice(low, min(low + STRIPE, len(p)))
        about = (p[part].astype(kind) @ q).astype(np.float64) * s[part, None] * t[None, :]
        bound = d[part, None] + (1 + d[part, None]) * e[None, :] + SLACK
        sure = about - bound >= threshold
        yield part, sure, (about + bound >= threshold) & ~sure


def tile_roots(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column with a link, the least id it reaches inside the tile."""
    root_a, root_b = ids_a.copy(), ids_b.copy()
    todo_a, todo_b = linked.any(axis=1), linked.any(axis=0)
    while todo_a.any():
        in_a, in_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        edge = np.zeros(len(ids_a), bool)
        edge[np.argmax(todo_a)] = True
        while edge.any():
            in_a |= edge
            more = linked[edge].any(axis=0) & ~in_b
            in_b |= more
            edge = linked[:, more].any(axis=1) & ~in_a
        least = min(ids_a[in_a].min(), ids_b[in_b].min())
        root_a[in_a], root_b[in_b] = least, least
        todo_a &= ~in_a
        todo_b &= ~in_b
    return root_a, root_b


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by their largest number, else squares of extreme numbers overflow or vanish, and their lengths then."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v, np.sqrt((v * v).sum(axis=1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as rows."""
    return np.array(column.to_pylist(), np.float64)


def _encode(usable: DataFrame) -> DataFrame:
    """``usable`` (row, label, dim, v) with the codes, scale and error of each vector instead of the vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scales, errors = [b""] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v, n = _unit(_matrix(batch.column("v").take(pa.array(at))))
                p, scales[at], errors[at] = quantise(v / n[:, None])
                for k, row in zip(at.tolist(), p, strict=True):
                    codes[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "label", "dim")] + [pa.array(codes, pa.binary()), pa.array(scales), pa.array(errors)], ["row", "label", "dim", "codes", "scale", "error"])

    return usable.mapInArrow(encode, "row long, label string, dim int, codes binary, scale double, error double")


TILE = ("label", "dim", "i", "j")


def _split(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rows of a tile's two blocks, and whether they are one block."""
    i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    own = tile.column("own").to_numpy()
    a = np.flatnonzero(own == i)
    return a, (a if i == j else np.flatnonzero(own == j)), i == j


def _said(ids: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their roots in the tile and their links; of one block each row once."""
    root_a, root_b = tile_roots(linked, ids[a], ids[b])
    if same:
        return ids[a], root_a, linked.sum(axis=1)
    return np.concatenate([ids[a], ids[b]]), np.concatenate([root_a, root_b]), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    All pairs of vectors with equal, non-null labels (and equal lengths) are
    compared; those of cosine ``threshold`` or more in double precision link.
    Blocks of about ``block`` vectors meet pair by pair in tiles, one task each:
    a tile returns counts of links and local roots per vector, never pairs, so a
    hot label is spread over tiles and large groups of copies cost no rows.
    Tiles get codes; where pairs stay open, a second pass over the tile gets the
    vectors of those pairs in double precision and decides these pairs alone.

    Vectors that are null, empty, all zero, or hold null or non-finite numbers,
    or have no label or id, link with nothing and are kept.  Rows that repeat an
    id are vectors of their own (each in its own component, whose id is the least
    vec_id in it).  With ``label`` None all vectors are compared.  Only the named
    columns are read; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    group = F.col(label).cast("string") if label else F.lit("")
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    # the checkpoint keeps the rows' numbers as they are
    rows = cut(vectors.select(F.col(key).cast("long").alias("vec_id"), group.alias("label"), numbers.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    usable = rows.where(sound).select("row", "label", F.size("v").alias("dim"), "v")
    blocks = usable.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks) if blocks.count() < 10_000 else blocks
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = (
        _encode(usable).join(blocks, ["label", "dim"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "codes", "scale", "error")
    )

    def coded(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = tile.column("dim")[0].as_py()
        codes = np.frombuffer(b"".join(tile.column("codes").to_pylist()), np.int8).reshape(-1, dim)
        return codes, tile.column("scale").to_numpy(), tile.column("error").to_numpy()

    def prove(tile: pa.Table) -> pa.Table:
        a, b, same = _split(tile)
        quantised = coded(tile)
        linked, open_a, open_b = np.zeros((len(a), len(b)), bool), np.zeros(len(a), bool), np.zeros(len(b), bool)
        for part, sure, maybe in bounds(tuple(x[a] for x in quantised), tuple(x[b] for x in quantised), threshold):
            if same:
                here = np.arange(part.start, part.stop)
                sure[here - part.start, here] = maybe[here - part.start, here] = False
            linked[part] = sure
            open_a[part] = maybe.any(axis=1)
            open_b |= maybe.any(axis=0)
        ids = tile.column("row").to_numpy()
        row, root, links = _said(ids, a, b, linked, same)
        unsettled = open_a if same else np.concatenate([open_a, open_b])
        kept = (links > 0) | unsettled
        out = {c: tile.column(c)[:1].take(pa.array(np.zeros(int(kept.sum()), np.int64))) for c in TILE}
        owns = tile.column("own").to_numpy()
        return pa.table(out | {"own": owns[a if same else np.concatenate([a, b])][kept], "row": row[kept], "root": root[kept], "links": links[kept], "unsettled": unsettled[kept]})

    def settle(tile: pa.Table) -> pa.Table:
        a, b, same = _split(tile)
        v, n = _unit(_matrix(tile.column("v")))
        quantised = quantise(v / n[:, None])  # as in the first pass, so the same pairs are open
        linked = np.zeros((len(a), len(b)), bool)
        for part, _, maybe in bounds(tuple(x[a] for x in quantised), tuple(x[b] for x in quantised), threshold):
            i, j = np.nonzero(maybe)
            i += part.start
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                linked[x, y] = (np.einsum("ij,ij->i", v[a[x]], v[b[y]]) / (n[a[x]] * n[b[y]]) >= threshold) & ((x != y) | (not same))
        row, root, links = _said(tile.column("row").to_numpy(), a, b, linked, same)
        return pa.table({"row": row[links > 0], "root": root[links > 0], "links": links[links > 0]})

    proven = cut(dealt.groupBy(*TILE).applyInArrow(prove, "label string, dim int, i int, j int, own int, row long, root long, links long, unsettled boolean"))
    left = proven.where("unsettled").select(*TILE, "own", "row").join(usable.select("row", "v"), "row")
    settled = left.groupBy(*TILE).applyInArrow(settle, "row long, root long, links long")
    found = cut(proven.where("links > 0").select("row", "root", "links").unionAll(settled))
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    parts = connected_components(found, "row", "root").select(F.col("node").alias("row"), "component")
    named = rows.select("row", "vec_id").join(links, "row", "left").join(parts, "row", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least")).withColumnRenamed("component", "__component")
    component = F.coalesce("least", "vec_id")
    return named.join(least, F.col("component") == F.col("__component"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links and components at a cosine of 0.93 or more under equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM usable),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, least(vec_id, coalesce(y, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN least_of l ON l.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
"""

QUERIES = {"op2_near_vectors": op2_near_vectors}
ORACLES = {"op2_near_vectors": ORACLE_SQL}
