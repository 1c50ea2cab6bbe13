"""Queries of neighbour joins, graph algebra, reduction and clustering, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, geometry_metrics, graph, neighbours, prep, reduce, spectral
from ..sources import roles
from ..sources.roles import with_roles
from .preparation import cells_of, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a query and its twin."""
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def nearest(name: str, left: str, right: str, k: int | str, dist: str = "list_distance(a.v, b.v)", where: str = "true") -> str:
    """A common table expression of the k nearest."""
    return f""", {name} AS MATERIALIZED (SELECT src, dst, dist, place FROM (SELECT a.cell AS src, b.cell AS dst, {dist} AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY {dist}, b.cell) AS place FROM {left} a, {right} b WHERE {where}) WHERE place <= {k})"""


def unit(name: str, of: str) -> str:
    """A common table expression of vectors at unit length."""
    return f", {name} AS MATERIALIZED (SELECT * REPLACE (list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v) FROM {of})"


COSINE = "1 - list_dot_product(a.v, b.v)"


def emb(s, d):
    """All points."""
    return roles.embeddings(s, d)


def m1(s, d):
    """The points' first modality."""
    return roles.modality(emb(s, d), 1)


def m2(s, d):
    """The points' second modality."""
    return roles.modality(emb(s, d), 2)


def knn20(s, d):
    """The evaluation graph: 20 nearest, each point among its own."""
    e = emb(s, d)
    return neighbours.knn(e, e, 20)


def coords(s, d):
    """The points' places, with their batch."""
    e = emb(s, d)
    return roles.coordinates(e).join(e.select("cell", F.col("batch").alias("grp")), "cell")


KNN20 = nearest("g", "emb", "emb", 20)
query("j1_knn", with_roles("emb", body=KNN20 + " SELECT src, dst, round(dist, 6) AS dist, place::INT AS place FROM g"))(lambda s, d: rounded(knn20(s, d), "dist"))
query("j2_spatial_knn", with_roles("coords", body=nearest("g", "coords", "coords", 3, where="a.cell <> b.cell") + " SELECT src, dst, place::INT AS place FROM g"))(
    lambda s, d: neighbours.knn(coords(s, d), coords(s, d), 3, itself=False).drop("dist")
)
query("j4_correlation_knn", with_roles("emb", body=", c AS (SELECT cell, list_transform(v, lambda x: x - list_avg(v)) AS v FROM emb)" + unit("u", "c") + nearest("g", "u", "u", 20, COSINE, "a.cell <> b.cell") + " SELECT src, dst, round(dist, 6) AS dist FROM g"))(
    lambda s, d: rounded(neighbours.knn(emb(s, d), emb(s, d), 20, "correlation", itself=False).drop("place"), "dist")
)
RADIUS = """, r AS (SELECT a.cell AS src, b.cell AS dst, list_distance(a.v, b.v) AS dist FROM coords a, coords b WHERE a.cell <> b.cell AND list_distance(a.v, b.v) < 0.02),
k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS p FROM r) WHERE p <= 50 UNION ALL SELECT cell, cell FROM coords)"""
query("j5_radius_graph", with_roles("coords", body=RADIUS + " SELECT src, dst FROM k"))(lambda s, d: neighbours.within_radius(coords(s, d).select("cell", "x", "y"), 0.02, 50).select("src", "dst"))
B0, B1 = ", b0 AS (SELECT * FROM emb WHERE batch = 0)", ", b1 AS (SELECT * FROM emb WHERE batch <> 0)"
query("j7_cross_knn", with_roles("emb", body=B0 + B1 + nearest("g", "b0", "b1", 10) + " SELECT src, dst, place::INT AS place FROM g"))(
    lambda s, d: neighbours.knn(emb(s, d).where("batch = 0"), emb(s, d).where("batch <> 0"), 10).drop("dist")
)
query("j8_approximate_knn", None)(lambda s, d: neighbours.approximate_knn(emb(s, d), emb(s, d), 10, 1.2, 0.6))
query("j6_knn_distances", with_roles("emb", body=B0 + B1 + nearest("g", "b0", "b1", 10) + " SELECT src, dst, round(dist, 6) AS dist FROM g"))(
    lambda s, d: rounded(neighbours.knn(emb(s, d).where("batch = 0"), emb(s, d).where("batch <> 0"), 10).drop("place"), "dist")
)
query("j10_approximate_unit_knn", None)(
    lambda s, d: neighbours.approximate_knn(*(m1(s, d).where(w).select("cell", graph.unit_length(F.col("v")).alias("v")) for w in ("batch = 0", "batch <> 0")), 10, 1.2, 0.6)
)
query("j9_manhattan_knn", with_roles("emb", body=B0 + B1 + unit("u0", "b0") + unit("u1", "b1") + nearest("g", "u0", "u1", 10, "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))") + " SELECT src, dst, round(dist, 6) AS dist FROM g"))(
    lambda s, d: rounded(neighbours.knn(emb(s, d).where("batch = 0"), emb(s, d).where("batch <> 0"), 10, "unit_manhattan").drop("place"), "dist")
)
MUTUAL = unit("u", "emb") + "".join(nearest(f"g{p}{q}", f"(SELECT * FROM u WHERE batch = {p})", f"(SELECT * FROM u WHERE batch = {q})", 5) for p in range(3) for q in range(3) if p != q) + ", mm AS (" + " UNION ALL ".join(
    f"SELECT f.src AS a, f.dst AS b, {p} AS batch_a, {q} AS batch_b FROM g{p}{q} f JOIN g{q}{p} r ON f.src = r.dst AND f.dst = r.src" for p in range(3) for q in range(p + 1, 3)) + ")"
BATCHES = neighbours.bridge_pairs([0, 1, 2], [])
query("j12_mutual_neighbours", with_roles("emb", body=MUTUAL + " SELECT a, b, batch_a, batch_b FROM mm"))(lambda s, d: neighbours.mutual_across(emb(s, d), BATCHES, 5))
query("j13_shared_neighbours", with_roles("emb", body=KNN20 + ", m AS MATERIALIZED (SELECT x.src, x.dst FROM g x JOIN g y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst) SELECT m.src, m.dst, count(*) AS w FROM m JOIN g a ON a.src = m.src JOIN g b ON b.src = m.dst AND b.dst = a.dst GROUP BY ALL"))(
    lambda s, d: neighbours.shared_neighbours(knn20(s, d))
)
query("j14_jaccard_neighbours", with_roles("emb", body=KNN20 + ", s AS (SELECT a.src, b.src AS dst, count(*) AS w FROM g a JOIN g b ON a.dst = b.dst GROUP BY ALL) SELECT src, dst, round(w / (40.0::DOUBLE - w), 6) AS w FROM s WHERE w / (40.0::DOUBLE - w) >= 1 / 15.0::DOUBLE"))(
    lambda s, d: rounded(neighbours.jaccard_neighbours(knn20(s, d), 20), "w")
)
MATCHED = """, j AS (SELECT src, dst, count(*) AS n FROM (SELECT p.src, q.src AS dst FROM xy p JOIN yy q ON p.dst = q.dst UNION ALL SELECT p.src, q.src FROM xx p JOIN yx q ON p.dst = q.dst) GROUP BY ALL),
m AS (SELECT src, dst, (n / ({0}.0::DOUBLE - n)) / sum(n / ({0}.0::DOUBLE - n)) OVER (PARTITION BY src) AS score FROM j)"""
MATCH = unit("x", "m1") + unit("y", "m2") + "".join(nearest(f"{a}{b}", a, b, 5) for a, b in ("xy", "yy", "yx", "xx")) + MATCHED.format(20)
query("j15_matching", with_roles("m1", "m2", body=MATCH + " SELECT src, dst, round(score, 6) AS score FROM m"))(lambda s, d: rounded(neighbours.matching(m1(s, d), m2(s, d), 5), "score"))
query("e16_matching_score", with_roles("m1", "m2", body=MATCH + " SELECT round(avg(coalesce(score, 0)), 6) AS matching_score FROM m1 LEFT JOIN m ON m.src = m1.cell AND m.dst = m1.cell"))(
    lambda s, d: rounded(geometry_metrics.matching_score(m1(s, d), m2(s, d), 5), "matching_score")
)
query("e16_matching_score_by_batch", with_roles("m1", "m2", body=unit("x", "m1") + unit("y", "m2") + "".join(nearest(f"{a}{b}", a, b, 1, where="a.batch = b.batch") for a, b in ("xy", "yy", "yx", "xx")) + MATCHED.format(4) + " SELECT round(avg(coalesce(score, 0)), 6) AS matching_score FROM m1 LEFT JOIN m ON m.src = m1.cell AND m.dst = m1.cell"))(
    lambda s, d: rounded(geometry_metrics.matching_score(*(m(s, d).withColumn("grp", F.col("batch")) for m in (m1, m2)), 1, groups=True), "matching_score")
)
query("j26_nearest_place", with_roles("coords", body=nearest("g", "(SELECT coords.* FROM coords JOIN emb USING (cell) WHERE batch <> 0)", "(SELECT coords.* FROM coords JOIN emb USING (cell) WHERE batch = 0)", 1) + " SELECT src, dst FROM g"))(
    lambda s, d: neighbours.nth_neighbour(neighbours.knn(coords(s, d).where("grp <> 0"), coords(s, d).where("grp = 0"), 1)).select("src", "dst")
)
GRAPH3D = unit("u1", "m1") + unit("u2", "m2") + """, c AS (SELECT coords.*, batch FROM coords JOIN emb USING (cell))""" + nearest("s", "c", "c", 4, where="a.cell <> b.cell AND a.batch = b.batch") + nearest("f1", "u1", "u1", 3, COSINE, "a.batch <> b.batch") + nearest("f2", "u2", "u2", 3, COSINE, "a.batch <> b.batch")
query("j28_spatial_feature_graph", with_roles("m1", "m2", "coords", body=GRAPH3D + " SELECT src, dst, 1 AS sign FROM s UNION ALL SELECT src, dst, -1 FROM (SELECT src, dst FROM f1 UNION SELECT src, dst FROM f2)"))(
    lambda s, d: neighbours.spatial_and_feature_graph(coords(s, d), [m(s, d).withColumnRenamed("batch", "grp") for m in (m1, m2)], 4, 3)
)
MNN = MUTUAL + nearest("i", "coords", "coords", 3, where="a.cell <> b.cell") + """, e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM i UNION ALL SELECT cell, cell, 1.0 FROM coords UNION ALL SELECT a, b, 0.8 FROM mm UNION ALL SELECT b, a, 0.8 FROM mm) GROUP BY ALL)"""


def counted(s, d):
    """The points that have counts."""
    return emb(s, d).join(roles.counts(s, d).select("cell").distinct(), "cell", "left_semi")


def merged_graph(s, d):
    """Spatial neighbours with loops, joined by mutual neighbours of every two batches."""
    c = coords(s, d)
    intra = neighbours.knn(c, c, 3, itself=False).select("src", "dst").unionAll(c.select(F.col("cell").alias("src"), F.col("cell").alias("dst")))
    return graph.merged(intra, neighbours.mutual_across(emb(s, d), BATCHES, 5), 0.8)


query("j29_merged_graph", with_roles("coords", body=MNN + " SELECT src, dst, round(w, 6) AS w FROM e"))(lambda s, d: rounded(merged_graph(s, d), "w"))
query("j25_edge_classes", with_roles("coords", body=MNN + " SELECT src, dst, CASE WHEN p.batch = q.batch THEN p.batch ELSE -1 END AS etype FROM e JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst"))(
    lambda s, d: graph.edge_classes(merged_graph(s, d), emb(s, d).select("cell", "batch")).select("src", "dst", "etype")
)
query("j31_label_vote", with_roles("emb", body=nearest("g", "(SELECT * FROM emb WHERE batch <> 0)", "(SELECT * FROM emb WHERE batch = 0)", 5) + ", v AS (SELECT src, gt, count(*) AS n FROM g JOIN emb ON dst = cell GROUP BY ALL) SELECT src AS cell, arg_max(gt, n * 1000 - gt) AS label FROM v GROUP BY src"))(
    lambda s, d: neighbours.vote(neighbours.knn(emb(s, d).where("batch <> 0"), emb(s, d).where("batch = 0"), 5), emb(s, d).select("cell", F.col("gt").alias("label")))
)
query("j33_union_edges", with_roles("m1", "m2", body=nearest("a1", "m1", "m1", 20) + nearest("a2", "m2", "m2", 20) + " SELECT src, dst FROM a1 UNION SELECT src, dst FROM a2"))(
    lambda s, d: neighbours.knn(m1(s, d), m1(s, d), 20).select("src", "dst").unionAll(neighbours.knn(m2(s, d), m2(s, d), 20).select("src", "dst")).distinct()
)
query("w2_strongest", with_roles("emb", body=KNN20 + ", s AS (SELECT a.src, b.src AS dst, count(*) AS w FROM g a JOIN g b ON a.dst = b.dst GROUP BY ALL) SELECT src, dst, w, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM s) WHERE place <= 10"))(
    lambda s, d: neighbours.strongest(neighbours.shared_neighbours(knn20(s, d), mutual_only=False), 10)
)
SYM = nearest("g", "coords", "coords", 3, where="a.cell <> b.cell") + ", sym AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
NORM = SYM + """, l AS (SELECT src, dst, 1.0::DOUBLE AS w FROM sym UNION ALL SELECT cell, cell, 1.0 FROM coords), dg AS (SELECT src, sum(w) AS d FROM l GROUP BY src),
nm AS (SELECT l.src, l.dst, w / sqrt(p.d * q.d) AS w FROM l JOIN dg p ON p.src = l.src JOIN dg q ON q.src = l.dst)"""


def both_ways(s, d):
    """The evaluation graph in both directions, all edges alike."""
    return graph.symmetric(knn20(s, d)).withColumn("w", F.lit(1.0))


def spatial(s, d):
    """Spatial neighbours in both directions, each edge once."""
    c = coords(s, d)
    return graph.symmetric(neighbours.knn(c, c, 3, itself=False))


def gcn(s, d):
    """The spatial graph with loops, normalised."""
    return graph.normalised(spatial(s, d).withColumn("w", F.lit(1.0)), coords(s, d))


query("g1_symmetric", with_roles("coords", body=SYM + " SELECT src, dst FROM sym"))(spatial)
query("g2_normalised", with_roles("coords", body=NORM + " SELECT src, dst, round(w, 6) AS w FROM nm"))(lambda s, d: rounded(gcn(s, d), "w"))
query("g4_propagate", with_roles("coords", body=NORM + """, x0 AS (SELECT cell, v[1] AS a, v[2] AS b FROM emb), x1 AS (SELECT dst AS cell, sum(w * a) AS a, sum(w * b) AS b FROM nm JOIN x0 ON x0.cell = src GROUP BY dst),
x2 AS (SELECT dst AS cell, sum(w * a) AS a, sum(w * b) AS b FROM nm JOIN x1 ON x1.cell = src GROUP BY dst) SELECT cell, round(x0.a, 6) AS v0, round(x0.b, 6) AS v1, round(x1.a, 6) AS v2, round(x1.b, 6) AS v3, round(x2.a, 6) AS v4, round(x2.b, 6) AS v5 FROM x0 JOIN x1 USING (cell) JOIN x2 USING (cell)"""))(
    lambda s, d: rounded(graph.propagate(gcn(s, d), coords(s, d), 2, hops=2).select("cell", *[F.col("v")[i].alias(f"v{i}") for i in range(6)]), *[f"v{i}" for i in range(6)])
)
query("g6_component_share", with_roles("emb", body=nearest("g", "emb", "emb", 14, where="a.cell <> b.cell") + """, e AS (SELECT src, dst, p.gt FROM g JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst WHERE p.gt = q.gt), l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(x, y) AS (SELECT cell, cell FROM emb UNION SELECT r.x, l.dst FROM r JOIN l ON r.y = l.src), c AS (SELECT x, min(y) AS c FROM r GROUP BY x), z AS (SELECT gt, c, count(*) AS n FROM c JOIN emb ON cell = x GROUP BY ALL)
SELECT gt AS label, sum(n)::BIGINT AS n, max(n) AS largest, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM z GROUP BY gt""", recursive=True))(
    lambda s, d: rounded(graph.component_share(neighbours.knn(emb(s, d), emb(s, d), 14, itself=False), emb(s, d).select("cell", F.col("gt").alias("label"))), "share")
)
MEASURED = "(SELECT DISTINCT l_returnflag AS modality, l_linenumber AS batch FROM lineitem WHERE l_linenumber < 4 OR l_returnflag = 'A')"


def measured(s, d):
    """(modality, batch) of a mosaic with holes."""
    return roles.table(s, d, "lineitem").where("l_linenumber < 4 OR l_returnflag = 'A'").select(F.col("l_returnflag").alias("modality"), F.col("l_linenumber").alias("batch")).distinct()


query("g7_modality_components", f"SELECT batch::BIGINT AS batch, (SELECT min(batch) FROM {MEASURED})::BIGINT AS component FROM {MEASURED} GROUP BY batch")(lambda s, d: graph.modality_components(measured(s, d)))
query("g8_bridge_batches", f"SELECT batch, count(*) AS modalities, count(*) >= 2 AS bridge FROM {MEASURED} GROUP BY batch")(lambda s, d: graph.bridge_batches(measured(s, d)))
query("g15_smoothed_counts", with_roles("counts", "emb", body=", em AS (SELECT * FROM emb WHERE cell IN (SELECT cell FROM counts))" + nearest("g", "em", "em", 10) + " SELECT src AS cell, feature, round(sum(x) / 10, 6) AS x FROM g JOIN counts ON counts.cell = dst GROUP BY ALL"))(
    lambda s, d: rounded(graph.smoothed_counts(neighbours.knn(counted(s, d), counted(s, d), 10), roles.counts(s, d), 10), "x")
)
query("g16_impute", with_roles("adt", "m1", "m2", body=unit("u1", "m1") + unit("u2", "m2") + "".join(nearest(f"g{i}", f"(SELECT * FROM u{i} WHERE cell NOT IN (SELECT cell FROM adt))", f"(SELECT * FROM u{i} WHERE cell IN (SELECT cell FROM adt))", 10, "list_sum(list_transform(range(1, 33), lambda i: abs(a.v[i] - b.v[i])))") for i in (1, 2)) + """
SELECT cell, feature, round(sum(x) / 2, 6) AS x FROM (SELECT src AS cell, feature, sum(x) / 10 AS x FROM g1 JOIN adt ON adt.cell = dst GROUP BY ALL UNION ALL SELECT src, feature, sum(x) / 10 FROM g2 JOIN adt ON adt.cell = dst GROUP BY ALL) GROUP BY ALL"""))(
    lambda s, d: rounded(impute_two(s, d), "x")
)


def impute_two(s, d):
    """Both modalities of the target cells against those of the measured ones."""
    out, known = None, roles.adt(s, d).select("cell").distinct()
    for m in (m1(s, d), m2(s, d)):
        part = graph.impute(m.join(known, "cell", "left_anti"), [(m.join(known, "cell", "left_semi"), roles.adt(s, d))], 10)
        out = part if out is None else out.unionAll(part)
    return out.groupBy("cell", "feature").agg((F.sum("x") / 2).alias("x"))


query("g17_merged_vectors", with_roles("m1", "m2", body=" SELECT m1.cell, (k - 1)::INT AS d, round((m1.v[k] + m2.v[k]) / 2, 6) AS x FROM m1 JOIN m2 USING (cell), range(1, 33) r(k)"))(
    lambda s, d: rounded(graph.merged_vectors([m1(s, d), m2(s, d)], 32).select("cell", F.posexplode("v").alias("d", "x")), "x")
)
query("g18_attention", with_roles("coords", body=SYM + """, s AS (SELECT sym.src, sym.dst, exp(CASE WHEN p.x + q.y >= 0 THEN p.x + q.y ELSE 0.2 * (p.x + q.y) END) AS e FROM sym JOIN coords p ON p.cell = sym.src JOIN coords q ON q.cell = sym.dst)
SELECT src, dst, round(e / sum(e) OVER (PARTITION BY dst), 6) AS w FROM s"""))(
    lambda s, d: rounded(graph.attention_edges(spatial(s, d), coords(s, d).select("cell", F.col("x").alias("s_src"), F.col("y").alias("s_dst"))), "w")
)
query("g19_learned_graph", with_roles("coords", body=nearest("g", "coords", "coords", 3, where="a.cell <> b.cell") + """, w0 AS (SELECT src, dst, (CASE WHEN (src + dst) % 3 = 0 THEN -1 ELSE 1 END) * (place + 1.0::DOUBLE) AS w FROM g), h AS (SELECT src, dst, greatest(sum(w), 0) AS w FROM (SELECT src, dst, w / 2 AS w FROM w0 UNION ALL SELECT dst, src, w / 2 FROM w0) GROUP BY ALL HAVING greatest(sum(w), 0) > 0),
l AS (SELECT * FROM h UNION ALL SELECT cell, cell, 1.0 FROM coords), dg AS (SELECT src, sum(w) AS d FROM l GROUP BY src) SELECT l.src, l.dst, round(w / sqrt(p.d * q.d), 6) AS w FROM l JOIN dg p ON p.src = l.src JOIN dg q ON q.src = l.dst"""))(
    lambda s, d: rounded(graph.learned_graph(neighbours.knn(coords(s, d), coords(s, d), 3, itself=False).select("src", "dst", (F.when((F.col("src") + F.col("dst")) % 3 == 0, -1.0).otherwise(1.0) * (F.col("place") + 1)).alias("w")), coords(s, d)), "w")
)
query("g20_fused", with_roles("m1", "m2", body=", p AS (SELECT m1.cell, exp(m1.v[1]) / (exp(m1.v[1]) + exp(m2.v[1])) AS a, m1.v AS x, m2.v AS y FROM m1 JOIN m2 USING (cell)) SELECT cell, (k - 1)::INT AS d, round(a * x[k] + (1 - a) * y[k], 6) AS x FROM p, range(1, 33) r(k)"))(
    lambda s, d: rounded(graph.fused([m1(s, d), m2(s, d)], m1(s, d).select("cell", F.col("v")[0].alias("a")).join(m2(s, d).select("cell", F.col("v")[0].alias("b")), "cell").select("cell", F.array("a", "b").alias("s"))).select("cell", F.posexplode("v").alias("d", "x")), "x")
)
for _kind, _sql in (("eq", "exp(-power(list_distance(a.v, b.v), 2))"), ("cauchy", "1 / (1 + power(list_distance(a.v, b.v), 2))"), ("laplacian", "exp(-(abs(a.v[1] - b.v[1]) + abs(a.v[2] - b.v[2])))"), ("matern12", "exp(-list_distance(a.v, b.v))"), ("dot", "list_dot_product(a.v, b.v)"), ("matern52", "(1 + sqrt(5.0::DOUBLE) * list_distance(a.v, b.v) + 5.0::DOUBLE / 3 * power(list_distance(a.v, b.v), 2)) * exp(-sqrt(5.0::DOUBLE) * list_distance(a.v, b.v))"), ("matern32", "(1 + sqrt(3.0::DOUBLE) * list_distance(a.v, b.v)) * exp(-sqrt(3.0::DOUBLE) * list_distance(a.v, b.v))")):
    query(f"n22_kernel_{_kind}", with_roles("coords", body=f" SELECT a.cell, b.cell AS point, round({_sql}, 6) AS k FROM coords a, (SELECT x * 4 + y AS cell, [x / 3.0::DOUBLE, y / 3.0::DOUBLE] AS v FROM range(4) p(x), range(4) q(y)) b"))(
        lambda s, d, kind=_kind: rounded(coords(s, d).select("cell", "v").crossJoin(F.broadcast(prep.inducing_points(s, 4, 1.0).select(F.round(F.col("x") * 12 + F.col("y") * 3).cast("long").alias("point"), F.array("x", "y").alias("p")))).select("cell", "point", graph.kernel(kind, F.col("v"), F.col("p")).alias("k")), "k")
    )
query("n22_batched_cauchy", with_roles("coords", body=nearest("g", "coords", "coords", 3) + " SELECT src, dst, round(1 / (1 + power(dist, 2) / sqrt((p.batch + 1.0::DOUBLE) * (q.batch + 1))), 6) AS k FROM g JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst"))(
    lambda s, d: rounded(batched(s, d), "k")
)


def batched(s, d):
    """The batched kernel between near places; batch b has the scale b + 1."""
    c = coords(s, d)
    ends = neighbours.knn(c, c, 3)
    for end, n in (("src", 1), ("dst", 2)):
        ends = ends.join(c.select(F.col("cell").alias(end), F.col("v").alias(f"v{n}"), (F.col("grp") + 1.0).alias(f"s{n}")), end)
    return ends.select("src", "dst", graph.batched_cauchy(F.col("v1"), F.col("v2"), F.col("s1"), F.col("s2")).alias("k"))


WNN = "".join(unit(f"u{i}", f"m{i + 1}") + nearest(f"g{i}", f"u{i}", f"u{i}", 19, where="a.cell <> b.cell") for i in (0, 1))
BW = "".join(f""", s{i} AS MATERIALIZED (SELECT a.src, b.src AS dst, count(*) AS n FROM g{i} a JOIN g{i} b ON a.dst = b.dst GROUP BY ALL), r{i} AS MATERIALIZED (SELECT src, dst, rank() OVER (PARTITION BY src ORDER BY n / (40.0::DOUBLE - n)) AS r FROM s{i}),
f{i} AS MATERIALIZED (SELECT r.src, r.dst, list_distance(p.v, q.v) AS dist FROM r{i} r JOIN u{i} p ON p.cell = r.src JOIN u{i} q ON q.cell = r.dst WHERE r.r <= 21),
bw{i} AS MATERIALIZED (SELECT src AS cell, avg(dist) AS bw FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist DESC, dst) AS p FROM f{i}) WHERE p <= 20 GROUP BY src)""" for i in (0, 1))
PRED = "".join(f""", p{i}{j} AS MATERIALIZED (SELECT t.src AS cell, sqrt(sum(power(u.v[k] - m, 2))) AS d FROM (SELECT g.src, k, sum(u.v[k]) / 19 AS m FROM g{j} g JOIN u{i} u ON u.cell = g.dst, range(1, 33) r(k) GROUP BY ALL) t JOIN u{i} u ON u.cell = t.src GROUP BY t.src)""" for i in (0, 1) for j in (0, 1))
WEIGHTS = "".join(f""", q{i} AS (SELECT n.src AS cell, n.dist AS d, bw, exp(-greatest(w.d - n.dist, 0) / (bw - n.dist)) / (exp(-greatest(c.d - n.dist, 0) / (bw - n.dist)) + 0.0001) AS r FROM g{i} n JOIN bw{i} b ON b.cell = n.src JOIN p{i}{i} w ON w.cell = n.src JOIN p{i}{1 - i} c ON c.cell = n.src WHERE place = 1)""" for i in (0, 1)) + ", wt AS (SELECT a.cell, a.d AS d0, a.bw AS bw0, b.d AS d1, b.bw AS bw1, 1 / (1 + exp(b.r - a.r)) AS w0 FROM q0 a JOIN q1 b USING (cell))"


def modality_weights(s, d):
    """Weights of two modalities on 20 neighbours."""
    reps = tuple(m(s, d).select("cell", graph.unit_length(F.col("v")).alias("v")) for m in (m1, m2))
    return graph.modality_weights(reps, tuple(neighbours.knn(r, r, 19, itself=False) for r in reps), 20, 32)


query("w6_bandwidths", with_roles("m1", "m2", body=WNN + BW + " SELECT cell, round(bw, 6) AS bw FROM bw0"))(
    lambda s, d: rounded(graph.bandwidths(neighbours.knn(m1(s, d).select("cell", graph.unit_length(F.col("v")).alias("v")), m1(s, d).select("cell", graph.unit_length(F.col("v")).alias("v")), 19, itself=False), m1(s, d).select("cell", graph.unit_length(F.col("v")).alias("v")), 20), "bw")
)
query("g11_modality_weights", with_roles("m1", "m2", body=WNN + BW + PRED + WEIGHTS + " SELECT cell, round(d0, 6) AS d0, round(bw0, 6) AS bw0, round(d1, 6) AS d1, round(bw1, 6) AS bw1, round(w0, 6) AS w0, round(1 - w0, 6) AS w1 FROM wt"))(
    lambda s, d: rounded(modality_weights(s, d), "d0", "bw0", "d1", "bw1", "w0", "w1")
)
query("g14_weighted_neighbours", with_roles("m1", "m2", body=WNN + BW + PRED + WEIGHTS + nearest("h0", "u0", "u0", 199, where="a.cell <> b.cell") + nearest("h1", "u1", "u1", 199, where="a.cell <> b.cell") + """, un AS (SELECT src, dst FROM h0 UNION SELECT src, dst FROM h1),
sc AS (SELECT src, dst, w0 * exp(-(list_distance(a.v, b.v) - d0) / (bw0 - d0)) + (1 - w0) * exp(-(list_distance(x.v, y.v) - d1) / (bw1 - d1)) AS w FROM un JOIN wt ON wt.cell = src JOIN u0 a ON a.cell = src JOIN u0 b ON b.cell = dst JOIN u1 x ON x.cell = src JOIN u1 y ON y.cell = dst)
SELECT src, dst, round(w, 6) AS w, round(sqrt(least(greatest((1 - w) / 2, 0), 1)), 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS p FROM sc) WHERE p <= 20"""))(
    lambda s, d: rounded(graph.weighted_neighbours((m1(s, d), m2(s, d)), 20, 200, 32).select("src", "dst", "w", "dist"), "w", "dist")
)
query("d1_pca", None)(lambda s, d: reduce.pca(emb(s, d), 10)[0])
query("d3_lsi", None)(lambda s, d: reduce.Lsi(10).fit(roles.counts(s, d), cells_of(s, d)).transform(roles.counts(s, d)))
query("d5_correct_batches", None)(lambda s, d: reduce.correct_batches(emb(s, d)))
query("n14_row_z_scores", with_roles("emb", body=", z AS (SELECT cell, v, list_avg(v) AS m, list_stddev_samp(v) AS sd FROM emb) SELECT cell, (k - 1)::INT AS d, round((v[k] - m) / sd, 6) AS x FROM z, range(1, 65) r(k)"))(
    lambda s, d: rounded(emb(s, d).select("cell", F.posexplode(reduce.row_z_scores(F.col("v"))).alias("d", "x")), "x")
)
query("c1_communities", None)(lambda s, d: cluster.communities(both_ways(s, d)))



def overlaps(s, d):
    """Jaccard shares of the evaluation graph, without loops: the adjacency that is clustered."""
    return neighbours.jaccard_neighbours(knn20(s, d), 20).where("src <> dst")


query("c3_spectral", None)(lambda s, d: spectral.clusters(overlaps(s, d), 5))
query("c3_spectral_vectors", None)(lambda s, d: spectral.embedding(overlaps(s, d), 5)[1])
query("c4_kmeans", None)(lambda s, d: cluster.kmeans(emb(s, d), 10))
query("c5_mixture", None)(lambda s, d: cluster.mixture(roles.coordinates(emb(s, d)), 5))
query("c2_louvain", None)(lambda s, d: cluster.communities(both_ways(s, d), refine=False))
query("c7_bisected_resolution", None)(lambda s, d: cluster.communities_near(both_ways(s, d), 8))
query("c9_clustering", None)(lambda s, d: cluster.clustering(emb(s, d), 8, "leiden", n_components=20))
query("c10_clusters_of", None)(lambda s, d: cluster.clusters_of(m1(s, d), 10, "mixture"))
query("c12_nearest_centroid", with_roles("emb", body=", c AS (SELECT gt AS k, " + ", ".join(f"avg(v[{i}]) AS c{i}" for i in range(1, 65)) + " FROM emb GROUP BY gt), p AS (SELECT cell, k, " + " + ".join(f"power(v[{i}] - c{i}, 2)" for i in range(1, 65)) + " AS d FROM emb, c) SELECT cell, arg_min(k, d) AS cluster FROM p GROUP BY cell"))(
    lambda s, d: cluster.nearest_centroid(emb(s, d), cluster.centroids(emb(s, d), "gt", 64).select("cluster", "c"))
)
query("a8_covariances", with_roles("m1", body=", l AS (SELECT cell, gt, i, v[i + 1] AS x FROM m1, range(0, 32) r(i)) SELECT a.gt AS cluster, a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.x, b.x), 6) AS cov FROM l a JOIN l b USING (cell) GROUP BY ALL"))(
    lambda s, d: rounded(cluster.covariances(m1(s, d), "gt"), "cov")
)
query("c9_modularity", with_roles("emb", body=KNN20 + """, s AS (SELECT src, dst, 1.0::DOUBLE AS w FROM g UNION SELECT dst, src, 1.0 FROM g), e AS (SELECT s.*, p.gt AS c1, q.gt AS c2 FROM s JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst), dd AS (SELECT sum(d * d) AS dd FROM (SELECT c1, sum(w) AS d FROM e GROUP BY c1))
SELECT round(sum(w) FILTER (c1 = c2) / sum(w) - any_value(dd) / (sum(w) * sum(w)), 6) AS modularity FROM e, dd"""))(
    lambda s, d: rounded(cluster.modularity(graph.symmetric(knn20(s, d)).withColumn("w", F.lit(1.0)), emb(s, d).select("cell", F.col("gt").alias("cluster"))), "modularity")
)
