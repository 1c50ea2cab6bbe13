"""Queries of compositions, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, encoder, geometry_metrics, graph, layout, neighbours, partition, prep, processes, recipes
from ..sources import roles
from ..sources.roles import with_roles
from .graphs import KNN20, coords, emb, knn20, m1, m2, nearest, unit
from .preparation import PEAKS, rounded

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


def suppliers(s, d):
    """(cell) of all suppliers."""
    return roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"))


def rich(s, d):
    """(cell) of the suppliers that a model is trained on."""
    return roles.table(s, d, "supplier").where("s_acctbal >= 4500").select(F.col("s_suppkey").alias("cell"))


def users(s, d):
    """(cell) of all users."""
    return roles.adt(s, d).select("cell").distinct()


query("p25_super_resolution", with_roles("coords", body=nearest("g", "coords", "coords", 1, where="a.cell <> b.cell") + ", s AS (SELECT quantile_cont(dist, 0.5) / 4 AS s FROM g), o AS (SELECT * FROM (VALUES (0, 0, 0), (1, -1, -1), (2, -1, 1), (3, 1, -1), (4, 1, 1)) t(corner, a, b)) SELECT cell, corner, round(x + a * s, 6) AS x, round(y + b * s, 6) AS y FROM coords, s, o"))(
    lambda s, d: rounded(recipes.super_resolution(coords(s, d).select("cell", "x", "y")), "x", "y")
)
query("n15_normalise_others", with_roles("counts", body=f""", rich AS MATERIALIZED (SELECT s_suppkey AS cell FROM supplier WHERE s_acctbal >= 4500), cm AS MATERIALIZED (SELECT *, sum(x) OVER (PARTITION BY cell) AS t FROM counts), tr AS (SELECT cm.* FROM cm JOIN rich USING (cell)), md AS MATERIALIZED (SELECT quantile_cont(t, 0.5) AS m FROM (SELECT sum(x) AS t FROM tr GROUP BY cell)), n AS MATERIALIZED (SELECT count(*) AS n FROM rich),
lg AS MATERIALIZED (SELECT cell, feature, ln(1 + x / (t / (SELECT m FROM md))) AS x FROM cm), tm AS MATERIALIZED (SELECT lg.*, (SELECT n FROM n) AS n, sum(x) OVER (PARTITION BY feature) / (SELECT n FROM n) AS mean FROM lg JOIN rich USING (cell)),
st AS MATERIALIZED (SELECT feature, any_value(mean) AS mean, sqrt((sum((x - mean) * (x - mean)) + (any_value(n) - count(*)) * any_value(mean) * any_value(mean)) / greatest(1, any_value(n) - 1)) AS std FROM tm GROUP BY feature)
SELECT cell, feature, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS x FROM lg JOIN st USING (feature) ANTI JOIN rich USING (cell)"""))(
    lambda s, d: rounded(recipes.Normaliser().fit(roles.counts(s, d).join(rich(s, d), "cell", "left_semi"), rich(s, d).count()).transform(roles.counts(s, d).join(rich(s, d), "cell", "left_anti")).select("cell", "feature", "x"), "x")
)
query("n4_densify", with_roles("adt", body=f""", n AS (SELECT count(DISTINCT cell) AS n FROM adt), m AS (SELECT *, sum(x) OVER (PARTITION BY feature) / n AS mean FROM adt, n), st AS (SELECT feature, any_value(mean) AS mean, sqrt((sum((x - mean) * (x - mean)) + (any_value(n) - count(*)) * any_value(mean) * any_value(mean)) / (any_value(n) - 1)) AS std FROM m GROUP BY feature)
SELECT c.cell, st.feature, round((coalesce(a.x, 0) - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS x FROM (SELECT DISTINCT cell FROM adt) c, st LEFT JOIN adt a ON a.cell = c.cell AND a.feature = st.feature"""))(
    lambda s, d: rounded(prep.densify(prep.scale(roles.adt(s, d), users(s, d).count()), users(s, d)), "x")
)
LOSS = "lgamma(10.0::DOUBLE) + lgamma(x + 1) - lgamma(x + 10) + (10 + x) * ln(1 + m / 10) + x * (ln(10.0::DOUBLE) - ln(m))"
query("t7_likelihoods", with_roles("counts", body=f""", l AS (SELECT cell, feature, x, avg(x) OVER (PARTITION BY feature) AS m FROM counts) SELECT cell, feature, round({LOSS}, 6) AS nb, round({LOSS} - ln(1 - 0.1::DOUBLE), 6) AS zinb, round(m - x * ln(m) + lgamma(x + 1), 6) AS poisson,
round(CASE WHEN x > 25 THEN m - x * ln(m) + lgamma(x + 1) - ln(0.9::DOUBLE) ELSE -ln(0.1::DOUBLE + 0.9::DOUBLE * exp(-m)) END + 0.005, 6) AS zip,
round(ln(1 + exp(-0.3::DOUBLE)) - ln(exp(-({LOSS})) + exp(-({LOSS.replace("m", "(m * 2)").replace("lga(m * 2)(m * 2)a", "lgamma")}) - 0.3::DOUBLE)), 6) AS mixture FROM l"""))(
    lambda s, d: rounded(losses(roles.counts(s, d)), "nb", "zinb", "poisson", "zip", "mixture")
)


def losses(counts):
    """Likelihood of every count around its feature's mean; counts up to 25 stand for zeros where zeros are inflated."""
    x, m, ten = F.col("x"), F.col("m"), F.lit(10.0)
    rows = counts.join(counts.groupBy("feature").agg(F.avg("x").alias("m")), "feature")
    return rows.select(
        "cell", "feature", recipes.nb_loss(x, m, ten).alias("nb"), recipes.zinb_loss(x, m, ten, F.lit(0.1)).alias("zinb"), recipes.poisson_loss(x, m).alias("poisson"),
        F.when(x > 25, recipes.zip_loss(x, m, F.lit(0.1), 0.5)).otherwise(recipes.zip_loss(F.lit(0.0), m, F.lit(0.1), 0.5)).alias("zip"),
        recipes.mixture_nb_loss(x, m, m * 2, ten, F.lit(0.3)).alias("mixture"),
    )


query("b5_differential_expression", with_roles("counts", body=f""", ps AS (SELECT least(0.5, greatest(0.05, quantile_cont(m, 0.9))) AS ps FROM (SELECT avg(x) AS m FROM counts GROUP BY feature)), g AS (SELECT s_suppkey AS cell, CASE WHEN s_acctbal >= 4500 THEN 'a' ELSE 'b' END AS grp FROM supplier), n AS (SELECT count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM g),
m AS (SELECT feature, coalesce(sum(x) FILTER (grp = 'a'), 0) / any_value(na) AS mean_a, coalesce(sum(x) FILTER (grp = 'b'), 0) / any_value(nb) AS mean_b FROM counts JOIN g USING (cell), n GROUP BY feature), l AS (SELECT feature, log2(mean_a + ps) - log2(mean_b + ps) AS lfc FROM m, ps)
SELECT feature, round(lfc, 6) AS lfc, abs(lfc) >= 0.5 AS changed FROM l"""))(
    lambda s, d: rounded(recipes.differential_expression(roles.counts(s, d), roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.when(F.col("s_acctbal") >= 4500, "a").otherwise("b").alias("group")), 0.5).select("feature", "lfc", "changed"), "lfc")
)
MD5 = "('0x' || substr(md5({0}), 1, 13))::BIGINT"
query("g9_negative_edges", with_roles("emb", body=KNN20 + f""", ps AS (SELECT cell, row_number() OVER (ORDER BY {MD5.format("cell || ':0'")}, cell) - 1 AS p FROM emb), dr AS (SELECT cell AS src, t, {MD5.format("cell || ':' || t || ':0'")} % (SELECT count(*) FROM emb) AS p FROM emb, range(1, 5) r(t)),
fr AS (SELECT src, ps.cell AS dst, min(t) AS t FROM dr JOIN ps USING (p) WHERE src <> ps.cell GROUP BY ALL), ok AS (SELECT fr.* FROM fr ANTI JOIN g ON g.src = fr.src AND g.dst = fr.dst) SELECT src, arg_min(dst, t) AS dst FROM ok GROUP BY src"""))(lambda s, d: recipes.negative_edges(knn20(s, d), emb(s, d)))
query("d7_rna_vectors", None)(lambda s, d: recipes.rna_vectors(roles.counts(s, d), suppliers(s, d), 200, 8))
query("d8_adt_vectors", None)(lambda s, d: recipes.adt_vectors(roles.adt(s, d), users(s, d), 3))
query("d9_peak_vectors", None)(lambda s, d: recipes.peak_vectors(roles.counts(s, d), suppliers(s, d), 200, 6))
query("c11_split_and_merge", None)(lambda s, d: recipes.split_and_merge(roles.coordinates(emb(s, d)).select("cell", "v"), 4, 2)[1])
query("d7_rna_vectors_lsi", None)(lambda s, d: recipes.rna_vectors(roles.counts(s, d), suppliers(s, d), 200, 8, roles.cell_batches(s, d), "lsi"))
query("m17_best_information", None)(lambda s, d: recipes.best_information(graph.symmetric(knn20(s, d)).withColumn("w", F.lit(1.0)), emb(s, d).select("cell", F.col("gt").alias("label"))))
NEWER = "(SELECT coords.* FROM coords JOIN emb USING (cell) WHERE batch <> 0)"
query("t13_predicted_counts", with_roles("adt", "coords", body=nearest("g", NEWER, "(SELECT coords.* FROM coords JOIN adt USING (cell) JOIN emb USING (cell) WHERE batch = 0 GROUP BY ALL)", 1) + " SELECT src AS cell, feature, adt.x FROM g JOIN adt ON adt.cell = dst"))(
    lambda s, d: recipes.predict_at(coords(s, d).where("grp <> 0"), coords(s, d).where("grp = 0").join(users(s, d), "cell", "left_semi"), roles.adt(s, d))
)
query("t13_denoised_counts", with_roles("adt", "coords", body=", c AS (SELECT * FROM coords WHERE cell IN (SELECT cell FROM adt))" + nearest("g", "c", "c", 5) + ", k AS (SELECT src, dst, 1 / (1 + dist * dist) AS w FROM g), t AS (SELECT src, sum(w) AS t FROM k GROUP BY src) SELECT k.src AS cell, feature, round(sum(w * adt.x) / any_value(t), 6) AS x FROM k JOIN adt ON adt.cell = dst JOIN t ON t.src = k.src GROUP BY ALL"))(
    lambda s, d: rounded(recipes.denoised(roles.adt(s, d), coords(s, d).join(users(s, d), "cell", "left_semi"), 5), "x")
)
query("t7_contrast_loss", with_roles("emb", body=unit("u", "emb") + KNN20 + """, e AS (SELECT src, exp(list_dot_product(p.v, q.v) / 0.5) AS e, p.gt = q.gt AS pos FROM g JOIN u p ON p.cell = src JOIN u q ON q.cell = dst WHERE src <> dst), t AS (SELECT src, sum(e) FILTER (pos) AS a, sum(e) FILTER (NOT pos) AS b FROM e GROUP BY src)
SELECT round(avg(-ln(a / (a + b))), 6) AS contrast_loss FROM t WHERE a IS NOT NULL AND b IS NOT NULL"""))(lambda s, d: rounded(contrast(s, d), "contrast_loss"))


for _name, _grp, _of in (("t7_loss_within_batches", "m1.batch", "batch"), ("t7_loss_over_all", "0", None)):
    query(_name, with_roles("m1", "m2", body=f""", p AS (SELECT m1.cell, {_grp} AS grp, m1.v AS x, m2.v AS t FROM m1 JOIN m2 USING (cell)), d AS (SELECT a.cell, a.grp, list_dot_product(a.x, b.x) / 0.5 AS x, list_dot_product(a.t, b.t) / 0.5 AS t FROM p a JOIN p b ON a.grp = b.grp),
l AS (SELECT cell, grp, ln(sum(exp(x))) AS lx, ln(sum(exp(t))) AS lt FROM d GROUP BY ALL), k AS (SELECT cell, grp, sum(exp(t - lt) * (t - lt - x + lx)) AS k FROM d JOIN l USING (cell, grp) GROUP BY ALL) SELECT round(avg(k), 6) AS distribution_loss FROM (SELECT avg(k) AS k FROM k GROUP BY grp)"""))(
        lambda s, d, of=_of: rounded(geometry_metrics.distribution_loss(m1(s, d).withColumn("grp", F.col(of) if of else F.lit(0)), m2(s, d), 0.5), "distribution_loss")
    )


def contrast(s, d):
    """Neighbours of the same label against neighbours of others."""
    e = emb(s, d)
    pairs = knn20(s, d).where("src <> dst").join(e.select(F.col("cell").alias("src"), F.col("gt").alias("a")), "src").join(e.select(F.col("cell").alias("dst"), F.col("gt").alias("b")), "dst")
    return recipes.contrast_loss(e, pairs.where("a = b"), pairs.where("a <> b"), 0.5)



query("c14_background_means", None)(lambda s, d: recipes.background_means(roles.adt(s, d)))
query("t2_linear_surrogate", None)(lambda s, d: recipes.linear_surrogate((m1(s, d), m2(s, d)), coords(s, d), 32))
query("c13_change_threshold", None)(lambda s, d: s.createDataFrame([(recipes.change_threshold(Q["b5_differential_expression"](s, d)),)], "delta double"))
query("j20_align_reference", with_roles("peaks", body=PEAKS + """, inside AS (SELECT p.* REPLACE ((dataset <> 0)::INT AS dataset), m."start" AS q_start, m."end" AS q_end FROM peaks p JOIN merged m ON p.seqname = m.seqname AND p."start" >= m."start" AND p."end" <= m."end"),
kept AS (SELECT seqname, q_start, q_end FROM inside GROUP BY ALL HAVING count(DISTINCT dataset) = 2 AND q_end - q_start > 20 AND q_end - q_start < 10000)
SELECT dataset, cell, seqname || ':' || q_start || '-' || q_end AS feature, count(*) AS x FROM inside JOIN kept USING (seqname, q_start, q_end) GROUP BY ALL"""))(
    lambda s, d: recipes.align_reference(regions(s, d, "dataset = 0"), regions(s, d, "dataset <> 0"), "atac")
)
query("g5_typed_propagation", with_roles("coords", body=KNN20 + """, s AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), t AS (SELECT s.dst AS cell, coalesce(sum(c.x) FILTER (p.batch = q.batch), 0) AS v2, coalesce(sum(c.y) FILTER (p.batch = q.batch), 0) AS v3, coalesce(sum(c.x) FILTER (p.batch <> q.batch), 0) AS v4, coalesce(sum(c.y) FILTER (p.batch <> q.batch), 0) AS v5
FROM s JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst JOIN coords c ON c.cell = src GROUP BY s.dst) SELECT cell, round(x, 6) AS v0, round(y, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3, round(v4, 6) AS v4, round(v5, 6) AS v5 FROM t JOIN coords USING (cell)"""))(
    lambda s, d: rounded(typed(s, d).select("cell", *[F.col("v")[i].alias(f"v{i}") for i in range(6)]), *[f"v{i}" for i in range(6)])
)


def regions(s, d, which: str):
    """Counts on regions of some datasets."""
    return roles.peaks(s, d).where(which).select("cell", F.concat("seqname", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("feature"), F.lit(1).alias("x"))


def typed(s, d):
    """One step over edges within and across batches."""
    edges = graph.edge_classes(graph.symmetric(knn20(s, d)).withColumn("w", F.lit(1.0)), emb(s, d).select("cell", "batch"))
    return graph.propagate(edges, coords(s, d), 2, typed=True)


query("c6_communities_wanted", None)(lambda s, d: cluster.communities_of(graph.symmetric(knn20(s, d)).withColumn("w", F.lit(1.0)), 8))


def measured(s, d):
    """Places of the first batch with two measured values and their variances."""
    y, noise = F.array(F.col("v")[2], F.col("v")[3]), F.array(0.1 + F.abs(F.col("v")[4]), 0.1 + F.abs(F.col("v")[5]))
    return emb(s, d).where("batch = 0").select("cell", F.slice("v", 1, 2).alias("v"), y.alias("y"), noise.alias("noise"))


def process(s, d):
    """A process over the measured places, with a grid of 5 by 5 inducing points."""
    return processes.SparseProcess(processes.grid_of(measured(s, d), 5), "cauchy", 1.0, 1e-6).fit(measured(s, d))


def unmeasured(s, d):
    """Places of the other batches."""
    return roles.coordinates(emb(s, d).where("batch <> 0"))


def steps(at: str) -> str:
    """Gauss-Jordan steps without exchange, for positive definite matrices: rows a with the right side behind."""
    return f"""SELECT p + 1 AS p, list_transform(a, lambda r, i: CASE WHEN i = p + 1 THEN list_transform(r, lambda x: x / a[p + 1][p + 1]) ELSE list_transform(r, lambda x, j: x - r[p + 1] * a[p + 1][j] / a[p + 1][p + 1]) END) AS a FROM {at} WHERE p < 25"""


MEAN = """, kn AS MATERIALIZED (SELECT cell, v[1] AS x, v[2] AS y, v[3] AS t0, v[4] AS t1, 0.1 + abs(v[5]) AS n0, 0.1 + abs(v[6]) AS n1 FROM emb WHERE batch = 0),
ind AS MATERIALIZED (SELECT a * 5 + b + 1 AS i, x0 + a * (x1 - x0) / 4 AS x, y0 + b * (y1 - y0) / 4 AS y FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM kn), range(5) p(a), range(5) q(b)),
k AS MATERIALIZED (SELECT cell, i, 1 / (1 + power(kn.x - ind.x, 2) + power(kn.y - ind.y, 2)) AS k, t0, t1, n0, n1 FROM kn, ind),
mm AS (SELECT p.i, q.i AS j, 1 / (1 + power(p.x - q.x, 2) + power(p.y - q.y, 2)) + CASE WHEN p.i = q.i THEN 1e-6 ELSE 0 END AS m FROM ind p, ind q),
s AS MATERIALIZED (SELECT p.i, q.i AS j, sum(p.k * q.k / p.n0) AS s0, sum(p.k * q.k / p.n1) AS s1 FROM k p JOIN k q USING (cell) GROUP BY ALL),
rows AS (SELECT i, list(m + s0 ORDER BY j) AS r0, list(m + s1 ORDER BY j) AS r1 FROM mm JOIN s USING (i, j) GROUP BY i),
b AS (SELECT i, sum(k * t0 / n0) AS b0, sum(k * t1 / n1) AS b1 FROM k GROUP BY i),
g0 AS (SELECT 0 AS p, list(list_append(r0, b0) ORDER BY i) AS a FROM rows JOIN b USING (i) UNION ALL """ + steps("g0") + """),
g1 AS (SELECT 0 AS p, list(list_append(r1, b1) ORDER BY i) AS a FROM rows JOIN b USING (i) UNION ALL """ + steps("g1") + """),
w AS (SELECT i, g0.a[i][26] AS w0, g1.a[i][26] AS w1 FROM g0, g1, ind WHERE g0.p = 25 AND g1.p = 25)
SELECT cell, round(sum(w0 / (1 + power(v[1] - x, 2) + power(v[2] - y, 2))), 6) AS mean0, round(sum(w1 / (1 + power(v[1] - x, 2) + power(v[2] - y, 2))), 6) AS mean1 FROM emb, ind JOIN w USING (i) WHERE batch <> 0 GROUP BY cell"""
query("t13_process_mean", with_roles("emb", body=MEAN, recursive=True))(
    lambda s, d: rounded(process(s, d).predict(unmeasured(s, d)).select("cell", *[F.col("mean")[i].alias(f"mean{i}") for i in (0, 1)]), "mean0", "mean1")
)
query("t13_process_variance", None)(lambda s, d: process(s, d).predict(unmeasured(s, d)).select("cell", *[F.col("var")[i].alias(f"var{i}") for i in (0, 1)]))


def unseen_counts(s, d):
    """Event counts at the other batches' places: latent numbers by process and nearest place, decoded linearly."""
    e = emb(s, d)
    z = F.slice("v", 3, 4)
    known = e.where("batch = 0").join(users(s, d), "cell", "left_semi").select("cell", F.slice("v", 1, 2).alias("v"), z.alias("z"), F.transform(z, lambda x: 0.1 + F.abs(x)).alias("spread"))
    gp = known.select("cell", "v", F.slice("z", 1, 2).alias("y"), F.slice("spread", 1, 2).alias("noise"))
    fitted = processes.SparseProcess(processes.grid_of(gp, 4), jitter=1e-6).fit(gp)
    decoder = processes.LinearDecoder().fit(known.select("cell", F.col("z").alias("v")), roles.adt(s, d))
    return decoder.decode(processes.latents_at(fitted, known, unmeasured(s, d)).select("cell", "v"))


query("t13_unseen_counts", None)(unseen_counts)


def weighed(s, d):
    """The evaluation graph in both directions, every edge of weight 1."""
    return graph.symmetric(knn20(s, d).where("src <> dst")).withColumn("w", F.lit(1.0))


query("d6_layout", None)(lambda s, d: layout.layout(emb(s, d)))
query("t10_partition", None)(lambda s, d: partition.partition(weighed(s, d), 8))
query("t10_batches", None)(lambda s, d: partition.mini_batches(weighed(s, d), partition.partition(weighed(s, d), 8), 2))


def looped(points, k: int, metric: str = "euclidean"):
    """A normalised symmetric graph of the k nearest, with loops."""
    return graph.normalised(graph.symmetric(neighbours.knn(points, points, k, metric, itself=False)).withColumn("w", F.lit(1.0)), points.select("cell"))


def trained(s, d):
    """The two halves' encoder, after ten steps."""
    one, two = m1(s, d).select("cell", "v"), m2(s, d).select("cell", "v")
    model = encoder.Encoder((one, two), looped(coords(s, d).select("cell", "v"), 3), (looped(one, 20, "correlation"), looped(two, 20, "correlation")), 16)
    return model.encoded(model.train(10, 0.01).parameters)


query("t2_attention_encoder", None)(trained)
