"""Queries of evaluation metrics and reports, and their DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import geometry_metrics as geo
from ..operators import label_metrics as lab
from ..operators import mixing_metrics as mix
from ..operators import neighbours
from ..sources import roles
from ..sources.roles import with_roles
from .graphs import COSINE, KNN20, coords, emb, knn20, m1, m2, nearest, unit
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


def labelled(s, d, label: str = "gt", batch: str | None = None) -> DataFrame:
    """(cell, v, label) and, if named, batch."""
    e = emb(s, d)
    return e.select("cell", "v", F.col(label).alias("label"), *([F.col(batch).alias("batch")] if batch else []))


def cells(s, d) -> DataFrame:
    """(cell, v, label, cluster, batch) of all points; label 0 is one batch's alone: the others' points of it have label 1."""
    return emb(s, d).select("cell", "v", F.when((F.col("gt") == 0) & (F.col("batch") != 0), 1).otherwise(F.col("gt")).alias("label"), F.col("pred").alias("cluster"), "batch")


CELLS = ", cells AS (SELECT cell, v, CASE WHEN gt = 0 AND batch <> 0 THEN 1 ELSE gt END AS label, pred AS cluster, batch FROM emb)"
CT = ", ct AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b, sum(n) OVER () AS total FROM (SELECT pred AS cluster, gt AS label, count(*) AS n FROM emb GROUP BY ALL))"
PAIRS = CT + ", q AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS tp, sum(n) AS total FROM ct), ca AS (SELECT sum(a * (a - 1) / 2.0::DOUBLE) AS s FROM (SELECT DISTINCT cluster, a FROM ct)), cb AS (SELECT sum(b * (b - 1) / 2.0::DOUBLE) AS s FROM (SELECT DISTINCT label, b FROM ct)), pc AS (SELECT tp, ca.s - tp AS fp, cb.s - tp AS fn, total * (total - 1) / 2.0::DOUBLE - ca.s - cb.s + tp AS tn, total::DOUBLE AS total FROM q, ca, cb)"
INFO = CT + ", i AS (SELECT sum(n / total * ln(total * n / (a * b))) AS mi, -sum(n / total * ln(a / total)) AS hc, -sum(n / total * ln(b / total)) AS hl FROM (SELECT n::DOUBLE AS n, a::DOUBLE AS a, b::DOUBLE AS b, total::DOUBLE AS total FROM ct))"


def table(s, d) -> DataFrame:
    """The contingency table of predicted against true labels."""
    return lab.contingency(emb(s, d), "pred", "gt")


query("a7_contingency", with_roles("emb", body=CT + " SELECT cluster, label, n, a::BIGINT AS a, b::BIGINT AS b, total::BIGINT AS total FROM ct"))(table)
query("m1_purity", with_roles("emb", body=CT + " SELECT round(sum(m) / any_value(total), 6)::DOUBLE AS purity FROM (SELECT max(n) AS m, any_value(total) AS total FROM ct GROUP BY cluster)"))(lambda s, d: rounded(lab.purity(table(s, d)), "purity"))
query("m2_pair_counts", with_roles("emb", body=PAIRS + " SELECT tp, fp, fn, tn, total FROM pc"))(lambda s, d: lab.pair_counts(table(s, d)))
query("m3_m10_pair_metrics", with_roles("emb", body=PAIRS + """ SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f_measure, round(tp / (tp + fp + fn), 6) AS jaccard, round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / sqrt((tp + fp) * (tp + fn)), 6) AS fmi,
round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM pc"""))(lambda s, d: rounded(lab.pair_metrics(table(s, d)), "precision", "recall", "f_measure", "jaccard", "dice", "fmi", "ari"))
query("m9_m14_information", with_roles("emb", body=INFO + " SELECT round(mi / ((hc + hl) / 2), 6) AS nmi, round(mi / hl, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * (mi / hl) * (mi / hc) / (mi / hl + mi / hc), 6) AS v_measure FROM i"))(
    lambda s, d: rounded(lab.information_metrics(table(s, d)), "nmi", "homogeneity", "completeness", "v_measure")
)
query("m11_adjusted_information", with_roles("emb", body=INFO + """, p AS (SELECT a::BIGINT AS a, b::BIGINT AS b, total::BIGINT AS t FROM (SELECT DISTINCT cluster, a, total FROM ct) x, (SELECT DISTINCT label, b FROM ct) y),
k AS (SELECT *, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS k FROM p),
e AS (SELECT sum(k / t::DOUBLE * ln(t * k / (a * b)::DOUBLE) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS emi FROM k)
SELECT round(emi, 6) AS emi, round((mi - emi) / ((hc + hl) / 2 - emi), 6) AS ami FROM i, e"""))(lambda s, d: rounded(lab.adjusted_information(table(s, d)), "emi", "ami"))
#: The best matching, cluster by cluster, over all sets of labels that are taken (bits).
BEST = CT + ", b0 AS (SELECT 0::BIGINT AS taken, 0::BIGINT AS n)" + "".join(
    f""", b{k + 1} AS (SELECT taken, max(n) AS n FROM (SELECT * FROM b{k} UNION ALL SELECT taken | (1::BIGINT << label), b{k}.n + ct.n FROM b{k}, ct WHERE cluster = {k} AND taken & (1::BIGINT << label) = 0) GROUP BY taken)""" for k in range(8))
query("m16_cluster_accuracy", with_roles("emb", body=BEST + " SELECT round(max(n) / (SELECT any_value(total) FROM ct)::DOUBLE, 6) AS accuracy FROM b8"))(lambda s, d: rounded(lab.cluster_accuracy(table(s, d)), "accuracy"))
ISO = CELLS + ", sn AS (SELECT label, count(DISTINCT batch) AS batches FROM cells GROUP BY label), iso AS (SELECT * FROM sn WHERE batches <= (SELECT min(batches) FROM sn) AND (SELECT min(batches) FROM sn) <> (SELECT count(DISTINCT batch) FROM cells))"
query("m18_isolated_labels", with_roles("emb", body=ISO + " SELECT label, batches FROM iso"))(lambda s, d: lab.isolated_labels(cells(s, d)))
query("m19_isolated_f1", with_roles("emb", body=ISO + ", c2 AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b FROM (SELECT cluster, label, count(*) AS n FROM cells GROUP BY ALL)) SELECT round(avg(f), 6) AS isolated_f1 FROM (SELECT label, max(2 * n / (a + b)::DOUBLE) AS f FROM c2 GROUP BY label) JOIN iso USING (label)"))(
    lambda s, d: rounded(lab.isolated_f1(cells(s, d)), "isolated_f1")
)
# geometry


def sil(points: str, label: str, grp: str = "'all'") -> str:
    """Common table expressions of silhouettes of (cell, v, label) within groups."""
    return f""", pt AS (SELECT cell, v, {label} AS label, {grp} AS grp FROM {points}), sz AS (SELECT grp, label, count(*) AS n FROM pt GROUP BY ALL),
sd AS (SELECT p.cell, p.label, p.grp, q.label AS other, sum(list_distance(p.v, q.v)) AS t FROM pt p JOIN pt q ON p.grp = q.grp GROUP BY ALL),
ab AS (SELECT cell, sd.label, sd.grp, max(CASE WHEN other = sd.label AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN other <> sd.label THEN t / n END) AS b FROM sd JOIN sz ON sz.grp = sd.grp AND sz.label = other GROUP BY ALL),
sl AS (SELECT cell, label, grp, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


query("e1_silhouettes", with_roles("emb", body=sil("emb", "gt::VARCHAR") + " SELECT cell, label, round(s, 6) AS s FROM sl"))(
    lambda s, d: rounded(geo.silhouettes(labelled(s, d).withColumn("grp", F.lit("all"))).select("cell", "label", "s"), "s")
)
query("e2_silhouette_scaled", with_roles("emb", body=sil("emb", "gt::VARCHAR") + " SELECT round((avg(s) + 1) / 2, 6) AS silhouette FROM sl"))(lambda s, d: rounded(geo.silhouette_score(labelled(s, d), True), "silhouette"))
query("e3_silhouette_batch", with_roles("emb", body=CELLS + sil("cells", "batch::VARCHAR", "label::VARCHAR") + ", gb AS (SELECT grp, count(DISTINCT label) AS b, count(*) AS n FROM pt GROUP BY grp) SELECT round(avg(m), 6) AS silhouette_batch FROM (SELECT grp, avg(1 - abs(s)) AS m FROM sl GROUP BY grp) JOIN gb USING (grp) WHERE b > 1 AND b < n"))(
    lambda s, d: rounded(geo.silhouette_batch(cells(s, d).select("cell", "v", "batch", F.col("label").alias("grp"))), "silhouette_batch")
)
query("e6_silhouette_batch_strict", with_roles("emb", body=CELLS + sil("cells", "batch::VARCHAR", "label::VARCHAR") + ", gb AS (SELECT grp, count(DISTINCT label) AS b, count(*) AS n FROM pt GROUP BY grp) SELECT round(avg(CASE WHEN b > 1 AND b < n THEN m ELSE 1 END), 6) AS silhouette_batch FROM (SELECT grp, avg(1 - abs(s)) AS m FROM sl GROUP BY grp) JOIN gb USING (grp)"))(
    lambda s, d: rounded(geo.silhouette_batch(cells(s, d).select("cell", "v", "batch", F.col("label").alias("grp")), strict=True), "silhouette_batch")
)
query("e7_isolated_silhouette", with_roles("emb", body=ISO + sil("cells", "label::VARCHAR") + " SELECT round((avg(m) + 1) / 2, 6) AS isolated_asw FROM (SELECT label, avg(s) AS m FROM sl WHERE label IN (SELECT label::VARCHAR FROM iso) GROUP BY label)"))(
    lambda s, d: rounded(geo.isolated_silhouette(cells(s, d).select("cell", "v", "label", "batch")), "isolated_asw")
)
query("e8_e9_dispersion", with_roles("emb", body=""", l AS (SELECT cell, gt AS label, i, v[i] AS x FROM emb, range(1, 65) r(i)), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT i, avg(x) AS g FROM l GROUP BY i),
bt AS (SELECT sum(n * (m - g) * (m - g)) AS b, count(DISTINCT label) AS k FROM c JOIN g USING (i)), f AS (SELECT l.label, cell, sum((x - m) * (x - m)) AS sq FROM l JOIN c ON c.label = l.label AND c.i = l.i GROUP BY ALL), wt AS (SELECT sum(sq) AS w, count(*) AS n FROM f),
r AS (SELECT label, avg(sqrt(sq)) AS r FROM f GROUP BY label), ap AS (SELECT x.label, y.label AS l2, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM c x JOIN c y ON x.i = y.i AND x.label <> y.label GROUP BY ALL),
db AS (SELECT avg(w) AS db FROM (SELECT ap.label, max((p.r + q.r) / d) AS w FROM ap JOIN r p ON p.label = ap.label JOIN r q ON q.label = l2 GROUP BY ap.label))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin FROM bt, wt, db"""))(lambda s, d: rounded(geo.dispersion_metrics(labelled(s, d)), "calinski_harabasz", "davies_bouldin"))
AP = """, h AS (SELECT src, place, (p.gt = q.gt)::INT AS hit FROM g JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst), ap AS (SELECT src, hit, sum(hit) OVER (PARTITION BY src ORDER BY place ROWS UNBOUNDED PRECEDING) / place::DOUBLE AS p FROM h)
SELECT src AS cell, round(coalesce(avg(p) FILTER (hit = 1), 0), 6) AS ap FROM ap GROUP BY src"""
query("e10_average_precision", with_roles("emb", body=nearest("g", "emb", "emb", "(SELECT greatest(1, round_even(count(*) * 0.01, 0)) FROM emb)", where="a.cell <> b.cell") + AP))(lambda s, d: rounded(geo.average_precision(labelled(s, d)), "ap"))
query("e11_average_precision_30", with_roles("emb", body=nearest("g", "emb", "emb", 30, where="a.cell <> b.cell") + AP))(lambda s, d: rounded(geo.average_precision(labelled(s, d), 30), "ap"))
query("e4_silhouette_no_group", with_roles("emb", body=sil("emb", "batch::VARCHAR") + " SELECT round(avg(1 - abs(s)), 6) AS silhouette_no_group FROM sl"))(
    lambda s, d: rounded(geo.silhouette_no_group(emb(s, d).select("cell", "v", "batch")), "silhouette_no_group")
)
ALIGNMENT = "".join(f""", w{r} AS (SELECT cell, v, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ('0x' || substr(md5(cell || ':0:{r}'), 1, 13))::BIGINT, cell) AS p FROM emb) WHERE p <= (SELECT min(n) FROM (SELECT count(*) AS n FROM emb GROUP BY batch)))"""
    + nearest(f"n{r}", f"w{r}", f"w{r}", 20, where="a.cell <> b.cell") + f""", s{r} AS (SELECT least(1, (20 - sum((p.batch = q.batch)::INT) / count(DISTINCT src)::DOUBLE) * 3 / (20 * 2)) AS s FROM n{r} JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst)""" for r in range(4))
query("e12_alignment", with_roles("emb", body=ALIGNMENT + " SELECT round(avg(s), 6) AS alignment FROM (" + " UNION ALL ".join(f"SELECT s FROM s{r}" for r in range(4)) + ")"))(
    lambda s, d: rounded(geo.alignment_score(emb(s, d).select("cell", "v", "batch"), 20), "alignment")
)
query("e13_neighbour_conservation", with_roles("m1", "m2", body="".join(nearest(f"n{i}", f"m{i}", f"m{i}", "(SELECT greatest(1, round_even(count(*) * 0.01, 0)) FROM emb)", where="a.cell <> b.cell AND a.batch = b.batch") for i in (1, 2)) + """, c AS (SELECT n1.src, count(*) AS n FROM n1 JOIN n2 ON n1.src = n2.src AND n1.dst = n2.dst GROUP BY n1.src), z AS (SELECT x.src, x.n AS a, y.n AS b, coalesce(c.n, 0) AS n FROM (SELECT src, count(*) AS n FROM n1 GROUP BY src) x JOIN (SELECT src, count(*) AS n FROM n2 GROUP BY src) y USING (src) LEFT JOIN c USING (src))
SELECT round(avg(r), 6) AS neighbour_conservation FROM (SELECT batch, avg(n / (a + b - n)::DOUBLE) AS r FROM z JOIN emb ON cell = src GROUP BY batch)"""))(
    lambda s, d: rounded(geo.neighbour_conservation(m1(s, d).withColumnRenamed("batch", "grp"), m2(s, d).withColumnRenamed("batch", "grp")), "neighbour_conservation")
)
FOS = """, d AS (SELECT a.cell AS i, b.cell AS j, {0} AS d FROM {1} a, {2} b), o AS (SELECT i, d FROM d WHERE i = j), x AS (SELECT avg(c) AS x FROM (SELECT d.i, avg((d.d < o.d)::INT) AS c FROM d JOIN o ON o.i = d.i GROUP BY d.i)), y AS (SELECT avg(c) AS y FROM (SELECT d.j, avg((d.d < o.d)::INT) AS c FROM d JOIN o ON o.i = d.j GROUP BY d.j))
SELECT round(x, 6) AS foscttm_x, round(y, 6) AS foscttm_y, round((x + y) / 2, 6) AS foscttm FROM x, y"""
query("e14_foscttm", with_roles("m1", "m2", body=FOS.format("list_distance(a.v, b.v)", "m1", "m2")))(lambda s, d: rounded(geo.foscttm(m1(s, d), m2(s, d)), "foscttm_x", "foscttm_y", "foscttm"))
query("e15_foscttm_cosine", with_roles("m1", "m2", body=unit("u1", "m1") + unit("u2", "m2") + FOS.format(COSINE, "u1", "u2")))(lambda s, d: rounded(geo.foscttm(m1(s, d), m2(s, d), "cosine"), "foscttm_x", "foscttm_y", "foscttm"))
F1 = """, tb AS (SELECT label, pred, count(*) AS n FROM pr GROUP BY ALL), tl AS (SELECT label, sum(n) AS t, coalesce(sum(n) FILTER (label = pred), 0) AS hit FROM tb GROUP BY label), tp AS (SELECT pred AS label, sum(n) AS p FROM tb GROUP BY pred),
bo AS (SELECT coalesce(tl.label, tp.label) AS label, coalesce(t, 0)::DOUBLE AS t, coalesce(p, 0)::DOUBLE AS p, coalesce(hit, 0)::DOUBLE AS hit FROM tl FULL JOIN tp ON tl.label = tp.label),
fs AS (SELECT sum(t) AS n, sum(hit) AS hit, sum(t * p) AS tp, avg(CASE WHEN t + p = 0 THEN 0 ELSE 2 * hit / (t + p) END) AS macro, sum(CASE WHEN t + p = 0 THEN 0 ELSE 2 * hit / (t + p) END * t) / sum(t) AS weighted FROM bo)"""
SCORES = " SELECT round(hit / n, 6) AS accuracy, round((hit / n - tp / (n * n)) / (1 - tp / (n * n)), 6) AS kappa, round(macro, 6) AS macro_f1, round(weighted, 6) AS weighted_f1 FROM fs"
query("e18_cross_validation", with_roles("emb", body=", f AS (SELECT cell, v, gt, row_number() OVER (PARTITION BY gt ORDER BY cell) % 5 AS fold FROM emb)" + nearest("g", "f", "f", 5, where="a.fold <> b.fold") + ", vt AS (SELECT src, gt, count(*) AS n FROM g JOIN emb ON dst = cell GROUP BY ALL), pr AS (SELECT any_value(e.gt) AS label, arg_max(vt.gt, n * 1000 - vt.gt) AS pred FROM vt JOIN emb e ON e.cell = src GROUP BY src)" + F1 + SCORES))(
    lambda s, d: rounded(geo.cross_validation(labelled(s, d)), "accuracy", "kappa", "macro_f1", "weighted_f1")
)
query("e18_leave_batch_out", with_roles("emb", body=nearest("g", "emb", "emb", 5, where="a.batch <> b.batch") + ", vt AS (SELECT src, gt, count(*) AS n FROM g JOIN emb ON dst = cell GROUP BY ALL), pr AS (SELECT any_value(e.gt) AS label, arg_max(vt.gt, n * 1000 - vt.gt) AS pred FROM vt JOIN emb e ON e.cell = src GROUP BY src)" + F1 + SCORES))(
    lambda s, d: rounded(geo.cross_validation(labelled(s, d, batch="batch"), batch=True), "accuracy", "kappa", "macro_f1", "weighted_f1")
)
query("e17_label_transfer", with_roles("emb", body="".join(nearest(f"g{p}", f"(SELECT * FROM emb WHERE (batch = 0) = ({p} = 0))", f"(SELECT * FROM emb WHERE (batch = 0) <> ({p} = 0))", 10) + f", v{p} AS (SELECT src, gt, count(*) AS n FROM g{p} JOIN emb ON dst = cell GROUP BY ALL), p{p} AS (SELECT any_value(e.gt) AS label, arg_max(v{p}.gt, n * 1000 - v{p}.gt) AS pred FROM v{p} JOIN emb e ON e.cell = src GROUP BY src), f{p} AS (SELECT avg(2 * hit / (t + q)) AS f FROM (SELECT k, count(*) FILTER (label = k)::DOUBLE AS t, count(*) FILTER (pred = k) AS q, count(*) FILTER (label = k AND pred = k) AS hit FROM p{p}, (SELECT label AS k FROM p{p} UNION SELECT pred FROM p{p}) GROUP BY k))" for p in (0, 1)) + " SELECT round((f0.f + f1.f) / 2, 6) AS label_transfer FROM f0, f1"))(
    lambda s, d: rounded(geo.label_transfer(labelled(s, d, batch="batch").where("batch = 0"), labelled(s, d, batch="batch").where("batch <> 0")), "label_transfer")
)
query("e20_auc", "WITH b AS (SELECT o_totalprice AS score, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS p FROM orders GROUP BY ALL), c AS (SELECT *, coalesce(sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(p * (below + (n - p) / 2.0::DOUBLE)) / (sum(p) * sum(n - p))::DOUBLE, 6) AS auc FROM c")(
    lambda s, d: rounded(geo.auc(roles.table(s, d, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("positive"))), "auc")
)


def prices(s, d) -> DataFrame:
    """Counts of the same cells and features by another measure."""
    return roles.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature")).agg(F.round(F.sum("l_tax") * 100).alias("x"))


PRICES = ", prices AS (SELECT l_suppkey AS cell, l_partkey AS feature, round(sum(l_tax) * 100) AS x FROM lineitem GROUP BY ALL), bth AS (SELECT coalesce(c.cell, p.cell) AS cell, coalesce(c.feature, p.feature) AS feature, coalesce(c.x, 0) AS p, coalesce(p.x, 0) AS q FROM counts c FULL JOIN prices p ON c.cell = p.cell AND c.feature = p.feature)"
for _by, _n, _count in (("cell", "(SELECT count(*) FROM part)", lambda s, d: roles.table(s, d, "part").count()), ("feature", "(SELECT count(*) FROM supplier)", cells_of)):
    query(f"e21_pearson_by_{_by}", with_roles("counts", body=PRICES + f", t AS (SELECT {_by}, sum(p) AS p, sum(q) AS q, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, {_n}::DOUBLE AS n FROM bth GROUP BY ALL) SELECT {_by}, round((n * pq - p * q) / sqrt((n * pp - p * p) * (n * qq - q * q)), 6) AS pearson FROM t WHERE (n * pp - p * p) * (n * qq - q * q) > 0"))(
        lambda s, d, by=_by, count=_count: rounded(geo.correlations(roles.counts(s, d), prices(s, d), by, count(s, d)).where("pearson IS NOT NULL"), "pearson")
    )
query("w7_spearman", with_roles("counts", body=PRICES + ", k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY p) + (count(*) OVER (PARTITION BY feature, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY feature ORDER BY q) + (count(*) OVER (PARTITION BY feature, q) - 1) / 2.0 AS rq FROM bth) SELECT feature, round(corr(rp, rq), 6) AS spearman FROM k GROUP BY feature"))(
    lambda s, d: rounded(geo.spearman(roles.counts(s, d), prices(s, d), "feature", roles.counts(s, d)), "spearman")
)
query("e24_metacell_correlation", with_roles("emb", body=", l AS (SELECT cell, gt, i, v[i] AS x FROM emb, range(1, 65) r(i)), m AS (SELECT gt, i, avg(x) AS m FROM l GROUP BY ALL) SELECT cell, round(corr(x, m), 6) AS pearson FROM l JOIN m USING (gt, i) GROUP BY cell"))(
    lambda s, d: rounded(geo.metacell_correlation(labelled(s, d)), "pearson")
)
query("e22_correlation_distance", with_roles("m1", "m2", body="".join(f", l{i} AS (SELECT cell, k, v[k] AS x FROM m{i}, range(1, 33) r(k)), r{i} AS (SELECT a.k, b.k AS e, corr(a.x, b.x) AS r FROM l{i} a JOIN l{i} b USING (cell) GROUP BY ALL)" for i in (1, 2)) + " SELECT round(1 - sum(p.r * q.r) / (sqrt(sum(p.r * p.r)) * sqrt(sum(q.r * q.r))), 6) AS cmd FROM r1 p JOIN r2 q USING (k, e)"))(
    lambda s, d: rounded(geo.correlation_matrix_distance(m1(s, d), m2(s, d)), "cmd")
)
# mixing
LISI = KNN20 + ", lc AS (SELECT src, {0} AS label, count(*) AS n FROM g JOIN emb ON dst = cell GROUP BY ALL), li AS (SELECT src, 1 / sum(power(n / 20.0::DOUBLE, 2)) AS l FROM lc GROUP BY src)"
query("l1_ilisi", with_roles("emb", body=LISI.format("batch") + " SELECT round((quantile_cont(l, 0.5) - 1) / (3 - 1), 6) AS ilisi FROM li"))(lambda s, d: rounded(mix.ilisi(knn20(s, d), emb(s, d).select("cell", F.col("batch").alias("label"))), "ilisi"))
query("l2_clisi", with_roles("emb", body=LISI.format("gt") + " SELECT round(((SELECT count(DISTINCT gt) FROM emb) - quantile_cont(l, 0.5)) / ((SELECT count(DISTINCT gt) FROM emb) - 1), 6) AS clisi FROM li"))(
    lambda s, d: rounded(mix.clisi(knn20(s, d), emb(s, d).select("cell", F.col("gt").alias("label"))), "clisi")
)
CHI = ", sh AS (SELECT batch, count(*) / (SELECT count(*) FROM emb)::DOUBLE AS share FROM emb GROUP BY batch), ob AS (SELECT src, batch, count(*) AS n FROM {0} g JOIN emb ON dst = cell GROUP BY ALL), kk AS (SELECT src, sum(n) AS k FROM ob GROUP BY src), ch AS (SELECT kk.src, any_value(k) AS k, sum(power(coalesce(n, 0) - share * k, 2) / (share * k)) AS chi2 FROM kk JOIN sh ON true LEFT JOIN ob ON ob.src = kk.src AND ob.batch = sh.batch GROUP BY kk.src)"
query("l4_kbet", with_roles("emb", body=KNN20 + CHI.format("g") + " SELECT round(1 - avg((chi2 > 5.991464547107979)::INT), 6) AS kbet FROM ch"))(lambda s, d: rounded(mix.kbet(knn20(s, d), emb(s, d).select("cell", "batch")), "kbet"))
query("l5_kbet_by_label", with_roles("emb", body=KNN20 + """, lz AS (SELECT gt, sum(n) AS cells, count(*) AS batches, avg(n) AS mean FROM (SELECT gt, batch, count(*) AS n FROM emb GROUP BY ALL) GROUP BY gt), ok AS (SELECT gt, least(70, greatest(10, floor(mean / 4))) AS k0 FROM lz WHERE cells >= 10 AND batches > 1),
tk AS (SELECT src, dst FROM (SELECT src, dst, k0, row_number() OVER (PARTITION BY src ORDER BY dst) AS p FROM g JOIN emb ON cell = src JOIN ok USING (gt)) WHERE p <= least(k0, 50))""" + CHI.format("tk") + " SELECT gt AS label, round(avg((chi2 > 5.991464547107979)::INT), 6) AS kbet FROM ch JOIN emb ON cell = src WHERE k >= 5 GROUP BY gt"))(
    lambda s, d: rounded(mix.kbet_by_label(knn20(s, d), emb(s, d).select("cell", F.col("gt").alias("label"), "batch")), "kbet")
)
query("l6_graph_connectivity", with_roles("emb", body=nearest("g", "emb", "emb", 14, where="a.cell <> b.cell") + """, e AS (SELECT src, dst FROM g JOIN emb p ON p.cell = src JOIN emb q ON q.cell = dst WHERE p.gt = q.gt), l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(x, y) AS (SELECT cell, cell FROM emb UNION SELECT r.x, l.dst FROM r JOIN l ON r.y = l.src), c AS (SELECT x, min(y) AS c FROM r GROUP BY x), z AS (SELECT gt, c, count(*) AS n FROM c JOIN emb ON cell = x GROUP BY ALL)
SELECT round(avg(s), 6) AS graph_connectivity FROM (SELECT max(n) / sum(n)::DOUBLE AS s FROM z GROUP BY gt)""", recursive=True))(lambda s, d: rounded(mix.graph_connectivity(labelled(s, d)), "graph_connectivity"))
MORAN = nearest("g", "coords", "coords", 3, where="a.cell <> b.cell") + ", z AS (SELECT cell, pred - (SELECT avg(pred) FROM emb) AS z FROM emb), sm AS (SELECT sum(1 / 3.0::DOUBLE) AS s0, sum(p.z * q.z / 3) AS c, sum(power(p.z - q.z, 2) / 3) AS gp FROM g JOIN z p ON p.cell = src JOIN z q ON q.cell = dst), sq AS (SELECT sum(z * z) AS sq, count(*) AS n FROM z)"
query("l7_moran_geary", with_roles("coords", body=MORAN + " SELECT round(n / s0 * c / sq, 6) AS morans_i, round((n - 1) / (2 * s0) * gp / sq, 6) AS gearys_c FROM sm, sq"))(
    lambda s, d: rounded(mix.moran_geary(neighbours.knn(coords(s, d), coords(s, d), 3, itself=False), emb(s, d).select("cell", F.col("pred").alias("value"))), "morans_i", "gearys_c")
)
query("l8_moran_columns", with_roles("coords", body=nearest("g", "coords", "coords", 3, where="a.cell <> b.cell") + """, lo AS (SELECT cell, 'batch' AS name, batch::DOUBLE AS x FROM emb UNION ALL SELECT cell, 'gt', gt FROM emb UNION ALL SELECT cell, 'pred', pred FROM emb), z AS (SELECT cell, name, x - avg(x) OVER (PARTITION BY name) AS z FROM lo),
sm AS (SELECT p.name AS name, sum(1 / 3.0::DOUBLE) AS s0, sum(p.z * q.z / 3) AS c FROM g JOIN z p ON p.cell = src JOIN z q ON q.cell = dst AND q.name = p.name GROUP BY ALL), sq AS (SELECT name, sum(z * z) AS sq, count(*) AS n FROM z GROUP BY name) SELECT name, round(n / s0 * c / sq, 6) AS morans_i FROM sm JOIN sq USING (name)"""))(
    lambda s, d: rounded(mix.moran_columns(neighbours.knn(coords(s, d), coords(s, d), 3, itself=False), emb(s, d), ["batch", "gt", "pred"]), "morans_i")
)
query("l9_ilisi_90", with_roles("emb", body=nearest("g", "emb", "emb", 90) + ", lc AS (SELECT src, batch AS label, count(*) AS n FROM g JOIN emb ON dst = cell GROUP BY ALL), li AS (SELECT src, 1 / sum(power(n / 90.0::DOUBLE, 2)) AS l FROM lc GROUP BY src) SELECT round((quantile_cont(l, 0.5) - 1) / (3 - 1), 6) AS ilisi FROM li"))(
    lambda s, d: rounded(mix.ilisi(neighbours.knn(emb(s, d), emb(s, d), 90), emb(s, d).select("cell", F.col("batch").alias("label"))), "ilisi")
)
PERPLEXITY = nearest("g", "emb", "emb", 30, where="a.cell <> b.cell") + """, st(src, low, high, beta, step) AS (SELECT cell, 0.0::DOUBLE, 1e12::DOUBLE, 1.0::DOUBLE, 0 FROM emb UNION ALL
SELECT src, CASE WHEN up THEN beta ELSE low END, CASE WHEN up THEN high ELSE beta END, CASE WHEN NOT up THEN (beta + low) / 2 WHEN high > 1e11 THEN beta * 2 ELSE (beta + high) / 2 END, step + 1
FROM (SELECT st.src, any_value(low) AS low, any_value(high) AS high, any_value(beta) AS beta, any_value(step) AS step, ln(sum(exp(-beta * dist))) + any_value(beta) * sum(dist * exp(-beta * dist)) / sum(exp(-beta * dist)) > ln(10.0::DOUBLE) AS up FROM st JOIN g ON g.src = st.src WHERE step < 50 GROUP BY st.src)),
w AS (SELECT g.src, batch, sum(exp(-beta * dist)) AS w FROM g JOIN st ON st.src = g.src AND step = 50 JOIN emb ON cell = dst GROUP BY ALL) SELECT src AS cell, round(1 / sum(power(w / t, 2)), 5) AS lisi FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS t FROM w) GROUP BY src"""
query("l3_perplexity_lisi", with_roles("emb", body=PERPLEXITY, recursive=True))(lambda s, d: mix.perplexity_lisi(neighbours.knn(emb(s, d), emb(s, d), 30, itself=False), emb(s, d).select("cell", F.col("batch").alias("label")), 10).withColumn("lisi", F.round("lisi", 5)))


def report(parts: list[DataFrame]) -> DataFrame:
    """(metric, value) of one-row tables."""
    long = [p.unpivot([], p.columns, "metric", "value") for p in parts]
    return reduce(DataFrame.unionAll, long)


def batch_report(s, d) -> DataFrame:
    """Batch mixing: silhouette over batches, iLISI, kBET, connectivity."""
    e, edges = emb(s, d), cut(knn20(s, d))
    points = e.select("cell", "v", "batch", F.col("gt").alias("grp"))
    return report([geo.silhouette_batch(points), mix.ilisi(edges, e.select("cell", F.col("batch").alias("label"))), mix.kbet(edges, e.select("cell", "batch")), mix.graph_connectivity(labelled(s, d))])


def label_report(s, d) -> DataFrame:
    """Agreement, geometry and neighbourhood metrics of a labelled embedding."""
    e, edges, t = emb(s, d), cut(knn20(s, d)), cut(table(s, d))
    points = labelled(s, d)
    return report([
        lab.pair_metrics(t), lab.purity(t), lab.information_metrics(t), lab.adjusted_information(t).select("ami"), geo.silhouette_score(points), geo.dispersion_metrics(points),
        mix.clisi(edges, e.select("cell", F.col("gt").alias("label"))), mix.moran_geary(neighbours.knn(coords(s, d), coords(s, d), 3, itself=False), e.select("cell", F.col("pred").alias("value"))),
    ])


def long_sql(parts: list[tuple[str, tuple[str, ...]]]) -> str:
    """The columns of one-row queries as rows."""
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS value FROM ({sql})" for sql, columns in parts for c in columns)


query("b1_label_report", long_sql([
    (SQL["m3_m10_pair_metrics"], ("precision", "recall", "f_measure", "jaccard", "dice", "fmi", "ari")), (SQL["m1_purity"], ("purity",)),
    (SQL["m9_m14_information"], ("nmi", "homogeneity", "completeness", "v_measure")), (SQL["m11_adjusted_information"], ("ami",)),
    (with_roles("emb", body=sil("emb", "gt::VARCHAR") + " SELECT round(avg(s), 6) AS silhouette FROM sl"), ("silhouette",)),
    (SQL["e8_e9_dispersion"], ("calinski_harabasz", "davies_bouldin")), (SQL["l2_clisi"], ("clisi",)), (SQL["l7_moran_geary"], ("morans_i", "gearys_c")),
]))(lambda s, d: rounded(label_report(s, d), "value"))
BATCH_SIL = with_roles("emb", body=sil("emb", "batch::VARCHAR", "gt::VARCHAR") + ", gb AS (SELECT grp, count(DISTINCT label) AS b, count(*) AS n FROM pt GROUP BY grp) SELECT round(avg(m), 6) AS silhouette_batch FROM (SELECT grp, avg(1 - abs(s)) AS m FROM sl GROUP BY grp) JOIN gb USING (grp) WHERE b > 1 AND b < n")
query("b2_batch_report", long_sql([(BATCH_SIL, ("silhouette_batch",)), (SQL["l1_ilisi"], ("ilisi",)), (SQL["l4_kbet"], ("kbet",)), (SQL["l6_graph_connectivity"], ("graph_connectivity",))]))(lambda s, d: rounded(batch_report(s, d), "value"))
