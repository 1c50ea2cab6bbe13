"""Queries of sources, filters, normalisation, alignment and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, mixing_metrics, prep, timed
from ..sources import bundles, roles
from ..sources.roles import with_roles

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


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to six places, without negative zeros."""
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


def cells_of(s, d) -> int:
    return roles.table(s, d, "supplier").count()


def regions_of(s, d) -> list[int]:
    """The batches, one for each region that has a supplier."""
    return sorted(r[0] for r in roles.cell_batches(s, d).select("batch").distinct().collect())


def local_fit_sql(of: str, out: str) -> str:
    """Common table expressions of the local regression: (grp, feature, mean, expected) as ``out``, from (grp, feature, mean, u, w)."""
    return f""", {out}n AS MATERIALIZED (SELECT grp, greatest(1, floor(count(*) * 0.3::DOUBLE + 0.00001)) AS q FROM {of} GROUP BY grp),
{out}d AS (SELECT a.grp, a.feature, a.mean, b.u - a.u AS d, b.w, row_number() OVER (PARTITION BY a.grp, a.feature ORDER BY abs(b.u - a.u)) AS r FROM {of} a JOIN {of} b ON a.grp = b.grp),
{out}w AS (SELECT x.*, greatest(max(abs(d)) OVER (PARTITION BY x.grp, feature), 0) AS far FROM {out}d x JOIN {out}n y ON x.grp = y.grp WHERE r <= q),
{out}s AS (SELECT grp, feature, any_value(mean) AS mean, sum(k) AS s0, sum(k * d) AS s1, sum(k * d * d) AS s2, sum(k * d * d * d) AS s3, sum(k * d * d * d * d) AS s4, sum(k * w) AS t0, sum(k * d * w) AS t1, sum(k * d * d * w) AS t2
FROM (SELECT *, CASE WHEN far > 0 THEN power(1 - power(abs(d) / far, 3), 3) ELSE 1 END AS k FROM {out}w) GROUP BY grp, feature),
{out} AS MATERIALIZED (SELECT grp, feature, mean, power(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) / 2) AS expected FROM {out}s)"""


N_CELLS = "(SELECT count(*) FROM supplier)"

query("s1_counts", with_roles("counts", body=" SELECT cell, feature, x FROM counts"))(roles.counts)
query("s3_dense_to_long", "SELECT * FROM (SELECT vec_id AS cell, unnest(range(0, 64))::INT AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x <> 0")(
    lambda s, d: bundles.dense_to_counts(roles.embeddings(s, d)).withColumnRenamed("feature", "d")
)
query("s8_roles", with_roles("emb", body=" SELECT cell, gt, pred, batch FROM emb"))(lambda s, d: roles.embeddings(s, d).select("cell", "gt", "pred", "batch"))
query("p1_filter_features", with_roles("counts", body=" SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts WHERE x <> 0 GROUP BY feature HAVING count(*) >= 27)"))(
    lambda s, d: prep.filter_features(roles.counts(s, d), min_cells=27).select("cell", "feature", "x")
)
query("p2_filter_fraction", with_roles("counts", body=f" SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts WHERE x <> 0 GROUP BY feature HAVING count(*) >= floor({N_CELLS} * 0.25))"))(
    lambda s, d: prep.filter_features(roles.counts(s, d), fraction=0.25, n_cells=cells_of(s, d)).select("cell", "feature", "x")
)
query("p3_filter_cells", with_roles("counts", body=" SELECT * FROM counts WHERE cell IN (SELECT cell FROM counts WHERE x <> 0 GROUP BY cell HAVING count(*) >= 517)"))(
    lambda s, d: prep.filter_cells(roles.counts(s, d), min_features=517).select("cell", "feature", "x")
)
query("p4_filter_totals", with_roles("counts", body=" SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING sum(x) >= 700)"))(
    lambda s, d: prep.filter_features(roles.counts(s, d), min_counts=700).select("cell", "feature", "x")
)
query("p9_gene_selection", with_roles("counts", body=f""", seen AS (SELECT feature, count(*) AS cells, avg(log2(x)) AS m FROM counts WHERE x > 0 GROUP BY feature HAVING count(*) >= 10)
SELECT feature, round(1 - cells / {N_CELLS}::DOUBLE, 6) AS zero_rate, round(m, 6) AS mean_log2, 1 - cells / {N_CELLS}::DOUBLE > exp(-1.5 * (m - 5)) + 0.02 AS chosen FROM seen"""))(
    lambda s, d: rounded(prep.gene_selection(roles.counts(s, d), cells_of(s, d))[0], "zero_rate", "mean_log2")
)
BISECTED = f""", seen AS MATERIALIZED (SELECT feature, 1 - count(*) / {N_CELLS}::DOUBLE AS zero_rate, avg(log2(x)) AS m FROM counts WHERE x > 0 GROUP BY feature HAVING count(*) >= 10),
bs(low, up, pos, k, found) AS (SELECT 0.0::DOUBLE, 10.0::DOUBLE, 5.0::DOUBLE, 0, (SELECT count(*) FROM seen WHERE zero_rate > exp(-1.5 * (m - 5)) + 0.02)
UNION ALL SELECT low, up, pos, k, (SELECT count(*) FROM seen WHERE zero_rate > exp(-1.5 * (m - pos)) + 0.02) FROM (SELECT CASE WHEN found < 200 THEN low ELSE pos END AS low, CASE WHEN found < 200 THEN pos ELSE up END AS up, CASE WHEN found < 200 THEN (pos + low) / 2 ELSE (pos + up) / 2 END AS pos, k + 1 AS k FROM bs WHERE found <> 200 AND k < 100))"""
query("p9_gene_selection_n", with_roles("counts", body=BISECTED + " SELECT feature, round(zero_rate, 6) AS zero_rate, round(m, 6) AS mean_log2, zero_rate > exp(-1.5 * (m - (SELECT arg_max(pos, k) FROM bs))) + 0.02 AS chosen FROM seen", recursive=True))(
    lambda s, d: rounded(prep.gene_selection(roles.counts(s, d), cells_of(s, d), n=200)[0], "zero_rate", "mean_log2")
)
query("p10_keep_features", with_roles("counts", body=" SELECT * FROM counts WHERE feature IN (SELECT p_partkey FROM part WHERE p_size <= 10)"))(
    lambda s, d: prep.keep_features(roles.counts(s, d), roles.table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("feature"))).select("cell", "feature", "x")
)
query("p11_keep_cells", with_roles("counts", body=" SELECT * FROM counts WHERE cell IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 4500)"))(
    lambda s, d: prep.keep_cells(roles.counts(s, d), roles.table(s, d, "supplier").where("s_acctbal >= 4500").select(F.col("s_suppkey").alias("cell"))).select("cell", "feature", "x")
)
query("p14_folded_names", "SELECT DISTINCT lower(p_brand) AS feature FROM part WHERE p_size <= 25 INTERSECT SELECT lower(p_brand) FROM part WHERE p_size > 25")(
    lambda s, d: align.shared_names([roles.table(s, d, "part").where("p_size <= 25").select(F.upper("p_brand").alias("feature")), roles.table(s, d, "part").where("p_size > 25").select(F.col("p_brand").alias("feature"))], fold=True)
)
query("j17_required_names", "SELECT DISTINCT p_brand AS feature FROM part WHERE p_size <= 25 INTERSECT SELECT p_brand FROM part WHERE p_size > 25")(
    lambda s, d: align.shared_names([roles.table(s, d, "part").where(w).select(F.col("p_brand").alias("feature")) for w in ("p_size <= 25", "p_size > 25")], required=True)
)
query("p17_drop_zero_cells", with_roles("counts", "adt", body=" SELECT 'a' AS side, cell, feature::VARCHAR AS feature, x FROM counts WHERE cell IN (SELECT cell FROM adt) UNION ALL SELECT 'b', cell, feature, x FROM adt WHERE cell IN (SELECT cell FROM counts)"))(
    lambda s, d: both_sides(*prep.drop_zero_cells(roles.counts(s, d), roles.adt(s, d)))
)
query("p18_check_whole", with_roles("counts", body=" SELECT cell, feature, x FROM counts"))(lambda s, d: prep.check_whole(roles.counts(s, d)))
query("p22_flip", with_roles("coords", body=" SELECT cell, -x AS x, y FROM coords"))(lambda s, d: prep.flip(roles.coordinates(roles.embeddings(s, d)).select("cell", "x", "y")))
query("p12_unique_names", """SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '-' || (n - 1) ELSE p_brand END AS p_brand
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")(
    lambda s, d: prep.unique_names(roles.table(s, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")
)
query("p13_marker_names", "SELECT p_partkey, replace(replace(replace(replace(n, '-', '_'), 'Mouse', 'mouse'), 'Human', 'human'), 'Rat', 'rat') AS marker FROM (SELECT p_partkey, 'Mouse-' || p_name AS n FROM part)")(
    lambda s, d: roles.table(s, d, "part").select("p_partkey", prep.marker_name(F.concat(F.lit("Mouse-"), "p_name")).alias("marker"))
)
query("p15_parse_region", with_roles("peaks", body=" SELECT event_id, seqname, \"start\", \"end\" FROM peaks"))(
    lambda s, d: roles.peaks(s, d).select("event_id", align.parse_region(F.concat("seqname", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))).alias("r")).select("event_id", "r.*")
)
query("p16_binarize", with_roles("counts", body=" SELECT cell, feature, (x > 25)::INT AS x FROM counts"))(lambda s, d: prep.binarize(roles.counts(s, d), 25))
query("p19_long_filter", """SELECT o_orderpriority AS model, r_name AS sample, o_orderstatus AS metric, round(avg(o_totalprice), 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderstatus IN ('F', 'O') GROUP BY ALL""")(
    lambda s, d: rounded(bench_table(s, d).where(F.col("sample").isin("ASIA", "EUROPE") & F.col("metric").isin("F", "O")), "value")
)
query("p23_rescale", with_roles("coords", body=", e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM coords) SELECT cell, round((x - a) / (b - a) * 20, 6) AS x, round((y - c) / (d - c) * 20, 6) AS y FROM coords, e"))(
    lambda s, d: rounded(prep.rescale(roles.coordinates(roles.embeddings(s, d)).select("cell", "x", "y"), 20.0), "x", "y")
)
query("p24_inducing_points", "SELECT a * (20.0::DOUBLE / 5) AS x, b * (20.0::DOUBLE / 5) AS y FROM range(6) p(a), range(6) q(b)")(lambda s, d: prep.inducing_points(s, 6, 20.0))
query("p24_inducing_grid", with_roles("coords", body=" SELECT round(x0 + a * ((x1 - x0) / 5), 6) AS x, round(y0 + b * ((y1 - y0) / 5), 6) AS y FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM coords), range(6) p(a), range(6) q(b)"))(
    lambda s, d: rounded(prep.inducing_grid(roles.coordinates(roles.embeddings(s, d)), 6), "x", "y")
)
query("p26_fragments", with_roles("counts", body=" SELECT cell, feature, ceil(x / 2)::BIGINT AS x FROM counts"))(lambda s, d: prep.reads_to_fragments(roles.counts(s, d)))
query("p27_codes", "SELECT s_suppkey, s_nationkey, (dense_rank() OVER (ORDER BY s_nationkey) - 1)::INT AS code FROM supplier")(
    lambda s, d: prep.codes(roles.table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "s_nationkey", "code")
)
query("p29_prefixed", with_roles("emb", body=" SELECT 's' || batch || '_' || cell AS cell, batch FROM emb"))(lambda s, d: align.prefixed(roles.embeddings(s, d).select("cell", "batch")))
query("a2_size_factors", with_roles("counts", body=", t AS (SELECT cell, sum(x) AS total FROM counts GROUP BY cell) SELECT cell, total, round(total / (SELECT quantile_cont(total, 0.5) FROM t), 6) AS size_factor FROM t"))(
    lambda s, d: rounded(prep.size_factors(roles.counts(s, d)), "size_factor")
)
STATS = f""", m AS (SELECT *, sum(x) OVER (PARTITION BY feature) / {N_CELLS} AS mean FROM counts),
stats AS (SELECT feature, count(*) AS n, any_value(mean) AS mean, sqrt((sum((x - mean) * (x - mean)) + ({N_CELLS} - count(*)) * any_value(mean) * any_value(mean)) / ({N_CELLS} - 1)) AS std FROM m GROUP BY feature)"""
query("a3_feature_stats", with_roles("counts", body=STATS + " SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"))(
    lambda s, d: rounded(prep.feature_stats(roles.counts(s, d), cells_of(s, d)), "mean", "std")
)
query("a1_pseudo_bulk", with_roles("counts", "cell_batches", body=""", z AS (SELECT batch, count(*) AS n FROM cell_batches GROUP BY batch)
SELECT batch::VARCHAR AS sample, feature, round(sum(x) / any_value(n), 6) AS x FROM counts JOIN cell_batches USING (cell) JOIN z USING (batch) GROUP BY ALL"""))(
    lambda s, d: rounded(prep.pseudo_bulk(roles.counts(s, d), roles.cell_batches(s, d).withColumnRenamed("batch", "label")), "x")
)
query("a6_batch_shares", with_roles("emb", body=" SELECT batch, round(count(*) / (SELECT count(*) FROM emb)::DOUBLE, 6) AS share FROM emb GROUP BY batch"))(
    lambda s, d: rounded(mixing_metrics.batch_shares(roles.embeddings(s, d)), "share")
)
query("a13_posterior", """SELECT o_orderpriority AS feature, round(avg(l), 6) AS mean, round(quantile_cont(l, 0.5), 6) AS median, round(stddev_pop(l), 6) AS sd, round(avg((abs(l) >= 0.5)::INT), 6) AS p_de
FROM (SELECT o_orderpriority, log2(o_totalprice / 150000) AS l FROM orders) GROUP BY ALL""")(
    lambda s, d: rounded(prep.posterior_summary(roles.table(s, d, "orders").select(F.col("o_orderpriority").alias("feature"), F.log2(F.col("o_totalprice") / 150000).alias("lfc")), 0.5), "mean", "median", "sd", "p_de")
)
query("n1_normalize_total", with_roles("counts", body=" SELECT cell, feature, round(x / sum(x) OVER (PARTITION BY cell) * 10000, 6) AS x FROM counts"))(lambda s, d: rounded(prep.normalize_total(roles.counts(s, d)), "x"))
query("n2_normalize_median", with_roles("counts", body=", t AS (SELECT quantile_cont(t, 0.5) AS m FROM (SELECT sum(x) AS t FROM counts GROUP BY cell)) SELECT cell, feature, round(x / sum(x) OVER (PARTITION BY cell) * m, 6) AS x FROM counts, t"))(
    lambda s, d: rounded(prep.normalize_total(roles.counts(s, d), None), "x")
)
query("n3_log1p", with_roles("counts", body=" SELECT cell, feature, round(ln(1 + x), 6) AS x FROM counts"))(lambda s, d: rounded(prep.log1p(roles.counts(s, d)), "x"))
query("n4_scale", with_roles("counts", body=STATS + " SELECT cell, feature, round((x - s.mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS x, round(-s.mean / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS zero FROM counts JOIN stats s USING (feature)"))(
    lambda s, d: rounded(prep.scale(roles.counts(s, d), cells_of(s, d)), "x", "zero")
)
query("n5_clr_all", with_roles("adt", body=" SELECT cell, feature, round(ln(1 + x / exp(sum(ln(1 + x)) OVER (PARTITION BY cell) / 5)), 6) AS x FROM adt"))(lambda s, d: rounded(prep.clr_all(roles.adt(s, d), 5), "x"))
query("n6_clr_present", with_roles("adt", body=" SELECT cell, feature, round(ln(x) - avg(ln(x)) OVER (PARTITION BY cell), 6) AS x, round(exp(avg(ln(x)) OVER (PARTITION BY cell)), 6) AS gmean FROM adt WHERE x > 0"))(
    lambda s, d: rounded(prep.clr_present(roles.adt(s, d)), "x", "gmean")
)
TF, IDF = "x / sum(x) OVER (PARTITION BY cell)", f"{N_CELLS}::DOUBLE / sum(x) OVER (PARTITION BY feature)"
for name, kind, sql in (
    ("n7_tfidf_plain", "plain", f"({TF}) * ({IDF})"), ("n9_tfidf_log", "log", f"({TF}) * ln(1 + {IDF})"), ("n10_tfidf_scaled", "scaled", f"ln(1 + 10000 * ({TF}) * ({IDF}))"),
    ("n8_tfidf_guarded", "guarded", f"x / (sum(x) OVER (PARTITION BY cell) + 1e-8) * ({N_CELLS}::DOUBLE / (sum(x) OVER (PARTITION BY feature) + 1e-8))"),
):
    query(name, with_roles("counts", body=f" SELECT cell, feature, round({sql}, 6) AS x FROM counts"))(lambda s, d, kind=kind: rounded(prep.tfidf(roles.counts(s, d), cells_of(s, d), kind), "x"))
query("n11_tfidf_documents", with_roles("terms", body=", w AS (SELECT cell, feature, x * ln((SELECT count(*) FROM documents)::DOUBLE / count(*) OVER (PARTITION BY feature)) AS x FROM terms), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cell)) AS l FROM w) SELECT cell, feature, round(CASE WHEN l = 0 THEN 0 ELSE x / l END, 6) AS x FROM n"))(
    lambda s, d: rounded(prep.tfidf_texts(roles.texts(s, d)), "x")
)
query("n12_l1_log", with_roles("counts", body=" SELECT cell, feature, round(ln(1 + x / sum(abs(x)) OVER (PARTITION BY cell) * 10000), 6) AS x FROM counts"))(lambda s, d: rounded(prep.l1_log(roles.counts(s, d)), "x"))
query("n18_fold_change", with_roles("counts", body=""", g AS (SELECT s_suppkey AS cell, CASE WHEN s_acctbal >= 4500 THEN 'a' ELSE 'b' END AS grp FROM supplier), n AS (SELECT count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM g),
m AS (SELECT feature, coalesce(sum(x) FILTER (grp = 'a'), 0) / any_value(na) AS mean_a, coalesce(sum(x) FILTER (grp = 'b'), 0) / any_value(nb) AS mean_b FROM counts JOIN g USING (cell), n GROUP BY feature)
SELECT feature, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(log2(mean_a + 0.05) - log2(mean_b + 0.05), 6) AS lfc FROM m"""))(
    lambda s, d: rounded(prep.fold_changes(roles.counts(s, d), roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.when(F.col("s_acctbal") >= 4500, "a").otherwise("b").alias("group"))), "mean_a", "mean_b", "lfc")
)
query("p7_dispersion", with_roles("counts", body=f""", l AS (SELECT * FROM counts), m AS (SELECT *, sum(x) OVER (PARTITION BY feature) / {N_CELLS} AS mean FROM l),
st AS (SELECT feature, any_value(mean) AS mean, (sum((x - mean) * (x - mean)) + ({N_CELLS} - count(*)) * any_value(mean) * any_value(mean)) / ({N_CELLS} - 1) AS var FROM m GROUP BY feature),
d AS (SELECT feature, ln(1 + mean) AS m, ln(var / mean) AS d FROM st), b AS (SELECT *, least(floor((m - (SELECT min(m) FROM d)) / ((SELECT max(m) - min(m) FROM d) / 20)), 19) AS bin FROM d),
z AS (SELECT feature, m, d, stddev_samp(d) OVER (PARTITION BY bin) AS sd, avg(d) OVER (PARTITION BY bin) AS av FROM b)
SELECT feature, round(m, 6) AS mean, round((d - CASE WHEN sd IS NULL THEN 0 ELSE av END) / CASE WHEN sd IS NULL THEN av ELSE sd END, 6) AS score FROM z"""))(
    lambda s, d: rounded(prep.dispersion_features(prep.log1p(roles.counts(s, d)), 300, cells_of(s, d)).select("feature", "mean", "score"), "mean", "score")
)
query("p8_dispersion_percentile", with_roles("counts", body=f""", m AS (SELECT *, sum(x) OVER (PARTITION BY feature) / {N_CELLS} AS mean FROM counts), st AS (SELECT feature, any_value(mean) AS mean, (sum((x - mean) * (x - mean)) + ({N_CELLS} - count(*)) * any_value(mean) * any_value(mean)) / ({N_CELLS} - 1) AS var FROM m GROUP BY feature),
b AS (SELECT feature, ln(1 + mean) AS m, var / mean AS d, ntile(20) OVER (ORDER BY round(mean, 9), feature) AS bin FROM st), q AS (SELECT bin, quantile_cont(d, 0.5) AS md FROM b GROUP BY bin), o AS (SELECT b.*, md, abs(d - md) AS o FROM b JOIN q USING (bin)), w AS (SELECT bin, quantile_cont(o, 0.5) AS mad FROM o GROUP BY bin)
SELECT feature, round(m, 6) AS mean, round((d - md) / CASE WHEN mad = 0 THEN NULL ELSE mad END, 5) AS score FROM o JOIN w USING (bin)"""))(
    lambda s, d: rounded(prep.dispersion_features(prep.log1p(roles.counts(s, d)), 300, cells_of(s, d), flavour="percentile").select("feature", "mean", F.round("score", 5).alias("score")), "mean")
)
STABILISED = """, gs AS MATERIALIZED (SELECT grp, count(*) AS n FROM cg GROUP BY grp), gc AS MATERIALIZED (SELECT grp, cell, feature, x FROM counts JOIN cg USING (cell)),
st AS (SELECT grp, feature, count(*) AS k, sum(x) / any_value(n) AS mean, any_value(n) AS n, var_pop(x) * count(*) AS v, avg(x) AS a FROM gc JOIN gs USING (grp) GROUP BY grp, feature),
uw AS MATERIALIZED (SELECT grp, feature, mean, log10(mean) AS u, log10(var) AS w FROM (SELECT *, (v + k * power(a - mean, 2) + (n - k) * mean * mean) / (n - 1) AS var FROM st) WHERE mean > 0 AND var > 0)""" + local_fit_sql("uw", "lf") + """,
sc AS MATERIALIZED (SELECT grp, feature, (sum(power(least(sqrt(n), (x - mean) / expected), 2)) + (any_value(n) - count(*)) * power(any_value(mean) / any_value(expected), 2)) / (any_value(n) - 1) AS score FROM gc JOIN lf USING (grp, feature) JOIN gs USING (grp) GROUP BY grp, feature),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, feature) AS place FROM sc)"""
query("p5_stabilised_features", with_roles("counts", body=", cg AS (SELECT s_suppkey AS cell, 0 AS grp FROM supplier)" + STABILISED + " SELECT feature, round(score, 5) AS score, place <= 300 AS chosen FROM rk"))(
    lambda s, d: prep.stabilised_features(roles.counts(s, d), 300, cells_of(s, d)).select("feature", F.round("score", 5).alias("score"), "chosen")
)
query("p6_features_by_batch", with_roles("counts", "cell_batches", body=", cg AS (SELECT cell, batch AS grp FROM cell_batches)" + STABILISED + ", fb AS (SELECT feature, count(*) AS batches, quantile_cont(place, 0.5) AS rank FROM rk WHERE place <= 300 GROUP BY feature) SELECT feature, batches, rank::DOUBLE AS rank, row_number() OVER (ORDER BY rank, batches DESC, feature) <= 300 AS chosen FROM fb"))(
    lambda s, d: prep.features_by_batch(roles.counts(s, d), roles.cell_batches(s, d), 300)
)


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two count tables, one after the other."""
    return a.select(F.lit("a").alias("side"), "cell", F.col("feature").cast("string").alias("feature"), "x").unionAll(b.select(F.lit("b"), "cell", F.col("feature").cast("string"), "x"))


def bench_table(s, d) -> DataFrame:
    """(model, sample, metric, value)."""
    o, c, n, r = (roles.table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    geo = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("model"), F.col("r_name").alias("sample"), F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))


BENCH = """WITH bench AS (SELECT o_orderpriority AS model, r_name AS sample, o_orderstatus AS metric, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
query("b3_wide_table", BENCH + " SELECT sample || '-' || metric AS \"row\"," + ", ".join(f"round(max(value) FILTER (model = '{m}'), 6) AS \"{m}\"" for m in PRIORITIES) + " FROM bench GROUP BY ALL")(
    lambda s, d: rounded(align.wide_table(bench_table(s, d), ["sample", "metric"], "model", "value", PRIORITIES), *PRIORITIES)
)
query("b4_signed_rank", BENCH + """, w AS (SELECT sample, metric, max(value) FILTER (model = '1-URGENT') - max(value) FILTER (model = '5-LOW') AS d FROM bench GROUP BY ALL),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM w WHERE d <> 0) SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0)::DOUBLE AS w_plus FROM r""")(
    lambda s, d: align.signed_rank(align.wide_table(bench_table(s, d), ["sample", "metric"], "model", "value", PRIORITIES), "1-URGENT", "5-LOW")
)
# alignment
PEAKS = """, o AS (SELECT seqname, "start", "end", max("end") OVER (PARTITION BY seqname ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM peaks),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
merged AS (SELECT seqname, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY seqname, island)"""
query("a9_merge_intervals", with_roles("peaks", body=PEAKS + ' SELECT seqname, "start", "end", n FROM merged'))(lambda s, d: align.merge_intervals(roles.peaks(s, d)))
query("j18_contained", with_roles("peaks", body=""", q AS (SELECT seqname, "start" AS q_start, "start" + 40 AS q_end FROM peaks) SELECT event_id, q_start, q_end FROM peaks p JOIN q ON p.seqname = q.seqname AND p."start" >= q_start AND p."end" <= q_end"""))(
    lambda s, d: align.contained(roles.peaks(s, d).select("seqname", "start", (F.col("start") + 40).alias("end")), roles.peaks(s, d)).select("event_id", "q_start", "q_end")
)
query("j19_align_peaks", with_roles("peaks", body=PEAKS + """, inside AS (SELECT p.*, m."start" AS q_start, m."end" AS q_end FROM peaks p JOIN merged m ON p.seqname = m.seqname AND p."start" >= m."start" AND p."end" <= m."end"),
kept AS (SELECT seqname, q_start, q_end FROM inside GROUP BY ALL HAVING count(DISTINCT dataset) = 3 AND q_end - q_start > 20 AND q_end - q_start < 10000)
SELECT dataset, cell, seqname || ':' || q_start || '-' || q_end AS feature, count(*) AS x FROM inside JOIN kept USING (seqname, q_start, q_end) GROUP BY ALL"""))(
    lambda s, d: align.align_peaks(roles.peaks(s, d).withColumn("x", F.lit(1)), 3)
)
query("j16_shared_names", with_roles("counts", "cell_batches", body=", f AS (SELECT DISTINCT batch, feature FROM counts JOIN cell_batches USING (cell)) SELECT feature FROM f GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT batch) FROM cell_batches)"))(
    lambda s, d: align.shared_names([roles.counts(s, d).join(roles.cell_batches(s, d).where(F.col("batch") == b), "cell", "left_semi") for b in regions_of(s, d)])
)
query("j21_shared_cells", "SELECT s_suppkey AS cell FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)")(
    lambda s, d: align.shared_cells([roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("cell")), roles.adt(s, d)])
)
query("j24_first_batch", "SELECT cell, arg_min(batch, i * 100 + batch) AS batch FROM (SELECT s_suppkey AS cell, 1 AS batch, 0 AS i FROM supplier UNION ALL SELECT user_id, 2, 1 FROM events) GROUP BY cell")(
    lambda s, d: align.first_batch([roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.lit(1).alias("batch")), roles.adt(s, d).select("cell", F.lit(2).alias("batch")).distinct()])
)
query("u1_concat_batches", with_roles("counts", "cell_batches", body=""", two AS (SELECT c.*, batch FROM counts c JOIN cell_batches USING (cell) ), shared AS (SELECT feature FROM two GROUP BY feature HAVING count(DISTINCT batch) = (SELECT count(DISTINCT batch) FROM two))
SELECT cell || '-' || batch AS cell, feature, x, batch FROM two WHERE feature IN (SELECT feature FROM shared)"""))(
    lambda s, d: align.concat_batches([roles.counts(s, d).join(roles.cell_batches(s, d).where(F.col("batch") == b), "cell", "left_semi") for b in regions_of(s, d)], regions_of(s, d))
)
query("u2_stack_batches", with_roles("emb", body=" SELECT cell, gt, batch AS src FROM emb"))(
    lambda s, d: align.stack_batches(align.split_batches(roles.embeddings(s, d).select("cell", "gt", "batch"), [0, 1, 2])).select("cell", "gt", "src")
)
query("u7_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(
    lambda s, d: align.missing(roles.table(s, d, "customer"), roles.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")
)
query("u8_distinct", with_roles("emb", body=" SELECT DISTINCT gt, batch FROM emb"))(lambda s, d: roles.embeddings(s, d).select("gt", "batch").distinct())
query("a14_rollup", with_roles("emb", body=" SELECT coalesce(gt, -1) AS gt, coalesce(batch, -1) AS batch, count(*) AS n FROM emb GROUP BY ROLLUP (emb.gt, emb.batch)"))(
    lambda s, d: roles.embeddings(s, d).rollup("gt", "batch").agg(F.count("*").alias("n")).fillna(-1, ["gt", "batch"])
)
# rows with a time
query("w11_recent", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS recent,
lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::INT AS part FROM events""")(
    lambda s, d: rounded(timed.recent(roles.table(s, d, "events"), 3600), "recent")
)
query("n21_time_parts", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, isodow(ts)::INT AS weekday, nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '')::INT AS number FROM events""")(
    lambda s, d: timed.parts(roles.table(s, d, "events"))
)
query("a15_distinct_features", with_roles("counts", body=" SELECT cell, count(DISTINCT feature) AS n FROM counts WHERE x <> 0 GROUP BY cell"))(lambda s, d: timed.distinct_features(roles.counts(s, d)))
