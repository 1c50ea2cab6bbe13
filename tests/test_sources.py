"""Round trips of the formats, and the event stream against a batch."""

import pytest
from pyspark.sql import functions as F

from stratoloom.operators import recipes, reduce
from stratoloom.sources import bundles, roles
from stratoloom.sources.config import load_config
from stratoloom.streaming import events


def test_bundle(spark, tmp_path):
    """What is written is read; missing parts are None."""
    counts = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], bundles.COUNTS)
    bundles.Bundle(counts=counts, cells=spark.createDataFrame([(0, "a")], "cell long, name string")).write(str(tmp_path / "b"))
    got = bundles.load(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, got.counts.collect())) == [(0, 1, 2.0), (1, 0, 3.0)] and got.features is None
    assert bundles.load(spark, counts).counts is counts and bundles.load(spark, got) is got
    both = bundles.read_many(spark, [str(tmp_path / "b"), None], ["x", "y"])
    assert {r["batch"] for r in both.collect()} == {"x"}
    with pytest.raises(ValueError):
        bundles.read_many(spark, [None], ["x"])
    bundles.write_triples(got, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t" / "counts"), header=True).columns == ["i", "j", "x"]


def test_labels(spark, tmp_path):
    """Lines keep their places."""
    labels = spark.createDataFrame([(k, (7 * k) % 5) for k in range(100)], "cell long, label int").repartition(4)
    bundles.write_labels(labels, str(tmp_path / "l"))
    assert sorted(map(tuple, bundles.read_labels(spark, str(tmp_path / "l")).collect())) == [(k, (7 * k) % 5) for k in range(100)]


def test_wide_csv(spark, tmp_path):
    """Columns are routed by prefix; groups that are too small are annotation."""
    (tmp_path / "w.csv").write_text("id,PC1,PC2,PC3,PC4,PC5,RNA1,domain\nc1,1,2,3,4,5,9,A\nc2,0,0,0,0,1,8,B\n")
    got = bundles.read_wide_csv(spark, str(tmp_path / "w.csv"))
    assert set(got) == {"PC", "annotation"} and got["annotation"].columns == ["cell", "RNA1", "domain"]
    assert {r["cell"]: r["v"] for r in got["PC"].collect()} == {"c1": [1.0, 2.0, 3.0, 4.0, 5.0], "c2": [0.0, 0.0, 0.0, 0.0, 1.0]}


def test_sinks(spark, tmp_path):
    """Metrics, matrices, melted tables."""
    bundles.write_metrics(spark.createDataFrame([("ari", 0.5)], "metric string, value double"), str(tmp_path / "m"), "run")
    assert spark.read.csv(str(tmp_path / "m"), header=True).first().asDict() == {"Metric": "ari", "run": "0.5"}
    bundles.write_matrix_csv(spark.createDataFrame([(1, [1.0, 2.0])], "cell long, v array<double>"), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first()[0] == "1.000000e+00,2.000000e+00"
    wide = spark.createDataFrame([(1, 0.25, 0.75)], "cell long, a double, b double")
    assert sorted(map(tuple, bundles.melt(wide, ["cell"]).collect())) == [(1, "a", 0.25), (1, "b", 0.75)]
    dense = bundles.dense_to_counts(spark.createDataFrame([(1, [0.0, 2.0])], "cell long, v array<double>"))
    assert list(map(tuple, dense.collect())) == [(1, 1, 2.0)]


def test_stream(spark, small, tmp_path):
    """Windowed counts of the stream are those of the table."""
    table = roles.table(spark, small, "events")
    query = events.windowed_counts(events.read_events(spark, small), late="3650 days").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = table.groupBy(F.window("ts", "1 hour").start.alias("start"), F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("x"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, small, tmp_path):
    """Sessions of the stream are runs of a user's events without a gap."""
    table = roles.table(spark, small, "events")
    query = events.sessions(events.read_events(spark, small), "12 hours", "3650 days").writeStream.outputMode("complete").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = []
    for user, times in table.groupBy("user_id").agg(F.sort_array(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")))).alias("t")).collect():
        runs = [[times[0], times[0], 0]]
        for t in times:
            if t - runs[-1][1] >= 12 * 3600 * 10**6:
                runs.append([t, t, 0])
            runs[-1][1:] = [t, runs[-1][2] + 1]
        want += [(a, b + 12 * 3600 * 10**6, user, n) for a, b, n in runs]
    got = spark.table("runs").select(F.unix_micros(F.col("start").cast("timestamp")), F.unix_micros(F.col("end").cast("timestamp")), "cell", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fitted(spark, tmp_path):
    """Fitted models are written and read, and transform alike."""
    counts = spark.createDataFrame([(i, j, float((i * j) % 7 + 1)) for i in range(30) for j in range(12) if (i + j) % 3], "cell long, feature long, x double")
    rows = lambda df: sorted((r["cell"], *[round(x, 9) for x in r["v"]]) for r in df.collect())
    for tfidf in (True, False):
        lsi = reduce.Lsi(3, tfidf=tfidf).fit(counts, 30)
        lsi.save(str(tmp_path / f"lsi{tfidf}"))
        assert rows(reduce.Lsi.read(spark, str(tmp_path / f"lsi{tfidf}")).transform(counts)) == rows(lsi.transform(counts))
    fitted = recipes.Normaliser().fit(counts, 30)
    fitted.save(str(tmp_path / "n"))
    again = recipes.Normaliser.read(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, again.transform(counts).collect())) == sorted(map(tuple, fitted.transform(counts).collect()))


def test_exports(spark, tmp_path):
    """Vectors with domains, resources of a run, nested settings, vectors of a bundle."""
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "cell long, v array<double>")
    bundles.write_results(v, spark.createDataFrame([(1, 5), (2, 6)], "cell long, cluster int"), str(tmp_path / "r"))
    got = spark.read.csv(str(tmp_path / "r"), header=True)
    assert got.columns == ["cell", "embedding0", "embedding1", "domain"] and sorted(map(tuple, got.collect())) == [("1", "1.0", "2.0", "5"), ("2", "3.0", "4.0", "6")]
    bundles.write_resources(spark, str(tmp_path / "res"), 1.5)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "res")).collect()]
    assert lines[0] == "seconds: 1.500" and all(x.startswith("executor ") for x in lines[1:]) and len(lines) > 1
    (tmp_path / "c.json").write_text('{"net": {"dims": [4, 2], "name": "x"}, "seed": 3}')
    c = load_config(spark, str(tmp_path / "c.json"))
    assert c.net.dims == [4, 2] and c.net.name == "x" and c.seed == 3
    bundles.Bundle(vectors={"joint": v}).write(str(tmp_path / "b"))
    assert sorted(map(tuple, bundles.load(spark, str(tmp_path / "b"), ("joint",)).vectors["joint"].collect())) == sorted(map(tuple, v.collect()))
