"""Predictive maintenance and image models: held-out metrics, scored rows, pixel arrays."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrun.operators import boosting, ml

FAST = {"maxIter": 10}


def _labelled(spark, n, signal):
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    rows = spark.range(n).select(F.col("id").alias("k"), share(1).alias("x"), share(2).alias("noise"), share(3).alias("other"))
    return rows.withColumn("y", (F.col("x" if signal else "other") > 0.5).cast("int")).drop("other")


def test_held_out_metrics_have_a_floor_and_noise_a_ceiling(spark):
    told = ml.cross_validate(_labelled(spark, 600, True), ["x", "noise"], "y", "k", 3, **FAST).collect()
    assert len(told) == 3 and all(r["auc"] > 0.97 and r["accuracy"] > 0.93 for r in told)
    assert sum(r["rows"] for r in told) == 600
    blind = ml.cross_validate(_labelled(spark, 600, False), ["x", "noise"], "y", "k", 3, **FAST).collect()
    assert all(0.35 < r["auc"] < 0.65 for r in blind)  # a training metric would be near one


def test_folds_keep_a_key_together_and_survive_one_class(spark):
    d = spark.createDataFrame([(f"k{i % 10}", float(i), 1) for i in range(40)], "k string, x double, y int")
    sizes = ml.fold_sizes(d, "k", "y").collect()
    assert sum(r["rows"] for r in sizes) == 40 and sum(r["keys"] for r in sizes) == 10
    got = ml.cross_validate(d, ["x"], "y", "k", **FAST).collect()
    assert all(r["auc"] is None and r["accuracy"] is None for r in got)
    assert ml.cross_validate(d.limit(0), ["x"], "y", "k", **FAST).count() == 0


def _hours(spark):
    """Two machines, ten days of hours; the hot one fails whenever it vibrates."""
    t0 = dt.datetime(2024, 1, 20)
    rows = []
    for m in ("A", "B"):
        for h in range(240):
            hot = (h // 24) % 2 == 1 if m == "A" else False
            rows.append((m, "L1", f"name {m}", t0 + dt.timedelta(hours=h), *(float(hot) if c == "vibration_rms" else 0.0 for c in ml.FEATURE_COLS), int(hot)))
    cols = ", ".join(f"{c} double" for c in ml.FEATURE_COLS)
    return spark.createDataFrame(rows, f"machine_id string, line string, machine_name string, ts timestamp, {cols}, failure_within_24h int")


def test_scored_rows_are_not_fitted_on(spark):
    f = _hours(spark)
    as_of = "2024-01-30 00:00:00"
    fitted = ml.training_rows(f, as_of)
    assert fitted.agg(F.max("ts")).first()[0] < dt.datetime(2024, 1, 29)
    # a machine that fell silent long ago: its newest hour is scored, hence not fitted on
    silent = f.filter("machine_id = 'A' or ts < '2024-01-22'")
    assert ml.training_rows(silent, as_of).filter("machine_id = 'B'").count() == 47
    model = ml.fit_once(fitted, ml.FEATURE_COLS, "failure_within_24h", **FAST)
    assert ml.fit_once(ml.training_rows(f, as_of), ml.FEATURE_COLS, "failure_within_24h", **FAST) is model
    got = ml.score(model, f).collect()
    assert [(r["machine_id"], r["risk_tier"]) for r in got] == [("A", "CRITICAL"), ("B", "LOW")]
    parts = {r["risk_tier"]: r for r in ml.risk_summary(ml.score(model, f)).collect()}
    assert parts["CRITICAL"]["share_pct"] == 50.0
    base = {r["machine_id"]: r["failure_probability"] for r in ml.base_rate_scores(f, as_of).collect()}
    assert base == {"A": round(97 / 218, 4), "B": round(1 / 218, 4)}


def _numpy_statistics(a):
    """The statistics of a (side, side, 3) array in 0..1, from their definitions."""
    side = a.shape[0]
    out = {}
    for k, ch in enumerate(ml.CHANNELS):
        c = a[:, :, k]
        out[f"{ch}_mean"], out[f"{ch}_std"] = c.mean(), c.std()
        out[f"{ch}_skew"] = ((c - c.mean()) ** 3).mean() / (c.std() + 1e-6) ** 3
        for b, n in enumerate(np.histogram(c, 16, (0.0, 1.0))[0]):
            out[f"{ch}_hist_{b:02d}"] = n / c.size
        for i in (0, 1):
            for j in (0, 1):
                h = side // 2
                out[f"{ch}_quad_{i}{j}"] = c[h * i : h if i == 0 else side, h * j : h if j == 0 else side].mean()
    dark, bright = (a < 0.28).all(axis=2), (a > 0.72).all(axis=2)
    out["dark_ratio"], out["dark_bright_ratio"] = dark.mean(), dark.sum() / max(1.0, bright.sum() + 1e-6)
    steep = np.hypot(*np.gradient(a.mean(axis=2)))
    out["gradient_mean"], out["gradient_std"] = steep.mean(), steep.std()
    pad = int(side * 0.15)
    inner = np.zeros((side, side), bool)
    inner[pad : side - pad, pad : side - pad] = True
    out["centre_var"], out["edge_var"] = a[inner].var(), a[~inner].var()
    out["min"], out["max"] = a.min(), a.max()
    return out


@pytest.mark.parametrize("side", [8, 10])
def test_image_statistics_equal_numpy(spark, side):
    rng = np.random.default_rng(3)
    images = {1: rng.integers(0, 256, (side, side, 3)), 2: np.full((side, side, 3), 9), 3: rng.integers(0, 2, (side, side, 3)) * 255}
    rows = [(i, [[float(x) for x in a[:, :, k].ravel()] for k in range(3)], "extra") for i, a in images.items()]
    t = spark.createDataFrame(rows, "id int, planes array<array<double>>, channels string")
    got = ml.image_statistics(ml.rgb_images(t, "id", F.col("planes")), side).collect()
    assert len(got[0].asDict()) == 78
    for r in got:
        a = images[r["image_id"]].astype(float)
        span = a.max() - a.min()
        want = _numpy_statistics((a - a.min()) / span if span else a * 0)
        for c, v in want.items():
            assert math.isclose(r[c], v, abs_tol=2e-6), (r["image_id"], c, r[c], v)
    assert ml.image_statistics(ml.rgb_images(t.limit(0), "id", F.col("planes")), side).count() == 0


def test_null_pixels_give_null_statistics(spark):
    t = spark.createDataFrame([(1, [[None] + [1.0] * 63] * 3), (2, None)], "id int, planes array<array<double>>")
    got = ml.image_statistics(ml.rgb_images(t, "id", F.col("planes")), 8).collect()
    assert len(got) == 2 and all(r["red_mean"] is None and r["gradient_mean"] is None for r in got)


def test_augmented_arrays_equal_the_pixel_table(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(5)
    table = ml.dihedral_augment(ml.pixel_table(e, "vec_id", "embedding"))
    arrays = ml.augment_images(ml.rgb_images(e, "vec_id", F.array("embedding", "embedding", "embedding")), 8)
    px = arrays.select("image_id", "variant", F.posexplode(F.get("channels", 1)).alias("pos", "v"))
    px = px.select("image_id", "variant", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"), "v")
    both = table.join(px, ["image_id", "variant", "row", "col"])
    assert both.count() == 5 * 8 * 64
    assert both.where(F.abs(F.col("value") - F.col("v") * 255) > 1e-3).count() == 0  # the table scales in single precision
    every = ml.augment_images(ml.rgb_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", F.array(*["embedding"] * 3)), 8)
    assert "Exchange" not in ml.image_statistics(every, 8)._jdf.queryExecution().executedPlan().toString()


def test_boosting_jobs_have_as_many_tasks_as_the_values_are_worth(spark, monkeypatch):
    """Rows that a shuffle left in many partitions are fitted in few, and in more where a task would hold too many values."""
    seen = []
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    d = _labelled(spark, 300, True).repartition(7)
    few = ml.cross_validate(d, ["x", "noise"], "y", "k", 3, **FAST).collect()
    assert seen and set(seen) == {1} and sum(r["rows"] for r in few) == 300
    seen.clear()
    monkeypatch.setattr(ml, "VALUES_A_TASK", 60)
    many = ml.cross_validate(d, ["x", "noise"], "y", "k", 3, **FAST).collect()
    assert set(seen) == {10} and sum(r["rows"] for r in many) == 300


def _weighted(spark, n):
    """Rows in three partitions: a steep and a faint feature, one that is mostly zero, noise, and weights."""
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    rows = spark.range(0, n, 1, 3).select(F.col("id").alias("k"), share(1).alias("x"), share(2).alias("noise"), share(3).alias("u"))
    rows = rows.withColumn("y", (F.col("x") + 0.7 * F.col("u") > 0.8).cast("int")).withColumn("rare", F.when(F.col("u") > 0.8, F.col("u")).otherwise(0.0))
    return rows.withColumn("w", F.when(F.col("y") == 1, 0.75).otherwise(1.5)).drop("u")


@pytest.mark.parametrize("weight", [None, "w"])
def test_folds_boosted_together_are_spark_models(spark, monkeypatch, weight):
    """Held-out metrics equal those of GBTClassifier fitted a fold at a time: thresholds, drawn rows, splits, leaves and residuals."""
    monkeypatch.setattr(ml, "VALUES_A_TASK", 1000)
    d = _weighted(spark, 900).persist()
    features, params = ["x", "noise", "rare"], {"maxIter": 8, "maxDepth": 3}
    got = {r["fold"]: r for r in ml.cross_validate(d, features, "y", "k", 3, weight, **params).collect()}
    rows = d.withColumn("_fold", ml.fold_of(F.col("k").cast("string"), 3))
    for k in range(3):
        pipeline = ml._pipeline(features, "y", **params)
        if weight:
            pipeline.getStages()[-1].setWeightCol(weight)
        scored = pipeline.fit(rows.filter(F.col("_fold") != k)).transform(rows.filter(F.col("_fold") == k))
        right = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
        auc = ml.BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC").evaluate(scored)
        assert got[k]["accuracy"] == right and math.isclose(got[k]["auc"], auc, abs_tol=1e-9)
    d.unpersist()


def test_rows_to_fit_on_have_every_feature(spark):
    """As GBTClassifier, which takes neither NaN nor infinite values."""
    d = _weighted(spark, 90).withColumn("noise", F.when(F.col("k") != 3, F.col("noise")))
    with pytest.raises(Exception, match="must not be null"):
        ml.cross_validate(d, ["x", "noise"], "y", "k", 3, **FAST)


def test_a_tree_of_all_folds_is_a_job_a_level(spark):
    d = _weighted(spark, 300).persist()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    took = []
    for trees in (5, 15):
        before = jobs()
        assert ml.cross_validate(d, ["x", "noise"], "y", "k", 3, maxIter=trees).count() == 3
        took.append(jobs() - before)
    assert took[1] - took[0] <= 10 * ml.GBT_PARAMS["maxDepth"]  # three folds
    d.unpersist()


def test_margins_lost_by_a_worker_are_made_again(monkeypatch):
    rng = np.random.default_rng(7)
    block = boosting.Block(np.zeros(40, np.int16), np.ones(40, np.int8), np.ones(40), rng.integers(0, 9, (3, 40)).astype(np.uint8))
    trees = boosting.Trees(2, 2, 6)
    trees.feature[:], trees.cut[:] = rng.integers(0, 3, trees.feature.shape), rng.integers(0, 9, trees.cut.shape)
    trees.value[:], trees.weight[:] = rng.normal(size=trees.value.shape), 0.1
    monkeypatch.setattr(boosting, "_MARGINS", boosting.Kept(1))
    for m in (1, 2, 6):
        step_by_step = boosting._margins("run", 0, block, trees.upto(m)).copy()
    boosting._margins("run", 1, block, trees.upto(1))  # no room for both
    assert list(boosting._MARGINS.held) == [("run", 1)]
    assert np.array_equal(boosting._margins("run", 0, block, trees), step_by_step)
    assert len(np.unique(step_by_step)) > 4


def test_thresholds_of_few_many_zero_and_missing_values():
    ones = np.ones(8)
    assert boosting.thresholds(np.array([1.0, 1, 2, 2, 4, 4, 4, 4]), ones, 8.0, 31).tolist() == [1.5, 3.0]
    assert boosting.thresholds(np.arange(1.0, 9.0), ones, 8.0, 3).tolist() == [2.5, 4.5, 6.5]
    assert boosting.thresholds(np.array([0.0, 0, 0, 0, -2, -2, 2, 2]), ones, 8.0, 31).tolist() == [-1.0, 1.0]
    assert not len(boosting.thresholds(np.full(8, 5.0), ones, 8.0, 31)) and not len(boosting.thresholds(np.array([1.0, np.nan] * 4), ones, 8.0, 31))
