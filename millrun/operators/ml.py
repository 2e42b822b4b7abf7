"""Predictive maintenance and visual inspection.

Features are built on a (machine, hour) grid: the rolling counts are range windows over a
machine's hourly rows, whose number is bounded by the time span, not by the event volume (a
busy machine adds events per hour, not rows). Models are Spark ML pipelines (distributed
training and batch scoring); cross-validation folds are assigned by a key column so that
related rows (one image's augmented copies) never straddle folds (quirk Q12). Scores are of rows
that the model was not fitted on. Image statistics and augmentation work on pixel arrays inside a
row: an image is never exploded or shuffled.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.operators.boosting import Boosting, held_out_margins

# Fixed values of the reference's model set-up.
FEATURE_COLS = (
    "temp_c", "vibration_rms", "spindle_load_pct", "oil_pressure_bar", "cycle_time_deviation_pct",
    "operating_hours", "hours_since_last_pm", "fault_count_7d", "alarm_count_24h",
)
GBT_PARAMS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.8, "minInstancesPerNode": 10, "seed": 42}
N_FOLDS = 5
VALUES_A_TASK = 6_000_000  # feature values (rows x features) of one boosting task
MAX_FITS = 5  # folds fitted at a time
HOUR = 3600


def pdm_features(telemetry: DataFrame, events: DataFrame, alarms: DataFrame, master: DataFrame) -> DataFrame:
    """L1 + W14 + W15: nine features and the failure-within-24h label per machine x hour.

    Sensor proxies from the telemetry: vibration = power, spindle load = OEE, oil pressure =
    cycle time / 10. Counts: faults in the last 7 days, alarms in the last 24 h (both including
    the current hour), faults in the next 24 h (label); hours since the last maintenance event.
    """
    hour = lambda c: F.unix_timestamp(F.date_trunc("hour", c))
    ev = events.groupBy("machine_id", hour("event_ts").alias("h")).agg(
        F.count_if(F.col("state") == "fault").alias("faults"),
        F.count_if(F.col("state") == "maintenance").alias("pms"),
    )
    al = alarms.groupBy("machine_id", hour("triggered_ts").alias("h")).agg(F.count(F.lit(1)).alias("alarms"))
    tel = telemetry.select("machine_id", F.unix_timestamp("ts").alias("h"), "temp_c", "power_kw", "oee_pct", "cycle_time_sec")
    grid = (
        tel.select("machine_id", "h").unionByName(ev.select("machine_id", "h")).unionByName(al.select("machine_id", "h")).distinct()
        .join(ev, ["machine_id", "h"], "left").join(al, ["machine_id", "h"], "left")
        .fillna(0, ["faults", "pms", "alarms"])
    )
    w = Window.partitionBy("machine_id").orderBy("h")  # one machine's hours
    grid = (
        grid.withColumn("fault_count_7d", F.sum("faults").over(w.rangeBetween(-7 * 24 * HOUR, 0)))
        .withColumn("alarm_count_24h", F.sum("alarms").over(w.rangeBetween(-24 * HOUR, 0)))
        .withColumn("future_faults", F.sum("faults").over(w.rangeBetween(HOUR, 24 * HOUR)))
        .withColumn("last_pm", F.max(F.when(F.col("pms") > 0, F.col("h"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("first_h", F.min("h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    j = tel.join(grid, ["machine_id", "h"]).join(master.select("machine_id", "line", F.col("name").alias("machine_name"), "std_cycle_sec"),
                                                 "machine_id")
    return j.select(
        "machine_id", "line", "machine_name", F.timestamp_seconds("h").alias("ts"),
        F.col("temp_c"), F.col("power_kw").alias("vibration_rms"), F.col("oee_pct").alias("spindle_load_pct"),
        (F.col("cycle_time_sec") / 10.0).alias("oil_pressure_bar"),
        P.round_half_up((F.col("cycle_time_sec") - F.col("std_cycle_sec")) / F.col("std_cycle_sec") * 100, 4).alias("cycle_time_deviation_pct"),
        ((F.col("h") - F.col("first_h")) / 3600.0).alias("operating_hours"),
        F.coalesce((F.col("h") - F.col("last_pm")) / 3600.0, F.lit(9999.0)).alias("hours_since_last_pm"),
        F.col("fault_count_7d").cast("bigint").alias("fault_count_7d"),
        F.col("alarm_count_24h").cast("bigint").alias("alarm_count_24h"),
        (F.coalesce(F.col("future_faults"), F.lit(0)) > 0).cast("int").alias("failure_within_24h"),
    )


def _scaled(features) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ]


def _pipeline(features, label: str, **params) -> Pipeline:
    return Pipeline(stages=[*_scaled(features), GBTClassifier(featuresCol="scaled", labelCol=label, **{**GBT_PARAMS, **params})])


def fold_of(key: Column | str, n_folds: int = N_FOLDS) -> Column:
    """Fold 0..n-1 of a key, from its MD5: all rows of a key are in one fold; a null key counts as empty."""
    digest = F.md5(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n_folds).cast("int")


def fold_sizes(df: DataFrame, fold_key: str, label: str, n_folds: int = N_FOLDS) -> DataFrame:
    """Rows, positives and distinct keys of each fold that holds any."""
    return df.groupBy(fold_of(F.col(fold_key).cast("string"), n_folds).alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_distinct(fold_key).alias("keys")
    )


def cross_validate(df: DataFrame, features, label: str, fold_key: str, n_folds: int = N_FOLDS, weight: str | None = None, **params) -> DataFrame:
    """Held-out ROC-AUC and accuracy of each fold, folds by ``fold_key`` (:func:`fold_of`).

    Returns DataFrame[fold, rows, positives, auc, accuracy]. A fold whose held-out rows have one class only has
    a null AUC; where the rows left to fit on have one class, both are null. Folds without rows are absent.
    ``params`` override the boosting parameters."""
    cols = dict.fromkeys([label, *features, *([weight] if weight else [])])
    d = df.select(*cols, fold_of(F.col(fold_key).cast("string"), n_folds).alias("_fold")).persist()
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="margin", metricName="areaUnderROC")
    try:
        sizes = d.groupBy("_fold").agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).collect()  # a row a fold
        sizes = {r[0]: (r[1], r[2]) for r in sizes}
        n, pos = (sum(v[i] for v in sizes.values()) for i in (0, 1))
        # a level of a tree is a job over the rows: as many tasks as the values are worth, not as the shuffles had
        tasks = max(1, -(-n * len(features) // VALUES_A_TASK))
        now = d.rdd.getNumPartitions()
        rows = d if tasks == now else d.coalesce(tasks) if tasks < now else d.repartition(tasks)

        # folds whose other rows have both classes
        fitted = [k for k, (rows_k, positives) in sorted(sizes.items()) if 0 < pos - positives < n - rows_k]
        with ThreadPoolExecutor(max_workers=MAX_FITS) as pool:
            found = pool.map(lambda k: Pipeline(stages=_scaled(features)).fit(rows.filter(F.col("_fold") != k)), fitted)
            prepared = dict(zip(fitted, found))
        metrics = {k: (None, None) for k in sizes}
        if fitted:
            seen = {k: n - sizes[k][0] for k in fitted}
            scored = held_out_margins(rows, prepared, seen, label, weight, "_fold", Boosting(**{**GBT_PARAMS, **params}))
            try:
                def fold_metrics(k: int):
                    own = scored.filter(F.col("_fold") == k)
                    accuracy = own.agg(F.avg(((F.col("margin") > 0) == (F.col(label) == 1)).cast("int"))).first()[0]
                    return float(ev.evaluate(own)) if 0 < sizes[k][1] < sizes[k][0] else None, accuracy

                with ThreadPoolExecutor(max_workers=MAX_FITS) as pool:
                    metrics |= zip(fitted, pool.map(fold_metrics, fitted))
            finally:
                scored.unpersist()
    finally:
        d.unpersist()
    metrics = [(k, *sizes[k], *metrics[k]) for k in sorted(sizes)]
    return df.sparkSession.createDataFrame(metrics, "fold int, rows bigint, positives bigint, auc double, accuracy double")


_FITTED: dict[tuple, PipelineModel] = {}


def fit_once(df: DataFrame, features, label: str, **params) -> PipelineModel:
    """The model fitted on ``df``; the same rows (plan and input files) are fitted once an application."""
    files = tuple(sorted(df.inputFiles()))
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), files, tuple(features), label, tuple(sorted(params.items())))
    if key not in _FITTED:
        _FITTED[key] = _pipeline(features, label, **params).fit(df)
    return _FITTED[key]


def feature_importances(model, features) -> list[tuple[str, float]]:
    """Importance per feature of the fitted GBT (one small vector on the driver)."""
    return list(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def latest_rows(features_df: DataFrame) -> DataFrame:
    """The row of each machine's newest hour."""
    cols = features_df.columns
    newest = features_df.groupBy("machine_id").agg(F.max_by(F.struct(*cols), F.struct("ts", *[c for c in cols if c != "ts"])).alias("r"))
    return newest.select("r.*")


def training_rows(features_df: DataFrame, as_of) -> DataFrame:
    """Rows whose 24-hour label is complete at ``as_of`` and that are not a machine's newest (those are scored)."""
    newest = features_df.groupBy("machine_id").agg(F.max("ts").alias("ts"))
    known = F.col("ts") < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return features_df.filter(known).join(newest, ["machine_id", "ts"], "left_anti")


def _ranked(rows: DataFrame, probability: Column) -> DataFrame:
    """P25 + S7: probability to four places, its tier, the likeliest failure first."""
    p = P.round_half_up(probability, 4)
    return rows.withColumn("failure_probability", p).select(
        "machine_id", "line", "machine_name", "ts", "failure_probability", P.risk_tier("failure_probability").alias("risk_tier")
    ).orderBy(F.desc("failure_probability"), "machine_id")


def score(model, features_df: DataFrame) -> DataFrame:
    """L3 + P25 + S7: failure probability of each machine's latest feature row, tier, sorted."""
    scored = model.transform(latest_rows(features_df))
    return _ranked(scored, vector_to_array("probability")[1])


def base_rate_scores(features_df: DataFrame, as_of) -> DataFrame:
    """P25 + S7 with a machine's past share of failing hours, (1 + failures) / (2 + hours), in place of a model.

    What a model must beat; a machine without a complete hour has one half."""
    past = training_rows(features_df, as_of).groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("failure_within_24h").alias("_k")
    )
    rows = latest_rows(features_df).join(past, "machine_id", "left")
    rate = (1.0 + F.coalesce("_k", F.lit(0))) / (2.0 + F.coalesce("_n", F.lit(0)))
    return _ranked(rows, rate)


def risk_summary(scored: DataFrame) -> DataFrame:
    """A28 + A57: machines per tier, share, mean probability."""
    return scored.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("machines"), P.round_half_up(F.avg("failure_probability"), 4).alias("avg_probability")
    ).withColumn("share_pct", P.round_half_up(F.col("machines") * 100.0 / F.sum("machines").over(Window.partitionBy()), 1))


# ---- visual inspection ---------------------------------------------------------------------------

SIDE = 8  # the test images are 8 x 8, one channel
BINS = 16
DARK, BRIGHT = 64.0, 192.0


def pixel_table(images: DataFrame, id_col: str, vec_col: str, side: int = SIDE) -> DataFrame:
    """Long pixel table (image_id, row, col, value), each image min-max scaled to 0..255."""
    px = images.select(F.col(id_col).alias("image_id"), F.posexplode(vec_col).alias("pos", "v"))
    w = Window.partitionBy("image_id")  # one image's pixels
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return px.select(
        "image_id", (F.col("pos") / side).cast("int").alias("row"), (F.col("pos") % side).cast("int").alias("col"),
        F.when(hi > lo, (F.col("v").cast("double") - lo) / (hi - lo) * 255.0).otherwise(F.lit(0.0)).alias("value"),
    )


# The eight flips / rotations of a square as (row, col) maps on side - 1 = m.
DIHEDRAL = ("r,c", "c,m-r", "m-r,m-c", "m-c,r", "r,m-c", "m-r,c", "c,r", "m-c,m-r")


def dihedral_augment(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """Eight copies of every image (identity, rotations, flips) by coordinate maps."""
    m = side - 1
    r, c = F.col("row"), F.col("col")
    coord = {"r": r, "c": c, "m-r": F.lit(m) - r, "m-c": F.lit(m) - c}
    variants = F.array(*[F.struct(F.lit(i).alias("variant"), coord[a.split(",")[0]].alias("nr"), coord[a.split(",")[1]].alias("nc"))
                         for i, a in enumerate(DIHEDRAL)])
    x = pixels.select("image_id", "value", F.explode(variants).alias("t"))
    return x.select("image_id", F.col("t.variant").alias("variant"), F.col("t.nr").cast("int").alias("row"),
                    F.col("t.nc").cast("int").alias("col"), "value")


def image_features(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """L4 for one channel: mean, std, min, max, skew; 16-bin histogram shares; dark ratio and
    dark/bright ratio; horizontal + vertical gradient mean and std; quadrant means; centre and
    edge variance. Grouped by image (and augmentation variant when present)."""
    keys = ["image_id"] + (["variant"] if "variant" in pixels.columns else [])
    v = F.col("value")
    h = side // 2
    row_w = Window.partitionBy(*keys, "row").orderBy("col")
    col_w = Window.partitionBy(*keys, "col").orderBy("row")
    g = pixels.withColumn("gx", F.abs(F.lead("value").over(row_w) - v)).withColumn("gy", F.abs(F.lead("value").over(col_w) - v))
    n = F.count(F.lit(1))
    mean = F.avg(v)
    centre = (F.col("row").between(2, side - 3)) & (F.col("col").between(2, side - 3))
    bucket = F.least(F.floor(v / (256.0 / BINS)), F.lit(BINS - 1))

    def quad(qr: int, qc: int):
        rr = F.col("row") < h if qr == 0 else F.col("row") >= h
        cc = F.col("col") < h if qc == 0 else F.col("col") >= h
        return rr & cc

    aggs = [
        mean.alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.avg(v * v * v) - 3 * mean * F.avg(v * v) + 2 * mean * mean * mean).alias("_m3"),
        F.var_pop(v).alias("_m2"),
        (F.count_if(v < DARK) / n).alias("dark_ratio"),
        (F.count_if(v < DARK) / F.greatest(F.count_if(v > BRIGHT), F.lit(1))).alias("dark_bright_ratio"),
        F.avg("gx").alias("grad_x_mean"), F.stddev_pop("gx").alias("grad_x_std"),
        F.avg("gy").alias("grad_y_mean"), F.stddev_pop("gy").alias("grad_y_std"),
        *[F.avg(F.when(quad(qr, qc), v)).alias(f"quad_{qr}{qc}_mean") for qr in (0, 1) for qc in (0, 1)],
        F.var_pop(F.when(centre, v)).alias("centre_var"), F.var_pop(F.when(~centre, v)).alias("edge_var"),
        *[(F.count_if(bucket == b) / n).alias(f"hist_{b:02d}") for b in range(BINS)],
    ]
    out = g.groupBy(*keys).agg(*aggs)
    skew = F.when(F.col("_m2") > 0, F.col("_m3") / F.pow(F.col("_m2"), 1.5)).otherwise(F.lit(0.0))
    cols = [c for c in out.columns if c not in keys and not c.startswith("_")]
    r6 = lambda c: P.round_half_up(c, 6)
    return out.select(*keys, *[r6(F.col(c)).alias(c) for c in cols], r6(skew).alias("skew"))


# ---- images as pixel arrays: three channels, one row an image ----------------------------------

# Thresholds of dark and bright pixels and the border's share of the side.
DARK_SHARE, BRIGHT_SHARE, BORDER = 0.28, 0.72, 0.15
CHANNELS = ("red", "green", "blue")


def rgb_images(images: DataFrame, id_col: str, channels: Column) -> DataFrame:
    """(image_id, channels): ``channels`` holds a row-major array a channel, scaled to 0..1 by the image's extremes.

    A flat image is all zero; a null entry makes its image's statistics null."""
    ch = F.transform(channels, lambda c: F.transform(c, lambda v: v.cast("double")))
    rows = images.select(F.col(id_col).alias("image_id"), ch.alias("channels"))
    rows = rows.withColumn("_lo", F.array_min(F.flatten("channels"))).withColumn("_hi", F.array_max(F.flatten("channels")))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.transform("channels", lambda c: F.transform(c, lambda v: F.when(span > 0, (v - F.col("_lo")) / span).otherwise(v - v)))
    return rows.select("image_id", scaled.alias("channels"))


def augment_images(images: DataFrame, side: int) -> DataFrame:
    """L5 on pixel arrays: eight rows an image (``variant`` 0..7), each channel's pixels read in the variant's order."""
    m = side - 1
    at = {"r": lambda r, c: r, "c": lambda r, c: c, "m-r": lambda r, c: m - r, "m-c": lambda r, c: m - c}
    # source position of each target position: pixel (r, c) of the image lands at the variant's coordinates
    order = []
    for maps in DIHEDRAL:
        nr, nc = maps.split(",")
        to = {at[nr](r, c) * side + at[nc](r, c): r * side + c for r in range(side) for c in range(side)}
        order.append([to[i] for i in range(side * side)])
    variants = F.explode(F.array(*(
        F.struct(F.lit(k).alias("variant"), F.lit(o).alias("order")) for k, o in enumerate(order)
    ))).alias("_v")
    moved = F.transform("channels", lambda ch: F.transform("_v.order", lambda i: F.get(ch, i)))
    return images.select("*", variants).select("image_id", F.col("_v.variant").alias("variant"), moved.alias("channels"))


def _mean_of(a: Column, of) -> Column:
    """Mean of ``of`` each double of an array; null if it is empty or holds a null."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + of(v)) / F.nullif(F.size(a).cast("double"), F.lit(0.0))


def _mean(a: Column) -> Column:
    return _mean_of(a, lambda v: v)


def _variance(a: Column, mean: Column) -> Column:
    return _mean_of(a, lambda v: (v - mean) * (v - mean))


def image_statistics(images: DataFrame, side: int) -> DataFrame:
    """L4: 77 statistics of each (image_id[, variant], channels) row, by array expressions inside the row.

    Per channel mean, deviation, skew, a histogram of 16 bins; share of pixels dark in all channels, and dark to bright
    ones; mean and deviation of the gradient of the channels' mean (central differences, one-sided at the border);
    channel means of the quadrants; variance of centre and border; extremes. Rounded to 6 places."""
    keys = [c for c in ("image_id", "variant") if c in images.columns]
    n, half, pad = side * side, side // 2, int(side * BORDER)
    nth = lambda k: F.get(F.col("channels"), k)
    rows = images.withColumn("_grey", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (
        F.get(nth(0), i) + F.get(nth(1), i) + F.get(nth(2), i)) / 3.0))

    def slopes(step: int) -> tuple[Column, Column, Column]:
        """Each pixel's neighbours along the axis whose neighbours lie ``step`` apart, and how far they are."""
        pos = [i // step % side for i in range(n)]
        below, above = [i - step * (x > 0) for i, x in enumerate(pos)], [i + step * (x < side - 1) for i, x in enumerate(pos)]
        return F.lit(below), F.lit(above), F.lit([(j - i) / step for i, j in zip(below, above)])

    def gradient(i: Column) -> Column:
        across, down = ((F.get("_grey", F.get(above, i)) - F.get("_grey", F.get(below, i))) / F.get(far, i) for below, above, far in (slopes(1), slopes(side)))
        return F.sqrt(across * across + down * down)

    def part(positions: list[int]) -> Column:
        """These pixels, an array a channel."""
        return F.transform("channels", lambda ch: F.transform(F.lit(positions), lambda i: F.get(ch, i)))

    inside = [i for i in range(n) if all(pad <= x < side - pad for x in divmod(i, side))]
    border = [i for i in range(n) if i not in set(inside)]
    quads = {(a, b): [i for i in range(n) if (i // side >= half, i % side >= half) == (bool(a), bool(b))] for a in (0, 1) for b in (0, 1)}
    pixels = F.arrays_zip(nth(0).alias("r"), nth(1).alias("g"), nth(2).alias("b"))
    every = lambda test: F.size(F.filter(pixels, lambda p: test(p["r"]) & test(p["g"]) & test(p["b"])))
    rows = (
        rows.withColumn("_grad", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), gradient))
        .withColumn("_mean", F.transform("channels", _mean))
        .withColumn("_centre", F.flatten(part(inside))).withColumn("_border", F.flatten(part(border)))
        .withColumn("_dark", every(lambda v: v < DARK_SHARE)).withColumn("_bright", every(lambda v: v > BRIGHT_SHARE))
    )
    rows = (
        rows.withColumn("_off", F.transform("channels", lambda c, i: F.transform(c, lambda v: v - F.get("_mean", i))))
        .withColumn("_gmean", _mean(F.col("_grad"))).withColumn("_cmean", _mean(F.col("_centre"))).withColumn("_bmean", _mean(F.col("_border")))
        .withColumn("_bins", F.transform("channels", lambda c: F.transform(c, lambda v: F.least(F.floor(v * BINS), F.lit(BINS - 1)).cast("int"))))
        .withColumn("_quads", F.array(*(F.transform(part(q), _mean) for q in quads.values())))
    )
    rows = rows.withColumn("_m2", F.transform("_off", lambda c: _mean_of(c, lambda v: v * v))).withColumn("_m3", F.transform("_off", lambda c: _mean_of(c, lambda v: v * v * v)))
    in_bin = lambda b: lambda x: x == b
    out = {}
    for k, ch in enumerate(CHANNELS):
        deviation = F.sqrt(F.get("_m2", k))
        out[f"{ch}_mean"], out[f"{ch}_std"] = F.get("_mean", k), deviation
        out[f"{ch}_skew"] = F.get("_m3", k) / F.pow(deviation + 1e-6, 3)
        for b in range(BINS):
            out[f"{ch}_hist_{b:02d}"] = F.size(F.filter(F.get("_bins", k), in_bin(b))) / F.lit(float(n))
        for j, (qr, qc) in enumerate(quads):
            out[f"{ch}_quad_{qr}{qc}"] = F.get(F.get("_quads", j), k)
    out["dark_ratio"] = F.col("_dark") / F.lit(float(n))
    out["dark_bright_ratio"] = F.col("_dark") / F.greatest(F.lit(1.0), F.col("_bright") + 1e-6)
    out["gradient_mean"], out["gradient_std"] = F.col("_gmean"), F.sqrt(_variance(F.col("_grad"), F.col("_gmean")))
    out["centre_var"] = _variance(F.col("_centre"), F.col("_cmean"))
    out["edge_var"] = _variance(F.col("_border"), F.col("_bmean"))
    out["min"], out["max"] = F.array_min(F.flatten("channels")), F.array_max(F.flatten("channels"))
    return rows.select(*keys, *(P.round_half_up(v, 6).alias(c) for c, v in out.items()))


def image_labels(images: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Binary class: defective when the label is odd (A53 summary uses the same rule, P39)."""
    return images.select(F.col(id_col).alias("image_id"), (F.col(label_col) % 2).cast("int").alias("defective"))


def vision_summary(labels: DataFrame) -> DataFrame:
    """Clean / defective / total."""
    return labels.agg(F.count_if(F.col("defective") == 0).alias("clean"), F.count_if(F.col("defective") == 1).alias("defective"),
                      F.count(F.lit(1)).alias("total"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_class) as a column."""
    w = Window.partitionBy()  # two class rows after the aggregate
    cw = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("weight", F.sum("_n").over(w) / (2.0 * F.col("_n")))
    return df.join(cw.select(label, "weight"), label)
