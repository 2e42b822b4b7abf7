"""ML queries: features, folds, base-rate scores and image statistics with DuckDB oracles; training
and model scores are registered without SQL and bounded by metric floors in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import ml
from millrun.operators import plant
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.plant_queries import RH, SQL_ALARMS, SQL_STATE_EVENTS, SQL_TELEMETRY
from millrun.plans.registry import query
from millrun.sources import bindings as B

_BINDS = ["machine_telemetry_raw", "production_events_raw", "alarm_events_raw", "machine_master"]
_CTES = [("tel", SQL_TELEMETRY), ("se", SQL_STATE_EVENTS), ("al", SQL_ALARMS)]

SQL_FEATURES = f"""WITH ev AS (SELECT machine_id, epoch(date_trunc('hour', event_ts)) AS h,
                          count_if(state = 'fault') AS faults, count_if(state = 'maintenance') AS pms FROM se GROUP BY 1, 2),
      a AS (SELECT machine_id, epoch(date_trunc('hour', triggered_ts)) AS h, count(*) AS alarms FROM al GROUP BY 1, 2),
      t AS (SELECT machine_id, epoch(ts) AS h, temp_c, power_kw, oee_pct, cycle_time_sec FROM tel),
      g0 AS (SELECT machine_id, h FROM t UNION SELECT machine_id, h FROM ev UNION SELECT machine_id, h FROM a),
      g AS (SELECT g0.machine_id, g0.h, coalesce(ev.faults, 0) AS faults, coalesce(ev.pms, 0) AS pms,
                   coalesce(a.alarms, 0) AS alarms
            FROM g0 LEFT JOIN ev ON g0.machine_id = ev.machine_id AND g0.h = ev.h
            LEFT JOIN a ON g0.machine_id = a.machine_id AND g0.h = a.h),
      r AS (SELECT *, sum(faults) OVER (PARTITION BY machine_id ORDER BY h RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS f7,
                   sum(alarms) OVER (PARTITION BY machine_id ORDER BY h RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS a24,
                   sum(faults) OVER (PARTITION BY machine_id ORDER BY h RANGE BETWEEN 3600 FOLLOWING AND 86400 FOLLOWING) AS fut,
                   max(CASE WHEN pms > 0 THEN h END) OVER (PARTITION BY machine_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS last_pm,
                   min(h) OVER (PARTITION BY machine_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS first_h FROM g)
    SELECT t.machine_id, m.line, m.name AS machine_name, to_timestamp(t.h)::TIMESTAMP AS ts, t.temp_c, t.power_kw AS vibration_rms,
        t.oee_pct AS spindle_load_pct, t.cycle_time_sec / 10.0 AS oil_pressure_bar,
        {RH("(t.cycle_time_sec - m.std_cycle_sec) / m.std_cycle_sec * 100", 4)} AS cycle_time_deviation_pct,
        (t.h - r.first_h) / 3600.0 AS operating_hours, coalesce((t.h - r.last_pm) / 3600.0, 9999.0) AS hours_since_last_pm,
        CAST(r.f7 AS BIGINT) AS fault_count_7d, CAST(r.a24 AS BIGINT) AS alarm_count_24h,
        CAST(coalesce(r.fut, 0) > 0 AS INTEGER) AS failure_within_24h
    FROM t JOIN r ON t.machine_id = r.machine_id AND t.h = r.h JOIN machine_master m ON t.machine_id = m.machine_id"""


def _features(t):
    master = B.machine_master(t)
    return ml.pdm_features(
        plant.telemetry_silver(B.machine_telemetry_raw(t)),
        plant.state_events_silver(B.production_events_raw(t), master),
        plant.alarms_silver(B.alarm_events_raw(t), master, B.AS_OF_EVENTS),
        master,
    )


@query("pdm_features", W(_BINDS, _CTES, SQL_FEATURES))
def q_pdm_features(t):
    """L1 + W14 + W15: features and label per machine x hour."""
    return _features(t)


def _by_day(t):
    return _features(t).withColumn("day", F.to_date("ts").cast("string"))


FOLD_SQL = lambda key: f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 5 AS INTEGER)"


@query("pdm_train_metrics")
def q_pdm_train_metrics(t):
    """L2: GBT (reference hyper-parameters) 5-fold held-out ROC-AUC and accuracy, folds by day."""
    return ml.cross_validate(_by_day(t), ml.FEATURE_COLS, "failure_within_24h", "day")


@query(
    "pdm_fold_sizes",
    W(_BINDS, [*_CTES, ("feats", SQL_FEATURES)],
      f"""SELECT {FOLD_SQL("strftime(ts, '%Y-%m-%d')")} AS fold, count(*) AS rows, count_if(failure_within_24h = 1) AS positives,
          count(DISTINCT CAST(ts AS DATE)) AS keys FROM feats GROUP BY 1"""),
)
def q_pdm_fold_sizes(t):
    """L2: rows, positives and days of each fold."""
    return ml.fold_sizes(_by_day(t), "day", "failure_within_24h")


def _scores(t):
    f = _features(t)
    return ml.score(ml.fit_once(ml.training_rows(f, B.AS_OF_EVENTS), ml.FEATURE_COLS, "failure_within_24h"), f)


@query("pdm_scores")
def q_pdm_scores(t):
    """L3 + P25 + S7: probability and risk tier of each machine's latest hour, by a model that saw earlier hours only."""
    return _scores(t)


@query("pdm_risk_summary")
def q_pdm_risk_summary(t):
    """A28 + A57 over the scores."""
    return ml.risk_summary(_scores(t))


SQL_BASE_RATE = f"""WITH newest AS (SELECT machine_id, max(ts) AS ts FROM feats GROUP BY 1),
      past AS (SELECT f.machine_id, count(*) AS n, sum(f.failure_within_24h) AS k FROM feats f JOIN newest w USING (machine_id)
               WHERE f.ts < TIMESTAMP '{B.AS_OF_EVENTS}' - INTERVAL 24 HOUR AND f.ts <> w.ts GROUP BY 1),
      s AS (SELECT f.machine_id, f.line, f.machine_name, f.ts,
                   {RH("(1.0::DOUBLE + coalesce(p.k, 0)) / (2.0::DOUBLE + coalesce(p.n, 0))", 4)} AS failure_probability
            FROM feats f JOIN newest w ON f.machine_id = w.machine_id AND f.ts = w.ts LEFT JOIN past p ON p.machine_id = f.machine_id)
    SELECT *, CASE WHEN failure_probability < 0.30 THEN 'LOW' WHEN failure_probability < 0.55 THEN 'MEDIUM'
                   WHEN failure_probability < 0.80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier FROM s"""


@query("pdm_base_rate_scores", W(_BINDS, [*_CTES, ("feats", SQL_FEATURES)], SQL_BASE_RATE))
def q_pdm_base_rate_scores(t):
    """P25 + S7: tiers by each machine's past share of failing hours."""
    return ml.base_rate_scores(_features(t), B.AS_OF_EVENTS)


@query(
    "pdm_base_rate_summary",
    W(_BINDS, [*_CTES, ("feats", SQL_FEATURES), ("b", SQL_BASE_RATE)],
      f"""SELECT risk_tier, count(*) AS machines, {RH("avg(failure_probability)", 4)} AS avg_probability,
          {RH("count(*) * 100.0 / (SELECT count(*) FROM b)", 1)} AS share_pct FROM b GROUP BY risk_tier"""),
)
def q_pdm_base_rate_summary(t):
    """A28 + A57 over the base-rate scores."""
    return ml.risk_summary(ml.base_rate_scores(_features(t), B.AS_OF_EVENTS))


# ---- vision -------------------------------------------------------------------------------
SQL_PIXELS = """WITH e AS (SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos
                         FROM embeddings),
      s AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM e)
    SELECT image_id, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 AS INTEGER) AS col,
           CASE WHEN hi > lo THEN (CAST(v AS DOUBLE) - lo) / (hi - lo) * 255.0 ELSE 0.0 END AS value FROM s"""

_R6 = lambda e: RH(e, 6)
_HIST = ", ".join(f"{_R6(f'count_if(least(floor(value / 16.0), 15) = {b}) / count(*)')} AS hist_{b:02d}" for b in range(16))
_QUAD = ", ".join(
    f"{_R6(f'avg(CASE WHEN row {a} 4 AND col {c} 4 THEN value END)')} AS quad_{qr}{qc}_mean"
    for qr, a in ((0, "<"), (1, ">=")) for qc, c in ((0, "<"), (1, ">="))
)
SQL_IMG = f"""WITH p AS ({SQL_PIXELS}),
      g AS (SELECT *, abs(lead(value) OVER (PARTITION BY image_id, row ORDER BY col) - value) AS gx,
                   abs(lead(value) OVER (PARTITION BY image_id, col ORDER BY row) - value) AS gy FROM p),
      a AS (SELECT image_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
              avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value) AS m3,
              var_pop(value) AS m2,
              count_if(value < 64.0) / count(*) AS dark_ratio,
              count_if(value < 64.0) / greatest(count_if(value > 192.0), 1) AS dark_bright_ratio,
              avg(gx) AS gxm, stddev_pop(gx) AS gxs, avg(gy) AS gym, stddev_pop(gy) AS gys,
              {_QUAD},
              var_pop(CASE WHEN row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 THEN value END) AS cv,
              var_pop(CASE WHEN NOT (row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5) THEN value END) AS ev,
              {_HIST}
            FROM g GROUP BY image_id)
    SELECT image_id, {_R6('mean')} AS mean, {_R6('std')} AS std, {_R6('mn')} AS min, {_R6('mx')} AS max,
        {_R6('dark_ratio')} AS dark_ratio, {_R6('dark_bright_ratio')} AS dark_bright_ratio,
        {_R6('gxm')} AS grad_x_mean, {_R6('gxs')} AS grad_x_std, {_R6('gym')} AS grad_y_mean, {_R6('gys')} AS grad_y_std,
        quad_00_mean, quad_01_mean, quad_10_mean, quad_11_mean, {_R6('cv')} AS centre_var, {_R6('ev')} AS edge_var,
        {", ".join(f"hist_{b:02d}" for b in range(16))},
        {_R6('CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0.0 END')} AS skew FROM a"""


def _pixels(t):
    return ml.pixel_table(t.embeddings, "vec_id", "embedding")


@query("image_features", SQL_IMG)
def q_image_features(t):
    """L4: per-image statistics over the long pixel table."""
    return ml.image_features(_pixels(t))


@query(
    "dihedral_augment",
    f"""WITH p AS ({SQL_PIXELS}),
        t AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(variant))
        SELECT image_id, variant,
          CAST(CASE variant WHEN 0 THEN row WHEN 1 THEN col WHEN 2 THEN 7 - row WHEN 3 THEN 7 - col
                            WHEN 4 THEN row WHEN 5 THEN 7 - row WHEN 6 THEN col ELSE 7 - col END AS INTEGER) AS row,
          CAST(CASE variant WHEN 0 THEN col WHEN 1 THEN 7 - row WHEN 2 THEN 7 - col WHEN 3 THEN row
                            WHEN 4 THEN 7 - col WHEN 5 THEN col WHEN 6 THEN row ELSE 7 - row END AS INTEGER) AS col,
          value FROM p, t""",
)
def q_dihedral_augment(t):
    """Eight flips / rotations of every image."""
    return ml.dihedral_augment(_pixels(t))


@query(
    "vision_summary",
    """SELECT count_if(label % 2 = 0) AS clean, count_if(label % 2 = 1) AS defective, count(*) AS total FROM embeddings""",
)
def q_vision_summary(t):
    """A53 + P39."""
    return ml.vision_summary(ml.image_labels(t.embeddings, "vec_id", "label"))


# An image's three channels are its 64 values read from position 0, 21 and 42 on, around the end.
def _images(t):
    v = F.col("embedding")
    turned = F.array(*(F.concat(F.slice(v, 21 * k + 1, 64), F.slice(v, 1, 21 * k)) if k else v for k in range(3)))
    return ml.rgb_images(t.embeddings, "vec_id", turned)


def _sql_rgb_statistics() -> str:
    """One row an image from a long table of pixels, grouped."""
    cells = []
    for k, ch in enumerate(ml.CHANNELS):
        v = f"CASE WHEN k = {k} THEN v END"
        cells += [f"avg({v}) AS mean{k}", f"stddev_pop({v}) AS std{k}"]
        cells += [f"count_if(k = {k} AND least(floor(v * 16), 15) = {b}) / 64.0 AS {ch}_hist_{b:02d}" for b in range(16)]
        cells += [f"{_R6(f'avg(CASE WHEN k = {k} AND y {a} 4 AND x {c} 4 THEN v END)')} AS {ch}_quad_{qr}{qc}"
                  for qr, a in ((0, "<"), (1, ">=")) for qc, c in ((0, "<"), (1, ">="))]
    inner = "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"
    skews = ", ".join(f"avg(CASE WHEN k = {k} THEN pow(v - mean{k}, 3) END) AS third{k}" for k in range(3))
    named = ", ".join(
        f"{_R6(f'mean{k}')} AS {ch}_mean, {_R6(f'std{k}')} AS {ch}_std, {_R6(f'third{k} / pow(std{k} + 1e-6, 3)')} AS {ch}_skew"
        for k, ch in enumerate(ml.CHANNELS)
    )
    hists = ", ".join(f"{_R6(f'{ch}_hist_{b:02d}')} AS {ch}_hist_{b:02d}" for ch in ml.CHANNELS for b in range(16))
    quads = ", ".join(f"{ch}_quad_{q}" for ch in ml.CHANNELS for q in ("00", "01", "10", "11"))
    return f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings),
      s AS (SELECT vec_id, pos, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)
                                     ELSE 0.0 END AS v FROM e WINDOW w AS (PARTITION BY vec_id)),
      p AS (SELECT vec_id, k, (pos + 64 - 21 * k) % 64 // 8 AS y, (pos + 64 - 21 * k) % 8 AS x, v FROM s, range(3) t(k)),
      g AS (SELECT vec_id, y, x, avg(v) AS grey, count_if(v < 0.28) = 3 AS dark, count_if(v > 0.72) = 3 AS bright FROM p GROUP BY ALL),
      d AS (SELECT *, (coalesce(lead(grey) OVER r, grey) - coalesce(lag(grey) OVER r, grey)) / CASE WHEN x IN (0, 7) THEN 1 ELSE 2 END AS gx,
                      (coalesce(lead(grey) OVER c, grey) - coalesce(lag(grey) OVER c, grey)) / CASE WHEN y IN (0, 7) THEN 1 ELSE 2 END AS gy
            FROM g WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
      dg AS (SELECT vec_id, avg(sqrt(gx * gx + gy * gy)) AS gm, stddev_pop(sqrt(gx * gx + gy * gy)) AS gs,
                    count_if(dark) AS dark, count_if(bright) AS bright FROM d GROUP BY 1),
      a AS (SELECT vec_id, {", ".join(cells)}, var_pop(CASE WHEN {inner} THEN v END) AS cv,
                   var_pop(CASE WHEN NOT ({inner}) THEN v END) AS bv, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1),
      t3 AS (SELECT vec_id, {skews} FROM p JOIN (SELECT vec_id, mean0, mean1, mean2 FROM a) USING (vec_id) GROUP BY 1)
    SELECT vec_id AS image_id, {named}, {hists}, {quads}, {_R6("dark / 64.0")} AS dark_ratio,
           {_R6("dark / greatest(1.0, bright + 1e-6)")} AS dark_bright_ratio, {_R6("gm")} AS gradient_mean, {_R6("gs")} AS gradient_std,
           {_R6("cv")} AS centre_var, {_R6("bv")} AS edge_var, {_R6("lo")} AS min, {_R6("hi")} AS max
    FROM a JOIN dg USING (vec_id) JOIN t3 USING (vec_id)"""


@query("image_statistics", _sql_rgb_statistics())
def q_image_statistics(t):
    """L4: 77 statistics of every three-channel image, inside the row."""
    return ml.image_statistics(_images(t), 8)


@query(
    "defect_fold_sizes",
    f"""SELECT {FOLD_SQL("vec_id::VARCHAR")} AS fold, 8 * count(*) AS rows, 8 * count_if(label % 2 = 1) AS positives,
        count(DISTINCT vec_id) AS keys FROM embeddings GROUP BY 1""",
)
def q_defect_fold_sizes(t):
    """Rows, defective rows and images of each fold; an image's eight copies are in one."""
    return ml.fold_sizes(_defect_rows(t)[0], "image_id", "defective")


def _defect_rows(t):
    feats = ml.image_statistics(ml.augment_images(_images(t), 8), 8)
    cols = [c for c in feats.columns if c not in ("image_id", "variant")]
    return ml.class_weights(feats.join(ml.image_labels(t.embeddings, "vec_id", "label"), "image_id"), "defective"), cols


@query("defect_train_metrics")
def q_defect_train_metrics(t):
    """Class-weighted GBT on statistics of augmented images; folds by image (Q12)."""
    d, cols = _defect_rows(t)
    return ml.cross_validate(d, cols, "defective", "image_id", weight="weight")
