"""Reliability analytics: sensor breaches, rolling z-scores, trend-to-threshold, robust spend
outliers, alarm response times and the downtime cascade (SURVEY §2.2 P26, P27, P41; §2.5 W12,
W13, W18; §2.10 C1-C3).

Rolling statistics run on the machine x hour grid (one row per machine-hour after the W1
dedupe), so a window partition holds a machine's hours - bounded by the time span - and never a
machine's raw events. The cascade walks at most three downstream stations by three bounded
joins on (line, index + k) against the small route table; no recursion, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.operators.quantiles import quantile
from millrun.session import cut_lineage

# Fixed values of the reference's sensor limits.
BREACH_RULES = (
    ("temp_c", ">", 60.0), ("vibration_rms", ">", 3.5), ("spindle_load_pct", ">", 85.0),
    ("oil_pressure_bar", "<", 1.5), ("cycle_time_deviation_pct", ">", 15.0), ("hours_since_last_pm", ">", 1500.0),
)
# Fixed values of the reference's driving sensors (W12): sensor, threshold, side on which it is in breach.
DRIVING_LIMITS = (
    ("fault_count_7d", 4.0, "above"), ("vibration_rms", 3.5, "above"), ("temp_c", 62.0, "above"),
    ("spindle_load_pct", 85.0, "above"), ("cycle_time_deviation_pct", 15.0, "above"), ("oil_pressure_bar", 1.8, "below"),
)
# Fixed values of the reference's cascade rules.
CASCADE_HOPS, CASCADE_DECAY, CASCADE_STOP = 3, 0.75, 0.05
IMPACT_SPLIT = (("Revenue Loss", 0.58), ("Delivery Risk", 0.27), ("WIP Queue", 0.15))
OEE_HIT_CAP, OEE_HIT_PER_8H = 35.0, 58.0
RISK_HIGH_HOURS, RISK_MEDIUM_HOURS = 6.0, 3.0
FALLBACK_SHARE = 0.85  # no downstream station starved: the final assembly takes 0.85 x outage hours
SHARED_BLOCK_SHARE = 0.82  # outage of the shared final assembly blocks each line's last station at 0.82 x hours
FINAL_ASSEMBLY = ("FAL-ASM-01", 60, 42000.0)  # station, rate per hour, unit value
# The production line routes (station, step, buffer hours, rate per hour, unit value, shared).
LINE_ROUTES = {
    "A": (("BDY-STM-01", "Stamping", 0.25, 38, 1200, False), ("BDY-WLD-01", "Robotic Weld", 0.50, 34, 1200, False),
          ("BDY-SLD-01", "Sealing", 0.25, 36, 1200, False), ("BDY-INS-01", "Body Inspect", 0.25, 38, 1200, False),
          ("FAL-ASM-01", "Final Asm", 0.00, 60, 42000, True)),
    "B": (("PNT-PRP-01", "Phosphate", 0.50, 22, 800, False), ("PNT-ECT-01", "E-Coat", 0.50, 18, 800, False),
          ("PNT-BSC-01", "Base Coat", 0.25, 24, 800, False), ("PNT-CLR-01", "Clear Coat", 0.25, 20, 800, False),
          ("PNT-INS-01", "Paint Inspect", 0.25, 28, 800, False), ("FAL-ASM-01", "Final Asm", 0.00, 60, 42000, True)),
    "C": (("PTN-MCH-01", "Block Machine", 0.50, 22, 3200, False), ("PTN-HAD-01", "Head Assembly", 0.25, 28, 3200, False),
          ("PTN-BLD-01", "Engine Build", 0.25, 14, 3200, False), ("PTN-DYN-01", "Dyno Test", 0.50, 11, 3200, False),
          ("FAL-ASM-01", "Final Asm", 0.00, 60, 42000, True)),
}


def sensor_breaches(features: DataFrame) -> DataFrame:
    """Breach flags per reading in long form (unpivot), counted per machine x sensor."""
    cols = [c for c, _, _ in BREACH_RULES]
    long = features.select("machine_id", "ts", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["machine_id", "ts"], cols, "sensor", "value")
    rule = None
    for c, op, lim in BREACH_RULES:
        hit = (F.col("value") > lim) if op == ">" else (F.col("value") < lim)
        rule = F.when(F.col("sensor") == c, hit) if rule is None else rule.when(F.col("sensor") == c, hit)
    return long.withColumn("breach", rule).groupBy("machine_id", "sensor").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("breach")).alias("breaches"), F.max("value").alias("max_value"))


def sensor_zscore(telemetry: DataFrame, value_col: str = "temp_c", window_rows: int = 23) -> DataFrame:
    """W13 + P27: z of each hourly reading against the previous ``window_rows`` readings of the
    same machine; severity from |z|; trend from the sign of z."""
    w = Window.partitionBy("machine_id").orderBy("ts").rowsBetween(-window_rows, -1)
    mean, std = F.avg(value_col).over(w), F.stddev_samp(value_col).over(w)
    z = F.when(std > 0, (F.col(value_col) - mean) / std)
    out = telemetry.select("machine_id", "ts", F.col(value_col).alias("value"), z.alias("z"))
    return out.select(
        "machine_id", "ts", "value", P.round_half_up("z", 4).alias("z"),
        F.when(F.col("z").isNotNull(), P.zscore_severity("z")).alias("severity"),
        F.when(F.col("z") > 1, F.lit("rising")).when(F.col("z") < -1, F.lit("falling")).otherwise(F.lit("stable")).alias("trend"),
    )


def trend_to_threshold(telemetry: DataFrame, as_of: str, value_col: str = "temp_c", threshold: float = 60.0, hours: int = 24) -> DataFrame:
    """The last ``hours`` hourly points per machine before ``as_of``: breach flag, slope per
    hour (least squares) and hours until the threshold at that slope."""
    end = F.lit(as_of).cast("timestamp")
    t = telemetry.filter((F.col("ts") < end) & (F.col("ts") >= end - F.make_interval(hours=F.lit(hours))))
    x = (F.unix_timestamp("ts") / 3600.0)
    g = t.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("points"), F.max(F.col(value_col) > threshold).alias("breached"),
        F.regr_slope(value_col, x).alias("slope"), F.max_by(value_col, "ts").alias("last_value"))
    eta = F.when((F.col("slope") > 0) & (F.col("last_value") < threshold), (F.lit(threshold) - F.col("last_value")) / F.col("slope"))
    return g.select("machine_id", "points", "breached", P.round_half_up("slope", 4).alias("slope_per_hour"),
                    "last_value", P.round_half_up(eta, 1).alias("hours_to_threshold"))


def sensor_trends(features: DataFrame, as_of: str, limits=DRIVING_LIMITS, hours: int = 24) -> DataFrame:
    """W12 for every sensor: the last ``hours`` hourly points before ``as_of`` against the sensor's threshold, per machine.

    ``features`` has a column for each sensor of ``limits(sensor, threshold, direction)``; they are unpivoted, so a machine's
    sensors are separate groups. ``hours_to_threshold`` is 0 once the last value is in breach, the time of the least-squares line to
    the threshold if it moves towards it, else NULL. NULL readings don't count.
    """
    end = F.lit(as_of).cast("timestamp")
    cols = [c for c, _, _ in limits]
    recent = features.filter((F.col("ts") < end) & (F.col("ts") >= end - F.make_interval(hours=F.lit(hours))))
    long = recent.select("machine_id", "ts", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["machine_id", "ts"], cols, "sensor", "value")
    threshold = F.element_at(F.create_map(*[F.lit(x) for c, v, _ in limits for x in (c, v)]), F.col("sensor"))
    side = F.element_at(F.create_map(*[F.lit(x) for c, _, d in limits for x in (c, d)]), F.col("sensor"))
    sign = F.when(side == "above", 1.0).otherwise(-1.0)  # distances grow towards the breach
    x = (F.unix_timestamp("ts") - F.unix_timestamp(end)) / 3600.0
    long = long.filter(F.col("value").isNotNull()).withColumns({"threshold": threshold, "direction": side, "past": sign * (F.col("value") - threshold)})
    g = long.groupBy("machine_id", "sensor", "threshold", "direction").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("past") > 0).alias("breaches"), F.regr_slope("value", x).alias("slope"),
        F.max_by("value", "ts").alias("last_value"))
    gap = F.when(F.col("direction") == "above", F.col("threshold") - F.col("last_value")).otherwise(F.col("last_value") - F.col("threshold"))
    towards = F.when(F.col("direction") == "above", F.col("slope")).otherwise(-F.col("slope"))
    eta = F.when(gap < 0, 0.0).when(towards > 0, gap / towards)
    return g.select("machine_id", "sensor", "direction", "threshold", "points", "breaches", "last_value",
                    P.round_half_up("slope", 4).alias("slope_per_hour"), P.round_half_up(eta, 1).alias("hours_to_threshold"))


def driving_sensor(trends: DataFrame) -> DataFrame:
    """Of each machine's sensors the one that reaches its threshold first (of equally early ones the first by name).

    A machine none of whose sensors is on its way has a NULL time and its first sensor by name.
    """
    first = F.struct(F.col("hours_to_threshold").isNull(), "hours_to_threshold", "sensor")
    cols = ["sensor", "direction", "threshold", "last_value", "slope_per_hour", "hours_to_threshold"]
    g = trends.groupBy("machine_id").agg(
        F.min_by(F.struct(*cols), first).alias("d"), F.count_if(F.col("hours_to_threshold") == 0).alias("sensors_in_breach"))
    return g.select("machine_id", "d.*", "sensors_in_breach")


def spend_outliers(spend: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Robust z = 0.6745 (x - median) / MAD within each group (exact medians by ``operators.quantiles``), variance %
    against the median, tier outlier (|z| > 3.5) / watch (> 2) / normal."""
    med = quantile(spend, [group_col], value_col, 0.5, "med")
    d = spend.join(med, group_col)
    off = d.withColumn("_off", F.abs(F.col(value_col) - F.col("med")))
    mad = quantile(off, [group_col], "_off", 0.5, "mad")
    j = d.join(mad, group_col)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col(value_col) - F.col("med")) / F.col("mad"))
    tier = F.when(F.abs(z) > 3.5, F.lit("outlier")).when(F.abs(z) > 2, F.lit("watch")).otherwise(F.lit("normal"))
    return j.select(*spend.columns, P.round_half_up(z, 4).alias("robust_z"),
                    P.round_half_up(F.when(F.col("med") != 0, (F.col(value_col) - F.col("med")) / F.col("med") * 100), 2).alias("variance_pct"),
                    tier.alias("tier"))


def alarm_response(alarms: DataFrame) -> DataFrame:
    """Minutes from trigger to acknowledgement per severity (unacknowledged counted apart)."""
    mins = (F.unix_timestamp("ack_ts") - F.unix_timestamp("triggered_ts")) / 60.0
    return alarms.groupBy("severity").agg(
        F.count(F.lit(1)).alias("alarms"), F.count("ack_ts").alias("acknowledged"),
        P.round_half_up(F.avg(mins), 2).alias("avg_ack_minutes"), F.max(mins).alias("max_ack_minutes"))


# ---- C1-C3: downtime cascade ---------------------------------------------------------------------


def route_table(spark: SparkSession) -> DataFrame:
    """The line routes as a small dimension (line, idx, station, buffer, rate, value, shared)."""
    rows = [(line, i, sid, step, float(buf), int(rate), float(val), shared)
            for line, stations in LINE_ROUTES.items() for i, (sid, step, buf, rate, val, shared) in enumerate(stations)]
    return spark.createDataFrame(rows, "line string, idx int, station string, step string, buffer double, rate int, "
                                       "unit_value double, shared boolean")


def outages_at_stations(events: DataFrame, route: DataFrame) -> DataFrame:
    """Fault outages (hours) placed on route stations: a machine of line L sits on station
    (machine number div 3) mod (stations of L), so some outages hit the shared final assembly."""
    n = F.regexp_extract("machine_id", r"([0-9]+)$", 1).cast("int")
    f = events.filter((F.col("state") == "fault") & F.col("duration_minutes").isNotNull() & F.col("line").isNotNull())
    sizes = route.groupBy("line").agg(F.count(F.lit(1)).alias("k"))
    o = f.join(F.broadcast(sizes), "line").select(  # route: fixed 16 rows
        F.col("event_id").alias("outage_id"), "line", (F.floor(n / 3) % F.col("k")).cast("int").alias("idx"),
        (F.col("duration_minutes") / 60.0).alias("hours"))
    return o


def _last_before_shared() -> list[tuple[str, str, int, float]]:
    """Per line, the station just before the shared final assembly (fixed route data)."""
    out = []
    for line, st in LINE_ROUTES.items():
        sid, _step, _buf, rate, val, shared = st[-2]
        if not shared:
            out.append((line, sid, rate, float(val)))
    return out


def cascade_raw(outages: DataFrame, route: DataFrame, hops: int = CASCADE_HOPS, decay: float = CASCADE_DECAY) -> DataFrame:
    """C1 with unrounded hours: the stations an outage starves (level-1 nodes of the impact graph).

    * Normal station: up to ``hops`` downstream stations of its line, impact = max(0, remaining -
      buffer), stop at the first impact below 0.05, remaining = ``decay`` x impact.
    * Nothing starved (last station, or the first impact below 0.05): the final assembly takes
      0.85 x the outage hours.
    * Shared final assembly down: the last station of every line is blocked at 0.82 x hours.

    Every join is with the fixed route (16 rows, broadcast), so the cascade is map-only: the
    unrolled hops replace recursion and no row ever leaves its task."""
    r = F.broadcast(route.select("line", "idx", "station", "buffer", "rate", "unit_value", "shared"))  # fixed 16 rows
    src = outages.join(r, ["line", "idx"]).select(
        "outage_id", "line", "idx", "hours", F.col("station").alias("origin_station"), "shared",
        F.col("unit_value").alias("src_unit_value"))
    # five branches below (three hops, fallback, shared station) read the outages; a reliable
    # checkpoint computes them once instead of re-running the event scan and state windows per branch
    src = cut_lineage(src)
    keep = ["outage_id", "origin_station", "hours", "src_unit_value"]
    normal = src.filter(~F.col("shared"))
    cur = normal.select(*keep, "line", "idx", F.col("hours").alias("rem"))
    parts = []
    for k in range(1, hops + 1):
        nxt = cur.select(*keep, "line", (F.col("idx") + 1).alias("idx"), "rem").join(r.drop("shared"), ["line", "idx"])
        nxt = nxt.withColumn("impact_hours", F.greatest(F.lit(0.0), F.col("rem") - F.col("buffer"))).filter(
            F.col("impact_hours") >= CASCADE_STOP)
        nxt = nxt.select(*keep, "line", "idx", "station", F.lit(k).alias("hop"), "impact_hours", "rate", "unit_value",
                         (F.col("impact_hours") * decay).alias("rem"))
        parts.append(nxt.drop("idx", "rem"))
        cur = nxt
    # nothing starved <=> the first hop is missing or below the stop level (hop k needs hop k - 1)
    nr = r.select("line", (F.col("idx") - 1).alias("idx"), F.col("buffer").alias("next_buffer"))
    first = normal.join(nr, ["line", "idx"], "left")
    starved = F.col("next_buffer").isNotNull() & (F.greatest(F.lit(0.0), F.col("hours") - F.col("next_buffer")) >= CASCADE_STOP)
    fa_station, fa_rate, fa_value = FINAL_ASSEMBLY
    parts.append(first.filter(~starved).select(
        *keep, "line", F.lit(fa_station).alias("station"), F.lit(1).alias("hop"),
        (F.col("hours") * FALLBACK_SHARE).alias("impact_hours"), F.lit(fa_rate).alias("rate"), F.lit(fa_value).alias("unit_value")))
    blocked = F.explode(F.array(*[
        F.struct(F.lit(line).alias("line"), F.lit(sid).alias("station"), F.lit(rate).alias("rate"), F.lit(val).alias("unit_value"))
        for line, sid, rate, val in _last_before_shared()]))
    sh = src.filter(F.col("shared")).select(*keep, blocked.alias("b"))
    parts.append(sh.select(*keep, F.col("b.line").alias("line"), F.col("b.station").alias("station"), F.lit(1).alias("hop"),
                           (F.col("hours") * SHARED_BLOCK_SHARE).alias("impact_hours"), F.col("b.rate").alias("rate"),
                           F.col("b.unit_value").alias("unit_value")))
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.withColumn("hop", F.col("hop").cast("int")).withColumn("rate", F.col("rate").cast("int"))


def cascade(outages: DataFrame, route: DataFrame, hops: int = CASCADE_HOPS, decay: float = CASCADE_DECAY) -> DataFrame:
    """C1 result rows (hours rounded to 4 dp for display)."""
    c = cascade_raw(outages, route, hops, decay)
    return c.select("outage_id", "origin_station", "line", "station", "hop", P.round_half_up("impact_hours", 4).alias("impact_hours"),
                    "rate", "unit_value")


def impact_split(casc: DataFrame) -> DataFrame:
    """Each starved station's hours split 58 / 27 / 15 over revenue loss, delivery risk, WIP queue."""
    arr = F.array(*[F.struct(F.lit(n).alias("link"), F.lit(s).alias("share")) for n, s in IMPACT_SPLIT])
    x = casc.select("outage_id", "station", "hop", "impact_hours", F.explode(arr).alias("s"))
    return x.select("outage_id", "station", "hop", F.col("s.link").alias("link"),
                    P.round_half_up(F.col("impact_hours") * F.col("s.share"), 4).alias("value"))


def impact_kpis(casc: DataFrame) -> DataFrame:
    """C3 per outage over the unrounded cascade: units lost = round(sum impact x rate); revenue =
    units lost x the source station's unit value; OEE hit = min(35, round1(hours / 8 x 58));
    delivery risk from the total starved hours (HIGH > 6, MEDIUM > 3)."""
    g = casc.groupBy("outage_id", "origin_station", "hours", "src_unit_value").agg(
        F.count(F.lit(1)).alias("stations"),
        F.sum(F.col("impact_hours") * F.col("rate")).alias("u"),
        F.sum("impact_hours").alias("total"))
    units = F.floor(F.col("u") + 0.5).cast("bigint")
    return g.select(
        "outage_id", "origin_station", "stations", units.alias("units_lost"),
        (units * F.col("src_unit_value")).alias("revenue_impact"),
        P.round_half_up("total", 4).alias("total_impact_hours"),
        F.least(F.lit(OEE_HIT_CAP), P.round_half_up(F.col("hours") / 8 * OEE_HIT_PER_8H, 1)).alias("oee_hit_pts"),
        F.when(F.col("total") > RISK_HIGH_HOURS, F.lit("HIGH")).when(F.col("total") > RISK_MEDIUM_HOURS, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW")).alias("delivery_risk"))


_ = Column


# ---- C4: rework routing cost --------------------------------------------------------------------

# The reference's routing per disposition (station, minutes), in routing order.
REWORK_ROUTES = {
    "SCRAP": (("E-Coat Strip & Clean", 45), ("Phosphate Pre-Treatment", 30), ("E-Coat Re-dip", 60),
              ("Base Coat", 25), ("Clear Coat", 20), ("Final Inspection", 15)),
    "REWORK": (("Localised Strip & Feather", 20), ("Spot Phosphate Treatment", 15), ("Spot E-Coat Touch-Up", 35),
               ("Base Coat Blend", 20), ("Clear Coat Blend", 18), ("Final Inspection", 10)),
}


def routing_table(spark: SparkSession) -> DataFrame:
    rows = [(d, i + 1, st, m) for d, route in REWORK_ROUTES.items() for i, (st, m) in enumerate(route)]
    return spark.createDataFrame(rows, "decision string, seq int, station string, minutes int")


def rework_routing_cost(decisions: DataFrame) -> DataFrame:
    """C4 per decision x station: images routed, station minutes per image and in total. Images are
    counted per decision first (map-side partial count), so the fixed 12-row routing is joined to
    at most one row per decision instead of being exploded per image."""
    counts = decisions.filter(F.col("decision").isNotNull()).groupBy("decision").agg(F.count(F.lit(1)).alias("images"))
    route = F.broadcast(routing_table(decisions.sparkSession))  # fixed 12 rows
    return counts.join(route, "decision").select(
        "decision", "seq", "station", "minutes", "images", (F.col("images") * F.col("minutes")).alias("total_minutes"))


def rework_cost_by_decision(decisions: DataFrame) -> DataFrame:
    """C4 per decision: images, routing minutes per image (sum over stations) and total minutes."""
    per = rework_routing_cost(decisions)
    return per.groupBy("decision", "images").agg(
        F.count(F.lit(1)).alias("stations"), F.sum("minutes").alias("minutes_per_image"),
        F.sum("total_minutes").alias("total_minutes"))
