"""Reliability, cascade, nested-document, filter and action queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.operators import commercial as C
from millrun.operators import erp, finance as FI, plant, planning as PL
from millrun.operators import reliability as R
from millrun.plans.commercial_queries import _SC_SQL
from millrun.plans.erp_queries import SQL_DELIVERY_LINES, SQL_INV_GOLD, SQL_INV_POS, SQL_ORDER_LINES, SQL_PROC_GOLD, SQL_PROC_LINES
from millrun.plans.finance_queries import SQL_PL
from millrun.plans.ml_queries import SQL_FEATURES, _BINDS, _CTES, _features
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.plant_queries import SQL_ALARMS, SQL_STATE_EVENTS, SQL_TELEMETRY, TS_AS_OF
from millrun.plans.planning_queries import SQL_ACC
from millrun.plans.registry import query
from millrun.sources import bindings as B


def RH(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10**d} + 0.5) / {10**d})"


# ---- P26 sensor breaches ------------------------------------------------------------------------
_BCOLS = [c for c, _, _ in R.BREACH_RULES]
_BRULE = "CASE sensor " + " ".join(f"WHEN '{c}' THEN value {op} {lim}" for c, op, lim in R.BREACH_RULES) + " END"


@query(
    "sensor_breaches",
    W(_BINDS, _CTES + [("f", SQL_FEATURES)],
      f"""WITH c AS (SELECT machine_id, ts, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _BCOLS)} FROM f),
          u AS (UNPIVOT c ON {", ".join(_BCOLS)} INTO NAME sensor VALUE value)
        SELECT machine_id, sensor, count(*) AS readings, count_if({_BRULE}) AS breaches, max(value) AS max_value
        FROM u GROUP BY machine_id, sensor"""),
)
def q_sensor_breaches(t):
    """Breach counts per machine x sensor from the long (unpivoted) feature table."""
    return R.sensor_breaches(_features(t))


# ---- W13 + P27 ----------------------------------------------------------------------------------
def _tel(t):
    return plant.telemetry_silver(B.machine_telemetry_raw(t))


@query(
    "sensor_zscore",
    W(["machine_telemetry_raw"], [("tel", SQL_TELEMETRY)],
      f"""WITH w AS (SELECT machine_id, ts, temp_c AS value,
                   avg(temp_c) OVER (PARTITION BY machine_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS m,
                   stddev_samp(temp_c) OVER (PARTITION BY machine_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS s
                 FROM tel),
            z AS (SELECT *, CASE WHEN s > 0 THEN (value - m) / s END AS z FROM w)
        SELECT machine_id, ts, value, {RH("z", 4)} AS z,
               CASE WHEN z IS NOT NULL THEN CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END END
                   AS severity,
               CASE WHEN z > 1 THEN 'rising' WHEN z < -1 THEN 'falling' ELSE 'stable' END AS trend FROM z"""),
)
def q_sensor_zscore(t):
    """W13 + P27 on hourly temperature per machine."""
    return R.sensor_zscore(_tel(t))


@query(
    "trend_to_threshold",
    W(["machine_telemetry_raw"], [("tel", SQL_TELEMETRY)],
      f"""WITH l AS (SELECT * FROM tel WHERE ts < {TS_AS_OF} AND ts >= {TS_AS_OF} - INTERVAL 24 HOUR),
            g AS (SELECT machine_id, count(*) AS points, bool_or(temp_c > 60.0) AS breached,
                         regr_slope(temp_c, epoch(ts) / 3600.0) AS slope, arg_max(temp_c, ts) AS last_value FROM l GROUP BY 1)
        SELECT machine_id, points, breached, {RH("slope", 4)} AS slope_per_hour, last_value,
               {RH("CASE WHEN slope > 0 AND last_value < 60.0 THEN (60.0 - last_value) / slope END", 1)} AS hours_to_threshold FROM g"""),
)
def q_trend_to_threshold(t):
    """Last-24 h temperature trend per machine vs the 60 degree limit."""
    return R.trend_to_threshold(_tel(t), B.AS_OF_EVENTS)


_LIMITS = "(VALUES " + ", ".join(f"('{c}', CAST({v} AS DOUBLE), '{d}')" for c, v, d in R.DRIVING_LIMITS) + ") k(sensor, threshold, direction)"
_LCOLS = [c for c, _, _ in R.DRIVING_LIMITS]
SQL_TRENDS = f"""SELECT machine_id, sensor, direction, threshold, points, breaches, last_value, {RH("slope", 4)} AS slope_per_hour,
        {RH("CASE WHEN beyond THEN 0.0 WHEN direction = 'above' AND slope > 0 OR direction = 'below' AND slope < 0 THEN (threshold - last_value) / slope END", 1)}
            AS hours_to_threshold
    FROM (SELECT machine_id, sensor, direction, threshold, count(*) AS points, regr_slope(value, date_diff('hour', {TS_AS_OF}, ts)) AS slope,
                 count_if(if(direction = 'above', value > threshold, value < threshold)) AS breaches, arg_max(value, ts) AS last_value,
                 arg_max(if(direction = 'above', value > threshold, value < threshold), ts) AS beyond
          FROM (SELECT machine_id, ts, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _LCOLS)} FROM f
                WHERE ts >= {TS_AS_OF} - INTERVAL 24 HOUR AND ts < {TS_AS_OF}) c
          UNPIVOT (value FOR sensor IN ({", ".join(_LCOLS)})) JOIN {_LIMITS} USING (sensor) GROUP BY ALL)"""


@query("sensor_trends", W(_BINDS, _CTES + [("f", SQL_FEATURES)], SQL_TRENDS))
def q_sensor_trends(t):
    """W12 for every sensor with its direction, last 24 hours."""
    return R.sensor_trends(_features(t), B.AS_OF_EVENTS)


@query(
    "driving_sensor",
    W(_BINDS, _CTES + [("f", SQL_FEATURES), ("tr", SQL_TRENDS)],
      """SELECT machine_id, sensor, direction, threshold, last_value, slope_per_hour, hours_to_threshold, sensors_in_breach
         FROM (SELECT *, count_if(hours_to_threshold = 0) OVER (PARTITION BY machine_id) AS sensors_in_breach,
                      row_number() OVER (PARTITION BY machine_id ORDER BY hours_to_threshold NULLS LAST, sensor) AS r FROM tr) WHERE r = 1"""),
)
def q_driving_sensor(t):
    """The sensor of each machine that reaches its threshold first."""
    return R.driving_sensor(R.sensor_trends(_features(t), B.AS_OF_EVENTS))


# ---- W18 spend outliers -------------------------------------------------------------------------
def _supplier_spend(t):
    li = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    s = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(t.region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_suppkey").alias("supplier"), F.col("r_name").alias("department"), "spend")


@query(
    "spend_outliers",
    f"""WITH sp AS (SELECT l_suppkey AS supplier, r_name AS department, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
                    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
          md AS (SELECT department, median(spend) AS med FROM sp GROUP BY 1),
          d AS (SELECT sp.*, md.med FROM sp JOIN md ON sp.department = md.department),
          ma AS (SELECT department, median(abs(spend - med)) AS mad FROM d GROUP BY 1),
          j AS (SELECT d.*, ma.mad, CASE WHEN ma.mad > 0 THEN 0.6745 * (spend - med) / ma.mad END AS z FROM d JOIN ma ON d.department = ma.department)
     SELECT supplier, department, spend, {RH("z", 4)} AS robust_z,
            {RH("CASE WHEN med <> 0 THEN (spend - med) / med * 100 END", 2)} AS variance_pct,
            CASE WHEN abs(z) > 3.5 THEN 'outlier' WHEN abs(z) > 2 THEN 'watch' ELSE 'normal' END AS tier FROM j""",
)
def q_spend_outliers(t):
    """Robust z of supplier spend within its region (exact median and MAD)."""
    return R.spend_outliers(_supplier_spend(t), "department", "spend")


@query(
    "alarm_response",
    W(["alarm_events_raw", "machine_master"], [("al", SQL_ALARMS)],
      f"""SELECT severity, count(*) AS alarms, count(ack_ts) AS acknowledged,
             {RH("avg(date_diff('second', triggered_ts, ack_ts) / 60.0)", 2)} AS avg_ack_minutes,
             max(date_diff('second', triggered_ts, ack_ts) / 60.0) AS max_ack_minutes FROM al GROUP BY severity"""),
)
def q_alarm_response(t):
    """Trigger-to-acknowledge minutes per severity."""
    return R.alarm_response(plant.alarms_silver(B.alarm_events_raw(t), B.machine_master(t), B.AS_OF_EVENTS))


# ---- C1-C3 cascade --------------------------------------------------------------------------------
_ROUTE = "(VALUES " + ", ".join(
    f"('{line}', {i}, '{sid}', CAST({buf} AS DOUBLE), {rate}, CAST({val} AS DOUBLE), {str(sh).upper()})"
    for line, st in R.LINE_ROUTES.items() for i, (sid, _s, buf, rate, val, sh) in enumerate(st)
) + ") r(line, idx, station, buffer, rate, unit_value, shared)"


def _hop(k: int, prev: str) -> str:
    return f"""h{k} AS (SELECT * FROM (SELECT p.outage_id, p.origin_station, p.hours, p.src_unit_value, p.line, rt.idx, rt.station,
                                   {k} AS hop, greatest(0.0, p.rem - rt.buffer) AS impact, rt.rate, rt.unit_value
                            FROM {prev} p JOIN rt ON p.line = rt.line AND rt.idx = p.idx + 1) x
             CROSS JOIN LATERAL (SELECT x.impact * 0.75 AS rem) y WHERE impact >= 0.05)"""


_COLS = "outage_id, origin_station, hours, src_unit_value, line, station, hop, impact, rate, unit_value"
SQL_CASCADE_RAW = f"""WITH rt AS (SELECT * FROM {_ROUTE}),
      k AS (SELECT line, count(*) AS k FROM rt GROUP BY line),
      o AS (SELECT e.event_id AS outage_id, e.line,
                   CAST(floor(CAST(regexp_extract(e.machine_id, '([0-9]+)$', 1) AS INTEGER) / 3) % k.k AS INTEGER) AS idx,
                   e.duration_minutes / 60.0 AS hours
            FROM se e JOIN k ON e.line = k.line WHERE e.state = 'fault' AND e.duration_minutes IS NOT NULL),
      src AS (SELECT o.*, rt.station AS origin_station, rt.shared, rt.unit_value AS src_unit_value
              FROM o JOIN rt ON o.line = rt.line AND o.idx = rt.idx),
      h0 AS (SELECT outage_id, origin_station, hours, src_unit_value, line, idx, hours AS rem FROM src WHERE NOT shared),
      {_hop(1, "h0")}, {_hop(2, "h1")}, {_hop(3, "h2")},
      fb AS (SELECT outage_id, origin_station, hours, src_unit_value, line, 'FAL-ASM-01' AS station, 1 AS hop,
                    hours * 0.85 AS impact, 60 AS rate, CAST(42000 AS DOUBLE) AS unit_value
             FROM h0 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.outage_id = h0.outage_id)),
      lb AS (SELECT r1.line, r1.station, r1.rate, r1.unit_value FROM rt r1 JOIN k ON r1.line = k.line
             WHERE r1.idx = k.k - 2 AND NOT r1.shared),
      sh AS (SELECT s.outage_id, s.origin_station, s.hours, s.src_unit_value, lb.line, lb.station, 1 AS hop,
                    s.hours * 0.82 AS impact, lb.rate, lb.unit_value FROM src s, lb WHERE s.shared)
    SELECT {_COLS} FROM h1 UNION ALL SELECT {_COLS} FROM h2 UNION ALL SELECT {_COLS} FROM h3
    UNION ALL SELECT {_COLS} FROM fb UNION ALL SELECT {_COLS} FROM sh"""
_SE = ["production_events_raw", "machine_master"]
_CR = [("se", SQL_STATE_EVENTS), ("cr", SQL_CASCADE_RAW)]


def _cascade_raw(t):
    route = R.route_table(t.spark)
    ev = plant.state_events_silver(B.production_events_raw(t), B.machine_master(t))
    return R.cascade_raw(R.outages_at_stations(ev, route), route)


@query(
    "downtime_cascade",
    W(_SE, _CR, f"""SELECT outage_id, origin_station, line, station, CAST(hop AS INTEGER) AS hop, {RH("impact", 4)} AS impact_hours,
                          CAST(rate AS INTEGER) AS rate, unit_value FROM cr"""),
)
def q_downtime_cascade(t):
    """Stations starved by each fault outage: up to three downstream hops, the final-assembly
    fallback, and the shared-station case that blocks every line."""
    c = _cascade_raw(t)
    return c.select("outage_id", "origin_station", "line", "station", "hop", P.round_half_up("impact_hours", 4).alias("impact_hours"),
                    "rate", "unit_value")


@query(
    "cascade_impact_split",
    W(_SE, _CR,
      f"""SELECT outage_id, station, CAST(hop AS INTEGER) AS hop, s.link, {RH("impact * s.share", 4)} AS value
          FROM cr, (VALUES ('Revenue Loss', CAST(0.58 AS DOUBLE)), ('Delivery Risk', CAST(0.27 AS DOUBLE)),
                           ('WIP Queue', CAST(0.15 AS DOUBLE))) s(link, share)"""),
)
def q_cascade_impact_split(t):
    """Starved hours split over revenue loss, delivery risk and WIP queue."""
    return R.impact_split(_cascade_raw(t))


@query(
    "cascade_impact_kpis",
    W(_SE, _CR,
      f"""WITH g AS (SELECT outage_id, origin_station, hours, src_unit_value, count(*) AS stations, sum(impact * rate) AS u,
                          sum(impact) AS total FROM cr GROUP BY 1, 2, 3, 4)
        SELECT outage_id, origin_station, stations, CAST(floor(u + 0.5) AS BIGINT) AS units_lost,
               CAST(floor(u + 0.5) AS BIGINT) * src_unit_value AS revenue_impact, {RH("total", 4)} AS total_impact_hours,
               least(35.0, {RH("hours / 8 * 58.0", 1)}) AS oee_hit_pts,
               CASE WHEN total > 6 THEN 'HIGH' WHEN total > 3 THEN 'MEDIUM' ELSE 'LOW' END AS delivery_risk FROM g"""),
)
def q_cascade_impact_kpis(t):
    """C3 per outage: units lost, revenue impact at the source unit value, OEE hit, delivery risk."""
    return R.impact_kpis(_cascade_raw(t))


# ---- J16 nested document ---------------------------------------------------------------------------
@query(
    "inspection_documents",
    W(["inspection_records", "inspection_rows"], [],
      """SELECT r.id, r.product, count(ir.id) AS n_rows, list(ir.id ORDER BY ir.id) FILTER (WHERE ir.id IS NOT NULL) AS row_ids,
                list(ir.piece_iqa ORDER BY ir.id) FILTER (WHERE ir.id IS NOT NULL) AS iqa
         FROM inspection_records r LEFT JOIN inspection_rows ir ON ir.record_id = r.id GROUP BY r.id, r.product"""),
)
def q_inspection_documents(t):
    """Each record with its rows nested in order (one grouped collect per record, no N+1)."""
    rows = B.inspection_rows(t)
    nested = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.sort_array(F.collect_list(F.struct("id", "piece_iqa"))).alias("r"))
    recs = B.inspection_records(t).select("id", "product")
    j = recs.join(nested, recs.id == nested.record_id, "left")
    return j.select("id", "product", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.transform("r", lambda x: x["id"]).alias("row_ids"),
                    F.transform("r", lambda x: x["piece_iqa"]).alias("iqa"))


# ---- P43 + P44 filters -------------------------------------------------------------------------------
@query(
    "pl_filtered",
    W(["finance_lines"], [("pl", SQL_PL)],
      """SELECT * FROM pl WHERE period_key LIKE 'FY2000%' AND fiscal_quarter IN (1, 2) AND region IN ('AMERICA', 'EUROPE')"""),
)
def q_pl_filtered(t):
    """P43 + P44: fiscal-year prefix, first half and region predicates on the P&L."""
    pl = FI.pl_summary(B.finance_lines(t))
    year = pl.filter(F.col("period_key").startswith("FY2000"))
    return P.dynamic_filter(year, fiscal_quarter=[1, 2], region=["AMERICA", "EUROPE"])


# ---- F5 action generation ------------------------------------------------------------------------
_DOS = f"""WITH st AS (SELECT material_number, CAST(sum(unrestricted_stock) AS BIGINT) AS stock FROM inv_gold GROUP BY 1),
          dm AS (SELECT material_number, CAST(sum(order_quantity) AS BIGINT) AS qty FROM ol
                 WHERE date_diff('day', TRY_CAST(order_date AS DATE), DATE '{B.AS_OF_ORDERS}') BETWEEN 0 AND 364 GROUP BY 1)
     SELECT st.material_number, coalesce(dm.qty, 0) AS annual_demand, st.stock,
            CASE WHEN coalesce(dm.qty, 0) > 0 THEN floor((st.stock * 365 * 20 + dm.qty) / (dm.qty * 2)) / 10 END AS dos
     FROM st LEFT JOIN dm ON st.material_number = dm.material_number"""
_HEALTH = """CASE WHEN stock = 0 THEN 'stockout' WHEN dos >= 7 AND dos < 30 THEN 'at_risk' WHEN dos >= 30 AND dos <= 90 THEN 'optimal'
                  WHEN dos < 7 THEN 'stockout' ELSE 'excess' END"""


#: Binding of the status log: an event is an entry about the reorder of the material that has its user's number.
LOG_STATUS = (("view", "acknowledged"), ("click", "in_progress"), ("signup", "reopened"), ("purchase", "done"), ("error", "rejected"))
_PAIRS_SQL = """SELECT sku || '/' || from_branch || '/' || to_branch AS entity_id, qty, sku_cost FROM (
    SELECT e.sku, e.branch_id AS from_branch, n.branch_id AS to_branch, e.sku_cost, least(e.e_end, n.n_end, e.cap) - greatest(e.e_end - e.excess, n.n_end - n.need) AS qty
    FROM lanes e JOIN lanes n ON e.sku = n.sku AND e.excess > 0 AND n.need > 0) WHERE qty > 0"""
_LANES_SQL = """SELECT *, sum(excess) OVER (PARTITION BY sku ORDER BY branch_id) AS e_end, sum(need) OVER (PARTITION BY sku ORDER BY branch_id) AS n_end,
        least(sum(excess) OVER (PARTITION BY sku), sum(need) OVER (PARTITION BY sku)) AS cap, arg_min(cost, branch_id) OVER (PARTITION BY sku) AS sku_cost
    FROM (SELECT sku, branch_id, min(unit_cost) AS cost,
                 greatest(sum(coalesce(available_stock, 0)) - sum(coalesce(safety_stock, 0)), 0) AS excess,
                 greatest(sum(coalesce(safety_stock, 0)) - sum(coalesce(available_stock, 0)), 0) AS need FROM stock_network GROUP BY 1, 2)"""
# The life cycle by a walk over each action's entries: since the last reopening the first closing entry, else the last entry.
_STATE_SQL = """SELECT action_id, any_value(n) AS n_changes,
        coalesce(arg_min(struct_pack(s := status, t := ts), (ts, event_id)) FILTER (WHERE status IN ('done', 'rejected')),
                 arg_max(struct_pack(s := status, t := ts), (ts, event_id))) AS st
    FROM (SELECT *, count(*) OVER (PARTITION BY action_id) AS n, count(*) FILTER (WHERE status = 'reopened') OVER (PARTITION BY action_id) AS openings,
                 count(*) FILTER (WHERE status = 'reopened') OVER (PARTITION BY action_id ORDER BY ts, event_id) AS opened
          FROM (SELECT 'reorder:' || user_id::VARCHAR AS action_id, event_id, ts, CASE event_type """ + " ".join(
    f"WHEN '{e}' THEN '{st}'" for e, st in LOG_STATUS) + """ END AS status FROM events))
    WHERE opened = openings GROUP BY 1"""


def _status_log(t):
    status = F.element_at(F.create_map(*[F.lit(x) for pair in LOG_STATUS for x in pair]), F.col("event_type"))
    return t.events.select(F.col("event_id").alias("entry_id"), F.concat(F.lit("reorder:"), F.col("user_id").cast("string")).alias("action_id"),
                           status.alias("status"), F.col("ts").cast("timestamp").alias("changed_at"))


@query(
    "action_generation",
    W(["mard", "vbap", "vbak", "demand_history", "ekpo", "ekko", "lips", "likp", "stock_network"],
      [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD), ("ol", SQL_ORDER_LINES), ("dos0", _DOS),
       ("dos", f"SELECT *, {_HEALTH} AS health FROM dos0"), ("acc", SQL_ACC),
       ("cm", f"SELECT category, {RH('sum(round(bias_pct * 10)) / count(*) / 10', 2)} AS mean_bias_pct FROM acc WHERE actual_qty > 0 GROUP BY 1"),
       ("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD), ("dl", SQL_DELIVERY_LINES), ("sc", _SC_SQL),
       ("lanes", _LANES_SQL), ("pairs", _PAIRS_SQL), ("state", _STATE_SQL)],
      f"""WITH a AS (
          SELECT 'reorder' AS action_type, material_number AS entity_id,
                 CASE WHEN health = 'stockout' THEN 'Critical' ELSE 'High' END AS priority, CAST(annual_demand AS DOUBLE) AS impact,
                 DATE '{B.AS_OF_ORDERS}' + 3 AS due_date FROM dos WHERE health IN ('at_risk', 'stockout')
          UNION ALL
          SELECT 'forecast_override', category, 'Medium', mean_bias_pct, DATE '{B.AS_OF_ORDERS}' + 7 FROM cm
          WHERE abs(mean_bias_pct) > 5
          UNION ALL
          SELECT 'escalate_supplier', supplier_number, 'High', spend_usd, DATE '{B.AS_OF_ORDERS}' + 5 FROM sc
          WHERE on_time_pct < 50
          UNION ALL
          SELECT 'lateral_transfer', entity_id, if({RH("qty * sku_cost", 2)} >= 10000, 'High', 'Medium'), {RH("qty * sku_cost", 2)},
                 DATE '{B.AS_OF_ORDERS}' + 2 FROM pairs)
        SELECT a.*, action_type || ':' || entity_id AS action_id, coalesce(if(st.s = 'reopened', 'pending', st.s), 'pending') AS status,
               st.t AS status_since, coalesce(n_changes, 0) AS n_changes
        FROM a LEFT JOIN state ON state.action_id = action_type || ':' || entity_id"""),
)
def q_action_generation(t):
    """reorder / forecast-override / supplier-escalation / transfer actions from the A46, A18, A45 and O4 rules, and their status."""
    ol = erp.order_lines(B.vbap(t), B.vbak(t))
    dos = PL.days_of_supply(erp.inventory_gold(erp.inventory_positions(B.mard(t))), ol, B.AS_OF_ORDERS)
    cm = PL.category_mape(PL.forecast_accuracy(B.demand_history(t)))
    proc = erp.procurement_gold(erp.procurement_lines(B.ekpo(t), B.ekko(t)))
    sc = PL.supplier_scorecard(proc, erp.delivery_lines(B.lips(t), B.likp(t)))
    return C.action_generation(dos, cm, sc, B.AS_OF_ORDERS, PL.rebalance_pairs(B.stock_network(t)), _status_log(t))


# ---- control tower payload ---------------------------------------------------------------------------
@query(
    "control_tower_payload",
    W(["ekpo", "ekko", "mard", "wo_mst", "lips", "likp", "vbap", "vbak"], [],
      """SELECT 'procurement' AS record_set, CAST(json_object('po', ebeln, 'vendor', coalesce(lifnr, ''), 'vendorName', coalesce(lifnr, ''),
                'material', coalesce(matnr, ''), 'qty', coalesce(menge, 0), 'value', coalesce(netwr, 0.0), 'status', 'Open', 'delivery', coalesce(eindt, '')) AS VARCHAR) AS payload
         FROM ekpo LEFT JOIN ekko USING (ebeln)
         UNION ALL
         SELECT 'inventory', json_object('material', matnr, 'plant', werks, 'storageLoc', lgort, 'unrestricted', labst, 'blocked', speme,
                                         'inTransit', 0, 'reorderPoint', coalesce(eisbe, 0))::VARCHAR FROM mard
         UNION ALL
         SELECT 'manufacturing', json_object('order', wono, 'material', part, 'plant', site, 'qty', qty_ord, 'status', ord_status,
                                             'start', CAST(start_date AS VARCHAR), 'end', CAST(due_date AS VARCHAR))::VARCHAR FROM wo_mst
         UNION ALL
         SELECT 'logistics', json_object('delivery', vbeln, 'shipTo', coalesce(kunnr, ''), 'material', matnr, 'qty', lfimg, 'status', '',
                                         'planned', coalesce(lfdat, ''), 'carrier', coalesce(tragr, ''))::VARCHAR FROM lips LEFT JOIN likp USING (vbeln)
         UNION ALL
         SELECT 'demand', json_object('order', vbeln, 'customer', coalesce(kunnr, ''), 'material', matnr, 'qty', kwmeng, 'requestDate', edatu,
                                      'status', coalesce(absta, ''), 'forecastQty', 0)::VARCHAR FROM vbap LEFT JOIN vbak USING (vbeln)"""),
)
def q_control_tower_payload(t):
    """Five record sets as JSON records of one table."""
    return C.control_tower_payload({
        "procurement": B.ekpo(t).join(B.ekko(t), "ebeln", "left"),
        "inventory": B.mard(t),
        "manufacturing": B.wo_mst(t),
        "logistics": B.lips(t).join(B.likp(t), "vbeln", "left"),
        "demand": B.vbap(t).join(B.vbak(t), "vbeln", "left"),
    })


# ---- C4 rework routing cost ------------------------------------------------------------------------
_RR = "(VALUES " + ", ".join(
    f"('{d}', {i + 1}, '{st}', {m})" for d, route in R.REWORK_ROUTES.items() for i, (st, m) in enumerate(route)
) + ") r(decision, seq, station, minutes)"
SQL_REWORK = f"""SELECT r.decision, r.seq, r.station, r.minutes, count(*) AS images, CAST(count(*) * r.minutes AS BIGINT) AS total_minutes
    FROM inspection_decisions d JOIN {_RR} ON r.decision = d.decision GROUP BY r.decision, r.seq, r.station, r.minutes"""


@query("rework_routing_cost", W(["inspection_decisions"], [], SQL_REWORK))
def q_rework_routing_cost(t):
    """C4: station minutes per disposition (scrap / rework) over the defective inspection images."""
    return R.rework_routing_cost(B.inspection_decisions(t))


@query(
    "rework_cost_by_decision",
    W(["inspection_decisions"], [("rr", SQL_REWORK)],
      """SELECT decision, images, count(*) AS stations, sum(minutes) AS minutes_per_image, sum(total_minutes) AS total_minutes
         FROM rr GROUP BY decision, images"""),
)
def q_rework_cost_by_decision(t):
    """C4: routing minutes per image and in total for each disposition."""
    return R.rework_cost_by_decision(B.inspection_decisions(t))
