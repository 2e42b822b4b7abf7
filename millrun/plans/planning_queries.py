"""Planning and forecasting queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import erp, planning as PL
from millrun.plans.erp_queries import SQL_DELIVERY_LINES, SQL_INV_GOLD, SQL_INV_POS, SQL_ORDER_LINES, SQL_PROC_GOLD, SQL_PROC_LINES
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import query
from millrun.session import spread
from millrun.sources import bindings as B


def RH(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10**d} + 0.5) / {10**d})"


def HD(num: str, den: str, d: int) -> str:
    return f"(floor((({num}) * {2 * 10**d} + ({den})) / (({den}) * 2)) / {10**d})"


COUNTRY = B.TARIFF_COUNTRY.lower()

SQL_PLAN = f"""WITH g AS (
        SELECT *, coalesce(product_category, 'Default') AS cat,
               CASE WHEN lower(primary_origin) = '{COUNTRY}' THEN unit_cost * CAST(1.25 AS DOUBLE) ELSE unit_cost END AS ucat
        FROM stock_network
        WHERE (lower(trim(coalesce(region, ''))) = 'fl' OR lower(trim(coalesce(region, ''))) = '')
          AND coalesce(contains(lower(carrier_flag), 'carrier') OR carrier_flag = '1'
                       OR coalesce(trim(carrier_flag), '') = '', FALSE)),
    rws AS (SELECT cat AS product_category, sku, branch_id, sum(coalesce(CAST(available_stock AS DOUBLE), 0.0)) AS stock,
                   sum(coalesce(CAST(safety_stock AS DOUBLE), 0.0)) AS safety, max(upper(trim(location_type))) AS loc,
                   min(ucat) AS cost
            FROM g GROUP BY 1, 2, 3),
    cat AS (SELECT cat AS product_category, count(*) AS n_rows FROM g GROUP BY 1),
    flags AS (SELECT product_category, max(CASE WHEN loc = 'HUB' THEN 1 ELSE 0 END) AS has_hub,
                     max(CASE WHEN loc = 'SPOKE' THEN 1 ELSE 0 END) AS has_spoke FROM rws GROUP BY 1),
    br AS (SELECT product_category, branch_id, sum(stock) AS tot FROM rws GROUP BY 1, 2),
    br2 AS (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY tot DESC, branch_id) AS r,
                   count(*) OVER (PARTITION BY product_category) AS n FROM br),
    rr AS (SELECT x.*, c.n_rows, f.has_hub, f.has_spoke, b.n,
                  CASE WHEN f.has_hub = 1 AND f.has_spoke = 1 THEN x.loc
                       WHEN b.r <= greatest(1, least(b.n - 1, floor(b.n / 2))) THEN 'HUB' ELSE 'SPOKE' END AS role
           FROM rws x JOIN cat c ON x.product_category = c.product_category
           JOIN flags f ON x.product_category = f.product_category
           JOIN br2 b ON x.product_category = b.product_category AND x.branch_id = b.branch_id),
    ff AS (SELECT *, CASE WHEN role = 'HUB' THEN greatest(stock, 0.0) ELSE 0.0 END AS supply,
                  CASE WHEN role = 'SPOKE' THEN greatest(safety - stock, 0.0) ELSE 0.0 END AS need
           FROM rr WHERE n_rows >= 2 AND ((has_hub = 1 AND has_spoke = 1) OR n >= 2) AND role IN ('HUB', 'SPOKE')),
    cc AS (SELECT *,
             sum(supply) OVER (PARTITION BY product_category, sku ORDER BY branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_cum,
             sum(need) OVER (PARTITION BY product_category, sku ORDER BY branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum,
             sum(supply) OVER (PARTITION BY product_category, sku) AS s_tot,
             sum(need) OVER (PARTITION BY product_category, sku) AS n_tot,
             first_value(cost) OVER (PARTITION BY product_category, sku ORDER BY branch_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sku_cost
           FROM ff),
    sh AS (SELECT *, CASE WHEN role = 'HUB' THEN -greatest(0.0, least(s_cum, n_tot) - (s_cum - supply))
                          ELSE greatest(0.0, least(n_cum, s_tot) - (n_cum - need)) END AS shift FROM cc)
    SELECT product_category, sku AS SKU, branch_id AS Branch_ID, role AS location_type,
           shift + 0.0 AS Recommended_Stock_Shift,
           {RH("abs(shift) * sku_cost * CAST(0.15 AS DOUBLE)", 4)} AS Projected_Margin_Recovery
    FROM sh"""


def _plan(t):
    return PL.transfer_plan(B.stock_network(t), country=B.TARIFF_COUNTRY)


@query("prescriptive_plan", W(["stock_network"], [], SQL_PLAN))
def q_prescriptive_plan(t):
    """O1 + O2 (+ P19-P21 filters): stock shifts per category x SKU x branch."""
    return _plan(t)


# The options by explicit lanes: hub interval x need interval, with one more need interval for what is left (first spoke).
SQL_PLAN_OPTIONS = SQL_PLAN.split("    ff AS (")[0] + f"""    op AS (SELECT * FROM (VALUES (FALSE), (TRUE)) a(protect_hub_safety), (VALUES (FALSE), (TRUE)) b(ship_surplus)),
    ff AS (SELECT rr.*, op.*, if(role = 'HUB', greatest(stock - if(protect_hub_safety, safety, 0.0), 0.0), 0.0) AS supply,
                  if(role = 'SPOKE', greatest(safety - stock, 0.0), 0.0) AS need
           FROM rr, op WHERE n_rows >= 2 AND ((has_hub = 1 AND has_spoke = 1) OR n >= 2) AND role IN ('HUB', 'SPOKE')),
    hubs AS (SELECT *, coalesce(sum(supply) OVER w, 0.0) AS a FROM ff WHERE role = 'HUB'
             WINDOW w AS (PARTITION BY product_category, sku, protect_hub_safety, ship_surplus ORDER BY branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    wants AS (SELECT product_category, sku, protect_hub_safety, ship_surplus, branch_id, 0 AS pass, need FROM ff WHERE role = 'SPOKE'
              UNION ALL
              SELECT product_category, sku, protect_hub_safety, ship_surplus, min(branch_id) FILTER (WHERE role = 'SPOKE'), 1, greatest(sum(supply) - sum(need), 0.0)
              FROM ff WHERE ship_surplus GROUP BY ALL HAVING count(*) FILTER (WHERE role = 'SPOKE') > 0),
    spokes AS (SELECT *, coalesce(sum(need) OVER w, 0.0) AS a FROM wants
               WINDOW w AS (PARTITION BY product_category, sku, protect_hub_safety, ship_surplus ORDER BY pass, branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lanes AS (SELECT h.product_category, h.sku, h.protect_hub_safety, h.ship_surplus, h.branch_id AS hub, s.branch_id AS spoke,
                     greatest(0.0, least(h.a + h.supply, s.a + s.need) - greatest(h.a, s.a)) AS x
              FROM hubs h JOIN spokes s USING (product_category, sku, protect_hub_safety, ship_surplus)),
    moved AS (SELECT product_category, sku, protect_hub_safety, ship_surplus, hub AS branch_id, -sum(x) AS shift FROM lanes GROUP BY ALL
              UNION ALL
              SELECT product_category, sku, protect_hub_safety, ship_surplus, spoke, sum(x) FROM lanes GROUP BY ALL),
    cost AS (SELECT product_category, sku, arg_min(cost, branch_id) AS sku_cost FROM ff GROUP BY 1, 2)
    SELECT ff.protect_hub_safety, ff.ship_surplus, ff.product_category, ff.sku AS SKU, ff.branch_id AS Branch_ID, role AS location_type,
           coalesce(shift, 0.0) + 0.0 AS Recommended_Stock_Shift,
           {RH("abs(coalesce(shift, 0.0)) * sku_cost * CAST(0.15 AS DOUBLE)", 4)} AS Projected_Margin_Recovery
    FROM ff LEFT JOIN moved USING (product_category, sku, protect_hub_safety, ship_surplus, branch_id) JOIN cost USING (product_category, sku)"""


@query("transfer_plan_options", W(["stock_network"], [], SQL_PLAN_OPTIONS))
def q_transfer_plan_options(t):
    """O2 under the four pairs of protect_hub_safety and ship_surplus."""
    return PL.transfer_plan_options(B.stock_network(t), country=B.TARIFF_COUNTRY)


@query(
    "plan_risk",
    W(["stock_network"], [("plan", SQL_PLAN)],
      """SELECT p.product_category, sum(greatest(0.0, n.safety - n.stock)) AS risk_before,
             sum(greatest(0.0, n.safety - n.stock - p.Recommended_Stock_Shift)) AS risk_after,
             sum(p.Recommended_Stock_Shift) AS units_moved
         FROM plan p JOIN (SELECT coalesce(product_category, 'Default') AS product_category, sku, branch_id,
                                  CAST(sum(available_stock) AS DOUBLE) AS stock, CAST(sum(safety_stock) AS DOUBLE) AS safety
                           FROM stock_network GROUP BY 1, 2, 3) n
           ON p.product_category = n.product_category AND p.SKU = n.sku AND p.Branch_ID = n.branch_id
         WHERE p.location_type = 'SPOKE' GROUP BY p.product_category"""),
)
def q_plan_risk(t):
    """O2 objective check: spoke shortfall before and after the plan per category."""
    return PL.plan_risk(_plan(t), B.stock_network(t))


# ---- forecasting ---------------------------------------------------------------------------
SQL_ACC = f"""SELECT sku_id, category, period, forecast_qty, actual_qty,
    {RH("actual_qty * avg_selling_price", 2)} AS forecast_value_usd,
    CASE WHEN actual_qty > 0 THEN {HD("abs(forecast_qty - actual_qty) * 100", "actual_qty", 1)} END AS mape,
    CASE WHEN actual_qty > 0 THEN {HD("(forecast_qty - actual_qty) * 100", "actual_qty", 1)} END AS bias_pct,
    CAST(greatest(0, forecast_qty - floor((forecast_qty * 2 + 10) / 20)) AS BIGINT) AS confidence_lower,
    CAST(forecast_qty + floor((forecast_qty * 2 + 10) / 20) AS BIGINT) AS confidence_upper,
    CASE WHEN actual_qty > 0 AND {HD("(forecast_qty - actual_qty) * 100", "actual_qty", 1)} > 3 THEN 'Over'
         WHEN actual_qty > 0 AND {HD("(forecast_qty - actual_qty) * 100", "actual_qty", 1)} < -3 THEN 'Under'
         ELSE 'On target' END AS direction
    FROM demand_history"""


def _hist(t):
    return B.demand_history(t)


def _acc(t):
    return PL.forecast_accuracy(_hist(t))


@query("forecast_accuracy", W(["demand_history"], [], SQL_ACC))
def q_forecast_accuracy(t):
    """P22 + P23 per SKU x month."""
    return _acc(t)


@query(
    "category_mape",
    W(["demand_history"], [("acc", SQL_ACC)],
      f"""SELECT category, {RH("sum(round(mape * 10)) / count(*) / 10", 2)} AS mape,
          {RH("sum(round(bias_pct * 10)) / count(*) / 10", 2)} AS mean_bias_pct, count(DISTINCT sku_id) AS sku_count,
          {HD("sum(abs(forecast_qty - actual_qty)) * 100", "sum(actual_qty)", 2)} AS wmape
          FROM acc WHERE actual_qty > 0 GROUP BY category"""),
)
def q_category_mape(t):
    """A18."""
    return PL.category_mape(_acc(t))


@query(
    "naive_forecast",
    W(["demand_history"], [],
      f"""SELECT sku_id, period, actual_qty,
          coalesce(lag(actual_qty, 1) OVER (PARTITION BY sku_id ORDER BY period), actual_qty) AS naive_forecast,
          {RH("avg(actual_qty) OVER (PARTITION BY sku_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", 2)}
              AS rolling_avg_3,
          CASE WHEN lag(actual_qty, 1) OVER (PARTITION BY sku_id ORDER BY period) IS NULL THEN 'seed' ELSE 'naive' END
              AS period_type
          FROM demand_history"""),
)
def q_naive_forecast(t):
    """W7 + W16."""
    return PL.naive_forecast(_hist(t))


SEASONAL_CTES = """h AS (SELECT *, CAST(substr(period, 1, 4) AS INTEGER) * 12 + CAST(substr(period, 6, 2) AS INTEGER) - 1 AS t,
                      CAST(substr(period, 6, 2) AS INTEGER) AS moy FROM demand_history),
    fit AS (SELECT sku_id, regr_slope(actual_qty, t) AS slope, regr_intercept(actual_qty, t) AS intercept,
                   avg(actual_qty) AS mean_all, max(t) AS t_last FROM h GROUP BY sku_id),
    season AS (SELECT sku_id, moy, avg(actual_qty) AS mean_moy FROM h GROUP BY sku_id, moy),
    fut AS (SELECT fit.*, s.step, fit.t_last + s.step AS tt, (fit.t_last + s.step) % 12 + 1 AS fmoy
            FROM fit, range(1, 13) s(step)),
    j AS (SELECT fut.*, season.mean_moy FROM fut LEFT JOIN season ON fut.sku_id = season.sku_id AND fut.fmoy = season.moy),
    q AS (SELECT *, CAST(floor(greatest(0.0, coalesce(intercept + slope * tt, mean_all)
                      * CASE WHEN mean_all > 0 THEN coalesce(mean_moy, mean_all) / mean_all ELSE 1.0 END) + 0.5) AS BIGINT) AS fc
          FROM j)"""
SQL_SEASONAL = "WITH " + SEASONAL_CTES + """
    SELECT sku_id, CAST(CAST(floor(tt / 12) AS INTEGER) AS VARCHAR) || '-' || lpad(CAST(tt % 12 + 1 AS VARCHAR), 2, '0') AS period,
        CAST(step AS INTEGER) AS horizon, fc AS forecast_qty,
        CAST(greatest(0, fc - floor(fc * (CAST(0.08 AS DOUBLE) + (step - 1) * CAST(0.012 AS DOUBLE)) + 0.5)) AS BIGINT) AS confidence_lower,
        CAST(fc + floor(fc * (CAST(0.08 AS DOUBLE) + (step - 1) * CAST(0.012 AS DOUBLE)) + 0.5) AS BIGINT) AS confidence_upper,
        CASE WHEN step - 1 <= 2 THEN 'Consensus' WHEN step - 1 <= 8 THEN 'Statistical' ELSE 'Long-Range' END AS forecast_method
    FROM q"""


@query("demand_forecast", W(["demand_history"], [], SQL_SEASONAL))
def q_demand_forecast(t):
    """F1 + P24: 12-month trend x seasonal projection per SKU with widening interval."""
    return PL.seasonal_forecast(_hist(t))


@query(
    "forecast_bias_override",
    W(["demand_history"], [("acc", SQL_ACC)],
      f"""WITH {SEASONAL_CTES},
          fcast AS (SELECT sku_id, CAST(CAST(floor(tt / 12) AS INTEGER) AS VARCHAR) || '-' || lpad(CAST(tt % 12 + 1 AS VARCHAR), 2, '0')
                    AS period, fc AS forecast_qty FROM q),
          b AS (SELECT sku_id, sum(round(bias_pct * 10)) / count(*) / 10 AS mb FROM acc WHERE bias_pct IS NOT NULL GROUP BY sku_id)
        SELECT f.sku_id, f.period, f.forecast_qty, {RH("coalesce(b.mb, 0.0)", 2)} AS mean_bias_pct,
               CAST(greatest(0.0, floor(f.forecast_qty * (1 - coalesce(b.mb, 0.0) / 100.0) + 0.5)) AS BIGINT) AS adjusted_forecast_qty
        FROM fcast f LEFT JOIN b ON f.sku_id = b.sku_id"""),
)
def q_forecast_bias_override(t):
    """F4."""
    return PL.bias_override(PL.seasonal_forecast(_hist(t)), _acc(t))


@query(
    "canonical_sku",
    """SELECT p_partkey, p_name, min(p_partkey) OVER (PARTITION BY trim(p_name)) AS canonical_sku_id FROM part""",
)
def q_canonical_sku(t):
    """W8 (intended form): canonical id per description, every row kept."""
    return PL.canonical_sku(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name")


# ---- supply analytics ----------------------------------------------------------------------
@query(
    "demand_monthly",
    W(["vbap", "vbak"], [("ol", SQL_ORDER_LINES)],
      f"""SELECT material_number, order_year_month, CAST(sum(order_quantity) AS BIGINT) AS actual_qty,
          count(DISTINCT sales_order_number) AS order_count, {RH("avg(order_quantity)", 2)} AS avg_line_qty
          FROM ol WHERE order_year_month IS NOT NULL GROUP BY 1, 2"""),
)
def q_demand_monthly(t):
    """A17."""
    return PL.demand_monthly(erp.order_lines(spread(B.vbap(t), "vbeln"), B.vbak(t)))


@query(
    "supplier_scorecard",
    W(["ekpo", "ekko", "lips", "likp"], [("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD), ("dl", SQL_DELIVERY_LINES)],
      f"""SELECT *, CASE WHEN completed_lines > 0 THEN {HD("on_time_lines * 100", "completed_lines", 1)} END AS on_time_pct
          FROM (SELECT g.supplier_number, count(*) AS po_count,
                  CAST(sum(CAST(g.total_net_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS spend_usd,
                  CAST(coalesce(sum(d.on_time), 0) AS BIGINT) AS on_time_lines,
                  CAST(coalesce(sum(d.completed), 0) AS BIGINT) AS completed_lines
                FROM proc_gold g LEFT JOIN (SELECT delivery_number, count_if(on_time_delivery) AS on_time,
                                                   count_if(on_time_delivery IS NOT NULL) AS completed
                                            FROM dl GROUP BY 1) d
                  ON g.purchase_order_number = d.delivery_number
                GROUP BY g.supplier_number) s"""),
)
def q_supplier_scorecard(t):
    """A45."""
    proc = erp.procurement_gold(erp.procurement_lines(B.ekpo(t), B.ekko(t)))
    return PL.supplier_scorecard(proc, erp.delivery_lines(B.lips(t), B.likp(t)))


@query(
    "days_of_supply",
    W(["mard", "vbap", "vbak"], [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD), ("ol", SQL_ORDER_LINES)],
      f"""WITH st AS (SELECT material_number, CAST(sum(unrestricted_stock) AS BIGINT) AS stock FROM inv_gold GROUP BY 1),
          dm AS (SELECT material_number, CAST(sum(order_quantity) AS BIGINT) AS qty FROM ol
                 WHERE date_diff('day', TRY_CAST(order_date AS DATE), DATE '{B.AS_OF_ORDERS}') BETWEEN 0 AND 364 GROUP BY 1),
          j AS (SELECT st.material_number, st.stock, coalesce(dm.qty, 0) AS qty,
                       CASE WHEN coalesce(dm.qty, 0) > 0 THEN {HD("st.stock * 365", "dm.qty", 1)} END AS dos
                FROM st LEFT JOIN dm ON st.material_number = dm.material_number)
        SELECT material_number, stock, qty AS annual_demand, dos AS days_of_supply,
          CASE WHEN stock = 0 THEN 'stockout' WHEN dos >= 7 AND dos < 30 THEN 'at_risk' WHEN dos >= 30 AND dos <= 90 THEN 'optimal'
               WHEN dos < 7 THEN 'stockout' ELSE 'excess' END AS health FROM j"""),
)
def q_days_of_supply(t):
    """A46."""
    inv = erp.inventory_gold(erp.inventory_positions(B.mard(t)))
    return PL.days_of_supply(inv, erp.order_lines(B.vbap(t), B.vbak(t)), B.AS_OF_ORDERS)


_DOS_SQL = f"""SELECT st.material_number, st.stock, coalesce(dm.qty, 0) AS annual_demand,
        CASE WHEN coalesce(dm.qty, 0) > 0 THEN {HD("st.stock * 365", "dm.qty", 1)} END AS dos
    FROM (SELECT material_number, CAST(sum(unrestricted_stock) AS BIGINT) AS stock FROM inv_gold GROUP BY 1) st
    LEFT JOIN (SELECT material_number, CAST(sum(order_quantity) AS BIGINT) AS qty FROM ol
               WHERE TRY_CAST(order_date AS DATE) BETWEEN DATE '{B.AS_OF_ORDERS}' - 364 AND DATE '{B.AS_OF_ORDERS}' GROUP BY 1) dm USING (material_number)"""
_HEALTH_SQL = """SELECT *, CASE WHEN stock <= 0 OR dos < 7 THEN 'stockout' WHEN dos IS NULL OR dos > 90 THEN 'excess'
        WHEN dos < 30 THEN 'at_risk' ELSE 'optimal' END AS health FROM dos0"""
_DOS_CTES = [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD), ("ol", SQL_ORDER_LINES), ("dos0", _DOS_SQL), ("dos", _HEALTH_SQL)]
_HEALTHS = ("optimal", "excess", "at_risk", "stockout")
#: Units that one storage position of the test data can hold, and bands of days of supply for its categories (ours; PROMO has none).
POSITION_UNITS = 60
BANDS = (("STANDARD", 25, 45), ("MEDIUM", 8, 18), ("SMALL", 30, 60), ("LARGE", 30, 60), ("ECONOMY", 45, 90))


def _dos(t):
    return PL.days_of_supply(erp.inventory_gold(erp.inventory_positions(B.mard(t))), erp.order_lines(B.vbap(t), B.vbak(t)), B.AS_OF_ORDERS)


@query(
    "dc_utilization",
    W(["mard", "vbap", "vbak"], _DOS_CTES,
      f"""WITH cap AS (SELECT plant, CAST(count(*) * {POSITION_UNITS} AS BIGINT) AS capacity_units FROM inv_pos WHERE plant <> 'P2' GROUP BY 1),
            u AS (SELECT plant, material_number, CAST(sum(total_stock) AS BIGINT) AS units FROM inv_pos GROUP BY 1, 2)
        SELECT plant, CAST(sum(units) AS BIGINT) AS stock_units, count_if(units > 0) AS skus,
               {", ".join(f"count_if(health = '{h}') AS {h}_skus" for h in _HEALTHS)}, any_value(capacity_units) AS capacity_units,
               CASE WHEN any_value(capacity_units) > 0 THEN {HD("CAST(sum(units) AS BIGINT) * 100", "any_value(capacity_units)", 1)} END AS utilization_pct
        FROM u LEFT JOIN dos USING (material_number) LEFT JOIN cap USING (plant) GROUP BY plant"""),
)
def q_dc_utilization(t):
    """A46 per distribution centre; the capacity of plant P2 is not known."""
    positions = erp.inventory_positions(B.mard(t))
    capacity = positions.filter("plant <> 'P2'").groupBy("plant").agg((F.count(F.lit(1)) * POSITION_UNITS).alias("capacity_units"))
    return PL.dc_utilization(positions, capacity, _dos(t))


@query(
    "category_days_of_supply",
    W(["mard", "vbap", "vbak"], _DOS_CTES,
      f"""WITH b(category, lo, hi) AS (VALUES {", ".join(f"('{c}', {lo}, {hi})" for c, lo, hi in BANDS)}),
            g AS (SELECT p_type AS category, CAST(sum(stock) AS BIGINT) AS stock, CAST(sum(annual_demand) AS BIGINT) AS annual_demand,
                         CAST(sum(CAST(stock AS DECIMAL(20,0)) * CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
                         {", ".join(f"count_if(health = '{h}') AS {h}" for h in _HEALTHS)}
                  FROM dos JOIN part ON CAST(p_partkey AS VARCHAR) = material_number GROUP BY 1),
            d AS (SELECT *, CASE WHEN annual_demand > 0 THEN {HD("stock * 365", "annual_demand", 1)} END AS days_of_supply FROM g)
        SELECT d.*, lo, hi, CASE WHEN lo IS NULL OR days_of_supply IS NULL THEN NULL WHEN days_of_supply BETWEEN lo AND hi THEN 'in'
                                 WHEN days_of_supply < lo THEN 'below' ELSE 'above' END AS position FROM d LEFT JOIN b USING (category)"""),
)
def q_category_days_of_supply(t):
    """A46 per category against its band."""
    categories = t.part.select(F.col("p_partkey").cast("string").alias("material_number"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("unit_value"))
    return PL.category_days_of_supply(_dos(t), categories, t.spark.createDataFrame(BANDS, "category string, lo int, hi int"))


@query(
    "order_automation",
    W(["vbak"], [],
      f"""SELECT *, {HD("automated * 100", "total_orders", 1)} AS automation_rate_pct FROM (
          SELECT order_year_month, count(*) AS total_orders, CAST(sum(auto) AS BIGINT) AS automated,
                 count(*) - CAST(sum(auto) AS BIGINT) AS manual
          FROM (SELECT strftime(TRY_CAST(audat AS DATE), '%Y-%m') AS order_year_month,
                       CAST(auart IN ('4-NOT SPECIFIED', '5-LOW') AS INTEGER) AS auto FROM vbak) x
          WHERE order_year_month IS NOT NULL GROUP BY 1) y"""),
)
def q_order_automation(t):
    """A43."""
    return PL.order_automation(B.vbak(t))


@query(
    "stock_rebalance_pairs",
    W(["stock_network"], [],
      f"""WITH g AS (SELECT sku, branch_id, sum(coalesce(CAST(available_stock AS BIGINT), 0)) AS stock,
                          sum(coalesce(CAST(safety_stock AS BIGINT), 0)) AS safety, min(unit_cost) AS cost
                   FROM stock_network GROUP BY 1, 2),
            h AS (SELECT *, greatest(stock - safety, 0) AS excess, greatest(safety - stock, 0) AS need FROM g),
            c AS (SELECT *, sum(excess) OVER (PARTITION BY sku ORDER BY branch_id) AS e_end,
                            sum(need) OVER (PARTITION BY sku ORDER BY branch_id) AS n_end,
                            least(sum(excess) OVER (PARTITION BY sku), sum(need) OVER (PARTITION BY sku)) AS cap,
                            arg_min(cost, branch_id) OVER (PARTITION BY sku) AS sku_cost FROM h),
            p AS (SELECT e.sku, e.branch_id AS from_branch, n.branch_id AS to_branch, e.sku_cost,
                         least(e.e_end, n.n_end, e.cap) - greatest(e.e_end - e.excess, n.n_end - n.need) AS qty
                  FROM c e JOIN c n ON e.sku = n.sku AND e.excess > 0 AND n.need > 0)
        SELECT sku, from_branch, to_branch, qty, {RH("qty * sku_cost * 0.05", 2)} AS freight_cost FROM p WHERE qty > 0"""),
)
def q_stock_rebalance_pairs(t):
    """Excess -> short branch transfer pairs per SKU with freight cost (interval merge, no all-pairs)."""
    return PL.rebalance_pairs(B.stock_network(t)).drop("unit_cost")
