"""Sales / supply-chain scenario queries with DuckDB oracles. Inputs are derived from the given
tables here (quote lines from order lines, accounts from customers, SCADA readings from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import commercial as C
from millrun.operators import erp, planning as PL
from millrun.plans.erp_queries import SQL_DELIVERY_LINES, SQL_INV_GOLD, SQL_INV_POS, SQL_ORDER_LINES, SQL_PROC_GOLD, SQL_PROC_LINES
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.planning_queries import SQL_ACC
from millrun.plans.registry import query
from millrun.sources import bindings as B
from millrun.streaming.jobs import page_time_log


def RH(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10**d} + 0.5) / {10**d})"


def D(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


SEG_SQL = ("CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEGMENT_OF.items()) + " ELSE 'smb' END")


# ---- P34 quote pricing -------------------------------------------------------------------------
def _quote_lines(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_mktsegment")
    p = t.part.select("p_partkey", "p_name", "p_retailprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("l_orderkey").alias("quote_id"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("product"),
                    F.col("l_quantity").cast("int").alias("qty"), F.col("p_retailprice").alias("unit_price"),
                    C.segment_tier(F.col("c_mktsegment")).alias("segment"))


_SEGD = "CASE segment " + " ".join(f"WHEN '{k}' THEN {D(v)}" for k, v in C.SEGMENT_DISCOUNT.items()) + f" ELSE {D(0.0)} END"
_VOLD = "CASE " + " ".join(f"WHEN qty >= {q} THEN {D(d)}" for q, d in C.VOLUME_DISCOUNT) + f" ELSE {D(0.0)} END"


@query(
    "quote_pricing",
    f"""WITH l AS (SELECT l_orderkey AS quote_id, l_linenumber AS line_no, p_name AS product, CAST(l_quantity AS INTEGER) AS qty,
                          p_retailprice AS unit_price, {SEG_SQL} AS segment
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                   JOIN part ON l_partkey = p_partkey),
          a AS (SELECT *, least({_SEGD} + {_VOLD}, {D(0.25)}) AS total_discount, unit_price * qty AS list_total FROM l),
          b AS (SELECT *, floor(list_total * total_discount + 0.5) AS discount_amount FROM a),
          c AS (SELECT *, list_total - discount_amount AS net_total FROM b),
          e AS (SELECT *, floor(net_total * {D(0.012)} + 0.5) AS shipping, floor(net_total * {D(0.072)} + 0.5) AS tax FROM c)
     SELECT *, net_total + shipping + tax AS grand_total,
            total_discount > {D(0.1)} OR net_total + shipping + tax > {D(100000.0)} AS needs_approval FROM e""",
)
def q_quote_pricing(t):
    """P34 over every order line as a quote line (list price = part retail price)."""
    return C.quote_pricing(_quote_lines(t))


# ---- P35 price elasticity ----------------------------------------------------------------------
def _products(t):
    li = t.lineitem.select("l_partkey", "l_quantity")
    p = t.part.select("p_partkey", "p_type", "p_retailprice")
    price = p.groupBy("p_type").agg((F.sum(F.round(F.col("p_retailprice") * 100)) / F.count(F.lit(1)) / 100.0).alias("base_price"))
    units = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_type").agg(F.sum(F.col("l_quantity").cast("int")).cast("double").alias("base_units"))
    return price.join(units, "p_type").select(F.col("p_type").alias("product"), "base_price", "base_units",
                                              (F.col("base_price") * 0.6).alias("base_cost"))


_GRID = "(VALUES " + ", ".join(f"({D(g)})" for g in (-0.2, -0.1, 0.0, 0.1, 0.2)) + ") g(price_change)"


@query(
    "price_elasticity",
    f"""WITH pr AS (SELECT p_type, sum(round(p_retailprice * 100)) / count(*) / 100.0 AS base_price FROM part GROUP BY 1),
          un AS (SELECT p_type, CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS base_units FROM lineitem
                 JOIN part ON l_partkey = p_partkey GROUP BY 1),
          b AS (SELECT pr.p_type AS product, base_price, base_units, base_price * {D(0.6)} AS base_cost FROM pr JOIN un ON pr.p_type = un.p_type),
          x AS (SELECT b.*, g.price_change, base_price * (1 + g.price_change) AS price, {D(-1.5)} * g.price_change AS dem FROM b, {_GRID}),
          y AS (SELECT *, greatest(0.0, floor(base_units * (1 + dem) + 0.5)) AS u FROM x)
     SELECT product, price_change, {RH("price", 2)} AS price, CAST(u AS BIGINT) AS units,
            {RH("(u * price - base_units * base_price) / 1000", 2)} AS revenue_impact_k,
            {RH("(price - base_cost) / price * 100", 2)} AS margin_pct, CAST(floor(100 * (1 + dem) + 0.5) AS INTEGER) AS demand_index,
            CAST(least(95, greatest(20, floor(68 - price_change * 50 + 0.5))) AS INTEGER) AS win_pct FROM y""",
)
def q_price_elasticity(t):
    """P35 per part type on a +-20 % price grid (elasticity -1.5)."""
    return C.price_elasticity(_products(t))


# ---- P36, P37, P48 -------------------------------------------------------------------------------
_CAT = f"""SELECT category, {RH("sum(round(mape * 10)) / count(*) / 10", 2)} AS mape FROM acc WHERE actual_qty > 0 GROUP BY category"""
_SCN = "(VALUES " + ", ".join(f"({i}, {v}, {p}, {s})" for i, (v, p, s) in enumerate(((0, 0, 0), (10, 5, 0), (-10, 0, 5), (20, 10, 10)))) + \
    ") s(scenario, vol, promo, season)"


@query(
    "demand_scenarios",
    W(["demand_history"], [("acc", SQL_ACC), ("cat", _CAT)],
      f"""WITH x AS (SELECT cat.category, cat.mape, s.scenario,
                  s.vol * {D(1.0)} + s.promo * {D(0.6)} + s.season * {D(0.4)} AS total FROM cat, {_SCN})
         SELECT category, CAST(scenario AS INTEGER) AS scenario, {RH("total", 1)} AS total_shift,
            {RH(f"greatest({D(5.1)}, mape + abs(total) * {D(0.12)})", 1)} AS scenario_mape,
            {RH(f"total * {D(0.18)}", 1)} AS safety_stock_delta_m, {RH(f"total * {D(0.08)}", 1)} AS fill_rate_delta_pct,
            {RH(f"total * {D(0.05)} + {D(-2.1)}", 1)} AS bias_pct FROM x"""),
)
def q_demand_scenarios(t):
    """P36 over each category's MAPE."""
    return C.demand_scenarios(PL.category_mape(PL.forecast_accuracy(B.demand_history(t))))


_PLAN = f"""SELECT category, period, sum(forecast_qty) AS plan_units, sum(actual_qty) AS actual_units,
        CAST(sum(CAST(forecast_qty AS DECIMAL(18,0)) * CAST(avg_selling_price AS DECIMAL(18,2))) AS DOUBLE) AS plan_value,
        CAST(sum(CAST(actual_qty AS DECIMAL(18,0)) * CAST(avg_selling_price AS DECIMAL(18,2))) AS DOUBLE) AS actual_value
        FROM demand_history GROUP BY 1, 2"""
SQL_PLAN_GAP = f"""SELECT category, period, CAST(plan_units AS BIGINT) AS plan_units, CAST(actual_units AS BIGINT) AS actual_units,
        {RH("CASE WHEN plan_units > 0 THEN actual_units * 100.0 / plan_units END", 1)} AS attainment_pct,
        {RH("CASE WHEN plan_units > 0 THEN actual_units * 100.0 / plan_units END - 100.0", 1)} AS gap_pct,
        CASE WHEN plan_units > 0 THEN actual_units * 100.0 / plan_units END - 100.0 >= -5.0 AS on_track,
        {RH("plan_value / 1e6", 3)} AS plan_value_m, {RH("plan_value / nullif(actual_value / nullif(actual_units, 0), 0) / 1000", 3)} AS plan_k_units FROM g"""


@query("plan_gap", W(["demand_history"], [("g", _PLAN)], SQL_PLAN_GAP))
def q_plan_gap(t):
    """P37 per category x month."""
    return C.plan_gap(B.demand_history(t)).withColumn("plan_units", F.col("plan_units").cast("bigint")).withColumn(
        "actual_units", F.col("actual_units").cast("bigint"))


@query(
    "plan_scenarios",
    W(["demand_history"], [("g", _PLAN), ("pg", SQL_PLAN_GAP)],
      f"""SELECT category, period, s.scenario, {RH("plan_units * s.f", 2)} AS units FROM pg,
          (VALUES ('base', {D(1.0)}), ('upside', {D(1.12)}), ('downside', {D(0.85)})) s(scenario, f)"""),
)
def q_plan_scenarios(t):
    """P48 over the monthly plan."""
    pg = C.plan_gap(B.demand_history(t)).withColumn("plan_units", F.col("plan_units").cast("bigint"))
    return C.plan_scenarios(pg)


# ---- control tower -----------------------------------------------------------------------------
@query(
    "exception_summary",
    W(["lips", "likp", "vbap", "vbak"], [("dl", SQL_DELIVERY_LINES), ("ol", SQL_ORDER_LINES)],
      f"""WITH u AS (
            SELECT 'late_delivery' AS exception_type,
                   CAST(date_diff('day', coalesce(planned_delivery_date, actual_delivery_date), DATE '{B.AS_OF_ORDERS}') AS INTEGER) AS age,
                   delivered_quantity AS units, NULL AS usd FROM dl WHERE delivery_status = 'Late'
            UNION ALL
            SELECT 'pending_delivery', CAST(date_diff('day', planned_delivery_date, DATE '{B.AS_OF_ORDERS}') AS INTEGER),
                   delivered_quantity, NULL FROM dl WHERE delivery_status = 'Pending'
            UNION ALL
            SELECT 'rejected_line', CAST(date_diff('day', TRY_CAST(order_date AS DATE), DATE '{B.AS_OF_ORDERS}') AS INTEGER),
                   order_quantity, CAST(net_value_usd AS DECIMAL(18,2)) FROM ol WHERE is_rejected)
        SELECT exception_type, count(*) AS exceptions, {RH("avg(age)", 1)} AS avg_age_days,
               CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(usd AS DECIMAL(18,2))) AS DOUBLE) AS value_usd
        FROM u GROUP BY 1"""),
)
def q_exception_summary(t):
    """A44 as of the ERP clock."""
    return C.exception_summary(erp.delivery_lines(B.lips(t), B.likp(t)), erp.order_lines(B.vbap(t), B.vbak(t)), B.AS_OF_ORDERS)


def _accounts(t):
    li = t.lineitem.select("l_orderkey", "l_returnflag")
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    per_c = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(
        (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("score"))
    arr = o.groupBy(F.col("o_custkey").alias("a_custkey")).agg(
        (F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 10000 + 0.5) / 100).alias("arr_m"))
    c = t.customer.select("c_custkey", "c_mktsegment")
    j = c.join(per_c, c.c_custkey == per_c.o_custkey).join(arr, c.c_custkey == arr.a_custkey)
    return j.select(F.col("c_custkey"), C.segment_tier(F.col("c_mktsegment")).alias("tier"), "score",
                    F.concat(F.lit("$"), F.col("arr_m").cast("string"), F.lit("M")).alias("arr_text"))


@query(
    "churn_exposure",
    f"""WITH s AS (SELECT o_custkey, count_if(l_returnflag = 'R') / count(*) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                   GROUP BY 1),
          a AS (SELECT o_custkey, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 10000 + 0.5) / 100 AS arr_m
                FROM orders GROUP BY 1),
          x AS (SELECT {SEG_SQL} AS tier, s.score, a.arr_m FROM customer JOIN s ON c_custkey = s.o_custkey JOIN a ON c_custkey = a.o_custkey)
     SELECT tier, count(*) AS accounts, count_if(score >= 0.7) AS at_risk,
            {RH("sum(CASE WHEN score >= 0.7 THEN arr_m END)", 2)} AS at_risk_arr_m FROM x GROUP BY tier""",
)
def q_churn_exposure(t):
    """A47 (score = share of returned lines, ARR parsed back from money text)."""
    return C.churn_exposure(_accounts(t), threshold=0.7)


_SC_SQL = f"""SELECT g.supplier_number, CAST(sum(CAST(g.total_net_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS spend_usd,
        CASE WHEN sum(d.completed) > 0 THEN floor((sum(d.on_time) * 2000 + sum(d.completed)) / (sum(d.completed) * 2)) / 10 END AS on_time_pct
    FROM proc_gold g LEFT JOIN (SELECT delivery_number, count_if(on_time_delivery) AS on_time, count_if(on_time_delivery IS NOT NULL)
                                AS completed FROM dl GROUP BY 1) d ON g.purchase_order_number = d.delivery_number
    GROUP BY g.supplier_number"""


@query(
    "value_at_risk",
    W(["ekpo", "ekko", "lips", "likp"], [("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD), ("dl", SQL_DELIVERY_LINES),
                                        ("sc", _SC_SQL)],
      """SELECT count_if(on_time_pct <= 25) AS high_risk_suppliers,
         CAST(sum(CASE WHEN on_time_pct <= 40 THEN CAST(spend_usd AS DECIMAL(20,2)) END) AS DOUBLE)
             AS value_at_risk_usd FROM sc"""),
)
def q_value_at_risk(t):
    """A48 over the supplier scorecard."""
    proc = erp.procurement_gold(erp.procurement_lines(B.ekpo(t), B.ekko(t)))
    return C.value_at_risk(PL.supplier_scorecard(proc, erp.delivery_lines(B.lips(t), B.likp(t))))


@query(
    "ticket_breakdown",
    W(["test_schedule"], [],
      f"""SELECT priority, count(*) AS tickets, {RH("count(*) * 100.0 / sum(count(*)) OVER ()", 1)} AS share_pct
          FROM test_schedule GROUP BY priority"""),
)
def q_ticket_breakdown(t):
    """A49 over the lab schedule (tickets by priority)."""
    return C.ticket_breakdown(B.test_schedule(t))


@query(
    "page_engagement",
    """SELECT 'app-' || CAST(user_id % 3 AS VARCHAR) AS app_name, event_type AS page, 'U-' || CAST(user_id AS VARCHAR) AS username,
              CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT) AS seconds,
              CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) AS BIGINT) AS clicks, count(*) AS visits
       FROM events GROUP BY 1, 2, 3""",
)
def q_page_engagement(t):
    """A50 over the engagement log."""
    return C.page_engagement(page_time_log(t))


def _scada(t):
    e = t.events
    v = F.col("value")
    q = F.when(v <= 100, F.lit("GOOD")).when(v <= 200, F.lit("UNCERTAIN")).otherwise(F.lit("BAD"))
    return e.select(F.concat(F.lit("TAG-"), (F.col("user_id") % 18).cast("string")).alias("tag"), F.to_date("ts").alias("reading_date"),
                    v.alias("value"), q.alias("quality"))


@query(
    "scada_quality",
    f"""WITH r AS (SELECT 'TAG-' || CAST(user_id % 18 AS VARCHAR) AS tag, CAST(ts AS DATE) AS reading_date, value,
                          CASE WHEN value <= 100 THEN 'GOOD' WHEN value <= 200 THEN 'UNCERTAIN' ELSE 'BAD' END AS quality FROM events)
     SELECT tag, reading_date, count(*) AS readings, {RH("count_if(quality = 'GOOD') * 100.0 / count(*)", 2)} AS good_pct,
            {RH("count_if(quality = 'BAD') * 100.0 / count(*)", 2)} AS bad_pct,
            {RH("count_if(quality = 'UNCERTAIN') * 100.0 / count(*)", 2)} AS uncertain_pct,
            min(CASE WHEN quality = 'GOOD' THEN value END) AS good_min,
            {RH("sum(CASE WHEN quality = 'GOOD' THEN round(value * 100) END) / count_if(quality = 'GOOD') / 100.0", 2)} AS good_avg,
            max(CASE WHEN quality = 'GOOD' THEN value END) AS good_max FROM r GROUP BY 1, 2""",
)
def q_scada_quality(t):
    """A51 per tag x day (readings partitioned by day)."""
    return C.scada_quality(_scada(t))


@query(
    "low_stock_parts",
    W(["mard"], [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD)],
      """SELECT material_number, plant, unrestricted_stock, safety_stock_level, unrestricted_stock < safety_stock_level AS below_minimum,
         CAST(greatest(0, safety_stock_level - unrestricted_stock) AS BIGINT) AS reorder_gap FROM inv_gold"""),
)
def q_low_stock_parts(t):
    """A52."""
    return C.low_stock_parts(erp.inventory_gold(erp.inventory_positions(B.mard(t))))


@query(
    "fleet_status",
    W(["lips", "likp"], [("dl", SQL_DELIVERY_LINES)],
      """SELECT shipping_carrier, delivery_status, count(DISTINCT delivery_number) AS shipments FROM dl
         WHERE contains(lower(coalesce(delivery_number, '')), 'urgent') OR contains(lower(coalesce(customer_number, '')), 'urgent')
            OR contains(lower(coalesce(shipping_carrier, '')), 'urgent') OR contains(lower(coalesce(delivery_status, '')), 'urgent')
         GROUP BY 1, 2"""),
)
def q_fleet_status(t):
    """A55 with the free-text route filter "urgent"."""
    return C.fleet_status(erp.delivery_lines(B.lips(t), B.likp(t)), "urgent")


# ---- F2, F3, F5 ---------------------------------------------------------------------------------
@query(
    "cost_trend_forecast",
    W(["ekpo", "ekko"], [("pl", SQL_PROC_LINES)],
      f"""WITH g AS (SELECT material_number, substr(scheduled_delivery_date, 1, 7) AS period, avg(unit_price) AS p FROM pl
                     WHERE unit_price IS NOT NULL GROUP BY 1, 2),
            h AS (SELECT *, CAST(substr(period, 1, 4) AS INTEGER) * 12 + CAST(substr(period, 6, 2) AS INTEGER) - 1 AS t FROM g),
            fit AS (SELECT material_number, regr_slope(p, t) AS slope, regr_intercept(p, t) AS intercept, avg(p) AS mean_price,
                           max(t) AS t_last FROM h GROUP BY 1),
            f AS (SELECT fit.*, s.step, t_last + s.step AS tt FROM fit, range(1, 7) s(step))
        SELECT material_number, CAST(CAST(floor(tt / 12) AS INTEGER) AS VARCHAR) || '-' || lpad(CAST(tt % 12 + 1 AS VARCHAR), 2, '0') AS period,
               CAST(step AS INTEGER) AS horizon, {RH("coalesce(intercept + slope * tt, mean_price)", 2)} AS forecast_unit_cost FROM f"""),
)
def q_cost_trend_forecast(t):
    """6-month straight-line unit-cost forecast per material."""
    return C.cost_trend_forecast(erp.procurement_lines(B.ekpo(t), B.ekko(t)))


@query(
    "make_buy",
    W(["ekpo", "ekko"], [("pl", SQL_PROC_LINES)],
      f"""WITH g AS (SELECT material_number, plant, min(unit_price) AS sp, sum(ordered_quantity) AS qty FROM pl
                     WHERE unit_price IS NOT NULL GROUP BY 1, 2),
            c AS (SELECT g.*, qty * 100.0 / sum(qty) OVER (PARTITION BY plant) AS cap,
                         p_retailprice * CAST(p_partkey % 10 + 1 AS DOUBLE) / 5 AS ic
                  FROM g LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = material_number)
        SELECT material_number, plant, {RH("sp", 4)} AS supplier_price, {RH("ic", 4)} AS internal_cost, {RH("cap", 4)} AS capacity_use_pct,
               CASE WHEN ic <= sp * (1 - {D(0.05)}) AND cap < 85.0 THEN 'Make' WHEN ic <= sp THEN 'Hybrid' ELSE 'Buy' END AS decision
        FROM c"""),
)
def q_make_buy(t):
    """F3 per material x plant; the internal cost is a fifth to twice the list price, by part number."""
    cost = F.col("p_retailprice") * (F.col("p_partkey") % 10 + 1).cast("double") / 5
    costs = t.part.select(F.col("p_partkey").cast("string").alias("material_number"), cost.alias("internal_cost"))
    return C.make_buy(erp.procurement_lines(B.ekpo(t), B.ekko(t)), costs)
