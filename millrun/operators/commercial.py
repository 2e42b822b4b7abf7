"""Sales and supply-chain scenario analytics (SURVEY §2.2 P34-P37, P48; §2.4 A44, A47-A52, A55;
§2.10 F2, F3, F5).

Scenario tables (price grids, plan scenarios, impact splits) are small fixed arrays exploded
per row - a generator, not a join - so every query is linear in its input. Money is rounded
half-up on the binary double (``floor(x + 0.5)``) so results do not depend on the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.sources.io import resolve_columns

# Fixed values of the reference's quoting rules.
SEGMENT_DISCOUNT = {"enterprise": 0.05, "midmarket": 0.03, "smb": 0.0}
VOLUME_DISCOUNT = ((200, 0.08), (100, 0.05), (50, 0.03))  # quantity floor -> discount
MAX_DISCOUNT, SHIPPING_RATE, TAX_RATE = 0.25, 0.012, 0.072
APPROVAL_DISCOUNT, APPROVAL_TOTAL = 0.10, 100000.0
# Fixed values of the pricing and demand what-ifs.
WIN_BASE, WIN_SLOPE, WIN_MIN, WIN_MAX = 68, 50, 20, 95
DEMAND_WEIGHTS = (1.0, 0.6, 0.4)  # volume, promotion, season
MAPE_FLOOR, MAPE_SLOPE = 5.1, 0.12
SS_PER_POINT_M, FILL_PER_POINT, BIAS_SLOPE, BIAS_BASE = 0.18, 0.08, 0.05, -2.1
PLAN_SCENARIOS = (("base", 1.0), ("upside", 1.12), ("downside", 0.85))
# The life cycle of an action: statuses a log entry may give, and those that hold until it is reopened.
LIFE_CYCLE = ("pending", "acknowledged", "in_progress", "done", "rejected", "reopened")
CLOSED = ("done", "rejected")
TRANSFER_HIGH_USD = 10_000.0  # ours: a lane worth as much is a High action
# Our binding of customer segments to quote tiers (test data market segments).
SEGMENT_OF = {"BUILDING": "enterprise", "MACHINERY": "enterprise", "AUTOMOBILE": "midmarket", "FURNITURE": "midmarket"}


def _r0(c: Column) -> Column:
    """Math.round for non-negative money."""
    return F.floor(c + 0.5)


def segment_tier(mkt: Column) -> Column:
    e = F.lit("smb")
    for k, v in SEGMENT_OF.items():
        e = F.when(mkt == k, F.lit(v)).otherwise(e)
    return e


def quote_pricing(lines: DataFrame) -> DataFrame:
    """Per quote line: segment + volume discount (capped), net, shipping, tax, total, approval.
    ``lines``: quote_id, line_no, product, qty, unit_price, segment."""
    seg = F.lit(0.0)
    for k, v in SEGMENT_DISCOUNT.items():
        seg = F.when(F.col("segment") == k, F.lit(v)).otherwise(seg)
    vol = F.lit(0.0)
    for floor_qty, d in reversed(VOLUME_DISCOUNT):
        vol = F.when(F.col("qty") >= floor_qty, F.lit(d)).otherwise(vol)
    disc = F.least(seg + vol, F.lit(MAX_DISCOUNT))
    list_total = F.col("unit_price") * F.col("qty")
    q = lines.withColumn("total_discount", disc).withColumn("list_total", list_total)
    q = q.withColumn("discount_amount", _r0(F.col("list_total") * F.col("total_discount")))
    q = q.withColumn("net_total", F.col("list_total") - F.col("discount_amount"))
    q = q.withColumn("shipping", _r0(F.col("net_total") * SHIPPING_RATE)).withColumn("tax", _r0(F.col("net_total") * TAX_RATE))
    q = q.withColumn("grand_total", F.col("net_total") + F.col("shipping") + F.col("tax"))
    return q.withColumn("needs_approval", (F.col("total_discount") > APPROVAL_DISCOUNT) | (F.col("grand_total") > APPROVAL_TOTAL))


def price_elasticity(products: DataFrame, elasticity: float = -1.5, grid=(-0.2, -0.1, 0.0, 0.1, 0.2)) -> DataFrame:
    """Demand, revenue impact ($K), margin %, demand index and clamped win % on a price grid.
    ``products``: product, base_price, base_units, base_cost."""
    x = products.select("*", F.explode(F.array(*[F.lit(g) for g in grid])).alias("price_change"))
    price = F.col("base_price") * (1 + F.col("price_change"))
    dem = F.lit(elasticity) * F.col("price_change")
    units = F.greatest(F.lit(0.0), _r0(F.col("base_units") * (1 + dem)))
    return x.select(
        "product", "price_change",
        P.round_half_up(price, 2).alias("price"),
        units.cast("bigint").alias("units"),
        P.round_half_up((units * price - F.col("base_units") * F.col("base_price")) / 1000, 2).alias("revenue_impact_k"),
        P.round_half_up(F.try_divide(price - F.col("base_cost"), price) * 100, 2).alias("margin_pct"),
        _r0(100 * (1 + dem)).cast("int").alias("demand_index"),
        F.least(F.lit(WIN_MAX), F.greatest(F.lit(WIN_MIN), _r0(WIN_BASE - F.col("price_change") * WIN_SLOPE))).cast("int").alias("win_pct"),
    )


def demand_scenarios(base: DataFrame, scenarios=((0, 0, 0), (10, 5, 0), (-10, 0, 5), (20, 10, 10))) -> DataFrame:
    """Volume / promotion / season shifts on each category's MAPE: MAPE, safety-stock $M,
    fill-rate and bias deltas. ``base``: category, mape."""
    arr = F.array(*[F.struct(F.lit(v).alias("vol"), F.lit(p).alias("promo"), F.lit(s).alias("season")) for v, p, s in scenarios])
    x = base.select("category", "mape", F.posexplode(arr).alias("scenario", "s"))
    total = F.col("s.vol") * DEMAND_WEIGHTS[0] + F.col("s.promo") * DEMAND_WEIGHTS[1] + F.col("s.season") * DEMAND_WEIGHTS[2]
    r1 = lambda c: P.round_half_up(c, 1)
    return x.select(
        "category", F.col("scenario").cast("int").alias("scenario"), r1(total).alias("total_shift"),
        r1(F.greatest(F.lit(MAPE_FLOOR), F.col("mape") + F.abs(total) * MAPE_SLOPE)).alias("scenario_mape"),
        r1(total * SS_PER_POINT_M).alias("safety_stock_delta_m"), r1(total * FILL_PER_POINT).alias("fill_rate_delta_pct"),
        r1(total * BIAS_SLOPE + BIAS_BASE).alias("bias_pct"),
    )


def _cents(quantity: str) -> Column:
    """Value of a quantity at the selling price, summed exactly."""
    price = F.col("avg_selling_price").cast("decimal(18,2)")
    return F.sum(F.col(quantity).cast("decimal(18,0)") * price).cast("double")


def plan_gap(history: DataFrame, target_pct: float = 100.0, tolerance: float = 5.0) -> DataFrame:
    """Attainment (actual / plan) per category x month against the target; plan value ($M)
    converted to thousand units by the price actually realised that month (actual value / actual units),
    so that a plan of dearer products than were sold is worth more units than it lists."""
    g = history.groupBy("category", "period").agg(
        F.sum("forecast_qty").alias("plan_units"), F.sum("actual_qty").alias("actual_units"),
        _cents("forecast_qty").alias("plan_value"), _cents("actual_qty").alias("actual_value"),
    )
    att = F.when(F.col("plan_units") > 0, F.col("actual_units") * 100.0 / F.col("plan_units"))
    asp = F.try_divide(F.col("actual_value"), F.col("actual_units"))
    return g.select(
        "category", "period", "plan_units", "actual_units", P.round_half_up(att, 1).alias("attainment_pct"),
        P.round_half_up(att - target_pct, 1).alias("gap_pct"), (att - target_pct >= -tolerance).alias("on_track"),
        P.round_half_up(F.col("plan_value") / 1e6, 3).alias("plan_value_m"),
        P.round_half_up(F.try_divide(F.col("plan_value"), asp) / 1000, 3).alias("plan_k_units"),
    )


def plan_scenarios(plan: DataFrame) -> DataFrame:
    """Base / upside x1.12 / downside x0.85 over each category's monthly plan."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor")) for n, f in PLAN_SCENARIOS])
    x = plan.select("category", "period", "plan_units", F.explode(arr).alias("s"))
    return x.select("category", "period", F.col("s.scenario").alias("scenario"),
                    P.round_half_up(F.col("plan_units") * F.col("s.factor"), 2).alias("units"))


# ---- supply-chain control tower -------------------------------------------------------------------


def exception_summary(delivery: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """Exceptions by type - late deliveries, open (pending) deliveries, rejected order
    lines - with count, mean age in days, units and USD value; a union of rule queries.
    Delivery lines carry no price: their value is NULL, never units in a money column."""
    d = F.lit(as_of).cast("date")
    planned = F.col("planned_delivery_date")

    def rule(rows: DataFrame, name: str, since: Column, units: str, usd: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("exception_type"), F.datediff(d, since).alias("age"),
            F.col(units).cast("bigint").alias("units"), usd.cast("decimal(18,2)").alias("usd"))

    no_price = F.lit(None)
    late = rule(delivery.filter(F.col("delivery_status") == "Late"), "late_delivery",
                F.coalesce(planned, "actual_delivery_date"), "delivered_quantity", no_price)
    pend = rule(delivery.filter(F.col("delivery_status") == "Pending"), "pending_delivery", planned, "delivered_quantity", no_price)
    rej = rule(orders.filter(F.col("is_rejected")), "rejected_line",
               P.safe_to_date("order_date"), "order_quantity", F.col("net_value_usd"))
    return late.unionByName(pend).unionByName(rej).groupBy("exception_type").agg(
        F.count(F.lit(1)).alias("exceptions"), P.round_half_up(F.avg("age"), 1).alias("avg_age_days"),
        F.sum("units").alias("units"), F.sum("usd").cast("double").alias("value_usd"))


def churn_exposure(accounts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Accounts at or above the churn score and their ARR (parsed from money text) per tier."""
    arr = F.regexp_replace(F.col("arr_text"), r"[^0-9.]", "").cast("double")
    return accounts.groupBy("tier").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("score") >= threshold).alias("at_risk"),
        P.round_half_up(F.sum(F.when(F.col("score") >= threshold, arr)), 2).alias("at_risk_arr_m"))


def value_at_risk(scorecard: DataFrame, high: float = 75.0, medium: float = 60.0) -> DataFrame:
    """Supplier risk from late share (score = 100 - on-time %): High / Medium / Low, Unknown for a
    supplier without a completed delivery; count of High and spend where risk is High or Medium."""
    score = F.lit(100.0) - F.col("on_time_pct")
    tier = (F.when(score.isNull(), F.lit("Unknown")).when(score >= high, F.lit("High"))
            .when(score >= medium, F.lit("Medium")).otherwise(F.lit("Low")))
    s = scorecard.withColumn("risk", tier)
    return s.agg(F.count_if(F.col("risk") == "High").alias("high_risk_suppliers"),
                 F.sum(F.when(F.col("risk").isin("High", "Medium"), F.col("spend_usd").cast("decimal(20,2)"))).cast("double").alias("value_at_risk_usd"))


def ticket_breakdown(tickets: DataFrame) -> DataFrame:
    """Tickets per priority and share (shares over the few priority rows)."""
    g = tickets.groupBy("priority").agg(F.count(F.lit(1)).alias("tickets"))
    return g.withColumn("share_pct", P.round_half_up(F.col("tickets") * 100.0 / F.sum("tickets").over(Window.partitionBy()), 1))


def page_engagement(log: DataFrame) -> DataFrame:
    """Seconds and clicks per app x page x user."""
    return log.groupBy("app_name", "page", "username").agg(
        F.sum("seconds_spent").cast("bigint").alias("seconds"), F.sum("click_count").cast("bigint").alias("clicks"),
        F.count(F.lit(1)).alias("visits"))


def scada_quality(readings: DataFrame) -> DataFrame:
    """Share of GOOD / BAD / UNCERTAIN and min / avg / max of GOOD values per tag x day."""
    n = F.count(F.lit(1))
    good = F.col("quality") == "GOOD"
    r = lambda c: P.round_half_up(c, 2)
    return readings.groupBy("tag", "reading_date").agg(
        n.alias("readings"), r(F.count_if(good) * 100.0 / n).alias("good_pct"),
        r(F.count_if(F.col("quality") == "BAD") * 100.0 / n).alias("bad_pct"),
        r(F.count_if(F.col("quality") == "UNCERTAIN") * 100.0 / n).alias("uncertain_pct"),
        F.min(F.when(good, F.col("value"))).alias("good_min"),
        r(F.sum(F.when(good, F.round(F.col("value") * 100))) / F.count_if(good) / 100.0).alias("good_avg"),
        F.max(F.when(good, F.col("value"))).alias("good_max"))


def low_stock_parts(inv_gold: DataFrame) -> DataFrame:
    """Stock positions with the below-minimum flag and reorder gap (readers sort below first)."""
    below = F.col("unrestricted_stock") < F.col("safety_stock_level")
    return inv_gold.select("material_number", "plant", "unrestricted_stock", "safety_stock_level", below.alias("below_minimum"),
                           F.greatest(F.lit(0), F.col("safety_stock_level") - F.col("unrestricted_stock")).cast("bigint").alias("reorder_gap"))


def fleet_status(delivery: DataFrame, route_filter: str | None = None) -> DataFrame:
    """Shipments by status per carrier; optional free-text filter over four columns."""
    d = delivery
    if route_filter:
        t = route_filter.lower()
        cols = ["delivery_number", "customer_number", "shipping_carrier", "delivery_status"]
        d = d.filter(F.exists(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in cols]), lambda x: x.contains(t)))
    return d.groupBy("shipping_carrier", "delivery_status").agg(F.countDistinct("delivery_number").alias("shipments"))


# ---- F2, F3, F5 -----------------------------------------------------------------------------------


def _month_index(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int") - 1


def cost_trend_forecast(proc_lines: DataFrame, horizon: int = 6) -> DataFrame:
    """straight-line unit-cost forecast per material for the next ``horizon`` months
    (least squares over monthly average unit price by scheduled month)."""
    m = proc_lines.filter(F.col("unit_price").isNotNull()).select(
        "material_number", F.substring("scheduled_delivery_date", 1, 7).alias("period"), "unit_price")
    g = m.groupBy("material_number", "period").agg(F.avg("unit_price").alias("avg_unit_price"))
    g = g.withColumn("t", _month_index(F.col("period")))
    fit = g.groupBy("material_number").agg(
        F.regr_slope("avg_unit_price", "t").alias("slope"), F.regr_intercept("avg_unit_price", "t").alias("intercept"),
        F.avg("avg_unit_price").alias("mean_price"), F.max("t").alias("t_last"))
    f = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("t", F.col("t_last") + F.col("step"))
    price = F.coalesce(F.col("intercept") + F.col("slope") * F.col("t"), F.col("mean_price"))
    period = F.concat(F.floor(F.col("t") / 12).cast("int").cast("string"), F.lit("-"), F.lpad((F.col("t") % 12 + 1).cast("string"), 2, "0"))
    return f.select("material_number", period.alias("period"), F.col("step").cast("int").alias("horizon"),
                    P.round_half_up(price, 2).alias("forecast_unit_cost"))


def make_buy(proc_lines: DataFrame, costs: DataFrame, saving: float = 0.05, capacity_limit: float = 85.0) -> DataFrame:
    """F3 (thresholds are ours): per material x plant, the lowest supplier price against the internal cost
    of ``costs(material_number, internal_cost)``, and capacity use = the material's share (%) of its plant's
    volume. Buy when internal is dearer or unknown, Make when it saves at least ``saving`` and capacity
    use is below the limit, else Hybrid. Plant totals are sums of the material x plant rows, joined back: a plant
    with a third of all rows is never one task."""
    g = proc_lines.filter(F.col("unit_price").isNotNull()).groupBy("material_number", "plant").agg(
        F.min("unit_price").alias("supplier_price"), F.sum("ordered_quantity").alias("qty"))
    plants = g.groupBy(F.col("plant").alias("_plant")).agg(F.sum("qty").alias("_volume"))
    x = g.join(plants, g.plant.eqNullSafe(plants["_plant"])).join(costs, "material_number", "left")
    x = x.withColumn("capacity_use_pct", F.try_divide(F.col("qty") * 100.0, F.col("_volume")))
    price, internal = F.col("supplier_price"), F.col("internal_cost")
    decision = (
        F.when(internal.isNull() | (internal > price), F.lit("Buy"))
        .when((internal <= price * (1 - saving)) & (F.col("capacity_use_pct") < capacity_limit), F.lit("Make"))
        .otherwise(F.lit("Hybrid")))
    return x.select("material_number", "plant", P.round_half_up(price, 4).alias("supplier_price"),
                    P.round_half_up(internal, 4).alias("internal_cost"), P.round_half_up("capacity_use_pct", 4).alias("capacity_use_pct"),
                    decision.alias("decision"))


def action_generation(dos: DataFrame, cat_mape: DataFrame, scorecard: DataFrame, as_of: str, transfers: DataFrame | None = None,
                      log: DataFrame | None = None) -> DataFrame:
    """typed, prioritised actions from rule queries, with impact, due date and the status that the log gives them.

    Reorder at-risk materials, override biased category forecasts, escalate late suppliers, and (from ``transfers(sku, from_branch,
    to_branch, qty, unit_cost)``) move excess stock of one branch to another's shortfall: one action per lane of a SKU, due in two days, worth the goods
    moved. The action id is its type and entity, so the same rule hit keeps its id and its status from run to run.
    """
    d = F.lit(as_of).cast("date")
    reorder = dos.filter(F.col("health").isin("at_risk", "stockout")).select(
        F.lit("reorder").alias("action_type"), F.col("material_number").alias("entity_id"),
        F.when(F.col("health") == "stockout", F.lit("Critical")).otherwise(F.lit("High")).alias("priority"),
        F.col("annual_demand").cast("double").alias("impact"), F.date_add(d, 3).alias("due_date"))
    override = cat_mape.filter(F.abs(F.col("mean_bias_pct")) > 5).select(
        F.lit("forecast_override").alias("action_type"), F.col("category").alias("entity_id"), F.lit("Medium").alias("priority"),
        F.col("mean_bias_pct").alias("impact"), F.date_add(d, 7).alias("due_date"))
    escalate = scorecard.filter(F.col("on_time_pct") < 50).select(
        F.lit("escalate_supplier").alias("action_type"), F.col("supplier_number").alias("entity_id"), F.lit("High").alias("priority"),
        F.col("spend_usd").alias("impact"), F.date_add(d, 5).alias("due_date"))
    actions = reorder.unionByName(override).unionByName(escalate)
    if transfers is not None:
        value = P.round_half_up(F.col("qty") * F.col("unit_cost"), 2)
        actions = actions.unionByName(transfers.select(
            F.lit("lateral_transfer").alias("action_type"), F.concat_ws("/", "sku", "from_branch", "to_branch").alias("entity_id"),
            F.when(value >= TRANSFER_HIGH_USD, F.lit("High")).otherwise(F.lit("Medium")).alias("priority"),
            value.alias("impact"), F.date_add(d, 2).alias("due_date")))
    return with_status(actions.withColumn("action_id", F.concat_ws(":", "action_type", "entity_id")), log)


def with_status(actions: DataFrame, log: DataFrame | None) -> DataFrame:
    """Actions with their place in the life cycle from an append-only ``log(entry_id, action_id, status, changed_at)``.

    The newest entry counts (of entries at the same time the one of greatest id) unless an earlier one has closed the action: ``done`` and
    ``rejected`` hold until an entry says ``reopened``, which makes it pending again. Entries with another status or without a time
    don't count, nor do those of actions that no rule gives any more. Without an entry an action is pending.
    The log folds into one row an action by partial aggregates, so a hot action is no hot task.
    """
    if log is None:
        return actions.withColumns({"status": F.lit("pending"), "status_since": F.lit(None).cast("timestamp"), "n_changes": F.lit(0).cast("bigint")})
    known = log.filter(F.col("status").isin(*LIFE_CYCLE) & F.col("changed_at").isNotNull() & F.col("action_id").isNotNull())
    order = F.struct("changed_at", "entry_id")
    entry = F.struct("changed_at", "entry_id", "status")
    opened = known.groupBy("action_id").agg(F.max(F.when(F.col("status") == "reopened", order)).alias("_opened"), F.count(F.lit(1)).alias("n_changes"))
    # Since the last reopening: the first closing entry if there is one, else the newest entry.
    current = known.join(opened, "action_id").filter(F.col("_opened").isNull() | (order >= F.col("_opened")))
    closing = F.when(F.col("status").isin(*CLOSED), entry)
    state = current.groupBy("action_id", "n_changes").agg(F.coalesce(F.min(closing), F.max(entry)).alias("_s"))
    state = state.select("action_id", "n_changes", F.when(F.col("_s.status") == "reopened", F.lit("pending")).otherwise(F.col("_s.status")).alias("_status"),
                         F.col("_s.changed_at").alias("status_since"))
    joined = actions.join(state, "action_id", "left")
    return joined.withColumns({"status": F.coalesce("_status", F.lit("pending")), "n_changes": F.coalesce("n_changes", F.lit(0))}).drop("_status")


# ---- control tower ----------------------------------------------------------------------------------

#: The record sets of the control tower, each field with its source columns in order of preference, its type and its default.
CONTROL_TOWER = {
    "procurement": (
        ("po", ("ebeln", "po"), "string", ""), ("vendor", ("lifnr", "vendor"), "string", ""),
        ("vendorName", ("vendor_name", "vendorName", "vendor", "lifnr"), "string", ""), ("material", ("matnr", "material"), "string", ""),
        ("qty", ("menge", "qty"), "int", 0), ("value", ("netwr", "value"), "double", 0.0), ("status", ("status",), "string", "Open"),
        ("delivery", ("eindt", "delivery"), "string", "")),
    "inventory": (
        ("material", ("matnr", "material"), "string", ""), ("plant", ("werks", "plant"), "string", ""),
        ("storageLoc", ("lgort", "storageLoc"), "string", ""), ("unrestricted", ("unrestricted", "labst"), "int", 0),
        ("blocked", ("blocked", "speme"), "int", 0), ("inTransit", ("in_transit", "inTransit"), "int", 0),
        ("reorderPoint", ("reorder_point", "reorderPoint", "eisbe"), "int", 0)),
    "manufacturing": (
        ("order", ("aufnr", "order", "wono"), "string", ""), ("material", ("matnr", "material", "part"), "string", ""),
        ("plant", ("werks", "plant", "site"), "string", ""), ("qty", ("psmng", "qty", "qty_ord"), "int", 0),
        ("status", ("status", "ord_status"), "string", ""), ("start", ("gstrs", "start", "start_date"), "string", ""),
        ("end", ("gltrs", "end", "due_date"), "string", "")),
    "logistics": (
        ("delivery", ("vbeln", "delivery"), "string", ""), ("shipTo", ("kunnr", "shipTo"), "string", ""),
        ("material", ("matnr", "material"), "string", ""), ("qty", ("lfimg", "qty"), "int", 0), ("status", ("status",), "string", ""),
        ("planned", ("lfdat", "planned"), "string", ""), ("carrier", ("carrier", "tragr"), "string", "")),
    "demand": (
        ("order", ("vbeln", "order"), "string", ""), ("customer", ("kunnr", "customer"), "string", ""),
        ("material", ("matnr", "material"), "string", ""), ("qty", ("kwmeng", "qty"), "int", 0),
        ("requestDate", ("edatu", "requestDate"), "string", ""), ("status", ("status", "absta"), "string", ""),
        ("forecastQty", ("forecast_qty", "forecastQty"), "int", 0)),
}


def control_tower_payload(sets: dict[str, DataFrame | None]) -> DataFrame:
    """Records of unlike tables as one stream of ``record_set, payload``: a JSON object a row, its fields named for the control tower.

    A field comes from the first of its source columns that the table has (in any case), NULL values and absent columns take the
    default, and a set whose table is missing (None, or not given) has no records. Nothing is gathered: rows stay where they are read.
    """
    parts = []
    for name, fields in CONTROL_TOWER.items():
        df = sets.get(name)
        if df is None:
            continue
        found = resolve_columns(df, {target: (list(sources), default) for target, sources, _, default in fields})
        typed = [F.coalesce(F.col(target).cast(kind), F.lit(default).cast(kind)).alias(target) for target, _, kind, default in fields]
        parts.append(found.select(F.lit(name).alias("record_set"), F.to_json(F.struct(*typed)).alias("payload")))
    return reduce(DataFrame.unionByName, parts)
