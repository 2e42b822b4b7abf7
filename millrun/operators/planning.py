"""Planning, forecasting and supplier analytics (SURVEY §2.10 O1-O4, F1, F4; §2.2 P19-P24; §2.4 A17,
A18, A43, A45, A46; §2.5 W7, W8, W16).

Transfer plan without a solver (O2). Per SKU the objective separates: shortfall is minimal when
spoke needs are met from hub stock, so the optimum is max(0, total need - total supply). The
plan is deterministic: hubs and spokes are ordered by branch id and laid out on two number
lines (cumulative supply, cumulative need); hub i ships the part of its supply interval that
lies below the total need, spoke j receives the part of its need interval that lies below the
total supply. Only running sums per SKU (over that SKU's branches) are needed - no hub x spoke
pairs, no Python worker, and a hot category is spread over its SKUs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P
from millrun.session import cut_lineage

# Fixed values of the reference's planning rules.
MARGIN_RATE = 0.15
CI_HIST = 0.10  # +-10 % of the forecast for history rows
CI_FWD_BASE, CI_FWD_STEP = 0.08, 0.012  # forward: 8 % + 1.2 % per month
HORIZON_MONTHS = 12
DOS_FLOOR_DAYS = 7  # below 7 days of supply: stockout risk


# ---- P19-P21 filters -------------------------------------------------------------------------


def with_tariff(df: DataFrame, country: str, pct: float) -> DataFrame:
    """Unit cost x (1 + pct) when the origin equals ``country`` (case-insensitive)."""
    hit = F.lower(F.col("primary_origin")) == F.lit(country.lower())
    return df.withColumn("unit_cost_after_tariff", F.when(hit, F.col("unit_cost") * (1 + pct)).otherwise(F.col("unit_cost")))


def region_filter(df: DataFrame, region: str) -> DataFrame:
    """P20: region equals the target, or is blank / NULL."""
    r = F.lower(F.trim(F.coalesce(F.col("region"), F.lit(""))))
    return df.filter((r == region.lower()) | (r == ""))


def brand_filter(df: DataFrame, faithful: bool = False) -> DataFrame:
    """P21. Fixed form (default): flag contains "carrier", equals "1", or is blank / NULL.
    ``faithful=True`` keeps the reference's COALESCE, where ``contains`` is non-NULL for any text
    (quirk Q8), so only "carrier" texts and NULL survive."""
    f = F.col("carrier_flag").cast("string")
    if faithful:
        keep = F.coalesce(F.lower(f).contains("carrier"), f == "1", F.lit(True))
    else:
        keep = F.lower(f).contains("carrier") | (f == "1") | F.coalesce(F.trim(f), F.lit("")).eqNullSafe("")
    return df.filter(F.coalesce(keep, F.lit(False)))


# ---- O1 + O2 -----------------------------------------------------------------------------------


def network_roles(network: DataFrame, country: str = "nation_3", tariff_pct: float = 0.25, region: str = "FL",
                  faithful_brand: bool = False) -> DataFrame:
    """P19-P21 + O1: stock, safety stock, cost and role (HUB / SPOKE) per (category, SKU, branch).

    Duplicate (SKU, branch) rows are summed first (Q10). Categories with fewer than two rows,
    or without both a hub and a spoke after inference, produce no rows.
    """
    g = brand_filter(region_filter(with_tariff(network, country, tariff_pct), region), faithful_brand)
    g = g.withColumn("product_category", F.coalesce(F.col("product_category"), F.lit("Default")))
    keys = ["product_category", "sku", "branch_id"]
    rows = g.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("available_stock").cast("double"), F.lit(0.0))).alias("stock"),
        F.sum(F.coalesce(F.col("safety_stock").cast("double"), F.lit(0.0))).alias("safety"),
        F.max(F.upper(F.trim(F.col("location_type")))).alias("loc"),
        F.min("unit_cost_after_tariff").alias("cost"),
        F.count(F.lit(1)).alias("raw_rows"),
    )
    # three consumers below prune these rows to different columns, so Spark cannot reuse one
    # exchange for them and would rescan the inputs once per consumer; a reliable checkpoint in
    # the shared folder computes the network rows once (and survives executor loss)
    rows = cut_lineage(rows)
    # a row per branch of a category holds all that depends on the category alone; nothing as long as the
    # network is keyed by the category, which may be one of a handful
    br = rows.groupBy("product_category", "branch_id").agg(
        F.sum("stock").alias("tot"),
        F.sum("raw_rows").alias("rows"),
        F.max((F.col("loc") == "HUB").cast("int")).alias("hub"),
        F.max((F.col("loc") == "SPOKE").cast("int")).alias("spoke"),
    )
    wc = Window.partitionBy("product_category")
    # O1: rank branches by stock in the category; the top half (>= 1, <= n - 1) are hubs
    rank, n = F.row_number().over(wc.orderBy(F.desc("tot"), F.asc("branch_id"))), F.count(F.lit(1)).over(wc)
    explicit = (F.max("hub").over(wc) == 1) & (F.max("spoke").over(wc) == 1)
    facts = br.select("product_category", "branch_id", rank.alias("r"), n.alias("n"), F.sum("rows").over(wc).alias("n_rows"),
                      F.coalesce(explicit, F.lit(False)).alias("explicit"))
    n_hub = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") / 2)))
    inferred = F.when(F.col("r") <= n_hub, F.lit("HUB")).otherwise(F.lit("SPOKE"))
    facts = facts.filter((F.col("n_rows") >= 2) & (F.col("explicit") | (F.col("n") >= 2))).select(
        "product_category", "branch_id", "explicit", inferred.alias("inferred"))
    # AQE broadcasts the facts where their measured size allows it; beyond it the key is the branch, not the category
    r = rows.join(facts, ["product_category", "branch_id"])
    r = r.withColumn("role", F.when(F.col("explicit"), F.col("loc")).otherwise(F.col("inferred")))
    return r.filter(F.col("role").isin("HUB", "SPOKE"))


def transfer_plan(network: DataFrame, country: str = "nation_3", tariff_pct: float = 0.25, region: str = "FL",
                  faithful_brand: bool = False, protect_hub_safety: bool = False, ship_surplus: bool = False) -> DataFrame:
    """O1 + O2: recommended stock shift per (category, SKU, branch) and margin recovery.

    Hub rows ship (negative), spoke rows receive (positive); shifts sum to zero per SKU. With ``protect_hub_safety`` a hub
    ships only what it has above its own safety stock. With ``ship_surplus`` a second pass gives what the needs leave in the
    hubs to the SKU's first spoke (the literal optimum of the reference's objective, which rewards any movement).
    """
    roles = network_roles(network, country, tariff_pct, region, faithful_brand)
    return allocate(roles, F.lit(protect_hub_safety), F.lit(ship_surplus))


def transfer_plan_options(network: DataFrame, **filters) -> DataFrame:
    """O2 under each pair of options, from one reading of the network: ``transfer_plan`` plus the two option columns."""
    pairs = F.array(*[F.struct(F.lit(a).alias("protect_hub_safety"), F.lit(b).alias("ship_surplus")) for a in (False, True) for b in (False, True)])
    rows = network_roles(network, **filters).withColumn("_option", F.explode(pairs)).select("*", "_option.*").drop("_option")
    return allocate(rows, F.col("protect_hub_safety"), F.col("ship_surplus"), ["protect_hub_safety", "ship_surplus"])


def allocate(r: DataFrame, protect: Column, surplus: Column, options: list[str] | None = None) -> DataFrame:
    """O2 on rows with roles: running sums over each SKU's branches, no hub x spoke pairs."""
    options = options or []
    kept_back = F.when(protect, F.col("safety")).otherwise(F.lit(0.0))
    supply = F.when(F.col("role") == "HUB", F.greatest(F.col("stock") - kept_back, F.lit(0.0))).otherwise(F.lit(0.0))
    need = F.when(F.col("role") == "SPOKE", F.greatest(F.col("safety") - F.col("stock"), F.lit(0.0))).otherwise(F.lit(0.0))
    r = r.withColumn("supply", supply).withColumn("need", need)
    sku_w = Window.partitionBy("product_category", "sku", *options)  # one SKU's branches
    run = sku_w.orderBy("branch_id").rowsBetween(Window.unboundedPreceding, 0)
    r = (
        r.withColumn("s_cum", F.sum("supply").over(run))
        .withColumn("n_cum", F.sum("need").over(run))
        .withColumn("s_tot", F.sum("supply").over(sku_w))
        .withColumn("n_tot", F.sum("need").over(sku_w))
        .withColumn("sku_cost", F.min_by("cost", "branch_id").over(sku_w))
        .withColumn("first_spoke", F.min(F.when(F.col("role") == "SPOKE", F.col("branch_id"))).over(sku_w))
    )
    left = F.greatest(F.col("s_tot") - F.col("n_tot"), F.lit(0.0))
    r = r.withColumn("extra", F.when(surplus & F.col("first_spoke").isNotNull(), left).otherwise(F.lit(0.0)))
    asked = F.col("n_tot") + F.col("extra")
    shipped = F.greatest(F.lit(0.0), F.least(F.col("s_cum"), asked) - (F.col("s_cum") - F.col("supply")))
    received = F.greatest(F.lit(0.0), F.least(F.col("n_cum"), F.col("s_tot")) - (F.col("n_cum") - F.col("need")))
    received = received + F.when(F.col("branch_id") == F.col("first_spoke"), F.col("extra")).otherwise(F.lit(0.0))
    shift = F.when(F.col("role") == "HUB", -shipped).otherwise(received)
    return r.select(
        *options,
        "product_category",
        F.col("sku").alias("SKU"),
        F.col("branch_id").alias("Branch_ID"),
        F.col("role").alias("location_type"),
        (shift + F.lit(0.0)).alias("Recommended_Stock_Shift"),  # + 0.0 folds -0.0 into 0.0
        P.round_half_up(F.abs(shift) * F.col("sku_cost") * MARGIN_RATE, 4).alias("Projected_Margin_Recovery"),
    )


def plan_risk(plan: DataFrame, network: DataFrame) -> DataFrame:
    """Stock-out risk per category before and after the plan (sum of spoke shortfalls)."""
    n = network.groupBy(F.coalesce("product_category", F.lit("Default")).alias("product_category"),
                        F.col("sku").alias("SKU"), F.col("branch_id").alias("Branch_ID")).agg(
        F.sum("available_stock").cast("double").alias("stock"), F.sum("safety_stock").cast("double").alias("safety"))
    j = plan.filter(F.col("location_type") == "SPOKE").join(n, ["product_category", "SKU", "Branch_ID"])
    short = lambda add: F.greatest(F.lit(0.0), F.col("safety") - F.col("stock") - add)
    return j.groupBy("product_category").agg(
        F.sum(short(F.lit(0.0))).alias("risk_before"),
        F.sum(short(F.col("Recommended_Stock_Shift"))).alias("risk_after"),
        F.sum("Recommended_Stock_Shift").alias("units_moved"),
    )


def rebalance_pairs(network: DataFrame, freight_rate: float = 0.05) -> DataFrame:
    """Branch-to-branch transfer pairs per SKU, from branches above safety stock to branches
    below it, with freight cost = qty x unit cost x ``freight_rate`` (our parameter; the reference
    shows literal rows only).

    Excess and shortfall are laid out on two number lines per SKU (branches in id order); pair
    (i, j) moves the overlap of excess interval i and need interval j, capped at min(total excess,
    total need). The pairs come from merging the interval start points in one window per SKU and
    forward-filling the current source and target: at most (#sources + #targets - 1) pairs and
    never a source x target product. The (sku, branch) pre-aggregate bounds every window
    partition by the branch count, however many raw rows a hot SKU has."""
    g = network.groupBy("sku", "branch_id").agg(
        F.sum(F.coalesce(F.col("available_stock").cast("bigint"), F.lit(0))).alias("stock"),
        F.sum(F.coalesce(F.col("safety_stock").cast("bigint"), F.lit(0))).alias("safety"),
        F.min("unit_cost").alias("cost"),
    )
    g = g.withColumn("excess", F.greatest(F.col("stock") - F.col("safety"), F.lit(0))).withColumn(
        "need", F.greatest(F.col("safety") - F.col("stock"), F.lit(0)))
    sku_w = Window.partitionBy("sku")
    run = sku_w.orderBy("branch_id").rowsBetween(Window.unboundedPreceding, 0)
    g = (g.withColumn("e_end", F.sum("excess").over(run)).withColumn("n_end", F.sum("need").over(run))
         .withColumn("cap", F.least(F.sum("excess").over(sku_w), F.sum("need").over(sku_w)))
         .withColumn("sku_cost", F.min_by("cost", "branch_id").over(sku_w)))
    src = g.filter(F.col("excess") > 0).select(
        "sku", "cap", "sku_cost", (F.col("e_end") - F.col("excess")).alias("pos"), F.lit(0).alias("kind"),
        F.col("branch_id").alias("from_branch"), F.lit(None).cast("string").alias("to_branch"))
    dst = g.filter(F.col("need") > 0).select(
        "sku", "cap", "sku_cost", (F.col("n_end") - F.col("need")).alias("pos"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("from_branch"), F.col("branch_id").alias("to_branch"))
    pts = src.unionByName(dst).filter(F.col("pos") < F.col("cap"))
    order = sku_w.orderBy("pos", "kind")
    fill = order.rowsBetween(Window.unboundedPreceding, 0)
    pts = (pts.withColumn("f", F.last("from_branch", ignorenulls=True).over(fill))
           .withColumn("t", F.last("to_branch", ignorenulls=True).over(fill))
           .withColumn("end", F.coalesce(F.lead("pos").over(order), F.col("cap"))))
    seg = pts.filter(F.col("f").isNotNull() & F.col("t").isNotNull() & (F.col("end") > F.col("pos")))
    return seg.select(
        "sku", F.col("f").alias("from_branch"), F.col("t").alias("to_branch"), (F.col("end") - F.col("pos")).alias("qty"),
        F.col("sku_cost").alias("unit_cost"),
        P.round_half_up((F.col("end") - F.col("pos")) * F.col("sku_cost") * freight_rate, 2).alias("freight_cost"))


# ---- forecasting (P22-P24, F1, F4, W7, W16) -----------------------------------------------------


def _half_up_div(num: Column, den: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor((num * (2 * scale) + den) / (den * 2)) / scale


def forecast_accuracy(history: DataFrame) -> DataFrame:
    """P22 + P23: abs % error, signed bias %, value, +-10 % interval, direction per SKU x month."""
    a, f = F.col("actual_qty"), F.col("forecast_qty")
    ci = F.floor((f * 2 + 10) / 20)  # round(f * 0.10), exact on integers
    err = F.when(a > 0, _half_up_div(F.abs(f - a) * 100, a, 1))
    bias = F.when(a > 0, _half_up_div((f - a) * 100, a, 1))
    return history.select(
        "sku_id", "category", "period", "forecast_qty", "actual_qty",
        P.round_half_up(a * F.col("avg_selling_price"), 2).alias("forecast_value_usd"),
        err.alias("mape"), bias.alias("bias_pct"),
        F.greatest(F.lit(0), f - ci).cast("bigint").alias("confidence_lower"), (f + ci).cast("bigint").alias("confidence_upper"),
        P.forecast_direction(bias).alias("direction"),
    )


def category_mape(acc: DataFrame) -> DataFrame:
    """MAPE, mean bias and SKU count per category, plus WMAPE = sum|f - a| / sum a."""
    return acc.filter(F.col("actual_qty") > 0).groupBy("category").agg(
        P.round_half_up(F.sum(F.round(F.col("mape") * 10)) / F.count(F.lit(1)) / 10, 2).alias("mape"),
        P.round_half_up(F.sum(F.round(F.col("bias_pct") * 10)) / F.count(F.lit(1)) / 10, 2).alias("mean_bias_pct"),
        F.countDistinct("sku_id").alias("sku_count"),
        _half_up_div(F.sum(F.abs(F.col("forecast_qty") - F.col("actual_qty"))) * 100, F.sum("actual_qty"), 2).alias("wmape"),
    )


def naive_forecast(history: DataFrame) -> DataFrame:
    """W7 + W16: last month's actual (own value for the first month) and the mean of the three
    previous months, per SKU (a SKU's months are one window partition)."""
    w = Window.partitionBy("sku_id").orderBy("period")
    return history.select(
        "sku_id", "period", "actual_qty",
        F.coalesce(F.lag("actual_qty", 1).over(w), F.col("actual_qty")).alias("naive_forecast"),
        P.round_half_up(F.avg("actual_qty").over(w.rowsBetween(-3, -1)), 2).alias("rolling_avg_3"),
        F.when(F.lag("actual_qty", 1).over(w).isNull(), F.lit("seed")).otherwise(F.lit("naive")).alias("period_type"),
    )


def _month_index(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int") - 1


def seasonal_forecast(history: DataFrame, horizon: int = HORIZON_MONTHS) -> DataFrame:
    """F1 + P24: per SKU a straight line over the month index (least squares) times a
    month-of-year index (month mean / overall mean), projected ``horizon`` months past the SKU's
    last month, with an interval widening 8 % + 1.2 % per month."""
    h = history.withColumn("t", _month_index(F.col("period"))).withColumn("moy", F.substring("period", 6, 2).cast("int"))
    fit = h.groupBy("sku_id").agg(
        F.regr_slope("actual_qty", "t").alias("slope"),
        F.regr_intercept("actual_qty", "t").alias("intercept"),
        F.avg("actual_qty").alias("mean_all"),
        F.max("t").alias("t_last"),
    )
    season = h.groupBy("sku_id", "moy").agg(F.avg("actual_qty").alias("mean_moy"))
    fut = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fut = fut.withColumn("t", F.col("t_last") + F.col("step")).withColumn("moy", F.col("t") % 12 + 1)
    fut = fut.join(season, ["sku_id", "moy"], "left")
    idx = F.when(F.col("mean_all") > 0, F.coalesce(F.col("mean_moy"), F.col("mean_all")) / F.col("mean_all")).otherwise(F.lit(1.0))
    base = F.coalesce(F.col("intercept") + F.col("slope") * F.col("t"), F.col("mean_all"))
    qty = F.greatest(F.lit(0.0), base * idx)
    fc = F.floor(qty + 0.5).cast("bigint")
    i = F.col("step") - 1
    width = F.floor(fc * (F.lit(CI_FWD_BASE) + i * CI_FWD_STEP) + 0.5).cast("bigint")
    period = F.concat(
        (F.floor(F.col("t") / 12)).cast("int").cast("string"), F.lit("-"), F.lpad((F.col("t") % 12 + 1).cast("string"), 2, "0")
    )
    return fut.select(
        "sku_id", period.alias("period"), F.col("step").cast("int").alias("horizon"), fc.alias("forecast_qty"),
        F.greatest(F.lit(0), fc - width).cast("bigint").alias("confidence_lower"), (fc + width).alias("confidence_upper"),
        P.forecast_method(i).alias("forecast_method"),
    )


def bias_override(forecast: DataFrame, acc: DataFrame) -> DataFrame:
    """apply the opposite of each SKU's mean historical bias to its forward forecast."""
    b = acc.filter(F.col("bias_pct").isNotNull()).groupBy("sku_id").agg(
        (F.sum(F.round(F.col("bias_pct") * 10)) / F.count(F.lit(1)) / 10).alias("mean_bias_pct")
    )
    j = forecast.join(b, "sku_id", "left").withColumn("mean_bias_pct", F.coalesce("mean_bias_pct", F.lit(0.0)))
    return j.select(
        "sku_id", "period", "forecast_qty", P.round_half_up("mean_bias_pct", 2).alias("mean_bias_pct"),
        F.greatest(F.lit(0.0), F.floor(F.col("forecast_qty") * (1 - F.col("mean_bias_pct") / 100.0) + 0.5)).cast("bigint")
        .alias("adjusted_forecast_qty"),
    )


def canonical_sku(catalog: DataFrame, id_col: str, desc_col: str) -> DataFrame:
    """W8 (intended form, Q3): one canonical id per description = its smallest id; every row kept."""
    canon = catalog.groupBy(F.trim(F.col(desc_col)).alias("_d")).agg(F.min(id_col).alias("canonical_sku_id"))
    return catalog.join(canon, F.trim(F.col(desc_col)) == F.col("_d")).drop("_d")


# ---- supply analytics (A17, A43, A45, A46) -------------------------------------------------------


def demand_monthly(order_lines_df: DataFrame) -> DataFrame:
    """Quantity and order count per material x month (bad order dates are skipped)."""
    return order_lines_df.filter(F.col("order_year_month").isNotNull()).groupBy("material_number", "order_year_month").agg(
        F.sum("order_quantity").cast("bigint").alias("actual_qty"),
        F.countDistinct("sales_order_number").alias("order_count"),
        P.round_half_up(F.avg("order_quantity"), 2).alias("avg_line_qty"),
    )


def supplier_scorecard(proc_gold: DataFrame, delivery: DataFrame) -> DataFrame:
    """Per supplier PO count, spend and on-time % of the deliveries of its orders."""
    d = delivery.groupBy("delivery_number").agg(
        F.count_if(F.col("on_time_delivery") == F.lit(True)).alias("on_time"),
        F.count_if(F.col("on_time_delivery").isNotNull()).alias("completed"),
    )
    j = proc_gold.join(d, proc_gold.purchase_order_number == d.delivery_number, "left")
    return j.groupBy("supplier_number").agg(
        F.count(F.lit(1)).alias("po_count"),
        F.sum(F.col("total_net_value_usd").cast("decimal(18,2)")).cast("double").alias("spend_usd"),
        F.coalesce(F.sum("on_time"), F.lit(0)).cast("bigint").alias("on_time_lines"),
        F.coalesce(F.sum("completed"), F.lit(0)).cast("bigint").alias("completed_lines"),
    ).withColumn(
        "on_time_pct",
        F.when(F.col("completed_lines") > 0, _half_up_div(F.col("on_time_lines") * 100, F.col("completed_lines"), 1)),
    )


def days_of_supply(
    inv_gold: DataFrame, order_lines_df: DataFrame, as_of: str, days: int = 365, lo: float = 30.0, hi: float = 90.0
) -> DataFrame:
    """Days of supply = stock / average daily demand of the ``days`` up to ``as_of`` per material, and health.

    stockout: nothing left, or less than DOS_FLOOR_DAYS of demand (it runs out before an order arrives);
    at_risk below ``lo``, excess above ``hi`` or without demand, else optimal. Lines without a valid order date have no demand rate.
    """
    ordered = P.safe_to_date("order_date")
    last = F.lit(as_of).cast("date")
    order_lines_df = order_lines_df.filter((ordered > F.date_sub(last, days)) & (ordered <= last))
    stock = inv_gold.groupBy("material_number").agg(F.sum("unrestricted_stock").cast("bigint").alias("stock"))
    dem = order_lines_df.groupBy("material_number").agg(F.sum("order_quantity").cast("bigint").alias("qty"))
    j = stock.join(dem, "material_number", "left").withColumn("qty", F.coalesce("qty", F.lit(0)))
    dos = F.when(F.col("qty") > 0, _half_up_div(F.col("stock") * days, F.col("qty"), 1))
    health = (
        F.when((F.col("stock") <= 0) | (dos < DOS_FLOOR_DAYS), F.lit("stockout"))
        .when(dos.isNull(), F.lit("excess"))
        .when(dos < lo, F.lit("at_risk"))
        .when(dos > hi, F.lit("excess"))
        .otherwise(F.lit("optimal"))
    )
    return j.select("material_number", "stock", F.col("qty").alias("annual_demand"), dos.alias("days_of_supply"), health.alias("health"))


def dc_utilization(positions: DataFrame, capacity: DataFrame, dos: DataFrame) -> DataFrame:
    """A46 per distribution centre (plant): stock units against ``capacity(plant, capacity_units)``, SKUs, and materials by health.

    A centre without a stated capacity has NULL utilisation. Positions are reduced to plant x material before anything else,
    so a hot plant or material is one row a task.
    """
    pm = positions.groupBy("plant", "material_number").agg(F.sum("total_stock").cast("bigint").alias("units"))
    j = pm.join(dos.select("material_number", "health"), "material_number", "left")
    g = j.groupBy("plant").agg(
        F.sum("units").alias("stock_units"), F.count_if(F.col("units") > 0).alias("skus"),
        *[F.count_if(F.col("health") == h).alias(f"{h}_skus") for h in ("optimal", "excess", "at_risk", "stockout")])
    pct = F.when(F.col("capacity_units") > 0, _half_up_div(F.col("stock_units") * 100, F.col("capacity_units"), 1))
    return g.join(capacity, "plant", "left").withColumn("utilization_pct", pct)


def category_days_of_supply(dos: DataFrame, categories: DataFrame, bands: DataFrame, days: int = 365) -> DataFrame:
    """A46 per category: days of supply of its summed stock and demand, against the band ``bands(category, lo, hi)``.

    ``categories(material_number, category, unit_value)``; materials without a category are left out. The position is "below", "in" or "above" the band,
    NULL without demand or band.
    """
    j = dos.join(categories, "material_number")
    value = F.col("stock").cast("decimal(20,0)") * F.col("unit_value").cast("decimal(18,2)")
    g = j.groupBy("category").agg(
        F.sum("stock").cast("bigint").alias("stock"), F.sum("annual_demand").cast("bigint").alias("annual_demand"),
        F.sum(value).cast("double").alias("value"), *[F.count_if(F.col("health") == h).alias(h) for h in ("optimal", "excess", "at_risk", "stockout")])
    g = g.withColumn("days_of_supply", F.when(F.col("annual_demand") > 0, _half_up_div(F.col("stock") * days, F.col("annual_demand"), 1)))
    dos_ = F.col("days_of_supply")
    place = F.when(dos_ < F.col("lo"), F.lit("below")).when(dos_ > F.col("hi"), F.lit("above")).when(dos_.isNotNull() & F.col("lo").isNotNull(), F.lit("in"))
    return g.join(bands, "category", "left").withColumn("position", place)


def order_automation(headers: DataFrame, automated_types=("4-NOT SPECIFIED", "5-LOW")) -> DataFrame:
    """Orders per month (valid order dates), automated vs manual by order type, and the rate."""
    o = headers.select(P.year_month("audat").alias("order_year_month"), F.col("auart").isin(*automated_types).cast("int").alias("auto"))
    return o.filter(F.col("order_year_month").isNotNull()).groupBy("order_year_month").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("auto").cast("bigint").alias("automated"),
    ).withColumn("manual", F.col("total_orders") - F.col("automated")).withColumn(
        "automation_rate_pct", _half_up_div(F.col("automated") * 100, F.col("total_orders"), 1)
    )
