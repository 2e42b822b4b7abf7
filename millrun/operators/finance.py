"""Finance summaries.

All money is summed as DECIMAL (exact, order-independent) and turned into DOUBLE only for the
reported figures. The quarter grain is small (quarters x regions), so the windows over it
(prior quarter budget, year-over-year) run on aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrun.functions import scalar as P

# Fixed values of the reference's finance rules.
BUDGET_GROWTH = "1.02"  # budget = prior quarter x 1.02
EBITDA_TARGET_PCT = 23.8
# Scenario table (name, revenue %, COGS %, OpEx %) for P45.
PL_SCENARIOS = (("base", 0.0, 0.0, 0.0), ("upside", 5.0, 2.0, 1.0), ("downside", -5.0, -1.0, 2.0))
# Working-capital scenario deltas (name, delta DSO days, delta DPO days) for P46.
WC_SCENARIOS = (("faster_collection", -5.0, 0.0), ("slower_payment", 0.0, 5.0), ("combined", -5.0, 5.0))


def _dec(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def pl_summary(lines: DataFrame) -> DataFrame:
    """P&L per region x fiscal quarter: revenue, COGS, OpEx, EBITDA, budget (prior quarter x 1.02)
    and revenue variance. ``lines`` carries region, order date, price, discount, tax, quantity."""
    rev = _dec(F.col("l_extendedprice")) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    opex = _dec(F.col("l_extendedprice")) * F.col("l_tax").cast("decimal(4,2)")
    cogs = (F.col("l_quantity").cast("int") * 10).cast("decimal(18,2)")
    q = lines.groupBy(
        "region", F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("fiscal_quarter")
    ).agg(F.sum(rev).alias("rev"), F.sum(cogs).alias("cogs"), F.sum(opex).alias("opex"))
    w = Window.partitionBy("region").orderBy("fiscal_year", "fiscal_quarter")  # one region's quarters
    budget = F.lag("rev", 1).over(w) * F.lit(BUDGET_GROWTH).cast("decimal(3,2)")
    return q.select(
        F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit("-Q"), F.col("fiscal_quarter").cast("string")).alias("period_key"),
        "region", "fiscal_year", "fiscal_quarter",
        F.col("rev").cast("double").alias("actual_revenue"),
        F.col("cogs").cast("double").alias("cogs"),
        F.col("opex").cast("double").alias("opex"),
        (F.col("rev") - F.col("cogs") - F.col("opex")).cast("double").alias("actual_ebitda"),
        budget.cast("double").alias("budget_revenue"),
        (F.col("rev") - budget).cast("double").alias("revenue_variance"),
    )


def _margin(ebitda: Column, revenue: Column) -> Column:
    return F.when(revenue != 0, P.round_half_up(ebitda / revenue * 100, 1))


def pl_trend(pl: DataFrame) -> DataFrame:
    """A29 + P33: revenue, EBITDA ($M, 1 dp) and margin % per quarter."""
    g = pl.groupBy("period_key", "fiscal_year", "fiscal_quarter").agg(
        F.sum(F.col("actual_revenue").cast("decimal(20,4)")).cast("double").alias("rev"),
        F.sum(F.col("actual_ebitda").cast("decimal(20,4)")).cast("double").alias("ebitda"),
    )
    return g.select(
        "period_key", "fiscal_year", "fiscal_quarter",
        P.round_half_up(F.col("rev") / 1e6, 1).alias("revenue_m"),
        P.round_half_up(F.col("ebitda") / 1e6, 1).alias("ebitda_m"),
        _margin(F.col("ebitda"), F.col("rev")).alias("margin_pct"),
    )


def finance_kpis(pl: DataFrame, year: int, quarter: int) -> DataFrame:
    """One quarter's totals and variance to budget ($M)."""
    q = pl.filter((F.col("fiscal_year") == year) & (F.col("fiscal_quarter") == quarter)).agg(
        F.sum(F.col("actual_revenue").cast("decimal(20,4)")).cast("double").alias("rev"),
        F.sum(F.col("actual_ebitda").cast("decimal(20,4)")).cast("double").alias("ebitda"),
        F.sum(F.col("revenue_variance").cast("decimal(24,6)")).cast("double").alias("var"),
    )
    return q.select(
        P.round_half_up(F.col("rev") / 1e6, 1).alias("total_revenue_m"),
        P.round_half_up(F.col("ebitda") / 1e6, 1).alias("total_ebitda_m"),
        _margin(F.col("ebitda"), F.col("rev")).alias("ebitda_margin_pct"),
        P.round_half_up(F.col("var") / 1e6, 1).alias("revenue_vs_budget_m"),
    )


def working_capital(lines: DataFrame, year: int, quarter: int, days: int = 90) -> DataFrame:
    """Per region for one quarter: DSO = open order value / revenue x 90, DPO = open line
    cost / COGS x 90, CCC = DSO - DPO, share of open value older than 90 days at quarter end."""
    qe = F.make_date(F.lit(year), F.lit(quarter * 3), F.lit(1))
    quarter_end = F.last_day(qe)
    l = lines.filter((F.year("o_orderdate") == year) & (F.quarter("o_orderdate") == quarter))
    rev = _dec(F.col("l_extendedprice")) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    cost = (F.col("l_quantity").cast("int") * 10).cast("decimal(18,2)")
    open_line = F.col("l_linestatus") == "O"
    old = F.datediff(quarter_end, F.to_date("o_orderdate")) > days
    g = l.groupBy("region").agg(
        F.sum(rev).cast("double").alias("rev"),
        F.sum(cost).cast("double").alias("cogs"),
        F.sum(F.when(open_line, rev)).cast("double").alias("ar"),
        F.sum(F.when(open_line, cost)).cast("double").alias("ap"),
        F.sum(F.when(open_line & old, rev)).cast("double").alias("ar_old"),
    )
    dso = F.when(F.col("rev") > 0, F.coalesce(F.col("ar"), F.lit(0.0)) / F.col("rev") * days)
    dpo = F.when(F.col("cogs") > 0, F.coalesce(F.col("ap"), F.lit(0.0)) / F.col("cogs") * days)
    r1 = lambda c: P.round_half_up(c, 1)
    return g.select(
        "region", r1(dso).alias("dso"), r1(dpo).alias("dpo"), r1(dso - dpo).alias("ccc"),
        r1(F.when(F.col("ar") > 0, F.coalesce(F.col("ar_old"), F.lit(0.0)) / F.col("ar") * 100)).alias("ar_90_plus_pct"),
    )


def working_capital_averages(wc: DataFrame) -> DataFrame:
    """A31 (second part): averages across regions."""
    return wc.agg(*[P.round_half_up(F.avg(c), 1).alias(f"avg_{c}") for c in ("dso", "dpo", "ccc", "ar_90_plus_pct")])


def cost_center_variance(lines: DataFrame, year: int) -> DataFrame:
    """Cost centre = nation, department = region; budget = prior-year cost x 1.02, actual =
    this year's cost; variance, over-budget flag and the department's share of revenue (real
    revenue, not the reference's constant, Q11)."""
    cost = (F.col("l_quantity").cast("int") * 10).cast("decimal(18,2)")
    rev = _dec(F.col("l_extendedprice")) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    y = F.year("o_orderdate")
    g = lines.filter(y.isin(year - 1, year)).groupBy(F.col("nation").alias("cost_center"), F.col("region").alias("department")).agg(
        (F.sum(F.when(y == year - 1, cost)) * F.lit(BUDGET_GROWTH).cast("decimal(3,2)")).alias("budget"),
        F.sum(F.when(y == year, cost)).alias("actual"),
        F.sum(F.when(y == year, rev)).alias("rev"),
    )
    dept = Window.partitionBy("department")  # a department's cost centres (bounded by nations)
    every = Window.partitionBy()  # the cost-centre rows only (aggregated)
    return g.select(
        "cost_center", "department",
        F.col("budget").cast("double").alias("budget_amount"),
        F.col("actual").cast("double").alias("actual_amount"),
        (F.col("actual") - F.col("budget")).cast("double").alias("variance"),
        (F.col("actual") > F.col("budget")).alias("over_budget"),
        P.round_half_up((F.sum("rev").over(dept) / F.sum("rev").over(every) * 100).cast("double"), 2).alias("department_revenue_share_pct"),
    )


def cash_flow(pl: DataFrame) -> DataFrame:
    """Quarterly cash flow: operating CF = EBITDA, capex = OpEx, FCF = OCF - capex (over regions)."""
    g = pl.groupBy("period_key", "fiscal_year", "fiscal_quarter").agg(
        F.sum(F.col("actual_ebitda").cast("decimal(20,4)")).alias("ocf"),
        F.sum(F.col("opex").cast("decimal(20,4)")).alias("capex"),
    )
    return g.select("period_key", "fiscal_year", "fiscal_quarter", F.col("ocf").cast("double").alias("operating_cash_flow"),
                    F.col("capex").cast("double").alias("capital_expenditures"),
                    (F.col("ocf") - F.col("capex")).cast("double").alias("free_cash_flow"))


def fcf_yoy(cf: DataFrame) -> DataFrame:
    """W11 + P33: FCF ($M) against four quarters earlier, % of the prior's absolute value; the
    first quarter stands in when there is no prior year (un-partitioned window on quarter rows)."""
    w = Window.orderBy("fiscal_year", "fiscal_quarter")
    prior = F.lag("free_cash_flow", 4).over(w)
    base = F.coalesce(prior, F.first("free_cash_flow").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return cf.select(
        "period_key",
        P.round_half_up(F.col("operating_cash_flow") / 1e6, 1).alias("operating_cf"),
        P.round_half_up(-F.col("capital_expenditures") / 1e6, 1).alias("capex"),
        P.round_half_up(F.col("free_cash_flow") / 1e6, 1).alias("fcf"),
        F.when(base != 0, P.round_half_up((F.col("free_cash_flow") - base) / F.abs(base) * 100, 1)).alias("fcf_yoy_pct"),
    )


def pl_scenarios(pl: DataFrame, year: int) -> DataFrame:
    """One year's P&L under revenue / COGS / OpEx % changes; GM %, EBITDA, margin, target.
    The scenario table is a literal array exploded on the single aggregate row (no join)."""
    a = pl.filter(F.col("fiscal_year") == year).agg(
        *[F.sum(F.col(c).cast("decimal(20,4)")).cast("double").alias(a) for c, a in
          (("actual_revenue", "rev"), ("cogs", "cogs"), ("opex", "opex"))]
    )
    sc = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(o).alias("o"))
                   for n, r, c, o in PL_SCENARIOS])
    x = a.select("*", F.explode(sc).alias("s"))
    rev = F.col("rev") * (1 + F.col("s.r") / 100)
    cogs = F.col("cogs") * (1 + F.col("s.c") / 100)
    opex = F.col("opex") * (1 + F.col("s.o") / 100)
    gp, ebitda = rev - cogs, rev - cogs - opex
    r1 = lambda c: P.round_half_up(c, 1)
    return x.select(
        F.col("s.scenario").alias("scenario"),
        r1(rev / 1e6).alias("revenue_m"), r1(gp / 1e6).alias("gross_profit_m"),
        r1(F.when(rev != 0, gp / rev * 100)).alias("gross_margin_pct"),
        r1(ebitda / 1e6).alias("ebitda_m"), r1(F.when(rev != 0, ebitda / rev * 100)).alias("ebitda_margin_pct"),
        F.coalesce(F.try_divide(ebitda, rev) * 100 >= EBITDA_TARGET_PCT, F.lit(False)).alias("meets_target"),
    )


def working_capital_impact(pl: DataFrame, year: int) -> DataFrame:
    """Cash released = -dDSO x revenue / 365 + dDPO x COGS / 365 for each scenario ($M)."""
    a = pl.filter(F.col("fiscal_year") == year).agg(
        *[F.sum(F.col(c).cast("decimal(20,4)")).cast("double").alias(a) for c, a in (("actual_revenue", "rev"), ("cogs", "cogs"))]
    )
    sc = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("d_dso"), F.lit(p).alias("d_dpo")) for n, d, p in WC_SCENARIOS])
    x = a.select("*", F.explode(sc).alias("s"))
    cash = -F.col("s.d_dso") * F.col("rev") / 365 + F.col("s.d_dpo") * F.col("cogs") / 365
    return x.select(F.col("s.scenario").alias("scenario"), P.round_half_up(cash / 1e6, 2).alias("cash_impact_m"))


# ---- P43 + P44: periods and organisation as joined tables ----------------------------------------------

#: Departments that a cost type covers.
COST_TYPES = (("opex", "Operations"), ("opex", "Commercial"), ("capex", "Technology"), ("ga", "Corporate"))
#: Our regions of the reference's business units.
BUSINESS_UNITS = (("amer", "AMERICA"), ("emea", "EUROPE"), ("emea", "MIDDLE EAST"), ("emea", "AFRICA"), ("apac", "ASIA"))


def fiscal_calendar(spark: SparkSession, first: str, last: str, start_month: int = 1) -> DataFrame:
    """A row for each month from ``first`` to ``last``: its fiscal year (named for the calendar year in which it ends) and quarter, and
    the period key ``FY<year>-Q<quarter>``."""
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH")))
    cal = spark.range(1).select(months.alias("month"))
    shifted = F.add_months("month", (13 - start_month) % 12)
    year, quarter = F.year(shifted), F.quarter(shifted)
    key = F.concat(F.lit("FY"), year.cast("string"), F.lit("-Q"), quarter.cast("string"))
    return cal.select("month", year.alias("fiscal_year"), quarter.alias("fiscal_quarter"), key.alias("period_key"))


def period_selections(calendar: DataFrame, as_of: str) -> DataFrame:
    """``selection, period_key`` of what a report can choose at ``as_of``: this quarter, the last quarter, the year to date,
    this and the last fiscal year, the first and the second quarter of this year, and all.

    A selection that reaches outside the calendar has the periods that are inside.
    """
    day = F.lit(as_of).cast("date")
    quarters = calendar.groupBy("period_key", "fiscal_year", "fiscal_quarter").agg(F.min("month").alias("starts"))
    now = quarters.where(F.col("starts") <= day).agg(F.max(F.struct("starts", "fiscal_year", "fiscal_quarter")).alias("now"))
    q = quarters.crossJoin(F.broadcast(now))  # one row
    index = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    current = F.col("now.fiscal_year") * 4 + F.col("now.fiscal_quarter")
    this_year = F.col("fiscal_year") == F.col("now.fiscal_year")
    rules = {
        "this_quarter": index == current, "last_quarter": index == current - 1, "ytd": this_year & (index <= current), "this_year": this_year,
        "last_year": F.col("fiscal_year") == F.col("now.fiscal_year") - 1, "q1": this_year & (F.col("fiscal_quarter") == 1),
        "q2": this_year & (F.col("fiscal_quarter") == 2), "all": F.lit(True),
    }
    chosen = F.explode(F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull()))
    return q.select(chosen.alias("selection"), "period_key")


def pl_by_selection(pl: DataFrame, selections: DataFrame) -> DataFrame:
    """P&L totals of every selection of periods."""
    j = pl.join(selections, "period_key")
    g = j.groupBy("selection").agg(
        F.countDistinct("period_key").alias("periods"), F.sum(F.col("actual_revenue").cast("decimal(20,4)")).cast("double").alias("revenue"),
        F.sum(F.col("actual_ebitda").cast("decimal(20,4)")).cast("double").alias("ebitda"))
    return g.withColumn("margin_pct", _margin(F.col("ebitda"), F.col("revenue")))


def cost_by_organisation(costs: DataFrame, selections: DataFrame) -> DataFrame:
    """P43 + P44: costs per selection of periods, business unit and cost type, from ``costs(region, department, period_key, cost)``.

    Units, cost types and periods are small tables that are joined; what belongs to no unit or type is reported under
    NULL, so that the parts add up to the whole.
    """
    spark = costs.sparkSession
    small = costs.groupBy("region", "department", "period_key").agg(F.sum(F.col("cost").cast("decimal(20,2)")).alias("cost"))
    units = spark.createDataFrame(BUSINESS_UNITS, "unit string, region string")
    types = spark.createDataFrame(COST_TYPES, "cost_type string, department string")
    j = small.join(units, "region", "left").join(types, "department", "left").join(selections, "period_key")
    return j.groupBy("selection", "unit", "cost_type").agg(F.sum("cost").cast("double").alias("cost"))
