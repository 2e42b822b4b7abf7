"""Finance queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrun.operators import finance as FI
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import query
from millrun.sources import bindings as B

YEAR, QUARTER = 2000, 4  # the reporting quarter of the finance dashboards


def RH(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10**d} + 0.5) / {10**d})"


REV = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
COST = "CAST(CAST(l_quantity AS INTEGER) * 10 AS DECIMAL(18,2))"
OPEX = "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))"

SQL_PL = f"""SELECT 'FY' || CAST(fiscal_year AS VARCHAR) || '-Q' || CAST(fiscal_quarter AS VARCHAR) AS period_key, region,
    fiscal_year, fiscal_quarter, CAST(rev AS DOUBLE) AS actual_revenue, CAST(cogs AS DOUBLE) AS cogs,
    CAST(opex AS DOUBLE) AS opex, CAST(rev - cogs - opex AS DOUBLE) AS actual_ebitda,
    CAST(lag(rev) OVER (PARTITION BY region ORDER BY fiscal_year, fiscal_quarter) * CAST(1.02 AS DECIMAL(3,2)) AS DOUBLE)
        AS budget_revenue,
    CAST(rev - lag(rev) OVER (PARTITION BY region ORDER BY fiscal_year, fiscal_quarter) * CAST(1.02 AS DECIMAL(3,2)) AS DOUBLE)
        AS revenue_variance
    FROM (SELECT region, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(quarter(o_orderdate) AS INTEGER) AS fiscal_quarter,
                 sum({REV}) AS rev, sum({COST}) AS cogs, sum({OPEX}) AS opex
          FROM finance_lines GROUP BY 1, 2, 3) q"""

_PLB = ["finance_lines"]
_PLC = [("pl", SQL_PL)]


def _pl(t):
    return FI.pl_summary(B.finance_lines(t))


@query("pl_summary", W(_PLB, [], SQL_PL))
def q_pl_summary(t):
    """P&L per region x quarter with budget and variance."""
    return _pl(t)


SQL_TREND_G = """SELECT period_key, fiscal_year, fiscal_quarter,
        CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) AS rev,
        CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) AS DOUBLE) AS ebitda FROM pl GROUP BY 1, 2, 3"""


@query(
    "pl_trend",
    W(_PLB, _PLC + [("g", SQL_TREND_G)],
      f"""SELECT period_key, fiscal_year, fiscal_quarter, {RH("rev / 1e6", 1)} AS revenue_m, {RH("ebitda / 1e6", 1)} AS ebitda_m,
          CASE WHEN rev <> 0 THEN {RH("ebitda / rev * 100", 1)} END AS margin_pct FROM g"""),
)
def q_pl_trend(t):
    """A29 + P33."""
    return FI.pl_trend(_pl(t))


@query(
    "finance_kpis",
    W(_PLB, _PLC,
      f"""SELECT {RH("rev / 1e6", 1)} AS total_revenue_m, {RH("ebitda / 1e6", 1)} AS total_ebitda_m,
          CASE WHEN rev <> 0 THEN {RH("ebitda / rev * 100", 1)} END AS ebitda_margin_pct, {RH("var / 1e6", 1)} AS revenue_vs_budget_m
          FROM (SELECT CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) AS rev,
                       CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) AS DOUBLE) AS ebitda,
                       CAST(sum(CAST(revenue_variance AS DECIMAL(24,6))) AS DOUBLE) AS var
                FROM pl WHERE fiscal_year = {YEAR} AND fiscal_quarter = {QUARTER}) k"""),
)
def q_finance_kpis(t):
    """A30 for the reporting quarter."""
    return FI.finance_kpis(_pl(t), YEAR, QUARTER)


SQL_WC = f"""WITH g AS (SELECT region, CAST(sum({REV}) AS DOUBLE) AS rev, CAST(sum({COST}) AS DOUBLE) AS cogs,
        CAST(sum(CASE WHEN l_linestatus = 'O' THEN {REV} END) AS DOUBLE) AS ar,
        CAST(sum(CASE WHEN l_linestatus = 'O' THEN {COST} END) AS DOUBLE) AS ap,
        CAST(sum(CASE WHEN l_linestatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE),
                 last_day(make_date({YEAR}, {QUARTER * 3}, 1))) > 90 THEN {REV} END) AS DOUBLE) AS ar_old
        FROM finance_lines WHERE year(o_orderdate) = {YEAR} AND quarter(o_orderdate) = {QUARTER} GROUP BY region),
    d AS (SELECT region, CASE WHEN rev > 0 THEN coalesce(ar, 0.0) / rev * 90 END AS dso,
                 CASE WHEN cogs > 0 THEN coalesce(ap, 0.0) / cogs * 90 END AS dpo,
                 CASE WHEN ar > 0 THEN coalesce(ar_old, 0.0) / ar * 100 END AS old FROM g)
    SELECT region, {RH("dso", 1)} AS dso, {RH("dpo", 1)} AS dpo, {RH("dso - dpo", 1)} AS ccc, {RH("old", 1)} AS ar_90_plus_pct FROM d"""


@query("working_capital", W(_PLB, [], SQL_WC))
def q_working_capital(t):
    """A31 per region for the reporting quarter."""
    return FI.working_capital(B.finance_lines(t), YEAR, QUARTER)


@query(
    "working_capital_averages",
    W(_PLB, [], f"""WITH wc AS ({SQL_WC[5:].split(chr(10), 1)[0] if False else SQL_WC})
        SELECT {RH("avg(dso)", 1)} AS avg_dso, {RH("avg(dpo)", 1)} AS avg_dpo, {RH("avg(ccc)", 1)} AS avg_ccc,
               {RH("avg(ar_90_plus_pct)", 1)} AS avg_ar_90_plus_pct FROM wc"""),
)
def q_working_capital_averages(t):
    """A31 averages across regions."""
    return FI.working_capital_averages(FI.working_capital(B.finance_lines(t), YEAR, QUARTER))


@query(
    "cost_center_variance",
    W(_PLB, [],
      f"""WITH g AS (SELECT nation AS cost_center, region AS department,
            sum(CASE WHEN year(o_orderdate) = {YEAR - 1} THEN {COST} END) * CAST(1.02 AS DECIMAL(3,2)) AS budget,
            sum(CASE WHEN year(o_orderdate) = {YEAR} THEN {COST} END) AS actual,
            sum(CASE WHEN year(o_orderdate) = {YEAR} THEN {REV} END) AS rev
          FROM finance_lines WHERE year(o_orderdate) IN ({YEAR - 1}, {YEAR}) GROUP BY 1, 2)
        SELECT cost_center, department, CAST(budget AS DOUBLE) AS budget_amount, CAST(actual AS DOUBLE) AS actual_amount,
            CAST(actual - budget AS DOUBLE) AS variance, actual > budget AS over_budget,
            {RH("CAST(sum(rev) OVER (PARTITION BY department) / sum(rev) OVER () * 100 AS DOUBLE)", 2)} AS department_revenue_share_pct
        FROM g"""),
)
def q_cost_center_variance(t):
    """A32 with the real revenue share (Q11 fix)."""
    return FI.cost_center_variance(B.finance_lines(t), YEAR)


@query(
    "fcf_yoy",
    W(_PLB, _PLC,
      f"""WITH cf AS (SELECT period_key, fiscal_year, fiscal_quarter,
            CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) AS DOUBLE) AS operating_cash_flow,
            CAST(sum(CAST(opex AS DECIMAL(20,4))) AS DOUBLE) AS capital_expenditures,
            CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) - sum(CAST(opex AS DECIMAL(20,4))) AS DOUBLE) AS free_cash_flow
          FROM pl GROUP BY 1, 2, 3),
        b AS (SELECT *, coalesce(lag(free_cash_flow, 4) OVER (ORDER BY fiscal_year, fiscal_quarter),
                                 first_value(free_cash_flow) OVER (ORDER BY fiscal_year, fiscal_quarter
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS base FROM cf)
        SELECT period_key, {RH("operating_cash_flow / 1e6", 1)} AS operating_cf, {RH("-capital_expenditures / 1e6", 1)} AS capex,
            {RH("free_cash_flow / 1e6", 1)} AS fcf,
            CASE WHEN base <> 0 THEN {RH("(free_cash_flow - base) / abs(base) * 100", 1)} END AS fcf_yoy_pct FROM b"""),
)
def q_fcf_yoy(t):
    """W11 over the quarterly cash flow."""
    return FI.fcf_yoy(FI.cash_flow(_pl(t)))


_SC = " UNION ALL ".join(f"SELECT '{n}' AS scenario, {r} AS r, {c} AS c, {o} AS o" for n, r, c, o in FI.PL_SCENARIOS)


@query(
    "pl_scenarios",
    W(_PLB, _PLC,
      f"""WITH a AS (SELECT CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) AS rev,
                           CAST(sum(CAST(cogs AS DECIMAL(20,4))) AS DOUBLE) AS cogs,
                           CAST(sum(CAST(opex AS DECIMAL(20,4))) AS DOUBLE) AS opex FROM pl WHERE fiscal_year = {YEAR}),
          s AS (SELECT scenario, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c, CAST(o AS DOUBLE) AS o FROM ({_SC}) v),
          x AS (SELECT scenario, rev * (1 + r / 100) AS rv, cogs * (1 + c / 100) AS cg, opex * (1 + o / 100) AS ox FROM a, s)
        SELECT scenario, {RH("rv / 1e6", 1)} AS revenue_m, {RH("(rv - cg) / 1e6", 1)} AS gross_profit_m,
            CASE WHEN rv <> 0 THEN {RH("(rv - cg) / rv * 100", 1)} END AS gross_margin_pct,
            {RH("(rv - cg - ox) / 1e6", 1)} AS ebitda_m,
            CASE WHEN rv <> 0 THEN {RH("(rv - cg - ox) / rv * 100", 1)} END AS ebitda_margin_pct,
            coalesce((rv - cg - ox) / rv * 100 >= 23.8, FALSE) AS meets_target FROM x"""),
)
def q_pl_scenarios(t):
    """P45 for the reporting year."""
    return FI.pl_scenarios(_pl(t), YEAR)


_WS = " UNION ALL ".join(f"SELECT '{n}' AS scenario, {d} AS d_dso, {p} AS d_dpo" for n, d, p in FI.WC_SCENARIOS)


@query(
    "working_capital_impact",
    W(_PLB, _PLC,
      f"""WITH a AS (SELECT CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) AS rev,
                           CAST(sum(CAST(cogs AS DECIMAL(20,4))) AS DOUBLE) AS cogs FROM pl WHERE fiscal_year = {YEAR}),
          s AS (SELECT scenario, CAST(d_dso AS DOUBLE) AS d_dso, CAST(d_dpo AS DOUBLE) AS d_dpo FROM ({_WS}) v)
        SELECT scenario, {RH("(-d_dso * rev / 365 + d_dpo * cogs / 365) / 1e6", 2)} AS cash_impact_m FROM a, s"""),
)
def q_working_capital_impact(t):
    """P46 for the reporting year."""
    return FI.working_capital_impact(_pl(t), YEAR)


# ---- P43 + P44 by joined tables ------------------------------------------------------------------------
FIRST_MONTH, LAST_MONTH, REPORT_DAY = "1992-01-01", "2002-12-31", "2000-11-15"
_SEL_SQL = f"""SELECT selection, period_key FROM (
        SELECT DISTINCT year(m) AS y, quarter(m) AS q, 'FY' || year(m)::VARCHAR || '-Q' || quarter(m)::VARCHAR AS period_key
        FROM (SELECT unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS m)) c,
    LATERAL (SELECT unnest(list_filter([
        if(y = {YEAR} AND q = {QUARTER}, 'this_quarter', NULL), if(y * 4 + q = {YEAR * 4 + QUARTER - 1}, 'last_quarter', NULL),
        if(y = {YEAR} AND q <= {QUARTER}, 'ytd', NULL), if(y = {YEAR}, 'this_year', NULL), if(y = {YEAR - 1}, 'last_year', NULL),
        if(y = {YEAR} AND q = 1, 'q1', NULL), if(y = {YEAR} AND q = 2, 'q2', NULL), 'all'], lambda x: x IS NOT NULL)) AS selection) l"""


def _selections(t):
    return FI.period_selections(FI.fiscal_calendar(t.spark, FIRST_MONTH, LAST_MONTH), REPORT_DAY)


@query(
    "pl_by_period",
    W(_PLB, _PLC + [("sel", _SEL_SQL)],
      f"""SELECT selection, count(DISTINCT period_key) AS periods, CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) AS revenue,
                 CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) AS DOUBLE) AS ebitda,
                 CASE WHEN sum(actual_revenue) <> 0 THEN {RH("CAST(sum(CAST(actual_ebitda AS DECIMAL(20,4))) AS DOUBLE) / CAST(sum(CAST(actual_revenue AS DECIMAL(20,4))) AS DOUBLE) * 100", 1)} END AS margin_pct
          FROM pl JOIN sel USING (period_key) GROUP BY 1"""),
)
def q_pl_by_period(t):
    """Quarter, last quarter, year to date, years and all over a fiscal calendar."""
    return FI.pl_by_selection(_pl(t), _selections(t))


def _costs(t):
    """Binding: a line's department by the length of its nation's name (five kinds, the last without a cost type)."""
    department = F.element_at(F.array(*[F.lit(d) for d in ("Operations", "Commercial", "Technology", "Corporate", "Research")]), F.length("nation") % 5 + 1)
    day = F.col("o_orderdate")
    key = F.concat(F.lit("FY"), F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    return B.finance_lines(t).select("region", department.alias("department"), key.alias("period_key"), (F.col("l_quantity").cast("int") * 10).cast("decimal(18,2)").alias("cost"))


@query(
    "cost_by_organisation",
    W(_PLB, [("sel", _SEL_SQL)],
      f"""SELECT selection, CASE region WHEN 'AMERICA' THEN 'amer' WHEN 'ASIA' THEN 'apac' WHEN 'EUROPE' THEN 'emea'
                                        WHEN 'AFRICA' THEN 'emea' WHEN 'MIDDLE EAST' THEN 'emea' END AS unit,
                 CASE length(nation) % 5 WHEN 0 THEN 'opex' WHEN 1 THEN 'opex' WHEN 2 THEN 'capex' WHEN 3 THEN 'ga' END AS cost_type,
                 CAST(sum({COST}) AS DOUBLE) AS cost
          FROM finance_lines JOIN sel ON period_key = 'FY' || year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR GROUP BY 1, 2, 3"""),
)
def q_cost_by_organisation(t):
    """P43 + P44: costs by selection of periods, business unit and cost type."""
    return FI.cost_by_organisation(_costs(t), _selections(t))
