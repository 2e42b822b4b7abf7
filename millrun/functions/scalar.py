"""Scalar derivations. Each is a Column expression or a ``with_x`` helper.

All of them are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_to_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text date -> DATE, NULL (not an error) for unparsable text such as ``2025-02-30``."""
    return F.try_to_date(col(c), fmt)


def safe_date_diff(end: Column | str, start: Column | str) -> Column:
    """Days between two text dates; NULL when either is missing or bad."""
    return F.datediff(safe_to_date(end), safe_to_date(start))


def year_month(c: Column | str) -> Column:
    """``yyyy-MM`` of a text date (NULL for a bad date)."""
    return F.date_format(safe_to_date(c), "yyyy-MM")


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round half-up on the binary double (floor(x*10^d + 0.5) / 10^d).

    ``round`` in Spark rounds the decimal text of a double while other engines round the binary
    value, so a ratio whose text ends in 5 can round differently. This form is one IEEE
    multiply, add and floor, identical everywhere.
    """
    scale = 10**digits
    return F.floor(col(c) * scale + 0.5) / scale


def safe_ratio(num: Column | str, den: Column | str, otherwise=None) -> Column:
    """num/den when den > 0, else NULL (or ``otherwise``)."""
    expr = F.when(col(den) > 0, col(num) / col(den))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def rejected_flag(c: Column | str) -> Column:
    """P5: not NULL and not empty."""
    return col(c).isNotNull() & (col(c) != "")


def delivery_status(planned: Column | str, actual: Column | str) -> tuple[Column, Column, Column]:
    """(variance_days, on_time, status). Three-valued: plan missing -> on_time NULL, status Late (Q6)."""
    both = col(actual).isNotNull() & col(planned).isNotNull()
    variance = F.when(both, F.datediff(col(actual), col(planned)))
    on_time = F.when(both, col(actual) <= col(planned))
    status = (
        F.when(col(actual).isNull(), F.lit("Pending"))
        .when(on_time == F.lit(True), F.lit("On Time"))
        .otherwise(F.lit("Late"))
    )
    return variance, on_time, status


def stock_tier(stock: Column | str, safety: Column | str) -> Column:
    """Critical below safety stock, Low below twice of it, else OK."""
    return (
        F.when(col(stock) < col(safety), F.lit("Critical"))
        .when(col(stock) < col(safety) * 2, F.lit("Low"))
        .otherwise(F.lit("OK"))
    )


def in_range_filter(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows whose columns lie in closed ranges; NULL never passes. ``None`` = open end."""
    conds = []
    for name, (lo, hi) in bounds.items():
        c = F.col(name)
        if lo is not None and hi is not None:
            conds.append(c.between(lo, hi))
        elif lo is not None:
            conds.append(c > lo)
        else:
            conds.append(c < hi)
    return df.filter(reduce(lambda a, b: a & b, conds))


def shift_of(ts: Column | str, day_start: int = 6, day_end: int = 17) -> tuple[Column, Column]:
    """(shift_id, shift_period). Hours day_start..day_end are the day shift.

    The calendar day of the reading names the shift (quirk Q2: 00:00-05:59 gets that day's night).
    """
    is_day = F.hour(col(ts)).between(day_start, day_end)
    sid = F.concat(F.date_format(col(ts), "yyyy-MM-dd"), F.lit("-"), F.when(is_day, F.lit("D")).otherwise(F.lit("N")))
    period = F.when(is_day, F.lit("Day")).otherwise(F.lit("Night"))
    return sid, period


def shift_period_from_id(shift_id: Column | str) -> Column:
    return F.when(col(shift_id).like("%-D"), F.lit("Day")).otherwise(F.lit("Night"))


def severity_normalize(c: Column | str) -> Column:
    """P10."""
    u = F.upper(col(c))
    return F.when(u.isin("CRITICAL", "HIGH", "MEDIUM"), u).otherwise(F.lit("LOW"))


def severity_rank(c: Column | str) -> Column:
    """CRITICAL 1, HIGH 2, MEDIUM 3, other 4."""
    x = col(c)
    return F.when(x == "CRITICAL", 1).when(x == "HIGH", 2).when(x == "MEDIUM", 3).otherwise(4)


def result_normalize(c: Column | str) -> Column:
    """P11."""
    low = F.lower(col(c))
    return F.when(low.isin("pass", "fail", "rework"), low).otherwise(F.lit("unknown"))


# Defect patterns in evaluation order -> canonical category.
DEFECT_PATTERNS = (
    ("%Solder%", "Solder Bridge"),
    ("%Bond Wire%", "Bond Wire Short"),
    ("%Misalign%", "Misalignment"),
    ("%Contam%", "Contamination"),
    ("%Missing%", "Missing Component"),
)


def defect_category(c: Column | str) -> Column:
    """First matching LIKE pattern; any other non-null text -> Other."""
    x = col(c)
    expr = None
    for pattern, name in DEFECT_PATTERNS:
        expr = F.when(x.like(pattern), F.lit(name)) if expr is None else expr.when(x.like(pattern), F.lit(name))
    return expr.when(x.isNotNull(), F.lit("Other"))


def downtime_category(state: Column | str, idle_reason: Column | str) -> Column:
    """P13."""
    st, ir = col(state), col(idle_reason)
    sw = ir.like("%firmware%") | ir.like("%software%")
    return (
        F.when(st == "fault", F.lit("Equipment Fault"))
        .when(st == "idle", F.when(sw, F.lit("Material / SW Hold")).otherwise(F.lit("Other")))
        .when(st == "maintenance", F.lit("Planned Maintenance"))
    )


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole-second interval length in minutes (double)."""
    return (F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))) / 60.0


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))).cast("double")


def risk_tier(p: Column | str, critical=0.80, high=0.55, medium=0.30) -> Column:
    """P25."""
    x = col(p)
    return (
        F.when(x >= critical, F.lit("CRITICAL"))
        .when(x >= high, F.lit("HIGH"))
        .when(x >= medium, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def zscore_severity(z: Column | str) -> Column:
    """|z| > 4 critical, > 3 high, else medium."""
    x = F.abs(col(z))
    return F.when(x > 4, F.lit("critical")).when(x > 3, F.lit("high")).otherwise(F.lit("medium"))


def status_slug(c: Column | str) -> Column:
    """P28."""
    return F.lower(F.regexp_replace(col(c), "_", "-"))


def scaled_money(c: Column | str, scale: float = 1e6, digits: int = 1) -> Column:
    """ROUND(x / 1e6, 1)."""
    return F.round(col(c) / scale, digits)


def kpi_band(c: Column | str, green: float, yellow: float) -> Column:
    """>= green -> green, >= yellow -> yellow, else red."""
    x = col(c)
    return F.when(x >= green, F.lit("green")).when(x >= yellow, F.lit("yellow")).otherwise(F.lit("red"))


def forecast_method(horizon_idx: Column | str) -> Column:
    """Months 0-2 Consensus, 3-8 Statistical, 9+ Long-Range."""
    h = col(horizon_idx)
    return F.when(h <= 2, F.lit("Consensus")).when(h <= 8, F.lit("Statistical")).otherwise(F.lit("Long-Range"))


def forecast_direction(bias_pct: Column | str, on_target: float = 3.0) -> Column:
    """Over / Under forecast beyond +-on_target %, else On target."""
    b = col(bias_pct)
    return F.when(b > on_target, F.lit("Over")).when(b < -on_target, F.lit("Under")).otherwise(F.lit("On target"))


def and_all(conds: list[Column]) -> Column:
    """AND of optional predicates (an empty list keeps every row)."""
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def dynamic_filter(df: DataFrame, **equals) -> DataFrame:
    """AND of the filters that are given: a value is matched exactly, a list by any of its values, None is no filter."""
    given = {k: v for k, v in equals.items() if v is not None}
    return df.filter(and_all([F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in given.items()]))
