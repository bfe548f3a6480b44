"""Calendar windows: lags, growth, control lags."""

from cellwise.operators import calendar as cal
from cellwise.plans import base as B
from cellwise.plans.registry import query

_ROUNDED_GROWTH = ", ".join(f"round({n}, 6) AS {n}" for n in B.GROWTHS.values())
_ROUNDED_LAGS = ", ".join(
    f"round({c}_lag{n}, 6) AS {c}_lag{n}" for c, steps in B.GROWTH_LAGS.items() for n in steps
)


@query(
    "panel_growth",
    B.with_sql(B.ACTIVITY_GROWTH_SQL)
    + f"""SELECT geo, ind, yr, is_suppressed, employment, establishments, round(payroll, 2) AS payroll,
         average_pay, {_ROUNDED_GROWTH} FROM activity_growth""",
)
def panel_growth(spark, folder):
    levels = B.activity_layer(spark, folder)
    grown = cal.add(levels, B.PANEL, "yr", cal.growths(B.GROWTHS, suppressed="is_suppressed"))
    return B.rounded(grown)


@query(
    "calendar_lags",
    B.with_sql(B.START_PANEL_SQL)
    + """SELECT geo, ind, yr, is_suppressed, round(start_rate, 6) AS start_rate,
         round(start_rate_lag1, 6) AS start_rate_lag1, round(start_rate_lag2, 6) AS start_rate_lag2,
         round(start_rate_lag3, 6) AS start_rate_lag3 FROM start_panel""",
)
def calendar_lags(spark, folder):
    return B.rounded(B.start_panel(spark, folder).drop("starts", "backbone"))


@query(
    "growth_lags",
    B.with_sql(B.ACTIVITY_PANEL_SQL)
    + f"SELECT geo, ind, yr, {_ROUNDED_GROWTH}, {_ROUNDED_LAGS} FROM activity_panel",
)
def growth_lags(spark, folder):
    drop = ["is_suppressed", *B.GROWTHS]
    return B.rounded(B.activity_panel(spark, folder).drop(*drop))
