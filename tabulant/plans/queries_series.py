"""Queries for time series: daily event values per type, daily order totals per priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulant.operators import series
from tabulant.plans.registry import query, rounded, table

DAILY = """e AS (SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 2) AS v
    FROM events GROUP BY 1, 2),
  p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM e)"""
KEYS = ("event_type", "day", "v")


def daily(spark, sf):
    day = F.date_trunc("day", F.col("ts")).alias("day")
    return (
        table(spark, sf, "events")
        .groupBy("event_type", day)
        .agg(F.round(F.sum("value"), 2).alias("v"))
    )


@query(
    "detect_trend",
    f"""WITH {DAILY} SELECT event_type, round(regr_slope(v, pos), 4) + 0.0 AS slope,
      round(regr_intercept(v, pos), 4) AS intercept, round(regr_r2(v, pos), 6) AS r_squared,
      round(sqrt(regr_r2(v, pos)), 6) AS strength, count(*) AS n FROM p GROUP BY 1""",
)
def q_trend(spark, sf):
    out = rounded(series.detect_trend(daily(spark, sf), *KEYS).drop("p_value"), 6)
    return out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)})


def _decompose_sql(period):
    h = period // 2
    total = f"sum(v) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    if period % 2 == 0:
        total += (
            f" - (lag(v, {h}) OVER (PARTITION BY event_type ORDER BY pos)"
            f" + lead(v, {h}) OVER (PARTITION BY event_type ORDER BY pos)) / 2"
        )
    return f"""{DAILY},
    t AS (SELECT *, CASE WHEN pos >= {h} AND pos < n - {h} THEN ({total}) / {period} END AS trend FROM p),
    f AS (SELECT event_type, pos % {period} AS ph, avg(v - trend) AS raw FROM t GROUP BY 1, 2),
    s AS (SELECT event_type, ph, raw - avg(raw) OVER (PARTITION BY event_type) AS seasonal FROM f),
    d AS (SELECT t.event_type, day, v, pos, trend, seasonal, v - trend - seasonal AS residual
          FROM t JOIN s ON s.event_type = t.event_type AND ph = pos % {period})"""


def _decompose_query(period):
    return f"""WITH {_decompose_sql(period)} SELECT event_type, v, pos AS position,
      round(trend, 4) AS trend, round(seasonal, 4) + 0.0 AS seasonal,
      round(residual, 4) + 0.0 AS residual FROM d"""


@query("seasonal_decompose", _decompose_query(7))
def q_decompose(spark, sf):
    return rounded(series.seasonal_decompose(daily(spark, sf), *KEYS, 7).drop("day"))


@query("seasonal_decompose_even", _decompose_query(6))
def q_decompose_even(spark, sf):
    return rounded(series.seasonal_decompose(daily(spark, sf), *KEYS, 6).drop("day"))


@query(
    "seasonal_strength",
    f"""WITH {_decompose_sql(12)} SELECT event_type, CAST(12 AS BIGINT) AS period, count(*) AS n,
      round(var_pop(seasonal) / var_pop(v), 6) AS seasonal_strength FROM d GROUP BY 1""",
)
def q_strength(spark, sf):
    return rounded(series.seasonal_strength(daily(spark, sf), *KEYS), 6)


@query(
    "forecast",
    f"""WITH RECURSIVE {DAILY}, g AS (SELECT 0.05 + 0.15 * i AS a, 0.05 + 0.15 * j AS b, i, j
      FROM range(0, 7) AS x(i), range(0, 7) AS y(j)),
    r AS (SELECT event_type, a::DOUBLE AS a, b::DOUBLE AS b, i, j, 0 AS pos, v AS level, t AS trend, 0.0::DOUBLE AS sse
      FROM g, (SELECT event_type, v, lead(v) OVER (PARTITION BY event_type ORDER BY pos) - v AS t, pos FROM p) WHERE pos = 0
      UNION ALL
      SELECT event_type, a, b, i, j, r.pos + 1, a * v + (1 - a) * (level + trend),
        b * (a * v + (1 - a) * (level + trend) - level) + (1 - b) * trend, sse + (v - level - trend) ** 2
      FROM r JOIN p USING (event_type) WHERE p.pos = r.pos + 1),
    best AS (SELECT r.* FROM r JOIN (SELECT DISTINCT event_type, n FROM p) USING (event_type) WHERE pos = n - 1
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sse, i, j) = 1)
    SELECT event_type, CAST(step AS BIGINT) AS step, round(level + step * trend, 4) AS forecast,
      round(a, 4) AS level_rate, round(b, 4) AS trend_rate
    FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM best)""",
)
def q_forecast(spark, sf):
    return rounded(series.forecast(daily(spark, sf), *KEYS))


@query(
    "moving_average_forecast",
    f"""WITH {DAILY} SELECT event_type, CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS step,
      forecast FROM (SELECT event_type, round(avg(v), 4) AS forecast FROM p WHERE pos >= n - 3
      GROUP BY 1)""",
)
def q_moving(spark, sf):
    return rounded(series.moving_average_forecast(daily(spark, sf), *KEYS))


@query(
    "make_sequences",
    f"""WITH {DAILY}, w AS (SELECT event_type, pos, v, list(v) OVER (PARTITION BY event_type
      ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM p)
    SELECT event_type, pos AS position, l[1] AS w1, l[2] AS w2, l[3] AS w3, l[4] AS w4, v AS label
    FROM w WHERE len(l) = 4""",
)
def q_sequences(spark, sf):
    out = series.make_sequences(daily(spark, sf), *KEYS, length=4)
    return rounded(
        out.select(
            "event_type",
            "position",
            *[F.col("window")[i].alias(f"w{i + 1}") for i in range(4)],
            "label",
        )
    )


@query(
    "ar_forecast",
    f"""WITH RECURSIVE {DAILY}, d AS (SELECT event_type, pos, n, v,
        v - lag(v) OVER (PARTITION BY event_type ORDER BY pos) AS d FROM p),
    b AS (SELECT *, lag(d) OVER (PARTITION BY event_type ORDER BY pos) AS d1 FROM d),
    f AS (SELECT event_type, regr_slope(d, d1) AS b, regr_intercept(d, d1) AS a FROM b GROUP BY 1),
    r AS (SELECT b.event_type, 0 AS step, v AS y, d AS dd, f.a, f.b FROM b
          JOIN f USING (event_type) WHERE pos = n - 1
          UNION ALL SELECT event_type, step + 1, y + a + b * dd, a + b * dd, a, b FROM r WHERE step < 5)
    SELECT event_type, CAST(step AS BIGINT) AS step, round(y, 4) AS forecast FROM r WHERE step > 0""",
)
def q_ar(spark, sf):
    return rounded(series.ar_forecast(daily(spark, sf), *KEYS))


@query(
    "ar_forecast_seasonal",
    f"""WITH {DAILY}, d AS (SELECT event_type, pos, n, v,
        v - lag(v, 7) OVER (PARTITION BY event_type ORDER BY pos) AS d FROM p),
    b AS (SELECT *, lag(d) OVER (PARTITION BY event_type ORDER BY pos) AS d1 FROM d),
    f AS (SELECT event_type, regr_slope(d, d1) AS b, regr_intercept(d, d1) AS a,
          max_by(d, pos) AS d0 FROM b GROUP BY 1),
    s AS (SELECT *, a + b * d0 AS e1 FROM f),
    s2 AS (SELECT *, a + b * e1 AS e2 FROM s), s3 AS (SELECT *, a + b * e2 AS e3 FROM s2)
    SELECT p.event_type, pos - n + 8 AS step,
      round(v + CASE pos - n + 8 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 4) AS forecast
    FROM p JOIN s3 USING (event_type) WHERE pos - n + 8 BETWEEN 1 AND 3""",
)
def q_ar_seasonal(spark, sf):
    return rounded(series.ar_forecast(daily(spark, sf), *KEYS, steps=3, season=7))


def _seasonal_sql(steps):
    """Trend and two waves of period 7 by least squares: columns are freed of those before them."""
    waves = [f"{f}((pos * {k}) % 7 * 2 * pi() / 7)" for k in (1, 2) for f in ("sin", "cos")]
    names = [f"x{i}" for i in range(5)]
    ctes = [
        DAILY,
        f"""q AS (SELECT event_type, pos, n, v FROM p UNION ALL
          SELECT event_type, n - 1 + unnest(range(1, {steps} + 1)), n, NULL FROM (SELECT DISTINCT event_type, n FROM p))""",
        "z0 AS (SELECT event_type, pos, n, v, v AS y, pos::DOUBLE AS x0, "
        + ", ".join(f"{w} AS x{i + 1}" for i, w in enumerate(waves)) + " FROM q)",
    ]
    own = "FILTER (v IS NOT NULL) OVER (PARTITION BY event_type)"
    centred = ", ".join(f"{c} - avg({c}) {own} AS {c}" for c in [*names, "y"])
    ctes.append(f"c0 AS (SELECT event_type, pos, n, v, avg(y) {own} AS fit, {centred} FROM z0)")
    for i, x in enumerate(names):
        slope = lambda c: f"(sum({c} * {x}) {own} / sum({x} * {x}) {own})"  # noqa: B023, E731
        rest = ", ".join(f"{c} - {slope(c)} * {x} AS {c}" for c in [*names[i + 1 :], "y"])
        ctes.append(f"c{i + 1} AS (SELECT event_type, pos, n, v, fit + {slope('y')} * {x} AS fit, {rest} FROM c{i})")
    return ", ".join(ctes)


@query(
    "seasonal_regression_forecast",
    f"""WITH {_seasonal_sql(5)} SELECT event_type, CAST(pos - n + 1 AS BIGINT) AS step, round(fit, 4) AS forecast
    FROM c5 WHERE v IS NULL""",
)
def q_seasonal_regression(spark, sf):
    return rounded(series.seasonal_regression_forecast(daily(spark, sf), *KEYS, period=7))


RESIDUALS = f"""{DAILY}, f AS (SELECT event_type, regr_slope(v, pos) AS b,
      regr_intercept(v, pos) AS a FROM p GROUP BY 1),
    r AS (SELECT event_type, pos, v - a - b * pos AS r FROM p JOIN f USING (event_type))"""


@query(
    "residual_anomalies_zscore",
    f"""WITH {RESIDUALS}, s AS (SELECT event_type, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1)
    SELECT event_type, pos AS position, round(r, 4) + 0.0 AS residual, abs((r - m) / s) > 1.5 AS anomaly
    FROM r JOIN s USING (event_type)""",
)
def q_anomaly_z(spark, sf):
    res = series.model_residuals(daily(spark, sf), *KEYS).select("event_type", "position", "residual")
    return rounded(series.residual_anomalies(res, "event_type", "zscore", 1.5))


@query(
    "residual_anomalies_error",
    f"""WITH {RESIDUALS}, s AS (SELECT event_type, avg(abs(r)) AS m, stddev_pop(abs(r)) AS s FROM r GROUP BY 1)
    SELECT event_type, pos AS position, round(r, 4) + 0.0 AS residual, abs(r) > m + 2 * s AS anomaly
    FROM r JOIN s USING (event_type)""",
)
def q_anomaly_error(spark, sf):
    res = series.model_residuals(daily(spark, sf), *KEYS).select("event_type", "position", "residual")
    return rounded(series.residual_anomalies(res, "event_type", "error"))


@query(
    "residual_anomalies_quantile",
    f"""WITH {RESIDUALS}, s AS (SELECT event_type, quantile_cont(abs(r), 0.95) AS q FROM r GROUP BY 1)
    SELECT event_type, pos AS position, round(r, 4) + 0.0 AS residual, abs(r) > q AS anomaly
    FROM r JOIN s USING (event_type)""",
)
def q_anomaly_quantile(spark, sf):
    res = series.model_residuals(daily(spark, sf), *KEYS).select("event_type", "position", "residual")
    return rounded(series.residual_anomalies(res, "event_type", "quantile"))


@query(
    "residual_anomalies_seasonal",
    f"""WITH {_seasonal_sql(0)}, r AS (SELECT event_type, v, pos, v - fit AS r FROM c5 WHERE v IS NOT NULL),
    s AS (SELECT event_type, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1)
    SELECT event_type, v, pos AS position, round(r, 4) + 0.0 AS residual, abs((r - m) / s) > 2 AS anomaly
    FROM r JOIN s USING (event_type)""",
)
def q_anomaly_seasonal(spark, sf):
    res = series.model_residuals(daily(spark, sf), *KEYS, model="seasonal")
    return rounded(series.residual_anomalies(res.drop("day"), "event_type"))
