"""Metric-drop diagnosis around 2024-01-10 on the test calendar."""

from __future__ import annotations

from oracles.base import normal_p, query

_DAYS = """
span AS (
  SELECT *, CASE WHEN date = DATE '2024-01-10' THEN 'drop' ELSE 'base' END AS side
  FROM sessions WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'
)
"""

_TEST = """
counts AS (
  SELECT CAST(count(*) FILTER (WHERE side = 'base') AS DOUBLE) AS nb,
         CAST(count(*) FILTER (WHERE side = 'drop') AS DOUBLE) AS nd,
         CAST(sum(converted) FILTER (WHERE side = 'base') AS DOUBLE) AS cb,
         CAST(sum(converted) FILTER (WHERE side = 'drop') AS DOUBLE) AS cd
  FROM span
),
scored AS (
  SELECT *, cb / nb AS pb, cd / nd AS pd,
         (cb / nb - cd / nd)
           / sqrt((cb + cd) / (nb + nd) * (1 - (cb + cd) / (nb + nd)) * (1 / nb + 1 / nd)) AS z
  FROM counts
),
tested AS (SELECT *, """ + normal_p("z") + """ AS p FROM scored)
"""

_IMPACT = """
hit AS (
  SELECT count(*) AS n, sum(revenue) AS actual, avg(converted) AS cr
  FROM sessions WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'
),
usual AS (
  SELECT avg(revenue) AS rps, avg(converted) AS cr
  FROM sessions WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'
)
"""

_LONG = """
long_span AS (
  SELECT unnest(['device', 'location', 'product_category', 'traffic_source']) AS dimension,
         unnest([device, location, product_category, traffic_source]) AS value,
         side, converted
  FROM span
),
changes AS (
  SELECT dimension, value,
         avg(converted) FILTER (WHERE side = 'base') AS b,
         avg(converted) FILTER (WHERE side = 'drop') AS d
  FROM long_span GROUP BY dimension, value
)
"""

_HOURS = """
hours AS (
  SELECT t.hour, t.n AS n_drop, y.n AS n_prev, t.cr AS cr_drop, y.cr AS cr_prev,
         round(t.cr - y.cr, 4) AS delta
  FROM (SELECT hour, count(*) AS n, round(avg(converted) * 100, 4) AS cr
        FROM sessions WHERE date = DATE '2024-01-10' GROUP BY hour) t
  JOIN (SELECT hour, count(*) AS n, round(avg(converted) * 100, 4) AS cr
        FROM sessions WHERE date = DATE '2024-01-09' GROUP BY hour) y USING (hour)
)
"""

_CAUSE = """
cause AS (
  SELECT max((d - b) / b) FILTER (WHERE value = 'mobile') AS mobile,
         max((d - b) / b) FILTER (WHERE value = 'desktop') AS desktop,
         (SELECT value FROM changes WHERE dimension = 'product_category' AND (d - b) / b IS NOT NULL
          ORDER BY (d - b) / b, value LIMIT 1) AS worst
  FROM changes WHERE dimension = 'device'
),
named AS (
  SELECT *,
    CASE WHEN abs(mobile) > 1.5 * abs(desktop) THEN 'Mobile UX / Payment Gateway'
         ELSE 'Product Category: ' || worst END AS category,
    CASE WHEN abs(mobile) > 1.5 * abs(desktop)
         THEN printf('MOBILE PAYMENT / UX ISSUE: Mobile CR dropped %.1f%% vs desktop %.1f%%. Check: mobile payment SDK, app update, responsive layout breakage.', mobile * 100, desktop * 100)
         ELSE 'CATEGORY-LEVEL ISSUE: ''' || worst || ''' shows the deepest CR drop. Check: inventory issues, price change, product page errors in this category.' END AS hypothesis
  FROM cause
)
"""

_BASE = "avg(converted) FILTER (WHERE side = 'base')"
_DROP = "avg(converted) FILTER (WHERE side = 'drop')"

SQL = {
    "drop_verify_union": query(
        """
SELECT CASE side WHEN 'drop' THEN 'drop_day' ELSE 'baseline_7d' END AS period,
       count(*) AS sessions, CAST(sum(converted) AS BIGINT) AS conversions,
       round(avg(converted) * 100, 4) AS cr_pct
FROM span GROUP BY side""",
        _DAYS,
    ),
    "drop_verify_ztest": query(
        """
SELECT round(pb * 100, 4) AS baseline_cr, round(pd * 100, 4) AS drop_day_cr,
       round((pd - pb) / pb * 100, 2) AS relative_drop, round((pd - pb) * 100, 4) AS absolute_drop,
       CAST(nb AS BIGINT) AS baseline_sessions, CAST(nd AS BIGINT) AS drop_day_sessions,
       round(z, 4) AS z_statistic, round(p, 8) AS p_value, p < 0.05 AS is_significant,
       CASE WHEN p < 0.05 THEN 'REAL DROP — statistically significant (p < 0.05)'
            ELSE 'LIKELY NOISE — not statistically significant' END AS verdict
FROM tested""",
        _DAYS,
        _TEST,
    ),
    "slice_device": query(
        f"""
SELECT device, round({_BASE} * 100, 4) AS baseline_cr_pct, round({_DROP} * 100, 4) AS drop_day_cr_pct,
       round(round({_DROP} - {_BASE}, 6) * 100, 4) AS absolute_change_pp
FROM span GROUP BY device""",
        _DAYS,
    ),
    "slice_location": query(
        f"""
SELECT location, round({_BASE} * 100, 4) AS baseline_cr_pct, round({_DROP} * 100, 4) AS drop_day_cr_pct
FROM span GROUP BY location""",
        _DAYS,
    ),
    "slice_category": query(
        f"""
SELECT product_category, round({_BASE} * 100, 4) AS baseline_cr_pct,
       round({_DROP} * 100, 4) AS drop_day_cr_pct, count(*) FILTER (WHERE side = 'drop') AS drop_day_sessions
FROM span GROUP BY product_category""",
        _DAYS,
    ),
    "slice_all_dims": query(
        """
SELECT dimension, value, round(b * 100, 4) AS baseline_cr, round(d * 100, 4) AS drop_cr,
       round((d - b) * 100, 4) AS absolute_change_pp,
       round((d - b) / nullif(b, 0) * 100, 2) AS relative_change_pct
FROM changes WHERE b IS NOT NULL AND d IS NOT NULL""",
        _DAYS,
        _LONG,
    ),
    "worst_segment": query(
        """
SELECT dimension, value AS worst_value, change AS relative_change_pct
FROM (SELECT *, round((d - b) / nullif(b, 0) * 100, 2) AS change FROM changes
      WHERE dimension IN ('device', 'traffic_source'))
WHERE change IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY change, value) = 1""",
        _DAYS,
        _LONG,
    ),
    "drop_hourly": query("""
SELECT hour, count(*) AS sessions, CAST(sum(converted) AS BIGINT) AS conversions,
       round(avg(converted) * 100, 4) AS cr_pct, round(avg(page_load_ms), 4) AS avg_load_ms
FROM sessions WHERE date = DATE '2024-01-10' GROUP BY hour"""),
    "hourly_vs_prev": query(
        "SELECT hour, n_drop AS sessions_drop, n_prev AS sessions_prev, cr_drop, cr_prev, delta FROM hours",
        _HOURS,
    ),
    "biggest_drop_hour": query(
        "SELECT hour AS biggest_drop_hour, delta AS delta_pp FROM hours ORDER BY delta, hour LIMIT 1", _HOURS
    ),
    "root_cause": query(
        """
SELECT round(mobile * 100, 2) AS mobile_delta_pct, round(desktop * 100, 2) AS desktop_delta_pct,
       worst AS worst_category, category AS root_cause_category, hypothesis AS primary_hypothesis
FROM named""",
        _DAYS,
        _LONG,
        _CAUSE,
    ),
    "business_impact": query(
        """
SELECT n AS sessions, round(actual, 2) AS actual_revenue_inr,
       round(rps * n, 2) AS expected_revenue_inr, round(rps * n - actual, 2) AS lost_revenue_inr
FROM hit CROSS JOIN usual""",
        _IMPACT,
    ),
    "business_impact_missed": query(
        """
SELECT 3 AS drop_window_days, n AS sessions_during_drop, round(rps, 4) AS baseline_rps_inr,
       round(actual, 2) AS actual_revenue_inr, round(rps * n, 2) AS expected_revenue_inr,
       round(rps * n - actual, 2) AS lost_revenue_inr,
       CAST(trunc(round((usual.cr - hit.cr) * n, 6)) AS BIGINT) AS missed_conversions
FROM hit CROSS JOIN usual""",
        _IMPACT,
    ),
}

_REPORT = [
    (1, "Verify drop", "Baseline CR", "printf('%.4f%%', round(pb * 100, 4))", "tested"),
    (1, "Verify drop", "Drop day CR", "printf('%.4f%%', round(pd * 100, 4))", "tested"),
    (1, "Verify drop", "Relative drop", "printf('%.2f%%', round((pd - pb) / pb * 100, 2))", "tested"),
    (1, "Verify drop", "Absolute drop", "printf('%.4fpp', round((pd - pb) * 100, 4))", "tested"),
    (1, "Verify drop", "Z statistic", "printf('%.4f', round(z, 4))", "tested"),
    (1, "Verify drop", "P value", "printf('%.8f', round(p, 8))", "tested"),
    (1, "Verify drop", "Significant", "CASE WHEN p < 0.05 THEN 'YES' ELSE 'NO' END", "tested"),
    (
        1,
        "Verify drop",
        "Verdict",
        "CASE WHEN p < 0.05 THEN 'REAL DROP — statistically significant (p < 0.05)' "
        "ELSE 'LIKELY NOISE — not statistically significant' END",
        "tested",
    ),
    (2, "Dimension slicing", "Worst device", "max(worst_value) FILTER (WHERE dimension = 'device')", "worst"),
    (2, "Dimension slicing", "Worst source", "max(worst_value) FILTER (WHERE dimension = 'traffic_source')", "worst"),
    (
        3,
        "Timeline",
        "Biggest drop hour",
        "printf('%02d:00', (SELECT hour FROM hours ORDER BY delta, hour LIMIT 1))",
        "(SELECT 1)",
    ),
    (4, "Root cause", "Mobile CR change", "printf('%.2f%%', round(mobile * 100, 2))", "named"),
    (4, "Root cause", "Desktop CR change", "printf('%.2f%%', round(desktop * 100, 2))", "named"),
    (4, "Root cause", "Root cause", "category", "named"),
    (4, "Root cause", "Primary hypothesis", "hypothesis", "named"),
    (5, "Business impact", "Sessions during drop", "format('{:,}', n)", "hit"),
    (5, "Business impact", "Expected revenue", "'₹' || format('{:,.2f}', round(rps * n, 2))", "hit, usual"),
    (5, "Business impact", "Actual revenue", "'₹' || format('{:,.2f}', round(actual, 2))", "hit"),
    (5, "Business impact", "Lost revenue", "'₹' || format('{:,}', CAST(round(rps * n - actual) AS BIGINT))", "hit, usual"),
    (
        5,
        "Business impact",
        "Missed conversions",
        "format('{:,}', CAST(trunc(round((usual.cr - hit.cr) * n, 6)) AS BIGINT))",
        "hit, usual",
    ),
]

SQL["diagnosis_report"] = query(
    "\nUNION ALL\n".join(
        f"SELECT {step} AS step, '{section}' AS section, {order} AS ord, '{metric}' AS metric, {value} AS value FROM {source}"
        for order, (step, section, metric, value, source) in enumerate(_REPORT, start=1)
    ),
    _DAYS,
    _TEST,
    _LONG,
    _HOURS,
    _CAUSE,
    _IMPACT,
    """worst AS (
  SELECT dimension, value AS worst_value
  FROM (SELECT *, round((d - b) / nullif(b, 0) * 100, 2) AS change FROM changes)
  WHERE change IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY change, value) = 1)""",
)
