"""North star, drivers and metrics tree."""

from __future__ import annotations

from oracles.base import query, student_p

_CORRELATION = """
moments AS (
  SELECT corr(page_load_ms, converted) AS r, CAST(count(*) AS DOUBLE) AS n FROM sessions
),
tested AS (SELECT r, n, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM moments)
"""

_VISITORS = """
freq AS (SELECT user_id, count(*) AS visits FROM sessions GROUP BY user_id),
visitors AS (
  SELECT avg(converted) FILTER (WHERE visits > 1) AS ret,
         avg(converted) FILTER (WHERE visits = 1) AS new,
         count(*) FILTER (WHERE visits > 1) AS ret_n,
         count(*) FILTER (WHERE visits = 1) AS new_n
  FROM sessions JOIN freq USING (user_id)
)
"""

SQL = {
    "north_star": query("""
SELECT 'North Star Metric' AS metric_name,
       count(*) AS total_sessions,
       CAST(sum(converted) AS BIGINT) AS total_conversions,
       round(100 * avg(converted), 3) AS conversion_rate_pct,
       round(sum(revenue), 2) AS total_revenue_inr,
       round(avg(revenue), 4) AS revenue_per_session_inr
FROM sessions"""),
    "north_star_daily_stats": query(
        """
SELECT 'Conversion Rate' AS north_star_metric,
       round((SELECT avg(converted) FROM sessions) * 100, 3) AS overall_cr,
       round(avg(cr) * 100, 3) AS avg_daily_cr,
       round(stddev_samp(cr) * 100, 4) AS cr_std,
       CAST(sum(n) AS BIGINT) AS total_sessions,
       CAST(sum(c) AS BIGINT) AS total_conversions,
       round((SELECT sum(revenue) FROM sessions), 2) AS total_revenue_inr
FROM daily""",
        "daily AS (SELECT date, count(*) AS n, sum(converted) AS c, avg(converted) AS cr FROM sessions GROUP BY date)",
    ),
    "daily_cr": query("""
SELECT date, count(*) AS sessions, CAST(sum(converted) AS BIGINT) AS conversions,
       round(avg(converted) * 100, 4) AS cr_pct,
       round(sum(revenue), 2) AS daily_revenue,
       round(avg(avg(converted)) OVER (ORDER BY date ROWS 6 PRECEDING) * 100, 4) AS cr_7d_rolling_avg_pct
FROM sessions GROUP BY date"""),
    "driver_page_experience": query("""
SELECT 'Page Experience' AS driver,
       round(avg(page_load_ms), 4) AS avg_page_load_ms,
       round(avg(bounced) * 100, 3) AS bounce_rate_pct,
       round(avg(converted) FILTER (WHERE device = 'mobile') * 100, 4) AS mobile_cr_pct,
       round(avg(converted) FILTER (WHERE device = 'desktop') * 100, 4) AS desktop_cr_pct,
       round((avg(converted) FILTER (WHERE device = 'desktop')
              - avg(converted) FILTER (WHERE device = 'mobile')) * 100, 4) AS mobile_gap_pp
FROM sessions"""),
    "load_cr_correlation": query(
        f"""
SELECT round(r, 4) AS correlation_with_cr, round({student_p('t', 'df')}, 6) AS p_value,
       CAST(n AS BIGINT) AS sessions
FROM tested""",
        _CORRELATION,
    ),
    "driver_discovery": query("""
SELECT traffic_source, count(*) AS sessions,
       round(100.0 * count(*) / (SELECT count(*) FROM sessions), 2) AS traffic_share_pct,
       round(avg(converted) * 100, 4) AS cr_pct,
       round(sum(revenue), 2) AS revenue
FROM sessions GROUP BY traffic_source"""),
    "paid_vs_organic": query(
        """
SELECT share AS organic_share_pct,
       CASE WHEN share >= 25 THEN '✅' ELSE '⚠️' END AS organic_status,
       round(paid * 100, 3) AS paid_cr_pct,
       round(organic * 100, 3) AS organic_cr_pct,
       round((paid - organic) * 100, 3) AS paid_vs_organic_pp
FROM split""",
        """split AS (
  SELECT round(100.0 * count(*) FILTER (WHERE traffic_source = 'organic_search') / count(*), 2) AS share,
         avg(converted) FILTER (WHERE traffic_source = 'paid_search') AS paid,
         avg(converted) FILTER (WHERE traffic_source = 'organic_search') AS organic
  FROM sessions)""",
    ),
    "driver_product_quality": query("""
SELECT product_category, count(*) AS sessions, CAST(sum(converted) AS BIGINT) AS conversions,
       round(avg(converted) * 100, 4) AS cr_pct,
       round(avg(revenue) FILTER (WHERE converted = 1), 4) AS avg_order_value_inr
FROM sessions GROUP BY product_category"""),
    "driver_price": query("""
SELECT 'revenue_per_session' AS metric, CAST(NULL AS VARCHAR) AS key,
       round(avg(revenue), 4) AS value,
       CASE WHEN avg(revenue) >= 40 THEN '✅' ELSE '⚠️' END AS status
FROM sessions
UNION ALL
SELECT 'category_aov', product_category, round(avg(revenue), 4), NULL
FROM sessions WHERE converted = 1 GROUP BY product_category
UNION ALL
SELECT 'traffic_source_cr', traffic_source, round(avg(converted) * 100, 3), NULL
FROM sessions GROUP BY traffic_source"""),
    "funnel": query(
        """
SELECT steps_completed, n AS users_at_step,
       round(100.0 * n / sum(n) OVER (), 2) AS pct_of_sessions,
       round(100.0 * (n - lag(n) OVER w) / lag(n) OVER w, 2) AS pct_change_vs_prev_step
FROM depth WINDOW w AS (ORDER BY steps_completed)""",
        "depth AS (SELECT steps_completed, count(*) AS n FROM sessions GROUP BY steps_completed)",
    ),
    "return_visitor_cr": query(
        """
SELECT ret_n AS returning_sessions, new_n AS new_sessions,
       round(ret * 100, 3) AS returning_cr_pct,
       round(new * 100, 3) AS new_visitor_cr_pct,
       round((ret - new) * 100, 3) AS loyalty_lift_pp
FROM visitors""",
        _VISITORS,
    ),
    "returning_semi_anti": query(
        """
SELECT 'returning' AS visitor_type, count(*) AS sessions,
       CAST(coalesce(sum(converted), 0) AS BIGINT) AS conversions,
       round(avg(converted) * 100, 4) AS cr_pct
FROM sessions s WHERE EXISTS (SELECT 1 FROM again a WHERE a.user_id = s.user_id)
UNION ALL
SELECT 'new', count(*), CAST(coalesce(sum(converted), 0) AS BIGINT), round(avg(converted) * 100, 4)
FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.user_id = s.user_id)""",
        "again AS (SELECT user_id FROM sessions GROUP BY user_id HAVING count(*) > 1)",
    ),
}

_TREE_PARTS = [
    ("overall", "'North Star', 'overall_cr', '', round(cr * 100, 3), NULL"),
    ("days", "'North Star', 'avg_daily_cr', '', round(avg_cr * 100, 3), NULL"),
    ("days", "'North Star', 'cr_std', '', round(std_cr * 100, 4), NULL"),
    ("overall", "'North Star', 'total_sessions', '', n, NULL"),
    ("overall", "'North Star', 'total_conversions', '', c, NULL"),
    ("overall", "'North Star', 'total_revenue_inr', '', round(total, 2), NULL"),
    (
        "overall",
        "'Page Experience', 'page_load_speed', 'avg_ms', round(load, 4), CASE WHEN load > 2500 THEN '⚠️' ELSE '✅' END",
    ),
    (
        "overall",
        "'Page Experience', 'bounce_rate', 'pct', round(bounce * 100, 2), CASE WHEN bounce > 0.4 THEN '⚠️' ELSE '✅' END",
    ),
    ("tested", "'Page Experience', 'page_load_speed', 'correlation_with_cr', round(r, 4), NULL"),
    ("tested", f"'Page Experience', 'page_load_speed', 'p_value', round({student_p('t', 'df')}, 6), NULL"),
    ("overall", "'Page Experience', 'mobile_experience', 'mobile_cr', round(mobile * 100, 3), NULL"),
    ("overall", "'Page Experience', 'mobile_experience', 'desktop_cr', round(desktop * 100, 3), NULL"),
    (
        "overall",
        "'Page Experience', 'mobile_experience', 'gap_vs_desktop', round((desktop - mobile) * 100, 3), "
        "CASE WHEN desktop - mobile > 0.01 THEN '⚠️' ELSE '✅' END",
    ),
    (
        "overall",
        "'Price & Value', 'revenue_per_session', '', round(rps, 4), CASE WHEN rps >= 40 THEN '✅' ELSE '⚠️' END",
    ),
    (
        "sessions WHERE converted = 1 GROUP BY product_category",
        "'Price & Value', 'category_aov', product_category, round(avg(revenue), 4), NULL",
    ),
    (
        "sessions GROUP BY traffic_source",
        "'Price & Value', 'traffic_source_cr', traffic_source, round(avg(converted) * 100, 3), NULL",
    ),
    (
        "sessions GROUP BY traffic_source",
        "'Discovery', 'traffic_mix', traffic_source, round(100.0 * count(*) / (SELECT n FROM overall), 2), NULL",
    ),
    (
        "overall",
        "'Discovery', 'organic_share', '', round(organic_pct, 2), CASE WHEN round(organic_pct, 2) >= 25 THEN '✅' ELSE '⚠️' END",
    ),
    ("overall", "'Discovery', 'paid_efficiency', 'paid_cr', round(paid * 100, 3), NULL"),
    ("overall", "'Discovery', 'paid_efficiency', 'organic_cr', round(organic * 100, 3), NULL"),
    ("overall", "'Discovery', 'paid_efficiency', 'paid_vs_organic', round((paid - organic) * 100, 3), NULL"),
    (
        "sessions GROUP BY product_category",
        "'Product Quality', 'category_conversion_rates', product_category, round(avg(converted) * 100, 3), NULL",
    ),
    (
        "sessions GROUP BY steps_completed",
        "'Product Quality', 'funnel_steps_distribution', CAST(steps_completed AS VARCHAR), "
        "round(100.0 * count(*) / (SELECT n FROM overall), 2), NULL",
    ),
    ("visitors", "'Product Quality', 'return_visitor_cr', 'returning_cr', round(ret * 100, 3), NULL"),
    ("visitors", "'Product Quality', 'return_visitor_cr', 'new_visitor_cr', round(new * 100, 3), NULL"),
    ("visitors", "'Product Quality', 'return_visitor_cr', 'loyalty_lift', round((ret - new) * 100, 3), NULL"),
]

_OVERALL = """
overall AS (
  SELECT count(*) AS n, sum(converted) AS c, sum(revenue) AS total, avg(converted) AS cr,
         avg(page_load_ms) AS load, avg(bounced) AS bounce, avg(revenue) AS rps,
         avg(converted) FILTER (WHERE device = 'mobile') AS mobile,
         avg(converted) FILTER (WHERE device = 'desktop') AS desktop,
         avg(converted) FILTER (WHERE traffic_source = 'paid_search') AS paid,
         avg(converted) FILTER (WHERE traffic_source = 'organic_search') AS organic,
         100.0 * count(*) FILTER (WHERE traffic_source = 'organic_search') / count(*) AS organic_pct
  FROM sessions
)
"""

_DAYS = """
days AS (
  SELECT avg(cr) AS avg_cr, stddev_samp(cr) AS std_cr
  FROM (SELECT avg(converted) AS cr FROM sessions GROUP BY date)
)
"""

_TREE = (
    "SELECT driver, metric, key, CAST(value AS DOUBLE) AS value, status FROM (\n"
    + "\nUNION ALL\n".join(f"SELECT {items} FROM {source}" for source, items in _TREE_PARTS)
    + "\n) tree(driver, metric, key, value, status)"
)
SQL["metrics_tree"] = query(_TREE, _CORRELATION, _VISITORS, _OVERALL, _DAYS)

# How the document shows a metric: key in the tree, name in the document, format.
_SHOWN = [
    ("page_load_speed", "avg_ms", "value", "%.0fms avg"),
    ("bounce_rate", "pct", "value", "%.2f%%"),
    ("mobile_experience", "mobile_cr", "mobile_cr", "%.3f%%"),
    ("mobile_experience", "desktop_cr", "desktop_cr", "%.3f%%"),
    ("mobile_experience", "gap_vs_desktop", "gap_vs_desktop", "%.3fpp"),
    ("revenue_per_session", "", "value", "₹%.2f"),
    ("organic_share", "", "value", "%.1f%%"),
    ("paid_efficiency", "paid_cr", "paid_cr", "%.3f%%"),
    ("paid_efficiency", "organic_cr", "organic_cr", "%.3f%%"),
    ("paid_efficiency", "paid_vs_organic", "paid_vs_organic", "%+.3fpp"),
    ("return_visitor_cr", "returning_cr", "returning_cr", "%.3f%%"),
    ("return_visitor_cr", "new_visitor_cr", "new_visitor_cr", "%.3f%%"),
    ("return_visitor_cr", "loyalty_lift", "loyalty_lift", "%+.3fpp"),
]
_BENCHMARKS = {
    "page_load_speed": "< 2500ms",
    "bounce_rate": "< 40%",
    "revenue_per_session": "> ₹40",
    "organic_share": "> 25%",
}
_SIGN = "CASE WHEN {0} THEN '✅ Healthy' WHEN NOT {0} THEN '⚠️ At Risk' END"
_HEALTH = [
    ("page_load_speed", "avg_ms", _SIGN.format("status = '✅'")),
    ("revenue_per_session", "", _SIGN.format("status = '✅'")),
    ("organic_share", "", _SIGN.format("status = '✅'")),
    ("return_visitor_cr", "loyalty_lift", _SIGN.format("value > 0")),
]
_BRANCH = "'level1_drivers.' || driver || '"


def _where(metric: str, key: str) -> str:
    return f"FROM tree WHERE metric = '{metric}' AND key = '{key}'"


SQL["metrics_tree_document"] = query(
    "SELECT path, CAST(text AS VARCHAR) AS text, CAST(number AS DOUBLE) AS number FROM (\n"
    + "\nUNION ALL\n".join(
        [
            "SELECT 'north_star.north_star_metric' AS path, 'Conversion Rate' AS text, NULL AS number",
            "SELECT 'north_star.' || metric, NULL, value FROM tree WHERE driver = 'North Star'",
            f"SELECT DISTINCT {_BRANCH}.driver', driver, NULL FROM tree WHERE driver <> 'North Star'",
            f"""SELECT {_BRANCH}.level2.' || metric || '.' || key, NULL, value FROM tree
WHERE metric IN ('category_aov', 'traffic_source_cr', 'traffic_mix', 'category_conversion_rates', 'funnel_steps_distribution')
   OR key IN ('correlation_with_cr', 'p_value')""",
            f"SELECT {_BRANCH}.level2.' || metric || '.status', status, NULL FROM tree WHERE status IS NOT NULL",
        ]
        + [f"SELECT {_BRANCH}.level2.{m}.{name}', printf('{form}', value), NULL {_where(m, k)}" for m, k, name, form in _SHOWN]
        + [f"SELECT DISTINCT {_BRANCH}.level2.{m}.benchmark', '{b}', NULL FROM tree WHERE metric = '{m}'" for m, b in _BENCHMARKS.items()]
        + [f"SELECT {_BRANCH}.health', {health}, NULL {_where(m, k)}" for m, k, health in _HEALTH]
    )
    + "\n) fields(path, text, number) WHERE text IS NOT NULL OR number IS NOT NULL",
    _CORRELATION,
    _VISITORS,
    _OVERALL,
    _DAYS,
    f"tree AS ({_TREE})",
)

SQL["north_star_report"] = query(
    """
SELECT * FROM (
  SELECT 1 AS ord, 'North Star Metric' AS section, 'Overall Conversion Rate' AS metric,
         printf('%.3f%%', round(cr * 100, 3)) AS value, NULL AS benchmark, NULL AS health FROM overall
  UNION ALL SELECT 2, 'North Star Metric', 'Avg Daily Conv. Rate', printf('%.3f%%', round(avg_cr * 100, 3)), NULL, NULL FROM days
  UNION ALL SELECT 3, 'North Star Metric', 'Daily CR Std Dev', printf('%.4f%%', round(std_cr * 100, 4)), NULL, NULL FROM days
  UNION ALL SELECT 4, 'North Star Metric', 'Total Sessions', format('{:,}', n), NULL, NULL FROM overall
  UNION ALL SELECT 5, 'North Star Metric', 'Total Conversions', format('{:,}', CAST(c AS BIGINT)), NULL, NULL FROM overall
  UNION ALL SELECT 6, 'North Star Metric', 'Total Revenue', printf('₹%.2fM', round(total, 2) / 1e6), NULL, NULL FROM overall
  UNION ALL SELECT 7, 'Page Experience', 'Avg Page Load', printf('%.0fms', round(load, 4)), '< 2500ms',
                   CASE WHEN load > 2500 THEN '⚠️ At Risk' ELSE '✅ Healthy' END FROM overall
  UNION ALL SELECT 8, 'Price & Value', 'Revenue/Session', printf('₹%.2f', round(rps, 4)), '> ₹40',
                   CASE WHEN rps >= 40 THEN '✅ Healthy' ELSE '⚠️ At Risk' END FROM overall
  UNION ALL SELECT 9, 'Discovery', 'Organic Share', printf('%.1f%%', round(organic_pct, 2)), '> 25%',
                   CASE WHEN round(organic_pct, 2) >= 25 THEN '✅ Healthy' ELSE '⚠️ At Risk' END FROM overall
  UNION ALL SELECT 10, 'Product Quality', 'Return Visitor Lift', printf('%+.3fpp', round((ret - new) * 100, 3)), '> 0pp',
                   CASE WHEN round((ret - new) * 100, 3) > 0 THEN '✅ Healthy' ELSE '⚠️ At Risk' END FROM visitors
)""",
    _OVERALL,
    _DAYS,
    _VISITORS,
)
