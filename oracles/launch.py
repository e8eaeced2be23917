"""Feature launch on 2024-01-21 of the test calendar."""

from __future__ import annotations

from oracles.base import ALL_COLUMNS, normal_p, query, student_p

_RANGE = """
ranged AS (
  SELECT *, date < DATE '2024-01-21' AS before
  FROM sessions
  WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
    AND NOT (date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12')
)
"""

_SPLIT = """
split AS (
  SELECT *, CASE WHEN date < DATE '2024-01-21' THEN 'pre_launch' ELSE 'post_launch' END AS period
  FROM sessions
  WHERE (date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'
         AND date NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-13')
     OR date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'
)
"""

_STATS = """
sides AS (
  SELECT period, CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(converted) AS DOUBLE) AS c, CAST(sum(bounced) AS DOUBLE) AS b,
         avg(page_load_ms) AS lm, var_samp(page_load_ms) AS lv,
         avg(revenue) AS rm, var_samp(revenue) AS rv
  FROM split GROUP BY period
),
pair AS (
  SELECT p.n AS n1, q.n AS n2, p.c AS c1, q.c AS c2, p.b AS b1, q.b AS b2,
         p.lm AS lm1, q.lm AS lm2, p.lv / p.n AS la, q.lv / q.n AS lb,
         p.rm AS rm1, q.rm AS rm2, p.rv / p.n AS ra, q.rv / q.n AS rb,
         p.c / p.n AS cr1, q.c / q.n AS cr2, p.b / p.n AS br1, q.b / q.n AS br2,
         (p.c + q.c) / (p.n + q.n) AS pooled_c, (p.b + q.b) / (p.n + q.n) AS pooled_b
  FROM sides p JOIN sides q ON p.period = 'pre_launch' AND q.period = 'post_launch'
),
stats AS (
  SELECT *,
    (cr1 - cr2) / sqrt(pooled_c * (1 - pooled_c) * (1 / n1 + 1 / n2)) AS zc,
    (br1 - br2) / sqrt(pooled_b * (1 - pooled_b) * (1 / n1 + 1 / n2)) AS zb,
    (lm1 - lm2) / sqrt(la + lb) AS tl,
    (la + lb) * (la + lb) / (la * la / (n1 - 1) + lb * lb / (n2 - 1)) AS dl,
    (rm1 - rm2) / sqrt(ra + rb) AS tr,
    (ra + rb) * (ra + rb) / (ra * ra / (n1 - 1) + rb * rb / (n2 - 1)) AS dr,
    sqrt(cr1 * (1 - cr1) / n1 + cr2 * (1 - cr2) / n2) AS se_c
  FROM pair
)
"""

_TESTED = (
    "tested AS (SELECT *, "
    + ", ".join(
        [
            f"{normal_p('zc')} AS pc",
            f"{normal_p('zb')} AS pb",
            f"{student_p('tl', 'dl')} AS pl",
            f"{student_p('tr', 'dr')} AS pr",
            "lm2 <= lm1 AS load_ok",
            "br2 <= br1 AS bounce_ok",
            "rm2 >= rm1 AS rev_ok",
        ]
    )
    + " FROM stats)"
)

_GUARDRAILS = """
guardrails AS (
  SELECT 'Page Load Time (ms)' AS metric, 'lower' AS direction_good,
         round(lm1, 4) AS pre_value, round(lm2, 4) AS post_value, round(lm2 - lm1, 4) AS absolute_change,
         round((lm2 - lm1) / lm1 * 100, 2) AS relative_change_pct,
         round(lm2 - lm1 - 1.96 * sqrt(la + lb), 4) AS ci_95_low,
         round(lm2 - lm1 + 1.96 * sqrt(la + lb), 4) AS ci_95_high,
         pl AS p, load_ok AS passed,
         CASE WHEN load_ok THEN '✅ PASSED — Load time improved' ELSE '⚠️ FAILED — Load time degraded' END AS verdict
  FROM tested
  UNION ALL
  SELECT 'Bounce Rate', 'lower', round(br1 * 100, 3), round(br2 * 100, 3), round((br2 - br1) * 100, 3),
         round((br2 - br1) / br1 * 100, 2), NULL, NULL, pb, bounce_ok,
         CASE WHEN bounce_ok THEN '✅ PASSED — Bounce rate held/improved' ELSE '⚠️ FAILED — Bounce rate increased' END
  FROM tested
  UNION ALL
  SELECT 'Revenue Per Session (₹)', 'higher', round(rm1, 4), round(rm2, 4), round(rm2 - rm1, 4),
         round((rm2 - rm1) / rm1 * 100, 2),
         round(rm2 - rm1 - 1.96 * sqrt(ra + rb), 4), round(rm2 - rm1 + 1.96 * sqrt(ra + rb), 4), pr, rev_ok,
         CASE WHEN rev_ok THEN '✅ PASSED — Revenue per session improved' ELSE '⚠️ FAILED — Revenue per session dropped' END
  FROM tested
)
"""

_EFFECTS = """
effects AS (
  SELECT 'Device: ' || device AS segment, 100 AS gate,
         avg(converted) FILTER (WHERE period = 'pre_launch') AS pre,
         avg(converted) FILTER (WHERE period = 'post_launch') AS post,
         count(*) FILTER (WHERE period = 'pre_launch') AS n1,
         count(*) FILTER (WHERE period = 'post_launch') AS n2
  FROM split WHERE device IN ('mobile', 'desktop', 'tablet') GROUP BY device
  UNION ALL
  SELECT 'Source: ' || traffic_source, 500,
         avg(converted) FILTER (WHERE period = 'pre_launch'),
         avg(converted) FILTER (WHERE period = 'post_launch'),
         count(*) FILTER (WHERE period = 'pre_launch'),
         count(*) FILTER (WHERE period = 'post_launch')
  FROM split GROUP BY traffic_source
),
judged AS (
  SELECT segment, round(pre * 100, 4) AS pre_cr, round(post * 100, 4) AS post_cr,
         round((post - pre) / nullif(pre, 0) * 100, 2) AS lift_pct,
         CASE WHEN (post - pre) / nullif(pre, 0) < -0.05 THEN '⚠️ Regression on segment' ELSE '✅ OK' END AS concern
  FROM effects WHERE n1 >= gate AND n2 >= gate
)
"""

_RECOMMENDATION = """
CASE WHEN pc < 0.05 AND cr2 > cr1 AND load_ok AND bounce_ok AND rev_ok THEN '🚀 SHIP IT — Full rollout recommended'
     WHEN pc < 0.05 AND cr2 > cr1 THEN '⚠️ CONDITIONAL SHIP — Fix guardrail issues before full rollout'
     ELSE '🛑 DO NOT SHIP — No significant improvement detected' END
"""

SQL = {
    "launch_pre_post": query(
        """
SELECT CASE WHEN before THEN 'pre_launch' ELSE 'post_launch' END AS period, count(*) AS sessions,
       CAST(sum(converted) AS BIGINT) AS conversions, round(avg(converted) * 100, 4) AS cr_pct,
       round(avg(revenue), 4) AS revenue_per_session_inr, round(avg(page_load_ms), 4) AS avg_load_ms,
       round(avg(bounced) * 100, 3) AS bounce_rate_pct
FROM ranged GROUP BY before""",
        _RANGE,
    ),
    "launch_weekly": query(
        """
SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, count(*) AS sessions,
       round(avg(converted) * 100, 4) AS cr_pct, round(avg(revenue), 4) AS rps_inr,
       round(avg(page_load_ms), 4) AS avg_load_ms,
       CASE WHEN date_trunc('week', date) < DATE '2024-01-18' THEN 'pre_launch' ELSE 'post_launch' END AS period
FROM ranged GROUP BY date_trunc('week', date)""",
        _RANGE,
    ),
    "launch_device": query(
        """
SELECT device, round(avg(converted) FILTER (WHERE before) * 100, 4) AS pre_cr_pct,
       round(avg(converted) FILTER (WHERE NOT before) * 100, 4) AS post_cr_pct,
       round((avg(converted) FILTER (WHERE NOT before) - avg(converted) FILTER (WHERE before)) * 100, 4) AS lift_pp
FROM ranged GROUP BY device""",
        _RANGE,
    ),
    "launch_split": query(
        f"SELECT {ALL_COLUMNS}, period FROM split",
        _SPLIT,
    ),
    "launch_primary": query(
        """
SELECT 'Conversion Rate' AS metric, 'primary' AS type,
       round(cr1 * 100, 4) AS pre_value, round(cr2 * 100, 4) AS post_value,
       round((cr2 - cr1) * 100, 4) AS absolute_change_pp,
       round((cr2 - cr1) / cr1 * 100, 2) AS relative_lift_pct,
       round((cr2 - cr1 - 1.96 * se_c) * 100, 4) AS ci_95_low_pp,
       round((cr2 - cr1 + 1.96 * se_c) * 100, 4) AS ci_95_high_pp,
       round(zc, 4) AS z_statistic, round(pc, 8) AS p_value, pc < 0.05 AS is_significant,
       CAST(n1 AS BIGINT) AS pre_sessions, CAST(n2 AS BIGINT) AS post_sessions,
       CASE WHEN pc < 0.05 AND cr2 > cr1 THEN 'SIGNIFICANT IMPROVEMENT ✅'
            WHEN pc < 0.05 THEN 'SIGNIFICANT REGRESSION ⚠️'
            ELSE 'NOT SIGNIFICANT — needs more data 🔄' END AS verdict
FROM tested""",
        _SPLIT,
        _STATS,
        _TESTED,
    ),
    "launch_guardrails": query(
        """
SELECT metric, 'guardrail' AS type, direction_good, pre_value, post_value, absolute_change,
       relative_change_pct, ci_95_low, ci_95_high, round(p, 6) AS p_value, p < 0.05 AS is_significant,
       passed, verdict
FROM guardrails""",
        _SPLIT,
        _STATS,
        _TESTED,
        _GUARDRAILS,
    ),
    "launch_recommendation": query(
        f"""
SELECT pc < 0.05 AND cr2 > cr1 AS primary_significant,
       CAST(load_ok AS INTEGER) + CAST(bounce_ok AS INTEGER) + CAST(rev_ok AS INTEGER) AS guardrails_passed,
       load_ok AND bounce_ok AND rev_ok AS all_guardrails_pass,
       {_RECOMMENDATION} AS recommendation
FROM tested""",
        _SPLIT,
        _STATS,
        _TESTED,
    ),
    "launch_side_effects": query("SELECT * FROM judged", _SPLIT, _EFFECTS),
    "launch_report": query(
        f"""
SELECT 'Recommendation' AS section, 'Recommendation' AS metric, {_RECOMMENDATION} AS value,
       CAST(NULL AS VARCHAR) AS verdict
FROM tested
UNION ALL SELECT 'Primary metric', 'Pre-launch CR', printf('%.4f%%', round(cr1 * 100, 4)), NULL FROM tested
UNION ALL SELECT 'Primary metric', 'Post-launch CR', printf('%.4f%%', round(cr2 * 100, 4)), NULL FROM tested
UNION ALL SELECT 'Primary metric', 'Absolute change', printf('%+.4fpp', round((cr2 - cr1) * 100, 4)), NULL FROM tested
UNION ALL SELECT 'Primary metric', 'Relative lift', printf('%+.2f%%', round((cr2 - cr1) / cr1 * 100, 2)), NULL FROM tested
UNION ALL SELECT 'Primary metric', '95% CI',
                 printf('[%+.4fpp, %+.4fpp]', round((cr2 - cr1 - 1.96 * se_c) * 100, 4),
                        round((cr2 - cr1 + 1.96 * se_c) * 100, 4)), NULL FROM tested
UNION ALL SELECT 'Primary metric', 'Z statistic', printf('%.4f', round(zc, 4)), NULL FROM tested
UNION ALL SELECT 'Primary metric', 'P value', printf('%.8f', round(pc, 8)), NULL FROM tested
UNION ALL SELECT 'Guardrails', metric, printf('%.4f -> %.4f (%+.2f%%)', pre_value, post_value, relative_change_pct),
                 verdict FROM guardrails
UNION ALL SELECT 'Side effects', segment, printf('%+.2f%%', lift_pct), concern FROM judged""",
        _SPLIT,
        _STATS,
        _TESTED,
        _GUARDRAILS,
        _EFFECTS,
    ),
}
