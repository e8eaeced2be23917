"""Calendar, sample, summary, invariants and cohorts."""

from __future__ import annotations

from oracles.base import ALL_COLUMNS, query

_FIRST = "firsts AS (SELECT user_id, min(date) AS first_date FROM sessions GROUP BY user_id)"

SQL = {
    "session_calendar": query("""
SELECT session_id, "timestamp", date,
       strftime(date_trunc('week', date), '%Y-%m-%d') || '/' ||
       strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
       strftime(date, '%Y-%m') AS month, hour
FROM sessions"""),
    "sample_sessions": query(f"""
SELECT {ALL_COLUMNS}
FROM sessions ORDER BY md5('42:' || session_id), session_id LIMIT 2500"""),
    "dataset_summary": query("""
SELECT count(*) AS total_sessions, min(date) AS first_date, max(date) AS last_date,
       round(avg(converted) * 100, 2) AS overall_cr_pct, round(sum(revenue), 2) AS total_revenue,
       count(DISTINCT user_id) AS unique_users, round(avg(page_load_ms), 4) AS avg_page_load_ms
FROM sessions"""),
    "session_invariants": query("""
SELECT 'bounced_iff_first_step' AS rule,
       count(*) FILTER (WHERE (bounced = 1) <> (steps_completed = 1)) AS violations, count(*) AS rows_checked FROM sessions
UNION ALL SELECT 'revenue_only_if_converted', count(*) FILTER (WHERE converted <> 1 AND revenue <> 0), count(*) FROM sessions
UNION ALL SELECT 'converted_only_from_step_4', count(*) FILTER (WHERE converted = 1 AND steps_completed < 4), count(*) FROM sessions
UNION ALL SELECT 'page_load_positive', count(*) FILTER (WHERE page_load_ms <= 0), count(*) FROM sessions
UNION ALL SELECT 'steps_between_1_and_5', count(*) FILTER (WHERE steps_completed NOT BETWEEN 1 AND 5), count(*) FROM sessions"""),
    "cohort_retention": query(
        """
SELECT first_date AS cohort_date, count(DISTINCT user_id) AS cohort_size,
       count(DISTINCT user_id) FILTER (WHERE date > first_date) AS returned_users,
       round(100.0 * count(DISTINCT user_id) FILTER (WHERE date > first_date) / count(DISTINCT user_id), 2)
         AS retention_rate_pct
FROM sessions JOIN firsts USING (user_id)
GROUP BY first_date HAVING count(DISTINCT user_id) >= 100
ORDER BY first_date LIMIT 20""",
        _FIRST,
    ),
    "cohort_days_since_first": query(
        """
SELECT session_id, user_id, first_date, date AS session_date,
       CAST(date_diff('day', first_date, date) AS INTEGER) AS days_since_first
FROM sessions JOIN firsts USING (user_id)""",
        _FIRST,
    ),
}
