"""The sessions view over `events`, and numeric p values, as SQL text."""

from __future__ import annotations

SESSIONS = """
raw_events AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (event_id * 37) % 100 AS h
  FROM events
),
sessions AS (
  SELECT 'S' || repeat('0', greatest(8 - length(CAST(event_id AS VARCHAR)), 0)) || CAST(event_id AS VARCHAR) AS session_id,
         'U' || repeat('0', greatest(7 - length(CAST(user_id * 40 + event_id % 40 AS VARCHAR)), 0))
             || CAST(user_id * 40 + event_id % 40 AS VARCHAR) AS user_id,
         ts AS "timestamp",
         CASE WHEN k < 62 THEN 'mobile' WHEN k < 92 THEN 'desktop' ELSE 'tablet' END AS device,
         'CITY_' || CAST(user_id % 10 AS VARCHAR) AS location,
         CASE WHEN h < 30 THEN 'organic_search' WHEN h < 52 THEN 'paid_search'
              WHEN h < 70 THEN 'social' WHEN h < 82 THEN 'email'
              WHEN h < 92 THEN 'direct' ELSE 'referral' END AS traffic_source,
         'CAT_' || CAST((event_id * 7 + user_id) % 6 AS VARCHAR) AS product_category,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
              WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 END AS steps_completed,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue,
         400 + 30 * value AS page_load_ms,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS bounced,
         CAST(ts AS DATE) AS date,
         CAST(hour(ts) AS INTEGER) AS hour
  FROM raw_events
)
"""

INTERVALS = 2000


def query(body: str, *ctes: str) -> str:
    """`body` behind the sessions view and any further common table expressions."""
    return "WITH " + ",\n".join([SESSIONS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def _simpson(density: str, upper: str) -> str:
    """Integral of `density` (in terms of `x`) from 0 to `upper`."""
    step = f"({upper} / {INTERVALS}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {INTERVALS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    point = density.format(x=f"(i * {step})")
    return f"({step} / 3.0 * list_sum([{weight} * {point} for i in range(0, {INTERVALS + 1})]))"


def normal_p(stat: str) -> str:
    density = "exp(-{x} * {x} / 2.0) / sqrt(2.0 * pi())"
    return f"(1.0 - 2.0 * {_simpson(density, f'abs({stat})')})"


def student_p(stat: str, df: str) -> str:
    scale = f"(exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()))"
    density = f"power(1.0 + {{x}} * {{x}} / {df}, -({df} + 1) / 2.0)"
    return f"(1.0 - 2.0 * {scale} * {_simpson(density, f'abs({stat})')})"


# All columns of a session, the calendar included.
ALL_COLUMNS = """session_id, user_id, "timestamp", device, location, traffic_source, product_category, steps_completed,
       converted, revenue, page_load_ms, bounced, date,
       strftime(date_trunc('week', date), '%Y-%m-%d') || '/' ||
       strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
       strftime(date, '%Y-%m') AS month, hour"""
