"""User features, scaling, profiles and persona names."""

from __future__ import annotations

from oracles.base import query

_USERS = """
device_counts AS (SELECT user_id, device, count(*) AS n FROM sessions GROUP BY user_id, device),
favourites AS (
  SELECT user_id, device, n FROM device_counts
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, device) = 1
),
users AS (
  SELECT s.user_id, count(*) AS total_sessions, CAST(sum(converted) AS BIGINT) AS total_conversions,
         sum(revenue) AS total_revenue, avg(steps_completed) AS avg_steps, avg(page_load_ms) AS avg_page_load_ms,
         count(DISTINCT date) AS days_active, sum(converted) / count(*) AS conversion_rate,
         sum(revenue) / count(*) AS revenue_per_session, any_value(f.device) AS primary_device
  FROM sessions s JOIN favourites f ON f.user_id = s.user_id
  GROUP BY s.user_id
)
"""

_LABELLED = """
labelled AS (
  SELECT *, CASE WHEN revenue_per_session > 60 THEN 4
                 WHEN total_conversions = 0 AND total_sessions = 1 THEN 0
                 WHEN total_conversions = 0 THEN 1
                 WHEN total_sessions <= 3 THEN 2
                 ELSE 3 END AS segment_id
  FROM users
),
profile AS (
  SELECT segment_id, count(*) AS n, avg(total_sessions) AS visits, avg(conversion_rate) AS cr,
         avg(revenue_per_session) AS revenue, avg(days_active) AS days
  FROM labelled GROUP BY segment_id
)
"""

_PROFILE_COLUMNS = (
    'segment_id, n AS "count", round(visits, 6) AS avg_sessions, round(cr, 6) AS avg_cr, '
    "round(revenue, 6) AS avg_revenue, round(days, 6) AS avg_days_active"
)

_SCALED = ", ".join(
    f"round((CAST({x} AS DOUBLE) - avg(CAST({x} AS DOUBLE)) OVER ()) / stddev_pop(CAST({x} AS DOUBLE)) OVER (), 6) AS {name}"
    for name, x in {
        "total_sessions": "total_sessions",
        "conversion_rate": "conversion_rate",
        "revenue_per_session": "revenue_per_session",
        "avg_steps": "avg_steps",
        "days_active": "days_active",
        "device_mobile": "(CASE WHEN primary_device = 'mobile' THEN 1 ELSE 0 END)",
        "device_desktop": "(CASE WHEN primary_device = 'desktop' THEN 1 ELSE 0 END)",
    }.items()
)

# The draws of the k-means++ starts.
_PRIME, _MULTIPLIER, _STEPS = 2147483647, 48271, 64
_NAMES = (
    "total_sessions",
    "conversion_rate",
    "revenue_per_session",
    "avg_steps",
    "days_active",
    "device_mobile",
    "device_desktop",
)
_INPUTS = [*_NAMES[:5], "CAST(primary_device = 'mobile' AS INTEGER)", "CAST(primary_device = 'desktop' AS INTEGER)"]


def _lloyd(name: str, start: str, points: str, tolerance: str) -> str:
    """Centres of every (k, start) pair moved to the means of their points until they stay."""
    nearest = f"""
      SELECT k, start, x, w, list_position(apart, list_min(apart)) AS j, list_min(apart) AS d FROM (
        SELECT l.k, l.start, p.x, p.w, list_transform(l.centres, lambda c: round(pow(list_distance(c, p.x), 2), 9)) AS apart
        FROM {name} l, {points} p WHERE l.moved)"""
    means = ", ".join(f"sum(w * x[{i}]) / sum(w)" for i in range(1, len(_NAMES) + 1))
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT k, start, iter + 1, CASE WHEN far > {tolerance} THEN new ELSE old END, far > {tolerance}, cost FROM (
    SELECT l.k, l.start, any_value(l.iter) AS iter, list(coalesce(m.mean, l.centres[g.j]) ORDER BY g.j) AS new,
           any_value(l.centres) AS old, max(list_distance(coalesce(m.mean, l.centres[g.j]), l.centres[g.j])) AS far,
           sum(m.cost) AS cost
    FROM {name} l JOIN range(1, 65) g(j) ON g.j <= len(l.centres)
    LEFT JOIN (SELECT k, start, j, [{means}] AS mean, sum(w * d) AS cost FROM ({nearest}) GROUP BY k, start, j) m
      ON m.k = l.k AND m.start = l.start AND m.j = g.j
    WHERE l.moved AND l.iter < 301
    GROUP BY l.k, l.start)
)"""


def _clustering(ks: list[int], starts: int = 10, seed: int = 42) -> list[str]:
    """Points, seeded starts, their descent, and `model`: a row of numbered centres for each k."""
    scaled = ", ".join(f"(f{i} - m{i}) / (CASE WHEN s{i} > 0 THEN s{i} ELSE 1.0 END)" for i in range(len(_INPUTS)))
    factors = ", ".join(
        f"({s}, {t}, {pow(_MULTIPLIER, 1 + _STEPS * s + t, _PRIME)})" for s in range(starts) for t in range(max(ks))
    )
    first = f"""SELECT k, start, 0 AS iter, centres[1:k] AS centres, true AS moved, CAST(NULL AS DOUBLE) AS cost
  FROM seeds, (SELECT unnest({ks}) AS k) WHERE step = {max(ks)}"""
    winners = """SELECT k, 0 AS start, 0 AS iter, centres, true AS moved, CAST(NULL AS DOUBLE) AS cost
  FROM race WHERE NOT moved QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(cost, 6), start) = 1"""
    return [
        "inputs AS (SELECT *, "
        + ", ".join(f"round(coalesce(CAST({e} AS DOUBLE), 0), 9) AS f{i}" for i, e in enumerate(_INPUTS))
        + " FROM users)",
        "scales AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(len(_INPUTS))) + " FROM inputs)",
        f"vectors AS MATERIALIZED (SELECT inputs.*, [{scaled}] AS x FROM inputs, scales)",
        f"""
points AS MATERIALIZED (
  SELECT x, count(*) AS w, min(user_id) AS first,
         1 + CAST('0x' || substr(md5('{seed}:' || min(user_id)), 1, 12) AS BIGINT) % ({_PRIME} - 1) AS draw
  FROM vectors GROUP BY x
)""",
        f"factors AS (SELECT * FROM (VALUES {factors}) t(start, step, a))",
        f"""
seeds AS (
  SELECT start, CAST(0 AS INTEGER) AS step, CAST([] AS DOUBLE[][]) AS centres FROM range({starts}) r(start)
  UNION ALL
  SELECT start, step + 1, list_append(any_value(centres), arg_min(x, {{'score': -ln(u) / (w * d), 'first': first}})) FROM (
    SELECT s.start, s.step, s.centres, p.x, p.w, p.first, CAST((p.draw * f.a) % {_PRIME} AS DOUBLE) / {_PRIME} AS u,
           CASE WHEN s.step = 0 THEN 1.0
                ELSE list_min(list_transform(s.centres, lambda c: round(pow(list_distance(c, p.x), 2), 9))) END AS d
    FROM seeds s JOIN factors f ON f.start = s.start AND f.step = s.step, points p)
  WHERE d > 0 GROUP BY start, step
)""",
        _lloyd("race", first, "points", "1e-4"),
        _lloyd("settled", winners, "points", "1e-9"),
        """
centres AS (
  SELECT k, cost, centre, row_number() OVER (PARTITION BY k ORDER BY round(centre[2], 6), round(centre[1], 6)) - 1 AS segment_id
  FROM (SELECT k, cost, unnest(centres) AS centre FROM settled WHERE NOT moved)
)""",
        "model AS MATERIALIZED (SELECT k, any_value(cost) AS cost, list(centre ORDER BY segment_id) AS centres FROM centres GROUP BY k)",
        """
placed AS MATERIALIZED (
  SELECT k, x, w, list_position(apart, list_min(apart)) - 1 AS segment_id
  FROM (SELECT m.k, p.x, p.w, list_transform(m.centres, lambda c: round(pow(list_distance(c, p.x), 2), 9)) AS apart FROM model m, points p)
)""",
        # Mean squared distances between all pairs of users.
        """
apart AS (
  SELECT p.k, p.x, p.w, p.segment_id, q.segment_id AS other,
         sum(q.w * pow(list_distance(p.x, q.x), 2)) / nullif(sum(q.w) - max(CAST(p.segment_id = q.segment_id AS INTEGER)), 0) AS d
  FROM placed p JOIN placed q ON q.k = p.k GROUP BY p.k, p.x, p.w, p.segment_id, q.segment_id
),
silhouettes AS (
  SELECT k, segment_id, w, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM (
    SELECT k, x, w, segment_id, max(d) FILTER (other = segment_id) AS a, min(d) FILTER (other <> segment_id) AS b
    FROM apart GROUP BY k, x, w, segment_id)
  WHERE b IS NOT NULL
)""",
    ]


_FITTED = """
labelled AS MATERIALIZED (
  SELECT *, list_position(distances, list_min(distances)) - 1 AS segment_id FROM (
    SELECT v.*, m.centres, list_transform(m.centres, lambda c: round(pow(list_distance(c, v.x), 2), 9)) AS distances FROM vectors v, model m)
),
profile AS (
  SELECT segment_id, count(*) AS n, avg(total_sessions) AS visits, avg(conversion_rate) AS cr,
         avg(revenue_per_session) AS revenue, avg(days_active) AS days
  FROM labelled GROUP BY segment_id
),
named AS (
  SELECT *, CASE WHEN cr > 0.06 AND revenue > 60 THEN 'High-Value Loyal Buyers'
                 WHEN cr > 0.03 AND visits > 3 THEN 'Engaged Regular Shoppers'
                 WHEN cr < 0.01 AND visits < 2 THEN 'One-Time Browsers'
                 ELSE 'Window Shoppers (Retargetable)' END AS segment_name
  FROM profile
)
"""

_COORDINATES = ", ".join(
    f"round(x[{i}], 5) AS x_{name}, round(centres[l.segment_id + 1][{i}], 5) AS centre_{name}" for i, name in enumerate(_NAMES, 1)
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "user_segments": recursive(query(
        f"""
SELECT user_id, CAST(l.segment_id AS INTEGER) AS segment_id, segment_name, total_sessions,
       round(conversion_rate, 5) AS conversion_rate, round(revenue_per_session, 5) AS revenue_per_session, days_active,
       {_COORDINATES}, round(list_min(distances), 5) AS squared_distance
FROM labelled l JOIN named n ON n.segment_id = l.segment_id""",
        _USERS, *_clustering([4])[:-2], _FITTED,
    )),
    "user_segment_profile": recursive(query(
        """
SELECT CAST(n.segment_id AS INTEGER) AS segment_id, n AS "count", round(visits, 5) AS avg_sessions, round(cr, 5) AS avg_cr,
       round(revenue, 5) AS avg_revenue, round(days, 5) AS avg_days_active, segment_name,
       round(s.own, 5) AS segment_silhouette, round(t.mean, 5) AS silhouette
FROM named n
JOIN (SELECT segment_id, sum(w * s) / sum(w) AS own FROM silhouettes GROUP BY segment_id) s ON s.segment_id = n.segment_id,
(SELECT sum(w * s) / sum(w) AS mean FROM silhouettes) t""",
        _USERS, *_clustering([4]), _FITTED,
    )),
    "optimal_k": recursive(query(
        """
SELECT CAST(k AS INTEGER) AS k, round(cost, 4) AS cost, round(mean, 4) AS silhouette,
       row_number() OVER (ORDER BY round(mean, 6) DESC, k) = 1 AS recommended
FROM model JOIN (SELECT k, sum(w * s) / sum(w) AS mean FROM silhouettes GROUP BY k) scores USING (k)""",
        _USERS, *_clustering([2, 3, 4, 5, 6, 7]),
    )),
    "primary_device": query(
        "SELECT user_id, device AS primary_device, n AS device_sessions FROM favourites", _USERS
    ),
    "user_features": query(
        """
SELECT user_id, total_sessions, total_conversions, round(total_revenue, 2) AS total_revenue,
       round(avg_steps, 6) AS avg_steps, round(avg_page_load_ms, 6) AS avg_page_load_ms, days_active,
       round(conversion_rate, 6) AS conversion_rate, round(revenue_per_session, 6) AS revenue_per_session,
       primary_device,
       CAST(primary_device = 'mobile' AS INTEGER) AS device_mobile,
       CAST(primary_device = 'desktop' AS INTEGER) AS device_desktop,
       CAST(primary_device = 'tablet' AS INTEGER) AS device_tablet
FROM users""",
        _USERS,
    ),
    "scaled_features": query(f"SELECT user_id, {_SCALED} FROM users", _USERS),
    "segment_profile": query(f"SELECT {_PROFILE_COLUMNS} FROM profile", _USERS, _LABELLED),
    "persona_rules": query(
        f"""
SELECT {_PROFILE_COLUMNS},
       CASE WHEN cr > 0.06 AND revenue > 60 THEN 'High-Value Loyal Buyers'
            WHEN cr > 0.03 AND visits > 3 THEN 'Engaged Regular Shoppers'
            WHEN cr < 0.01 AND visits < 2 THEN 'One-Time Browsers'
            ELSE 'Window Shoppers (Retargetable)' END AS segment_name
FROM profile""",
        _USERS,
        _LABELLED,
    ),
}
