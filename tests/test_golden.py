"""Published result values, rebuilt from the daily totals behind them."""

from __future__ import annotations

import pytest

from builders import sessions_per_day
from sessionscope.operators import anomaly, diagnosis, segments

# Day, sessions, conversion rate, revenue.
APRIL = [
    ("2024-04-22", 10134, 0.007203, 85315.60),
    ("2024-04-23", 10075, 0.006253, 87201.90),
    ("2024-04-24", 10304, 0.006017, 72458.28),
    ("2024-04-25", 10042, 0.006672, 83362.32),
    ("2024-04-26", 10118, 0.006325, 76900.89),
    ("2024-04-27", 13178, 0.006374, 115768.16),
    ("2024-04-28", 13198, 0.008941, 149523.12),
]
DROP = [
    ("2024-04-10", 10160, 0.005807, 69733.86),
    ("2024-04-11", 10185, 0.004909, 66833.13),
    ("2024-04-12", 10195, 0.007160, 93635.75),
]


def days(table):
    return [(day, n, round(rate * n), revenue) for day, n, rate, revenue in table]


@pytest.fixture(scope="module")
def april(spark):
    return sessions_per_day(spark, days(APRIL)).cache()


def test_inclusive_scores_of_the_spike_day(april):
    events = anomaly.anomaly_events_inclusive(april).collect()
    assert len(events) == 1
    event = events[0]
    assert str(event.date) == "2024-04-28"
    assert event.conversion_rate == pytest.approx(0.008941)
    assert event.cr_zscore == pytest.approx(2.101, abs=5e-4)
    assert event.rps_zscore == pytest.approx(2.018, abs=5e-4)
    assert event.total_revenue == 149523.12


def test_exclusive_score_of_the_spike_day(april):
    events = anomaly.anomaly_events(april).collect()
    # The two days before the series has three values cannot have a spread worth naming.
    spike = [e for e in events if str(e.date) == "2024-04-28"][0]
    assert spike.cr_z == pytest.approx(5.947, abs=0.01)
    assert spike.anomaly_type == "SPIKE"


def test_rolling_mean_of_the_full_window(april):
    last = anomaly.daily_kpis(april).collect()[-1]
    assert last.conversion_rate_7d_ma == pytest.approx(0.006826571871959637, abs=3e-7)


def test_sums_of_the_drop_window(spark):
    impact = diagnosis.business_impact_missed(sessions_per_day(spark, days(DROP))).first()
    assert impact.sessions_during_drop == 30540
    assert impact.actual_revenue_inr == 230202.74
    # Without a baseline there is nothing to expect.
    assert impact.expected_revenue_inr is None


def test_persona_names(spark):
    # The published profile of four segments.
    profile = spark.createDataFrame(
        [
            (0, 42699, 1.367760369095295, 0.0, 0.0, 1.3654652333778308),
            (1, 35711, 1.9767578617232786, 0.001057097252947271, 1.035672598545733, 1.969533197054129),
            (2, 20681, 3.62163338329868, 0.004937723683190537, 4.896392836803661, 3.5941685605144817),
            (3, 909, 1.9383938393839384, 0.6173817381738175, 835.3379083241658, 1.9317931793179317),
        ],
        "segment_id int, count long, avg_sessions double, avg_cr double, avg_revenue double, avg_days_active double",
    )
    named = {r.segment_id: r.segment_name for r in segments.persona_rules(profile).collect()}
    assert named == {
        0: "One-Time Browsers",
        1: "One-Time Browsers",
        2: "Window Shoppers (Retargetable)",
        3: "High-Value Loyal Buyers",
    }
