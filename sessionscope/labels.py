"""The wording of marks, verdicts and names in result tables.

Fixed values throughout: consumers match on these texts.
"""

# Health marks of the metrics tree, status of the health rows.
GOOD_MARK = "✅"
BAD_MARK = "⚠️"
HEALTHY_LABEL = "✅ Healthy"
AT_RISK_LABEL = "⚠️ At Risk"
HEALTHY = "healthy"
AT_RISK = "at_risk"

# Daily alerts.
CR_ALERT = "🚨 CR ANOMALY"
RPS_ALERT = "🚨 RPS ANOMALY"
NO_ALERT = "✅ Normal"
ANOMALY_FLAG = "🚨 ANOMALY"
DROP = "DROP"
SPIKE = "SPIKE"

# Periods around a launch or a drop.
PRE_LAUNCH = "pre_launch"
POST_LAUNCH = "post_launch"
BASELINE = "baseline_7d"
DROP_DAY = "drop_day"

# Drop verification; the significance level is filled in.
REAL_DROP = "REAL DROP — statistically significant (p < {alpha})"
LIKELY_NOISE = "LIKELY NOISE — not statistically significant"

# Root cause.
MOBILE_CAUSE = "Mobile UX / Payment Gateway"
CATEGORY_CAUSE = "Product Category: "
MOBILE_HYPOTHESIS = (
    "MOBILE PAYMENT / UX ISSUE: Mobile CR dropped %.1f%% vs desktop %.1f%%. "
    "Check: mobile payment SDK, app update, responsive layout breakage."
)
CATEGORY_HYPOTHESIS = (
    "CATEGORY-LEVEL ISSUE: '%s' shows the deepest CR drop. "
    "Check: inventory issues, price change, product page errors in this category."
)

# Launch verdicts.
LAUNCH_IMPROVED = "SIGNIFICANT IMPROVEMENT ✅"
LAUNCH_REGRESSED = "SIGNIFICANT REGRESSION ⚠️"
LAUNCH_UNCLEAR = "NOT SIGNIFICANT — needs more data 🔄"
SHIP = "🚀 SHIP IT — Full rollout recommended"
SHIP_CONDITIONALLY = "⚠️ CONDITIONAL SHIP — Fix guardrail issues before full rollout"
DO_NOT_SHIP = "🛑 DO NOT SHIP — No significant improvement detected"
SEGMENT_REGRESSION = "⚠️ Regression on segment"
SEGMENT_OK = "✅ OK"

# Guardrails: name, good direction, verdict when passed, verdict when failed.
LOAD_GUARDRAIL = (
    "Page Load Time (ms)",
    "lower",
    "✅ PASSED — Load time improved",
    "⚠️ FAILED — Load time degraded",
)
BOUNCE_GUARDRAIL = (
    "Bounce Rate",
    "lower",
    "✅ PASSED — Bounce rate held/improved",
    "⚠️ FAILED — Bounce rate increased",
)
REVENUE_GUARDRAIL = (
    "Revenue Per Session (₹)",
    "higher",
    "✅ PASSED — Revenue per session improved",
    "⚠️ FAILED — Revenue per session dropped",
)

# Personas.
LOYAL = "High-Value Loyal Buyers"
ENGAGED = "Engaged Regular Shoppers"
ONE_TIME = "One-Time Browsers"
WINDOW = "Window Shoppers (Retargetable)"
