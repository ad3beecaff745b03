"""Fixed values.

Everything in this module is a value that results depend on: fees, thresholds,
weights and the texts that rules attach to rows. There is no logic here.
"""

# Administration fee per payment type (name lower-cased, blanks as "_").
PAYMENT_FEES = {
    "cash": 0,
    "debit_card": 1500,
    "credit_card": 2500,
    "qris": 1000,
    "ewallet": 1500,
    "unknown": 1000,
}

# Seat categories that have a column of their own (lower-cased).
SEAT_CATEGORIES = ("regular", "vip", "sweetbox")

# Show statuses (lower-cased) that count as an incident.
CANCELLED = ("cancelled", "canceled")
DELAYED = "delayed"

# Time-slot score weights and advice thresholds.
SLOT_DEMAND_WEIGHT = 0.6
SLOT_REVENUE_WEIGHT = 0.4
SLOT_PREMIUM = "Consider premium pricing or add more shows in this slot."
SLOT_STRONG = "Demand is strong, evaluate pricing and studio allocation to improve monetization."
SLOT_QUIET = "This slot is usually quiet; consider promotions or reducing show frequency."
SLOT_KEEP = "Keep this slot as-is while monitoring demand changes."

# Pricing actions, their price change in percent and their reasons.
PRICE_UP = "increase_price"
PRICE_DOWN = "discount_or_reduce_slot"
PRICE_HOLD = "hold"
PRICE_REASON_LAGGING = "Demand and occupancy are high, but slot monetization is still lagging."
PRICE_REASON_PACKED = "Slot sangat padat dan layak diuji premium pricing."
PRICE_REASON_LOW = "Occupancy is low, so promotions or reduced frequency may be more effective."
PRICE_REASON_HOLD = "Slot ini relatif seimbang."

# Advertising score weights.
AD_AUDIENCE_WEIGHT = 0.5
AD_REVENUE_WEIGHT = 0.3
AD_OCCUPANCY_WEIGHT = 0.2
AD_FORMULA = "0.5*audience + 0.3*revenue + 0.2*occupancy"

# Advice of the breakout-title and overlap rules.
BREAKOUT_YES = "Add more shows and accelerate marketing support."
BREAKOUT_NO = "Monitor further before expanding slot allocation."
OVERLAP_ADVICE = "Consider moving showtime, reducing overlap, or changing studio."

# Action types in the order in which their candidates are listed.
MOVE = "move_to_larger_studio"
REDUCE = "reduce_showtimes"
PROMO = "promotion_opportunity"
PREMIUM = "premium_pricing"

# Fixed values: (action type, badge colour, badge icon).
ACTION_BADGES = (
    (MOVE, "blue", "move-right"),
    (REDUCE, "red", "minus-circle"),
    (PROMO, "yellow", "badge-percent"),
    (PREMIUM, "green", "trending-up"),
)
DEFAULT_BADGE = ("slate", "lightbulb")

# Expected impact by action type.
EXPECTED_IMPACT = {
    MOVE: "Capture unmet demand and reduce sellout risk on high-performing sessions.",
    REDUCE: "Free up capacity for stronger titles or stronger time windows.",
    PROMO: "Lift utilization in weak sessions without cutting stronger showtimes.",
    PREMIUM: "Increase revenue yield without adding more schedule volume.",
}

# Action texts. {t} title, {h} start time, {v} venue, {r} room now,
# {n} other room, {o} occupancy, {k} tickets.
ACTION_TEXT = {
    MOVE: {
        "title": "Move {t} to {n}",
        "description": "{t} at {h} in {v} is regularly filling {r}, while {n} has spare capacity.",
        "reason": "Average occupancy for this session is {o}%, and {n} is a larger studio with weaker "
        "aggregate utilization.",
    },
    REDUCE: {
        "title": "Reduce the {h} show for {t}",
        "description": "{t} is consistently underperforming in {v} at {h}.",
        "reason": "The session is running at only {o}% occupancy with {k} tickets sold over the observed pattern.",
    },
    PROMO: {
        "title": "Run a targeted promo for {t} at {h}",
        "description": "{t} has recoverable demand in {v}, but the current session still under-converts.",
        "reason": "The slot is only reaching {o}% occupancy, which fits the low-conversion window highlighted "
        "by pricing analysis.",
    },
    PREMIUM: {
        "title": "Test a premium price for {t} at {h}",
        "description": "{t} is already winning in {v} during this slot.",
        "reason": "The session is sustaining {o}% occupancy, which indicates pricing headroom on a resilient "
        "time window.",
    },
}

# Insight texts of a scope without a candidate action. {s} scope label,
# {o} occupancy, {k} ticket growth, {r} revenue growth.
INSIGHT_ACTION_TITLE = "{s} needs an operational adjustment"
INSIGHT_TEXT = {
    "occupancy": {
        "title": "{s} needs immediate showtime optimization",
        "description": "The last 14 days show average occupancy at {o}%, which indicates underused capacity.",
        "recommendation": "Reduce weak showtimes, move strong titles into better sessions, and tighten studio "
        "allocation.",
        "action_items": [
            "Review the weakest sessions and reduce frequency where needed.",
            "Protect the strongest titles and prime time sessions.",
            "Use promotions only on sessions with persistent low demand.",
        ],
        "impact_level": "high",
    },
    "growth": {
        "title": "{s} is showing softer demand",
        "description": "Ticket growth is {k}% and revenue growth is {r}% across the last 14 days.",
        "recommendation": "Refresh commercial actions, focus capacity on proven demand, and cut weak showtimes.",
        "action_items": [
            "Evaluate campaign performance in the weakest sessions.",
            "Test selective incentives only where conversion is consistently weak.",
            "Shift capacity toward stronger time windows.",
        ],
        "impact_level": "medium",
    },
    "revenue": {
        "title": "{s} is stable with room to monetize stronger demand",
        "description": "Revenue and ticket performance are stable across the last 14 days, with average "
        "occupancy at {o}%.",
        "recommendation": "Protect high-performing sessions and test targeted pricing or promotional actions "
        "on the best opportunities.",
        "action_items": [
            "Maintain the strongest sessions and avoid unnecessary price cuts.",
            "Test premium pricing only on the most resilient demand windows.",
            "Monitor occupancy shifts before expanding schedule volume.",
        ],
        "impact_level": "medium",
    },
}

# Theme of an insight by the type of its first action.
ACTION_THEME = {MOVE: "capacity", PROMO: "promotion", PREMIUM: "pricing"}

# Allowed values in stored insight payloads.
PRIORITIES = ("low", "medium", "high")
INSIGHT_CATEGORIES = ("occupancy", "revenue", "tickets", "growth")

# Alerts. (id, title, recommended action).
ALERTS = (
    (
        "system-health",
        "Backend health",
        "Check backend connectivity, database health, and data synchronization.",
    ),
    (
        "revenue-growth",
        "Revenue trend",
        "Review promos, movie lineup, and branches with revenue declines.",
    ),
    (
        "occupancy-level",
        "Occupancy level",
        "Consider studio relayout or reduce low-demand showtimes.",
    ),
    (
        "cinema-activity",
        "Cinema activity",
        "Validate whether inactive branches are offline, under maintenance, or idle.",
    ),
)
HEALTH_UP = "Backend is active and responding normally."
HEALTH_DOWN = "Backend is inactive or cannot reach the database."
REVENUE_DOWN = "Revenue is below the previous comparison window."
REVENUE_OK = "Revenue is stable or above the previous comparison window."
OCCUPANCY_LOW = "Overall occupancy is low and may need attention."
OCCUPANCY_OK = "Overall occupancy is within an acceptable range."
