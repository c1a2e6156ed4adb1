"""The row rules, twice, as SQL conditions that are never null.

The contract is what a valid row satisfies, each value checked with as few
operations as possible since every landed row pays for them. The rules name what
is wrong with the other rows. A row either meets the contract or breaks a rule.
"""

from millrace.model import CORRUPT, EVENT_TYPES, MONEY, TEXT_LIMITS

REQUIRED_TEXT = ("event_id", "user_id", "product_id", "product_name", "category", "event_type")
BASIC_TEXT = ("event_id", "user_id", "product_id", "event_type")

_TYPES = ", ".join(f"'{t}'" for t in EVENT_TYPES)
UNKNOWN_TYPE = f"coalesce(event_type NOT IN ({_TYPES}), false)"
NOT_FINITE = "coalesce(isnan(price) OR abs(price) = double('Infinity'), false)"

_PRICE = {
    "price_null": "price IS NULL",
    "price_not_positive": "coalesce(price <= 0, false)",
}
_TIME = {
    "timestamp_null": "`timestamp` IS NULL",
    "timestamp_unparsable": "`timestamp` IS NOT NULL AND event_timestamp IS NULL",
}

# Prices that the table's column cannot hold.
_UNSTORABLE = {
    "price_not_finite": NOT_FINITE,
    "price_range": f"price IS NOT NULL AND NOT {NOT_FINITE}"
    f" AND try_cast(price AS {MONEY.simpleString()}) IS NULL",
}

# The rules of the ingestion job: ids, event type, price and time.
BASIC_RULES = {
    **{f"{c}_null": f"{c} IS NULL" for c in BASIC_TEXT},
    "event_type_unknown": UNKNOWN_TYPE,
    **_PRICE,
    **_UNSTORABLE,
    **_TIME,
}

# The basic rules plus everything the stored table demands.
TABLE_RULES = {
    **{f"{c}_null": f"{c} IS NULL" for c in REQUIRED_TEXT},
    "event_type_unknown": UNKNOWN_TYPE,
    **{
        f"{c}_length": f"coalesce(length({c}) > {limit}, false)"
        for c, limit in TEXT_LIMITS.items()
        if c != "event_type"  # a known type is always short enough
    },
    **_PRICE,
    **_UNSTORABLE,
    **_TIME,
}


_KNOWN_TYPE = f"coalesce(event_type IN ({_TYPES}), false)"
_POSITIVE = "coalesce(price > 0, false)"
_STORABLE = f"try_cast(price AS {MONEY.simpleString()}) IS NOT NULL"  # nor NaN nor infinite

BASIC_CONTRACT = (
    "event_id IS NOT NULL",
    "user_id IS NOT NULL",
    "product_id IS NOT NULL",
    _KNOWN_TYPE,
    _POSITIVE,
    _STORABLE,
    "event_timestamp IS NOT NULL",
)
TABLE_CONTRACT = (
    *(
        f"coalesce(length({c}) <= {limit}, false)"
        for c, limit in TEXT_LIMITS.items()
        if c != "event_type"
    ),
    _KNOWN_TYPE,
    _POSITIVE,
    _STORABLE,
    "event_timestamp IS NOT NULL",
)


def contract_for(columns, strict=True):
    """The conditions of a valid row in a cleaned frame with these columns."""
    contract = TABLE_CONTRACT if strict else BASIC_CONTRACT
    return (f"{CORRUPT} IS NULL", *contract) if CORRUPT in columns else contract


def rules_for(columns, strict=True):
    """Reason code -> condition for a cleaned frame with these columns."""
    rules = TABLE_RULES if strict else BASIC_RULES
    if CORRUPT not in columns:
        return rules
    # A line that did not parse has no further reasons: its fields mean nothing.
    return {
        "corrupt_record": f"{CORRUPT} IS NOT NULL",
        **{code: f"{CORRUPT} IS NULL AND {bad}" for code, bad in rules.items()},
    }
