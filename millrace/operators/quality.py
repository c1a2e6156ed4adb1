"""Cleaning, the verdict on each row, and reports about broken rules."""

from pyspark.sql import functions as F

from millrace.functions.cleaning import lowered, parse_event_time, tidy
from millrace.functions.rules import NOT_FINITE, UNKNOWN_TYPE, contract_for, rules_for
from millrace.model import EVENT_COLUMNS, MONEY, TEXT_COLUMNS, TEXT_LIMITS

# Fixed value: the textual form of a UUID.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def clean(df, strict=True):
    """Trim the text columns, lower the event type, parse the event time.

    strict also turns blank text into null. The timestamp text stays for the
    quarantine.
    """
    texts = {c: tidy(F.col(c), strict) for c in TEXT_COLUMNS}
    texts["event_type"] = lowered(F.col("event_type"), strict)
    return df.withColumns({**texts, "event_timestamp": parse_event_time("timestamp")})


def _any(conditions):
    return " OR ".join(f"({c})" for c in conditions)


def judge(df, strict=True):
    """Add is_valid, never null. strict applies all rules of the stored table,
    otherwise only those of ids, event type, price sign and event time."""
    contract = " AND ".join(contract_for(df.columns, strict))
    return df.withColumn("is_valid", F.expr(contract))


def valid(judged):
    return judged.where("is_valid").drop("is_valid", "timestamp")


def rejected(judged, strict=True):
    """The invalid rows with their reason codes, joined by semicolons."""
    rules = rules_for(judged.columns, strict)
    codes = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules.items())
    return (
        judged.where("NOT is_valid")
        .withColumn("reasons", F.expr(f"concat_ws(';', {codes})"))
        .drop("is_valid")
    )


def split(df, strict=True):
    """(valid, rejected) of a raw landing frame; each row is in exactly one."""
    judged = judge(clean(df, strict), strict)
    return valid(judged), rejected(judged, strict)


def to_event_columns(df):
    """The table's columns in order, the price as money. No rule set lets a price through
    that does not fit; one that was not judged is an error rather than a null."""
    return df.withColumn("price", F.col("price").cast(MONEY)).select(*EVENT_COLUMNS)


def rule_violations(cleaned, strict=True):
    """One row per rule with the number of rows that break it; a single scan."""
    rules = rules_for(cleaned.columns, strict)
    counts = cleaned.agg(*[F.count_if(F.expr(bad)).alias(code) for code, bad in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def conformance_report(events, id_pattern=UUID):
    """Counts over stored rows that do not look like the table's contract."""
    too_long = _any(f"length({c}) > {limit}" for c, limit in TEXT_LIMITS.items())
    missing = _any(f"{c} IS NULL" for c in EVENT_COLUMNS)
    bad_price = f"NOT price > 0 OR {NOT_FINITE}"
    return events.agg(
        F.count("*").alias("checked_rows"),
        F.count_if(~F.col("event_id").rlike(id_pattern)).alias("bad_event_id"),
        F.count_if(F.expr(UNKNOWN_TYPE)).alias("bad_event_type"),
        F.count_if(F.expr(bad_price)).alias("bad_price"),
        F.count_if(F.col("event_timestamp").isNull()).alias("bad_timestamp"),
        F.count_if(F.expr(missing)).alias("missing_value"),
        F.count_if(F.expr(too_long)).alias("too_long"),
    )
