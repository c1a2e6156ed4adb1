import datetime

import pytest
from pyspark.errors import ArithmeticException

from millrace import operators as op
from millrace.model import CORRUPT, EVENT_COLUMNS, LANDING
from millrace.sources import malformed, read_landing

GOOD = dict(
    event_id="e1", user_id="u1", product_id="p1", product_name="Lamp", category="Home",
    price=1.5, event_type="view", timestamp="2026-01-15 10:00:00",
)

# (changes to a good row, reasons, valid under the basic rules)
CASES = [
    ({}, "", True),
    ({"user_id": " u1 ", "event_type": " VIEW "}, "", True),
    ({"price": None}, "price_null", False),
    ({"event_type": None}, "event_type_null", False),
    ({"event_type": None, "price": -1.0}, "event_type_null;price_not_positive", False),
    ({"event_type": "click"}, "event_type_unknown", False),
    ({"price": -1.0}, "price_not_positive", False),
    ({"price": 0.0}, "price_not_positive", False),
    ({"price": float("nan")}, "price_not_finite", False),
    ({"price": float("inf")}, "price_not_finite", False),
    ({"price": float("-inf")}, "price_not_positive;price_not_finite", False),
    ({"price": 1e8}, "price_range", False),
    ({"price": 99999999.99}, "", True),
    ({"event_id": None}, "event_id_null", False),
    ({"event_id": "   "}, "event_id_null", True),
    ({"product_name": None}, "product_name_null", True),
    ({"category": ""}, "category_null", True),
    ({"event_id": "x" * 50}, "", True),
    ({"event_id": "x" * 51}, "event_id_length", True),
    ({"product_name": "x" * 256}, "product_name_length", True),
    ({"timestamp": "2026-13-45 10:00:00"}, "timestamp_unparsable", False),
    ({"timestamp": "2026-02-30 10:00:00"}, "timestamp_unparsable", False),
    ({"timestamp": "2026-01-15T10:00:00"}, "timestamp_unparsable", False),
    ({"timestamp": " 2026-01-15 10:00:00"}, "timestamp_unparsable", False),
    ({"timestamp": "2026-01-15 24:00:00"}, "timestamp_unparsable", False),
    ({"timestamp": "2026-01-15"}, "timestamp_unparsable", False),
    ({"timestamp": None}, "timestamp_null", False),
]


@pytest.fixture(scope="module")
def landing(spark):
    rows = []
    for number, (change, _, _) in enumerate(CASES):
        row = {**GOOD, **change}
        rows.append([row[c] for c in LANDING.fieldNames()] + [number])
    return spark.createDataFrame(rows, LANDING.simpleString()[7:-1].replace(":", " ") + ", n int")


def test_reasons(landing):
    good, bad = op.split(landing)
    got = {r.n: r.reasons for r in bad.select("n", "reasons").collect()}
    got |= {r.n: "" for r in good.select("n").collect()}
    assert got == {n: reasons for n, (_, reasons, _) in enumerate(CASES)}


def test_basic_rules(landing):
    good, bad = op.split(landing, strict=False)
    basic = {n for n, (_, _, ok) in enumerate(CASES) if ok}
    assert {r.n for r in good.select("n").collect()} == basic
    assert good.count() + bad.count() == len(CASES)
    assert bad.where("reasons = ''").count() == 0


def test_violations_count_the_reasons(landing):
    counts = {r.rule: r.violations for r in op.rule_violations(op.clean(landing)).collect()}
    expected = {}
    for _, reasons, _ in CASES:
        for reason in filter(None, reasons.split(";")):
            expected[reason] = expected.get(reason, 0) + 1
    assert {k: v for k, v in counts.items() if v} == expected


def test_normalised_values(landing):
    row = op.to_event_columns(op.split(landing)[0].where("n = 1")).first()
    assert (row.user_id, row.event_type) == ("u1", "view")
    assert row.event_timestamp == datetime.datetime(2026, 1, 15, 10)
    assert str(row.price) == "1.50"


def test_a_price_that_does_not_fit_is_rejected_without_the_table_rules(landing):
    good, bad = op.split(landing.where("price = 1e8"), strict=False)
    assert op.to_event_columns(good).count() == 0
    assert bad.count() > 0 and {r.reasons for r in bad.collect()} == {"price_range"}


def test_a_price_that_was_not_judged_is_an_error_rather_than_null(landing):
    with pytest.raises(ArithmeticException):
        op.to_event_columns(op.clean(landing.where("price = 1e8"))).collect()


def test_times_do_not_depend_on_the_session_zone(spark, landing):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    gap = "2026-03-08 02:30:00"  # does not exist there
    df = session.createDataFrame([(gap,)], "timestamp string")
    from millrace.functions import as_instant, as_wall_clock, hour_of, parse_event_time
    from millrace.functions import seconds_between

    t = df.select(parse_event_time("timestamp").alias("t"))
    row = t.select(
        t.t.cast("string").alias("text"),
        as_wall_clock(as_instant("t")).cast("string").alias("back"),
        hour_of("t").cast("string").alias("hour"),
    ).first()
    assert (row.text, row.back, row.hour) == (gap, gap, "2026-03-08 02:00:00")
    later = t.selectExpr("t", "t + interval 90 minutes as later")
    assert later.select(seconds_between("t", "later").alias("s")).first().s == 5400


def test_conformance(spark):
    uuid = "a05a77ab-8565-4622-b489-15e63e6ae7c7"
    rows = [(uuid, "u", "p", "n", "c", "1.00", "view", "2026-01-01 00:00:00"),
            ("short", "u", "p", None, "c", "-1.00", "click", "2026-01-01 00:00:00"),
            (uuid[:-1], "u" * 51, "p", "n", "c", "1.00", "view", None)]
    df = spark.createDataFrame(rows, ",".join(f"{c} string" for c in EVENT_COLUMNS))
    df = df.selectExpr(
        "* except (price, event_timestamp)", "cast(price as decimal(10,2)) price",
        "cast(event_timestamp as timestamp_ntz) event_timestamp",
    )
    row = op.conformance_report(df).first()
    assert row.asDict() == dict(
        checked_rows=3, bad_event_id=2, bad_event_type=1, bad_price=1, bad_timestamp=1,
        missing_value=2, too_long=1,
    )


HEADER = "event_id,user_id,product_id,product_name,category,price,event_type,timestamp\n"
LINES = HEADER + (
    'ok,u,p,"27"" Monitor, flat",c,1.5,view,2026-01-15 10:00:00\n'
    "short,u,p\n"
    "long,u,p,n,c,1.5,view,2026-01-15 10:00:00,more\n"
    "bad,u,p,n,c,invalid_price,view,2026-01-15 10:00:00\n"
    "nan,u,p,n,c,NaN,view,2026-01-15 10:00:00\n"
    '"",u,p,n,c,1.5,view,2026-01-15 10:00:00\n'
    "empty,u,p,n,c,,,2026-01-15 10:00:00\n"
)


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    (folder / "events.csv").write_text(LINES)
    return str(folder)


def test_broken_lines_are_quarantined(spark, csv):
    good, bad = op.split(read_landing(spark, csv))
    assert [r.product_name for r in good.collect()] == ['27" Monitor, flat']
    reasons = {r.event_id: r.reasons for r in bad.collect()}
    assert reasons == {
        "short": "corrupt_record", "long": "corrupt_record", "bad": "corrupt_record",
        "nan": "price_not_finite", None: "event_id_null", "empty": "event_type_null;price_null",
    }


def test_broken_lines_are_counted_whatever_is_selected(spark, csv):
    landing = read_landing(spark, csv)
    assert landing.count() == 7
    assert malformed(landing).count() == 3
    assert malformed(landing).select("event_id").count() == 3
    assert landing.where(f"{CORRUPT} is null").count() == 4


def test_dropmalformed(spark, csv):
    rows = read_landing(spark, csv, mode="DROPMALFORMED").select(*LANDING.fieldNames()).collect()
    assert {r.event_id for r in rows} == {"ok", "nan", None, "empty"}
