"""The expected results as SQL over the test tables."""

# The same derivation as in fixtures.py.
_RAW = """
raw as (
  select case when e.event_id % 101 = 0 then null
         when e.event_id % 149 = 0 then lpad(cast(e.event_id as varchar), 60, '0')
         else cast(e.event_id as varchar) end as event_id,
    case when e.event_id % 97 = 0 then null
         when e.event_id % 89 = 0 then concat('  user_', cast(e.user_id as varchar), ' ')
         when e.event_id % 127 = 0 then rpad(concat('user_', cast(e.user_id as varchar)), 60, '0')
         else concat('user_', cast(e.user_id as varchar)) end as user_id,
    case when e.event_id % 107 = 0 then null
         when e.event_id % 139 = 0 then rpad(concat('prod_', cast(p.p_partkey as varchar)), 60, '0')
         else concat('prod_', cast(p.p_partkey as varchar)) end as product_id,
    case when e.event_id % 109 = 0 then '  '
         when e.event_id % 131 = 0 then rpad(p.p_name, 300, 'x')
         else p.p_name end as product_name,
    case when e.event_id % 113 = 0 then null
         when e.event_id % 137 = 0 then rpad(p.p_type, 120, 'x')
         else p.p_type end as category,
    case when e.event_id % 53 = 0 then null
         when e.event_id % 59 = 0 then -e.value
         when e.event_id % 41 = 0 or e.event_id % 43 = 0 or e.event_id % 47 = 0 then e.value
         when e.event_id % 157 = 0 then 'infinity'::double
         when e.event_id % 163 = 0 then 1e8
         else e.value end as price,
    case when e.event_id % 61 = 0 then null
         when e.event_id % 167 = 0 then 'wishlist'
         when e.event_type = 'click' then ' ADD_TO_CART '
         when e.event_type = 'view' then 'View'
         else e.event_type end as event_type,
    case when e.event_id % 71 = 0 then 'not-a-date'
         when e.event_id % 73 = 0 then strftime(e.ts, '%Y-%m-%dT%H:%M:%S')
         when e.event_id % 79 = 0 then strftime(e.ts, ' %Y-%m-%d %H:%M:%S')
         when e.event_id % 173 = 0 then null
         else strftime(e.ts, '%Y-%m-%d %H:%M:%S') end as "timestamp"
  from events e
  join part p on cast(json_extract(e.props, '$.k') as bigint) = p.p_partkey
)"""

_CLEAN = """
dup as (
  select *, 0 as delivery from raw
  union all
  select *, 1 as delivery from raw where cast(event_id as bigint) % 20 = 0
),
clean as (
  select nullif(trim(event_id), '') as event_id,
    nullif(trim(user_id), '') as user_id,
    nullif(trim(product_id), '') as product_id,
    nullif(trim(product_name), '') as product_name,
    nullif(trim(category), '') as category,
    price,
    lower(nullif(trim(event_type), '')) as event_type,
    "timestamp",
    delivery,
    case when "timestamp" not like ' %'
      then try_strptime("timestamp", '%Y-%m-%d %H:%M:%S') end as event_timestamp
  from dup
)"""

_REQUIRED = ("event_id", "user_id", "product_id", "product_name", "category", "event_type")
_LIMITS = {"event_id": 50, "user_id": 50, "product_id": 50, "product_name": 255, "category": 100}
_UNKNOWN = "coalesce(event_type not in ('view', 'add_to_cart', 'purchase'), false)"
_INFINITE = "coalesce(isnan(price) or isinf(price), false)"
_TIME = {
    "timestamp_null": '"timestamp" is null',
    "timestamp_unparsable": '"timestamp" is not null and event_timestamp is null',
}
_UNSTORABLE = {
    "price_not_finite": _INFINITE,
    "price_range": f"price is not null and not {_INFINITE}"
    " and try_cast(price as decimal(10,2)) is null",
}
_BASIC = {
    **{f"{c}_null": f"{c} is null" for c in ("event_id", "user_id", "product_id", "event_type")},
    "event_type_unknown": _UNKNOWN,
    "price_null": "price is null",
    "price_not_positive": "coalesce(price <= 0, false)",
    **_UNSTORABLE,
    **_TIME,
}
_RULES = {
    **{f"{c}_null": f"{c} is null" for c in _REQUIRED},
    "event_type_unknown": _UNKNOWN,
    **{f"{c}_length": f"coalesce(length({c}) > {n}, false)" for c, n in _LIMITS.items()},
    "price_null": "price is null",
    "price_not_positive": "coalesce(price <= 0, false)",
    **_UNSTORABLE,
    **_TIME,
}

_SHORT = " and ".join(f"length({c}) <= {n}" for c, n in _LIMITS.items())
_VERDICT = f"""
v as (
  select *, coalesce({_SHORT}
      and event_type in ('view', 'add_to_cart', 'purchase') and price > 0
      and try_cast(price as decimal(10,2)) is not null
      and event_timestamp is not null, false) as is_valid
  from clean
)"""

_EVENTS = """
ue as (
  select event_id, user_id, product_id, product_name, category,
    try_cast(price as decimal(10,2)) as price, event_type, event_timestamp
  from (
    select *, row_number() over (
      partition by event_id order by event_timestamp, delivery) as nth
    from v where is_valid) t
  where nth = 1
)"""


def _with(*parts):
    return lambda body: "with " + ",".join(parts) + "\n" + body


_from_raw = _with(_RAW)
_from_clean = _with(_RAW, _CLEAN)
_from_v = _with(_RAW, _CLEAN, _VERDICT)
_from_ue = _with(_RAW, _CLEAN, _VERDICT, _EVENTS)

_COLUMNS = (
    "event_id, user_id, product_id, product_name, category, price, event_type, event_timestamp"
)
_SUM = "cast(sum(price) as decimal(18,2))"
_FILE = "cast(event_id as bigint) // 500"


def _mean(price="price"):
    """The mean rounded half up to the cent, in whole numbers."""
    cents, n = f"sum(cast({price} * 100 as bigint))", f"count({price})"
    rounded = f"(2 * {cents} + {n}) // (2 * {n})"
    return f"cast(cast({rounded} as decimal(18,0)) * 0.01 as decimal(18,2))"


def _violations(rules):
    return " union all ".join(
        f"select '{code}' as rule, count(*) filter (where {bad}) as violations from clean"
        for code, bad in rules.items()
    )


_REASONS = "concat_ws(';', " + ", ".join(
    f"case when {bad} then '{code}' end" for code, bad in _RULES.items()
) + ")"

_SUMMARY = f"""select event_type, count(*) as total_events, count(distinct user_id) as unique_users,
  {_mean()} as avg_price, {_SUM} as total_value
from ue group by event_type"""

_HOURLY = """select date_trunc('hour', event_timestamp) as event_hour, event_type,
  count(*) as event_count, count(distinct user_id) as unique_users
from ue group by 1, 2"""

_LAST_DAY = f"""select * from ({_HOURLY}) h
where event_hour > (select max(event_timestamp) from ue) - interval 24 hour"""

_FUNNEL = """select user_id,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'add_to_cart') as cart_adds,
  count(*) filter (where event_type = 'purchase') as purchases
from ue group by user_id"""

_PRODUCTS = f"""select product_id, product_name, category, count(*) as purchase_count,
  {_SUM} as total_revenue
from ue where event_type = 'purchase' group by product_id, product_name, category"""
_TOP_10 = _PRODUCTS + " order by total_revenue desc, product_id, product_name, category limit 10"

_RECENT = """select event_id, user_id, product_name, event_type, price, event_timestamp
from ue order by event_timestamp desc, event_id limit 100"""

_MINUTES = """select date_trunc('minute', event_timestamp) as minute, count(*) as event_count
from ue group by 1"""

_RANGE = f"""select {_COLUMNS} from ue
where event_timestamp >= timestamp '2024-01-10' and event_timestamp < timestamp '2024-01-20'"""

_CREATED = """stored as (
  select *, case when cast(event_id as bigint) % 83 <> 0 then
    event_timestamp + to_seconds(10 - second(event_timestamp) % 10) end as created_at from ue
), waits as (
  select *, cast(date_diff('second', event_timestamp, created_at) as double) as latency from stored
)"""
_from_waits = _with(_RAW, _CLEAN, _VERDICT, _EVENTS, _CREATED)

_PROFILE = f"""profile as (
  select {_FILE} as file_no, count(*) as events,
    count(*) filter (where event_type = 'view') as view_events,
    count(*) filter (where event_type = 'add_to_cart') as add_to_cart_events,
    count(*) filter (where event_type = 'purchase') as purchase_events,
    {_mean("try_cast(price as decimal(10,2))")} as avg_price,
    min(event_timestamp) as first_event, max(event_timestamp) as last_event
  from clean where delivery = 0 group by 1
)"""
_from_profile = _with(_RAW, _CLEAN, _PROFILE)

_PRICE_TEXT = (
    "case when cast(event_id as bigint) % 41 = 0 then 'invalid_price'"
    " else coalesce(cast(price as varchar), '') end"
)
_HEAD = "event_id, coalesce(user_id, ''), coalesce(product_id, '')"
_LINE = (
    f"concat_ws(',', {_HEAD}, coalesce(product_name, ''), coalesce(category, ''), {_PRICE_TEXT},"
    " coalesce(event_type, ''), coalesce(\"timestamp\", ''))"
)
_NUMBER = "cast(event_id as bigint)"
_BROKEN = f"({_NUMBER} % 41 = 0 or {_NUMBER} % 43 = 0 or {_NUMBER} % 47 = 0)"
_LINES = f"""lines as (
  select event_id,
    case when {_NUMBER} % 43 = 0 then concat_ws(',', {_HEAD})
         when {_NUMBER} % 47 = 0 then concat({_LINE}, ',surplus')
         else {_LINE} end as line
  from raw where {_BROKEN}
)"""

_LINED = f"lined as (select event_id, {_LINE} as line from raw where event_id is not null)"
# A line whose price is not a number.
_UNREAD = f"coalesce({_NUMBER} % 41 = 0, false)"

# Stored rows that break the contract, as in fixtures.nonconforming.
_ODD = f"""odd as (
  select case when {_NUMBER} % 2 = 0 then concat_ws('-', substr(md5(event_id), 1, 8),
      substr(md5(event_id), 9, 4), substr(md5(event_id), 13, 4), substr(md5(event_id), 17, 4),
      substr(md5(event_id), 21, 12)) else event_id end as event_id,
    user_id, product_id, case when {_NUMBER} % 17 <> 0 then product_name end as product_name,
    case when {_NUMBER} % 19 = 0 then rpad(category, 101, 'x') else category end as category,
    case when {_NUMBER} % 11 = 0 then -price else price end as price,
    case when {_NUMBER} % 7 = 0 then 'other' else event_type end as event_type,
    case when {_NUMBER} % 13 <> 0 then event_timestamp end as event_timestamp
  from ue
)"""
_LOSSY = f"""kept as (select * from ue where {_NUMBER} % 31 <> 0),
stored as (select * from kept union all select * from kept where {_NUMBER} % 37 = 0)"""

ORACLES = {
    "events_scan": _from_ue(f"select {_COLUMNS} from ue"),
    "clean_events": _from_clean("select * from clean"),
    "valid_events": _from_v(
        'select * exclude (is_valid, "timestamp") from v where is_valid'
    ),
    "invalid_events": _from_v(
        f"select * exclude (is_valid), {_REASONS} as reasons from v where not is_valid"
    ),
    "null_verdict_rows": _from_clean(
        """select * from clean
where (event_id is not null and user_id is not null and product_id is not null
  and event_type in ('view', 'add_to_cart', 'purchase') and price > 0
  and event_timestamp is not null) is null"""
    ),
    "rule_violations": _from_clean(_violations(_RULES)),
    "basic_rule_violations": _from_clean(_violations(_BASIC)),
    "conformance_report": _with(_RAW, _CLEAN, _VERDICT, _EVENTS, _ODD)(
        """select count(*) as checked_rows,
  count(*) filter (where not regexp_full_match(event_id,
    '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')) as bad_event_id,
  count(*) filter (where event_type not in ('view', 'add_to_cart', 'purchase')) as bad_event_type,
  count(*) filter (where not price > 0) as bad_price,
  count(*) filter (where event_timestamp is null) as bad_timestamp,
  count(*) filter (where event_id is null or user_id is null or product_id is null
    or product_name is null or category is null or price is null or event_type is null
    or event_timestamp is null) as missing_value,
  count(*) filter (where length(event_id) > 50 or length(user_id) > 50
    or length(product_id) > 50 or length(product_name) > 255 or length(category) > 100
    or length(event_type) > 20) as too_long
from odd"""
    ),
    "malformed_rows": _with(_RAW, _LINES)("select event_id, line from lines"),
    "malformed_reasons": _from_v(
        f"""select reasons, count(*) as rejected_rows
from (select case when {_BROKEN} then 'corrupt_record' else {_REASONS} end as reasons
      from v where delivery = 0 and (not is_valid or {_BROKEN})) t
group by reasons"""
    ),
    "export_roundtrip": _from_ue(
        """select event_id, user_id, product_id, product_name, category,
  cast(price as double) as price, event_type,
  strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') as "timestamp" from ue"""
    ),
    "dedup_events": _from_v(
        """select * exclude (nth, is_valid, "timestamp") from (
  select *, row_number() over (
    partition by event_id order by event_timestamp, delivery) as nth
  from v where is_valid) t where nth = 1"""
    ),
    "insert_if_absent": _from_ue(
        f"""select {_COLUMNS} from ue where event_id not in (
  select event_id from ue where cast(event_id as bigint) % 3 = 0)"""
    ),
    "table_insert": _from_ue(
        f"""select row_number() over (order by batch_id, event_timestamp, event_id) as id,
  {_COLUMNS}, batch_id
from (select *, cast(case when cast(event_id as bigint) % 3 = 0 then 0 else 1 end as bigint)
        as batch_id from ue) t"""
    ),
    "surrogate_ids": _from_ue(
        f"select row_number() over (order by event_timestamp, event_id) as id, {_COLUMNS} from ue"
    ),
    "event_count": _from_ue("select count(*) as total_events from ue"),
    "events_by_type": _from_ue(
        "select event_type, count(*) as event_count from ue group by event_type"
    ),
    "event_summary": _from_ue(_SUMMARY),
    "hourly_events": _from_ue(_HOURLY),
    "hourly_events_last_24h": _from_ue(_LAST_DAY),
    "purchase_funnel": _from_ue(_FUNNEL),
    "funnel_buyers": _from_ue(f"select * from ({_FUNNEL}) f where purchases > 0"),
    "top_products": _from_ue(_PRODUCTS),
    "top_10_products": _from_ue(_TOP_10),
    "recent_activity": _from_ue(_RECENT),
    "recent_10": _from_ue(
        f"select {_COLUMNS} from ue order by event_timestamp desc, event_id limit 10"
    ),
    "events_per_minute": _from_ue(_MINUTES),
    "latest_minutes": _from_ue(_MINUTES + " order by minute desc limit 10"),
    "event_mix": _from_ue(
        """select event_type, count(*) as event_count, min(price) as min_price,
  max(price) as max_price,
  cast(count(*) as double) / cast(sum(count(*)) over () as double) as share
from ue group by event_type"""
    ),
    "sample_events": _from_ue(
        f"select {_COLUMNS} from ue order by md5(event_id), event_id limit 5"
    ),
    "date_range": _from_ue(_RANGE),
    "stored_date_range": _from_ue(_RANGE),
    "throughput_stats": _from_ue(
        """select count(*) as total_events, min(event_timestamp) as first_event,
  max(event_timestamp) as last_event,
  cast(date_diff('second', min(event_timestamp), max(event_timestamp)) as double)
    as duration_seconds
from ue"""
    ),
    "latency_stats": _from_waits(
        """select avg(latency) as avg_latency, max(latency) as max_latency,
  min(latency) as min_latency from waits"""
    ),
    "slo_report": _from_waits(
        """select landed, stored, cast(stored as double) / cast(landed as double) as success_rate,
  cast(stored as double) / cast(landed as double) >= 0.99 as success_met,
  cast(in_time as double) / cast(stored as double) as in_time_rate,
  max_latency, max_latency < 30 as latency_met
from (select (select count(*) from raw) as landed, count(*) as stored,
        count(*) filter (where latency < 30) as in_time, max(latency) as max_latency
      from waits) t"""
    ),
    "integrity_report": _with(_RAW, _CLEAN, _VERDICT, _EVENTS, _LOSSY)(
        """select (select count(*) from v) as landed_rows,
  (select count(*) from v where event_id is null) as landed_without_id,
  (select count(distinct event_id) from v) as landed_ids,
  (select count(*) from stored) as stored_rows,
  (select count(*) - count(distinct event_id) from stored) as duplicates,
  (select count(distinct event_id) from v where not is_valid) as rejected_ids,
  (select count(distinct event_id) from v where event_id not in (select event_id from stored)
     and event_id not in
       (select event_id from v where not is_valid and event_id is not null)) as lost_ids"""
    ),
    "batch_ledger": _from_v(
        f"""select {_FILE} as batch, count(*) as received,
  count(*) filter (where is_valid) as valid, count(*) filter (where not is_valid) as invalid,
  count(distinct event_id) filter (where is_valid) as kept
from v group by 1"""
    ),
    "file_profile": _from_profile("select * from profile"),
    "file_running_totals": _from_profile(
        """select file_no, events, files_so_far, total_events, elapsed_seconds,
  cast(total_events as double) / nullif(elapsed_seconds, 0) as events_per_second
from (select file_no, events, count(*) over w as files_so_far,
        cast(sum(events) over w as bigint) as total_events,
        cast(date_diff('second', min(first_event) over w, max(last_event) over w) as double)
          as elapsed_seconds
      from profile
      window w as (order by file_no nulls first rows between unbounded preceding and current row)) t"""
    ),
    "run_summary": _from_profile(
        """select total_events, total_files, elapsed_seconds,
  cast(total_events as double) / nullif(elapsed_seconds, 0) as events_per_second
from (select cast(sum(events) as bigint) as total_events, count(*) as total_files,
        cast(date_diff('second', min(first_event), max(last_event)) as double)
          as elapsed_seconds
      from profile) t"""
    ),
    "view_event_summary": _from_ue(_SUMMARY),
    "view_hourly_events": _from_ue(_HOURLY),
    "view_purchase_funnel": _from_ue(f"select * from ({_FUNNEL}) f where purchases > 0"),
    "view_top_products": _from_ue(_TOP_10),
    "view_recent_activity": _from_ue(_RECENT),
    "stream_parquet": _from_ue(f"select {_COLUMNS} from ue"),
    "stream_restart": _from_ue(f"select {_COLUMNS} from ue"),
    "compacted_table": _from_ue(f"select {_COLUMNS} from ue"),
    "stream_dedup_events": _from_ue(f"select {_COLUMNS} from ue"),
    "stream_ledger": _from_v(
        f"""select count(*) as received, count(*) filter (where {_UNREAD}) as corrupt,
  count(*) filter (where is_valid and not {_UNREAD}) as valid,
  count(*) filter (where not is_valid or {_UNREAD}) as invalid,
  count(*) filter (where is_valid and not {_UNREAD}) as kept,
  count(distinct event_id) filter (where is_valid and not {_UNREAD}) as written,
  true as several_batches
from v"""
    ),
    "stream_quarantine": _with(_RAW, _CLEAN, _VERDICT, _LINED)(
        f"""select event_id, user_id, "timestamp", case when {_UNREAD} then line end as raw_line,
  case when {_UNREAD} then 'corrupt_record' else {_REASONS} end as reasons
from v left join lined using (event_id) where not is_valid or {_UNREAD}"""
    ),
    "stream_new_checkpoint": _from_ue(
        """select count(*) as stored_rows, count(*) as stored_ids, count(*) as numbers,
  count(*) as last_number, cast(2 as bigint) as streams, count(*) as written from ue"""
    ),
    "stream_hourly": _from_ue(_HOURLY),
    "stream_minutes": _from_ue(_MINUTES),
    "stored_recent_activity": _from_ue(_RECENT),
    "stored_recent_10": _from_ue(
        f"select {_COLUMNS} from ue order by event_timestamp desc, event_id limit 10"
    ),
    "stored_last_24h": _from_ue(_LAST_DAY),
    "view_hourly_last_24h": _from_ue(_LAST_DAY),
    "view_hourly_since": _from_ue(_LAST_DAY),
    "reindexed_insert": _from_ue(f"select {_COLUMNS} from ue"),
    "committed_events": _from_ue(f"select {_COLUMNS} from ue where {_NUMBER} % 3 = 0"),
    "table_newest": _from_ue(_RECENT),
    "table_date_range": _from_ue(_RANGE),
    "summary_from_states": _from_ue(_SUMMARY),
    "hourly_from_states": _from_ue(_HOURLY),
    "funnel_from_states": _from_ue(_FUNNEL),
    "products_from_states": _from_ue(_TOP_10),
    "events_of_user": _from_ue(
        f"select {_COLUMNS} from ue where user_id = (select min(user_id) from ue)"
    ),
    "events_of_product": _from_ue(
        f"select {_COLUMNS} from ue where product_id = (select min(product_id) from ue)"
    ),
    "rolling_users": _from_ue(
        """select h.event_hour, count(distinct user_id) as unique_users, true as within
from (select distinct date_trunc('hour', event_timestamp) as event_hour from ue) h
join ue on event_timestamp < h.event_hour + interval 1 hour
  and event_timestamp >= h.event_hour - interval 23 hour
group by 1"""
    ),
    "stream_files": """select true as all_landed, true as several_batches,
  cast(2 as bigint) as most_in_a_batch""",
    "stream_without_valid_rows": _from_v(
        """select count(*) as received, count(*) as invalid, cast(0 as bigint) as written,
  cast(0 as bigint) as stored
from v where not is_valid"""
    ),
    "stored_stamps": _from_ue(
        f"""select case when {_NUMBER} % 3 = 0 then timestamp '2026-01-01 12:00:00'
  else timestamp '2026-01-02 00:00:00' end as created_at, count(*) as stored_rows
from ue group by 1"""
    ),
}
