"""The reports as SQL views."""

from functools import partial

from millrace.plans import reports

# The names users query.
TABLE = "user_events"
VIEWS = {
    "v_event_summary": reports.event_summary,
    "v_hourly_events": reports.hourly_events,
    "v_purchase_funnel": reports.purchase_funnel,
    "v_top_products": reports.top_products,
    "v_recent_activity": reports.recent_activity,
}


def register_views(events, table=TABLE, zones=None):
    """Create or replace the event view and the report views in the session
    of the given frame. Predicates over a view reach the scan below it.

    With the zones of a stored table a condition on the hour of v_hourly_events reads only the
    dates it allows, and v_recent_activity only the newest ones.
    """
    events.createOrReplaceTempView(table)
    views = dict(VIEWS)
    if zones is not None:
        views["v_hourly_events"] = partial(reports.hourly_events, dates=list(zones.dates))
        views["v_recent_activity"] = partial(reports.recent_activity, zones=zones)
    for name, report in views.items():
        report(events).createOrReplaceTempView(name)
