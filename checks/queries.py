"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.model import AS_OF, MONTH, ZONE, Model
from tidewatch.functions import business_days, scalars, schedules
from tidewatch.operators import (
    access,
    alerts,
    calls,
    catalogue,
    costs,
    dependencies,
    files,
    lists,
    maintenance,
    reliability,
    runs,
    state,
    tables,
)
from tidewatch.plans import monthly, status, timeline
from tidewatch.sinks import applied, export
from tidewatch.sources import polled, reports, table_logs

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}


def query(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def text(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def metric(name: str) -> Column:
    return F.try_element_at("metrics", F.lit(name)).alias(name)


# sources


@query
def run_reports(m):
    rows = reports.run_reports(m.raw_reports)
    return rows.select("id", "flow", "at", "outcome", "detail", metric("k"))


@query
def refused_reports(m):
    return reports.refused_reports(m.raw_reports).select("id", "flow", "result", "refusal")


@query
def strict_reports(m):
    forms = """element_at(array('{"a": NaN}', "{'a': 1}", '{"a": 1} tail', '{"a": 1e999}', '{"a": 01}', '{"a": -1.5e3}'),
        cast(id % 6 + 1 AS int))"""
    raw = m.raw_reports.withColumns({"result": F.lit("0"), "body": F.expr(forms)})
    return reports.refused_reports(raw).select("id", "flow", "refusal")


@query
def call_reports(m):
    return (
        reports.call_reports(m.raw_calls)
        .withColumn("millis", calls.clamped(F.col("millis")))
        .groupBy("flow", "status")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("millis").alias("millis"))
        .select("flow", *long("status"), "calls", "millis")
    )


@query
def refused_calls(m):
    spoilt = F.expr("if(unix_seconds(at) % 7 = 0, '{\"millis\": 5}', body)")
    raw = m.raw_calls.withColumn("body", spoilt)
    return reports.refused_calls(raw).select("flow", "at", "refusal")


@query
def table_log_inventory(m):
    return table_logs.inventory(m.log_lines).select(
        "table_name", "version", "committed_at", "rows", "files", "bytes",
        F.array_join("fields", ",").alias("fields"),
    )


@query
def completed_job_runs(m):
    last = m.job_runs.groupBy("job_id").agg(
        F.timestamp_millis(F.max("end_ms") - 86_400_000 * 200).alias("last_ok")
    )
    return polled.run_successes(m.job_runs, last)


@query
def job_run_problems(m):
    return polled.run_problems(m.job_runs)


@query
def job_cost_per_day(m):
    rows = costs.job_costs(m.usage, m.prices, since=F.lit("2023-01-01").cast("date"))
    return rows.select("job_id", *text("day"), "dbus", *rounded("cost", digits=4), "currency")


@query
def workspace_cost_per_day(m):
    usage = m.usage.where("workspace_id = 1")
    rows = costs.job_costs(usage, m.prices)
    return rows.select("job_id", *text("day"), "dbus", *rounded("cost", digits=4), "currency")


@query
def probe_checks(m):
    rows = polled.probe_checks(m.probes, m.flows.select("flow", "max_latency_ms"))
    return rows.select("id", "flow", "at", "problem", "success_detail", "millis", "warning")


@query
def flow_catalogue(m):
    rows = catalogue.combined(m.flows, catalogue.registered_flows(m.registrations))
    return rows.select(
        "flow", "kind", *long("every_seconds", "grace_seconds", "job_id"), "cron",
        "cron_style", "owner", "tolerance", "max_error_rate",
    )


# sinks


@query
def settled_events(m):
    return export.settled(m.events, 1000, at("2024-01-20 12:00:00")).select("id", "flow", "at")


@query
def settled_state_changes(m):
    changes = m.changes.join(m.events.select("id", "recorded_at"), "id")
    rows = export.settled(changes, 500, at("2024-01-10 00:00:00"))
    return rows.select("id", "flow", "at", "state")


@query
def closed_minutes(m):
    return export.closed_minutes(
        m.minutes, at("2024-01-05 00:00:00"), at("2024-01-25 10:30:30")
    )


@query
def additive_upsert(m):
    old, new = m.calls.where("millis % 3 > 0"), m.calls.where("millis % 3 = 0")
    return calls.merged(calls.per_minute(old), calls.per_minute(new))


@query
def last_call_per_flow(m):
    return calls.last_call(m.minutes)


@query
def replaced_cost_window(m):
    stored = m.costs.where("job_id % 2 = 0").withColumn("cost", F.col("cost") * 2)
    fetched = m.costs.where("day >= date'2024-01-31' - 40")
    rows = costs.replaced_window(stored, fetched, AS_OF)
    return rows.select("job_id", *text("day"), "dbus", *rounded("cost", digits=4), "currency")


@query
def announced_upsert(m):
    current = m.registrations.drop("job_id")
    announced = m.registrations.where("every_seconds > 100").selectExpr(
        "if(every_seconds % 20 = 0, id, concat('new-', id)) AS id",
        "kind",
        "if(every_seconds % 30 = 0, null, every_seconds * 2) AS every_seconds",
        "cast(null AS array<string>) AS after",
        "owner",
        "if(every_seconds % 40 = 0, '0 5 * * *', null) AS cron",
        "cast(null AS array<string>) AS calendar",
        "timezone",
        "cast(null AS bigint) AS grace_seconds",
    )
    rows = catalogue.coalesced(current, announced)
    return rows.select("id", "kind", "every_seconds", "owner", "cron", "grace_seconds")


def _probe_reports(m):
    rows = polled.probe_checks(m.probes, m.flows.select("flow", "max_latency_ms"))
    polls = rows.withColumnRenamed("at", "poll_at").withColumn(
        "schema_warnings", F.expr("if(id % 4 = 0, array('schema of x changed: +y'), null)")
    )
    ok = rows.where("problem IS NULL").select(
        "id", "flow", "at", F.col("success_detail").alias("detail"), F.col("millis").cast("int").alias("millis"),
        F.lit(None).cast("map<string,double>").alias("metrics"),
    )
    return polls, ok


@query
def poll_events(m):
    return applied.report_events(*_probe_reports(m)).select(
        "flow", "at", "outcome", "detail", *long("millis")
    )


@query
def poll_state(m):
    return applied.report_state(*_probe_reports(m))


@query
def latest_listing(m):
    return files.latest_listing(m.listings, m.polls)


@query
def retained_events(m):
    return export.pruned(m.events, "at", at(AS_OF), 10).select("id", "flow", "at")


@query
def retained_state_changes(m):
    rows = m.changes.withColumn("at", F.expr("at - make_interval(0, 0, 0, cast(id % 500 AS int))"))
    return export.pruned(rows, "at", at(AS_OF), export.STATE_DAYS).select("id", "at", "state")


@query
def deduplicated_export(m):
    twice = m.events.unionByName(m.events.where("id % 5 = 0"))
    return export.deduplicated(twice, ["id"]).select("id", "flow", "at", "outcome")


@query
def gauges(m):
    return applied.gauges(_judged(m), at(AS_OF)).select(
        "gauge", "flow", "kind", "owner", "state", "value"
    )


def _decided(m):
    return alerts.alert_decisions(m.evaluations, m.silences)


def _alert_rows(m):
    last_ok = state.replayed(m.events, AS_OF).select("flow", "last_ok")
    return alerts.alert_rows(_decided(m), m.flows, last_ok, runs.last_failures(m.events))


@query
def alert_rows(m):
    return _alert_rows(m)


@query
def routed_alerts(m):
    rows = alerts.routed(_alert_rows(m), m.owners, "shared-hook", ["all@example.com"])
    return rows.select("id", "flow", "owner", "webhook", F.array_join("email", ",").alias("email"))


# filters and orders


@query
def flow_list(m):
    return lists.matching(m.flows, "heartbeat", " SOURCE 1").select("flow", "kind", "source")


@query
def glob_matches(m):
    patterns = ["*/fr/*", "https://m.*", "http://*[0-4]", "*?[!a-z]?age=*", "*[?]*", "*[/]?r[/]*", "*[!0-9]", "[abc*", "*[*]*"]
    pages = m.table("pages").select("page_id", "url")
    rows = pages.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    return rows.where(scalars.glob_match(F.col("url"), F.col("pattern"))).select(
        "page_id", "pattern"
    )


@query
def valid_ids(m):
    return m.table("part").select(
        "p_partkey",
        scalars.valid_id(F.col("p_name")).alias("name_ok"),
        scalars.valid_id(F.lower(F.regexp_replace("p_brand", "#", "-"))).alias("brand_ok"),
    )


def _acks(m):
    return m.events.where("outcome = 'fail' AND id % 3 = 0").select(
        "flow", F.col("detail").alias("note"), F.lit("someone").alias("by"), "at"
    )


@query
def unacknowledged_attention(m):
    acked = alerts.acknowledged(_acks(m), m.changes, AS_OF).select(
        "flow", F.lit(True).alias("acknowledged")
    )
    return lists.unacknowledged(_judged(m).join(acked, "flow", "left")).select("flow", "state")


@query
def period_restriction(m):
    rows = lists.within(m.events, "at", at(MONTH[0]), at(MONTH[1]), at("2024-01-20 00:00:00"))
    return rows.groupBy("flow").agg(F.count(F.lit(1)).alias("events"))


@query
def missed_targets(m):
    return lists.missed(_report(m)).select("flow", *rounded("uptime", "target"))


@query
def announced_settings(m):
    raw = m.registrations.selectExpr(
        "id", "kind",
        "concat(every_seconds, if(every_seconds % 40 = 0, ' apples', 's')) AS every",
        "if(every_seconds % 70 = 0, '1h 30m', null) AS grace",
        "if(every_seconds % 50 = 0, ' flow-1,, flow-40 ', if(every_seconds % 110 = 0, 'nobody', null)) AS after",
        "owner",
        "if(every_seconds % 90 = 0, '61 * * * *', cron) AS cron",
        "if(every_seconds % 20 = 0, 'SE, fi', null) AS calendar",
        "timezone",
    )
    rows = catalogue.announced_settings(raw, m.flows, m.owners)
    return rows.select(
        "id", *long("every_seconds", "grace_seconds"), F.array_join("after", ",").alias("after"),
        "owner", F.array_join("calendar", ",").alias("calendar"), "error",
    )


@query
def catalogue_violations(m):
    bent = m.flows.withColumns(
        {
            "tolerance": F.expr("if(position % 10 = 9, 1.0D, tolerance)"),
            "after": F.expr("""CASE position WHEN 1 THEN array('flow-3') WHEN 20 THEN array('gone')
                               ELSE after END"""),
            "cron": F.expr("if(position = 30, '0 25 * * *', cron)"),
            "timezone": F.expr(f"if(position = 31, 'Nowhere/At_All', coalesce(timezone, '{ZONE}'))"),
        }
    )
    twice = bent.unionByName(bent.where("position = 40"))
    windows = m.windows.withColumns(
        {
            "lasts_seconds": F.expr("if(name = 'window-4', 0L, lasts_seconds)"),
            "patterns": F.expr("if(name = 'window-3', array('api-[!1', 'x**', '[*]'), patterns)"),
            "timezone": F.expr("if(name = 'window-2', 'Mars/Crater', timezone)"),
        }
    )
    owners = m.owners.withColumn("email", F.expr("if(owner = 'owner-3', array('a@b.se', 'nobody at home'), email)"))
    return catalogue.violations(twice, owners, windows)


# joins


@query
def price_interval_join(m):
    rows = costs.priced_usage(m.usage, m.prices)
    return rows.groupBy("sku", "cloud").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.sum(F.col("quantity") * F.col("price")), 4).alias("cost"),
        F.max("currency").alias("currency"),
    )


@query
def status_inputs(m):
    planned = status.with_schedule(m.flows, ZONE)
    since = at("2024-01-29 12:00:00")
    rows = state.with_inputs(
        planned,
        state.replayed(m.events, AS_OF),
        calls.totals_since(m.minutes, since),
        status.due_table(planned, AS_OF, ZONE),
        costs.cost_summary(m.costs, AS_OF),
    )
    return rows.select(
        "flow", "last_ok", "running_since", "problem", "ok", "client_errors", "server_errors",
        *rounded("yesterday", "last_30_days", digits=4),
    )


@query
def undeclared_registrations(m):
    registered = catalogue.registered_flows(m.registrations)
    return registered.join(m.flows.select("flow"), "flow", "left_anti").select("flow", "kind")


@query
def previous_sightings(m):
    return files.previous_sightings(m.listings).select(
        "flow", "key", "poll_at", "size", "size_before", "modified_before"
    )


@query
def schema_differences(m):
    first = m.schemas.groupBy("flow", "table_name").agg(
        F.min_by("fields", "poll_at").alias("a"), F.max_by("fields", "poll_at").alias("b")
    )
    return first.select(
        "flow", "table_name", tables.schema_change(F.col("a"), F.col("b")).alias("change")
    )


@query
def maintenance_cover(m):
    is_open = schedules.open_windows(m.windows, AS_OF).where("is_open")
    patterns = is_open.select("name", "closes_at", F.explode("patterns").alias("pattern"))
    return maintenance.covered(m.flows.select("flow"), patterns).select(
        "flow", "name", "closes_at"
    )


@query
def state_as_of(m):
    rows = reliability.period_changes(m.changes, at("2024-01-15 00:00:00"), at("2024-01-16 00:00:00"))
    return rows.select("flow", "at", "id", "state")


@query
def late_against_schedule(m):
    planned = status.with_schedule(m.flows, ZONE).where("cron IS NOT NULL")
    due = status.due_table(planned, AS_OF, ZONE)
    last = state.replayed(m.events, AS_OF).select("flow", "last_ok")
    missed = F.col("last_ok") <= scalars.plus_seconds(F.col("previous_at"), F.col("grace_seconds"))
    return (
        planned.join(due, "schedule_id")
        .join(last, "flow")
        .select("flow", "due_at", "previous_at", "next_at", missed.alias("missed"))
    )


@query
def monitoring_coverage(m):
    jobs = m.usage.select("job_id").distinct()
    return access.coverage(jobs, m.flows)


@query
def effective_roles(m):
    return access.effective_roles(
        m.members, m.group_roles, m.user_groups, ["CUSTOMER#000000001", "boss@example.com"]
    )


@query
def upstream_links(m):
    return dependencies.links(m.flows).select("flow", *long("pos"), "upstream")


# aggregates


@query
def calls_per_minute(m):
    return m.minutes


@query
def call_totals(m):
    return calls.totals_since(m.minutes, at("2024-01-29 12:00:00"))


@query
def call_buckets(m):
    rows = m.minutes.join(m.flows.select("flow", "max_error_rate"), "flow")
    return calls.call_buckets(rows, at("2024-01-24 08:00:00"), 168)


@query
def run_counts(m):
    return reliability.run_counts(m.events, at(MONTH[0]), at("2024-01-25 00:00:00"))


def _intervals(m):
    until = at(MONTH[1])
    return reliability.intervals(
        reliability.period_changes(m.changes, at("2024-01-03 00:00:00"), until), until
    )


@query
def uptime_summary(m):
    rows = reliability.summaries(_intervals(m), at(MONTH[1]))
    return rows.select("flow", *rounded("uptime", digits=9), "incidents", "longest_outage_seconds", "mean_recovery_seconds")


@query
def daily_uptime(m):
    rows = reliability.daily_uptime(_intervals(m), ZONE)
    return rows.select("flow", *text("day"), *rounded("uptime", digits=9))


@query
def daily_uptime_arrays(m):
    rows = monthly.monthly_days(m.changes, *MONTH, "2024-01-20 12:00:00", ZONE)
    label = F.transform(
        "days", lambda u: F.when(u.isNull(), "-").otherwise(F.format_string("%.6f", F.round(u, 6)))
    )
    return rows.select("flow", F.array_join(label, ",").alias("days"))


def _report(m):
    return monthly.monthly_report(m.flows, m.changes, m.events, m.costs, *MONTH, AS_OF, ZONE)


@query
def target_verdicts(m):
    return _report(m).select("flow", "met")


@query
def fleet_tiles(m):
    rows = reliability.tiles(_report(m))
    return rows.select("missed", *rounded("mean_uptime"), "incidents", "longest_outage_seconds", *rounded("cost", digits=4))


@query
def owner_tiles(m):
    rows = reliability.tiles(_report(m), by_owner=True).orderBy(*reliability.owner_order())
    return rows.select("owner", "missed", *rounded("mean_uptime"), "incidents", "longest_outage_seconds", *rounded("cost", digits=4))


def _judged(m):
    return status.evaluated(m.flows, m.events, m.minutes, m.costs, AS_OF, ZONE)


@query
def flows_per_state(m):
    return state.per_state(_judged(m))


@query
def cost_summary(m):
    rows = costs.cost_summary(m.costs, AS_OF)
    return rows.select("job_id", *rounded("yesterday", "last_30_days", digits=4), "currency")


@query
def period_costs(m):
    rows = costs.period_costs(m.costs, at(MONTH[0]), at(MONTH[1]), ZONE)
    return rows.select("job_id", *rounded("cost", digits=4), "currency")


@query
def usual_cost(m):
    """The upper median of the fourteen days before each day."""
    from pyspark.sql import Window

    before = Window.partitionBy("job_id").orderBy("_day").rangeBetween(-14, -1)
    rows = m.costs.withColumn("_day", F.expr("cast(datediff(day, date'1970-01-01') AS bigint)"))
    rows = rows.withColumn("usual", scalars.upper_median(F.collect_list("cost").over(before)))
    return rows.select("job_id", *text("day"), *rounded("usual", digits=4))


@query
def load_summary(m):
    return tables.load_summary(m.loads)


@query
def left_out_tables(m):
    return tables.left_out(m.loads)


@query
def calls_as_events(m):
    return calls.as_events(m.minutes)


# windows


@query
def state_intervals(m):
    return _intervals(m).select("flow", "at", "id", "state", "ends")


@query
def outages(m):
    return reliability.outages(_intervals(m))


@query
def recent_runs(m):
    rows = runs.recent_rows(m.events, 50, ["at", "id"])
    return rows.select("flow", "id", "at", "outcome", "detail", *long("rank"))


@query
def recent_calls(m):
    return runs.recent_rows(m.minutes, 60, ["minute"]).select("flow", "minute", "ok", *long("rank"))


@query
def last_failures(m):
    return runs.last_failures(m.events)


@query
def run_anomalies(m):
    return runs.run_anomalies(m.events, m.flows.select("flow", "tolerance"))


@query
def latest_anomaly(m):
    return runs.latest_anomaly(m.events, m.flows.select("flow", "tolerance"))


@query
def run_pairs(m):
    return runs.run_marks(m.events).select(
        "flow", "start", "end", "outcome", "detail", *long("millis"), metric("k")
    )


@query
def run_seconds(m):
    return runs.with_seconds(m.events).select("id", metric("k"), metric("seconds"))


def _seen(m):
    return files.observations(m.listings, m.polls, m.rules)


@query
def file_observations(m):
    return _seen(m).select(
        "flow", "poll_at", "key", "size", "first_seen", "settled", "empty", "arrived", "uncollected"
    )


@query
def file_arrivals(m):
    return files.arrivals(_seen(m))


@query
def file_problems(m):
    return files.poll_problems(_seen(m))


@query
def thinned_marks(m):
    marks = m.events.where("outcome <> 'start'").select("flow", "at", "id", "outcome")
    return runs.thinned(marks, 3600)


@query
def cost_spikes(m):
    rows = costs.cost_spikes(m.costs)
    return rows.select("job_id", *text("day"), *rounded("cost", "usual", digits=4), "warning")


@query
def recorded_state_changes(m):
    return alerts.recorded_changes(m.changes).select("id", "flow", "at", "state")


@query
def schema_changes(m):
    return tables.schema_changes(m.schemas)


@query
def schema_warnings(m):
    return tables.recent_schema_warnings(tables.schema_changes(m.schemas), "2024-01-30 12:00:00")


@query
def trusted_keys(m):
    return tables.trusted_keys(m.fingerprints, m.confirmations, m.pinned)


# orders and limits


@query
def triage_order(m):
    """Rows come in order; the rank is shown so that a comparison by value sees it."""
    rank = scalars.rank_in(F.col("state"), scalars.SEVERITY)
    return lists.by_urgency(_judged(m)).select("flow", "state", rank.alias("severity"))


@query
def report_order(m):
    rows = lists.ordered_report(_report(m), "uptime", descending=True)
    keys = ["uptime", "target", "incidents", "outage", "recovery", "runs", "cost"]
    shown = [F.round(lists.report_key(k).cast("double"), 4).alias(f"by_{k}") for k in keys]
    return rows.select("flow", *shown)


@query
def newest_audit(m):
    rows = m.events.select("id", "at", F.col("flow").alias("by"), F.col("detail").alias("action"))
    return lists.newest(rows, 200)


@query
def first_names(m):
    """Five part brands of each type and how many more there are."""
    brands = m.table("part").select("p_type", "p_brand").distinct()
    listed = lists.first_with_remainder(brands, "p_type", "p_brand")
    return listed.select(
        "p_type", lists.with_remainder(F.col("first"), F.col("more")).alias("names")
    )


# set operations


@query
def carried_in_and_changes(m):
    rows = reliability.period_changes(m.changes, at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))
    return rows.groupBy("flow", "state").agg(F.count(F.lit(1)).alias("n"))


@query
def declared_and_registered(m):
    rows = catalogue.combined(m.flows, catalogue.registered_flows(m.registrations))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("flows"))


@query
def own_and_group_roles(m):
    rows = access.all_roles(m.members, m.group_roles, m.user_groups)
    return rows.groupBy("email", "role").agg(F.count(F.lit(1)).alias("n"))


@query
def field_differences(m):
    per_type = m.schemas.groupBy("flow", "table_name").agg(
        F.min_by("fields", "poll_at").alias("a"), F.max_by("fields", "poll_at").alias("b")
    )
    return per_type.select(
        "flow",
        "table_name",
        F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("added"),
        F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("dropped"),
    )


# scalar functions


@query
def duration_labels(m):
    return m.events.select("id", scalars.human_duration(F.col("id") * F.col("id") % 300000).alias("label"))


@query
def readable_numbers(m):
    rows = m.table("orders").select("o_orderkey", "o_totalprice")
    return rows.select(
        "o_orderkey",
        scalars.readable(F.col("o_totalprice")).alias("price"),
        scalars.readable(F.floor("o_totalprice").cast("double")).alias("whole"),
    )


@query
def slugs(m):
    slug = scalars.plain_slug(F.concat(F.lit(" Ö "), "p_name", F.lit(" // "), "p_brand", F.lit(" (v2)")))
    taken = F.col("p_partkey") % 3 == 0
    return m.table("part").select(
        "p_partkey",
        slug.alias("slug"),
        scalars.unique_slug(slug, taken, F.col("p_partkey")).alias("flow"),
    )


@query
def metric_maps(m):
    extra = F.create_map(F.lit("extra"), F.col("id").cast("double"), F.lit("k"), F.lit(0.0))
    return m.events.where("metrics IS NOT NULL").select(
        "id",
        F.element_at("metrics", "k").alias("k"),
        F.map_contains_key("metrics", "seconds").alias("has_seconds"),
        F.element_at(
            F.map_concat(F.map_filter("metrics", lambda k, _: k != "k"), extra), "k"
        ).alias("merged_k"),
    )


@query
def local_labels(m):
    return m.events.select(
        "id",
        scalars.local_label(F.col("at"), ZONE).alias("label"),
        scalars.local_clock(F.col("at"), ZONE).alias("clock"),
    )


@query
def month_bounds(m):
    orders = m.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    bounds = business_days.month_bounds(F.col("at"), ZONE)
    return orders.select("o_orderkey", bounds.alias("b")).select(
        "o_orderkey", F.col("b.from").alias("starts"), F.col("b.to").alias("ends")
    )


@query
def local_days(m):
    """Order counts per local day of the orders' own period, clock changes included."""
    orders = m.table("orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    day = F.to_date(F.from_utc_timestamp("at", ZONE))
    starts = business_days.local_midnight(F.col("day"), ZONE)
    ends = business_days.local_midnight(F.date_add("day", 1), ZONE)
    return (
        orders.groupBy(day.alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(
            *text("day"),
            starts.alias("starts"),
            ends.alias("ends"),
            ((F.unix_seconds(ends) - F.unix_seconds(starts)) / 3600).cast("long").alias("hours"),
            "orders",
        )
    )


@query
def deadline_calendar(m):
    planned = status.with_schedule(m.flows, ZONE).where("cron IS NOT NULL").select(
        F.col("flow").alias("schedule_id"), "cron", "cron_style",
        F.coalesce("timezone", F.lit(ZONE)).alias("timezone"), "calendar",
    )
    return schedules.deadlines(planned, "2024-03-15", "2024-07-15").withColumnRenamed(
        "schedule_id", "flow"
    )


@query
def order_business_days(m):
    """Orders per business day in Sweden and Finland."""
    dates = m.table("orders").select(F.to_date("o_orderdate").alias("date"))
    open_days = business_days.business_days(dates, ["se", "fi"], (1990, 2010))
    return open_days.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("date").alias("days")
    )


@query
def due_checks(m):
    planned = status.with_schedule(m.flows, ZONE).where("cron IS NOT NULL")
    due = status.due_table(planned, "2024-01-08 06:00:00", ZONE)
    return planned.join(due, "schedule_id").select("flow", "due_at", "previous_at", "next_at", "error")


# seldom, by rule, in one year only, and never
RARE = ["0 7 1 7 *", "30 6 29 2 *", "0 0 30 2 *", "0 0 8 1 3 ? 2020", "0 0 12 L * ?", "0 0 9 ? * 2#2", "0 30 5 15W * ?", "0 0 4 ? 3 6L"]


@query
def rare_schedules(m):
    crons = F.array(*map(F.lit, RARE))
    at = F.pmod("position", F.lit(len(RARE))).cast("int")
    planned = m.flows.select(
        F.col("flow").alias("schedule_id"),
        F.get(crons, at).alias("cron"),
        F.when(at < 3, "unix").otherwise("quartz").alias("cron_style"),
        F.lit("UTC").alias("timezone"),
        F.array().cast("array<string>").alias("calendar"),
        F.lit(1800).cast("long").alias("grace_seconds"),
    )
    return schedules.around(planned, AS_OF).withColumnRenamed("schedule_id", "flow")


@query
def open_windows(m):
    return schedules.open_windows(m.windows, AS_OF).select(
        "name", "opened_at", "closes_at", "is_open", "next_opening"
    )


@query
def status_classes(m):
    rows = m.calls.groupBy("flow").agg(
        F.count_if(scalars.status_class(F.col("status")) == "server_error").alias("server"),
        F.count(F.lit(1)).alias("total"),
    )
    return rows.select("flow", F.round(scalars.error_rate(F.col("server"), F.col("total")), 9).alias("rate"))


# flow state, dependencies, alerts


@query
def state_evaluation(m):
    return _judged(m).select("flow", "kind", "state", "detail", "last_ok")


@query
def polled_state_evaluation(m):
    """Flows that report and flows that are polled, judged together."""
    asked = F.col("kind").isin("http", "sftp", "storage", "delta")
    polled_flows = m.flows.where(asked).select("flow")
    polls, ok = _probe_reports(m)
    rows = status.evaluated(
        m.flows, m.events.join(polled_flows, "flow", "left_anti"), m.minutes, m.costs, AS_OF, ZONE,
        polls.join(polled_flows, "flow"), ok.join(polled_flows, "flow"),
    )
    return rows.select("flow", "kind", "state", "detail", "last_ok")


@query
def polled_state_from_history(m):
    """Reports and polls of the same flows in one fold."""
    polls, ok = (rows.where("id % 2 = 1") for rows in _probe_reports(m))
    return state.folded(m.events.where("id % 2 = 0"), polls, ok, "2024-01-20 00:00:00")


@query
def state_from_history(m):
    return state.replayed(m.events, "2024-01-20 00:00:00")


def _own_states(m):
    """States taken from the latest change, some of them pending, over the dependency tree."""
    last = m.changes.groupBy("flow").agg(F.max_by("state", F.struct("at", "id")).alias("state"))
    return m.flows.where("position < 100").join(last, "flow").select(
        "flow", "after", "state", F.concat(F.lit("own "), "state").alias("detail")
    )


@query
def blocked_flows(m):
    return dependencies.blocked(_own_states(m)).select("flow", "state", "detail")


@query
def dependency_cycle(m):
    bent = m.flows.withColumn(
        "after", F.expr("if(flow = 'flow-2', array('flow-1', 'flow-5'), after)")
    )
    return dependencies.cycle_report(bent)


@query
def dependency_layout(m):
    pairs = m.flows.withColumn(
        "after", F.expr("""if(position % 8 = 1 OR position < 4, cast(array() AS array<string>), after)""")
    )
    return dependencies.layout(pairs).select("component", *long("step"), "flow")


@query
def maintenance_overlay(m):
    rows = maintenance.overlaid(_own_states(m), schedules.open_windows(m.windows, AS_OF), ZONE)
    return rows.select("flow", "state", "detail")


@query
def alert_decisions(m):
    return _decided(m).select("id", "flow", "at", "state", "alerted_before", "decision")


@query
def standing_acknowledgements(m):
    return alerts.acknowledged(_acks(m), m.changes, AS_OF)


@query
def silences_in_force(m):
    return alerts.silenced_now(m.silences, "2024-01-30 12:00:00")


def _lifts(m):
    """Some silences are lifted twenty minutes after they were set."""
    return m.silences.where("unix_seconds(set_at) % 3 = 0").select("flow", F.expr("set_at + INTERVAL 20 MINUTES AS at"))


@query
def lifted_silences(m):
    return alerts.silenced_now(m.silences, "2024-01-30 12:00:00", _lifts(m))


@query
def alert_decisions_after_lifts(m):
    rows = alerts.alert_decisions(m.evaluations, m.silences, lifts=_lifts(m))
    return rows.select("id", "flow", "at", "state", "alerted_before", "decision")


@query
def flow_timeline(m):
    return timeline.timeline(m.flows, m.events, m.minutes, AS_OF, 168).select(
        "flow", "start", "end", "outcome", "detail", *long("millis")
    )


@query
def monthly_report(m):
    rows = _report(m)
    return rows.select(
        "flow", "kind", "owner", *rounded("uptime", "target", digits=9), "met", "incidents",
        "longest_outage_seconds", "mean_recovery_seconds", "runs_ok", "runs_failed",
        *rounded("cost", digits=4),
    )


@query
def current_states(m):
    rows = status.current(m.flows, m.events, m.minutes, m.costs, m.windows, AS_OF, ZONE)
    return rows.select("flow", "state", "detail")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Model(spark, folder))

    return {name: bound(build) for name, build in QUERIES.items()}
