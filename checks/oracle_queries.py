"""One statement per query that plain SQL can express."""

from __future__ import annotations

from checks.oracles import AS_OF, END, K, START, STATUS, human, label, oracle, readable, to_local, to_utc

RAW_RESULT = """CASE WHEN event_id % 17 = 0 THEN 'done' WHEN event_type = 'view' THEN 'start'
    WHEN event_type = 'error' THEN CAST(event_id % 4 + 1 AS VARCHAR) WHEN event_type = 'click' THEN '00'
    WHEN event_type = 'signup' THEN '+0' ELSE '0' END"""
oracle("run_reports", f"""SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow, ts AS at,
    CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'ok' END AS outcome,
    CASE event_type WHEN 'view' THEN 'started' WHEN 'error' THEN 'exited with code ' || (event_id % 4 + 1)
        ELSE 'exit 0' END AS detail,
    CASE WHEN event_type <> 'view' AND event_id % 13 <> 0 THEN {K} END AS k FROM events
    WHERE event_id % 11 <> 0 AND event_id % 17 <> 0 AND (event_id % 13 = 0 OR event_id % 19 <> 0)""")
oracle("refused_reports", f"""SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow, {RAW_RESULT} AS result,
    CASE WHEN event_id % 11 = 0 THEN 'the body is not an object whose values are numbers'
        WHEN event_id % 13 <> 0 AND event_id % 19 = 0 THEN 'at most 20 metrics, each with a plain name'
        ELSE 'the result is neither start nor an exit code' END AS refusal FROM events
    WHERE event_id % 11 = 0 OR event_id % 17 = 0 OR (event_id % 13 <> 0 AND event_id % 19 = 0)""")
oracle("strict_reports", """SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow,
    'the body is not an object whose values are numbers' AS refusal FROM events WHERE event_id % 6 <> 5""")
oracle("call_reports", f"""SELECT flow, CAST(status AS BIGINT) AS status, count(*) AS calls, CAST(sum(millis) AS BIGINT) AS millis FROM (
    SELECT 'api-' || (user_id % 20) AS flow, {STATUS} AS status, CASE event_id % 3
        WHEN 0 THEN CAST(floor(value) AS BIGINT) WHEN 1 THEN 0 ELSE 86400000 END AS millis FROM events
    UNION ALL SELECT 'api-' || (user_id % 20), 200, 0 FROM events WHERE event_id % 3 = 0) GROUP BY 1, 2""")
oracle("refused_calls", """SELECT 'api-' || (user_id % 20) AS flow, ts AS at,
    'not a call or a list of calls, each with a status' AS refusal FROM events WHERE epoch_us(ts) // 1000000 % 7 = 0""")
oracle("table_log_inventory", """SELECT table_name, version, committed_at, CASE WHEN nn = files THEN rows END AS rows,
    files, bytes, fields FROM (
    SELECT 't' || (o_custkey % 20) AS table_name, max(o_orderkey) AS version, max_by(o_orderdate, o_orderkey) AS committed_at,
        CASE WHEN min(o_orderkey) FILTER (WHERE o_orderkey < 500) IS NOT NULL THEN 'id:long,v:string' END AS fields
    FROM orders GROUP BY 1) a
    JOIN (SELECT table_name, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes,
        CAST(sum(n) AS BIGINT) AS rows, count(n) AS nn FROM (
        SELECT *, CASE WHEN o_orderkey % 997 <> 0 THEN o_orderkey % 1000 END AS n FROM (
        SELECT 't' || (o_custkey % 20) AS table_name, *, row_number() OVER (PARTITION BY o_custkey % 20, o_orderkey % 200 ORDER BY o_orderkey DESC) AS r
        FROM orders WHERE o_orderkey >= 500) WHERE r = 1 AND o_orderstatus <> 'F') GROUP BY 1) b USING (table_name)""")
oracle("completed_job_runs", """SELECT job_id, make_timestamp(end_ms * 1000) AS at, 'run ' || run_id AS detail,
    (end_ms - start_ms) // 1000 AS seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms DESC, run_id DESC) AS r,
        max(end_ms) OVER (PARTITION BY job_id) AS last FROM jr)
    WHERE result_state = 'SUCCESS' AND end_ms > last - 86400000::BIGINT * 200""")
oracle("job_run_problems", """SELECT job_id, 'run ' || run_id || ' ' || lower(coalesce(result_state, 'unknown')) || ': ' || message AS problem
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms DESC, run_id DESC) AS r FROM jr)
    WHERE r = 1 AND result_state IS DISTINCT FROM 'SUCCESS'""")
DAY = "CAST(day AS VARCHAR) AS day"
oracle("job_cost_per_day", f"""SELECT job_id, {DAY}, dbus, round(cost, 4) AS cost, currency FROM jc WHERE day >= DATE '2023-01-01'""")
oracle("workspace_cost_per_day", f"""SELECT job_id, {DAY}, sum(quantity) AS dbus, round(sum(quantity * price), 4) AS cost,
    max(currency) AS currency FROM pu WHERE workspace_id = 1 GROUP BY job_id, pu.day""")
oracle("probe_checks", """SELECT id, flow, at, problem, CASE WHEN problem IS NULL THEN 'http ' || status END AS success_detail,
    CASE WHEN problem IS NULL THEN elapsed_ms END AS millis, warning FROM pc""")
oracle("flow_catalogue", "SELECT flow, kind, every_seconds, grace_seconds, job_id, cron, cron_style, owner, tolerance, max_error_rate FROM ct")

oracle("settled_events", """SELECT id, flow, at FROM ev WHERE id > 1000 AND id < coalesce((SELECT min(id) FROM ev
    WHERE id > 1000 AND recorded_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 MINUTE), 9223372036854775807)""")
oracle("settled_state_changes", """SELECT id, flow, at, state FROM sc WHERE id > 500 AND id < coalesce((SELECT min(id) FROM ev
    WHERE id > 500 AND recorded_at > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 MINUTE), 9223372036854775807)""")
oracle("closed_minutes", """SELECT * FROM mi WHERE minute > TIMESTAMP '2024-01-05 00:00:00' AND minute < TIMESTAMP '2024-01-25 10:29:00'""")
oracle("additive_upsert", "SELECT * FROM mi")
oracle("last_call_per_flow", "SELECT flow, max(minute) AS last_ok FROM mi GROUP BY 1")
oracle("replaced_cost_window", f"""SELECT job_id, {DAY}, dbus, round(cost * 2, 4) AS cost, currency FROM jc
    WHERE job_id % 2 = 0 AND day < DATE '2024-01-31' - 40
    UNION ALL SELECT job_id, {DAY}, dbus, round(cost, 4), currency FROM jc WHERE day >= DATE '2024-01-31' - 40""")
oracle("announced_upsert", """SELECT coalesce(r.id, a.id) AS id, coalesce(r.kind, a.kind) AS kind,
    coalesce(a.every_seconds, r.every_seconds, 86400) AS every_seconds, coalesce(a.owner, r.owner) AS owner,
    coalesce(a.cron, r.cron) AS cron, r.grace_seconds FROM rg r FULL JOIN (
    SELECT CASE WHEN every_seconds % 20 = 0 THEN id ELSE 'new-' || id END AS id, kind,
        CASE WHEN every_seconds % 30 <> 0 THEN every_seconds * 2 END AS every_seconds, owner,
        CASE WHEN every_seconds % 40 = 0 THEN '0 5 * * *' END AS cron FROM rg WHERE every_seconds > 100) a ON r.id = a.id""")
oracle("poll_events", """SELECT flow, at, 'ok' AS outcome, 'http ' || status AS detail, elapsed_ms AS millis FROM pc WHERE problem IS NULL
    UNION ALL SELECT flow, at, 'fail', problem, NULL FROM (
    SELECT *, lag(problem) OVER (PARTITION BY flow ORDER BY at) AS before FROM pc)
    WHERE problem IS NOT NULL AND problem IS DISTINCT FROM before""")
oracle("poll_state", """SELECT flow, last_ok, problem, nullif(concat_ws('; ', warning,
    CASE WHEN id % 4 = 0 THEN 'schema of x changed: +y' END), '') AS check_warning FROM (
    SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC) AS r,
        max(CASE WHEN problem IS NULL THEN at END) OVER (PARTITION BY flow) AS last_ok FROM pc) WHERE r = 1""")
oracle("latest_listing", """SELECT flow, poll_at, key, name, modified, size FROM li
    WHERE (flow, poll_at) IN (SELECT flow, max(poll_at) FROM li GROUP BY flow)""")
oracle("retained_events", f"SELECT id, flow, at FROM ev WHERE at >= {AS_OF} - INTERVAL 10 DAY")
oracle("retained_state_changes", f"""SELECT * FROM (SELECT id, at - to_days(CAST(id % 500 AS INTEGER)) AS at, state FROM sc)
    WHERE at >= {AS_OF} - INTERVAL 400 DAY""")
oracle("deduplicated_export", "SELECT id, flow, at, outcome FROM ev")
oracle("gauges", f"""SELECT 'flow_state' AS gauge, flow, kind, owner, state, 1::DOUBLE AS value FROM es
    UNION ALL SELECT 'last_ok_age_seconds', flow, NULL, NULL, NULL, age::DOUBLE FROM es WHERE last_ok IS NOT NULL
    UNION ALL SELECT 'flows', NULL, NULL, NULL, s, count(flow)::DOUBLE FROM
    (SELECT unnest(['ok', 'warning', 'late', 'failed', 'pending', 'blocked', 'maintenance']) AS s) LEFT JOIN es ON state = s GROUP BY s""")

oracle("flow_list", "SELECT flow, kind, source FROM fl WHERE kind = 'heartbeat' AND lower(source) LIKE '%source 1%'")
oracle("glob_matches", """SELECT page_id, pattern FROM pages,
    (SELECT unnest(['*/fr/*', 'https://m.*', 'http://*[0-4]', '*?[!a-z]?age=*', '*[?]*', '*[/]?r[/]*', '*[!0-9]', '[abc*', '*[*]*']) AS pattern)
    WHERE url GLOB pattern""")
oracle("valid_ids", """SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9._-]{1,64}') AS name_ok,
    regexp_full_match(lower(replace(p_brand, '#', '-')), '[a-z0-9._-]{1,64}') AS brand_ok FROM part""")
oracle("unacknowledged_attention", "SELECT flow, state FROM es WHERE state IN ('warning', 'late', 'failed') AND flow NOT IN (SELECT flow FROM as_)")
oracle("period_restriction", f"SELECT flow, count(*) AS events FROM ev WHERE at >= {START} AND at < TIMESTAMP '2024-01-20' GROUP BY 1")
oracle("missed_targets", "SELECT flow, round(uptime, 6) AS uptime, round(target, 6) AS target FROM re WHERE met = FALSE")
oracle("announced_settings", """SELECT id, CASE WHEN every_seconds % 40 <> 0 THEN every_seconds END AS every_seconds,
    CASE WHEN every_seconds % 70 = 0 THEN 5400::BIGINT END AS grace_seconds,
    CASE WHEN every_seconds % 50 = 0 THEN 'flow-1,flow-40' WHEN every_seconds % 110 = 0 THEN 'nobody' END AS "after",
    CASE WHEN owner IN ('owner-1', 'owner-2', 'owner-3') THEN owner END AS owner,
    CASE WHEN every_seconds % 20 = 0 THEN 'se,fi' END AS calendar,
    CASE WHEN every_seconds % 40 = 0 THEN 'every: not a duration: ' || every_seconds || ' apples'
        WHEN every_seconds < 60 THEN 'every: at least 60s'
        WHEN every_seconds % 90 = 0 THEN 'cron "61 * * * *"'
        WHEN every_seconds % 50 <> 0 AND every_seconds % 110 = 0 THEN 'after: unknown flow nobody'
        WHEN every_seconds % 50 = 0 AND id IN ('flow-10', 'flow-20', 'flow-5')
            THEN 'after: that would make a circle' END AS error FROM rg""")
ORDER = "(PARTITION BY flow ORDER BY at, id)"

oracle("price_interval_join", "SELECT sku, cloud, count(*) AS records, round(sum(quantity * price), 4) AS cost, max(currency) AS currency FROM pu GROUP BY 1, 2")
oracle("cost_summary", f"""SELECT job_id, round(coalesce(sum(cost) FILTER (WHERE day = DATE '2024-01-30'), 0), 4) AS yesterday,
    round(sum(cost), 4) AS last_30_days, max(currency) AS currency FROM jc
    WHERE day >= DATE '2024-01-31' - 30 AND day < DATE '2024-01-31' GROUP BY 1""")
oracle("status_inputs", """SELECT fl.flow, e.last_ok, running_since, problem, coalesce(ok, 0) AS ok,
    coalesce(client_errors, 0) AS client_errors, coalesce(server_errors, 0) AS server_errors, yesterday, last_30_days FROM fl
    LEFT JOIN (SELECT flow, last_ok AS any_ok, running_since, problem FROM st) s USING (flow)
    LEFT JOIN (SELECT flow, max(at) AS last_ok FROM ev WHERE outcome = 'ok' GROUP BY flow) e USING (flow)
    LEFT JOIN (SELECT flow, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(client_errors) AS BIGINT) AS client_errors,
        CAST(sum(server_errors) AS BIGINT) AS server_errors FROM mi WHERE minute >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1) c USING (flow)
    LEFT JOIN (SELECT job_id, round(coalesce(sum(cost) FILTER (WHERE day = DATE '2024-01-30'), 0), 4) AS yesterday,
        round(sum(cost), 4) AS last_30_days FROM jc WHERE day >= DATE '2024-01-31' - 30 AND day < DATE '2024-01-31' GROUP BY 1) j USING (job_id)""")
oracle("undeclared_registrations", "SELECT flow, kind FROM rf WHERE flow NOT IN (SELECT flow FROM fl)")
oracle("previous_sightings", """SELECT flow, key, poll_at, size, lag(size) OVER w AS size_before, lag(modified) OVER w AS modified_before
    FROM li WINDOW w AS (PARTITION BY flow, key ORDER BY poll_at)""")


def change(a: str, b: str, at: str, bt: str) -> str:
    return f"""nullif(array_to_string(list_concat(list_concat(
        list_transform(list_sort(list_filter({b}, lambda x: NOT list_contains({a}, x))), lambda x: '+' || x),
        list_transform(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), lambda x: '-' || x)),
        list_transform(list_sort(list_filter({b}, lambda x: list_contains({a}, x) AND {at} <> {bt})),
            lambda x: x || ' ' || {at} || ' to ' || {bt})), ', '), '')"""


ENDS = """(SELECT flow, table_name, min_by(names, poll_at) AS a, max_by(names, poll_at) AS b,
    min_by(type, poll_at) AS ta, max_by(type, poll_at) AS tb FROM so GROUP BY 1, 2)"""
oracle("schema_differences", f"SELECT flow, table_name, {change('a', 'b', 'ta', 'tb')} AS change FROM {ENDS}")
oracle("field_differences", f"""SELECT flow, table_name,
    array_to_string(list_sort(list_filter(fb, lambda x: NOT list_contains(fa, x))), ',') AS added,
    array_to_string(list_sort(list_filter(fa, lambda x: NOT list_contains(fb, x))), ',') AS dropped
    FROM (SELECT flow, table_name, list_transform(a, lambda x: x || ':' || ta) AS fa,
        list_transform(b, lambda x: x || ':' || tb) AS fb FROM {ENDS})""")
CHANGES = f"""(SELECT flow, table_name, poll_at AS changed_at, {change('p_names', 'names', 'p_type', 'type')} AS change FROM (
    SELECT *, lag(names) OVER w AS p_names, lag(type) OVER w AS p_type FROM so
    WINDOW w AS (PARTITION BY flow, table_name ORDER BY poll_at)) WHERE p_names IS NOT NULL)"""
oracle("schema_changes", f"SELECT * FROM {CHANGES} WHERE change IS NOT NULL")
oracle("schema_warnings", f"""SELECT flow, table_name, 'schema of ' || CASE WHEN table_name = '' THEN 'the table' ELSE table_name END
    || ' changed: ' || max_by(change, changed_at) AS warning FROM {CHANGES} WHERE change IS NOT NULL GROUP BY 1, 2
    HAVING max(changed_at) > TIMESTAMP '2024-01-29 12:00:00'""")
oracle("maintenance_cover", "SELECT flow, name, closes_at FROM cv")
oracle("state_as_of", """SELECT flow, TIMESTAMP '2024-01-15' AS at, id, state FROM (
        SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC, id DESC) AS r FROM sc WHERE at < TIMESTAMP '2024-01-15') WHERE r = 1
    UNION ALL SELECT flow, at, id, state FROM sc WHERE at >= TIMESTAMP '2024-01-15' AND at < TIMESTAMP '2024-01-16'""")
oracle("late_against_schedule", """SELECT flow, due_at, previous_at, next_at, last_ok <= previous_at + INTERVAL 30 MINUTE AS missed
    FROM du JOIN (SELECT flow, max(at) AS last_ok FROM ev WHERE outcome = 'ok' GROUP BY flow) USING (flow)""")
oracle("monitoring_coverage", """SELECT DISTINCT us.job_id, monitored_as FROM us LEFT JOIN (
    SELECT job_id, min_by(flow, n) AS monitored_as FROM fl WHERE kind = 'databricks' GROUP BY 1) w ON us.job_id = w.job_id""")
oracle("effective_roles", """SELECT email, max_by(role, rank) AS role FROM (SELECT email, role,
    CASE role WHEN 'viewer' THEN 0 WHEN 'operator' THEN 1 WHEN 'editor' THEN 2 ELSE 3 END AS rank FROM (
    SELECT * FROM rl UNION ALL VALUES ('customer#000000001', 'admin'), ('boss@example.com', 'admin'))) GROUP BY 1""")
oracle("own_and_group_roles", "SELECT email, role, count(*) AS n FROM rl GROUP BY 1, 2")
oracle("upstream_links", "SELECT flow, 0::BIGINT AS pos, upstream FROM fl WHERE upstream IN (SELECT flow FROM fl)")

oracle("calls_per_minute", "SELECT * FROM mi")
oracle("call_totals", """SELECT flow, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(client_errors) AS BIGINT) AS client_errors,
    CAST(sum(server_errors) AS BIGINT) AS server_errors FROM mi WHERE minute >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1""")
BUCKETS = """(SELECT flow, make_timestamp((epoch_us(minute) // 1000000 // 1008 * 1008) * 1000000) AS start,
    CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(client_errors) AS BIGINT) AS ce, CAST(sum(server_errors) AS BIGINT) AS se_,
    CAST(sum(total_millis) AS BIGINT) AS tm FROM mi WHERE minute >= TIMESTAMP '2024-01-24 08:00:00' GROUP BY 1, 2)"""
BUCKET = """flow, start, CASE WHEN se_::DOUBLE / (ok + ce + se_) > 0.3 THEN 'fail' ELSE 'ok' END AS outcome,
    (ok + ce + se_) || ' calls, ' || ce || ' client errors, ' || se_ || ' server errors' AS detail,
    tm // (ok + ce + se_) AS millis"""
oracle("call_buckets", f"SELECT {BUCKET} FROM {BUCKETS}")
oracle("run_counts", f"""SELECT flow, count(*) FILTER (WHERE outcome = 'ok') AS runs_ok, count(*) FILTER (WHERE outcome = 'fail') AS runs_failed
    FROM ev WHERE at >= {START} AND at < TIMESTAMP '2024-01-25' GROUP BY 1""")
oracle("uptime_summary", "SELECT flow, round(uptime, 9) AS uptime, incidents, longest_outage_seconds, mean_recovery_seconds FROM su")


def daily(intervals: str) -> str:
    return f"""(SELECT flow, d AS day, CASE WHEN m // 1000000 > 0 THEN (u // 1000000)::DOUBLE / (m // 1000000) END AS uptime FROM (
    SELECT flow, d, CAST(sum(n) AS BIGINT) AS m, CAST(sum(CASE WHEN state IN ('ok', 'warning') THEN n ELSE 0 END) AS BIGINT) AS u FROM (
        SELECT flow, state, dd.d, epoch_us(least(ends, {to_utc("(dd.d + INTERVAL 1 DAY)")})) - epoch_us(greatest(at, {to_utc("dd.d::TIMESTAMP")})) AS n
        FROM {intervals} JOIN dd ON at < {to_utc("(dd.d + INTERVAL 1 DAY)")} AND ends > {to_utc("dd.d::TIMESTAMP")}
        WHERE state NOT IN ('pending', 'maintenance') AND at < ends) GROUP BY 1, 2))"""


oracle("daily_uptime", f"SELECT flow, CAST(day AS VARCHAR) AS day, round(uptime, 9) AS uptime FROM {daily('iv')}")
CUT = "TIMESTAMP '2024-01-20 12:00:00'"
CUT_INTERVALS = f"""(SELECT flow, state, at, coalesce(lead(at) OVER (PARTITION BY flow ORDER BY at, id), {CUT}) AS ends FROM sc
    WHERE at >= {START} AND at < {CUT})"""
oracle("daily_uptime_arrays", f"""SELECT f.flow, string_agg(coalesce(printf('%.6f', round(uptime, 6)), '-'), ',' ORDER BY d) AS days
    FROM (SELECT DISTINCT flow FROM sc WHERE at < {CUT}) f, (SELECT d AS d FROM dd WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') days
    LEFT JOIN {daily(CUT_INTERVALS)} u ON u.flow = f.flow AND u.day = days.d GROUP BY 1""")
oracle("target_verdicts", "SELECT flow, met FROM re")
TILES = """count(*) FILTER (WHERE met = FALSE) AS missed, round(avg(uptime), 6) AS mean_uptime, CAST(sum(incidents) AS BIGINT) AS incidents,
    max(longest_outage_seconds) AS longest_outage_seconds, round(coalesce(sum(cost), 0), 4) AS cost"""
oracle("fleet_tiles", f"SELECT {TILES} FROM re")
oracle("owner_tiles", f"SELECT coalesce(owner, 'no owner') AS owner, {TILES} FROM re GROUP BY 1")
oracle("flows_per_state", """SELECT s AS state, count(flow) AS flows FROM
    (SELECT unnest(['ok', 'warning', 'late', 'failed', 'pending', 'blocked', 'maintenance']) AS s) LEFT JOIN es ON state = s GROUP BY s""")
oracle("period_costs", """SELECT job_id, round(sum(cost), 4) AS cost, max(currency) AS currency FROM jc
    WHERE day >= DATE '2024-01-01' AND day < DATE '2024-02-01' GROUP BY 1""")
oracle("usual_cost", f"SELECT job_id, {DAY}, round(list_sort(h)[len(h) // 2 + 1], 4) AS usual FROM ch")
NEWEST = """max(committed_at) AS at, count(*) AS n, max_by(table_name, (committed_at, table_name)) AS t,
    max_by(version, (committed_at, table_name)) AS v"""
oracle("load_summary", f"""SELECT flow, at, CASE WHEN n = 1 THEN 'version ' || v ELSE n || ' tables, newest ' || t || ' at version ' || v END AS detail,
    files, bytes, rows, CASE WHEN n > 1 THEN n END AS tables FROM (SELECT flow, {NEWEST}, CAST(sum(files) AS BIGINT) AS files,
    CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN count(rows) = count(*) THEN CAST(sum(rows) AS BIGINT) END AS rows FROM ld GROUP BY 1)""")
oracle("left_out_tables", """SELECT flow, 'not in the latest load: ' || array_to_string(names[1:5], ', ')
    || CASE WHEN len(names) > 5 THEN ' and ' || (len(names) - 5) || ' more' ELSE '' END AS warning FROM (
    SELECT flow, list(table_name ORDER BY table_name) AS names FROM (SELECT *, max(committed_at) OVER (PARTITION BY flow) AS newest FROM ld)
    WHERE newest - committed_at > INTERVAL 6 HOUR GROUP BY 1)""")
oracle("calls_as_events", """SELECT flow, minute AS at, CASE WHEN server_errors > 0 THEN 'fail' ELSE 'ok' END AS outcome,
    (ok + client_errors + server_errors) || ' calls, ' || client_errors || ' client errors, ' || server_errors || ' server errors' AS detail,
    total_millis // (ok + client_errors + server_errors) AS millis FROM mi""")

oracle("state_intervals", "SELECT flow, at, id, state, ends FROM iv")
oracle("outages", "SELECT * FROM ou")
oracle("recent_runs", """SELECT flow, id, at, outcome, detail, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC, id DESC) AS rank FROM ev) WHERE rank <= 50""")
oracle("recent_calls", """SELECT flow, minute, ok, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY flow ORDER BY minute DESC) AS rank FROM mi) WHERE rank <= 60""")
oracle("last_failures", "SELECT flow, max(at) AS failed_at FROM ev WHERE outcome = 'fail' GROUP BY 1")
oracle("run_anomalies", "SELECT flow, id, at, string_agg(finding, '; ' ORDER BY name) AS anomaly FROM mf GROUP BY 1, 2, 3")
oracle("latest_anomaly", "SELECT f.flow, anomaly FROM (SELECT DISTINCT flow FROM mr) f LEFT JOIN an USING (flow)")
PAIRS = f"""(SELECT *, lag(outcome) OVER w AS was, lag(at) OVER w AS was_at, lead(outcome) OVER w AS nxt FROM {{}} WINDOW w AS {ORDER})"""
PAIR = """flow, CASE WHEN outcome <> 'start' AND was = 'start' THEN was_at ELSE at END AS start,
    CASE WHEN outcome <> 'start' THEN at END AS "end",
    CASE WHEN outcome <> 'start' THEN outcome WHEN nxt IS NULL THEN 'running' ELSE 'unfinished' END AS outcome,
    CASE WHEN outcome = 'start' AND nxt IS NOT NULL THEN 'never reported an exit code' ELSE detail END AS detail,
    CASE WHEN outcome <> 'start' THEN CASE WHEN was = 'start' THEN
        CASE WHEN (epoch_us(at) - epoch_us(was_at)) // 1000 < 2147483648 THEN (epoch_us(at) - epoch_us(was_at)) // 1000 END
        ELSE 0 END END AS millis"""
KEPT = "outcome <> 'start' OR nxt IS NULL OR nxt = 'start'"
oracle("run_pairs", f"SELECT {PAIR}, CASE WHEN outcome <> 'start' THEN k END AS k FROM {PAIRS.format('ev')} WHERE {KEPT}")
oracle("run_seconds", f"""SELECT id, CASE WHEN outcome <> 'start' THEN k END AS k, CASE WHEN outcome <> 'start' AND was = 'start'
    THEN round((epoch_us(at) - epoch_us(was_at)) / 1e6) END AS seconds FROM {PAIRS.format('ev')}""")
oracle("file_observations", "SELECT flow, poll_at, key, size, first_seen, settled, empty, arrived, uncollected FROM se")
oracle("file_arrivals", "SELECT flow, first_seen AS at, name AS detail, size::DOUBLE AS bytes, poll_at FROM se WHERE arrived")
oracle("file_problems", """SELECT flow, poll_at, coalesce('empty file: ' || min(name) FILTER (WHERE empty),
    'not collected after 1d: ' || min(name) FILTER (WHERE uncollected)) AS problem FROM se WHERE empty OR uncollected GROUP BY 1, 2""")
oracle("thinned_marks", """SELECT flow, at, id, outcome FROM (SELECT *, row_number() OVER (
    PARTITION BY flow, outcome, epoch_us(at) // 3600000000 ORDER BY at, id) AS r FROM ev WHERE outcome <> 'start') WHERE outcome <> 'ok' OR r = 1""")
oracle("cost_spikes", f"SELECT job_id, {DAY}, round(cost, 4) AS cost, round(usual, 4) AS usual, warning FROM cs")
oracle("recorded_state_changes", f"""SELECT id, flow, at, state FROM (SELECT *, lag(state) OVER {ORDER} AS was FROM sc)
    WHERE was IS DISTINCT FROM state""")
oracle("trusted_keys", """SELECT flow, trusted, CASE WHEN last <> trusted THEN last END AS pending FROM (
    SELECT flow, coalesce(CASE WHEN CAST(split_part(flow, '-', 2) AS INTEGER) % 10 = 3 THEN 'K1' END, confirmed, first) AS trusted, last FROM (
    SELECT fp.flow, min_by(fingerprint, seen_at) AS first, max_by(fingerprint, seen_at) AS last,
        max_by(fingerprint, seen_at) FILTER (WHERE seen_at <= c.at) AS confirmed FROM fp LEFT JOIN (
        SELECT 'flow-' || (user_id % 50) AS flow, max(ts) AS at FROM events WHERE event_type = 'signup' AND event_id % 5 = 0 GROUP BY 1) c
        ON fp.flow = c.flow GROUP BY 1))""")

oracle("triage_order", """SELECT flow, state, CASE state WHEN 'failed' THEN 0 WHEN 'late' THEN 1 WHEN 'warning' THEN 2
    WHEN 'blocked' THEN 3 WHEN 'maintenance' THEN 4 WHEN 'pending' THEN 5 ELSE 6 END AS severity FROM es ORDER BY severity, flow""")
oracle("report_order", """SELECT flow, round(coalesce(uptime, 2), 4) AS by_uptime, CASE met WHEN FALSE THEN 0 WHEN TRUE THEN 1 ELSE 2 END::DOUBLE AS by_target,
    incidents::DOUBLE AS by_incidents, longest_outage_seconds::DOUBLE AS by_outage, coalesce(mean_recovery_seconds, -1)::DOUBLE AS by_recovery,
    runs_failed::DOUBLE AS by_runs, round(coalesce(cost, -1), 4) AS by_cost FROM re ORDER BY coalesce(uptime, 2) DESC, flow""")
oracle("newest_audit", 'SELECT id, at, flow AS "by", detail AS action FROM ev ORDER BY at DESC, id DESC LIMIT 200')
oracle("first_names", """SELECT p_type, array_to_string(b[1:5], ', ') || CASE WHEN len(b) > 5 THEN ' and ' || (len(b) - 5) || ' more' ELSE '' END AS names
    FROM (SELECT p_type, list(DISTINCT p_brand ORDER BY p_brand) AS b FROM part GROUP BY 1)""")
oracle("carried_in_and_changes", """SELECT flow, state, count(*) AS n FROM (SELECT flow, state FROM (
        SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC, id DESC) AS r FROM sc WHERE at < TIMESTAMP '2024-01-10') WHERE r = 1
    UNION ALL SELECT flow, state FROM sc WHERE at >= TIMESTAMP '2024-01-10' AND at < TIMESTAMP '2024-01-20') GROUP BY 1, 2""")
oracle("declared_and_registered", "SELECT kind, count(*) AS flows FROM ct GROUP BY 1")

oracle("duration_labels", f"SELECT id, {human('(id * id % 300000)')} AS label FROM ev")
oracle("readable_numbers", f"SELECT o_orderkey, {readable('o_totalprice')} AS price, {readable('floor(o_totalprice)')} AS whole FROM orders")
SLUG = "'o-' || trim(regexp_replace(lower(p_name || ' // ' || p_brand || ' (v2)'), '[^a-z0-9]+', '-', 'g'), '-')"
oracle("slugs", f"""SELECT p_partkey, slug, CASE WHEN p_partkey % 3 = 0 THEN slug || '-' || p_partkey ELSE slug END AS flow
    FROM (SELECT p_partkey, {SLUG} AS slug FROM part)""")
oracle("metric_maps", "SELECT id, k, FALSE AS has_seconds, 0::DOUBLE AS merged_k FROM ev WHERE outcome <> 'start'")
oracle("local_labels", f"SELECT id, {label('at')} AS label, lower(strftime({to_local('at')}, '%a %H:%M')) AS clock FROM ev")
MONTH_START = f"date_trunc('month', {to_local('o_orderdate')})"
oracle("month_bounds", f"""SELECT o_orderkey, {to_utc(f"CAST({MONTH_START} AS TIMESTAMP)")} AS starts,
    {to_utc(f"CAST({MONTH_START} + INTERVAL 1 MONTH AS TIMESTAMP)")} AS ends FROM orders""")
oracle("local_days", f"""SELECT CAST(d AS VARCHAR) AS day, starts, ends, (epoch_us(ends) - epoch_us(starts)) // 3600000000 AS hours, orders FROM (
    SELECT d, {to_utc("d::TIMESTAMP")} AS starts, {to_utc("(d + INTERVAL 1 DAY)")} AS ends, orders FROM (
    SELECT CAST({to_local("o_orderdate")} AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1))""")
oracle("deadline_calendar", """SELECT flow, at AS due_at, lag(at) OVER w AS previous_at, lead(at) OVER w AS next_at
    FROM fl JOIN oc ON fl.n % 9 = oc.k WHERE cron IS NOT NULL AND d BETWEEN DATE '2024-03-15' AND DATE '2024-07-15'
    WINDOW w AS (PARTITION BY flow ORDER BY at)""")
_SAME = "make_date(year(d), month(d), 15)"
oracle("rare_schedules", f"""SELECT * FROM (WITH days AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2060-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
    hits AS (SELECT 0 AS k, d + INTERVAL 7 HOUR AS at FROM days WHERE month(d) = 7 AND day(d) = 1
      UNION ALL SELECT 1, d + INTERVAL 390 MINUTE FROM days WHERE month(d) = 2 AND day(d) = 29
      UNION ALL SELECT 3, TIMESTAMP '2020-03-01 08:00:00'
      UNION ALL SELECT 4, d + INTERVAL 12 HOUR FROM days WHERE d = last_day(d)
      UNION ALL SELECT 5, d + INTERVAL 9 HOUR FROM days WHERE isodow(d) = 1 AND day(d) BETWEEN 8 AND 14
      UNION ALL SELECT 6, d + INTERVAL 330 MINUTE FROM days
        WHERE d = {_SAME} + CAST(CASE isodow({_SAME}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS INTEGER)
      UNION ALL SELECT 7, d + INTERVAL 4 HOUR FROM days WHERE month(d) = 3 AND isodow(d) = 5 AND day(d) > 24),
    due AS (SELECT k, at, row_number() OVER (PARTITION BY k ORDER BY at DESC) AS r FROM hits WHERE at <= {AS_OF} - INTERVAL 30 MINUTE)
    SELECT flow, max(due.at) FILTER (WHERE r = 1) AS due_at, max(due.at) FILTER (WHERE r = 2) AS previous_at,
      (SELECT min(at) FROM hits WHERE hits.k = fl.n % 8 AND at > {AS_OF}) AS next_at,
      CASE WHEN fl.n % 8 = 2 THEN 'never occurs' END AS error
    FROM fl LEFT JOIN due ON due.k = fl.n % 8 GROUP BY flow, fl.n)""")
CHECK = "TIMESTAMP '2024-01-08 06:00:00'"
oracle("due_checks", f"""SELECT flow, max(at) FILTER (WHERE r = 1) AS due_at, max(at) FILTER (WHERE r = 2) AS previous_at, min(nx) AS next_at,
    NULL::VARCHAR AS error FROM (
    SELECT flow, at, row_number() OVER (PARTITION BY flow ORDER BY at DESC) AS r, NULL::TIMESTAMP AS nx
    FROM fl JOIN oc ON fl.n % 9 = oc.k WHERE cron IS NOT NULL AND at <= {CHECK} - INTERVAL 30 MINUTE
    UNION ALL SELECT flow, NULL, 0, min(at) FROM fl JOIN oc ON fl.n % 9 = oc.k WHERE cron IS NOT NULL AND at > {CHECK} GROUP BY flow) GROUP BY 1""")
# Easter Sundays of the orders' years are given, everything else follows from the calendar
OFF = """(SELECT unnest([e - 2, e, e + 1, e + 39, e + 49, make_date(y, 1, 1), make_date(y, 1, 6), make_date(y, 5, 1), make_date(y, 6, 6),
    make_date(y, 12, 6), make_date(y, 12, 24), make_date(y, 12, 25), make_date(y, 12, 26), make_date(y, 12, 31),
    make_date(y, 6, 19) + CAST((12 - isodow(make_date(y, 6, 19))) % 7 AS INTEGER)]) FROM (VALUES (1995, DATE '1995-04-16'),
    (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'),
    (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')) t(y, e))"""
oracle("order_business_days", f"""SELECT year(d) AS year, count(*) AS orders, count(DISTINCT d) AS days FROM
    (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE isodow(d) <= 5 AND d NOT IN {OFF} GROUP BY 1""")
oracle("open_windows", "SELECT name, opened_at, closes_at, is_open, next_opening FROM wn")
oracle("status_classes", "SELECT flow, round(count(*) FILTER (WHERE status >= 500)::DOUBLE / count(*), 9) AS rate FROM cl GROUP BY 1")

oracle("state_evaluation", "SELECT flow, kind, state, detail, last_ok FROM es")
oracle("polled_state_evaluation", "SELECT flow, kind, state, detail, last_ok FROM pe")
oracle("polled_state_from_history", """SELECT flow, last_ok, CASE WHEN run.outcome = 'start' THEN run.at END AS running_since, problem, check_warning
    FROM (SELECT flow, max(ok) AS last_ok, max_by({'outcome': outcome, 'at': at}, (at, id)) FILTER (WHERE outcome IS NOT NULL) AS run,
        max_by({'v': problem}, (at, rank, coalesce(id, 0))) FILTER (WHERE rank IS NOT NULL).v AS problem,
        max_by({'v': warning}, at) FILTER (WHERE rank = 1).v AS check_warning
    FROM (SELECT flow, at, CASE WHEN outcome <> 'start' THEN 0 END AS rank, id, outcome, CASE WHEN outcome = 'fail' THEN detail END AS problem,
            NULL AS warning, CASE WHEN outcome = 'ok' THEN at END AS ok FROM ev WHERE id % 2 = 0
        UNION ALL SELECT flow, at, 1, NULL, NULL, problem, nullif(concat_ws('; ', warning, CASE WHEN id % 4 = 0 THEN 'schema of x changed: +y' END), ''),
            CASE WHEN problem IS NULL THEN at END FROM pc WHERE id % 2 = 1)
    WHERE at <= TIMESTAMP '2024-01-20' GROUP BY flow)""")
oracle("state_from_history", """SELECT flow, max(at) FILTER (WHERE outcome = 'ok') AS last_ok,
    CASE WHEN max_by(outcome, (at, id)) = 'start' THEN max(at) END AS running_since,
    CASE WHEN max_by(outcome, (at, id)) FILTER (WHERE outcome <> 'start') = 'fail'
        THEN max_by(detail, (at, id)) FILTER (WHERE outcome <> 'start') END AS problem
    FROM ev WHERE at <= TIMESTAMP '2024-01-20' GROUP BY 1""")


def blocking(states: str, name: str) -> str:
    """Broken flows reached through pending ones, then who waits on them."""
    return f"""{name} AS (SELECT flow FROM {states} WHERE state IN ('late', 'failed', 'blocked', 'maintenance')
        UNION SELECT s.flow FROM {states} s JOIN {name} ON s.upstream = {name}.flow WHERE s.state = 'pending'),
        fin AS (SELECT s.flow, s.detail, s.upstream, CASE WHEN s.state IN ('late', 'pending') AND s.upstream IN (SELECT flow FROM {name})
            AND s.upstream <> s.flow THEN 'blocked' ELSE s.state END AS state FROM {states} s),
        blk AS (SELECT f.flow, f.state, CASE WHEN f.state = 'blocked' THEN 'waiting on ' || u.flow || ' (' || u.state || ')'
            ELSE f.detail END AS detail FROM fin f LEFT JOIN fin u ON u.flow = f.upstream)"""


oracle("blocked_flows", f"{blocking('os', 'brk')} /* recursive */ SELECT flow, state, detail FROM blk")
OVER = """SELECT s.flow, CASE WHEN name IS NULL OR state IN ('ok', 'pending') THEN state ELSE 'maintenance' END AS state,
    CASE WHEN name IS NULL OR state IN ('ok', 'pending') THEN detail ELSE 'maintenance ' || name || ' until '
        || lower(strftime({local}, '%a %H:%M')) || '; ' || detail END AS detail
    FROM {states} s LEFT JOIN (SELECT flow, min(name) AS name, min_by(closes_at, name) AS closes_at FROM cv GROUP BY 1) c USING (flow)"""
oracle("maintenance_overlay", OVER.format(local=to_local("closes_at"), states="os"))
oracle("current_states", f"{blocking('es', 'brk')} /* recursive */ {OVER.format(local=to_local('closes_at'), states='blk')}")
oracle("standing_acknowledgements", 'SELECT flow, note, "by", at FROM as_')
oracle("silences_in_force", """SELECT flow, until FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY set_at DESC) AS r FROM sl
    WHERE set_at <= TIMESTAMP '2024-01-30 12:00:00') WHERE r = 1 AND until > TIMESTAMP '2024-01-30 12:00:00'""")
SINCE = f"{AS_OF} - INTERVAL 168 HOUR"
oracle("flow_timeline", f"""SELECT {PAIR} FROM {PAIRS.format(f"(SELECT ev.* FROM ev JOIN fl USING (flow) WHERE kind = 'heartbeat' AND at >= {SINCE})")} WHERE {KEPT}
    UNION ALL SELECT flow, start, start, outcome, detail, millis FROM (SELECT {BUCKET} FROM {BUCKETS})
    UNION ALL SELECT flow, at, at, outcome, detail, millis::BIGINT FROM (
        SELECT ev.*, row_number() OVER (PARTITION BY ev.flow, outcome, epoch_us(at) // 1008000000 ORDER BY at, id) AS r
        FROM ev JOIN fl USING (flow) WHERE kind NOT IN ('heartbeat', 'inbound') AND at >= {SINCE}) WHERE outcome <> 'ok' OR r = 1""")
oracle("monthly_report", """SELECT flow, kind, owner, round(uptime, 9) AS uptime, round(target, 9) AS target, met, incidents, longest_outage_seconds,
    mean_recovery_seconds, runs_ok, runs_failed, round(cost, 4) AS cost FROM re""")

# alert decisions: one state machine per flow, walked row by row
WALK = """ord AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at, o, id) AS r FROM (
        SELECT flow, at, 2 AS o, id, state, id % 7 <> 0 AS delivered, NULL::TIMESTAMP AS until FROM sc
        UNION ALL SELECT flow, set_at, 1, -1, NULL, TRUE, until FROM sl
        UNION ALL SELECT flow, until, 0, -1, NULL, TRUE, until FROM sl)),
    walk AS (SELECT flow, r, 'pending' AS alerted, 'pending' AS before, NULL::TIMESTAMP AS silent FROM ord WHERE FALSE
        UNION ALL SELECT flow, 0, 'pending', 'pending', NULL FROM (SELECT DISTINCT flow FROM ord)
        UNION ALL SELECT n.flow, n.r,
            CASE WHEN n.o = 1 THEN w.alerted
                WHEN n.o = 0 THEN CASE WHEN w.silent = n.until THEN 'pending' ELSE w.alerted END
                WHEN n.state = 'maintenance' OR coalesce(w.silent > n.at, FALSE) THEN w.alerted
                WHEN NOT n.delivered AND w.alerted <> n.state AND (n.state IN ('warning', 'late', 'failed')
                    OR (n.state = 'ok' AND w.alerted IN ('warning', 'late', 'failed'))) THEN w.alerted
                ELSE n.state END,
            w.alerted, CASE WHEN n.o = 1 THEN n.until ELSE w.silent END
        FROM walk w JOIN ord n ON n.flow = w.flow AND n.r = w.r + 1),
    dec AS (SELECT o.id, o.flow, o.at, o.state, w.before AS alerted_before,
        CASE WHEN o.state = 'maintenance' OR coalesce(w.silent > o.at, FALSE) OR w.before = o.state THEN 'none'
            WHEN o.state IN ('warning', 'late', 'failed') THEN 'alert'
            WHEN o.state = 'ok' AND w.before IN ('warning', 'late', 'failed') THEN 'recovery' ELSE 'record' END AS decision
        FROM ord o JOIN walk w ON o.flow = w.flow AND o.r = w.r WHERE o.o = 2)"""
oracle("alert_decisions", f"{WALK} /* recursive */ SELECT id, flow, at, state, alerted_before, decision FROM dec")
LIFTED = WALK.replace("FROM sl)),", "FROM sl UNION ALL SELECT flow, at, -1, -1, NULL, TRUE, at FROM lf)),").replace(
    "CASE WHEN n.o = 1 THEN w.alerted", "CASE WHEN n.o = -1 THEN 'pending' WHEN n.o = 1 THEN w.alerted").replace(
    "CASE WHEN n.o = 1 THEN n.until", "CASE WHEN abs(n.o) = 1 THEN n.until")
oracle("alert_decisions_after_lifts", f"{LIFTED} /* recursive */ SELECT id, flow, at, state, alerted_before, decision FROM dec")
oracle("lifted_silences", """SELECT flow, until FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY set_at DESC, until DESC) AS r FROM (
    SELECT flow, set_at, until FROM sl UNION ALL SELECT flow, at, at FROM lf)
    WHERE set_at <= TIMESTAMP '2024-01-30 12:00:00') WHERE r = 1 AND until > TIMESTAMP '2024-01-30 12:00:00'""")
ALERTS = """SELECT d.id, d.flow, d.at, d.flow || ' is ' || d.state || ' (' || sc.detail || ')' || coalesce(', owner ' || owner, '') AS text,
    d.state, sc.detail, owner, last_ok, CASE WHEN d.state = 'failed' THEN failed_at END AS failed_at
    FROM dec d JOIN sc USING (id) LEFT JOIN fl ON fl.flow = d.flow
    LEFT JOIN (SELECT flow, max(at) FILTER (WHERE outcome = 'ok') AS last_ok, max(at) FILTER (WHERE outcome = 'fail') AS failed_at FROM ev GROUP BY 1) e ON e.flow = d.flow
    WHERE decision IN ('alert', 'recovery')"""
oracle("alert_rows", f"{WALK} /* recursive */ {ALERTS}")
oracle("routed_alerts", f"""{WALK} /* recursive */ SELECT id, flow, owner, CASE WHEN owner = 'owner-1' THEN 'hook-1' ELSE 'shared-hook' END AS webhook,
    CASE WHEN owner IN ('owner-1', 'owner-2') THEN owner || '@example.com' ELSE 'all@example.com' END AS email FROM ({ALERTS})""")

# dependencies
oracle("dependency_cycle", """edge AS (SELECT flow, upstream FROM fl WHERE upstream IS NOT NULL AND flow <> 'flow-2'
        UNION ALL SELECT 'flow-2', unnest(['flow-1', 'flow-5'])),
    reach AS (SELECT flow AS a, upstream AS b FROM edge UNION SELECT a, upstream FROM reach JOIN edge ON flow = b)
    /* recursive */ SELECT min(a) AS flow FROM reach WHERE b IN (SELECT a FROM reach WHERE a = b)""")
oracle("dependency_layout", """edge AS (SELECT flow, upstream FROM fl WHERE upstream IS NOT NULL AND n % 8 <> 1 AND n >= 4),
    two AS (SELECT flow AS a, upstream AS b FROM edge UNION SELECT upstream, flow FROM edge),
    con AS (SELECT a, b FROM two UNION SELECT con.a, two.b FROM con JOIN two ON con.b = two.a),
    dep AS (SELECT flow, 0 AS step FROM fl WHERE n < 100 UNION SELECT edge.flow, step + 1 FROM dep JOIN edge ON edge.upstream = dep.flow)
    /* recursive */ SELECT component, step, flow FROM (SELECT a AS flow, least(min(b), a) AS component FROM con GROUP BY a)
    JOIN (SELECT flow, CAST(max(step) AS BIGINT) AS step FROM dep GROUP BY 1) USING (flow)""")
BENT = """edge AS (SELECT flow, CASE WHEN n = 1 THEN 'flow-3' WHEN n = 20 THEN 'gone' ELSE upstream END AS upstream FROM fl WHERE n BETWEEN 1 AND 99),
    reach AS (SELECT flow AS a, upstream AS b FROM edge UNION SELECT a, upstream FROM reach JOIN edge ON flow = b)"""
oracle("catalogue_violations", f"""{BENT} /* recursive */ SELECT flow AS subject, 'duplicate flow id' AS problem FROM fl WHERE n = 40
    UNION SELECT flow, 'anomaly_tolerance must be above 0 and below 1' FROM fl WHERE n % 10 = 9
    UNION SELECT flow, 'owner owner-4 is not known' FROM fl WHERE owner = 'owner-4'
    UNION SELECT flow, 'after refers to unknown flow gone' FROM fl WHERE n = 20
    UNION SELECT flow, 'cron or calendar not understood' FROM fl WHERE n = 30
    UNION SELECT flow, 'no such time zone: Nowhere/At_All' FROM fl WHERE n = 31
    UNION SELECT 'window-2', 'no such time zone: Mars/Crater'
    UNION SELECT 'window-3', 'pattern api-[!1: a bracket is not closed'
    UNION SELECT 'window-3', 'pattern x**: stars in a row must be a path component of their own'
    UNION SELECT DISTINCT owner, 'not an email address: nobody at home' FROM fl WHERE owner = 'owner-3'
    UNION SELECT 'window-4', 'lasts must be longer than zero'
    UNION SELECT a, 'after goes round in a circle' FROM reach WHERE b IN (SELECT a FROM reach WHERE a = b)""")
