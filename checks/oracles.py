"""The same queries in plain SQL over the test tables, for an independent engine."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 08:00:00'"
START, END = "TIMESTAMP '2023-12-31 23:00:00'", "TIMESTAMP '2024-01-31 23:00:00'"
ZONE = "'Europe/Stockholm'"
ORACLES: dict[str, str] = {}


def to_utc(local: str, zone: str = ZONE) -> str:
    return f"timezone('UTC', timezone({zone}, {local}))"


def to_local(at: str, zone: str = ZONE) -> str:
    return f"timezone({zone}, timezone('UTC', {at}))"


def human(seconds: str) -> str:
    s = f"greatest(CAST({seconds} AS BIGINT), 0)"
    return f"""(CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm'
        WHEN {s} < 86400 THEN ({s} // 3600) || 'h' ELSE ({s} // 86400) || 'd' END)"""


def readable(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE printf('%.2f', {x}) END)"


def label(at: str, zone: str = ZONE, short: str = "cet") -> str:
    return f"(lower(strftime({to_local(at, zone)}, '%a %d %b %H:%M')) || ' {short}')"


ROLE = "CASE {} % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'operator' WHEN 2 THEN 'editor' ELSE 'admin' END"
K = "CAST(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE)"
STATUS = "CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END"
MEASURED = "state NOT IN ('pending', 'maintenance')"
UP = "state IN ('ok', 'warning')"
POLLED = "('http', 'sftp', 'storage', 'delta')"

VIEWS: dict[str, str] = {
    "ev": f"""SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow, ts AS at,
        CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'ok' END AS outcome,
        event_type AS detail, CAST(floor(value * 1000) AS INTEGER) AS millis, value, {K} AS k,
        ts + to_seconds(event_id % 120) AS recorded_at FROM events""",
    "cl": f"""SELECT event_id AS id, 'api-' || (user_id % 20) AS flow, ts AS at, {STATUS} AS status,
        CAST(floor(value) AS BIGINT) AS millis FROM events""",
    "mi": """SELECT flow, date_trunc('minute', at) AS minute, count(*) FILTER (WHERE status < 400) AS ok,
        count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors,
        count(*) FILTER (WHERE status >= 500) AS server_errors,
        CAST(sum(millis) AS BIGINT) AS total_millis FROM cl GROUP BY 1, 2""",
    "sc": """SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow, ts AS at,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'late'
        WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'maintenance' ELSE 'pending' END
        END AS state, event_type || ' ' || event_id AS detail FROM events""",
    "fl": """SELECT CASE WHEN n < 100 THEN 'flow-' || n ELSE 'api-' || (n - 100) END AS flow, n,
        CASE WHEN n >= 100 THEN 'inbound' ELSE (['heartbeat', 'inbound', 'http', 'sftp', 'storage',
            'delta', 'databricks'])[CAST(n % 7 AS INTEGER) + 1] END AS kind,
        CAST(21600 * (1 + n % 4) AS BIGINT) AS every_seconds, CAST(1800 AS BIGINT) AS grace_seconds,
        CASE WHEN n >= 100 OR n % 3 <> 0 THEN NULL WHEN n % 9 = 0 THEN '0 7 * * 1-5'
            WHEN n % 9 = 3 THEN '30 */6 * * *' ELSE '0 15 6,18 1-31/2 * ?' END AS cron,
        CASE WHEN n < 100 AND n % 9 = 6 THEN 'quartz' ELSE 'unix' END AS cron_style,
        CASE WHEN n BETWEEN 1 AND 99 THEN 'flow-' || (n // 2) END AS upstream,
        CASE WHEN n % 5 <> 0 THEN 'owner-' || (n % 5) END AS owner,
        CASE WHEN n < 100 THEN 0.5::DOUBLE + n / 200 END AS sla,
        CASE WHEN n < 100 AND n % 7 = 6 THEN n % 20 END AS job_id, 'Source ' || n AS source
        FROM (SELECT DISTINCT user_id % 50 AS n FROM events
              UNION ALL SELECT DISTINCT user_id % 20 + 100 FROM events)""",
    "us": """SELECT l_suppkey % 20 AS job_id, CAST(l_shipdate AS DATE) + 8400 AS day,
        l_shipdate + INTERVAL 8400 DAY AS ended, l_partkey AS sku, l_linestatus AS cloud,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_quantity ELSE l_quantity END AS quantity,
        l_linenumber % 3 AS workspace_id FROM lineitem""",
    "pr": """SELECT p_partkey AS sku, cloud, p.starts, p.ends, p_retailprice * (1 + p.n) AS price,
        CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency
        FROM part, (VALUES ('O'), ('F')) c(cloud),
        (VALUES (0, TIMESTAMP '2018-01-01', TIMESTAMP '2021-01-01'),
                (1, TIMESTAMP '2021-01-01', TIMESTAMP '2023-06-01'),
                (2, TIMESTAMP '2023-06-01', NULL)) p(n, starts, ends)
        WHERE p_partkey % 97 <> 0""",
    "pu": """SELECT us.*, price, currency FROM us JOIN pr ON us.sku = pr.sku AND us.cloud = pr.cloud
        AND ended >= starts AND (ends IS NULL OR ended < ends)""",
    "jc": """SELECT job_id, day, sum(quantity) AS dbus, sum(quantity * price) AS cost,
        max(currency) AS currency FROM pu GROUP BY 1, 2""",
    "li": f"""SELECT flow, poll_at, key, name, modified, max(size) AS size FROM (
        SELECT 'flow-' || (user_id % 50) AS flow,
            make_timestamp((epoch_us(ts) // 1000000 // 21600 * 21600) * 1000000) AS poll_at,
            'f' || user_id AS key,
            'f' || user_id || CASE WHEN user_id % 7 = 0 THEN '.csv' ELSE '.xml' END AS name,
            CAST(floor({K} / 25) AS BIGINT) * 100 AS size,
            date_trunc('day', ts) AS modified FROM events) GROUP BY ALL""",
    "ru": "SELECT flow, n % 5 = 0 AS baseline FROM fl WHERE n < 100",
    "po": """SELECT flow, poll_at, row_number() OVER (PARTITION BY flow ORDER BY poll_at) AS poll
        FROM (SELECT DISTINCT flow, poll_at FROM li)""",
    # sightings of matching files with the one before, then runs of consecutive ones
    "s1": """SELECT li.*, poll, baseline,
        lag(poll) OVER w AS p_poll, lag(size) OVER w AS p_size, lag(modified) OVER w AS p_modified
        FROM li JOIN po USING (flow, poll_at) JOIN ru USING (flow) WHERE name LIKE '%.xml'
        WINDOW w AS (PARTITION BY flow, key ORDER BY poll_at)""",
    "s2": """SELECT *, coalesce(p_poll = poll - 1, FALSE) AS again, baseline AND poll = 1 AS inherited,
        (baseline AND poll = 1) OR coalesce(p_poll = poll - 1 AND p_size = size AND p_modified = modified,
            FALSE) AS settled,
        sum(CASE WHEN coalesce(p_poll = poll - 1, FALSE) THEN 0 ELSE 1 END)
            OVER (PARTITION BY flow, key ORDER BY poll_at) AS island FROM s1""",
    "s3": """SELECT *, lag(settled) OVER (PARTITION BY flow, key ORDER BY poll_at) AS p_settled,
        min(poll_at) OVER (PARTITION BY flow, key, island) AS first_seen FROM s2""",
    "se": """SELECT *, settled AND size = 0 AS empty,
        settled AND NOT inherited AND NOT coalesce(again AND p_settled, FALSE) AND size > 0 AS arrived,
        poll_at - first_seen > INTERVAL 1 DAY AS uncollected FROM s3""",
    "ld": """SELECT 'flow-' || (o_custkey % 50) AS flow, 't' || o_custkey AS table_name,
        count(*) AS version, max(o_orderdate) AS committed_at,
        CASE WHEN o_custkey % 211 <> 0 THEN count(*) * 10 END AS rows, count(*) AS files,
        CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes
        FROM orders GROUP BY o_custkey""",
    "sf": """SELECT DISTINCT 'flow-' || (user_id % 50) AS flow,
        CASE WHEN user_id % 3 = 0 THEN '' ELSE 't' || (user_id % 3) END AS table_name,
        date_trunc('day', ts) AS poll_at, event_type AS name,
        CASE WHEN day(ts) % 3 = 0 THEN 'long' ELSE 'int' END AS type FROM events""",
    "so": """SELECT flow, table_name, poll_at, type, list_sort(list(name)) AS names FROM sf
        GROUP BY ALL""",
    "fp": f"""SELECT 'flow-' || (user_id % 50) AS flow, ts AS seen_at,
        'K' || CAST(floor({K} / 25) AS BIGINT) AS fingerprint FROM events""",
    "pb": f"""SELECT event_id AS id, 'flow-' || (user_id % 50) AS flow, ts AS at, {STATUS} AS status,
        CAST(floor(value * 100) AS BIGINT) AS elapsed_ms,
        ts + to_days(CAST({K} AS INTEGER)) AS cert FROM events""",
    "pc": f"""SELECT id, flow, at, CASE WHEN status <> 200 THEN 'http ' || status
            WHEN n % 7 = 2 AND elapsed_ms > 2000 THEN 'slow response: ' || elapsed_ms || ' ms' END AS problem,
        status, elapsed_ms,
        CASE WHEN cert - at < INTERVAL 14 DAY THEN 'tls certificate expires in '
            || {human("epoch(cert) - epoch(at)")}
            || ' (' || strftime(cert, '%Y-%m-%d') || ')' END AS warning
        FROM pb LEFT JOIN fl USING (flow)""",
    "jr": """SELECT o_custkey % 50 AS job_id, o_orderkey AS run_id, epoch_ms(o_orderdate) AS start_ms,
        epoch_ms(o_orderdate) + (o_orderkey % 1000) * 1000 + 500 AS end_ms,
        CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' END AS result_state,
        o_orderpriority AS message FROM orders""",
    "rg": """SELECT CASE WHEN s_suppkey < 25 THEN 'flow-' || s_suppkey ELSE 'sup-' || s_suppkey END AS id,
        (['heartbeat', 'inbound', 'databricks'])[CAST(s_suppkey % 3 AS INTEGER) + 1] AS kind,
        s_suppkey * 10 AS every_seconds,
        CASE WHEN s_suppkey % 2 <> 0 THEN 'owner-' || (s_nationkey % 5) END AS owner,
        CASE WHEN s_suppkey % 6 <> 2 THEN s_suppkey END AS job_id,
        CASE WHEN s_suppkey % 4 = 1 THEN '0 2 * * *' END AS cron,
        CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey - 50 END AS grace_seconds FROM supplier""",
    "rf": """SELECT id AS flow, CASE WHEN kind = 'inbound' THEN 'inbound'
            WHEN kind = 'databricks' AND job_id IS NOT NULL THEN 'databricks' ELSE 'heartbeat' END AS kind,
        greatest(every_seconds, 60) AS every_seconds,
        CASE WHEN grace_seconds IS NOT NULL THEN greatest(grace_seconds, 0)
            WHEN cron IS NOT NULL THEN 3600
            ELSE greatest(greatest(every_seconds, 60) // 10, 300) END AS grace_seconds,
        cron, CASE WHEN kind = 'databricks' THEN 'quartz' ELSE 'unix' END AS cron_style, owner,
        0.5::DOUBLE AS tolerance, CASE WHEN kind = 'inbound' THEN 0.05::DOUBLE END AS max_error_rate,
        CASE WHEN kind = 'databricks' THEN job_id END AS job_id FROM rg""",
    "ct": """SELECT flow, kind, every_seconds, grace_seconds, cron, cron_style, owner,
        0.5::DOUBLE AS tolerance, 0.3::DOUBLE AS max_error_rate, job_id FROM fl
        UNION ALL SELECT flow, kind, every_seconds, grace_seconds, cron, cron_style, owner, tolerance,
        max_error_rate, job_id FROM rf WHERE flow NOT IN (SELECT flow FROM fl)""",
    "rl": f"""SELECT lower(c_name) AS email, {ROLE.format("(c_custkey // 10)")} AS role FROM customer
            WHERE c_custkey % 10 = 0
        UNION ALL SELECT lower(c_name), {ROLE.format("n_nationkey")} FROM customer
            JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 AND n_nationkey % 3 = 0
        UNION ALL SELECT lower(c_name), {ROLE.format("r_regionkey")} FROM customer
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            WHERE c_custkey % 2 = 0 AND r_regionkey % 2 = 0""",
    # deadlines of the three schedules in the catalogue, by hand
    "dd": """SELECT CAST(unnest(generate_series(DATE '2023-10-01', DATE '2024-08-31', INTERVAL 1 DAY)) AS DATE) AS d""",
    "hs": """SELECT unnest([DATE '2023-11-04', DATE '2023-12-24', DATE '2023-12-25', DATE '2023-12-26',
        DATE '2023-12-31', DATE '2024-01-01', DATE '2024-01-06', DATE '2024-03-29', DATE '2024-03-31',
        DATE '2024-04-01', DATE '2024-05-01', DATE '2024-05-09', DATE '2024-05-19', DATE '2024-06-06',
        DATE '2024-06-21', DATE '2024-06-22']) AS d""",
    "oc": f"""SELECT 0 AS k, d, {to_utc("d + INTERVAL 7 HOUR")} AS at FROM dd
            WHERE isodow(d) <= 5 AND d NOT IN (SELECT d FROM hs)
        UNION ALL SELECT 3, d, {to_utc("d + to_minutes(h * 60 + 30)")} FROM dd,
            (VALUES (0), (6), (12), (18)) t(h)
        UNION ALL SELECT 6, d, {to_utc("d + to_minutes(h * 60 + 15)", "'Europe/Helsinki'")} FROM dd,
            (VALUES (6), (18)) t(h) WHERE day(d) % 2 = 1""",
    "wn": f"""SELECT name, opened_at, closes_at, closes_at > {AS_OF} AS is_open, next_opening, patterns FROM (
        SELECT 'window-' || r_regionkey AS name, r_regionkey AS r,
            max(at) FILTER (WHERE at <= {AS_OF}) AS opened_at,
            max(at) FILTER (WHERE at <= {AS_OF}) + CASE WHEN r_regionkey IN (0, 2) THEN INTERVAL 2 HOUR
                ELSE INTERVAL 1 HOUR END AS closes_at,
            min(at) FILTER (WHERE at > {AS_OF}) AS next_opening,
            any_value(CASE r_regionkey WHEN 0 THEN ['flow-1*', 'flow-2?'] WHEN 1 THEN ['*-3[0-4]']
                WHEN 2 THEN ['*'] WHEN 3 THEN ['api-[!1]'] ELSE ['flow-*'] END) AS patterns
        FROM region JOIN (
            SELECT 0 AS r, {to_utc("d + INTERVAL 8 HOUR")} AS at FROM dd WHERE isodow(d) = 3
            UNION ALL SELECT 1, {to_utc("d + to_minutes(510)")} FROM dd
            UNION ALL SELECT 2, {to_utc("d + INTERVAL 2 HOUR")} FROM dd WHERE isodow(d) = 7
            UNION ALL SELECT 3, {to_utc("d + INTERVAL 9 HOUR")} FROM dd WHERE day(d) = 31
            UNION ALL SELECT 4, {to_utc("d + INTERVAL 10 HOUR")} FROM dd) o ON r = r_regionkey
        GROUP BY r_regionkey)""",
    "cv": f"""SELECT DISTINCT fl.flow, name, closes_at, pattern FROM fl,
        (SELECT name, closes_at, unnest(patterns) AS pattern FROM wn WHERE is_open) p
        WHERE fl.flow GLOB pattern""",
    # state changes of the period, with the state carried in
    "pd": f"""SELECT flow, TIMESTAMP '2024-01-03 00:00:00' AS at, id, state FROM (
            SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC, id DESC) AS n FROM sc
            WHERE at < TIMESTAMP '2024-01-03 00:00:00') WHERE n = 1
        UNION ALL SELECT flow, at, id, state FROM sc
            WHERE at >= TIMESTAMP '2024-01-03 00:00:00' AND at < {END}""",
    "iv": f"""SELECT *, coalesce(lead(at) OVER (PARTITION BY flow ORDER BY at, id), {END}) AS ends FROM pd""",
    "tu": f"""SELECT *, lag(up) OVER (PARTITION BY flow ORDER BY at, id) AS was FROM (
        SELECT flow, at, id, {UP} AS up FROM pd WHERE {MEASURED})""",
    "ou": """SELECT flow, at AS started, ended FROM (
        SELECT *, lead(at) OVER (PARTITION BY flow ORDER BY at, id) AS ended FROM tu
        WHERE up <> coalesce(was, TRUE)) WHERE NOT up""",
    "su": f"""SELECT t.flow, CASE WHEN m // 1000000 > 0 THEN (u // 1000000)::DOUBLE / (m // 1000000) END AS uptime,
        coalesce(incidents, 0) AS incidents, coalesce(longest, 0) AS longest_outage_seconds, recovery AS mean_recovery_seconds
        FROM (SELECT flow, CAST(sum(CASE WHEN {MEASURED} THEN epoch_us(ends) - epoch_us(at) ELSE 0 END) AS BIGINT) AS m,
            CAST(sum(CASE WHEN {UP} THEN epoch_us(ends) - epoch_us(at) ELSE 0 END) AS BIGINT) AS u FROM iv GROUP BY flow) t
        LEFT JOIN (SELECT flow, count(*) AS incidents,
            CAST(max(epoch_us(coalesce(ended, {END})) - epoch_us(started)) // 1000000 AS BIGINT) AS longest,
            CAST(sum(epoch_us(ended) - epoch_us(started)) // (count(ended) * 1000000) AS BIGINT) AS recovery
            FROM ou GROUP BY flow) o USING (flow)""",
    # the report is over the whole month, cut at as_of
    "p2": f"""SELECT flow, {START} AS at, id, state FROM (
            SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC, id DESC) AS n FROM sc
            WHERE at < {START}) WHERE n = 1
        UNION ALL SELECT flow, at, id, state FROM sc WHERE at >= {START} AND at < {AS_OF}""",
    "i2": f"""SELECT *, coalesce(lead(at) OVER (PARTITION BY flow ORDER BY at, id), {AS_OF}) AS ends FROM p2""",
    "t2": f"""SELECT *, lag(up) OVER (PARTITION BY flow ORDER BY at, id) AS was FROM (
        SELECT flow, at, id, {UP} AS up FROM p2 WHERE {MEASURED})""",
    "o2": """SELECT flow, at AS started, ended FROM (
        SELECT *, lead(at) OVER (PARTITION BY flow ORDER BY at, id) AS ended FROM t2
        WHERE up <> coalesce(was, TRUE)) WHERE NOT up""",
    "re": f"""SELECT fl.flow, kind, owner, uptime, sla AS target, uptime >= sla AS met,
        coalesce(incidents, 0) AS incidents, coalesce(longest, 0) AS longest_outage_seconds,
        recovery AS mean_recovery_seconds, coalesce(runs_ok, 0) AS runs_ok,
        coalesce(runs_failed, 0) AS runs_failed, cost FROM fl
        LEFT JOIN (SELECT flow, CASE WHEN m // 1000000 > 0 THEN (u // 1000000)::DOUBLE / (m // 1000000) END AS uptime
            FROM (SELECT flow, CAST(sum(CASE WHEN {MEASURED} THEN epoch_us(ends) - epoch_us(at) ELSE 0 END) AS BIGINT) AS m,
            CAST(sum(CASE WHEN {UP} THEN epoch_us(ends) - epoch_us(at) ELSE 0 END) AS BIGINT) AS u FROM i2 GROUP BY flow)) t USING (flow)
        LEFT JOIN (SELECT flow, count(*) AS incidents,
            CAST(max(epoch_us(coalesce(ended, {AS_OF})) - epoch_us(started)) // 1000000 AS BIGINT) AS longest,
            CAST(sum(epoch_us(ended) - epoch_us(started)) // (count(ended) * 1000000) AS BIGINT) AS recovery
            FROM o2 GROUP BY flow) o USING (flow)
        LEFT JOIN (SELECT flow, count(*) FILTER (WHERE outcome = 'ok') AS runs_ok,
            count(*) FILTER (WHERE outcome = 'fail') AS runs_failed FROM ev
            WHERE at >= {START} AND at < {AS_OF} GROUP BY flow) r USING (flow)
        LEFT JOIN (SELECT job_id, sum(cost) AS cost FROM jc
            WHERE day >= DATE '2024-01-01' AND day < DATE '2024-02-01' GROUP BY 1) c USING (job_id)""",
    # reported metrics of ok runs with the up to ten values before
    "mr": """SELECT flow, id, at, unnest(['k', 'value']) AS name, unnest([k, value]) AS v FROM ev
        WHERE outcome = 'ok'""",
    "mh": """SELECT *, list(v) OVER (PARTITION BY flow, name ORDER BY at, id
            ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h,
        row_number() OVER (PARTITION BY flow, name ORDER BY at DESC, id DESC) AS newest FROM mr""",
    "mf": f"""SELECT *, name || ' ' || {readable("v")} || ' is unusual, usually about ' || {readable("u")} AS finding
        FROM (SELECT *, list_sort(h)[len(h) // 2 + 1] AS u FROM mh WHERE len(h) >= 5)
        WHERE u > 0 AND (v < u * 0.5 OR v > u / 0.5)""",
    # cost of a day against the upper median of the fourteen days before
    "ch": """SELECT *, list(cost) OVER (PARTITION BY job_id ORDER BY day
            RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS h FROM jc""",
    "cs": """SELECT *, 'cost yesterday ' || printf('%.2f', cost) || ' ' || currency || ', usually about '
            || printf('%.2f', usual) AS warning
        FROM (SELECT *, list_sort(h)[len(h) // 2 + 1] AS usual FROM ch WHERE len(h) >= 5)
        WHERE usual > 0 AND cost > usual * 2 AND cost - usual >= 1""",
    # flow state and its judgement
    "st": f"""SELECT coalesce(e.flow, c.flow) AS flow, greatest(e.last_ok, c.last_ok) AS last_ok, running_since, problem FROM (
        SELECT flow, max(at) FILTER (WHERE outcome = 'ok') AS last_ok,
            CASE WHEN max_by(outcome, (at, id)) = 'start' THEN max(at) END AS running_since,
            CASE WHEN max_by(outcome, (at, id)) FILTER (WHERE outcome <> 'start') = 'fail'
                THEN max_by(detail, (at, id)) FILTER (WHERE outcome <> 'start') END AS problem
        FROM ev WHERE at <= {AS_OF} GROUP BY flow) e
        FULL JOIN (SELECT flow, max(minute) AS last_ok FROM mi WHERE minute <= {AS_OF} GROUP BY flow) c
        ON e.flow = c.flow""",
    "du": f"""SELECT flow, max(at) FILTER (WHERE n = 1) AS due_at, max(at) FILTER (WHERE n = 2) AS previous_at, min(nx) AS next_at FROM (
        SELECT flow, at, row_number() OVER (PARTITION BY flow ORDER BY at DESC) AS n, NULL::TIMESTAMP AS nx
        FROM fl JOIN oc ON fl.n % 9 = oc.k WHERE cron IS NOT NULL AND at <= {AS_OF} - INTERVAL 30 MINUTE
        UNION ALL SELECT flow, NULL, 0, min(at) FROM fl JOIN oc ON fl.n % 9 = oc.k
        WHERE cron IS NOT NULL AND at > {AS_OF} GROUP BY flow) GROUP BY flow""",
    "an": """SELECT f.flow, string_agg(finding, '; ' ORDER BY name) AS anomaly FROM mf f
        WHERE newest = 1 GROUP BY f.flow""",
    "jw": f"""SELECT fl.flow, warning AS cost_warning FROM fl JOIN cs USING (job_id)
        WHERE kind = 'databricks' AND day = DATE '2024-01-30'""",
    "es": f"""SELECT fl.*, last_ok, running_since, problem, due_at, previous_at, next_at, age,
        CASE WHEN problem IS NOT NULL THEN 'failed'
            WHEN kind = 'heartbeat' AND {AS_OF} - running_since > INTERVAL 2 HOUR THEN 'failed'
            WHEN last_ok IS NULL THEN 'pending'
            WHEN cron IS NOT NULL AND last_ok <= previous_at + INTERVAL 30 MINUTE THEN 'late'
            WHEN cron IS NULL AND {AS_OF} - last_ok > to_seconds(every_seconds + 1800) THEN 'late'
            WHEN anomaly IS NOT NULL OR cost_warning IS NOT NULL THEN 'warning' ELSE 'ok' END AS state,
        CASE WHEN problem IS NOT NULL THEN problem
            WHEN kind = 'heartbeat' AND {AS_OF} - running_since > INTERVAL 2 HOUR
                THEN 'still running after ' || {human(f"(epoch_us({AS_OF}) - epoch_us(running_since)) // 1000000")}
            WHEN last_ok IS NULL THEN 'no data yet'
            WHEN cron IS NOT NULL AND last_ok <= previous_at + INTERVAL 30 MINUTE THEN 'was due by ' ||
                CASE WHEN n % 9 = 6 THEN {label("(due_at + INTERVAL 30 MINUTE)", "'Europe/Helsinki'", "eet")}
                ELSE {label("(due_at + INTERVAL 30 MINUTE)")} END
            WHEN cron IS NULL AND {AS_OF} - last_ok > to_seconds(every_seconds + 1800)
                THEN 'nothing for ' || {human("age")} || ', expected every ' || {human("every_seconds")}
            WHEN anomaly IS NOT NULL OR cost_warning IS NOT NULL THEN concat_ws('; ', anomaly, cost_warning)
            ELSE 'last ok ' || {human("age")} || ' ago' || CASE WHEN cron IS NULL THEN '' ELSE ', next due ' ||
                CASE WHEN n % 9 = 6 THEN {label("(next_at + INTERVAL 30 MINUTE)", "'Europe/Helsinki'", "eet")}
                ELSE {label("(next_at + INTERVAL 30 MINUTE)")} END END END AS detail
        FROM (SELECT *, (epoch_us({AS_OF}) - epoch_us(last_ok)) // 1000000 AS age FROM fl LEFT JOIN st USING (flow)) fl
        LEFT JOIN du USING (flow) LEFT JOIN an USING (flow) LEFT JOIN jw USING (flow)""",
    # reports of some kinds and polls of others
    "ps": f"""SELECT flow, last_ok, running_since, problem, NULL::VARCHAR AS check_warning FROM st JOIN fl USING (flow) WHERE kind NOT IN {POLLED}
        UNION ALL SELECT flow, last_ok, NULL, problem, nullif(concat_ws('; ', warning,
            CASE WHEN id % 4 = 0 THEN 'schema of x changed: +y' END), '') FROM (
        SELECT *, row_number() OVER (PARTITION BY flow ORDER BY at DESC) AS r,
            max(CASE WHEN problem IS NULL THEN at END) OVER (PARTITION BY flow) AS last_ok
        FROM pc WHERE at <= {AS_OF}) JOIN fl USING (flow) WHERE r = 1 AND kind IN {POLLED}""",
    "pn": f"SELECT an.* FROM an JOIN fl USING (flow) WHERE kind NOT IN {POLLED}",
    # the latest change of each flow as its own state, and what waits on what
    "os": """SELECT flow, n, upstream, state, 'own ' || state AS detail FROM fl
        JOIN (SELECT flow, max_by(state, (at, id)) AS state FROM sc GROUP BY flow) USING (flow)
        WHERE n < 100""",
    # silences: replaced by a later one, and forgotten when they end
    "sr": """SELECT 'flow-' || (user_id % 50) AS flow, ts AS set_at, event_id % 13 / 2 AS hours
        FROM events WHERE event_type = 'signup' AND event_id % 10 = 1 AND event_id % 13 > 0""",
    "sl": """SELECT flow, set_at, set_at + to_seconds(CAST(floor(hours * 3600) AS BIGINT)) AS until,
        lead(set_at) OVER (PARTITION BY flow ORDER BY set_at) AS next_at FROM sr""",
    "lf": "SELECT flow, set_at + INTERVAL 20 MINUTE AS at FROM sl WHERE CAST(floor(epoch(set_at)) AS BIGINT) % 3 = 0",
    "ak": """SELECT flow, detail AS note, 'someone' AS "by", at FROM ev WHERE outcome = 'fail' AND id % 3 = 0""",
    "as_": f"""SELECT a.flow, note, "by", a.at FROM (
        SELECT flow, max_by(note, at) AS note, max("by") AS "by", max(at) AS at FROM ak GROUP BY flow) a
        LEFT JOIN (SELECT flow, max(at) AS ok_at FROM sc WHERE state = 'ok' GROUP BY flow) o ON a.flow = o.flow
        WHERE ok_at IS NULL OR ok_at <= a.at""",
}


# the same judgement over both
VIEWS["pe"] = (
    VIEWS["es"]
    .replace("JOIN st ", "JOIN ps ")
    .replace("JOIN an ", "JOIN pn ")
    .replace("WHEN anomaly IS NOT NULL", "WHEN check_warning IS NOT NULL OR anomaly IS NOT NULL")
    .replace("concat_ws('; ', anomaly", "concat_ws('; ', check_warning, anomaly")
)


def _uses(body: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", body))
    return [n for n in VIEWS if n in words]


def _quoted(text: str) -> str:
    """The column name ``at`` is a keyword; it is quoted outside of string literals."""
    parts = text.split("'")
    parts[::2] = [re.sub(r'(?<!["\w])at(?!["\w])', '"at"', p) for p in parts[::2]]
    return "'".join(parts)


def oracle(name: str, body: str) -> None:
    """Registers a query, with the views it uses in front of it.

    Before a ``/* recursive */`` mark stand common tables of its own that may refer to
    themselves.
    """
    needed: list[str] = []

    def need(text: str) -> None:
        for view in _uses(text):
            if view not in needed:
                need(VIEWS[view])
                needed.append(view)

    need(body)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed]
    own, mark, rest = body.partition("/* recursive */")
    if mark:
        sql = f"WITH RECURSIVE {', '.join([*ctes, own])} {rest}"
    elif ctes:
        sql = f"WITH {', '.join(ctes)} {body}"
    else:
        sql = body
    ORACLES[name] = _quoted(sql)
