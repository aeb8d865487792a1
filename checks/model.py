"""The model tables, seen through the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.calls import per_minute
from tidewatch.operators.costs import job_costs
from tidewatch.session import configured

AS_OF = "2024-01-31 08:00:00"
ZONE = "Europe/Stockholm"
MONTH = ("2023-12-31 23:00:00", "2024-01-31 23:00:00")


class Model:
    """Every attribute is a lazy DataFrame over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configured(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @property
    def _events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def events(self) -> DataFrame:
        rows = self._events.selectExpr(
            "event_id AS id",
            "concat('flow-', user_id % 50) AS flow",
            "ts AS at",
            "CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'ok' END AS outcome",
            "event_type AS detail",
            "cast(floor(value * 1000) AS int) AS millis",
            "map('k', cast(get_json_object(props, '$.k') AS double), 'value', value) AS metrics",
            "timestamp_micros(unix_micros(ts) + (event_id % 120) * 1000000) AS recorded_at",
        )
        return rows.withColumn("metrics", F.expr("if(outcome = 'start', null, metrics)"))

    @property
    def calls(self) -> DataFrame:
        return self._events.selectExpr(
            "concat('api-', user_id % 20) AS flow",
            "ts AS at",
            "CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END AS status",
            "cast(floor(value) AS bigint) AS millis",
        )

    @property
    def minutes(self) -> DataFrame:
        return per_minute(self.calls)

    @property
    def changes(self) -> DataFrame:
        return self._events.selectExpr(
            "event_id AS id",
            "concat('flow-', user_id % 50) AS flow",
            "ts AS at",
            """CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'warning'
               WHEN 'view' THEN 'late' WHEN 'error' THEN 'failed'
               ELSE if(event_id % 2 = 0, 'maintenance', 'pending') END AS state""",
            "concat(event_type, ' ', event_id) AS detail",
        )

    @property
    def flows(self) -> DataFrame:
        numbers = self._events.select((F.col("user_id") % 50).alias("n")).distinct()
        gateways = self._events.select((F.col("user_id") % 20 + 100).alias("n")).distinct()
        rows = numbers.unionByName(gateways)
        return rows.selectExpr(
            "if(n < 100, concat('flow-', n), concat('api-', n - 100)) AS flow",
            "n AS position",
            """if(n >= 100, 'inbound', element_at(array('heartbeat', 'inbound', 'http', 'sftp',
               'storage', 'delta', 'databricks'), cast(n % 7 AS int) + 1)) AS kind""",
            "21600 * (1 + n % 4) AS every_seconds",
            "1800L AS grace_seconds",
            """CASE WHEN n >= 100 OR n % 3 <> 0 THEN null WHEN n % 9 = 0 THEN '0 7 * * 1-5'
               WHEN n % 9 = 3 THEN '30 */6 * * *' ELSE '0 15 6,18 1-31/2 * ?' END AS cron""",
            "if(n < 100 AND n % 9 = 6, 'quartz', 'unix') AS cron_style",
            "if(n < 100 AND n % 9 = 0, array('se'), cast(array() AS array<string>)) AS calendar",
            "if(n < 100 AND n % 9 = 6, 'Europe/Helsinki', null) AS timezone",
            """if(n BETWEEN 1 AND 99, array(concat('flow-', n div 2)),
               cast(array() AS array<string>)) AS after""",
            "if(n % 5 = 0, null, concat('owner-', n % 5)) AS owner",
            "if(n < 100, 0.5D + n / 200D, null) AS sla",
            "0.5D AS tolerance",
            "7200L AS max_runtime_s",
            "0.3D AS max_error_rate",
            "if(n % 7 = 2, 2000L, null) AS max_latency_ms",
            "if(n < 100 AND n % 7 = 6, n % 20, null) AS job_id",
            "concat('Source ', n) AS source",
        )

    @property
    def owners(self) -> DataFrame:
        # owner-4 is not known on purpose
        return self.flows.where("owner IS NOT NULL AND owner <> 'owner-4'").selectExpr(
            "owner",
            "if(owner = 'owner-1', 'hook-1', null) AS webhook",
            """if(owner IN ('owner-1', 'owner-2'), array(concat(owner, '@example.com')),
               cast(array() AS array<string>)) AS email""",
        ).distinct()

    @property
    def windows(self) -> DataFrame:
        return self.table("region").selectExpr(
            "concat('window-', r_regionkey) AS name",
            """element_at(array('0 8 * * 3', '30 8 * * *', '0 2 * * 0', '0 9 31 * *',
               '0 10 * * *'), r_regionkey + 1) AS cron""",
            "'unix' AS cron_style",
            f"'{ZONE}' AS timezone",
            "if(r_regionkey IN (0, 2), 7200L, 3600L) AS lasts_seconds",
            """element_at(array(array('flow-1*', 'flow-2?'), array('*-3[0-4]'), array('*'),
               array('api-[!1]'), array('flow-*')), r_regionkey + 1) AS patterns""",
        )

    @property
    def usage(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_suppkey % 20 AS job_id",
            "date_add(cast(l_shipdate AS date), 8400) AS usage_date",
            "timestamp_seconds(unix_seconds(cast(l_shipdate AS timestamp)) + 8400 * 86400) AS usage_end_time",
            "l_partkey AS sku",
            "l_linestatus AS cloud",
            "'DBU' AS unit",
            "if(l_returnflag = 'R' AND l_linenumber = 1, -l_quantity, l_quantity) AS quantity",
            "l_linenumber % 3 AS workspace_id",
        )

    @property
    def prices(self) -> DataFrame:
        return (
            self.table("part")
            .where("p_partkey % 97 <> 0")
            .selectExpr("p_partkey AS sku", "p_retailprice", "explode(array('O', 'F')) AS cloud")
            .selectExpr("*", "posexplode(array(date'2018-01-01', date'2021-01-01', date'2023-06-01'))")
            .selectExpr(
                "sku",
                "cloud",
                "'DBU' AS unit",
                "cast(col AS timestamp) AS price_start",
                """cast(CASE pos WHEN 0 THEN date'2021-01-01' WHEN 1 THEN date'2023-06-01' END
                   AS timestamp) AS price_end""",
                "p_retailprice * (1 + pos) AS price",
                "if(sku % 2 = 0, 'EUR', 'USD') AS currency",
            )
        )

    @property
    def costs(self) -> DataFrame:
        return job_costs(self.usage, self.prices)

    @property
    def listings(self) -> DataFrame:
        return (
            self._events.selectExpr(
                "concat('flow-', user_id % 50) AS flow",
                "timestamp_seconds(unix_seconds(ts) - unix_seconds(ts) % 21600) AS poll_at",
                "concat('f', user_id) AS key",
                "concat('f', user_id, if(user_id % 7 = 0, '.csv', '.xml')) AS name",
                "cast(floor(cast(get_json_object(props, '$.k') AS double) / 25) AS bigint) * 100 AS size",
                "date_trunc('day', ts) AS modified",
            )
            .groupBy("flow", "poll_at", "key", "name", "modified")
            .agg(F.max("size").alias("size"))
        )

    @property
    def polls(self) -> DataFrame:
        return self.listings.select("flow", "poll_at").distinct()

    @property
    def rules(self) -> DataFrame:
        return self.flows.where("position < 100").selectExpr(
            "flow", "'*.xml' AS pattern", "86400L AS pickup_seconds",
            "position % 5 = 0 AS baseline",
        )

    @property
    def loads(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy("o_custkey")
            .agg(
                F.count(F.lit(1)).alias("version"),
                F.max("o_orderdate").cast("timestamp").alias("committed_at"),
                F.sum(F.floor("o_totalprice")).alias("bytes"),
            )
            .selectExpr(
                "concat('flow-', o_custkey % 50) AS flow",
                "concat('t', o_custkey) AS table_name",
                "version",
                "committed_at",
                "if(o_custkey % 211 = 0, null, version * 10) AS rows",
                "version AS files",
                "bytes",
            )
        )

    @property
    def schemas(self) -> DataFrame:
        return (
            self._events.selectExpr(
                "concat('flow-', user_id % 50) AS flow",
                "if(user_id % 3 = 0, '', concat('t', user_id % 3)) AS table_name",
                "date_trunc('day', ts) AS poll_at",
                "event_type",
            )
            .groupBy("flow", "table_name", "poll_at")
            .agg(F.array_sort(F.collect_set("event_type")).alias("types"))
            .select(
                "flow",
                "table_name",
                "poll_at",
                F.transform(
                    "types",
                    lambda t: F.concat(
                        t, F.when(F.dayofmonth("poll_at") % 3 == 0, ":long").otherwise(":int")
                    ),
                ).alias("fields"),
            )
        )

    @property
    def fingerprints(self) -> DataFrame:
        return self._events.selectExpr(
            "concat('flow-', user_id % 50) AS flow",
            "ts AS seen_at",
            "concat('K', cast(floor(cast(get_json_object(props, '$.k') AS double) / 25) AS bigint)) AS fingerprint",
        )

    @property
    def confirmations(self) -> DataFrame:
        return self._events.where("event_type = 'signup' AND event_id % 5 = 0").selectExpr(
            "concat('flow-', user_id % 50) AS flow", "ts AS at"
        )

    @property
    def pinned(self) -> DataFrame:
        return self.flows.where("position < 100 AND position % 10 = 3").selectExpr(
            "flow", "'K1' AS fingerprint"
        )

    @property
    def probes(self) -> DataFrame:
        return self._events.selectExpr(
            "event_id AS id",
            "concat('flow-', user_id % 50) AS flow",
            "ts AS at",
            "CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END AS status",
            "cast(floor(value * 100) AS bigint) AS elapsed_ms",
            """timestamp_micros(unix_micros(ts) + cast(cast(get_json_object(props, '$.k') AS double)
               AS bigint) * 86400000000) AS cert_not_after""",
        )

    @property
    def job_runs(self) -> DataFrame:
        start = "unix_millis(cast(o_orderdate AS timestamp))"
        return self.table("orders").selectExpr(
            "o_custkey % 50 AS job_id",
            "o_orderkey AS run_id",
            f"{start} AS start_ms",
            f"{start} + (o_orderkey % 1000) * 1000 + 500 AS end_ms",
            "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' END AS result_state",
            "o_orderpriority AS message",
        )

    @property
    def evaluations(self) -> DataFrame:
        """State changes with deliveries that sometimes fail."""
        return self.changes.withColumn("delivered", F.expr("id % 7 <> 0"))

    @property
    def silences(self) -> DataFrame:
        requests = self._events.where("event_type = 'signup' AND event_id % 10 = 1").selectExpr(
            "concat('flow-', user_id % 50) AS flow",
            "ts AS set_at",
            "cast(event_id % 13 AS double) / 2 AS hours",
        )
        from tidewatch.operators.alerts import valid_silences

        return valid_silences(requests)

    @property
    def raw_reports(self) -> DataFrame:
        """Run reports as sent, some of them not acceptable."""
        return self._events.selectExpr(
            "event_id AS id",
            "concat('flow-', user_id % 50) AS flow",
            "ts AS at",
            """CASE WHEN event_id % 17 = 0 THEN 'done' WHEN event_type = 'view' THEN 'start'
               WHEN event_type = 'error' THEN cast(event_id % 4 + 1 AS string)
               WHEN event_type = 'click' THEN '00' WHEN event_type = 'signup' THEN '+0'
               ELSE '0' END AS result""",
            """CASE WHEN event_id % 11 = 0 THEN '[1]' WHEN event_id % 13 = 0 THEN '  '
               WHEN event_id % 19 = 0 THEN '{"Bad Name": 1}' ELSE props END AS body""",
        )

    @property
    def raw_calls(self) -> DataFrame:
        """Call reports as sent: a single call, or two in an array."""
        status = "CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END"
        return self._events.selectExpr(
            "concat('api-', user_id % 20) AS flow",
            "ts AS at",
            f"""CASE WHEN event_id % 3 = 0
                THEN concat('[{{"status": ', {status}, ', "millis": ', cast(floor(value) AS bigint),
                            '}}, {{"status": 200, "millis": -5}}]')
                WHEN event_id % 3 = 1 THEN concat('{{"status": ', {status}, '}}')
                ELSE concat('{{"status": ', {status}, ', "millis": 90000000}}') END AS body""",
        )

    @property
    def registrations(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "if(s_suppkey < 25, concat('flow-', s_suppkey), concat('sup-', s_suppkey)) AS id",
            "element_at(array('heartbeat', 'inbound', 'databricks'), cast(s_suppkey % 3 AS int) + 1) AS kind",
            "s_suppkey * 10 AS every_seconds",
            "cast(array() AS array<string>) AS after",
            "if(s_suppkey % 2 = 0, null, concat('owner-', s_nationkey % 5)) AS owner",
            "if(s_suppkey % 6 = 2, null, s_suppkey) AS job_id",
            "if(s_suppkey % 4 = 1, '0 2 * * *', null) AS cron",
            "cast(null AS string) AS timezone",
            "cast(array() AS array<string>) AS calendar",
            "if(s_suppkey % 5 = 0, s_suppkey - 50, null) AS grace_seconds",
        )

    @property
    def members(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 10 = 0").selectExpr(
            "c_name AS email",
            "element_at(array('viewer', 'operator', 'editor', 'admin'), cast(c_custkey div 10 % 4 AS int) + 1) AS role",
        )

    @property
    def group_roles(self) -> DataFrame:
        roles = "element_at(array('viewer', 'operator', 'editor', 'admin'), cast({} % 4 AS int) + 1) AS role"
        nations = self.table("nation").where("n_nationkey % 3 = 0").selectExpr(
            "n_name AS group_name", roles.format("n_nationkey")
        )
        regions = self.table("region").where("r_regionkey % 2 = 0").selectExpr(
            "r_name AS group_name", roles.format("r_regionkey")
        )
        return nations.unionByName(regions)

    @property
    def user_groups(self) -> DataFrame:
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        people = self.table("customer").where("c_custkey % 2 = 0")
        return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "upper(c_name) AS email", "array(n_name, r_name) AS groups"
        )

    @property
    def log_lines(self) -> DataFrame:
        """Commit lines of tables whose files are added and removed over time."""
        path = "concat('part-', o_orderkey % 200, '.parquet')"
        schema = r"""'{"metaData":{"schemaString":"{\\"type\\":\\"struct\\",\\"fields\\":[{\\"name\\":\\"id\\",\\"type\\":\\"long\\"},{\\"name\\":\\"v\\",\\"type\\":\\"string\\"}]}"}}'"""
        return self.table("orders").selectExpr(
            "concat('t', o_custkey % 20) AS table_name",
            "o_orderkey AS version",
            "cast(o_orderdate AS timestamp) AS committed_at",
            f"""CASE WHEN o_orderkey < 500 THEN {schema}
                WHEN o_orderstatus = 'F' THEN concat('{{"remove":{{"path":"', {path}, '"}}}}')
                ELSE concat('{{"add":{{"path":"', {path}, '","size":', cast(floor(o_totalprice) AS bigint),
                     if(o_orderkey % 997 = 0, '', concat(',"stats":"{{\\\\"numRecords\\\\":', o_orderkey % 1000, '}}"')),
                     '}}}}') END AS value""",
        )
