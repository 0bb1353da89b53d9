"""The scheduler's relations as projections of the given tables, once for Spark and for DuckDB."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The moment of all queries: no query reads a clock.
NOW = "2024-01-16 12:00:00"


@dataclass(frozen=True)
class Dialect:
    """What differs between the two engines."""

    duck: bool

    def at(self, text: str) -> str:
        return f"TIMESTAMP '{text}'" if self.duck else f"TIMESTAMP_NTZ '{text}'"

    def minutes(self, ts: str, n: str) -> str:
        return f"({ts} + to_minutes(CAST({n} AS INTEGER)))" if self.duck else f"timestampadd(MINUTE, CAST({n} AS INT), {ts})"

    @property
    def time(self) -> str:
        return "TIMESTAMP" if self.duck else "TIMESTAMP_NTZ"

    @property
    def text(self) -> str:
        return "VARCHAR" if self.duck else "STRING"


def relation_sql(name: str, d: Dialect) -> str:
    """A relation's SQL; {t} stands for another relation or a given table."""
    t0 = d.at("2024-01-01 00:00:00")
    far = d.at("2199-12-01 00:00:00")  # within nanoseconds
    s = d.text
    return {
        "execution": f"""SELECT o_orderkey AS execution_id, o_custkey AS executable_id,
            CASE WHEN o_custkey % 2 = 0 THEN 'workflow' ELSE 'executor' END AS executable_type, CAST(o_orderdate AS {d.time}) AS trigger_at,
            CASE o_orderstatus WHEN 'F' THEN 'succeed' WHEN 'O' THEN 'running' ELSE 'inited' END AS status FROM {{orders}}""",
        "job_raw": f"""SELECT l_orderkey AS execution_id, l_linenumber AS ref_id, l_suppkey AS worker_id, l_partkey AS schedule_id, CAST(l_shipdate AS {d.time}) AS trigger_at,
            CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'succeed'
                 WHEN l_returnflag = 'N' AND l_quantity < 10 THEN 'inited' WHEN l_quantity < 20 THEN 'dispatched' ELSE 'running' END AS status,
            CAST(l_quantity AS INT) AS retry_times, l_extendedprice AS cost FROM {{lineitem}}""",
        "job": """SELECT execution_id, ref_id, worker_id, schedule_id, trigger_at, status, retry_times, cost FROM (
            SELECT *, row_number() OVER (PARTITION BY execution_id, ref_id ORDER BY schedule_id, worker_id, trigger_at, status, retry_times, cost) AS place FROM {job_raw}) x WHERE place = 1""",
        "worker": f"""SELECT s_suppkey AS worker_id, s_nationkey AS app_id, concat('10.0.', CAST(s_nationkey AS {s}), '.', CAST(s_suppkey AS {s})) AS host, 9000 AS port, 'http' AS protocol,
            CASE WHEN s_acctbal >= 0 THEN 'online' ELSE 'offline' END AS status, s_suppkey % 10 <> 0 AS is_enabled, s_suppkey % 97 = 0 AS is_deleted FROM {{supplier}}""",
        "worker_metric": f"""SELECT s_suppkey AS worker_id, CAST(s_suppkey % 16 AS INT) + 1 AS cpu_processors, CAST(s_suppkey % 16 AS DOUBLE) AS cpu_load, CAST(floor(s_acctbal) AS BIGINT) AS free_memory,
            CAST(s_suppkey % 8 AS INT) AS available_queue_num, {d.minutes(t0, "s_suppkey * 7 % 21600")} AS last_heartbeat_at FROM {{supplier}} WHERE s_suppkey % 13 <> 0""",
        "worker_executor": """SELECT DISTINCT l_suppkey AS worker_id, p_type AS name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_size = l_suppkey % 50 + 1""",
        "tag": f"""SELECT s_suppkey AS ref_id, 'worker' AS ref_type, 'nation' AS tag_name, n_name AS tag_value FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0
            UNION ALL SELECT s_suppkey, 'worker', 'region', r_name FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE s_suppkey % 7 <> 0
            UNION ALL SELECT s_suppkey, 'worker', 'tier', CAST(s_suppkey % 4 AS {s}) FROM {{supplier}} WHERE s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0
            UNION ALL SELECT s_suppkey, 'worker', 'tier', 'spare' FROM {{supplier}} WHERE s_suppkey % 6 = 0 AND s_suppkey % 7 <> 0""",
        "access_log": "SELECT user_id AS server_id, ts AS dispatch_at, event_id, event_type FROM {events}",
        "heartbeat": "SELECT user_id AS node_id, ts AS at, event_id FROM {events}",
        "schedule": f"""SELECT p_partkey AS schedule_id, CASE p_partkey % 3 WHEN 0 THEN 'fixed_rate' WHEN 1 THEN 'fixed_delay' ELSE 'cron' END AS schedule_type,
            {d.minutes(t0, "p_partkey % 1440")} AS start_time, CASE WHEN p_partkey % 11 = 0 THEN {d.minutes(t0, "p_partkey % 43200")} ELSE {far} END AS end_time,
            CAST(p_size % 5 AS BIGINT) * 60 AS schedule_delay, CAST(p_size AS BIGINT) * 60 AS schedule_interval,
            CASE WHEN p_partkey % 3 = 2 THEN concat('0 0/', CAST(p_size % 30 + 1 AS {s}), ' * * * ?') END AS schedule_cron,
            CASE WHEN p_partkey % 5 <> 0 THEN {d.minutes(t0, "p_partkey % 23000")} END AS last_trigger_at,
            CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 0 THEN {d.minutes(t0, "p_partkey % 23000 + p_size % 3")} END AS last_feedback_at,
            {d.minutes(t0, "p_partkey * 11 % 23000")} AS next_trigger_at, p_partkey % 10 <> 0 AS is_enabled, p_partkey % 29 = 0 AS is_deleted FROM {{part}}""",
        "firing": f"""SELECT concat(CAST(l_partkey AS {s}), '_', CAST(l_orderkey AS {s}), '_', CAST(l_linenumber AS {s})) AS delay_id, l_partkey AS schedule_id,
            {d.minutes(t0, "l_orderkey * 13 % 43200")} AS trigger_at, CAST(l_partkey % 64 + 1 AS INT) AS bucket,
            CASE l_returnflag WHEN 'N' THEN 'init' WHEN 'R' THEN 'failed' ELSE 'succeed' END AS status, l_linenumber = 7 AS is_deleted FROM {{lineitem}}""",
        "broker": f"""SELECT n_nationkey AS broker_id, concat('broker-', CAST(n_nationkey AS {s})) AS host, 9785 AS port, 'http' AS protocol, CAST(n_nationkey * 3 % 10 AS INT) AS broker_load,
            {d.minutes(d.at("2024-01-16 11:40:00"), "n_nationkey")} AS last_heartbeat_at FROM {{nation}}""",
        "bucket": "SELECT CAST(s_suppkey AS INT) AS bucket, s_suppkey % 28 AS broker_id FROM {supplier} WHERE s_suppkey <= 60 AND s_suppkey % 9 <> 0",
        "dag_node": """SELECT DISTINCT execution_id AS dag_id, ref_id AS node_id, CASE WHEN ref_id = 1 THEN 'start' ELSE 'executor' END AS node_type, status, status = 'failed' AND execution_id % 4 = 0 AS skip_when_fail FROM {job}""",
        "dag_edge": """SELECT dag_id, source, target FROM (SELECT execution_id AS dag_id, ref_id AS source, lead(ref_id) OVER (PARTITION BY execution_id ORDER BY ref_id) AS target FROM {job}) x WHERE target IS NOT NULL
            UNION SELECT execution_id, min(ref_id), max(ref_id) FROM {job} GROUP BY execution_id HAVING min(ref_id) < max(ref_id)
            UNION SELECT execution_id, max(ref_id), min(ref_id) FROM {job} WHERE execution_id % 10 = 0 GROUP BY execution_id HAVING min(ref_id) < max(ref_id)""",
        "workflow_node": """SELECT dag_id, node_id, CASE WHEN dag_id % 17 = 3 AND node_id = 2 THEN 'script' WHEN node_type = 'executor' AND dag_id % 7 <> 3 AND node_id = max(node_id) OVER (PARTITION BY dag_id) THEN 'end' ELSE node_type END AS node_type
            FROM {dag_node} WHERE dag_id % 31 <> 7""",
        "workflow_edge": """SELECT dag_id, source, target FROM {dag_edge} WHERE source < target UNION SELECT dag_id, max(node_id), 2 FROM {dag_node} WHERE dag_id % 8 = 2 GROUP BY dag_id HAVING max(node_id) > 2
            UNION SELECT dag_id, 3, 2 FROM {dag_node} WHERE dag_id % 8 = 5 GROUP BY dag_id HAVING max(node_id) > 3""",
        "version": f"""SELECT user_id AS ref_id, 'trigger' AS ref_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS {s}) AS version, event_type AS description, props AS config FROM {{events}}""",
        "trigger": f"""SELECT c_custkey AS trigger_id, c_name AS name, c_mktsegment AS description, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 60 + 1 AS {s}) ELSE '' END AS publish_version,
            CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 70 + 1 AS {s}) END AS draft_version, c_acctbal >= 0 AS is_enabled, c_custkey % 20 = 0 AS is_deleted FROM {{customer}}""",
        "job_event": """SELECT user_id AS job_id, event_id, ts AS at, user_id * event_id % 3 AS worker_id,
            CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'dispatch_success' WHEN 1 THEN 'start' WHEN 2 THEN 'run_success' WHEN 3 THEN 'run_fail' ELSE 'report' END AS event FROM {events}""",
    }[name]


RELATIONS = (
    "execution", "job_raw", "job", "worker", "worker_metric", "worker_executor", "tag", "access_log", "heartbeat", "schedule", "firing",
    "broker", "bucket", "dag_node", "dag_edge", "workflow_node", "workflow_edge", "version", "trigger", "job_event",
)


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


@dataclass
class Tables:
    """Relations and given tables over one folder, as DataFrames."""

    spark: SparkSession
    folder: str
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in RELATIONS:
                sql = relation_sql(name, Dialect(False))
                of = {n: self(n) for n in names_in(sql)}
                if name == "job":  # dealt out by execution once: its rows, graphs and edges then need no other shuffle
                    of["job_raw"] = of["job_raw"].repartition("execution_id")
                self.made[name] = self.spark.sql(sql, **of)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.made[name]


def with_relations(sql: str) -> str:
    """DuckDB SQL in which {relation} names become common table expressions."""
    d, done, parts = Dialect(True), set(), []

    def add(text: str) -> None:
        for n in names_in(text):
            if n in RELATIONS and n not in done:
                own = relation_sql(n, d)
                add(own)
                done.add(n)
                parts.append(f"{n}_r AS ({named(own)})")

    def named(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: f"{m[1]}_r" if m[1] in RELATIONS else m[1], text)

    add(sql)
    body = named(sql).strip()
    if not parts:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH( RECURSIVE)?", "", body, flags=re.I).strip()
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}, {body}"
    return f"WITH {', '.join(parts)} {body}"
