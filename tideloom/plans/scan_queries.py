"""Queries of scans, filters, paging and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import scalar as S
from ..operators import filters as B
from ..operators import joins as C
from ..operators import scans as A
from ..sources.files import next_ids
from ..sources.relations import NOW
from .registry import query

HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296)"


def bucket_sql(x: str) -> str:
    h = HASH.replace("{x}", x)
    return f"CAST(abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % 64 + 1 AS INTEGER)"


@query(f"""SELECT schedule_id, b.bucket, next_trigger_at FROM (SELECT *, {bucket_sql('schedule_id')} AS bucket FROM {{schedule}}) s JOIN (SELECT DISTINCT bucket FROM {{bucket}} WHERE broker_id = 1) b USING (bucket)
    WHERE next_trigger_at <= TIMESTAMP '{NOW}' + INTERVAL 600 SECOND AND start_time <= TIMESTAMP '{NOW}' - INTERVAL 600 SECOND AND end_time >= TIMESTAMP '{NOW}' + INTERVAL 600 SECOND
    AND is_enabled AND NOT is_deleted ORDER BY next_trigger_at, schedule_id LIMIT 100""")
def due_schedules(t):
    s = t("schedule").withColumn("bucket", S.bucket_of(F.col("schedule_id").cast("string")))
    return A.due_schedules(A.owned(s, t("bucket"), 1), NOW, 100).select("schedule_id", "bucket", "next_trigger_at")


@query(f"""SELECT schedule_id, next_trigger_at FROM {{schedule}} WHERE next_trigger_at <= TIMESTAMP '{NOW}' + INTERVAL 600 SECOND
    AND next_trigger_at BETWEEN start_time AND end_time AND is_enabled AND NOT is_deleted""")
def due_schedules_valid(t):
    return A.due_schedules(t("schedule"), NOW, strict=False).select("schedule_id", "next_trigger_at")


@query(f"""SELECT delay_id, schedule_id, trigger_at FROM {{firing}} WHERE bucket IN (SELECT bucket FROM {{bucket}} WHERE broker_id = 1)
    AND trigger_at <= TIMESTAMP '{NOW}' + INTERVAL 60 SECOND AND status = 'init' AND NOT is_deleted""")
def due_firings(t):
    return A.due_firings(A.owned(t("firing"), t("bucket"), 1), NOW).select("delay_id", "schedule_id", "trigger_at")


@query(f"SELECT count(*) AS expired, min(trigger_at) AS first_at, max(trigger_at) AS last_at FROM {{firing}} WHERE trigger_at <= TIMESTAMP '2024-01-10 00:00:00'")
def retention_scan(t):
    return A.expired_firings(t("firing"), "2024-01-10 00:00:00").agg(F.count(F.lit(1)).alias("expired"), F.min("trigger_at").alias("first_at"), F.max("trigger_at").alias("last_at"))


@query("SELECT status, count(*) AS n FROM {firing} WHERE trigger_at > TIMESTAMP '2024-01-10 00:00:00' GROUP BY status")
def retained_firings(t):
    return A.retained_firings(t("firing"), "2024-01-10 00:00:00").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT schedule_id, schedule_type FROM {schedule} WHERE schedule_id IN (58, 30, 7) AND NOT is_deleted")
def schedule_lookup(t):
    return A.lookup(t("schedule"), schedule_id=[58, 30, 7]).select("schedule_id", "schedule_type")


@query("SELECT worker_id, status FROM {worker} WHERE app_id = 3 AND status IN ('online', 'offline') AND NOT is_deleted")
def workers_by_app(t):
    return A.lookup(t("worker"), app_id=3, status=["online", "offline"]).select("worker_id", "status")


@query("SELECT worker_id, name FROM {worker_executor} WHERE worker_id IN (SELECT worker_id FROM {worker} WHERE app_id < 5)")
def executors_by_workers(t):
    return A.multi_get(t("worker_executor"), t("worker").filter("app_id < 5").select("worker_id")).select("worker_id", "name")


@query("SELECT * FROM {worker_metric} WHERE worker_id IN (SELECT worker_id FROM {worker} WHERE app_id < 5)")
def metrics_by_workers(t):
    return A.multi_get(t("worker_metric"), t("worker").filter("app_id < 5").select("worker_id"))


@query("SELECT worker_id, last_heartbeat_at FROM {worker_metric} WHERE last_heartbeat_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-03 00:00:00' ORDER BY worker_id DESC LIMIT 20 OFFSET 20")
def metrics_by_heartbeat_page(t):
    rows = A.between(t("worker_metric"), "last_heartbeat_at", "2024-01-01 01:00:00", "2024-01-03 00:00:00")
    return A.page(rows, 2, key="worker_id").select("worker_id", "last_heartbeat_at")


@query("SELECT broker_id FROM {broker} WHERE last_heartbeat_at BETWEEN TIMESTAMP '2024-01-16 11:50:00' AND TIMESTAMP '2024-01-16 12:00:00'")
def brokers_by_heartbeat(t):
    return A.between(t("broker"), "last_heartbeat_at", "2024-01-16 11:50:00", NOW).select("broker_id")


@query("SELECT bucket FROM {bucket} WHERE broker_id = 1")
def buckets_by_broker(t):
    return A.lookup(t("bucket"), broker_id=1).select("bucket")


@query("SELECT e.* FROM {execution} e WHERE EXISTS (SELECT 1 FROM {execution} k WHERE k.execution_id % 100 = 0 AND k.executable_id = e.executable_id AND k.executable_type = e.executable_type AND k.trigger_at = e.trigger_at)")
def execution_by_natural_key(t):
    key = ["executable_id", "executable_type", "trigger_at"]
    return A.multi_get(t("execution"), t("execution").filter("execution_id % 100 = 0").select(*key)).select(*t("execution").columns)


@query("SELECT j.execution_id, j.ref_id, e.executable_type, e.status AS execution_status, coalesce(c.c_name, '') AS executable FROM {job} j LEFT JOIN {execution} e USING (execution_id) LEFT JOIN customer c ON c.c_custkey = e.executable_id WHERE j.status = 'failed'")
def job_hydrate(t):
    e = t("execution").select("execution_id", "executable_id", "executable_type", F.col("status").alias("execution_status"))
    c = t("customer").select(F.col("c_custkey").alias("executable_id"), F.col("c_name").alias("executable"))
    jobs = t("job").filter("status = 'failed'").join(e, "execution_id", "left").join(c, "executable_id", "left")
    return jobs.select("execution_id", "ref_id", "executable_type", "execution_status", F.coalesce("executable", F.lit("")).alias("executable"))


@query("SELECT ref_id, tag_name, tag_value FROM {tag} WHERE ref_type = 'worker' AND ref_id IN (SELECT worker_id FROM {worker} WHERE NOT is_enabled)")
def tags_by_refs(t):
    return A.multi_get(t("tag"), t("worker").filter(~F.col("is_enabled")).select(F.col("worker_id").alias("ref_id"))).filter("ref_type = 'worker'").select("ref_id", "tag_name", "tag_value")


@query("SELECT trigger_id, name FROM {trigger} WHERE name LIKE '%01%2%' AND NOT is_deleted")
def trigger_name_like(t):
    return A.name_like(A.lookup(t("trigger")), "name", "01%2").select("trigger_id", "name")


@query("SELECT trigger_id, name, is_enabled FROM {trigger} WHERE NOT is_deleted ORDER BY is_enabled, trigger_id DESC LIMIT 50 OFFSET 100")
def trigger_page(t):
    return A.page(A.lookup(t("trigger")), 3, 50, [("is_enabled", "asc")], "trigger_id").select("trigger_id", "name", "is_enabled")


@query("SELECT worker_id, app_id, host, port FROM {worker} WHERE NOT is_deleted AND status = 'online' ORDER BY worker_id DESC LIMIT 20")
def worker_page(t):
    return api.page_of(t("worker"), "worker_id", status="online", app_id=None)[0].select("worker_id", "app_id", "host", "port")


@query("SELECT execution_id, executable_id, executable_type, trigger_at, status FROM {execution} WHERE status = 'running' ORDER BY execution_id DESC LIMIT 20 OFFSET 20")
def execution_page(t):
    return api.page_of(t("execution"), "execution_id", 2, status="running")[0].select("execution_id", "executable_id", "executable_type", "trigger_at", "status")


@query("SELECT count(*) AS total, count(*) > 40 AS has_next FROM {execution} WHERE status = 'running'")
def execution_page_info(t):
    return api.page_of(t("execution"), "execution_id", 2, status="running")[1]


@query("SELECT ref_id, worker_id, status FROM {job} WHERE execution_id = (SELECT min(execution_id) FROM {job})")
def jobs_of_execution(t):
    """The jobs of an execution and the workers that hold them."""
    first = t("job").agg(F.min("execution_id").alias("execution_id"))
    return A.multi_get(t("job"), first).select("ref_id", "worker_id", "status")


@query("SELECT count(*) AS total, count(*) > 60 AS has_next FROM {trigger} WHERE NOT is_deleted")
def trigger_page_info(t):
    return A.page_info(A.lookup(t("trigger")), 3, 20)


@query("""SELECT trigger_id, nullif(trim(publish_version), '') AS publish, nullif(trim(draft_version), '') AS draft, coalesce(nullif(trim(publish_version), ''), nullif(trim(draft_version), '')) AS publish_first,
    coalesce(nullif(trim(draft_version), ''), nullif(trim(publish_version), '')) AS draft_first FROM {trigger}""")
def version_modes(t):
    return t("trigger").select("trigger_id", *(B.version_of(m).alias(m.lower()) for m in ("PUBLISH", "DRAFT", "PUBLISH_FIRST", "DRAFT_FIRST")))


def _workers(t):
    return C.hydrate_workers(t("worker"), t("worker_executor"), t("tag"), t("worker_metric"))


def tag_sql(condition: str) -> str:
    return f"SELECT worker_id FROM {{worker}} w WHERE {condition}"


T_NAMED = "EXISTS (SELECT 1 FROM {tag} t WHERE t.ref_id = w.worker_id AND t.tag_name = 'tier')"
T_EQUAL = "EXISTS (SELECT 1 FROM {tag} t WHERE t.ref_id = w.worker_id AND t.tag_name = 'tier' AND t.tag_value = '0')"


@query(tag_sql(T_NAMED))
def tag_exists(t):
    return B.with_tags(_workers(t), [B.TagFilter("tier", "EXISTS")]).select("worker_id")


@query(tag_sql(f"NOT {T_NAMED}"))
def tag_not_exists(t):
    return B.with_tags(_workers(t), [B.TagFilter("tier", "NOT_EXISTS")]).select("worker_id")


@query(tag_sql(T_EQUAL))
def tag_match(t):
    return B.with_tags(_workers(t), [B.TagFilter("tier", "MUST_MATCH_VALUE", "0")]).select("worker_id")


@query(tag_sql(f"{T_NAMED} AND NOT {T_EQUAL}"))
def tag_not_match(t):
    return B.with_tags(_workers(t), [B.TagFilter("tier", "MUST_NOT_MATCH_VALUE", "0")]).select("worker_id")


@query(tag_sql("EXISTS (SELECT 1 FROM {tag} t WHERE t.ref_id = w.worker_id AND t.tag_name = 'region' AND regexp_matches(t.tag_value, 'A[MS]')) AND " + T_NAMED))
def tag_regex(t):
    return B.with_tags(_workers(t), [B.TagFilter("region", "MUST_MATCH_VALUE_REGEX", "A[MS]"), B.TagFilter("tier", "EXISTS")]).select("worker_id")


@query("SELECT worker_id FROM {worker} JOIN {worker_metric} USING (worker_id) WHERE available_queue_num > 0 AND cpu_load >= 2 AND free_memory >= 1000")
def resource_filter(t):
    return B.with_resources(_workers(t), 2.0, 1000).select("worker_id")


@query("SELECT worker_id FROM {worker} WHERE status = 'online' AND is_enabled AND NOT is_deleted AND worker_id IN (SELECT worker_id FROM {worker_executor} WHERE name LIKE 'PROMO%')")
def executor_filter(t):
    name = t("worker_executor").filter("name LIKE 'PROMO%'").select("worker_id")
    return A.multi_get(B.available(t("worker")), name).select("worker_id")


@query(f"""SELECT delay_id FROM {{firing}} JOIN (SELECT schedule_id, start_time, end_time FROM {{schedule}}) USING (schedule_id)
    WHERE trigger_at BETWEEN greatest(TIMESTAMP '{NOW}', start_time) AND least(end_time, TIMESTAMP '{NOW}' + INTERVAL 600 SECOND)""")
def firings_in_window(t):
    return B.in_window(t("firing").join(t("schedule").select("schedule_id", "start_time", "end_time"), "schedule_id"), NOW).select("delay_id")


@query(f"SELECT schedule_id, {bucket_sql('schedule_id')} AS bucket FROM {{schedule}}")
def bucket_of(t):
    return t("schedule").select("schedule_id", S.bucket_of(F.col("schedule_id").cast("string")).alias("bucket"))


@query("SELECT trigger_id, md5(name) AS md5_hex, sha1(name) AS sha1_hex FROM {trigger}")
def digests(t):
    return t("trigger").select("trigger_id", F.md5("name").alias("md5_hex"), F.sha1("name").alias("sha1_hex"))


@query("SELECT schedule_id, concat(schedule_id, '_', strftime(next_trigger_at, '%Y-%m-%d %H:%M:%S.%g')) AS delay_id FROM {schedule}")
def delay_ids(t):
    return t("schedule").select("schedule_id", S.delay_id(F.col("schedule_id"), F.col("next_trigger_at")).alias("delay_id"))


@query("SELECT schedule_id, md5(concat('{{\"schedule_id\":', schedule_id, ',\"schedule_type\":\"', schedule_type, '\"', CASE WHEN schedule_cron IS NULL THEN '' ELSE concat(',\"schedule_cron\":\"', schedule_cron, '\"') END, '}}')) AS fingerprint FROM {schedule}".replace("{{", "' || chr(123) || '").replace("}}", "' || chr(125) || '"))
def schedule_fingerprint(t):
    return t("schedule").select("schedule_id", S.fingerprint(F.col("schedule_id"), F.col("schedule_type"), F.col("schedule_cron")).alias("fingerprint"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(t):
    return t("events").select("event_id", S.from_json(F.col("props"), "k bigint, missing string")["k"].alias("k"))


@query("""SELECT o_orderkey, o_orderpriority AS type_tag FROM orders""")
def json_type_tag(t):
    text = F.to_json(F.struct(F.concat(F.lit("io.example."), F.col("o_orderpriority")).alias("type"), F.col("o_orderkey").alias("id")))
    return t("orders").select("o_orderkey", S.json_type(text).alias("type_tag"))


@query("""SELECT event_id, date_trunc('day', ts) AS begin_at, date_trunc('day', ts) + INTERVAL 86399 SECOND + INTERVAL 999 MILLISECOND AS end_at, epoch_us(ts) // 1000 AS ms FROM events""")
def day_bounds(t):
    ts = F.col("ts")
    return t("events").select("event_id", S.begin_of_day(ts).alias("begin_at"), S.end_of_day(ts).alias("end_at"), S.epoch_ms(ts).alias("ms"))


@query(f"""SELECT schedule_id, greatest(start_time, last_trigger_at) AS later, start_time + to_seconds(schedule_delay) AS started,
    CASE WHEN last_feedback_at IS NOT NULL THEN greatest(0, epoch_ms(last_feedback_at) - epoch_ms(TIMESTAMP '{NOW}')) END AS wait_ms FROM {{schedule}}""")
def time_functions(t):
    now = F.expr(f"TIMESTAMP_NTZ '{NOW}'")
    return t("schedule").select("schedule_id", S.later_of(F.col("start_time"), F.col("last_trigger_at")).alias("later"), S.plus_seconds(F.col("start_time"), F.col("schedule_delay")).alias("started"), S.ms_until(F.col("last_feedback_at"), now).alias("wait_ms"))


@query("""SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS known, count(*) AS n FROM events GROUP BY 1, 2""")
def enum_parse(t):
    return t("events").groupBy("event_type", S.enum_of(F.col("event_type"), ("click", "view")).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, status IN ('succeed', 'failed', 'cancelled', 'terminated') AS finished, count(*) AS n FROM {job} GROUP BY 1, 2")
def status_classes(t):
    return t("job").groupBy("status", S.is_finished(F.col("status")).alias("finished")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT worker_id, CASE WHEN worker_id % 5 = 0 THEN NULL ELSE protocol END AS protocol, CASE WHEN worker_id % 5 = 0 THEN NULL ELSE host END AS host, CASE WHEN worker_id % 5 = 0 THEN NULL ELSE port END AS port FROM {worker}""")
def address_parse(t):
    url = F.when(F.col("worker_id") % 5 == 0, F.concat("host", F.lit("//x"))).otherwise(F.concat("protocol", F.lit("://"), "host", F.lit(":"), F.col("port").cast("string")))
    return t("worker").select("worker_id", S.address(url).alias("a")).select("worker_id", "a.protocol", "a.host", "a.port")


@query("SELECT execution_id, ref_id, retry_times < 3 AS retry FROM {job} WHERE status = 'failed'")
def retry_allowed(t):
    return t("job").filter("status = 'failed'").select("execution_id", "ref_id", S.retry_allowed(F.col("retry_times"), F.lit(3)).alias("retry"))


@query("SELECT execution_id, ref_id, status FROM {job} j WHERE EXISTS (SELECT 1 FROM {job} k WHERE k.execution_id % 50 = 1 AND k.ref_id = 1 AND k.execution_id = j.execution_id AND k.ref_id = j.ref_id)")
def job_by_natural_key(t):
    keys = t("job").filter("execution_id % 50 = 1 AND ref_id = 1").select("execution_id", "ref_id")
    return A.multi_get(t("job"), keys).select("execution_id", "ref_id", "status")


@query("SELECT v.ref_id, v.version, v.description FROM {version} v WHERE EXISTS (SELECT 1 FROM {trigger} t WHERE t.trigger_id = v.ref_id AND t.draft_version = v.version)")
def versions_by_ids(t):
    keys = t("trigger").filter("draft_version IS NOT NULL").select(F.col("trigger_id").alias("ref_id"), F.lit("trigger").alias("ref_type"), F.col("draft_version").alias("version"))
    return A.multi_get(t("version"), keys).select("ref_id", "version", "description")


@query(f"SELECT concat('broker-', broker_id) AS name, CAST(broker_id AS VARCHAR) AS owner, last_heartbeat_at AS expire_at FROM {{broker}} WHERE broker_id = 3")
def lock_by_name(t):
    locks = t("broker").select(F.col("host").alias("name"), F.col("broker_id").cast("string").alias("owner"), F.col("last_heartbeat_at").alias("expire_at"))
    return A.lookup(locks, name="broker-3")


@query("SELECT worker_id FROM {worker} WHERE worker_id IN (SELECT worker_id FROM {worker_executor} WHERE name = (SELECT min(name) FROM {worker_executor}))")
def worker_with_executor(t):
    return B.with_executor(_workers(t), t("worker_executor").agg(F.min("name")).first()[0]).select("worker_id")


@query("SELECT count(*) AS workers FROM {worker} WHERE false")
def tag_unknown_condition(t):
    return B.with_tags(_workers(t), [B.TagFilter("tier", "SOMETHING_ELSE")]).agg(F.count(F.lit(1)).alias("workers"))


@query("SELECT worker_id, CASE WHEN worker_id % 2 = 0 THEN 'size=10.0,zone=a' ELSE 'size=10.0' END AS parameters FROM {worker}".replace("10.0", "1"))
def lb_parameters(t):
    params = F.create_map(F.lit("worker.lb.size"), F.lit("1"), F.lit("other"), F.lit("x"), F.lit("worker.lb."), F.lit("y"), F.lit("worker.lb.zone"), F.when(F.col("worker_id") % 2 == 0, F.lit("a")))
    own = t("worker").select("worker_id", B.parameters(params).alias("p"))
    return own.select("worker_id", F.array_join(F.array_sort(F.transform(F.map_entries("p"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("parameters"))


@query("SELECT worker_id, 'host=' || host || ',app=' || app_id AS tags FROM {worker}")
def key_value_tags(t):
    texts = F.array(F.concat(F.lit("host="), "host"), F.concat(F.lit(" app = "), F.col("app_id").cast("string")), F.lit("broken"), F.lit("=x"), F.concat(F.lit("host="), "host"))
    own = t("worker").select("worker_id", texts.alias("texts")).select("worker_id", B.parse_tags("texts").alias("t"))
    return own.select("worker_id", F.array_join(F.transform("t", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",").alias("tags"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS above FROM {trigger}")
def id_segments(t):
    """Ids for all triggers, a block to each partition: distinct and above the current one."""
    ids = next_ids(t.spark, 10_000, t("trigger").select("name").repartition(5))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("id") > 10_000).alias("above"))


@query("SELECT count(*) AS n, true AS right_length FROM {trigger}")
def short_uuids(t):
    ids = t("trigger").select(S.short_uuid().alias("u"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}$")).alias("right_length"))
