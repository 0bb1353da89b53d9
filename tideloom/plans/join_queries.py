"""Queries of joins, aggregations, transitions, times, picks, graphs, user code and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as D
from ..operators import dag as L
from ..operators import filters as B
from ..operators import joins as C
from ..operators import scans as A
from ..operators import selection as K
from ..operators import temporal as J
from ..operators import transitions as I
from ..operators import usercode as M
from ..sources.relations import NOW
from .registry import query
from .scan_queries import HASH, T_NAMED, _workers

RECENT = "SELECT server_id, count(*) AS accesses, max(dispatch_at) AS last_at FROM {access_log} WHERE dispatch_at > TIMESTAMP '" + NOW + "' - INTERVAL 2880 MINUTE AND dispatch_at <= TIMESTAMP '" + NOW + "' GROUP BY server_id"


@query("""SELECT w.worker_id, coalesce(len(e.executors), 0) AS executors, CAST(coalesce(t.tags, '') AS VARCHAR) AS tags, m.cpu_load FROM {worker} w LEFT JOIN (SELECT worker_id, list(DISTINCT name) AS executors FROM {worker_executor} GROUP BY 1) e USING (worker_id)
    LEFT JOIN (SELECT ref_id, string_agg(tag_name || '=' || tag_value, ',' ORDER BY tag_name, tag_value) AS tags FROM {tag} GROUP BY 1) t ON t.ref_id = w.worker_id LEFT JOIN {worker_metric} m USING (worker_id)""")
def worker_hydrate(t):
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<struct<name:string,value:string>>")), lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
    return _workers(t).select("worker_id", F.coalesce(F.size("executors"), F.lit(0)).cast("long").alias("executors"), tags.alias("tags"), "cpu_load").withColumn("executors", F.greatest("executors", F.lit(0)))


@query("SELECT t.trigger_id, t.publish_version, v.config FROM {trigger} t LEFT JOIN {version} v ON v.ref_id = t.trigger_id AND v.version = t.publish_version")
def trigger_version_join(t):
    v = t("version").select(F.col("ref_id").alias("trigger_id"), F.col("version").alias("publish_version"), "config")
    return t("trigger").select("trigger_id", "publish_version").join(v, ["trigger_id", "publish_version"], "left")


@query("""SELECT t.trigger_id, t.name, v.version FROM (SELECT * FROM {trigger} WHERE NOT is_deleted ORDER BY trigger_id DESC LIMIT 20) t LEFT JOIN {version} v ON v.ref_id = t.trigger_id AND v.version = t.publish_version""")
def trigger_page_hydrate(t):
    page = A.page(A.lookup(t("trigger")), 1, 20, key="trigger_id").select("trigger_id", "name", F.col("publish_version").alias("version"))
    v = t("version").select(F.col("ref_id").alias("trigger_id"), "version", F.col("version").alias("found"))
    return page.join(v, ["trigger_id", "version"], "left").select("trigger_id", "name", F.col("found").alias("version"))


@query("""SELECT execution_id, ref_id, min(worker_id) AS worker_id FROM {job_raw} r WHERE NOT EXISTS (SELECT 1 FROM {job} j WHERE j.execution_id = r.execution_id AND j.ref_id = r.ref_id AND j.execution_id % 2 = 0) GROUP BY 1, 2""")
def idempotent_jobs(t):
    wanted = t("job_raw").select("execution_id", "ref_id", "worker_id")
    return C.create_missing(t("job").filter("execution_id % 2 = 0"), wanted, ["execution_id", "ref_id"])


@query("SELECT CAST(i AS INTEGER) AS bucket FROM range(1, 65) r(i) WHERE i NOT IN (SELECT bucket FROM {bucket})")
def missing_buckets(t):
    return C.missing_buckets(t("bucket"))


ALIVE = "SELECT broker_id FROM {broker} WHERE last_heartbeat_at >= TIMESTAMP '" + NOW + "' - INTERVAL 10 MINUTE"


def _alive(t):
    return A.between(t("broker"), "last_heartbeat_at", "2024-01-16 11:50:00", "2024-01-17 00:00:00").select("broker_id")


@query(f"SELECT bucket, broker_id FROM {{bucket}} WHERE broker_id NOT IN ({ALIVE})")
def orphan_buckets(t):
    return C.orphan_buckets(t("bucket"), _alive(t))


@query(f"""WITH alive AS ({ALIVE}), ring AS (SELECT broker_id, row_number() OVER (ORDER BY broker_id) - 1 AS place FROM alive)
    SELECT bucket, CAST(broker_id AS BIGINT) AS broker_id FROM {{bucket}} WHERE broker_id IN (SELECT broker_id FROM alive)
    UNION ALL SELECT b.bucket, CAST(r.broker_id AS BIGINT) FROM {{bucket}} b JOIN ring r ON r.place = b.bucket % (SELECT count(*) FROM alive) WHERE b.broker_id NOT IN (SELECT broker_id FROM alive)
    UNION ALL SELECT CAST(i AS INTEGER), CAST(20 AS BIGINT) FROM range(1, 65) r(i) WHERE i NOT IN (SELECT bucket FROM {{bucket}})""")
def rebalance_buckets(t):
    return C.rebalance(t("bucket"), _alive(t).select(F.col("broker_id").cast("long").alias("broker_id")), 20)


@query("SELECT execution_id, count(*) FILTER (ref_id IN (1, 2, 3) AND status IN ('succeed', 'running')) AS n FROM {job} GROUP BY 1")
def job_status_count(t):
    return t("job").groupBy("execution_id").agg(F.count_if(F.col("ref_id").isin(1, 2, 3) & F.col("status").isin("succeed", "running")).alias("n"))


PROGRESS = "SELECT execution_id, count(*) AS total_num, count(*) FILTER (status = 'succeed') AS success_num, count(*) FILTER (status = 'failed') AS fail_num FROM {job} GROUP BY 1"


@query(f"SELECT *, total_num = success_num + fail_num AS finished FROM ({PROGRESS}) p")
def task_progress(t):
    return D.progress(t("job"), "execution_id")


@query(f"SELECT execution_id, CASE WHEN total_num <> success_num + fail_num THEN 'running' WHEN fail_num = 0 THEN 'succeed' ELSE 'failed' END AS outcome FROM ({PROGRESS}) p")
def job_outcome_all(t):
    return D.outcome(D.progress(t("job"), "execution_id")).select("execution_id", "outcome")


@query(f"SELECT execution_id, CASE WHEN total_num <> success_num + fail_num THEN 'running' WHEN success_num > 0 THEN 'succeed' ELSE 'failed' END AS outcome FROM ({PROGRESS}) p")
def job_outcome_any(t):
    return D.outcome(D.progress(t("job"), "execution_id"), any_of=True).select("execution_id", "outcome")


@query(f"SELECT s.server_id, coalesce(a.accesses, 0) AS accesses, a.last_at FROM (SELECT worker_id AS server_id FROM {{worker}}) s LEFT JOIN ({RECENT}) a USING (server_id)")
def access_stats(t):
    return D.access_statistics(t("worker").select(F.col("worker_id").alias("server_id")), t("access_log"), NOW, 2880)


@query("SELECT md5(string_agg(CAST(broker_id AS VARCHAR), ',' ORDER BY CAST(broker_id AS VARCHAR))) AS version, count(*) AS brokers FROM {broker}")
def topology_digest(t):
    return D.topology_digest(t("broker"))


@query("SELECT ref_id, ref_type, max(CAST(version AS BIGINT)) AS latest, max(CAST(version AS BIGINT)) + 1 AS next FROM {version} GROUP BY 1, 2")
def latest_version(t):
    return D.latest_version(t("version"))


@query("SELECT execution_id, string_agg(ref_id || ':' || status, ',' ORDER BY CAST(ref_id AS VARCHAR)) AS results FROM {job} WHERE execution_id % 10 = 1 GROUP BY 1")
def task_results(t):
    m = D.map_of_results(t("job").filter("execution_id % 10 = 1").withColumn("ref_id", F.col("ref_id").cast("string")), "execution_id", "ref_id", "status")
    return m.select("execution_id", F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("results"))


@query("SELECT execution_id, string_agg(ref_id || ':' || status, ',' ORDER BY CAST(ref_id AS VARCHAR)) AS results FROM {job} GROUP BY 1")
def task_results_all(t):
    """The result map of every execution; task_results has a tenth of them."""
    m = D.map_of_results(t("job").withColumn("ref_id", F.col("ref_id").cast("string")), "execution_id", "ref_id", "status")
    return m.select("execution_id", F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("results"))


@query("SELECT app_id, sum(cpu_processors) AS weight FROM {worker} JOIN {worker_metric} USING (worker_id) GROUP BY 1")
def weight_sum(t):
    return t("worker").join(t("worker_metric"), "worker_id").groupBy("app_id").agg(F.sum("cpu_processors").alias("weight"))


@query("""SELECT execution_id, ref_id, status IN ('inited', 'dispatched') AS applied, CASE WHEN status IN ('inited', 'dispatched') THEN 'running' ELSE status END AS status FROM {job}""")
def job_start(t):
    return I.guarded_update(t("job"), ("inited", "dispatched"), "running").select("execution_id", "ref_id", "applied", "status")


@query("""SELECT worker_id, CASE WHEN seen >= TIMESTAMP '2024-01-01 00:29:54' THEN 'online' WHEN seen < TIMESTAMP '2024-01-01 00:29:54' THEN 'offline' ELSE status END AS status,
    coalesce(CASE WHEN seen >= TIMESTAMP '2024-01-01 00:29:54' THEN status <> 'online' ELSE status <> 'offline' AND seen IS NOT NULL END, false) AS applied
    FROM {worker} LEFT JOIN (SELECT worker_id, max(last_heartbeat_at) AS seen FROM {worker_metric} GROUP BY worker_id) m USING (worker_id)""")
def worker_liveness(t):
    return I.mark_liveness(t("worker"), t("worker_metric"), "2024-01-01 00:30:00").select("worker_id", "status", "applied")


@query("""SELECT execution_id, ref_id, coalesce(status IN ('running', 'inited') AND worker_id % 2 = 0, false) AS applied, CASE WHEN status IN ('running', 'inited') AND worker_id % 2 = 0 THEN 'failed' ELSE status END AS status FROM {job}""")
def job_fail_owned(t):
    return I.guarded_update(t("job"), ("running", "inited"), "failed", F.col("worker_id") % 2 == 0).select("execution_id", "ref_id", "applied", "status")


@query(f"""SELECT delay_id, CASE WHEN status = 'init' AND NOT s.is_enabled THEN 'invalid' WHEN status = 'init' THEN 'running' ELSE status END AS status FROM {{firing}} JOIN (SELECT schedule_id, is_enabled FROM {{schedule}}) s USING (schedule_id)""")
def firing_start(t):
    rows = t("firing").join(t("schedule").select("schedule_id", "is_enabled"), "schedule_id")
    event = F.when(F.col("is_enabled"), "start").otherwise("invalidate")
    return rows.select("delay_id", I.next_state(F.col("status"), event, I.FIRING_EVENTS).alias("status"))


FOLD = """list_reduce(list_prepend('inited:0', list(event ORDER BY "at", event_id)), lambda a, e: CASE
    WHEN e = 'dispatch_success' AND split_part(a, ':', 1) = 'inited' THEN 'dispatched:' || (CAST(split_part(a, ':', 2) AS INTEGER) + 1)
    WHEN e = 'start' AND split_part(a, ':', 1) IN ('inited', 'dispatched') THEN 'running:' || (CAST(split_part(a, ':', 2) AS INTEGER) + 1)
    WHEN e = 'run_success' AND split_part(a, ':', 1) = 'running' THEN 'succeed:' || (CAST(split_part(a, ':', 2) AS INTEGER) + 1)
    WHEN e = 'run_fail' AND split_part(a, ':', 1) IN ('running', 'inited') THEN 'failed:' || (CAST(split_part(a, ':', 2) AS INTEGER) + 1) ELSE a END)"""


@query(f"SELECT job_id, split_part(s, ':', 1) AS status, CAST(split_part(s, ':', 2) AS BIGINT) AS applied, events FROM (SELECT job_id, {FOLD} AS s, count(*) AS events FROM {{job_event}} GROUP BY job_id) x")
def job_state_machine(t):
    return I.fold_events(t("job_event"), "job_id", ["at", "event_id"], "event", I.JOB_EVENTS, "inited")


@query("""SELECT trigger_id, CASE WHEN coalesce(trim(draft_version), '') <> '' THEN draft_version ELSE publish_version END AS publish_version,
    CASE WHEN coalesce(trim(draft_version), '') <> '' THEN NULL ELSE draft_version END AS draft_version FROM {trigger}""")
def publish_drafts(t):
    return I.publish(t("trigger")).select("trigger_id", "publish_version", "draft_version")


@query(f"""SELECT broker_id, coalesce(last_heartbeat_at < TIMESTAMP '{NOW}' OR broker_id = 3, true) AS granted FROM {{broker}}""")
def lease_locks(t):
    locks = t("broker").select("broker_id", F.col("broker_id").cast("string").alias("owner"), F.col("last_heartbeat_at").alias("expire_at"))
    return I.lease(locks, "3", NOW, 30).select("broker_id", "granted")


@query("""SELECT ref_id, tag_name, tag_value FROM {tag} WHERE ref_id % 3 <> 0 UNION ALL SELECT worker_id, 'host', host FROM {worker} WHERE worker_id % 3 = 0""")
def replace_tags(t):
    new = t("worker").filter("worker_id % 3 = 0").select(F.col("worker_id").alias("ref_id"), F.lit("host").alias("tag_name"), F.col("host").alias("tag_value"))
    return C.replace_by_key(t("tag").select("ref_id", "tag_name", "tag_value"), new, ["ref_id"])


@query("SELECT node_id, \"at\", event_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_id DESC) AS r FROM {heartbeat}) x WHERE r = 1")
def upsert_heartbeats(t):
    beats = t("heartbeat").select("node_id", "at", "event_id")
    return C.upsert(beats.filter("event_id % 2 = 0"), beats.filter("event_id % 2 = 1"), ["node_id"], "event_id")


RATE = "CASE WHEN last_trigger_at IS NULL THEN greatest(start_time + to_seconds(schedule_delay), {now}) ELSE greatest(last_trigger_at + to_seconds(schedule_interval), {now}) END".replace("{now}", f"TIMESTAMP '{NOW}'")


@query(f"SELECT schedule_id, {RATE} AS next_at FROM {{schedule}} WHERE schedule_type = 'fixed_rate'")
def next_fixed_rate(t):
    return t("schedule").filter("schedule_type = 'fixed_rate'").select("schedule_id", J.next_fixed_rate(F.expr(f"TIMESTAMP_NTZ '{NOW}'")).alias("next_at"))


@query(f"""SELECT schedule_id, CASE WHEN last_feedback_at IS NOT NULL THEN greatest(last_feedback_at + to_seconds(schedule_interval), TIMESTAMP '{NOW}') WHEN last_trigger_at IS NOT NULL THEN NULL
    ELSE greatest(start_time + to_seconds(schedule_delay), TIMESTAMP '{NOW}') END AS next_at FROM {{schedule}} WHERE schedule_type = 'fixed_delay'""")
def next_fixed_delay(t):
    return t("schedule").filter("schedule_type = 'fixed_delay'").select("schedule_id", J.next_fixed_delay(F.expr(f"TIMESTAMP_NTZ '{NOW}'")).alias("next_at"))


@query(f"""WITH c AS (SELECT schedule_id, CAST(regexp_extract(schedule_cron, '0/(\\d+)', 1) AS BIGINT) AS step, coalesce(last_trigger_at, TIMESTAMP '{NOW}') AS t0 FROM {{schedule}} WHERE schedule_type = 'cron')
    SELECT schedule_id, date_trunc('hour', t0) + to_minutes(CAST(CASE WHEN (minute(t0) // step + 1) * step > 59 THEN 60 ELSE (minute(t0) // step + 1) * step END AS INTEGER)) AS next_at FROM c""")
def cron_next(t):
    return J.next_cron(t("schedule").filter("schedule_type = 'cron'"), NOW)


@query(f"""SELECT schedule_id, unnest(generate_series(first, last, to_seconds(schedule_interval))) AS trigger_at FROM (SELECT schedule_id, schedule_interval, {RATE} AS first, least(end_time, TIMESTAMP '{NOW}' + INTERVAL 86400 SECOND) AS last
    FROM {{schedule}} WHERE schedule_type = 'fixed_rate' AND schedule_interval > 0) x WHERE first <= last""")
def expand_firings(t):
    return J.expand_fixed_rate(t("schedule"), NOW, 86400)


#: The first minute of a cron `0 0/step * * * ?` strictly after {x}.
CRON_AFTER = "date_trunc('hour', {x}) + to_minutes(CAST(least((minute({x}) // step + 1) * step, CASE WHEN (minute({x}) // step + 1) * step > 59 THEN 60 ELSE 59 END) AS INTEGER))"
CAUGHT = f"""SELECT *, CASE WHEN next_trigger_at >= TIMESTAMP '{NOW}' THEN next_trigger_at WHEN schedule_type = 'cron' THEN {CRON_AFTER.replace('{x}', f"coalesce(last_trigger_at, TIMESTAMP '{NOW}')")}
    WHEN last_trigger_at IS NULL THEN greatest(start_time + to_seconds(schedule_delay), TIMESTAMP '{NOW}') ELSE greatest(last_trigger_at + to_seconds(schedule_interval), TIMESTAMP '{NOW}') END AS next_at
    FROM (SELECT *, CAST(regexp_extract(schedule_cron, '0/(\\d+)', 1) AS BIGINT) AS step FROM (SELECT *, nullif(schedule_cron, '') AS cron FROM {{schedule}}) z) s""".replace("regexp_extract(schedule_cron, '0/(\\d+)', 1) AS BIGINT", "nullif(regexp_extract(schedule_cron, '0/(\\d+)', 1), '') AS BIGINT")


@query(f"SELECT schedule_id, schedule_type, next_at FROM ({CAUGHT}) c")
def catch_up(t):
    """The next trigger of every type; the fixed delay of a past one counts from its last trigger."""
    return J.catch_up(t("schedule"), NOW)


#: Firings of enabled schedules: the caught-up next one if it is valid and in the look-ahead, and what follows it by type.
PLANNED = f"""WITH c AS (SELECT *, greatest(TIMESTAMP '{NOW}', start_time) AS lo, least(end_time, TIMESTAMP '{NOW}' + INTERVAL 600 SECOND) AS hi FROM ({CAUGHT}) x WHERE is_enabled),
    due AS (SELECT * FROM c WHERE next_at BETWEEN lo AND hi),
    f AS (SELECT schedule_id, next_at AS trigger_at FROM due UNION SELECT schedule_id, unnest(generate_series(next_at, hi, to_seconds(schedule_interval))) FROM due WHERE schedule_type = 'fixed_rate'
        UNION SELECT schedule_id, m FROM (SELECT schedule_id, step, hi, unnest(generate_series(date_trunc('minute', next_at) + INTERVAL 1 MINUTE, hi, INTERVAL 1 MINUTE)) AS m FROM due WHERE schedule_type = 'cron') x WHERE minute(m) % step = 0),
    g AS (SELECT schedule_id, count(*) AS firings, max(trigger_at) AS last FROM f GROUP BY 1)"""
AFTER = CRON_AFTER.replace("{x}", "last")


@query(f"""{PLANNED} SELECT schedule_id, coalesce(firings, 0) AS firings, coalesce(last, last_trigger_at) AS last_trigger_at, CASE WHEN firings IS NULL THEN next_at WHEN schedule_type = 'fixed_rate' THEN last + to_seconds(schedule_interval)
    WHEN schedule_type = 'cron' THEN {AFTER} END AS next_trigger_at FROM c LEFT JOIN g USING (schedule_id)""")
def schedule_trigger(t):
    """What triggering leaves of each enabled schedule: number of firings, last and next trigger carried on."""
    return J.plan_firings(t("schedule"), NOW).select("schedule_id", F.size("firings").cast("long").alias("firings"), "last_trigger_at", "next_trigger_at")


@query(f"{PLANNED} SELECT concat(schedule_id, '_', strftime(trigger_at, '%Y-%m-%d %H:%M:%S.%g')) AS delay_id, schedule_id, trigger_at, 'init' AS status FROM f")
def expand_all_firings(t):
    """The firings of all three types."""
    return J.firings_of(J.plan_firings(t("schedule"), NOW))


@query(f"""{PLANNED} SELECT delay_id, schedule_id, trigger_at, status FROM {{firing}} x WHERE NOT (status = 'init' AND schedule_id % 2 = 0)
    UNION ALL SELECT concat(schedule_id, '_', strftime(trigger_at, '%Y-%m-%d %H:%M:%S.%g')), schedule_id, trigger_at, 'init' FROM f WHERE schedule_id % 2 = 0""")
def schedule_save(t):
    """Schedules of even ids change: their initial firings go and they are planned anew."""
    old = t("schedule").withColumn("fingerprint", F.lit("a"))
    new = old.withColumn("fingerprint", F.when(F.col("schedule_id") % 2 == 0, "b").otherwise("a"))
    return J.save(old, new, t("firing"), NOW)[1]


@query(f"""SELECT s.schedule_id, coalesce(e.end_at, s.last_feedback_at) AS last_feedback_at FROM {{schedule}} s LEFT JOIN
    (SELECT schedule_id, max(trigger_at) AS end_at FROM {{job}} WHERE status IN ('succeed', 'failed') GROUP BY 1) e USING (schedule_id)""")
def schedule_feedback(t):
    finished = t("job").filter("status IN ('succeed', 'failed')").select("schedule_id", F.col("trigger_at").alias("end_at"))
    return J.feedback(t("schedule"), finished).select("schedule_id", "last_feedback_at")


@query(f"""SELECT execution_id, CASE WHEN status = 'inited' THEN 'running' ELSE status END AS status, CASE WHEN status = 'inited' THEN TIMESTAMP '{NOW}' END AS start_at FROM {{execution}}""")
def execution_start(t):
    rows = t("execution").withColumn("start_at", F.lit(None).cast("timestamp_ntz"))
    return I.start_executions(rows, F.expr(f"TIMESTAMP_NTZ '{NOW}'")).select("execution_id", "status", "start_at")


@query(f"""SELECT e.execution_id, CASE WHEN e.status = 'running' AND done THEN CASE WHEN failed THEN 'failed' ELSE 'succeed' END ELSE e.status END AS status, CASE WHEN e.status = 'running' AND done THEN TIMESTAMP '{NOW}' END AS end_at
    FROM {{execution}} e LEFT JOIN (SELECT execution_id, count(*) FILTER (status NOT IN ('succeed', 'failed')) = 0 AS done, count(*) FILTER (status = 'failed') > 0 AS failed FROM {{job}} GROUP BY 1) j USING (execution_id)""")
def execution_finish(t):
    """Running executions whose jobs are all finished end, failed if any job did."""
    p = D.progress(t("job"), "execution_id")
    rows = t("execution").join(p.select("execution_id", F.when(F.col("finished"), F.col("fail_num") == 0).alias("ok")), "execution_id", "left").withColumn("end_at", F.lit(None).cast("timestamp_ntz"))
    return I.finish_executions(rows, F.col("ok"), F.expr(f"TIMESTAMP_NTZ '{NOW}'")).select("execution_id", "status", "end_at")


@query("""SELECT execution_id, ref_id, status = 'failed' AND retry_times < 20 AS retried, CASE WHEN status = 'failed' AND retry_times < 20 THEN 'inited' ELSE status END AS status,
    CASE WHEN status = 'failed' AND retry_times < 20 THEN retry_times + 1 ELSE retry_times END AS retry_times FROM {job}""")
def job_retry(t):
    return I.after_failure(t("job"), F.lit(20)).select("execution_id", "ref_id", "retried", "status", "retry_times")


TASK_KEY = "job_id * 4 + event_id % 4"


@query("SELECT task, split_part(s, ':', 1) AS status, CAST(split_part(s, ':', 2) AS BIGINT) AS applied, events FROM (SELECT job_id * 4 + event_id % 4 AS task, " + FOLD.replace("IN ('inited', 'dispatched')", "= 'dispatched'") + " AS s, count(*) AS events FROM {job_event} WHERE worker_id = job_id % 3 GROUP BY 1) x")
def task_state_machine(t):
    """States of tasks, keyed by job and task, after the reports of the worker that has them; others are refused."""
    log = t("job_event").withColumn("task", F.expr(TASK_KEY))
    tasks = log.select("task", (F.col("job_id") % 3).alias("worker_id")).distinct()
    return I.fold_events(I.own_reports(log, tasks, ["task"], "worker_id"), "task", ["at", "event_id"], "event", I.TASK_EVENTS, "inited")


@query("""SELECT delay_id, status FROM {firing} f WHERE NOT (status = 'init' AND schedule_id % 2 = 0)""")
def replan_firings(t):
    old = t("schedule").select("schedule_id", F.lit("a").alias("fingerprint"))
    new = t("schedule").select("schedule_id", F.when(F.col("schedule_id") % 2 == 0, "b").otherwise("a").alias("fingerprint"))
    return J.replan(old, new, t("firing")).select("delay_id", "status")


@query("""SELECT schedule_id, CASE WHEN schedule_type = 'cron' AND schedule_id % 4 = 0 THEN 'cron_missing' ELSE '' END AS errors FROM {schedule}""")
def config_errors(t):
    rows = t("schedule").withColumn("schedule_cron", F.when(F.col("schedule_id") % 4 != 0, F.col("schedule_cron")))
    return rows.select("schedule_id", F.array_join(J.config_errors(), ",").alias("errors"))


CANDIDATES = "SELECT w.app_id, w.worker_id, coalesce(a.accesses, 0) AS accesses, a.last_at FROM {worker} w LEFT JOIN (" + RECENT + ") a ON a.server_id = w.worker_id"


def _candidates(t):
    stats = D.access_statistics(t("worker").select(F.col("worker_id").alias("server_id")), t("access_log"), NOW, 2880)
    return t("worker").join(stats.withColumnRenamed("server_id", "worker_id"), "worker_id")


@query(f"SELECT app_id, worker_id, accesses FROM ({CANDIDATES}) c QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY accesses, worker_id) = 1")
def lfu_pick(t):
    return K.least_frequent(_candidates(t), "app_id", "worker_id").select("app_id", "worker_id", "accesses")


@query(f"SELECT app_id, worker_id, last_at FROM ({CANDIDATES}) c QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY last_at NULLS FIRST, worker_id) = 1")
def lru_pick(t):
    return K.least_recent(_candidates(t), "app_id", "worker_id").select("app_id", "worker_id", "last_at")


@query("SELECT app_id, worker_id FROM {worker} WHERE worker_id = 7")
def appoint_pick(t):
    return K.appoint(t("worker"), "app_id", "worker_id", "7").select("app_id", "worker_id")


@query()
def random_pick(t):
    return K.random_pick(t("worker"), "app_id", 7).select("app_id", "worker_id")


REQUESTS = "SELECT event_id, CAST(user_id % 25 AS INTEGER) AS app_id, CAST(event_id AS BIGINT) AS number FROM events"


def _requests(t):
    return t("events").select("event_id", (F.col("user_id") % 25).cast("int").alias("app_id"), F.col("event_id").alias("number"))


@query(f"""SELECT r.event_id, w.worker_id FROM ({REQUESTS}) r JOIN (SELECT app_id, worker_id, row_number() OVER (PARTITION BY app_id ORDER BY worker_id) - 1 AS place, count(*) OVER (PARTITION BY app_id) AS n FROM {{worker}}) w
    ON w.app_id = r.app_id AND w.place = r.number % w.n""")
def round_robin_equal(t):
    return K.round_robin(_requests(t), t("worker"), "app_id", "worker_id", "number").select("event_id", "worker_id")


@query(f"""WITH RECURSIVE s AS (SELECT app_id, list(worker_id ORDER BY worker_id) AS ids, list(cpu_processors ORDER BY worker_id) AS ws, CAST(sum(cpu_processors) AS BIGINT) AS total FROM {{worker}} JOIN {{worker_metric}} USING (worker_id) WHERE cpu_processors > 0 GROUP BY 1),
    c(app_id, step, pick, cur) AS (SELECT app_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)) FROM s
    UNION ALL SELECT app_id, step + 1, CAST(list_position(up, list_max(up)) AS BIGINT), list_transform(up, lambda x, i: CASE WHEN i = list_position(up, list_max(up)) THEN x - total ELSE x END)
    FROM (SELECT c.app_id, c.step, s.total, list_transform(c.cur, lambda x, i: x + CAST(s.ws[i] AS BIGINT)) AS up FROM c JOIN s USING (app_id) WHERE c.step < s.total) y)
    SELECT r.event_id, s.ids[c.pick] AS worker_id FROM ({REQUESTS}) r JOIN s USING (app_id) JOIN c ON c.app_id = r.app_id AND c.step = r.number % s.total + 1""")
def round_robin_weighted(t):
    servers = t("worker").join(t("worker_metric"), "worker_id")
    return K.weighted_round_robin(_requests(t), servers, "app_id", "worker_id", "cpu_processors", "number").select("event_id", "worker_id")


SLOTS = "CAST(('0x' || substr(d, 8 * j + 7, 2) || substr(d, 8 * j + 5, 2) || substr(d, 8 * j + 3, 2) || substr(d, 8 * j + 1, 2)) AS BIGINT)"


@query(f"""WITH slots AS (SELECT app_id, {SLOTS} AS slot, max(worker_id) AS worker_id FROM (SELECT app_id, worker_id, md5(CAST(worker_id AS VARCHAR) || CAST(i AS VARCHAR)) AS d FROM {{worker}}, range(16) a(i)) x, range(4) b(j) GROUP BY 1, 2),
    req AS (SELECT event_id, app_id, {HASH.replace('{x}', 'number')} AS h FROM ({REQUESTS}) r),
    found AS (SELECT req.event_id, req.app_id, min(slot) AS slot FROM req LEFT JOIN slots ON slots.app_id = req.app_id AND slot >= h GROUP BY 1, 2),
    low AS (SELECT app_id, min(slot) AS slot FROM slots GROUP BY 1)
    SELECT f.event_id, s.worker_id FROM found f JOIN low USING (app_id) JOIN slots s ON s.app_id = f.app_id AND s.slot = coalesce(f.slot, low.slot)""")
def hash_ring_pick(t):
    return K.consistent_hash(_requests(t), t("worker"), "app_id", "worker_id", "number").select("event_id", "worker_id")


@query("SELECT app_id, worker_id, row_number() OVER (PARTITION BY app_id ORDER BY worker_id) AS attempt FROM {worker} WHERE status = 'online' QUALIFY attempt <= 3")
def failover_candidates(t):
    failed = t("worker").filter("status <> 'online'")
    return K.failover(t("worker"), "app_id", failed, "worker_id").select("app_id", "worker_id", F.col("attempt").cast("long").alias("attempt"))


@query(f"""SELECT app_id, worker_id, accesses FROM (SELECT c.*, w.status, w.is_enabled, w.is_deleted, m.available_queue_num, m.free_memory FROM ({CANDIDATES}) c JOIN {{worker}} w USING (worker_id) JOIN {{worker_metric}} m USING (worker_id)) w
    WHERE status = 'online' AND is_enabled AND NOT is_deleted AND available_queue_num > 0 AND free_memory >= 500 AND {T_NAMED}
    AND EXISTS (SELECT 1 FROM {{worker_executor}} e WHERE e.worker_id = w.worker_id AND e.name LIKE 'STANDARD%') QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY accesses, worker_id) = 1""")
def dispatch_plan(t):
    """The worker that gets each app's job: online, enabled, with executor, tags and resources, least used."""
    w = B.available(_workers(t)).filter(F.exists(F.coalesce("executors", F.array().cast("array<string>")), lambda n: n.startswith("STANDARD")))
    w = B.with_resources(B.with_tags(w, [B.TagFilter("tier", "EXISTS")]), memory=500)
    stats = D.access_statistics(w.select(F.col("worker_id").alias("server_id")), t("access_log"), NOW, 2880)
    return K.least_frequent(w.join(stats.withColumnRenamed("server_id", "worker_id"), "worker_id"), "app_id", "worker_id").select("app_id", "worker_id", "accesses")


@query("SELECT count(*) AS edges, count(DISTINCT dag_id) AS dags FROM {dag_edge} e WHERE EXISTS (SELECT 1 FROM {dag_node} n WHERE n.dag_id = e.dag_id AND n.node_id = e.source AND n.node_id <> 4) AND EXISTS (SELECT 1 FROM {dag_node} n WHERE n.dag_id = e.dag_id AND n.node_id = e.target AND n.node_id <> 4)")
def dag_valid_edges(t):
    return L.valid_edges(t("dag_node").filter("node_id <> 4"), t("dag_edge")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dag_id").alias("dags"))


@query("SELECT DISTINCT dag_id, source AS node_id FROM {dag_edge} e WHERE NOT EXISTS (SELECT 1 FROM {dag_edge} x WHERE x.dag_id = e.dag_id AND x.target = e.source)")
def dag_origins(t):
    return L.origins(t("dag_edge"))


@query("SELECT DISTINCT dag_id, target AS node_id FROM {dag_edge} e WHERE NOT EXISTS (SELECT 1 FROM {dag_edge} x WHERE x.dag_id = e.dag_id AND x.source = e.target)")
def dag_lasts(t):
    return L.lasts(t("dag_edge"))


@query("SELECT dag_id, source AS node_id, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS successors FROM {dag_edge} GROUP BY 1, 2")
def dag_successors(t):
    return L.neighbours(t("dag_edge")).filter("successors IS NOT NULL").select("dag_id", "node_id", F.array_join("successors", ",").alias("successors"))


@query("""SELECT n.dag_id, n.node_id, count(*) AS needs, count(*) FILTER (p.status = 'succeed' OR p.status = 'failed' AND p.skip_when_fail) AS met FROM {dag_node} n JOIN {dag_edge} e ON e.dag_id = n.dag_id AND e.target = n.node_id
    LEFT JOIN {dag_node} p ON p.dag_id = e.dag_id AND p.node_id = e.source WHERE n.status = 'inited' GROUP BY 1, 2 HAVING needs = met""")
def dag_ready(t):
    return L.ready(t("dag_node"), t("dag_edge"))


@query("""WITH RECURSIVE reach(dag_id, start, node) AS (SELECT dag_id, source, target FROM {dag_edge} UNION SELECT r.dag_id, r.start, e.target FROM reach r JOIN {dag_edge} e ON e.dag_id = r.dag_id AND e.source = r.node)
    SELECT dag_id, bool_or(start = node) AS cyclic FROM reach GROUP BY 1""")
def dag_cycles(t):
    return L.cycles(t("dag_edge"))


@query("""WITH ends AS (SELECT dag_id FROM {dag_edge} e WHERE NOT EXISTS (SELECT 1 FROM {dag_edge} x WHERE x.dag_id = e.dag_id AND x.target = e.source) GROUP BY 1),
    bad AS (SELECT DISTINCT e.dag_id FROM {dag_edge} e JOIN {dag_node} n ON n.dag_id = e.dag_id AND n.node_id = e.source WHERE n.node_type <> 'start' AND NOT EXISTS (SELECT 1 FROM {dag_edge} x WHERE x.dag_id = e.dag_id AND x.target = e.source))
    SELECT DISTINCT dag_id, CASE WHEN dag_id NOT IN (SELECT dag_id FROM ends) THEN 'no_origin' WHEN dag_id IN (SELECT dag_id FROM bad) THEN 'origin_type' END AS error FROM {dag_node}""")
def dag_validate(t):
    return L.validate(t("dag_node"), t("dag_edge"))


@query("""WITH RECURSIVE v AS (SELECT DISTINCT e.dag_id, e.source, e.target FROM {workflow_edge} e JOIN {workflow_node} a ON a.dag_id = e.dag_id AND a.node_id = e.source JOIN {workflow_node} b ON b.dag_id = e.dag_id AND b.node_id = e.target),
    reach(dag_id, start, node) AS (SELECT dag_id, source, target FROM v UNION SELECT r.dag_id, r.start, e.target FROM reach r JOIN v e ON e.dag_id = r.dag_id AND e.source = r.node),
    cyc AS (SELECT dag_id, bool_or(start = node) AS cyclic FROM reach GROUP BY 1),
    sizes AS (SELECT dag_id, count(*) AS n, count(*) FILTER (node_type IS NULL OR node_type NOT IN ('start', 'executor', 'end')) AS bad FROM {workflow_node} GROUP BY 1),
    origin AS (SELECT dag_id, count(*) AS n, count(*) FILTER (node_type <> 'start') AS wrong FROM {workflow_node} w WHERE EXISTS (SELECT 1 FROM v WHERE v.dag_id = w.dag_id AND v.source = w.node_id) AND NOT EXISTS (SELECT 1 FROM v WHERE v.dag_id = w.dag_id AND v.target = w.node_id) GROUP BY 1),
    final AS (SELECT dag_id, count(*) AS n, count(*) FILTER (node_type <> 'end') AS wrong FROM {workflow_node} w WHERE EXISTS (SELECT 1 FROM v WHERE v.dag_id = w.dag_id AND v.target = w.node_id) AND NOT EXISTS (SELECT 1 FROM v WHERE v.dag_id = w.dag_id AND v.source = w.node_id) GROUP BY 1),
    ids AS (SELECT dag_id FROM {workflow_node} UNION SELECT dag_id FROM {workflow_edge})
    SELECT dag_id, CASE WHEN s.n IS NULL THEN 'empty' WHEN s.n > 100 THEN 'too_many_nodes' WHEN s.bad > 0 THEN 'node_error' WHEN o.n IS NULL THEN 'no_origin' WHEN o.wrong > 0 THEN 'origin_type' WHEN f.n IS NULL THEN 'no_last' WHEN f.wrong > 0 THEN 'last_type'
    WHEN c.cyclic THEN 'cyclic' END AS error FROM ids LEFT JOIN sizes s USING (dag_id) LEFT JOIN origin o USING (dag_id) LEFT JOIN final f USING (dag_id) LEFT JOIN cyc c USING (dag_id)""")
def workflow_validate(t):
    """All stages of a workflow's validation, over graphs with end nodes; dag_validate's SQL has two of them."""
    return L.validate_workflow(t("workflow_node"), t("workflow_edge"))


@query("""SELECT n.dag_id, bool_and(n.status = 'succeed' OR n.status = 'failed' AND n.skip_when_fail) AS succeeded FROM {dag_node} n WHERE NOT EXISTS (SELECT 1 FROM {dag_edge} e WHERE e.dag_id = n.dag_id AND e.source = n.node_id) GROUP BY 1""")
def dag_finished(t):
    return L.finished(t("dag_node"), t("dag_edge"))


@query("SELECT CASE WHEN node_type = 'start' THEN 'input_output' ELSE 'executor' END AS job_type, node_type = 'start' AS at_once, count(*) AS n FROM {dag_node} GROUP BY 1, 2")
def dag_jobs(t):
    return L.jobs_of(t("dag_node")).groupBy("job_type", "at_once").agg(F.count(F.lit(1)).alias("n"))


def _jobs(t):
    return t("part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("input"), (F.col("p_partkey") % 25).cast("int").alias("app_id"))


COUNT_CHARS = M.Executor("count_chars", lambda x: str(len(x)), lambda x: x.split(" "), lambda r: str(sum(int(v) for v in r.values())))


@query("SELECT p_partkey AS job_id, '0' AS task_id, CAST(length(p_name) AS VARCHAR) AS result, 'succeed' AS status, CAST(NULL AS VARCHAR) AS error_msg FROM part")
def run_standalone(t):
    return M.standalone(_jobs(t), COUNT_CHARS)


@query("SELECT p_partkey AS job_id, 'SUB_' || worker_id AS task_id, CAST(length(p_name) AS VARCHAR) AS result FROM part JOIN {worker} ON app_id = p_partkey % 25")
def run_broadcast(t):
    return M.broadcast_run(_jobs(t), t("worker"), COUNT_CHARS).select("job_id", "task_id", "result")


@query("SELECT job_id, 'MAP_' || (i - 1) AS task_id, CAST(length(x[i]) AS VARCHAR) AS result FROM (SELECT p_partkey AS job_id, string_split(p_name, ' ') AS x, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) y")
def run_map(t):
    return M.map_run(_jobs(t), COUNT_CHARS).select("job_id", "task_id", "result")


@query("SELECT p_partkey AS job_id, 'succeed' AS status, CAST(length(replace(p_name, ' ', '')) AS VARCHAR) AS result FROM part")
def run_map_reduce(t):
    return M.map_reduce(_jobs(t), COUNT_CHARS)
