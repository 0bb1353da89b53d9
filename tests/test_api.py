from datetime import datetime

from tideloom import api


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_header_life(spark):
    h = spark.createDataFrame([], api.HEADER)
    v = spark.createDataFrame([], api.VERSION)
    h = api.create(h, spark.createDataFrame([("a", "x"), ("b_1", None)], "name string, description string"))
    assert rows(h, "id", "name", "is_enabled") == [(10_001, "a", False), (10_002, "b_1", False)]
    h = api.update(h, spark.createDataFrame([(10_001, "c", "y"), (5, "z", "z")], "id long, name string, description string"))
    h, v = api.draft(h, v, spark.createDataFrame([(10_001, "first", "{}")], "ref_id long, description string, config string"), "trigger")
    h = api.publish(h, 10_001, 10_002)
    h, v = api.draft(h, v, spark.createDataFrame([(10_001, "second", "[]")], "ref_id long, description string, config string"), "trigger")
    assert rows(h.fillna(""), "name", "publish_version", "draft_version") == [("b_1", "", ""), ("c", "1", "2")]
    assert rows(api.get(h, v, 10_001), "config") == [("{}",)] and rows(api.get(h, v, 10_001, "DRAFT"), "config") == [("[]",)]
    h = api.disable(api.enable(h, 10_001, 10_002), 10_002)
    assert rows(h, "id", "is_enabled") == [(10_001, True), (10_002, False)]
    firings = spark.createDataFrame([(10_001, "init"), (10_001, "succeed"), (10_002, "init"), (None, "init")], "schedule_id long, status string")
    h, left = api.delete(h, firings, 10_001)
    assert left.count() == 3 and rows(h, "id", "is_deleted") == [(10_001, True), (10_002, False)]
    got, info = api.page(h, name="_")
    assert rows(got, "id") == [(10_002,)] and tuple(info.first()) == (1, False)


def test_workers_report(spark):
    jobs = spark.createDataFrame([(1, "inited", None), (2, "running", "w1"), (3, "running", "w1"), (4, "failed", "w1")], "job_id long, status string, worker_address string")
    said = spark.createDataFrame([(1, "start", "w9"), (2, "run_success", "w2"), (3, "run_fail", "w1"), (4, "start", "w1")], "job_id long, event string, worker_address string")
    assert rows(api.report(jobs, said).fillna(""), "job_id", "status", "worker_address") == [(1, "running", "w9"), (2, "running", "w1"), (3, "failed", "w1"), (4, "failed", "w1")]
    several = spark.createDataFrame([(1, "run_success", "w9", 3), (1, "start", "w9", 1), (1, "start", "w8", 2), (3, "run_fail", "w1", 1), (3, "run_success", "w1", 2)], "job_id long, event string, worker_address string, at int")
    assert rows(api.report(jobs, several).fillna(""), "job_id", "status", "worker_address") == [(1, "succeed", "w9"), (2, "running", "w1"), (3, "failed", "w1"), (4, "failed", "w1")]
    m = spark.createDataFrame([(1, 5, datetime(2024, 1, 2)), (2, 5, datetime(2024, 1, 2))], "worker_id long, free int, last_heartbeat_at timestamp_ntz")
    b = spark.createDataFrame([(1, 6, datetime(2024, 1, 3)), (2, 6, datetime(2024, 1, 1))], "worker_id long, free int, last_heartbeat_at timestamp_ntz")
    assert rows(api.heartbeat(m, b), "worker_id", "free") == [(1, 6), (2, 5)]


def test_schedules_are_planned_when_enabled(spark):
    day = datetime(2024, 1, 1)
    schema = "schedule_id long, schedule_type string, start_time timestamp_ntz, end_time timestamp_ntz, schedule_delay long, schedule_interval long, schedule_cron string, last_trigger_at timestamp_ntz, last_feedback_at timestamp_ntz, next_trigger_at timestamp_ntz, is_enabled boolean"
    s = spark.createDataFrame([(i, "fixed_rate", day, datetime(2025, 1, 1), 0, 300, None, None, None, datetime(2024, 1, 1, 12), False) for i in (1, 2)], schema)
    there = spark.createDataFrame([("1_2024-01-01 12:00:00.000", 1, datetime(2024, 1, 1, 12), "running")], "delay_id string, schedule_id long, trigger_at timestamp_ntz, status string")
    on, firings = api.enable_schedules(s, there, "2024-01-01 12:00:00", 1)
    assert [(r["schedule_id"], r["trigger_at"].minute, r["status"]) for r in firings.orderBy("trigger_at").collect()] == [(1, 0, "running"), (1, 5, "init"), (1, 10, "init")]
    assert rows(on, "schedule_id", "is_enabled") == [(1, True), (2, False)] and rows(api.disable_schedules(on, 1), "is_enabled") == [(False,), (False,)]
    apps = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "a", True)], "app_id long, name string, is_deleted boolean")
    got, info = api.page_of(apps, "app_id", name="a")
    assert rows(got, "app_id") == [(1,)] and tuple(info.first()) == (1, False) and api.page_of(apps, "app_id", name=None)[0].count() == 2 and rows(api.get_by(apps, name="b"), "app_id") == [(2,)]
