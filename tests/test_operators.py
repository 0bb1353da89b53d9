"""Cases that the given tables don't hold: nulls, ties, cycles, odd configurations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideloom.functions import scalar as S
from tideloom.functions.cron import CronError, next_after, parse
from tideloom.operators import aggregates as D
from tideloom.operators import dag as L
from tideloom.operators import filters as B
from tideloom.operators import joins as C
from tideloom.operators import selection as K
from tideloom.operators import temporal as J
from tideloom.operators import transitions as I
from tideloom.operators import usercode as M
from tideloom.sources import files

AT = datetime(2024, 1, 31, 10, 29, 30)


@pytest.mark.parametrize(
    "expression, dialect, want",
    [
        ("0/1 * * * * ? *", "QUARTZ", datetime(2024, 1, 31, 10, 29, 31)),
        ("0 0/30 * * * ?", "QUARTZ", datetime(2024, 1, 31, 10, 30)),
        ("0 0 12 L * ?", "QUARTZ", datetime(2024, 1, 31, 12)),
        ("0 0 9 ? * 2", "QUARTZ", datetime(2024, 2, 5, 9)),
        ("0 0 9 ? * MON-FRI", "QUARTZ", datetime(2024, 2, 1, 9)),
        ("0 0 9 ? * 6#3", "QUARTZ", datetime(2024, 2, 16, 9)),
        ("0 0 9 ? * 6L", "QUARTZ", datetime(2024, 2, 23, 9)),
        ("0 0 9 15W 6 ?", "QUARTZ", datetime(2024, 6, 14, 9)),
        ("0 0 0 29 2 ? 2025-2031", "QUARTZ", datetime(2028, 2, 29)),
        ("*/15 * * * *", "UNIX", datetime(2024, 1, 31, 10, 30)),
        ("0 0 13 * 5", "UNIX", datetime(2024, 2, 2)),
        ("0 0 * * 7", "UNIX", datetime(2024, 2, 4)),
        ("0 0 0 30 2 ?", "QUARTZ", None),
        ("0 0 * * * *", "QUARTZ", None),
        ("61 * * * *", "UNIX", None),
        (None, "QUARTZ", None),
    ],
)
def test_cron(expression, dialect, want):
    assert next_after(expression, dialect, AT) == want


def test_cron_errors():
    for bad in ("0 0 0 ? * ?", "0 0", "a * * * * ?"):
        with pytest.raises(CronError):
            parse(bad)


def java(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_java_hash(spark):
    ids = ["", "a", "polygenelubricants", "12345", "worker-é", None]
    got = spark.createDataFrame([(x,) for x in ids], "id string").select(S.java_hash(F.col("id")), S.bucket_of(F.col("id"))).collect()
    assert [r[0] for r in got] == [None if x is None else java(x) for x in ids]
    assert got[2][1] == 1 and got[5][1] is None


def test_scalars(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}', "http://h:80", datetime(2022, 12, 21, 13, 2, 58, 851000)), (" ", "h:80", None), ("{bad", None, None)], "j string, u string, t timestamp_ntz")
    r = df.select(S.from_json(F.col("j"), "a int")["a"], S.address(F.col("u"))["port"], S.epoch_ms(F.col("t")), S.parse_time(F.lit("2022-12-21 13:02:58")), S.to_json(F.when(F.col("t").isNotNull(), F.struct("t"))), S.ms_until(F.col("t"), F.col("t"))).collect()
    assert [x[0] for x in r] == [1, None, None] and [x[1] for x in r] == [80, None, None] and r[0][2] == 1671627778851
    assert r[0][3] == datetime(2022, 12, 21, 13, 2, 58) and r[0][4] == '{"t":"2022-12-21 13:02:58.851"}' and r[1][4] == "" and [x[5] for x in r] == [0, None, None]


WORKER = "worker_id long, app_id int, tags array<struct<name:string,value:string>>, executors array<string>, available_queue_num int, cpu_load double, free_memory long"


def test_filters_with_missing_parts(spark):
    w = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, 1, [("z", "a"), ("z", "b")], ["e"], 1, 2.0, 5), (3, 1, [("z", None)], ["f"], 0, 9.0, 9)], WORKER)
    ids = lambda df: sorted(r[0] for r in df.select("worker_id").collect())
    one = lambda c, v=None: ids(B.with_tags(w, [B.TagFilter("z", c, v)]))
    assert one("EXISTS") == [2, 3] and one("NOT_EXISTS") == [1] and one("MUST_MATCH_VALUE", "b") == [2]
    assert one("MUST_NOT_MATCH_VALUE", "b") == [3] and one("MUST_MATCH_VALUE_REGEX", "^a") == [2] and one("OTHER") == []
    assert ids(B.with_tags(w, [])) == [1, 2, 3] and ids(B.with_executor(w, "e")) == [2] and ids(B.with_resources(w)) == [2] and ids(B.with_resources(w, 3.0)) == []


def test_parameters_and_tags(spark):
    df = spark.createDataFrame([({"worker.lb.k": "v", "x": "y", "worker.lb.": "n"}, ["a=b", "a=b", "c", "=d", "e= "])], "params map<string,string>, t array<string>")
    r = df.select(B.parameters(), B.parse_tags("t")).first()
    assert r[0] == {"k": "v"} and [tuple(x) for x in r[1]] == [("a", "b")]


def test_ring_matches_a_tree(spark):
    import hashlib

    servers, keys = [1, 2, 3, 10], [f"key{i}" for i in range(300)] + ["polygenelubricants"]
    slots = {}
    for s in sorted(servers):
        for i in range(16):
            d = hashlib.md5(f"{s}{i}".encode()).digest()
            for j in range(4):
                slots[int.from_bytes(d[4 * j : 4 * j + 4], "little")] = s
    order = sorted(slots)
    want = {k: slots[next((x for x in order if x >= java(k) % (1 << 32)), order[0])] for k in keys}
    got = K.consistent_hash(spark.createDataFrame([(1, k) for k in keys], "g int, k string"), spark.createDataFrame([(1, s) for s in servers], "g int, id long"), "g", "id", "k").collect()
    assert {r["k"]: r["id"] for r in got} == want and len(got) == len(keys)


def test_smooth_cycle():
    assert K.smooth_cycle([5, 1, 1]) == [0, 0, 1, 0, 2, 0, 0]
    assert K.smooth_cycle([]) == []


def test_dags(spark):
    nodes = spark.createDataFrame([("a", i, "start" if i == 1 else "executor", s, i == 2) for i, s in ((1, "succeed"), (2, "failed"), (3, "succeed"), (4, "inited"), (9, "inited"))] + [("b", i, "executor", "inited", False) for i in (1, 2, 3)] + [("c", 1, "start", "inited", False)], "dag_id string, node_id int, node_type string, status string, skip_when_fail boolean")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 4), ("a", 3, 4), ("a", 3, 4), ("a", 4, 77), ("b", 1, 2), ("b", 2, 3), ("b", 3, 2)], "dag_id string, source int, target int")
    real = L.valid_edges(nodes, edges)
    pairs = lambda df: sorted(tuple(r) for r in df.select("dag_id", "node_id").collect())
    assert real.count() == 7 and pairs(L.origins(real)) == [("a", 1), ("b", 1)] and pairs(L.lasts(real)) == [("a", 4)]
    assert pairs(L.ready(nodes, real)) == [("a", 4)]  # the failure of 2 may be skipped
    assert {r[0]: r[1] for r in L.cycles(real).collect()} == {"a": False, "b": True}
    assert {r[0]: r[1] for r in L.validate(nodes, edges).collect()} == {"a": None, "b": "origin_type", "c": "no_origin"}


def test_every_stage_of_validation(spark):
    kinds = {"ok": "start executor end", "last": "start executor executor", "type": "start script end", "cycle": "start executor executor end", "loop": "start executor end", "first": "executor executor end", "alone": "start"}
    nodes = spark.createDataFrame([(d, i, k) for d, ks in kinds.items() for i, k in enumerate(ks.split(), 1)] + [("many", i, "executor") for i in range(101)], "dag_id string, node_id int, node_type string")
    chain = [(d, i, i + 1) for d, ks in kinds.items() for i in range(1, len(ks.split()))]
    edges = spark.createDataFrame(chain + [("cycle", 3, 2), ("loop", 3, 2), ("empty", 1, 2)], "dag_id string, source int, target int")
    want = {"ok": None, "last": "last_type", "type": "node_error", "cycle": "cyclic", "loop": "no_last", "first": "origin_type", "alone": "no_origin", "empty": "empty", "many": "too_many_nodes"}
    assert {r[0]: r[1] for r in L.validate_workflow(nodes, edges).collect()} == want


def test_cycles_of_graphs_of_any_size(spark):
    chain = [(d, i, i + 1) for d in "ab" for i in range(3_000)]
    edges = spark.createDataFrame(chain + [("b", 2_999, 1_500), ("c", 1, 2)], "dag_id string, source int, target int")
    assert {r[0]: r[1] for r in L.cycles(edges).collect()} == {"a": False, "b": True, "c": False}


def test_fold_order_and_repeats(spark):
    log = spark.createDataFrame([(1, 3, "run_success"), (1, 1, "dispatch_success"), (1, 2, "start"), (1, 2, "start"), (1, 4, "run_fail"), (2, 1, "run_success"), (3, 1, None)], "job_id long, at int, event string")
    got = {r["job_id"]: (r["status"], r["applied"], r["events"]) for r in I.fold_events(log, "job_id", ["at"], "event", I.JOB_EVENTS, "inited").collect()}
    assert got == {1: ("succeed", 3, 5), 2: ("inited", 0, 1), 3: ("inited", 0, 1)}


def test_fold_of_a_key_with_most_events(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cycle = {"go": (("a", "c"), "b"), "on": (("b",), "c"), "back": (("c",), "a")}
        name = F.element_at(F.array(*map(F.lit, ("go", "on", "back", "none"))), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
        log = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(7).alias("k"), F.col("id").alias("at"), name.alias("event"))
        want = {}
        for r in sorted(log.collect(), key=lambda r: r["at"]):
            s, n, m = want.get(r["k"], ("a", 0, 0))
            allowed, to = cycle.get(r["event"], ((), None))
            want[r["k"]] = (to, n + 1, m + 1) if s in allowed else (s, n, m + 1)
        assert {r["k"]: (r["status"], r["applied"], r["events"]) for r in I.fold_events(log, "k", ["at"], "event", cycle, "a").collect()} == want
        assert I.fold_chunks(log, "k", ["at"], "event", cycle, "a").agg(F.max("n")).first()[0] < 5_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_smooth_cycle_of_many_servers():
    def plain(weights):
        current, out = [0] * len(weights), []
        for _ in range(sum(weights)):
            current = [c + w for c, w in zip(current, weights)]
            best = max(range(len(weights)), key=lambda i: (current[i], -i))
            current[best] -= sum(weights)
            out.append(best)
        return out

    for weights in ([1], [3, 1, 3, 2, 2, 3], [16, 1, 7, 7, 16, 5, 1]):
        assert K.smooth_cycle(weights) == plain(weights)
    assert K.smooth_cycle([4, 2, 2]) * 2 == plain([4, 2, 2])  # repeats after half the sum
    assert len(K.smooth_cycle([i % 16 + 1 for i in range(20_000)])) == 170_000  # 3.4e9 steps times servers before


def test_round_robin_spreads_a_group(spark):
    servers = spark.createDataFrame([(1, i) for i in (5, 3, 9, 3)] + [(2, 8), (2, None)], "app int, server int")
    requests = spark.createDataFrame([(1, n) for n in range(7)] + [(2, 4), (3, 1)], "app int, number long")
    got = K.round_robin(requests, servers, "app", "server", "number")
    assert sorted((r["app"], r["number"], r["server"]) for r in got.collect()) == [(1, n, (3, 5, 9)[n % 3]) for n in range(7)] + [(2, 4, 8)]
    assert "collect_set" not in got._jdf.queryExecution().toString()


def test_next_times(spark):
    now = datetime(2024, 1, 1, 12)
    s = "schedule_id int, start_time timestamp_ntz, schedule_delay long, schedule_interval long, last_trigger_at timestamp_ntz, last_feedback_at timestamp_ntz, next_trigger_at timestamp_ntz"
    rows = [(1, datetime(2024, 1, 1, 13), 60, 10, None, None, None), (2, now, 0, 3600, now, None, now), (3, now, 0, None, None, None, datetime(2024, 1, 1)), (4, now, 0, 60, now, datetime(2024, 1, 1, 11), None)]
    df, at = spark.createDataFrame(rows, s), F.lit(now).cast("timestamp_ntz")
    got = {r[0]: (r[1], r[2]) for r in df.select("schedule_id", J.next_fixed_rate(at), J.next_fixed_delay(at)).collect()}
    assert got[1] == (datetime(2024, 1, 1, 13, 1), datetime(2024, 1, 1, 13, 1)) and got[2] == (datetime(2024, 1, 1, 13), None)
    assert got[3] == (now, now) and got[4] == (datetime(2024, 1, 1, 12, 1), now)


def test_planning_by_type(spark):
    """A firing of each type; missed ones collapse; one out of its validity, a disabled one, a bad cron and an unknown type have none."""
    now, at = "2024-01-01 12:00:00", lambda h, m=0, s=0: datetime(2024, 1, 1, h, m, s)
    schema = "schedule_id long, schedule_type string, start_time timestamp_ntz, end_time timestamp_ntz, schedule_delay long, schedule_interval long, schedule_cron string, last_trigger_at timestamp_ntz, last_feedback_at timestamp_ntz, next_trigger_at timestamp_ntz, is_enabled boolean"
    day, far = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [
        (1, "fixed_rate", day, far, 0, 240, None, at(11), None, at(11, 4), True), (2, "fixed_delay", day, far, 0, 60, None, at(11), at(11, 30), at(12, 2), True),
        (3, "cron", day, far, 0, None, "0 0/4 * * * ?", at(11, 59), None, at(12, 1), True), (4, "fixed_rate", day, at(12, 3), 0, 120, None, None, None, at(12), True),
        (5, "fixed_rate", at(13), far, 0, 60, None, None, None, at(12), True), (6, "fixed_rate", day, far, 0, 60, None, None, None, at(12), False),
        (7, "cron", day, far, 0, None, "bad", None, None, None, True), (8, "other", day, far, 0, 1, None, None, None, None, True), (9, "fixed_delay", day, far, 0, 60, None, at(11), None, at(11, 1), True),
    ]
    s = spark.createDataFrame(rows, schema)
    planned = J.plan_firings(s, now)
    got = {r[0]: ([f.minute for f in r["firings"]], r["last_trigger_at"], r["next_trigger_at"]) for r in planned.collect()}
    assert got == {
        1: ([0, 4, 8], at(12, 8), at(12, 12)), 2: ([2], at(12, 2), None), 3: ([1, 4, 8], at(12, 8), at(12, 12)), 4: ([0, 2], at(12, 2), at(12, 4)), 5: ([], None, at(12)),
        7: ([], None, None), 8: ([], None, None), 9: ([0], at(12), None),
    }
    after = {r["schedule_id"]: (r["last_trigger_at"], r["next_trigger_at"]) for r in J.carried(s, planned).collect()}
    assert after[3] == (at(12, 8), at(12, 12)) and after[6] == (None, at(12)) and len(after) == 9
    fed = J.feedback(s, spark.createDataFrame([(2, at(12, 5)), (2, at(12, 3))], "schedule_id long, end_at timestamp_ntz"))
    assert {r["schedule_id"]: r["last_feedback_at"] for r in fed.collect()}[2] == at(12, 5)
    again = {r["schedule_id"]: r["next_at"] for r in J.next_trigger(fed.filter("schedule_id = 2"), "2024-01-01 12:05:30").collect()}
    assert again == {2: at(12, 6)}
    old = s.withColumn("fingerprint", F.lit("a"))
    firings = spark.createDataFrame([("x", 1, at(12), "init"), ("y", 1, at(12), "running"), ("z", 3, at(12), "init")], "delay_id string, schedule_id long, trigger_at timestamp_ntz, status string")
    schedules, left = J.save(old, old.withColumn("fingerprint", F.when(F.col("schedule_id") == 1, "b").otherwise("a")), firings, now)
    assert sorted((r["schedule_id"], r["trigger_at"].minute, r["status"]) for r in left.collect()) == [(1, 0, "init"), (1, 0, "running"), (1, 4, "init"), (1, 8, "init"), (3, 0, "init")] and schedules.count() == 9


def test_streams_over_several_batches(spark, tmp_path):
    """One file a batch: windows, last heartbeats and states have one row a key, the last one."""
    from tideloom.streaming import liveness as N

    log = [(1, i, ("dispatch_success", "start", "run_success")[i], datetime(2024, 1, 1, 0, 0, 4 * i)) for i in range(3)]
    for i, row in enumerate(log):
        spark.createDataFrame([row, (2, 10 + i, "report", row[3])], "job_id long, event_id long, event string, at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    like = spark.read.parquet(f"{tmp_path}/in/*")

    def stream():
        return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    states = N.drain(N.report_states(stream()), f"{tmp_path}/states", "update", ["job_id"])
    assert sorted(tuple(r) for r in states.collect()) == [(1, "succeed", 3), (2, "inited", 0)]
    beats = lambda: stream().select(F.col("job_id").alias("node_id"), "at")
    windows = N.drain(N.online_windows(beats()), f"{tmp_path}/windows", "update", ["node_id", "start"])
    assert sorted((r["node_id"], r["start"].second, r["beats"]) for r in windows.collect()) == [(1, 0, 3), (2, 0, 3)]
    seen = N.drain(N.last_seen(beats()), f"{tmp_path}/seen", "update", ["node_id"])
    assert sorted((r["node_id"], r["last_at"].second, r["beats"]) for r in seen.collect()) == [(1, 8, 3), (2, 8, 3)]


def test_spells_over_several_batches(spark, tmp_path):
    """One file a batch: gaps of up to the timeout join heartbeats, longer ones end a spell, the last spell may go on."""
    from tideloom.streaming import liveness as N

    at = lambda s: datetime(2024, 1, 1, s // 3600, s // 60 % 60, s % 60)
    for i, beats in enumerate(([(1, 0), (1, 10), (2, 3)], [(1, 21), (2, 14), (None, 5)], [(1, 40), (3, None)], [(2, 400)])):
        spark.createDataFrame([(n, s if s is None else at(s)) for n, s in beats], "node_id long, at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    like = spark.read.parquet(f"{tmp_path}/in/*")
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = N.drain(N.online_spells(stream, late="1 minute"), f"{tmp_path}/spells").collect()
    assert {r["offline_at"] - r["last_at"] for r in got} == {timedelta(seconds=10)}
    expected = [(1, at(0), at(10), 2), (1, at(21), at(21), 1), (1, at(40), at(40), 1), (2, at(3), at(3), 1), (2, at(14), at(14), 1), (None, at(5), at(5), 1)]
    assert sorted(((x["node_id"], x["online_at"], x["last_at"], x["beats"]) for x in got), key=repr) == sorted(expected, key=repr)


def test_liveness_of_workers(spark):
    w = spark.createDataFrame([(1, "online"), (2, "offline"), (3, "offline"), (4, None), (None, "online")], "worker_id long, status string")
    m = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (4, datetime(2024, 1, 1)), (None, None)], "worker_id long, last_heartbeat_at timestamp_ntz")
    got = I.mark_liveness(w, m, "2024-01-02 00:00:06").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, "offline", True), (2, "online", True), (3, "offline", False), (4, "offline", True), (None, "online", False)], key=repr)


def test_executions_and_retries(spark):
    e = spark.createDataFrame([(1, "inited", None, None), (2, "running", None, None), (3, "running", None, None), (4, "failed", None, None)], "id int, status string, start_at timestamp_ntz, end_at timestamp_ntz")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert [(r["status"], r["start_at"] is not None) for r in I.start_executions(e, at).orderBy("id").collect()] == [("running", True), ("running", False), ("running", False), ("failed", False)]
    ok = F.when(F.col("id") == 2, F.lit(True)).when(F.col("id").isin(1, 4), F.lit(False))
    assert [(r["status"], r["end_at"] is not None) for r in I.finish_executions(e, ok, at).orderBy("id").collect()] == [("inited", False), ("succeed", True), ("running", False), ("failed", False)]
    jobs = spark.createDataFrame([("failed", 0), ("failed", 3), ("failed", None), ("succeed", 0)], "status string, retry_times int")
    assert [tuple(r) for r in I.after_failure(jobs, F.lit(1)).collect()] == [("inited", 1, True), ("failed", 3, False), ("failed", None, False), ("succeed", 0, False)]
    tasks = spark.createDataFrame([(1, "w")], "task int, worker string")
    assert I.own_reports(spark.createDataFrame([(1, "w", "start"), (1, "v", "start"), (2, "w", "start")], "task int, worker string, event string"), tasks, ["task"], "worker").count() == 1


def test_versions_are_numbers(spark):
    v = spark.createDataFrame([("r", "t", "9"), ("r", "t", "10"), ("r", "t", None)], "ref_id string, ref_type string, version string")
    assert tuple(D.latest_version(v).first())[2:] == (10, 11)


def test_creation_and_replacement(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, C.get_or_create(old, new, ["k"]).collect())) == [(1, "a"), (2, "y")]
    assert sorted(map(tuple, C.replace_by_key(old, new.filter("k = 1"), ["k"]).collect())) == [(1, "x")]
    assert C.missing_buckets(old.selectExpr("k AS bucket")).count() == 63


def test_replan_judges_each_row(spark):
    schedules = "schedule_id long, fingerprint string"
    old, new = spark.createDataFrame([(1, "a"), (2, "a")], schedules), spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], schedules)
    rows = [("x", 1, "init"), ("x", 1, "failed"), ("x", 2, "init"), ("y", 3, "init"), ("z", 1, None), (None, None, "init"), (None, 1, "init")]
    left = J.replan(old, new, spark.createDataFrame(rows, "delay_id string, schedule_id long, status string"))
    assert left.columns == ["delay_id", "schedule_id", "status"]
    assert {tuple(r) for r in left.collect()} == {("x", 1, "failed"), ("x", 2, "init"), ("z", 1, None), (None, None, "init")}


def test_user_code_failures(spark):
    jobs = spark.createDataFrame([(1, "a b"), (2, "a !")], "job_id long, input string")

    def run(x):
        if x == "!":
            raise ValueError(x)
        return x.upper()

    e = M.Executor("up", run, lambda x: x.split(), lambda r: "".join(sorted(r.values())))
    assert sorted(map(tuple, M.map_reduce(jobs, e).collect())) == [(1, "succeed", "AB"), (2, "failed", None)]
    r = M.Registry()
    r.add(e)
    with pytest.raises(ValueError):
        r.add(e)


def test_tables(spark):
    a = files.create_or_replace(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), "t_rows")
    assert files.exists(spark, "t_rows") and not files.exists(spark, "t_none") and a.count() == 2
    files.append(spark.createDataFrame([(3, 1)], "k int, v int"), "t_rows")
    got = files.upsert(spark.createDataFrame([(1, 5), (2, 0)], "k int, v int"), "t_rows", ["k"], "v")
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 1), (3, 1)]
    got = files.replace(spark.createDataFrame([(1, 7)], "k int, v int"), "t_rows", ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 1), (3, 1)]
    ids = [r["id"] for r in files.next_ids(spark, 10000, spark.range(250).repartition(3).drop("id").withColumn("x", F.lit(1))).collect()]
    assert len(set(ids)) == 250 and min(ids) > 10000


def test_entry_without_training_data(spark, tmp_path):
    import shutil
    import subprocess
    import sys

    from support import REPO

    shutil.copytree(REPO / "tideloom", tmp_path / "tideloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'dispatch_plan' in e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_broadcast_job_runs_once(spark):
    """Each worker of a job has the result of its one run; jobs of apps without workers have no task."""
    import uuid

    jobs = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "c", 8), (4, None, 9)], "job_id long, input string, app_id int")
    workers = spark.createDataFrame([(7, w) for w in range(50)] + [(9, 60)], "app_id int, worker_id long")
    got = M.broadcast_run(jobs, workers, M.Executor("any", lambda x: x.upper() + uuid.uuid4().hex)).collect()
    assert len({r["task_id"] for r in got if r["job_id"] == 1}) == 50 and len(got) == 101
    assert len({r["result"] for r in got if r["job_id"] == 1}) == 1 and [r["status"] for r in got if r["job_id"] == 4] == ["failed"]


def test_broadcast_results_take_little_room(spark, tmp_path):
    """Rows come in an order that files store in little room, and a list's rows are made apart from the join."""
    jobs = spark.range(2_000).selectExpr("id AS job_id", "CAST(id % 8 AS INT) AS app_id", "repeat('x', CAST(id * 7919 % 40 AS INT)) AS input")
    workers = spark.range(4_000).selectExpr("id * 7919 AS worker_id", "CAST(id % 8 AS INT) AS app_id")
    df = M.broadcast_run(jobs, workers, M.Executor("size", lambda x: str(len(x)))).select("job_id", "task_id", "result")
    df.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    want = jobs.join(workers, "app_id").selectExpr("job_id", "concat('SUB_', worker_id) AS task_id", "CAST(length(input) AS STRING) AS result")
    assert out.count() == 1_000_000 and out.exceptAll(want).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 400_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Coalesce") < plan.index("Join")


@pytest.mark.parametrize("fleet", [M.FLEET, 0])
def test_broadcast_to_odd_fleets(spark, monkeypatch, fleet):
    """Lists filled up and over, repeated jobs and workers, apps of one side alone or null, apps as text, failures, no rows."""
    monkeypatch.setattr(M, "FLEET", fleet)
    n, k = M.JOBS, M.WORKERS
    sizes = {"one": (1, 1), "full": (n, k), "over": (n + 1, 2 * k + 1), "idle": (0, 3), "": (3, 2), None: (5, 5), "none": (4, 0)}
    jobs = [(i, a, None if i % 5 == 0 else "y" * (i % 9)) for a, (j, _) in sizes.items() for i in range(j)] + [(0, "one", "again")]
    workers = [(a, w) for a, (_, c) in sizes.items() for w in range(c)] + [("one", 0)]
    got = M.broadcast_run(spark.createDataFrame(jobs, "job_id long, app_id string, input string"), spark.createDataFrame(workers, "app_id string, worker_id int"), M.Executor("size", lambda x: str(len(x))))
    key = lambda r: tuple(map(str, r))
    want = [(i, f"SUB_{w}", None if x is None else str(len(x)), "failed" if x is None else "succeed") for i, a, x in jobs for b, w in workers if a == b and a is not None]
    assert sorted(map(key, got.drop("error_msg").collect())) == sorted(map(key, want))
    assert M.broadcast_run(spark.createDataFrame([], "job_id long, app_id string, input string"), spark.createDataFrame(workers, "app_id string, worker_id int"), M.Executor("size", str)).count() == 0


@pytest.mark.parametrize("name", ["workflow_validate", "dag_validate"])
def test_validation_shuffles_graphs_once(spark, name):
    """Static plan: each use of the jobs deals them out by execution, and nodes and edges meet without another shuffle."""
    from support import SMALL

    from tideloom.plans.catalog import QUERIES

    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 10


def test_validation_of_odd_graphs(spark):
    """Ids that don't rise along edges, edges to nodes that are missing, repeated edges and nodes, a loop on a node, 100 nodes."""
    kinds = {"down": {3: "start", 2: "executor", 1: "end"}, "apart": {1: "start", 2: "end"}, "self": {1: "start", 2: "executor", 3: "end"}, "full": {i: "start" if i == 1 else "end" if i == 100 else "executor" for i in range(1, 101)}}
    nodes = spark.createDataFrame([(d, i, k) for d, own in kinds.items() for i, k in own.items()] + [("twice", 1, "start"), ("twice", 1, "start")], "dag_id string, node_id int, node_type string")
    edges = [("down", 3, 2), ("down", 2, 1), ("apart", 1, 2), ("self", 1, 2), ("self", 2, 2), ("self", 2, 3), ("twice", 1, 2), ("none", 1, None)] + [("full", i, i + 1) for i in range(1, 100)]
    edges = spark.createDataFrame(edges * 2 + [("apart", 1, i) for i in range(1_000, 3_000)], "dag_id string, source int, target int")
    got = {r[0]: r[1] for r in L.validate_workflow(nodes, edges).collect()}
    assert got == {"down": None, "apart": None, "self": "cyclic", "full": None, "twice": "no_origin", "none": "empty"}
    assert {r[0]: r[1] for r in L.validate(nodes, edges).collect()} == {k: v for k, v in got.items() if k != "none"}


def test_composed_maps():
    """Runs of one to 1,000 keys' maps against applying them one by one."""
    import numpy as np

    from tideloom.streaming.liveness import _composed

    rng = np.random.default_rng(4)
    keys = np.repeat(np.arange(6), [1, 2, 3, 7, 64, 1_000])
    to, n = rng.integers(0, 5, (len(keys), 5)), rng.integers(0, 2, (len(keys), 5))
    want = []
    for k in range(6):
        for s in range(5):
            at, count = s, 0
            for a, b in zip(to[keys == k], n[keys == k]):
                at, count = a[at], count + b[at]
            want.append((k, s, at, count))
    got_to, got_n = _composed(keys, to.copy(), n.copy())
    assert [(k, s, got_to[k, s], got_n[k, s]) for k in range(6) for s in range(5)] == want
