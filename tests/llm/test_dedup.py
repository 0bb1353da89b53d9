"""Exact, line and near dedup against plain Python, with nulls, ties, empty and very long texts and extra columns."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from support import SMALL, same
from xxhash import xxh64_intdigest

from tideloom.llm import exact_dedup, line_dedup, simhash
from tideloom.llm.components import connected_components

DOCS = "doc_id long, text string, digest string, n_lines int, fp long, row string"  # with columns whose names clash
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS)


ODD = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (None, "a b"), (7, None), (8, ""), (4, LONG), (6, LONG + "\n"), (6, LONG + "\n"), (None, "only null"), (2, " a b")]


@pytest.mark.parametrize("batches", [1, 3, 20])
def test_exact_odd_rows(spark, batches):
    got = exact_dedup.dedup_all(docs(spark, ODD), batches).collect()
    by = defaultdict(list)
    for i, t in ODD:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(ODD)
    for text, ids in by.items():
        mine = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and all(r["keep_id"] == keep and r["group_size"] == len(ids) for r in mine)
        assert sum(r["kept"] for r in mine) == 1 and all(r["doc_id"] == keep for r in mine if r["kept"])


def test_exact_over_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    first = index.new_only(docs(spark, [(1, "x"), (2, "x "), (3, "y"), (4, "y")]))
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 2, 3] and "n_lines" in first.columns
    got = {r["doc_id"]: (r["kept"], r["keep_id"], r["group_size"]) for r in index.dedup(docs(spark, [(0, "y"), (10, "z"), (11, "z")])).collect()}
    assert got == {0: (False, 3, 3), 10: (True, 10, 2), 11: (False, 10, 2)}
    again = exact_dedup.DigestIndex(spark, index.name)
    assert [r["kept"] for r in again.dedup(docs(spark, [(20, "z")])).collect()] == [False]
    assert index.dedup(docs(spark, [])).count() == 0 and index.rows().count() == 4
    index.drop()
    assert index.rows() is None


def test_exact_batch_that_is_lost_or_repeated(spark, monkeypatch):
    """A call that fails before its result is written leaves nothing behind; a batch id gives its first answer again."""
    index, rows = exact_dedup.DigestIndex(spark), docs(spark, [(1, "x"), (2, "x"), (3, "y")])
    answer = lambda batch: sorted((r["doc_id"], r["kept"], r["keep_id"], r["group_size"]) for r in index.dedup(rows, batch).collect())
    want, real = [(1, True, 1, 2), (2, False, 1, 2), (3, True, 3, 1)], exact_dedup.resolved

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup, "resolved", fail)
    with pytest.raises(RuntimeError):
        index.dedup(rows, "a")
    assert index.rows() is None
    monkeypatch.setattr(exact_dedup, "resolved", real)
    assert answer("a") == want and answer("a") == want
    assert [r["kept"] for r in index.dedup(docs(spark, [(9, "x"), (8, "w")]), "b").orderBy("doc_id").collect()] == [True, False]
    assert answer("a") == want and index.rows().count() == 3
    index.drop()


def test_exact_joins_leave_the_index_where_it_is(spark):
    index = exact_dedup.DigestIndex(spark)
    index.dedup(docs(spark, [(1, "x")]), "a")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = exact_dedup.digest_keys(docs(spark, [(2, "y")])).select("digest").join(index.rows().select("digest"), "digest", "left_anti")
        plan = new._jdf.queryExecution().sparkPlan().toString() + new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "SortMergeJoin" in plan and plan.split("SortMergeJoin")[-1].count("Exchange") == 1 and "Bucketed: true" in plan
    index.drop()


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.DigestIndex(spark).dedup(none).count() == 0 and exact_dedup.dedup_all(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def plain_lines(rows, least=20, n=3):
    keys, held = [], defaultdict(set)
    for i, t in rows:
        lines = (t or "").split("\n")
        own = []
        for line in lines:
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            own.append(k if len(k) >= least else None)
            if own[-1] is not None:
                held[k].add(-1 if i is None else i)
        keys.append((i, lines, own))
    out = []
    for i, lines, own in keys:
        stay = [x for x, k in zip(lines, own) if k is None or len(held[k]) < n or max(held[k]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_odd_rows(spark):
    same_ = "This Line is in many documents"
    rows = [(i, f"own {i}\n  {same_.upper() if i % 2 else same_}\t\nÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄ\n{same_}") for i in range(5)]
    rows += [(None, same_), (3, same_), (7, None), (8, ""), (9, "short\nshort\nshort"), (10, same_ + "\n" + same_), (11, "\n".join(f"line number {i:06d} of a long text" for i in range(20_000))), (12, "ääääääääääääääääääää"), (13, "É" * 20 + "\r")]
    rows += [(20 + i, "é" * 19) for i in range(4)]
    got = line_dedup.drop_repeated_lines(docs(spark, rows))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=repr) == plain_lines(rows)


def test_lines_of_rows_without_an_id_and_repeated_rows(spark):
    """A third of all rows have no id, a third are one row."""
    line = "a line that is long enough for a key"
    rows = [(None, f"{line}\nown line of row number {i:06d}\n{line}") for i in range(40)] + [(5, f"{line}\nx")] * 40 + [(i, line + f"\n{i}") for i in range(20, 60)]
    got = line_dedup.drop_repeated_lines(docs(spark, rows))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=repr) == plain_lines(rows)


def test_runs_are_compacted_and_only_repeats_are_looked_at(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fan_in=2)
    batch = lambda *x: spark.createDataFrame([(d, h, 0) for d, h in x], "did long, h1 long, h2 long")
    held = lambda: [sorted(r["h1"] for r in x.collect()) for x in runs.runs()]
    runs.add(batch((1, 1), (2, 1), (2, 2)))
    assert held() == [[1, 2]] and not runs.deltas
    runs.add(batch((3, 1), (3, 3)))
    assert [len(x) for x in runs.levels] == [0, 1] and held() == [[1, 2, 3]]
    runs.add(batch((4, 3), (5, 4), (6, 4)))
    assert [len(x) for x in runs.levels] == [1, 1] and held() == [[4], [1, 2, 3]]
    assert [sorted((r["h1"], r["n_docs"], r["run_docs"]) for r in d.collect()) for d in runs.deltas] == [[(1, 1, 2)], [(3, 1, 1)]]
    assert {r["h1"]: (r["n_docs"], r["last"]) for r in runs.repeated(2).collect()} == {1: (3, 3), 3: (2, 4), 4: (2, 6)}
    assert {r["h1"] for r in runs.repeated(3).collect()} == {1}
    runs.drop()
    assert runs.runs() == []


@pytest.mark.parametrize("name", ["op1_line_dedup", "op8_warc", "op10_exact_dedup"])
def test_queries_match_sql(spark, duck, name):
    from tideloom.llm.queries import ORACLE_SQL, QUERIES

    assert same(QUERIES[name](spark, SMALL), duck.execute(ORACLE_SQL[name])) > 0


def plain_prints(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return np.array(out, np.uint64)


def plain_components(keys, fp, most=3):
    label = list(range(len(fp)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= most) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    least = {}
    for i, k in enumerate(keys):
        r = root(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [least[root(i)] for i in range(len(fp))]


def check_simhash(got, rows):
    fp = plain_prints(rows)
    want = sorted(zip([i for i, _ in rows], [f"{x:016x}" for x in fp], plain_components([i for i, _ in rows], fp)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=repr) == want


def test_simhash_odd_rows(spark):
    rows = ODD + [(i, " ".join(["The Same words in all of these documents but the last one"] * 9) + f" x{i}") for i in range(20, 40)] + [(50, "one"), (51, "one two"), (52, "ONE  two"), (53, "one two three"), (54, "Äb c d e")]
    check_simhash(simhash.near_duplicates(docs(spark, rows)), rows)


def test_simhash_whole_table(spark):
    from tideloom.llm.queries import QUERIES

    t = pd.read_parquet(f"{SMALL}/documents.parquet")
    check_simhash(QUERIES["op4_simhash"](spark, SMALL), list(zip(t["doc_id"].tolist(), t["text"].tolist())))


def test_very_long_text_in_parts():
    a = simhash.fingerprints_of([LONG], 3, chunk=1000)
    assert a[0] == simhash.fingerprints_of([LONG], 3)[0] == plain_prints([(0, LONG)])[0]


@pytest.mark.parametrize("thresholds", [(3, -1), (1, 1), (2, 0)])
def test_any_allocation_finds_all_links(spark, thresholds, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # small blocks: hot keys are cut
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20, k), dtype=np.uint64), axis=1) for c in centre for k in (1, 2, 3)]))
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    bits = list(range(64))
    plan = simhash.Plan((tuple(bits[::2]), tuple(bits[1::2])), thresholds, 3)
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes, plan)).collect()}
    signed = fp.view(np.int64)
    order = np.argsort(signed)
    want = plain_components(signed[order].tolist(), fp[order])
    assert [roots.get(int(x), int(x)) for x in signed[order]] == want


@pytest.mark.parametrize("n", [400, 3200])
def test_units_of_a_large_key_do_not_grow(spark, monkeypatch, n):
    """All fingerprints share a key: no unit has more than a few blocks' rows, and all are linked."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    fp = np.arange(n, dtype=np.int64)
    bits = list(range(64))
    plan = simhash.Plan((tuple(bits[32:]), tuple(bits[:32])), (0, 2), 3)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fp}))
    real = simhash.forest

    def seen(group, *rest):
        assert np.bincount(group).max(initial=0) < 64 * 4
        return real(group, *rest)

    monkeypatch.setattr(simhash, "_links", lambda distance, f=simhash._links, g=seen: _with(f, g, distance))
    roots = {r["root"] for r in connected_components(simhash.links(nodes, plan)).collect()}
    assert roots == {0}


def _with(links, forest, distance):
    def rows(batches):
        old, simhash.forest = simhash.forest, forest
        try:
            yield from links(distance)(batches)
        finally:
            simhash.forest = old

    return rows


def test_plan_is_sound(spark):
    fp = np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.int64)
    plan = simhash.make_plan(spark.createDataFrame(pd.DataFrame({"fp": fp})), 3)
    assert sorted(b for p in plan.partitions for b in p) == list(range(64))
    assert sum(t + 1 for t in plan.thresholds) == 4
    cost, chosen = simhash.allocate([[0, 5, 9, 30, 90], [0, 1, 2, 3, 4]], 3)
    assert (cost, chosen) == (4, (-1, 3))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
