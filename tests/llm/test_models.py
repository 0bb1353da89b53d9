"""Language ID, quality, nearest neighbours, WARC and the pipeline: brute force, held-out accuracy, odd rows, damage."""

import hashlib
import math
import struct
import zlib
from collections import Counter
from itertools import product
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F
from support import SMALL

from tideloom.llm import ann, langid, quality, warc
from tideloom.llm.pieces import vocabulary
from tideloom.llm.queries import QUERIES
from tideloom.llm.tokens import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")
BIGGER = SMALL.replace("sf0.001", "sf0.01")


def sums_by_force(vocab, word, probs):
    """Summed probability, and expected count of each piece, over all segmentations of the marked word's bytes."""
    raw, index = ("▁" + word).encode(), {p.encode(): i for i, p in enumerate(vocab.pieces) if p.encode() in BY_BYTES}
    total, counts = 0.0, {}
    for cuts in product((0, 1), repeat=len(raw) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(raw)]
        choices = []
        for a, b in zip(at, at[1:]):
            own = [index[raw[a:b]]] if raw[a:b] in index else []
            choices.append(own + ([int(vocab.byte_ids[raw[a]])] if b == a + 1 else []))
        for ids in product(*choices):
            p = math.prod(probs[i] for i in ids)
            total += p
            for i in ids:
                counts[i] = counts.get(i, 0) + p
    return total, {i: c / total for i, c in counts.items()}


VOCAB = vocabulary(PIECES)
BY_BYTES = {VOCAB.pieces[i].encode() for i in VOCAB.trie.value[VOCAB.trie.value >= 0]}


def test_forward_sums_all_segmentations():
    probs = np.random.default_rng(0).dirichlet(np.ones(len(VOCAB.pieces)), 2)
    words = ["the", "ñu", "a", "zeit", "haus"]
    got = langid.log_likelihood(VOCAB, words, probs)
    for w, row in zip(words, got):
        lift = len(("▁" + w).encode()) * math.log(langid.LIFT)
        for p, x in zip(probs, row):
            assert abs(x - lift - math.log(sums_by_force(VOCAB, w, p)[0])) < 1e-6
    counts = langid.expected_counts(VOCAB, words, np.ones(len(words)), probs[0])
    want = np.zeros(len(VOCAB.pieces))
    for w in words:
        for i, c in sums_by_force(VOCAB, w, probs[0])[1].items():
            want[i] += c
    assert np.abs(counts - want).max() < 1e-9


def test_long_words_are_scored_whole(monkeypatch):
    """A word of any length: the sum over segmentations that cross any place, against a plain log-space forward pass."""
    probs = np.random.default_rng(0).dirichlet(np.ones(len(VOCAB.pieces)) * 0.05, 3) + 1e-12
    index = {p.encode(): i for i, p in enumerate(VOCAB.pieces) if p.encode() in BY_BYTES}
    longest = max(map(len, index))

    def plain(word, p):
        raw, out = ("▁" + word).encode(), [0.0]
        for e in range(1, len(raw) + 1):
            at = [out[s] + math.log(p[index[raw[s:e]]]) for s in range(max(0, e - longest), e) if raw[s:e] in index]
            out.append(np.logaddexp.reduce([*at, out[e - 1] + math.log(p[int(VOCAB.byte_ids[raw[e - 1]])])]))
        return out[-1] + len(raw) * math.log(langid.LIFT)

    words = ["donaudampfschifffahrtsgesellschaft" * 3, "a" * 23, "b" * 24, "ñandú" * 400, "the", "x" * 5000]
    monkeypatch.setattr(langid, "CELLS", 3000)
    got = langid.log_likelihood(VOCAB, words, probs)
    assert np.isfinite(got).all() and np.allclose(got, [[plain(w, p) for p in probs] for w in words], rtol=1e-9)
    counts = langid.expected_counts(VOCAB, words, np.full(len(words), 2.0), probs[0])
    sizes = np.array([len(VOCAB.pieces[i].encode()) if i not in VOCAB.byte_ids else 1 for i in range(len(VOCAB.pieces))])
    assert abs(counts @ sizes - 2 * sum(len(("▁" + w).encode()) for w in words)) < 1e-4
    scorer = langid.Scorer(PIECES, probs)
    assert np.allclose(scorer.scores([" ".join(words)])[0], got.sum(0))
    assert not any(len(w) > langid.SHORT for w in scorer.place)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(i, "a", c) for i, c in enumerate("xyz")], "doc_id long, text string, lang string"))


def test_language_held_out(spark):
    got = QUERIES["op5_language_id"](spark, BIGGER).toPandas().merge(pd.read_parquet(f"{BIGGER}/documents.parquet"), on="doc_id")
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(got) == 1000 and len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.97


DOCS = "doc_id long, text string, lang string, score double, shard int"


def test_language_odd_rows(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and that with", "en"), (3, None, "en"), (None, "the and", None), (4, "", None), (5, "12 34 !!", None), (6, "the " * 50_000, None), (6, "UND DIE nicht " + "x" * 500, None)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], DOCS)
    langs, probs = langid.train(df)
    assert langs == ["de", "en"] and langid.words_of("x² ½ Ⅷ_ñ9a") == ["x", "ñ", "a"]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in langid.predict(df, langs, probs).collect())
    assert [x[1] for x in got if x[0] in "345"] == ["und"] * 3 and all(0 <= x[2] <= 1 for x in got) and len(got) == len(rows)
    assert dict((x[0], x[1]) for x in got if x[0] in "12") == {"1": "de", "2": "en"} and ("None", "en") in [x[:2] for x in got]
    none = df.filter("false")
    assert langid.train(none)[0] == [] and langid.predict(df, [], np.zeros((0, 0))).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, langs, probs).count() == 0


def test_quality_held_out(spark):
    got = QUERIES["op2_quality"](spark, BIGGER).toPandas().merge(pd.read_parquet(f"{BIGGER}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 50 and got["score"].between(0, 1).all()
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.97 and (bad["predicted"] == 0).mean() > 0.7


def test_ngrams_by_hand():
    text = "Go go, GO go go !! !! I 12 x_y aB"
    words = ["Go", "go", ",", "GO", "go", "go", "!!", "!!", "I", "12", "x", "_", "y", "aB"]
    shapes = [5, 4, 8, 2, 4, 1, 11, 1, 3, 7, 4, 8, 4, 6]
    p, h = [int(x) for x in quality.PRIMES], [zlib.crc32(w.encode()) for w in words]
    kinds = [[x * p[2] for x in h] + [a * p[0] + b * p[1] for a, b in zip(h, h[1:])]]
    three = [1 << 16 | a << 8 | b << 4 | c for a, b, c in zip(shapes, shapes[1:], shapes[2:])]
    kinds.append([x * p[3] for x in [a << 4 | b for a, b in zip(shapes, shapes[1:])] + three])
    want = {}
    for grams in kinds:
        n = Counter((g & (2**64 - 1)) >> 20 & 0xFFF for g in grams)
        length = math.sqrt(sum(math.log1p(c) ** 2 for c in n.values()))
        for g, c in n.items():
            want[g] = want.get(g, 0) + math.log1p(c) / length
    at, x = quality.Hasher(12).features(text)
    assert at.tolist() == sorted(want) and np.abs(x - [want[g] for g in sorted(want)]).max() < 1e-12


def test_shards_without_rows_have_no_say(spark):
    df = spark.createDataFrame([(7, "good words")], "doc_id long, text string")
    w = quality.train(df, spark.createDataFrame([(7, 1)], "doc_id long, label int"))
    assert np.abs(w - quality.fit(["good words"], [1], quality.Settings())).max() < 1e-12 and w.any()


def test_ftrl_by_hand():
    s = quality.Settings(bits=8, epochs=1, l1=0.01, l2=0.1, alpha=0.5)
    texts, labels = ["a b", "!! c", "a"], [1, 0, 1]
    z, n, h = {}, {}, quality.Hasher(8)

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= s.l1 else -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(ni)) / s.alpha + s.l2)

    for k in np.random.default_rng(0).permutation(3):
        at, x = h.features(texts[k])
        at, x = [*at.tolist(), 256], [*x.tolist(), 1.0]
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, v, wi in zip(at, x, w):
            g = (p - labels[k]) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * wi, n.get(i, 0.0) + g * g
    want = np.array([weight(i) for i in range(257)])
    assert np.abs(quality.fit(texts, labels, s) - want).max() < 1e-9


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, "good text here", "x", 0.0, 1), (2, "BAD!! BAD!!", "x", 0.0, 1), (2, "BAD!! BAD!!", "x", 0.0, 1), (None, None, None, None, None), (4, "", None, None, None), (5, "word " * 80_000, None, None, None)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, None)], "doc_id long, label int")
    w = quality.train(df, labels)
    got = quality.score(df, w).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (None, 4)}) == 1
    assert not quality.train(df.filter("false"), labels.filter("false")).any() and quality.score(df.filter("false"), w).count() == 0


def by_force(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            own = [(-float(v @ q), j) for j, v in zip(ids, x) if j != i]
            out[i] = [j for _, j in sorted(own)[:k]]
    return out


def test_neighbours(spark):
    t = pd.read_parquet(f"{BIGGER}/embeddings.parquet")
    got = QUERIES["op9_ann"](spark, BIGGER).toPandas()
    x, ids = np.stack(t["embedding"].tolist()).astype(float), t["vec_id"].tolist()
    want = by_force(ids, x, 20)
    place = dict(zip(ids, x))
    hit = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own["vec_id"].tolist()
        assert own["score"].is_monotonic_decreasing and all(abs(place[q] @ place[v] - s) < 1e-12 for v, s in zip(own["vec_id"], own["score"]))
        hit += len(set(own["vec_id"]) & set(want[q]))
    assert got["query_id"].nunique() == len(want) and hit / (20 * len(want)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, list int, code string"
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, [1.0, None]), (105, [1.0]), (None, [9.0, 9.0]), (120, [-1.0, 0.0]), (121, [0.5, 1.0])]
    v = spark.createDataFrame([(i, e, 1, "c") for i, e in rows], schema)
    got = ann.search(v, v.filter("vec_id % 20 = 0"), 5).collect()
    own = {q: [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in {r["query_id"] for r in got}}
    assert own == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 120: [121, 0, 1, 2, 3]}
    few = v.filter("vec_id IN (120, 121)")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, few.filter("vec_id = 120"), 5).collect()] == [(120, 1, 121, -0.5)]
    assert ann.search(v.filter("false"), v, 5).count() == 0 and ann.search(v.filter("vec_id = 101"), v, 5).count() == 0


def test_quantised_candidates_leave_smallest_ids():
    """All have one code: of candidates that tie the smallest ids are sent on, in the lists that a query visits, without itself."""
    rng = np.random.default_rng(5)
    model = ann.Model(np.zeros((2, 8), np.float32), np.zeros(2, int), np.ones((8, 1, 1), np.float32), 1)
    ids = rng.permutation(300)
    left = pd.DataFrame({"list": ids % 2, "vec_id": ids, "row": ids + 1000, "code": [bytes(8)] * 300})
    right = pd.DataFrame({"query": [1, 2, 3], "query_id": [4, 7, 9], "lists": [[0], [0, 1], [0, 1]], "embedding": [np.ones(8)] * 3, "floor": [-np.inf, -np.inf, 9.0]})
    got = ann._search(SimpleNamespace(value=model), ann.Settings(rerank=20))(left, right)
    own = {q: x["vec_id"].tolist() for q, x in got.groupby("query")}
    assert own == {1: [i for i in range(0, 42, 2) if i != 4], 2: [i for i in range(21) if i != 7]} and (got["row"] == got["vec_id"] + 1000).all()


def test_lists_to_visit_are_measured_over_all_rows(spark):
    """Half of the rows are in tight clusters, whose neighbours one list holds; the others are scattered."""
    rng = np.random.default_rng(3)
    tight = rng.normal(0, 10, (10, 16)).repeat(60, 0) + rng.normal(0, 0.01, (600, 16))
    for x, least, most in ((tight, 1, 6), (rng.normal(0, 1, (600, 16)), 7, 24)):
        v = spark.createDataFrame(pd.DataFrame({"vec_id": range(600), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
        model = ann.fit(v, 600, ann.Settings())
        sent = spark.sparkContext.broadcast(model)
        index = v.withColumn("row", F.col("vec_id")).mapInPandas(ann._index(sent), ann.INDEX)
        assert len(model.centroids) == 24 and least <= ann.lists_to_visit(index, sent, 20, ann.Settings()) <= most


@pytest.mark.parametrize("kind", ["odd_length", "tiny", "queries_apart"])
def test_neighbours_of_other_vectors(spark, kind):
    """Lengths that no number of parts divides, very small vectors, and queries that are unlike the rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (3000, 63 if kind == "odd_length" else 16)) * (1e-24 if kind == "tiny" else 1)
    if kind == "queries_apart":
        x = rng.normal(0, 1, (15, 16)).repeat(200, 0) + rng.normal(0, 1e-2, (3000, 16))
        x[::20] = rng.normal(0, 1, (150, 16))
    v = spark.createDataFrame(pd.DataFrame({"vec_id": range(3000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    found = ann.search(v, v.filter("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
    want = by_force(range(3000), x, 20)
    assert len(found) == 150 and sum(len(set(r["ids"]) & set(want[r["query_id"]])) for r in found) >= 0.93 * 20 * 150


def test_sample_of_vectors_of_which_few_are_usable(spark):
    zero = spark.range(40_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
    few = spark.createDataFrame([(50_000 + i, [1.0, i / 8]) for i in range(3)], "vec_id long, embedding array<double>")
    v = zero.unionByName(few)
    for s in (ann.Settings(), ann.Settings(least_sample=1, list_sample=1, book_rows=1, measured=1)):
        got = ann.search(v, few, 5, s).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(50000 + q, r, 50000 + i) for q, own in ((0, (1, 2)), (1, (2, 0)), (2, (1, 0))) for r, i in enumerate(own, 1)]


def test_neighbours_with_repeated_ids(spark):
    """More than k + 1 rows of one id and vector, then copies of that vector with other ids."""
    v = spark.createDataFrame([(20, [1.0, 0.0])] * 30 + [(21 + i, [1.0, 0.0]) for i in range(30)] + [(5, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(v, v.filter("vec_id = 20").limit(1), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [21, 22, 23, 24, 25]


PAGES = "page_id long, url string, html string, digest string, revisit int, n int"


def test_archives_of_odd_pages(spark):
    big, same_ = "<p>" + "long " * 100_000, "x" * 100
    rows = [(5, "http://a/b", same_), (3, "u", same_), (9, None, same_), (1, "u", None), (2, "", ""), (4, "a b\r\nWARC-Type: bad", "y" * 99), (6, "u", "y" * 99), (7, "u", big), (8, "u", big), (None, "u", same_), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "a\r\n\r\nWARC/1.1\r\n"), (3, "u", same_)]
    df = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES)
    got = warc.round_trip(df, archive_bytes=1000).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        least = min((x for x in first[h or ""] if x is not None), default=None)
        to = least if len(raw) >= 100 and i is not None and i != least else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == sorted(want, key=repr)
    texts = {r["page_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert texts[7] == big and texts[12] == "a\r\n\r\nWARC/1.1\r\n" and texts[1] == ""
    assert warc.round_trip(df.filter("false")).count() == 0


def archive(dictionary=b"", records=2):
    w = warc.ArchiveWriter(dictionary)
    for i in range(records):
        w.add([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("WARC-Date", "1970-01-01T00:00:00Z")], b"block %d" % i)
    return w.bytes()


def test_archives_of_a_page_with_two_payloads(spark):
    """Page 2 has a copy of page 1, of page 0 and a payload of its own."""
    texts = {c: f"<p>{c * 200}</p>" for c in "abc"}
    pages = spark.createDataFrame([(1, "u", texts["a"]), (2, "u", texts["a"]), (2, "u", texts["b"]), (0, "u", texts["c"]), (2, "u", texts["c"])], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): c for c, t in texts.items()}
    rows = sorted((r["page_id"], sha[r["payload_digest"]], r["record_type"], r["refers_to"] if r["refers_to"] is not None else -1) for r in got)
    assert rows == [(0, "c", "response", -1), (1, "a", "response", -1), (2, "a", "revisit", 1), (2, "b", "response", -1), (2, "c", "revisit", 0)]


@pytest.mark.parametrize("dictionary", [b"", b"some raw dictionary content " * 9])
def test_archive_round_trip(dictionary):
    assert [b for _, b in warc.read_archive(archive(dictionary))] == [b"block 0", b"block 1"]
    packed = zstandard.compress(dictionary) if dictionary else b""
    if dictionary:
        frame = warc.SKIPPABLE + struct.pack("<I", len(packed)) + packed
        assert len(list(warc.read_archive(frame + archive(dictionary)[8 + len(dictionary) :]))) == 2


def test_archive_damage():
    good, z = archive(), zstandard.ZstdCompressor()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\nab\r\n\r\n"
    assert len(list(warc.read_archive(z.compress(head % 2)))) == 1
    flipped = bytearray(good)
    flipped[-6] ^= 255
    for bad in (b"junk" + good, good[:-3], bytes(flipped), z.compress(head % 3), z.compress(head % 2 * 2), z.compress(b"no header"), z.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"), warc.SKIPPABLE + b"\xff\0\0\0"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


def test_reading_an_archive_is_linear():
    """Bytes that the reader looks at, counted by a bytes-like of its own, and frames of every header form."""
    z = zstandard.ZstdCompressor(level=1)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    blocks = [b"", b"a" * 300_000, np.random.default_rng(0).bytes(400_000), b"ab" * 40_000]
    for size in (True, False):
        c = zstandard.ZstdCompressor(level=1, write_content_size=size, write_checksum=size)
        data = b"".join(c.compress(head % (len(b), b)) for b in blocks)
        assert [b for _, b in warc.read_archive(data)] == blocks
    stream = z.compressobj()
    data = stream.compress(head % (5, b"hello")) + stream.flush()
    assert [b for _, b in warc.read_archive(data * 3)] == [b"hello"] * 3
    ends, at = [], 0
    while at < len(data) * 3:
        at = warc.frame_end(data * 3, at)
        ends.append(at)
    assert ends == [len(data), 2 * len(data), 3 * len(data)]


def test_archives_of_revisits_are_cut(spark, tmp_path):
    pages = spark.range(300).select((F.col("id") * 0 + 7 - F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 150).alias("html")).coalesce(1)
    made = warc.write_archives(pages, f"file://{tmp_path}/w", 20_000)
    got = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert made.count() > 4 and got.count() == 300 and got.filter("record_type = 'response'").count() == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from test_dedup import plain_components, plain_prints
    from test_tokens import ids_of

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "1 2 3", None, "s", 5), (10_003, docs.first()["text"], "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    steps = {}
    for name, stage in p.STAGES:
        before, docs = docs, p.materialize(stage(spark, docs, SMALL), name)
        steps[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_semi").count() == docs.count()
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in steps.items()}
    assert not {10_001, 10_002} & ids["language"] and 10_003 in ids["language"] and len(ids["language"]) == 201
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    good = set(labels[labels["quality"] == 1]["doc_id"])
    assert len(good & ids["language"] - ids["quality"]) <= 0.05 * len(good)
    kept = {}
    for r in steps["quality"].collect():
        t = " ".join(x for x in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"]))
        kept[t] = min(kept.get(t, r["doc_id"]), r["doc_id"])
    assert ids["exact"] == set(kept.values())
    rows = sorted((r["doc_id"], r["text"]) for r in steps["exact"].collect())
    assert ids["near"] == set(plain_components([i for i, _ in rows], plain_prints(rows)))
    packed = steps["packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(ids_of(t)) + 1 for i, t in rows if i in ids["near"]}
