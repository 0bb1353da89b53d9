"""Token shards, packing, pieces: exact ids, round trips and brute force."""

import zlib
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from support import SMALL

from tideloom.llm import packing, sentencepieces, wavelet
from tideloom.llm.pieces import DoubleArrayTrie, Vocabulary, vocabulary
from tideloom.llm.tokens import WordCache, tokenizer_file, word_cache

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "\n", "a  b", "a \n b", " a", "\na", "a\n", "a ", "x\n\ny z", "don't  do\x85 it's", "a b c  d", "　x y\x1c z", "!\x1c a", "word, word's (word) Été! naïve_1 日本 \U0001f600 <|endoftext|> end", "tab\tin it", "a\r\nb \r\n c", " x   y", "x" * 5000, "a nul\0 b\0c \0 word, \0"]


def ids_of(text):
    t = word_cache(BPE).tokenizer
    return t.encode(text, add_special_tokens=False).ids


def small_texts():
    return pd.read_parquet(f"{SMALL}/documents.parquet")["text"].fillna("").tolist()


def test_word_cache_is_exact():
    texts = ODD + small_texts()
    for cache in (word_cache(BPE), WordCache(BPE)):
        for text, got in zip(texts, cache.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(text), text[:80]


def test_word_cache_forgets(monkeypatch):
    monkeypatch.setattr("tideloom.llm.tokens.CACHED", 300)
    monkeypatch.setattr("tideloom.llm.tokens.CHUNK", 20_000)
    cache, texts = WordCache(BPE), small_texts()
    for text, got in zip(texts, cache.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text)
    assert len(cache.ids) < 6000


def test_long_texts_are_cut_before_white_space(monkeypatch):
    monkeypatch.setattr("tideloom.llm.tokens.CHUNK", 50)
    for text in ["a word and\nanother, " * 40, "x" * 300, "one " * 12 + "y" * 200 + " end", "\n".join(["ab"] * 60) + "\n"]:
        assert np.frombuffer(WordCache(BPE).encode(["b", text, ""])[1], "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("n, most", [(0, 50), (1, 50), (7, 50), (512, 50), (513, 1), (3000, 50), (5000, 70_000)])
def test_wavelet_matrix(n, most):
    x = np.minimum(np.random.default_rng(n).geometric(0.05, n), most) if most == 50 else np.random.default_rng(n).integers(0, most, n)
    data = wavelet.pack_shard(1, [1], [n], x.astype("<u4"))
    for m in (wavelet.WaveletMatrix.build(x), wavelet.read_shard(data)[3], wavelet.open_shard(lambda at, size: data[at : at + size])[2]):
        assert m.decode().tolist() == x.tolist()
        at = np.random.default_rng(1).permutation(n)[:300]
        assert m.access(at).tolist() == x[at].tolist()
        with pytest.raises(IndexError):
            m.access([n])
        for v in (*np.unique(x)[::13].tolist(), 99_999):
            own, ends = np.flatnonzero(x == v), np.array([0, n // 3, n, n + 5])
            assert m.count(v) == len(own) and m.rank(v, ends).tolist() == [int((x[:e] == v).sum()) for e in ends]
            assert m.select(v, [-1, *range(len(own)), len(own)]).tolist() == [-1, *own.tolist(), -1]


def test_codes_are_short_and_bounded():
    counts = np.array([2**k for k in range(40)])
    assert wavelet.code_lengths(counts[:9], 16).tolist() == [8, 8, 7, 6, 5, 4, 3, 2, 1]
    lengths = wavelet.code_lengths(counts, 16)
    assert lengths.max() <= 16 and (0.5**lengths).sum() <= 1
    for own in (counts, np.ones(1), np.array([3, 3, 3])):
        lengths = wavelet.code_lengths(own, 16)
        c = wavelet.Codes(np.arange(len(own)), own.astype(np.int64), lengths)
        texts = [f"{code:0{n}b}" for code, n in zip(c.codes.tolist(), lengths.tolist())]
        assert not any(a != b and b.startswith(a) for a in texts for b in texts) and len(set(texts)) == len(own)


def test_shard_round_trip_and_damage():
    ids = np.array([5, 2, 70000, 2], np.uint32)
    data = wavelet.pack_shard(9, [None, 4], [2, 2], ids)
    shard, docs, lengths, m = wavelet.read_shard(data)
    assert (shard, docs, lengths.tolist(), m.decode().tolist()) == (9, [None, 4], [2, 2], ids.tolist())
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 4
    for bad in (b"x" + data[1:], data + b"1", data[:-9], bytes(flipped), b""):
        with pytest.raises(ValueError):
            wavelet.read_shard(bad)


def test_lookups_read_only_what_they_need():
    x = np.random.default_rng(0).integers(0, 300, 200_000).astype("<u4")
    data, seen = wavelet.pack_shard(0, [1], [len(x)], x), []
    read = lambda at, size: (seen.append(size), data[at : at + size])[1]
    m = wavelet.open_shard(read)[2]
    assert m.access([123_456])[0] == x[123_456] and m.select(7, [5])[0] == np.flatnonzero(x == 7)[5] and sum(seen) < len(data) / 20


def test_spark_lookups(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a b a"), (None, "a b a")]
    folder = f"file://{tmp_path}/wvm"
    catalog = wavelet.write_ids(frame(spark, rows), folder, BPE, 2, 100)
    ids = np.concatenate([np.array([*ids_of(t), 2]) for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))])
    got = wavelet.read_ids(catalog, folder, 2)
    assert got.agg(F.sum("n_tokens")).first()[0] == len(ids) and catalog.count() > 1
    want = np.empty(len(ids), np.int64)
    for r in wavelet.token_at(catalog, spark.range(-2, len(ids) + 2).withColumnRenamed("id", "position"), step=64).collect():
        want[r["position"]] = r["token"]
    # Texts that share doc_id 3 come in the order of their rows.
    assert sorted(want.tolist()) == sorted(ids.tolist()) and (want[:60] == ids[:60]).all()
    tokens = [2, int(ids[0]), 49_999]
    assert {r["token"]: r["n"] for r in wavelet.count_of(catalog, tokens).collect()} == {t: int((ids == t).sum()) for t in tokens}
    assert sorted(r["position"] for r in wavelet.positions_of(catalog, 2, some=3).collect()) == np.flatnonzero(want == 2).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, start int")


@pytest.mark.parametrize("shard_ids", [100, 1_000_000])
def test_shards_of_documents(spark, shard_ids):
    rows = [(10 - i, t) for i, t in enumerate(ODD)] + [(None, "nobody"), (77, None), (78, "twice"), (78, "twice")]
    got = sorted(wavelet.encode_and_reread(frame(spark, rows), shard_ids=shard_ids).collect(), key=lambda r: r["start"])
    want = sorted(((i, np.array([*ids_of(t or ""), 2], "<u4")) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    assert len(got) == len(want)
    for r, (i, ids) in zip(got, want):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.encode_and_reread(frame(spark, [])).count() == 0


def check_pieces(got, texts):
    got = pd.DataFrame([r.asDict() for r in got])
    for i, own in got.groupby("doc_id"):
        ids, own = np.array([*ids_of(texts[i]), 1], "<u4"), own.sort_values("start")
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])]
    sizes = []
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        sizes.append(own["length"].sum())
    return got, np.array(sizes)


def test_packing_documents(spark):
    texts = dict(enumerate(ODD + ["w " * 9000] + small_texts()))
    got, sizes = check_pieces(packing.pack_documents(frame(spark, list(texts.items()))).collect(), texts)
    assert sizes.max() == 2048 and sorted(got["doc_id"].unique()) == sorted(texts)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 4 * 2048
    full = got.groupby("step_group")["length"].sum()
    assert full.max() < 1.5 * packing.STEP_IDS
    odd = packing.pack_documents(frame(spark, [(None, "a"), (1, None), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in odd) == [(0, 2), (1, 1), (1, 1)]
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_pack_properties():
    rng = np.random.default_rng(0)
    for n in (1, 5, 300):
        lengths = rng.integers(1, 5000, n).tolist()
        at, fill = dict.fromkeys(range(n), 0), {}
        for d, start, m, w, offset, tier in packing.pack(lengths):
            assert m > 0 and offset == fill.get(w, (0, tier))[0] and fill.get(w, (0, tier))[1] == tier
            fill[w] = (offset + m, tier)
            at[d] += m
        assert at == dict(enumerate(lengths)) and sum(size != tier for size, tier in fill.values()) <= 1


def best_by_force(vocab, word):
    """Best score over all segmentations, characters without a piece spelt in bytes."""
    index = {p: i for i, p in enumerate(vocab.pieces)}
    best = -np.inf
    for cuts in product((0, 1), repeat=len(word) - 1):
        parts, part = [], word[0]
        for c, cut in zip(word[1:], cuts):
            if cut:
                parts.append(part)
                part = c
            else:
                part += c
        parts.append(part)
        scores = [vocab.scores[index[p]] if p in index else vocab.unknown_score if len(p) == 1 else -np.inf for p in parts]
        best = max(best, sum(scores))
    return best


def test_best_segmentation_by_force():
    v = vocabulary(PIECES)
    words = ["▁the", "▁Zeitung", "▁niño", "▁日本x", "▁abcabcabc", "▁▁▁a", "▁ononono!!", "q"]
    for w, ids in zip(words, v.best([w.encode() for w in words])):
        ids = np.frombuffer(ids, "<u4").tolist()
        score, byte_run = 0.0, 0
        text = sentencepieces.Codec(v).decode(np.array(ids))
        for i in ids:
            if i in v.byte_ids:
                byte_run += 1
            else:
                score += v.scores[i]
        spelt = sum(1 for c in w if c not in v.pieces)
        assert abs(score + spelt * v.unknown_score - best_by_force(v, w)) < 1e-9 and text.replace(" ", "") == w.replace("▁", "")
        assert v.best_of_long(w.encode()) == np.array(ids, "<u4").tobytes()


def test_trie():
    t = DoubleArrayTrie({b"a": 1, b"ab": 2, b"abc": 3, b"\xff": 4, b"b\x00": 5})
    assert t.prefixes(b"abcd", 0) == [(1, 1), (2, 2), (3, 3)] and t.prefixes(b"\xff", 0) == [(1, 4)] and t.prefixes(b"b\x00", 0) == [(2, 5)] and t.prefixes(b"zz", 0) == []


def test_pieces_round_trip(spark):
    texts = [t for t in ODD if "▁" not in t] + small_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    got = sentencepieces.decode_documents(sentencepieces.encode_documents(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (texts[r["doc_id"]] if r["doc_id"] is not None else "")
    assert sentencepieces.encode_documents(frame(spark, [])).count() == 0


def test_scores_come_from_ranks():
    v = Vocabulary(PIECES)
    own = v.scores[v.trie.value[v.trie.value >= 0]]
    assert abs(np.exp(own).sum() - 1) < 1e-9
