"""Token-id output: one wavelet matrix per shard file, with access, count and lookup served from the file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, open_bytes, put_bytes, shared_dir
from .tokens import tokenizer_file, word_cache

#: Fixed values of the file format, all little-endian. Head: magic, then shard, number of documents, of ids, of distinct ids
#: and of planes, sizes of the two frames that follow the plane directory. Directory: per plane its bits, its zeros and its
#: place in the file. Frames (zstd): distinct ids, their counts and code lengths; document ids with a null mask, and lengths.
#: A plane is a row of records: ones before the record's 512 bits, then the bits. The file ends with its CRC-32.
MAGIC, HEAD, DIRECTORY = b"WVMTRX02", struct.Struct("<8s7Q"), np.dtype([("n", "<u8"), ("zeros", "<u8"), ("at", "<u8")])
RECORD = np.dtype([("ones", "<u4"), ("bits", "<u8", 8)])
BLOCK = 512
#: Ids to a shard, from which a new one begins. A longer document has a shard of its own.
SHARD_IDS = 2_000_000
#: Local positions to a slice, the unit in which lookups are dealt to tasks.
SLICE = 1 << 16


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code for these counts, of at most `most` bits: counts are halved until it fits."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    counts = counts.astype(np.int64)
    while True:
        order = np.argsort(counts, kind="stable")
        leaves, m = counts[order].tolist(), len(counts)
        weight, parent, i, j = [], [0] * (2 * m - 1), 0, 0
        for new in range(m, 2 * m - 1):
            total = 0
            for _ in range(2):
                if i < m and (j >= len(weight) or leaves[i] <= weight[j]):
                    total, child, i = total + leaves[i], i, i + 1
                else:
                    total, child, j = total + weight[j], m + j, j + 1
                parent[child] = new
            weight.append(total)
        depth = [0] * (2 * m - 1)
        for node in range(2 * m - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:m]) <= most:
            out = np.empty(m, np.int64)
            out[order] = depth[:m]
            return out
        counts = (counts + 1) // 2


class Codes:
    """Prefix codes of the distinct ids of a shard. Leaves of each length are the last nodes of their level, so that the ids
    which end there are the tail of the level's sequence and need no further planes."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
        self.symbols, self.counts, self.lengths = symbols, counts, lengths
        self.planes = int(lengths.max()) if len(lengths) else 0
        self.codes = np.zeros(len(symbols), np.int64)
        #: For each length: places of its leaves in `symbols`, in the order of their nodes, and their counts' running sum.
        self.leaves: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        nodes = np.zeros(1, np.int64)
        for length in range(1, self.planes + 1):
            nodes = np.concatenate([nodes << 1, nodes << 1 | 1])
            own = np.flatnonzero(lengths == length)
            cut = len(nodes) - len(own)
            self.codes[own] = nodes[cut:]
            self.leaves.append(own)
            self.starts.append(np.append(0, np.cumsum(counts[own])).astype(np.int64))
            nodes = nodes[:cut]

    def ended(self, length: int) -> int:
        return int(self.starts[length][-1])

    def find(self, value: int) -> int:
        """Place of an id in `symbols`, -1 if the shard does not hold it."""
        i = int(np.searchsorted(self.symbols, value))
        return i if i < len(self.symbols) and self.symbols[i] == value else -1


class WaveletMatrix:
    """Bit-planes of a sequence of ids under prefix codes, each stably partitioned by the planes above it.

    access, rank and select take arrays and fetch only the 512-bit records that they need, from memory or from a file.
    """

    def __init__(self, codes: Codes, n: int, sizes: list[int], zeros: list[int], fetch: Callable[[int, np.ndarray | None], np.ndarray]):
        self.codes, self.n, self.sizes, self.zeros, self.fetch = codes, n, sizes, zeros, fetch

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        codes = Codes(symbols, counts, code_lengths(counts, max(16, len(symbols).bit_length())) if len(symbols) else np.zeros(0, np.int64))
        width = 16 if codes.planes <= 16 else 32
        table = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.uint16 if width == 16 else np.uint32)
        table[symbols] = codes.codes << (width - codes.lengths)
        seq, planes, sizes, zeros = table[ids], [], [], []
        for level in range(codes.planes):
            one = (seq & seq.dtype.type(1 << (width - 1 - level))) != 0
            low, high = np.flatnonzero(~one), np.flatnonzero(one)
            planes.append(_records(one))
            sizes.append(len(seq))
            zeros.append(len(low))
            new = np.empty_like(seq)
            np.take(seq, low, out=new[: len(low)], mode="clip")
            np.take(seq, high, out=new[len(low) :], mode="clip")
            seq = new[: len(new) - codes.ended(level + 1)]
        return cls(codes, len(ids), sizes, zeros, lambda level, blocks: planes[level] if blocks is None else planes[level][blocks])

    def decode(self) -> np.ndarray:
        """All ids in their order."""
        codes = self.codes
        kind = np.uint16 if not len(codes.symbols) or codes.symbols[-1] < 1 << 16 else np.uint32
        ids = np.zeros(0, kind)
        for level in range(codes.planes - 1, -1, -1):
            own = codes.leaves[level + 1]
            below = np.concatenate([ids, np.repeat(codes.symbols[own].astype(kind), codes.counts[own])])
            n, z = self.sizes[level], self.zeros[level]
            bits = np.ascontiguousarray(self.fetch(level, None)["bits"]).view(np.uint8).ravel()
            one = np.unpackbits(bits, count=n, bitorder="little").view(bool)
            if len(below) != n:
                raise ValueError("planes that don't add up")
            ids = np.empty(n, kind)
            ids[np.flatnonzero(~one)] = below[:z]
            ids[np.flatnonzero(one)] = below[z:]
        return ids.astype("<u4")

    def _ones(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones among the first i bits of a plane, and bit i."""
        if not len(i):
            return i, i
        block = i // BLOCK
        some, back = np.unique(block, return_inverse=True)
        record, at = self.fetch(level, some)[back], i % BLOCK
        word = np.arange(8)
        used = np.clip(at[:, None] - 64 * word, 0, 64).astype(np.uint64)
        mask = np.where(used == 64, np.uint64(2**64 - 1), (np.uint64(1) << (used & np.uint64(63))) - np.uint64(1))
        ones = record["ones"].astype(np.int64) + np.bitwise_count(record["bits"] & mask).sum(1, dtype=np.int64)
        bit = record["bits"][np.arange(len(i)), at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
        return ones, bit.astype(np.int64)

    def access(self, positions) -> np.ndarray:
        """Ids at these positions. Raises IndexError for one that there isn't."""
        i = np.asarray(positions, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError(positions)
        out, todo = np.zeros(len(i), np.int64), np.arange(len(i))
        for level in range(self.codes.planes):
            ones, bit = self._ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            left = self.sizes[level] - self.codes.ended(level + 1)
            leaf = i >= left
            own = np.searchsorted(self.codes.starts[level + 1], i[leaf] - left, side="right") - 1
            out[todo[leaf]] = self.codes.symbols[self.codes.leaves[level + 1][own]]
            i, todo = i[~leaf], todo[~leaf]
        return out

    def count(self, value: int) -> int:
        """Occurrences of an id, from the table of ids alone."""
        at = self.codes.find(value)
        return int(self.codes.counts[at]) if at >= 0 else 0

    def rank(self, value: int, ends) -> np.ndarray:
        """Occurrences of an id among the first ends[k] ids, for each k."""
        i = np.clip(np.asarray(ends, np.int64), 0, self.n)
        at = self.codes.find(value)
        if at < 0:
            return np.zeros(len(i), np.int64)
        start, length, code = np.zeros(1, np.int64), int(self.codes.lengths[at]), int(self.codes.codes[at])
        for level in range(length):
            both = np.concatenate([start, i])
            inside = np.minimum(both, self.sizes[level] - 1)  # one behind the last bit: the last bit counted too
            ones, bit = self._ones(level, inside)
            ones = ones + np.where(both > inside, bit, 0)
            both = self.zeros[level] + ones if code >> (length - 1 - level) & 1 else both - ones
            start, i = both[:1], both[1:]
        return i - start

    def select(self, value: int, occurrences) -> np.ndarray:
        """Positions of occurrences (from 0) of an id; -1 for those that there aren't."""
        k, at = np.asarray(occurrences, np.int64), self.codes.find(value)
        out = np.full(len(k), -1, np.int64)
        if at < 0:
            return out
        ok = (k >= 0) & (k < self.codes.counts[at])
        length, code = int(self.codes.lengths[at]), int(self.codes.codes[at])
        place = int(np.searchsorted(self.codes.leaves[length], at))
        i = k[ok] + self.sizes[length - 1] - self.codes.ended(length) + self.codes.starts[length][place]
        for level in range(length - 1, -1, -1):
            one = code >> (length - 1 - level) & 1
            i = self._nth(level, i - self.zeros[level] if one else i, one)
        out[ok] = i
        return out

    def _nth(self, level: int, k: np.ndarray, one: int) -> np.ndarray:
        """Positions of the k-th bits (from 0) that are `one` in a plane: binary search over records, then in one."""
        if not len(k):
            return k
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), -(-self.sizes[level] // BLOCK) - 1)
        before = lambda b: (lambda ones: ones if one else b * BLOCK - ones)(self._starts(level, b))
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            up = before(mid) <= k
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid - 1)
        some, back = np.unique(lo, return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(self.fetch(level, some)["bits"]).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        seen = np.cumsum(bits == one, 1, dtype=np.int64)[back]
        return lo * BLOCK + (seen <= (k - before(lo))[:, None]).sum(1)

    def _starts(self, level: int, blocks: np.ndarray) -> np.ndarray:
        some, back = np.unique(blocks, return_inverse=True)
        return self.fetch(level, some)["ones"].astype(np.int64)[back]


def _records(one: np.ndarray) -> np.ndarray:
    """A plane's records."""
    blocks = -(-len(one) // BLOCK)
    bits = np.zeros(blocks * BLOCK // 8, np.uint8)
    bits[: -(-len(one) // 8)] = np.packbits(one, bitorder="little")
    out = np.empty(blocks, RECORD)
    out["bits"] = bits.view("<u8").reshape(blocks, 8)
    ones = np.bitwise_count(out["bits"]).sum(1, dtype=np.int64)
    out["ones"] = np.cumsum(ones) - ones
    return out


def pack_shard(shard: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard file."""
    import zstandard

    z, m = zstandard.ZstdCompressor(level=1), WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    table = z.compress(m.codes.symbols.astype("<u4").tobytes() + m.codes.counts.astype("<u8").tobytes() + m.codes.lengths.astype("u1").tobytes())
    docs = z.compress(known.tobytes() + own.tobytes() + np.array(lengths, "<i8").tobytes())
    planes = [m.fetch(k, None).tobytes() for k in range(m.codes.planes)]
    directory = np.zeros(len(planes), DIRECTORY)
    first = HEAD.size + directory.nbytes + len(table) + len(docs)
    directory["n"], directory["zeros"] = m.sizes, m.zeros
    directory["at"] = first + np.cumsum([0, *map(len, planes)])[:-1]
    out = b"".join([HEAD.pack(MAGIC, shard, len(doc_ids), len(ids), len(m.codes.symbols), len(planes), len(table), len(docs)), directory.tobytes(), table, docs, *planes])
    return out + struct.pack("<I", zlib.crc32(out))


def open_shard(read: Callable[[int, int], bytes], whole: bool = False) -> tuple[int, tuple[list[int | None], np.ndarray] | None, WaveletMatrix]:
    """Shard number, documents (ids and lengths, if `whole`) and matrix of a file that `read(offset, size)` reads from.

    Only the head, the directory and the table of ids are read at once; planes are read record by record, or whole.
    """
    import zstandard

    head = read(0, HEAD.size)
    if len(head) < HEAD.size or head[:8] != MAGIC:
        raise ValueError("not a shard file")
    _, shard, docs, n, symbols, planes, table_size, docs_size = HEAD.unpack(head)
    directory = np.frombuffer(read(HEAD.size, planes * DIRECTORY.itemsize), DIRECTORY)
    at, z = HEAD.size + directory.nbytes, zstandard.ZstdDecompressor()
    table = z.decompress(read(at, table_size))
    codes = Codes(*(np.frombuffer(table, t, symbols, o * symbols).astype(np.int64) for t, o in (("<u4", 0), ("<u8", 4), ("u1", 12))))
    own = None
    if whole:
        raw = z.decompress(read(at + table_size, docs_size))
        known, ids, lengths = np.frombuffer(raw, np.uint8, docs), np.frombuffer(raw, "<i8", docs, docs), np.frombuffer(raw, "<i8", docs, 9 * docs)
        own = ([d if k else None for k, d in zip(known.tolist(), ids.tolist())], lengths)
    sizes, zeros, places = (directory[c].astype(np.int64).tolist() for c in ("n", "zeros", "at"))

    def fetch(level: int, blocks: np.ndarray | None) -> np.ndarray:
        if blocks is None or whole:
            rows = np.frombuffer(read(places[level], -(-sizes[level] // BLOCK) * RECORD.itemsize), RECORD)
            return rows if blocks is None else rows[blocks]
        return np.frombuffer(b"".join(read(places[level] + int(b) * RECORD.itemsize, RECORD.itemsize) for b in blocks), RECORD)

    return shard, own, WaveletMatrix(codes, n, sizes, zeros, fetch)


def read_shard(data: bytes) -> tuple[int, list[int | None], np.ndarray, WaveletMatrix]:
    """Shard number, document ids, lengths and matrix of a whole shard file. Raises ValueError for a damaged one."""
    if data[:8] != MAGIC or len(data) < HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a shard file, or a damaged one")
    view = memoryview(data)
    shard, (docs, lengths), matrix = open_shard(lambda at, size: view[at : at + size], whole=True)
    return shard, docs, lengths, matrix


def _write(file: str, folder: str, end_id: int, shard_ids: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), word_cache(file)
        docs, ids, size, shard = [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pd.DataFrame:
            nonlocal docs, ids, size, shard
            key = part << 32 | shard
            all_ids, name = np.frombuffer(b"".join(ids), "<u4"), f"{part:06d}-{shard:06d}.wvm"
            put_bytes(f"{folder}/{name}", pack_shard(key, docs, [len(x) // 4 for x in ids], all_ids))
            row = pd.DataFrame({"part": [part], "shard": [key], "n_ids": [len(all_ids)], "file": [f"{folder}/{name}"]})
            docs, ids, size, shard = [], [], 0, shard + 1
            return row

        for b in batches:
            own = iter(b["doc_id"].tolist())
            for some in cache.chunks(b["text"].fillna("").tolist()):
                for x in some:
                    d = next(own)
                    docs.append(None if pd.isna(d) else int(d))
                    ids.append(x + end)
                    size += len(ids[-1]) // 4
                    if size >= shard_ids:
                        yield flush()
        if docs:
            yield flush()

    return rows


def _read(end_id: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                shard, docs, lengths, m = read_shard(data)
                ids, ends = m.decode(), np.cumsum(lengths)
                if (int(ends[-1]) if len(ends) else 0) != len(ids) or (m.access(ends - 1) != end_id).any():
                    raise ValueError("documents that don't end with their end id")
                raw, starts = memoryview(ids.tobytes()), ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "shard": shard, "at": starts, "n_tokens": lengths, "ids_crc32": crc})

    return rows


def write_ids(docs: DataFrame, folder: str, file: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts and write shard files in ascending doc_id order; returns the catalog: shard, file, first, n_ids.

    `first` is the number of ids before the shard. Files are named by range partition and number, so a task that runs
    again writes the same files again. Ranges are cut by id and row, so rows that share an id, or have none, are many tasks' work. One number a range partition passes through the driver to turn shard sizes into starts.
    """
    spark = docs.sparkSession
    keys = ["doc_id", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = materialize(ranged.mapInPandas(_write(file, folder, end_id, shard_ids), "part long, shard long, n_ids long, file string"), "shards")
    before, total = [], 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect())):
        before.append((part, total))
        total += n
    parts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return shards.join(parts, "part").select("shard", "file", (F.col("before") + within).alias("first"), "n_ids")


def read_ids(catalog: DataFrame, folder: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of each document in the shard files, which are read and checked whole."""
    spark = catalog.sparkSession
    if catalog.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("content")
    # Every shard's row goes to its own documents; shards are few and no key is hot, as each holds bounded documents.
    found = files.mapInPandas(_read(end_id), "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")
    return found.join(catalog, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def _tokens_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for file, own in b.groupby("file", sort=False):
            with open_bytes(file) as read:
                yield pd.DataFrame({"position": own["position"], "token": open_shard(read)[2].access(own["at"].to_numpy())})


def token_at(catalog: DataFrame, positions: DataFrame, step: int = SHARD_IDS) -> DataFrame:
    """position and token for each of `positions` (position): ids before it in all files. Others than there are give no row.

    Positions find their shard by an equi-join on multiples of `step` and a comparison; of a file only the records on the
    way are read. Positions of one shard are dealt out in slices, so a shard that all ask for is no single task's work.
    """
    parts = catalog.filter("n_ids > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_ids") - 1) / step))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / step))
    found = asked.join(parts, "cell").filter("position >= first AND position < first + n_ids").select("position", "file", (F.col("position") - F.col("first")).alias("at"))
    dealt = found.repartition("file", F.floor(F.col("at") / SLICE)).sortWithinPartitions("file", "at")
    return dealt.mapInPandas(_tokens_at, "position long, token long")


def count_of(catalog: DataFrame, tokens: list[int]) -> DataFrame:
    """token and its occurrences in all files, from their tables of ids: no plane is read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                with open_bytes(file) as read:
                    m = open_shard(read)[2]
                    yield pd.DataFrame({"token": tokens, "n": [m.count(t) for t in tokens]})

    return catalog.select("file").mapInPandas(rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def positions_of(catalog: DataFrame, token: int, some: int = 4096) -> DataFrame:
    """All positions of a token: each file selects its occurrences, `some` at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, first in zip(b["file"], b["first"]):
                with open_bytes(file) as read:
                    m = open_shard(read)[2]
                    for lo in range(0, m.count(token), some):
                        yield pd.DataFrame({"position": first + m.select(token, np.arange(lo, min(lo + some, m.count(token))))})

    return catalog.select("file", "first").mapInPandas(rows, "position long")


def encode_and_reread(docs: DataFrame, file: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ids of all texts to wavelet-matrix shards and return what the files hold for each document.

    Defined cases: null text is empty and has only the end id; null doc_ids come first; rows that share a doc_id are
    each written, in the order of their rows; an empty table gives no file and no row; other columns are ignored.
    """
    folder = shared_dir(docs.sparkSession, "wavelet")
    catalog = write_ids(docs, folder, file or tokenizer_file("byte_bpe_50k.json"), end_id, shard_ids)
    return read_ids(catalog, folder, end_id)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_reread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
