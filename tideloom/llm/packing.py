"""Hierarchical multi-length packing of token ids into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import tokenizer_file, word_cache

#: Context sizes, powers of two; the last is the longest window.
TIERS = (256, 512, 1024, 2048)
#: Ids that a task holds before it packs them.
HELD_IDS = 2_000_000
#: Ids to a step group, a multiple of the longest window.
STEP_IDS = 16 * TIERS[-1]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset, tier) for documents of these lengths.

    A document is cut into longest windows; what is left goes to the smallest tier that holds it. Tiers are filled from
    the longest: each piece, longest first, opens a window, and its gap takes the longest pieces of the shorter tiers that
    fit, then the head of a longer one, which is cut. So every window but the last of all is full to its tier.
    """
    most, pieces, window = tiers[-1], [], 0
    held: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # length, document, start
    for d, n in enumerate(lengths):
        for start in range(0, n - n % most, most):
            pieces.append((d, start, most, window, 0, most))
            window += 1
        if n % most:
            held[next(k for k, t in enumerate(tiers) if t >= n % most)].append((n % most, d, n - n % most))
    for h in held:
        h.sort()
    for k in range(len(tiers) - 1, -1, -1):
        while held[k]:
            gap, at = tiers[k], 0
            while gap:
                # The longest that fits: tiers up to this one hold ever shorter pieces.
                j = next((j for j in range(k, -1, -1) if held[j] and held[j][0][0] <= gap), None)
                if j is None:
                    j = next((j for j in range(k + 1) if held[j]), None)
                    if j is None:
                        break
                    n, d, start = held[j].pop(0)  # shortest of those that don't fit
                    pieces.append((d, start, gap, window, at, tiers[k]))
                    rest = n - gap
                    i = next(i for i, t in enumerate(tiers) if t >= rest)
                    _insert(held[i], (rest, d, start + gap))
                    gap = 0
                else:
                    n, d, start = held[j].pop(_last_fit(held[j], gap))
                    pieces.append((d, start, n, window, at, tiers[k]))
                    at, gap = at + n, gap - n
            window += 1
    return pieces


def _last_fit(held: list[tuple[int, int, int]], gap: int) -> int:
    from bisect import bisect_left

    return bisect_left(held, (gap + 1,)) - 1


def _insert(held: list[tuple[int, int, int]], piece: tuple[int, int, int]) -> None:
    from bisect import insort

    insort(held, piece)


def step_groups(sizes: np.ndarray, costs: np.ndarray, step_ids: int = STEP_IDS) -> np.ndarray:
    """A group for each window: about step_ids ids in each, tiers and attention costs spread evenly over the groups.

    Windows in descending size and cost are dealt back and forth over the groups, so each gets its share of every tier.
    """
    groups = max(1, round(sizes.sum() / step_ids))
    order = np.lexsort((-costs, -sizes))
    lap, place = np.divmod(np.arange(len(sizes)), groups)
    dealt = np.empty(len(sizes), np.int64)
    dealt[order] = np.where(lap % 2, groups - 1 - place, place)
    return dealt


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def _pack_rows(file: str, end_id: int, tiers: tuple[int, ...], held_ids: int, step_ids: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, cache = TaskContext.get().partitionId() << 36, word_cache(file)
        end = np.array([end_id], "<u4").tobytes()
        docs, ids, size, windows, steps = [], [], 0, 0, 0

        def flush() -> pd.DataFrame:
            nonlocal docs, ids, size, windows, steps
            p = np.array(pack([len(x) // 4 for x in ids], tiers), np.int64).reshape(-1, 6)
            doc, start, n, window, at, tier = p.T
            count = int(window.max()) + 1
            full, cost = np.zeros(count, np.int64), np.zeros(count, np.int64)
            full[window] = tier
            np.add.at(cost, window, n * n)
            group = step_groups(full, cost, step_ids)
            out = pd.DataFrame(
                {
                    "doc_id": pd.array([docs[d] for d in doc.tolist()], "Int64"), "start": start, "length": n,
                    "ids_crc32": [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + m)]) for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist())],
                    "doc_tokens": [len(ids[d]) // 4 for d in doc.tolist()], "sequence_id": task + windows + window, "offset": at, "tier": tier, "step_group": task + steps + group[window],
                }
            )
            docs, ids, size, windows, steps = [], [], 0, windows + count, steps + int(group.max()) + 1
            return out

        for b in batches:
            own, texts = b["doc_id"].tolist(), b["text"].fillna("").tolist()
            todo = iter(own)
            for some in cache.chunks(texts):
                for x in some:
                    d = next(todo)
                    docs.append(None if pd.isna(d) else int(d))
                    ids.append(x + end)
                    size += len(ids[-1]) // 4
                    if size >= held_ids:
                        yield flush()
        if docs:
            yield flush()

    return rows


def pack_documents(docs: DataFrame, file: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, held_ids: int = HELD_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """One row per piece; see COLUMNS. Packs where the documents lie: nothing is shuffled, and a task holds `held_ids` at a time.

    Padding is that of one window for each `held_ids` ids of a task at most.

    Defined cases: null text is empty and has only the end id; null and repeated doc_ids are packed like others, each
    row a document of its own; a document of any length is cut; an empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_pack_rows(file or tokenizer_file("byte_bpe_50k.json"), end_id, tiers, held_ids, step_ids), COLUMNS)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
