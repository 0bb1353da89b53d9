"""SentencePiece-style encoding and decoding: Viterbi over a double-array trie of pieces, with byte fallback."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import MARK, Vocabulary, vocabulary
from .tokens import tokenizer_file

#: Words that a worker remembers.
CACHED = 200_000
#: No piece holds a marker behind another character, nor a line end with others: segmentations of these parts are independent.
PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class Codec:
    """Encodes and decodes whole texts; remembers the ids of words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.whole = vocab.crosses or vocab.lines
        self.ids: dict[str, bytes] = {}
        #: Bytes of each piece for decoding.
        self.bytes = [p.encode() for p in vocab.pieces]
        for b, i in enumerate(vocab.byte_ids.tolist()):
            if i >= 0:
                self.bytes[i] = bytes([b])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, whose spaces become markers behind one marker in front. Empty texts have none."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        parts = [[t] if self.whole and t else PARTS.findall(t) for t in marked]
        out = []
        for lo in range(0, len(texts), 64):
            some = parts[lo : lo + 64]
            if len(self.ids) > CACHED:
                self.ids = {}
            new = list(set().union(*some).difference(self.ids))
            self.ids.update(zip(new, self.vocab.best([w.encode("utf-8", "surrogatepass") for w in new])))
            out.extend(np.frombuffer(b"".join(map(self.ids.__getitem__, p)), "<u4") for p in some)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text: bytes joined, markers turned to spaces, the one in front removed. Broken UTF-8 gives U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(1)
def codec(file: str) -> Codec:
    return Codec(vocabulary(file))


def _encode(file: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 512):  # ids of few documents at a time
                x = b.iloc[lo : lo + 512]
                yield x.drop(columns="text").assign(ids=[i.astype(np.int32) for i in codec(file).encode(x["text"].fillna("").tolist())])

    return rows


def _decode(file: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(decoded=[codec(file).decode(np.asarray(i)) for i in b["ids"]])

    return rows


def encode_documents(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id and ids of each row of `docs`, which needs doc_id and text.

    Defined cases: null and empty texts have no ids; a literal marker in a text decodes to a space; rows are independent,
    so repeats, null ids and empty tables need no rule; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_encode(file or tokenizer_file("piece_bpe_32k.model")), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, file: str | None = None) -> DataFrame:
    """`encoded` (doc_id, ids) with the text of its ids as decoded."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInPandas(_decode(file or tokenizer_file("piece_bpe_32k.model")), "doc_id long, ids array<int>, decoded string")


def _digest(file: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(file)
        for b in batches:
            for lo in range(0, len(b), 256):
                x = b.iloc[lo : lo + 256]
                ids = c.encode(x["text"].fillna("").tolist())
                texts = [c.decode(i) for i in ids]
                yield pd.DataFrame(
                    {
                        "doc_id": x["doc_id"], "n_pieces": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids],
                        "decoded_chars": list(map(len, texts)), "decoded_sha256": [sha256(t.encode()).hexdigest() for t in texts],
                    }
                )

    return rows


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' number and CRC-32, and length and SHA-256 of the text decoded from them.

    Encodes and decodes in one pass, so ids of all documents need not leave the task.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(_digest(tokenizer_file("piece_bpe_32k.model")), "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, decoded_sha256 string")
