"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_for, hot_left_join, in_fraction, materialize, put_bytes, shared_dir

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a Zstandard frame, version line.
SKIPPABLE, FRAME, VERSION = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records to an archive, from which a new one begins; bound of the dictionary and of the pages it is made from.
ARCHIVE_BYTES, DICT_BYTES, DICT_PAGES = 32_000_000, 32_768, 200
#: Payloads from this size on are stored once.
LEAST_SHARED = 100


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A compression dictionary from the heads (4,096 characters) of DICT_PAGES pages at most, which a hash of their place
    in the table chooses; empty when they are too few. Only the size of archives depends on it, no record does."""
    import zstandard

    # Chosen by row, so that neither copies nor repeated ids make the sample larger.
    share = in_fraction(F.monotonically_increasing_id(), fraction_for(2 * DICT_PAGES, pages.count()))
    some = pages.filter("html IS NOT NULL").select("page_id", F.substring("html", 1, 4096).alias("head")).filter(share)
    samples = [r["head"].encode() for r in some.orderBy(F.xxhash64("page_id"), "page_id", "head").limit(DICT_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Bytes of an archive, record by record."""

    def __init__(self, dictionary: bytes):
        import zstandard

        self.parts = [SKIPPABLE + struct.pack("<I", len(dictionary)) + dictionary] if dictionary else []
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)

    def add(self, headers: list[tuple[str, str]], block: bytes) -> int:
        """Bytes of the record before compression."""
        lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
        record = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        self.parts.append(self.compressor.compress(record))
        return len(record)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its header and block headers. Raises WarcError for a torn one.

    A frame is its magic number, a descriptor, optional window, dictionary id and content size, blocks of a 3-byte header
    (last block, type, size) and an optional checksum.
    """
    if data[at : at + 4] != FRAME:
        raise WarcError(f"no frame at byte {at}")
    torn = WarcError(f"a torn frame at byte {at}")
    if at + 5 > len(data):
        raise torn
    descriptor = data[at + 4]
    alone, size = descriptor >> 5 & 1, descriptor >> 6
    end = at + 5 + (not alone) + (0, 1, 2, 4)[descriptor & 3] + (alone, 2, 4, 8)[size]
    last = False
    while not last:
        if end + 3 > len(data):
            raise torn
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        end += 3 + (1 if kind == 1 else block >> 3)
    end += 4 * (descriptor >> 2 & 1)
    if end > len(data):
        raise torn
    return end


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record, in time in proportion to the archive.

    Raises WarcError for a wrong magic number, a frame that holds no or more than one record, a torn frame, a missing
    header, and a length that the block does not have. A dictionary may itself be a Zstandard frame.
    """
    import zstandard

    dictionary, at = None, 0
    if data[:4] == SKIPPABLE:
        if len(data) < 8 or len(data) < 8 + (size := struct.unpack_from("<I", data, 4)[0]):
            raise WarcError("a torn dictionary frame")
        raw, at = data[8 : 8 + size], 8 + size
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw)
    one = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        try:
            frame = memoryview(data)[at:end]
            record = one.decompress(frame) if zstandard.frame_content_size(frame) >= 0 else one.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"a broken frame at byte {at}: {e}") from e
        at = end
        yield parse_record(record)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or not lines[0].startswith("WARC/"):
        raise WarcError("no record header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a bad header line: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("a block of a wrong length, or more than one record in a frame")
    return headers, rest[:-4]


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, split, payload = block.partition(b"\r\n\r\n")
    if not split:
        raise WarcError("no HTTP header")
    pairs = (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def _write(folder: str, dictionary: bytes, archive_bytes: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, size, w = TaskContext.get().partitionId(), 0, 0, ArchiveWriter(dictionary)

        def flush() -> pd.DataFrame:
            nonlocal n, size, w
            data = w.bytes()
            put_bytes(f"{folder}/{part:06d}-{n:06d}.warc.zst", data)
            n, size, w = n + 1, 0, ArchiveWriter(dictionary)
            return pd.DataFrame({"archive": [f"{part:06d}-{n - 1:06d}"], "bytes": [len(data)]})

        for b in batches:
            for page, url, html, digest, revisit, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["revisit"], b["refers_to"]):
                payload, own = (html or "").encode("utf-8", "surrogatepass"), "null" if pd.isna(page) else str(int(page))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                uri = " ".join((url or f"urn:page:{own}").split()) or f"urn:page:{own}"
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{own}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
                headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    to = "null" if pd.isna(refers) else str(int(refers))
                    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{to}>")]
                size += w.add(headers, http if revisit else http + payload)
                if size >= archive_bytes:
                    yield flush()
        if w.parts[bool(dictionary) :]:
            yield flush()

    return rows


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    for b in batches:
        for data in b["content"]:
            rows, held = [], 0
            for headers, block in read_archive(data):
                http, payload = _http(block)
                kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
                if kind == "response" and (len(payload) != int(http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
                    raise WarcError(f"a payload that isn't as its header says: {headers['warc-record-id']}")
                refers = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                text = payload.decode("utf-8", "replace") if kind == "response" else None
                rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), int(http["content-length"]), digest, kind, refers, text))
                held += len(payload)
                if held > 8_000_000:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html); returns name and size of each archive.

    Only digests are grouped; the pages themselves are shuffled once, by digest, but for very common payloads, which stay
    where they are. So no page_id, null or repeated, gathers rows.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha2(payload, 256).alias("digest"))
    first = F.min("page_id").alias("first")
    groups = keys.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    groups = materialize(groups.filter((F.col("bytes") >= LEAST_SHARED) & (F.col("n") > 1)).drop("bytes"), "payload_groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    told = hot_left_join(pages.withColumn("digest", F.sha2(payload, 256)), groups, ["digest"], "n", total)
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    records = told.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    written = records.mapInPandas(_write(folder, train_dictionary(pages), archive_bytes), "archive string, bytes long")
    return materialize(written, "archives")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of all archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInPandas(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages to archives and read them back.

    Defined cases: null html is an empty payload, null urls get one from the page_id; a page_id comes first by its value,
    null last; a row with a null page_id is always a response; rows that repeat a page_id are written each,
    as responses where theirs is the first page_id of the payload; an empty table gives no archive and no row; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if write_archives(pages, folder, archive_bytes).isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
    return read_archives(spark, folder)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url", "html")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
