"""Media columns: texts stored as 8-bit audio in content-defined chunks.

A payload becomes a WAV file of 8-bit samples. A rolling gear hash cuts the file into
chunks; chunk digests are deduplicated by Spark joins, and of each distinct chunk one copy is
stored, compressed, with the media row that owns it. A media row also has its ordered
chunk list, of which chunks that another row owns are fetched by digest when it is read back.
Every chunk and every reassembled file is verified against its digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, sample, with_group

UNIT, HEADER, RATE = 64, 44, 8000
LEAST, MOST, MASK_BITS = 4096, 65536, 13  # bytes of a chunk; 8 KB between cuts beyond LEAST on average
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
LEVEL, DICTIONARY = 15, 1 << 16


def wav(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of UNIT, as 8-bit mono samples."""
    payload = data + bytes(-len(data) % UNIT or (0 if data else UNIT))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32:  # gear hash of the last 32 bytes, doubled from that of the last ``width``
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = (np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist()
    out, at = [], 0
    for m in [*marks, n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or m == n and m > at:
            out.append(m)
            at = m
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def features(payload: bytes) -> str:
    """Sample count, mean, root mean square, peak and zero crossings around the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};mean={x.sum() / len(x):.6f};rms={(x @ x / len(x)) ** 0.5:.6f};peak={int(abs(x).max())};crossings={crossings}"


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, size, media, digests = b.slice(k, 256), [], [], []
                for data in part.column(1).to_pylist():
                    file = wav(data)
                    size.append(len(data)), media.append(hashlib.sha256(file).digest())
                    digests.append([hashlib.sha256(c).digest() for c in chunks(file)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


def dictionary(docs: DataFrame, sample_rows: int = 1000) -> bytes:
    """A compression dictionary, trained on about ``sample_rows`` payloads; empty if they are
    too few."""
    some = sorted(sample(docs, "doc_id", sample_rows).collect(), key=lambda r: (r["doc_id"], bytes(r["data"])))
    try:
        return zstandard.train_dictionary(DICTIONARY, [c for r in some for c in chunks(wav(bytes(r["data"])))]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def _packed(docs: DataFrame, words: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_dict(words))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, media, packed = b.slice(k, 256), [], []
                for data in part.column(1).to_pylist():
                    file = wav(data)
                    media.append(hashlib.sha256(file).digest())
                    packed.append([press.compress(c) for c in chunks(file)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary()), pa.array(packed, pa.list_(pa.binary()))], ["doc_id", "media", "packed"])

    return docs.mapInArrow(run, "doc_id long, media binary, packed array<binary>")


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n_bytes, media; stored: media, whole, owned, refs; the dictionary that chunks
    are compressed with, one row), all written.

    ``owned`` has the chunks that a media row keeps (ord, digest, shared, packed), ``refs`` the
    (ord, digest) of those that another row owns; ``whole``: there are none of these."""
    nobody = F.lit(-1 << 63)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), nobody).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    listed = materialise(_digests(docs), "digests")
    media = materialise(listed.groupBy("media").agg(F.min("doc_id").alias("rep"), F.any_value("digests").alias("digests")), "media")
    each = media.select("media", F.posexplode("digests").alias("ord", "digest"))
    total = media.agg(F.sum(F.size("digests"))).first()[0] or 0
    at = F.struct("media", "ord")
    named = with_group(each, ["digest"], {"owner": F.min(at), "uses": F.count(F.lit(1))}, total)
    plan = named.select("media", F.struct("ord", "digest", (F.col("owner") == at).alias("own"), (F.col("uses") > 1).alias("shared")).alias("c"))
    plan = plan.groupBy("media").agg(F.sort_array(F.collect_list("c")).alias("plan")).join(media.select("media", F.col("rep").alias("doc_id")), "media")
    words = dictionary(docs)
    packed = _packed(docs, words)
    if listed.groupBy("doc_id", "media").count().where("count > 1").limit(1).count():
        packed = packed.dropDuplicates(["doc_id", "media"])  # rows that repeat id and text: a media is stored once
    both = packed.join(plan, ["doc_id", "media"])
    owned = F.transform(F.filter("plan", lambda c: c["own"]), lambda c: F.struct(c["ord"].alias("ord"), c["digest"].alias("digest"), c["shared"].alias("shared"), F.get("packed", c["ord"]).alias("packed")))
    refs = F.transform(F.filter("plan", lambda c: ~c["own"]), lambda c: F.struct(c["ord"].alias("ord"), c["digest"].alias("digest")))
    stored = both.select("media", owned.alias("owned"), refs.alias("refs")).withColumn("whole", F.size("refs") == 0)
    rows = listed.select(F.nullif("doc_id", nobody).alias("doc_id"), "n_bytes", "media")
    kept = docs.sparkSession.createDataFrame([(bytearray(words),)], "dictionary binary")
    stored, kept = materialise(stored, "stored"), materialise(kept, "dictionary")
    release(media)
    return rows, stored, kept


def read_back(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """media, file: every media file, reassembled from its chunk list and verified."""
    words = bytes(kept.first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_dict(words))
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part, files = b.slice(k, 128), []
                for media, owned, fetched in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    pieces = []
                    for c in sorted([*owned, *(fetched or [])], key=lambda c: c["ord"]):
                        pieces.append(unpack.decompress(c["packed"]))
                        if hashlib.sha256(pieces[-1]).digest() != c["digest"]:
                            raise ValueError("a stored chunk differs from its digest")
                    files.append(b"".join(pieces))
                    if hashlib.sha256(files[-1]).digest() != media:
                        raise ValueError("a media file differs from its digest")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["media", "file"])

    own = F.transform("owned", lambda c: F.struct(c["ord"].alias("ord"), c["digest"].alias("digest"), c["packed"].alias("packed")))
    some = stored.where("not whole")
    wanted = some.select("media", F.explode("refs").alias("r")).select("media", "r.ord", "r.digest")
    givers = stored.select(F.explode(F.filter("owned", lambda c: c["shared"])).alias("o")).select("o.digest", "o.packed")
    fetched = wanted.join(givers, "digest").groupBy("media").agg(F.collect_list(F.struct("ord", "digest", "packed")).alias("fetched"))
    parts = some.select("media", own.alias("owned")).join(fetched, "media")
    none = F.array().cast("array<struct<ord:int,digest:binary,packed:binary>>")
    alone = stored.where("whole").select("media", own.alias("owned"), none.alias("fetched"))
    return alone.mapInArrow(run, "media binary, file binary").unionByName(parts.mapInArrow(run, "media binary, file binary"))


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature for every row, computed from the files that are read back.

    Null texts count as empty and have one unit of zero bytes; equal texts share one stored
    file; repeated rows keep a row each; an empty table gives an empty result; other columns are not
    read."""
    rows, stored, words = store(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                file = b.column(1)[k].as_py()
                payload = file[HEADER:]
                out.append((len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-UNIT:]), len(file), features(payload)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    schema = "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"
    seen = materialise(read_back(stored, words).mapInArrow(run, schema), "features")
    release(stored, words)
    hexed = {"media_sha256": F.lower(F.hex("media")), "payload_sha256": F.lower(F.hex("payload_sha256"))}
    out = rows.join(seen, "media").withColumns(hexed)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
