"""Token ids as length-delimited binary records, with an offset index.

Documents are sorted by doc_id over the whole output, encoded, and framed:

    length of the payload, 8 bytes | masked checksum of those | payload |
    masked checksum of the payload | a line feed

A payload is one flag byte (1: has a doc_id), the doc_id (8 bytes), the width
of an id (2 or 4 bytes) and the ids; numbers are little-endian. A checksum c is
CRC-32, masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32, so that data
that hold checksums keep good ones. The frames are written by the engine's own
file writer, with its commit protocol, into any store that it can write; the
line feed is the writer's row end and counts as part of the frame. The index
(file, doc_id, offset, length, n_tokens, start, ids_crc32) is made by scanning
the files, and a reader that shuffles seeks by it.

Null texts are empty documents (the end id alone). Rows without a doc_id come
first; rows that share one lie next to each other in the order of their texts,
repeated rows each as a record. Very long texts are encoded whole. Other columns,
whatever their names, are not read. An empty table gives an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import encoder

INDEX = "file string, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record of ``ids`` (little-endian unsigned 32-bit), without its line feed."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes | pa.Buffer) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of every record; a damaged one is an error."""
    at, view = 0, memoryview(data)
    while at < len(view):
        (size,) = struct.unpack_from("<Q", view, at)
        (check,) = struct.unpack_from("<I", view, at + 8)
        if check != masked(view[at : at + 8]):
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + 12 : at + 12 + size]
        (check,) = struct.unpack_from("<I", view, at + 12 + size)
        if check != masked(payload):
            raise ValueError(f"damaged payload at byte {at}")
        known, doc_id, width = struct.unpack_from("<BqB", payload)
        yield at, size + 17, doc_id if known else None, np.frombuffer(payload[10:], f"<u{width}").astype("<u4")
        at += size + 17


def file_count(rows: DataFrame, file_bytes: int) -> int:
    """So many files that each holds about ``file_bytes`` of text."""
    return max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_bytes: int = 32 << 20) -> None:
    """Write all ``docs`` (doc_id, text) under ``path`` in ascending order of doc_id.

    Files are bounded by the input's bytes, and rows of one doc_id are dealt out by how their texts begin, so neither
    a large corpus nor a common doc_id (or none) makes a file grow.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(file_count(rows, file_bytes), F.col("doc_id"), F.substring("text", 1, 32))
    end = int(end_id).to_bytes(4, "little")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = encoder(tokenizer).encode_column(b.column(0), b.column(1))
            while out := [frame(d, ids + end) for d, ids in islice(rows, 500)]:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    framed = map_batches(dealt.sortWithinPartitions("doc_id", "text"), per_batch, "record binary")
    framed.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record of the files under ``path``; ``before``: ids before it in its file."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                out: list[list] = [[] for _ in range(7)]
                total = 0
                for offset, length, doc_id, ids in frames(content.as_buffer()):
                    for column, value in zip(out, (name, doc_id, offset, length, len(ids), total, zlib.crc32(ids.tobytes()))):
                        column.append(value)
                    total += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(out)], [c.split()[0] for c in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_batches(files.select("path", "content"), per_batch, INDEX)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Scan the files once, keep the index as Parquet, and return it with ``start``: ids of all documents before."""
    scan_records(spark, path).write.mode("overwrite").parquet(index_path)
    index = spark.read.schema(INDEX).parquet(index_path)
    # One row a file. Files are numbered in the order of doc_id; the numbers, not the names, are in order.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return index.join(bases, "file").select("file", "doc_id", "offset", "length", "n_tokens", (F.col("_base") + F.col("before")).alias("start"), "ids_crc32")
