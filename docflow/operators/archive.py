"""Indexed archive containers for millions of tiny files (problem 4).

A container is two tables. Its blocks are rows of about `block_bytes`: the original bytes of many files behind one
another as payload, with the path, offset, length and checksum of each. Its aliases are the files whose record another
file already holds: their own path, length and checksum, and the id of the stored file. Every file with a body is in one
of the two, so any path is looked up, and any stored file restored byte for byte, without the originals.

What is kept and what isn't. Every record is stored once, by its file with the smallest id. Of a copy the place of its
record is kept, and with its own checksum whether its bytes were the stored ones; another notation of the same boxes is
not kept, as the same record would then be stored twice.

Scale: digests are computed in one pass and written as ids and 16 bytes a file, and copies found by a partial aggregate on
them and one join, whose skew AQE can split. Bodies move once, by file_id. A task streams through Arrow buffers with one
open block, cut at block_bytes or BLOCK_FILES files, so its memory is a few blocks; it leaves one short block at most,
and has BLOCKS_A_TASK full ones on average. Aliases are rows, so a record with a third of all files makes no wide row.

Defined results. Null body: the file is no record, no copy and in no container. Empty body or a body without boxes: a
record of its key without boxes. Null key: compared as a key of its own kind (null equals null). Rows that repeat a
file_id are one file, the first by path. Empty table: no blocks and no aliases. Extra columns are ignored. A body
longer than block_bytes fills a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import nfd
from docflow.session import materialise, pick, spread

BLOCK_BYTES = 128 << 20
#: Files of a block at most: its entries take about 100 bytes each.
BLOCK_FILES = 1 << 20
#: Blocks that the files of a task fill, on average.
BLOCKS_A_TASK = 8


@dataclass(frozen=True)
class Container:
    blocks: DataFrame
    aliases: DataFrame


def canonical_boxes(body: Column) -> Column:
    """The boxes of a label body as a sorted array of lines in one notation: numbers by value, any order, any white space."""
    lines = F.split(F.regexp_replace(body, "﻿", ""), r"[\r\n]+")
    tokens = lambda line: F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    number = lambda t: F.coalesce((F.expr("0.0D") + t.try_cast("double")).cast("string"), t)
    return F.array_sort(F.transform(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""), lambda x: F.array_join(F.transform(tokens(x), number), " ")))


def digests(files: DataFrame) -> DataFrame:
    """file_id, record (16 bytes of the digest of key and boxes) of each file with a body, written once."""
    files = spread(pick(files, "file_id", "unique_key", "body"))
    digest = F.sha2(F.to_json(F.struct(nfd(F.col("unique_key")).alias("k"), canonical_boxes(F.col("body")).alias("b"))), 256)
    return materialise(files.where("body is not null").select("file_id", F.unhex(F.substring(digest, 1, 32)).alias("record")), "digests")


def _firsts(keyed: DataFrame) -> DataFrame:
    """record, stored_id: the smallest file_id of each record."""
    return keyed.groupBy("record").agg(F.min("file_id").alias("stored_id"))


def record_index(files: DataFrame) -> DataFrame:
    """file_id, record and stored_id, the smallest file_id of the record, for each file with a body."""
    keyed = digests(files)
    return keyed.join(_firsts(keyed), "record").select("file_id", "record", "stored_id")


def copies(index: DataFrame) -> DataFrame:
    """Files of the index whose bytes are not stored, because a file with a smaller id holds the same record."""
    return index.where("stored_id < file_id").select("file_id")


BLOCK_SCHEMA = "block_id long, n_files long, n_bytes long, crc32 long, file_ids array<long>, file_paths array<string>, offsets array<long>, lengths array<long>, crc32s array<long>, payload binary"


def _first_of_equal(ids: np.ndarray, before: int | None) -> np.ndarray:
    """Which of ascending ids differ from the one before."""
    return np.r_[before is None or ids[:1] != before, ids[1:] != ids[:-1]].astype(bool) if len(ids) else np.zeros(0, bool)


def _bytes_of(column: pa.Array) -> pa.Buffer:
    """The bytes of a binary array's rows behind one another, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    data = column.buffers()[2]
    return data.slice(int(offsets[0]), int(offsets[1] - offsets[0])) if data is not None else pa.py_buffer(b"")


def _block(block_id: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks() if len(held) > 1 else pa.Table.from_batches(held)
    payload = b"".join(_bytes_of(b.column("bytes")) for b in held)
    lengths = np.concatenate([pc.binary_length(b.column("bytes")).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
    whole = pa.array([0, len(lengths)], pa.int32())
    entry = lambda values: pa.ListArray.from_arrays(whole, values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    one = lambda value: pa.array([value], pa.int64())
    columns = [one(block_id), one(len(lengths)), one(len(payload)), one(zlib.crc32(payload)), entry(table["file_id"].cast(pa.int64())), entry(table["file_path"]), entry(pa.array(np.cumsum(lengths) - lengths)), entry(pa.array(lengths)), entry(table["crc32"])]
    return pa.RecordBatch.from_arrays([*columns, pa.array([payload], pa.binary())], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def _pack(block_bytes: int, block_files: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = count = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("file_id").to_numpy(zero_copy_only=False)
            fresh, last = _first_of_equal(ids, last), ids[-1]
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
            ends = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(ends):
                room = block_bytes - size + (ends[low - 1] if low else 0)
                high = min(int(np.searchsorted(ends, room, side="right")), low + block_files - count)
                if high <= low and not held:
                    high = low + 1
                if high > low:
                    held.append(batch.slice(low, high - low))
                    size, count = size + int(ends[high - 1] - (ends[low - 1] if low else 0)), count + high - low
                if high <= low or size >= block_bytes or count >= block_files:
                    yield _block(part << 32 | number, held)
                    held, size, count, number = [], 0, 0, number + 1
                low = max(low, high)
        if held:
            yield _block(part << 32 | number, held)

    return pack


def pack(files: DataFrame, block_bytes: int = BLOCK_BYTES, block_files: int = BLOCK_FILES, tasks: int | None = None) -> Container:
    """The container of a listing of files (file_id, file_path, unique_key, body). Blocks and aliases are lazy; write() keeps them."""
    keyed = digests(files)
    files = pick(files, "file_id", "file_path", "body").where("body is not null").select("file_id", "file_path", F.encode("body", "UTF-8").alias("bytes"))
    tasks = tasks or (files.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // (block_bytes * BLOCKS_A_TASK) + 1
    stored = _firsts(keyed).select(F.col("stored_id").alias("file_id")).distinct()
    # Both sides by the same hash and number, so that the join moves neither again.
    rows = files.repartition(tasks, "file_id").join(stored.repartition(tasks, "file_id"), "file_id").select("file_id", "file_path", F.crc32("bytes").alias("crc32"), "bytes")
    blocks = rows.sortWithinPartitions("file_id", "file_path").mapInArrow(_pack(block_bytes, block_files), BLOCK_SCHEMA)
    other = files.select("file_id", "file_path", F.octet_length("bytes").cast("long").alias("length"), F.crc32("bytes").alias("crc32"))
    aliases = other.join(keyed.join(_firsts(keyed), "record").where("stored_id < file_id").select("file_id", "stored_id").distinct(), "file_id").groupBy("file_id", "stored_id").agg(F.min(F.struct("file_path", "length", "crc32")).alias("f"))
    return Container(blocks, aliases.select("file_id", "f.file_path", "stored_id", "f.length", "f.crc32"))


def write(container: Container, path: str) -> Container:
    """Writes both tables of a container below path and reads them back."""
    container.blocks.write.parquet(f"{path}/blocks")
    container.aliases.write.parquet(f"{path}/aliases")
    return read(container.blocks.sparkSession, path)


def read(spark: SparkSession, path: str) -> Container:
    return Container(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/aliases"))


def index_of(blocks: DataFrame) -> DataFrame:
    """file_id, file_path, block_id, offset, length, crc32 of every stored file."""
    entries = F.arrays_zip("file_ids", "file_paths", "offsets", "lengths", "crc32s")
    rows = blocks.select("block_id", F.explode(entries).alias("e"))
    return rows.select(F.col("e.file_ids").alias("file_id"), F.col("e.file_paths").alias("file_path"), "block_id", F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("length"), F.col("e.crc32s").alias("crc32"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of each block as slices of its payload, which isn't copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, paths, sums, lengths = (batch.column(c).slice(i, 1).flatten() for c in ("file_ids", "file_paths", "crc32s", "lengths"))
            payload = batch.column("payload")
            offsets = np.r_[0, np.cumsum(lengths.to_numpy(zero_copy_only=False))].astype(np.int32)
            bodies = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), _bytes_of(payload.slice(i, 1))])
            yield pa.RecordBatch.from_arrays([ids, paths, bodies, sums], names=["file_id", "file_path", "bytes", "crc32"])


def restore(blocks: DataFrame) -> DataFrame:
    """file_id, file_path, bytes and whether the checksum holds, read in parallel by block."""
    cut = blocks.select("file_ids", "file_paths", "lengths", "crc32s", "payload").mapInArrow(_unpack, "file_id long, file_path string, bytes binary, crc32 long")
    return cut.select("file_id", "file_path", "bytes", (F.crc32("bytes") == F.col("crc32")).alias("intact"))


def lookup(blocks: DataFrame, file_ids: list[int]) -> DataFrame:
    """The stored bytes of some files; payloads of blocks without any of them are not sliced."""
    wanted = F.exists("file_ids", lambda e: e.isin(file_ids))
    return restore(blocks.where(wanted)).where(F.col("file_id").isin(file_ids))


def resolve(container: Container) -> DataFrame:
    """Every file of the container with the place of its record, from the container alone.

    file_id, file_path, length, crc32 (its own), stored_id, block_id, offset, stored_length, stored_crc32 (of the bytes at the place).
    """
    stored = index_of(container.blocks)
    own = stored.select("file_id", "file_path", "length", "crc32", F.col("file_id").alias("stored_id"), "block_id", "offset", F.col("length").alias("stored_length"), F.col("crc32").alias("stored_crc32"))
    place = stored.select(F.col("file_id").alias("stored_id"), "block_id", "offset", F.col("length").alias("stored_length"), F.col("crc32").alias("stored_crc32"))
    return own.unionByName(container.aliases.join(place, "stored_id"))


def packed_copies(container: Container) -> DataFrame:
    """Files of the container whose bytes are not stored, because a file with a smaller id, found in its block, holds the same record."""
    return resolve(container).where("stored_id < file_id").select("file_id")


__all__ = ["BLOCK_BYTES", "Container", "canonical_boxes", "copies", "index_of", "lookup", "pack", "packed_copies", "read", "record_index", "resolve", "restore", "write"]
