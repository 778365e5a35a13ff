"""[8] Exact dedup by Grace hashing.

Texts are equal when they are identical after deleting white space. Each task first merges the copies among the rows that it has at a time, so
that a text with very many copies leaves it once. What is left is dealt by hash; a partition that doesn't fit in memory is divided by further
bits of the hash into spill files in the executor's temporary folder, again and again until each part fits an open-addressing table, which
compares complete contents. The files live no longer than their task; a lost executor's tasks simply run again.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, bounded_batches, code_points, texts

#: Bytes of rows that a table holds before it is compacted and, if that doesn't help, spilled.
MEMORY = 48 << 20
#: Bytes of input among which a task merges copies before the shuffle.
CHUNK = 24 << 20
BITS = 4


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACES)


class OpenTable:
    """Open addressing with linear probing; equal hashes are told apart by complete contents."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, is it new?)"""
        mask = len(self.slots) - 1
        i = h & mask
        while (j := self.slots[i]) >= 0:
            if self.hashes[j] == h and self.contents[j] == content:
                return j, False
            i = (i + 1) & mask
        j = self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for k, x in enumerate(self.hashes):
                i = x & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = k
        return j, True


class Merged:
    """Rows with distinct contents; of equal ones the best, with their number. Columns of a batch: ``_h``, ``_n``, then the rows' own."""

    def __init__(self, key: int, text: int):
        self.key, self.text = key, text
        self.reset()

    def reset(self) -> None:
        self.table, self.best, self.n, self.where, self.batches, self.nbytes = OpenTable(), [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids, rows, at = batch.column(self.key).to_pylist(), texts(batch.column(self.text)), sum(b.num_rows for b in self.batches)
        for i, (h, n, id_, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, rows, strict=True)):
            rank = (-code_points(text), id_ is None, id_, text)
            j, new = self.table.find(h & 0xFFFFFFFFFFFFFFFF, normal(text))
            if new:
                self.best.append(rank)
                self.n.append(n)
                self.where.append(at + i)
            else:
                self.n[j] += n
                if rank < self.best[j]:
                    self.best[j], self.where[j] = rank, at + i
        self.batches.append(batch)
        self.nbytes += batch.nbytes

    def rows(self) -> pa.RecordBatch | None:
        if not self.batches:
            return None
        picked = pa.Table.from_batches(self.batches).take(self.where).combine_chunks().to_batches()[0]
        return picked.set_column(1, "_n", pa.array(self.n, pa.int64()))

    def compact(self) -> None:
        rows = self.rows()
        self.batches, self.where, self.nbytes = [rows], list(range(rows.num_rows)), rows.nbytes


def grace(batches: Iterator[pa.RecordBatch], key: int, text: int, level: int = 0, memory: int = MEMORY) -> Iterator[pa.RecordBatch]:
    """One batch row for each distinct content. ``level``: how often these rows were divided."""
    held, batches = Merged(key, text), iter(batches)
    for batch in batches:
        held.add(batch)
        if held.nbytes > memory:
            held.compact()
            if 2 * held.nbytes > memory and BITS * level < 64:
                break
    else:
        if (rows := held.rows()) is not None:
            yield from (rows.slice(i, 1000) for i in range(0, rows.num_rows, 1000))
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(i)) for i in range(1 << BITS)]
        writers = [pa.ipc.new_stream(p, held.batches[0].schema) for p in paths]

        def spill(batch: pa.RecordBatch) -> None:
            parts = [[] for _ in paths]
            for i, h in enumerate(batch.column(0).to_pylist()):
                parts[(h & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS * (level + 1)) & ((1 << BITS) - 1)].append(i)
            for writer, part in zip(writers, parts, strict=True):
                if part:
                    writer.write_batch(batch.take(pa.array(part)))

        rows = held.batches[0]
        held.reset()
        for i in range(0, rows.num_rows, 1000):
            spill(rows.slice(i, 1000))
        del rows
        for batch in batches:
            spill(batch)
        for writer in writers:
            writer.close()
        for path in paths:
            with pa.ipc.open_stream(path) as stream:
                yield from grace(stream, key, text, level + 1, memory)
            os.remove(path)


def _merge(docs: DataFrame, key: int, text: int, memory: int, chunk: int) -> DataFrame:
    """``docs`` has columns c0, c1, ...; the result also _h and _n before them, a row for each distinct text."""
    bounded_batches(docs.sparkSession)
    made = T.StructType([T.StructField("_h", T.LongType()), T.StructField("_n", T.LongType()), *docs.schema.fields])

    def merge_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Merged(key + 2, text + 2)
        for batch in batches:
            hashes = [xxhash.xxh3_64_intdigest(normal(x)) for x in texts(batch.column(text))]
            signed = pa.array([h - (1 << 64) if h >> 63 else h for h in hashes], pa.int64())
            held.add(pa.RecordBatch.from_arrays([signed, pa.array([1] * batch.num_rows, pa.int64()), *batch.columns], names=["_h", "_n", *batch.schema.names]))
            if held.nbytes > chunk:
                yield held.rows()
                held.reset()
        if (rows := held.rows()) is not None:
            yield rows

    return docs.mapInArrow(merge_chunks, made).repartition("_h").mapInArrow(lambda batches: grace(batches, key + 2, text + 2, 0, memory), made)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", memory: int = MEMORY, chunk: int = CHUNK) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``: the one with the most code points, then the smallest id (null last).

    A null text counts as empty, and all empty texts are a group. Of rows that agree in id and text too, one stays. An empty table gives an
    empty result. Columns may have any names.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return _merge(inner, names.index(key), names.index(text), memory, chunk).drop("_h", "_n").toDF(*names)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", memory: int = MEMORY, chunk: int = CHUNK) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row, dropped ones too.

    ``kept`` holds for each row whose id is the kept one, so for all rows that repeat it (``dedup`` keeps one of them). Groups of one are left
    out of the join that brings the others their answer; its side with the documents has an id and 32 bytes a row and may be split where a
    text is frequent.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    slim = docs.select(F.col(key).alias("c0"), F.col(text).alias("c1"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind)), pa.array([hashlib.sha256(normal(x)).digest() for x in texts(batch.column(1))], pa.binary()), *batch.columns[2:]], names=["c0", "sha", *batch.schema.names[2:]])

    merged = _merge(slim, 0, 1, memory, chunk).where("_n > 1").select("c0", "c1", "_n")
    groups = merged.mapInArrow(keyed, f"c0 {kind.simpleString()}, sha binary, _n long").select(F.col("sha").alias("g"), F.col("c0").alias("keep_id"), F.col("_n"))
    rows = slim.mapInArrow(keyed, f"c0 {kind.simpleString()}, sha binary").join(groups, F.col("sha") == F.col("g"), "left")
    single = F.col("_n").isNull()
    keep = F.when(single, F.col("c0")).otherwise(F.col("keep_id"))
    return rows.select(F.col("c0").alias(key), keep.alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("c0")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
