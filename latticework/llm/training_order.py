"""[7] Token ids in training order, as fixed-stride binary shards.

Every document's ids (and an end id) are cut into sequences. The sequences of the corpus are numbered 0 to n - 1, and a keyed Feistel
permutation with cycle-walking gives each a global slot: no shuffled list of numbers exists anywhere, and a slot can be computed again from the
number alone. Rows go to the shard that holds their slot, are sorted there and written one after the other. All records have one size, so that a
reader finds any slot by arithmetic and can go on wherever it stopped.

Beside each shard lies a note of what it was made from: a fingerprint of the corpus, its numbering and the settings, and the checksum of its bytes. It
is written last and removed first, so a shard with a note of the same fingerprint is complete, and isn't written again; any other is.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, stored
from .fast_ids import token_ids
from .token_count import vocabulary_path

LENGTH = 256
END_ID = 2
KEY = 20_240_229
#: Sequences in a shard: 16 MB of 256 ids of two bytes. A corpus of many TB wants more.
SHARD = 1 << 15
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed mixing of 64 bits."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(_MIX[0]) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = 6):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = [int(_round(np.array([key + i], np.uint64), key * 31 + i)[0]) for i in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_round(right, key) & mask)
        return (right << half) | left  # the halves change places: the same with the keys turned round leads back

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (far := out >= np.uint64(self.n)).any():  # beyond n: go on along the cycle; the domain is less than 4 n + 4
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def sequences(text: str | None, path: str, length: int) -> list[np.ndarray]:
    ids = np.append(token_ids(text or "", path), np.uint32(END_ID))
    return [ids[i : i + length] for i in range(0, len(ids), length)]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def note_name(shard: int) -> str:
    return f"shard-{shard:08d}.json"


def _note(store, path: str) -> dict:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return {}
    with store.open_input_file(path) as f:
        return json.loads(f.read())


class ShardWriter:
    """Writes the shards of one task, each to a draft that takes its name when it is complete."""

    def __init__(self, folder: str, fingerprint: str, attempt: int):
        self.store, self.root = _open(folder)
        self.store.create_dir(self.root, recursive=True)
        self.fingerprint, self.attempt, self.file, self.shard = fingerprint, attempt, None, None

    def start(self, shard: int, size: int) -> None:
        self.finish()
        self.shard, self.want, self.size, self.crc = shard, size, 0, 0
        self.draft = f"{self.root}/.{shard_name(shard)}.{self.attempt}"
        there = _note(self.store, f"{self.root}/{note_name(shard)}")
        done = there.get("fingerprint") == self.fingerprint and self.store.get_file_info(f"{self.root}/{shard_name(shard)}").size == there["bytes"]
        self.file = None if done else self.store.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        if self.file is not None and data:
            self.file.write(data)
            self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)

    def finish(self) -> None:
        if self.file is None:
            return
        self.file.close()
        self.file = None
        if self.size != self.want:
            raise RuntimeError(f"{shard_name(self.shard)} has {self.size} bytes of {self.want}")
        from pyarrow import fs

        note = f"{self.root}/{note_name(self.shard)}"
        if self.store.get_file_info(note).type == fs.FileType.File:
            self.store.delete_file(note)
        self.store.move(self.draft, f"{self.root}/{shard_name(self.shard)}")
        with self.store.open_output_stream(f"{self.draft}.note") as f:
            f.write(json.dumps({"fingerprint": self.fingerprint, "bytes": self.size, "crc32": self.crc}).encode())
        self.store.move(f"{self.draft}.note", note)


def without_drafts(folder: str) -> None:
    """Remove what attempts that failed left behind."""
    from pyarrow import fs

    store, root = _open(folder)
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith(".shard-"):
            store.delete_file(found.path)


def read_slots(folder: str, first: int, n: int, length: int = LENGTH, per_shard: int = SHARD, wide: bool = False) -> list[np.ndarray]:
    """The sequences in slots ``first`` to ``first + n - 1``, read in order."""
    store, root = _open(folder)
    kind = np.dtype("<u4" if wide else "<u2")
    stride, out = kind.itemsize * (length + 1), []
    while n > 0:
        shard, at = divmod(first, per_shard)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * stride)
            some = np.frombuffer(f.read(min(n, per_shard - at) * stride), kind).reshape(-1, length + 1)
        if not len(some):
            break
        out += [row[1 : 1 + int(row[0])] for row in some]
        first, n = first + len(some), n - len(some)
    return out


def materialise(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, seed: int = KEY, per_shard: int = SHARD, wide: bool = False) -> DataFrame:
    """Writes the shards; (key, piece, length, ids_crc32, slot, shard, byte_offset) for every sequence.

    A record is the number of ids and then ``length`` ids (two bytes each, four if ``wide``), padded with 0. Another call with the same
    ``folder`` and input writes only what is missing; without ``folder`` the shards go to a new one in the shared folder. A null or empty text is a sequence of the
    end id alone; rows that repeat are written each. An empty table writes nothing. An id that needs more than the two bytes is an error; ``length`` has to fit too.

    Texts are read and tokenized twice: first for the number of sequences and a checksum of each input partition (two numbers for each reach the driver), then
    for the sequences: keeping the ids in between would take more disk than the check allows. Within a partition rows are sorted, so that a task
    that runs again numbers them as before, and one that finds another number than the first reading fails instead of leaving slots open. The order hangs on the
    key and on how the input is split, both of which the fingerprint covers.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, path, kind = docs.sparkSession, path or vocabulary_path(), docs.schema[key].dataType
    bounded_batches(spark)
    type_ = np.dtype("<u4" if wide else "<u2")
    if length > np.iinfo(type_).max:
        raise ValueError(f"a record's length must fit into {type_.itemsize} bytes")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mark = 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(t or "", path)
                n += -(-(len(ids) + 1) // length)
                mark = (mark + xxhash.xxh3_64_intdigest(ids.tobytes(), xxhash.xxh3_64_intdigest(repr(k)))) % (1 << 63)  # whatever the order of the rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "mark": pa.array([mark], pa.int64())})

    parts = sorted(tuple(r) for r in rows.mapInArrow(counted, "part int, n long, mark long").collect())
    counts, starts, total = {p: n for p, n, _ in parts}, {}, 0
    for part, n, _ in parts:
        starts[part], total = total, total + n
    settings = [os.path.basename(path), length, seed, per_shard, wide, END_ID]
    fingerprint = xxhash.xxh3_128_hexdigest(json.dumps([settings, [list(p) for p in parts if p[1]]]))
    folder = folder or scratch(spark, "shards")
    order = Feistel(max(1, total), seed)
    made = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("k", to_arrow_type(kind)), ("piece", pa.int32()), ("ids", pa.binary())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = starts.get(part, 0)
        for batch in batches:
            keys, piece, ids = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, x in enumerate(sequences(t, path, length)):
                    if not wide and int(x.max()) > 0xFFFF:
                        raise ValueError("an id needs more than two bytes: pass wide=True")
                    keys.append(k)
                    piece.append(i)
                    ids.append(x.astype(type_).tobytes())
            slots = order.slots(np.arange(number, number + len(keys), dtype=np.uint64)) if keys else np.zeros(0, np.int64)
            number += len(keys)
            columns = [(slots // per_shard).astype(np.int32), slots, keys, piece, ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)
        if number != starts.get(part, 0) + counts.get(part, 0):
            raise RuntimeError("the input changed between its two readings")

    out_schema = pa.schema([("k", to_arrow_type(kind)), ("piece", pa.int32()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64())])
    stride = type_.itemsize * (length + 1)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder, fingerprint, TaskContext.get().taskAttemptId())
        for batch in batches:
            blocks: list[bytes] = []
            n, crc, offsets = [], [], []
            for s, slot, ids in zip(batch.column("shard").to_pylist(), batch.column("slot").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != writer.shard:
                    writer.write(b"".join(blocks))
                    blocks.clear()
                    writer.start(s, min(per_shard, total - s * per_shard) * stride)
                n.append(len(ids) // type_.itemsize)
                crc.append(zlib.crc32(np.frombuffer(ids, type_).astype("<u4").tobytes()))
                offsets.append((slot % per_shard) * stride)
                blocks.append(n[-1].to_bytes(type_.itemsize, "little") + ids.ljust(stride - type_.itemsize, b"\0"))
            writer.write(b"".join(blocks))
            columns = [batch.column("k"), batch.column("piece"), n, crc, batch.column("slot"), batch.column("shard"), offsets]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)
        writer.finish()

    shards = max(1, -(-total // per_shard))
    dealt = rows.sortWithinPartitions("k", F.xxhash64("t")).mapInArrow(numbered, f"shard int, slot long, k {kind.simpleString()}, piece int, ids binary")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    # stored, so that the shards are whole when this returns, however much of the result is read
    out, _ = stored(dealt.mapInArrow(written, f"k {kind.simpleString()}, piece int, length long, ids_crc32 long, slot long, shard int, byte_offset long"), "slots")
    without_drafts(folder)
    return out.withColumnRenamed("k", key)
