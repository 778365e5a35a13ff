"""[9] Best-fit packing by patterns and non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. All that the plan needs of the corpus is how many pieces have each length, a histogram
of ``capacity`` numbers. Patterns of few lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded; the residue is packed best fit, longest first, again by counts, so that a pattern stands for any number of
sequences. Then every piece gets its place by its rank among the pieces of its length. Ranks are counted within salted groups,
so that a very common length is no single group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut
from .fast_ids import token_ids
from .token_count import vocabulary_path

CAPACITY = 1024
#: Ends each document.
END_ID = 2
#: Pieces in a salted group, about.
GROUP_ROWS = 5_000
#: Patterns that the least squares weigh at most.
MOST_PATTERNS = 20_000


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens; if they don't all have full length, the first is the short one."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))] if n else []


def enumerate_patterns(histogram: np.ndarray, capacity: int = CAPACITY, most: int = MOST_PATTERNS) -> np.ndarray:
    """Rows of up to four lengths, padded with 0, that fill a sequence exactly; only lengths that occur.

    All pairs; then triples and quadruples with the most frequent lengths in front, until there are ``most``.
    """
    there = histogram > 0
    lengths = np.flatnonzero(there)
    lengths = lengths[lengths > 0]
    rows: list[tuple[int, ...]] = [(int(a), capacity - int(a)) for a in lengths if 2 * a >= capacity and a < capacity and there[capacity - a]]
    common = sorted(lengths.tolist(), key=lambda x: (-histogram[x], x))[:150]
    seen = set(rows)
    for depth in (3, 4):
        for i, a in enumerate(common):
            for b in common[i:]:
                if depth == 3:
                    made = [(a, b, capacity - a - b)]
                else:
                    c = (capacity - a - b) // 2
                    made = [(a, b, c - d, capacity - a - b - c + d) for d in range(0, 40, 8)]
                for row in made:
                    if min(row) > 0 and all(there[x] for x in row):
                        row = tuple(sorted(row, reverse=True))
                        if row not in seen:
                            seen.add(row)
                            rows.append(row)
                if len(rows) >= most:
                    break
            if len(rows) >= most:
                break
    return np.array([row + (0,) * (4 - len(row)) for row in rows], np.int64).reshape(-1, 4)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares for (patterns' lengths) x = histogram, by multiplicative updates: x stays above 0 and the error never grows."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    target = histogram.astype(float)
    up = (target[patterns] * used).sum(1)
    x = np.full(len(patterns), target.sum() / (4.0 * len(patterns)) + 1e-9)
    for _ in range(rounds):
        made = np.zeros(len(histogram))
        np.add.at(made, patterns[used], np.broadcast_to(x[:, None], patterns.shape)[used])
        x *= up / np.maximum((made[patterns] * used).sum(1), 1e-12)
    return x


#: After so many steps of the rounding up, the residue is packed to see how far it should go.
ROUNDING_STEPS = 24


def thinned(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and fitted counts. A least-squares solution needs no more patterns than there are lengths, so the fit goes on with the weightiest until it has no more."""
    patterns = enumerate_patterns(histogram, capacity)
    x = fit_counts(patterns, histogram)
    for times in (4, 2, 1):
        most = times * int((histogram > 0).sum())
        if len(patterns) > most:
            patterns = patterns[np.sort(np.argsort(-x, kind="stable")[:most])]
            x = fit_counts(patterns, histogram)
    return patterns, x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)], using each length exactly as often as the histogram says.

    The fitted counts of the patterns are rounded down. Then patterns get one more sequence each as long as the pieces are there, those with the longest
    piece first, as it has the fewest ways to be completed, and of these those that lost most by rounding. Sequences of patterns are full, but in the end
    they take short pieces that long ones of the residue need; so the residue is packed best fit after some steps each, and the rounding up goes as
    far as gives the fewest sequences, of equal ones the farthest.
    """
    left = np.array(histogram, np.int64).copy()
    left[0] = 0
    full, left[capacity] = int(left[capacity]), 0
    patterns, x = thinned(left, capacity)
    counts = np.floor(x + 1e-9).astype(np.int64)
    planned = np.zeros(len(patterns), np.int64)

    def take(i: int, n: int) -> None:
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        planned[i] += n
        left[lengths] -= n * times

    for i in np.argsort(-counts, kind="stable"):
        take(i, int(counts[i]))
    best, fewest = None, None
    for some in [[], *np.array_split(np.lexsort((counts - x, -patterns.max(1, initial=0))), ROUNDING_STEPS)]:
        for i in some:
            take(i, 1)
        rest = best_fit(left, capacity)
        n = int(planned.sum()) + sum(k for _, k in rest)
        if fewest is None or n <= fewest:
            best, fewest = (planned.copy(), rest), n
    made = [(tuple(int(v) for v in row if v), int(n)) for row, n in zip(patterns, best[0], strict=True) if n]
    return ([((capacity,), full)] if full else []) + made + best[1]


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of counted lengths: each goes to the open sequences with the least room that holds it."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(r: int, row: tuple[int, ...], n: int) -> None:
        if r not in room:
            room[r] = []
            insort(rooms, r)
        room[r].append((row, n))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(n, capacity // length)
                made = n // each
                put(capacity - each * length, (length,) * each, made)
                n -= made * each
                continue
            r = rooms[i]
            row, there = room[r].pop()
            if not room[r]:
                del room[r]
                rooms.pop(i)
            used = min(n, there)
            n -= used
            put(r - length, (*row, length), used)
            if there > used:
                put(r, row, there - used)
    return [x for r in sorted(room) for x in room[r]]


class Places:
    """From (length, rank) to (sequence, offset). Its size is that of the plan: some thousand patterns, whatever the number of pieces."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        spans: dict[int, list[tuple[int, int, int]]] = {}  # for each length: first rank, first sequence, offset
        ranks: dict[int, int] = {}
        self.sequences = 0
        for row, n in made:
            offset = 0
            for length in row:
                at = ranks.get(length, 0)
                spans.setdefault(length, []).append((at, self.sequences, offset))
                ranks[length] = at + n
                offset += length
            self.sequences += n
        self.spans = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in spans.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            first, base, place = self.spans[int(length)]
            at = np.flatnonzero(lengths == length)
            i = np.searchsorted(first, ranks[at], "right") - 1
            sequence[at], offset[at] = base[i] + ranks[at] - first[i], place[i]
        return sequence, offset


_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, with_ids: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = pa.schema([("k", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(t or "", path), np.uint32(END_ID)).astype("<u4").tobytes()
                for i, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, x in zip(columns, (k, i, start, length, zlib.crc32(part), part), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(key, text).mapInArrow(made, f"k {kind.simpleString()}, {_PIECE}" + ", ids binary" * with_ids)


def ranked(rows: DataFrame, group: str, order: list[Column], total: int) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... within each value of ``group``, in no stated order, but the same in each run.

    A value's rows are dealt into salted groups of some thousand; ranks within one are shifted by the sizes of those before it.
    """
    salts = max(1, -(-total // GROUP_ROWS))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_within", within).join(starts, (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_s"))).withColumn("rank", F.col("_within") + F.col("_before")).drop("_salt", "_within", "_g", "_s", "_before")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece.

    A null or empty text is a document of the end id alone. Rows that repeat are packed each; a null id stays null. An empty table gives an
    empty result. Texts are tokenized once; the pieces are checkpointed, without ids unless these are asked for.
    """
    path = path or vocabulary_path()
    cutted = cut(pieces(docs, key, text, path, capacity, with_ids))
    found = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in found.items():
        histogram[length] = n
    places = Places(plan(histogram, capacity))
    rows = ranked(cutted, "length", [F.col("k"), F.col("piece"), F.col("ids_crc32")], int(histogram.sum()))
    wanted = T.StructType([*(f for f in rows.schema.fields if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("rank")
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    out = rows.mapInArrow(placed, wanted)
    return out.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
