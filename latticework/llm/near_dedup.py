"""[6] MinHash near-dedup with odd sketches.

A document is the set of its word shingles. Documents with the same set form a class (found by a 128-bit fingerprint, merged before the shuffle);
everything else works on one document of each class, so exact copies never meet. MinHash bands put similar sets into common buckets. The samples
also toggle bits of an odd sketch: the number of bits in which two sketches differ estimates a high similarity closely, so that a candidate needs
no look at the sets unless its estimate is near the threshold. A second odd sketch holds the whole set, not samples: the bits in which two of these differ
are never more than the elements in which the sets differ, so it rules pairs out for certain, and sharply as long as sets have some thousand elements at
most. Pairs that are left are confirmed on full sets.

No bucket emits all its pairs. First every member is compared with the bucket's most central one, the one whose buckets have the most members: of
a group of near copies of one text that is as a rule the text itself. Buckets whose members are all linked by then are done. In the others, only
pairs of different components are compared, by their sketches inside the join, and those whose estimate may reach the threshold are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stored, texts

WORDS, PERCENT = 5, 80
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: all but 4e-7 at 0.85, all but 3e-7 at 0.8 (28 bands of 4).
BANDS, ROWS = 28, 4
SKETCH_BITS = 512
#: Of the sketch of whole sets.
WHOLE_BITS = 1024
#: How far below the threshold an estimate may lie: six standard deviations of the sketch and the sample together.
SLACK = 6.0
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CACHE = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words, of the whole sequence; empty without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in found], np.uint64)
    width = min(words, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total += mixed(h[i : i + n] * _ODD[i])
    return np.unique(mixed(total))


def min_hashes(sets: np.ndarray, size: int) -> np.ndarray:
    """The least of the set's elements under each of ``size`` multiplicative permutations of 64 bits."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 2048):
        with np.errstate(over="ignore"):
            np.minimum(out, np.multiply.outer(_ODD[100 : 100 + size], sets[i : i + 2048]).min(1), out=out)
    return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = (mixed(samples).reshape(len(samples), bands, rows) * _ODD[10 : 10 + rows]).sum(2, dtype=np.uint64)
        return mixed(one + np.arange(bands, dtype=np.uint64) * _ODD[9])


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Each sample (with its place) toggles a bit; a row of 64-bit words for each document."""
    n, k = samples.shape
    with np.errstate(over="ignore"):
        at = mixed(samples + np.arange(k, dtype=np.uint64) * _ODD[8]) % np.uint64(bits)
    flat = (np.arange(n, dtype=np.int64)[:, None] * bits + at.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view("<i8")


def whole_sketch(found: np.ndarray, bits: int = WHOLE_BITS) -> np.ndarray:
    """Parity of the elements in each of ``bits`` cells."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def most_differing(threshold: float, size: int, bits: int = SKETCH_BITS, slack: float = SLACK) -> int:
    """Differing bits up to which a pair of that similarity must be confirmed. With s samples that differ, bits/2 (1 - (1 - 2/bits)^(2 s)) bits are expected to."""
    differ = size * (1 - threshold) + slack * np.sqrt(size * threshold * (1 - threshold))
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return int(np.ceil(expected + 1.5 * np.sqrt(expected)))


def sketches(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(k, n, f1, f2, s, b): set size, fingerprint, both odd sketches and band hashes of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    longs = pa.list_(pa.int64())
    schema = pa.schema([("k", to_arrow_type(kind)), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s", longs), ("b", longs)])
    words_of_sketch = (SKETCH_BITS + WHOLE_BITS) // 64

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            size, prints, samples = [], np.zeros((batch.num_rows, 2), np.int64), np.zeros((batch.num_rows, bands * rows), np.uint64)
            whole = np.zeros((batch.num_rows, WHOLE_BITS // 64), np.int64)
            for i, t in enumerate(texts(batch.column(1))):
                found = shingles(t, words, known)
                size.append(len(found))
                prints[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                samples[i], whole[i] = min_hashes(found, bands * rows), whole_sketch(found)
            b, s = band_hashes(samples, bands, rows).view(np.int64), np.concatenate([odd_sketches(samples), whole], 1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, w), pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for x, w in ((s, words_of_sketch), (b, bands))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), *lists], schema=schema)

    return docs.select(key, text).mapInArrow(made, f"k {kind.simpleString()}, n long, f1 long, f2 long, s array<long>, b array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for links (a, b): the smallest node that can be reached.

    Every round takes the least label among a node and its neighbours, then the label's own label, so that chains shorten by half. Sums are made before the
    shuffles, and the joins have a side that may be split where a node has very many links.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        closer = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        there = labels.select(F.col("node").alias("at"), F.col("comp").alias("further"))
        new = cut(closer.join(there, F.col("comp") == F.col("at"), "left").select("node", "was", F.least("comp", "further").alias("comp")))
        moved = new.where("was != comp").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    kind = docs.schema[key].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words, known).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["k", "set"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    full = rows.join(wanted, F.col("k") == F.col("id"), "left_semi").mapInArrow(sets, f"k {kind}, set binary")
    full, _ = stored(full, "sets")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(100 * common >= percent * (len(p) + len(q) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(full.select(F.col("k").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("k").alias("b"), F.col("set").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(compared, f"a {kind}, b {kind}").distinct())


def _near(s: str, t: str, n: str, m: str, percent: int, limit: int) -> Column:
    """May the sets with these sketches and sizes be similar enough? If they are, they differ in at most (100 - percent) / (100 + percent) of their summed sizes."""

    def differ(first: int, last: int) -> Column:
        return sum((F.bit_count(F.get(F.col(s), F.lit(i)).bitwiseXOR(F.get(F.col(t), F.lit(i)))) for i in range(first, last)), F.lit(0))

    sampled, both = SKETCH_BITS // 64, (SKETCH_BITS + WHOLE_BITS) // 64
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ(sampled, both) * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)) & (differ(0, sampled) <= limit)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; ``kept`` for the one whose id is its component's.

    A null or empty text has no shingles and is linked with nothing, and so is a row without an id. Rows that repeat an id count as one document
    with any of their sets. An empty table gives an empty result; other columns aren't read.
    """
    sk, _ = stored(sketches(docs, key, text, words, bands, rows), "sketches")
    usable = sk.where("n > 0 and k is not null")
    classes = cut(usable.groupBy("f1", "f2").agg(F.min("k").alias("rep")))
    info, _ = stored(usable.join(classes, ["f1", "f2"]).where(F.col("k") == F.col("rep")).select("k", "n", "s", "b"), "classes")
    slim = info.select("k", "n", "s")

    members = info.select("k", F.explode("b").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("lo"), F.max("k").alias("hi")).where("m > 1 and lo != hi").select("bucket", "m")
    members, _ = stored(members.join(sizes, "bucket"), "buckets")
    central = members.groupBy("k").agg(F.sum("m").alias("c"))
    ranked = members.join(central, "k")
    pivots = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("c")).alias("c"), "k")).alias("p")).select("bucket", F.col("p.k").alias("p"))
    limit = most_differing(percent / 100, bands * rows)

    def with_sketches(pairs: DataFrame) -> DataFrame:
        one, two = (slim.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
        return pairs.join(one, "a").join(two, "b").where(_near("s_a", "s_b", "n_a", "n_b", percent, limit)).select("a", "b")

    starred = members.join(pivots, "bucket").where("k != p").select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()
    tried = cut(with_sketches(starred))
    links = confirmed(tried, docs, key, text, words, percent)
    comp = components(links)

    placed = members.join(comp, F.col("k") == F.col("node"), "left").select("bucket", "k", F.coalesce("comp", "k").alias("comp"))
    placed = cut(placed)
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    left = placed.join(open_, "bucket", "left_semi").join(slim, "k")
    left, _ = stored(left, "open")
    one = left.select("bucket", F.col("k").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = left.select(F.col("bucket").alias("bucket2"), F.col("k").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    apart = one.join(two, (F.col("bucket") == F.col("bucket2")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near("sa", "sb", "na", "nb", percent, limit))
    more = cut(apart.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        found = confirmed(more, docs, key, text, words, percent)
        if found.limit(1).count():
            comp = components(links.union(found))

    out = sk.select("k", "n", "f1", "f2").join(classes, ["f1", "f2"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    place = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.coalesce("comp", "rep")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), place.alias("component_id"), place.eqNullSafe(F.col("k")).alias("kept"))


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without the rows that aren't kept, with all their columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(key)}"
    gone = similar(inner, at, f"c{names.index(text)}", words, percent, bands, rows).where("not kept").select(F.col(at).alias("_gone")).distinct()
    return inner.join(gone, F.col(at) == F.col("_gone"), "left_anti").toDF(*names)
