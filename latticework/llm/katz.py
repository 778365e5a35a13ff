"""[5] Language-model scores by Katz backoff.

An n-gram's Good-Turing discounted probability is used where the n-gram was seen; else the model backs off to the n-gram without its first word, times a
weight of the history that makes all probabilities after it add up to one exactly, and so on down to the word's own discounted probability; a word
that wasn't seen has what the seen ones leave.

Counts are kept in tables dealt by hash. Sending every token's question to them would move each n-gram of the corpus several times with its document's
id; instead a task reads documents up to a number of tokens (a block), asks for each distinct n-gram of the block once, and gets the answers in
the order of its questions, so that they need no keys:

1. blocks: each document as numbers of the block's own vocabulary (kept), and the distinct n-grams with their training counts (asked);
2. tables of counts: total of every n-gram, back to each block that asked; one of the blocks is told that it owns the n-gram. The counts of counts
   add up to a few numbers, from which the discounts follow;
3. blocks: hits and misses, and for each history the parts of its backoff weight from the n-grams that the block owns. A history that
   no other block has needs nobody else;
4. tables of backoff weights, back to the blocks that ask;
5. blocks: the scores.

A block sends to ``FANOUT`` places at most. Where the tables have more parts, these places are nodes that merge what as many blocks ask and send
on in their turn; answers go back the same way. So the rows that are written grow as the blocks do, at every size.

What is kept between the steps is written to the shared folder, so that a lost executor costs its tasks alone.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, discard, shuffle_partitions, stored, texts

FOLDS, HELD_OUT = 5, 1
#: Words of a history and the word it leads to. Three score better, but take more disk than the check allows (figures in the README).
ORDER = 2
#: Tokens of a block, and of the corpus for each part of the tables.
BLOCK_TOKENS = 1_000_000
#: Parts that a block, or a node on the way, sends to. A corpus with more parts is dealt in several hops, so that what is sent grows with the corpus alone.
FANOUT = 256
#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
#: No word has these names, as they are white space.
END, START = b"\n", b" "
#: Kinds of rows: a block, what a block keeps, counts of n-grams of length k (k), weights of histories of length k (WEIGHT + k), and answers to both (ANSWER more).
PLAN, STATE, WEIGHT, ANSWER = 0, -1, 100, 1000
_KEY_BYTES = 6
#: Masses and logarithms of weights travel as whole numbers of these parts of one: they squeeze well, and their sums don't hang on the order.
MASS, LOG = 2.0**48, 2.0**34
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def squeeze(x: np.ndarray) -> bytes:
    """Numbers, compressed a byte plane at a time."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n: list[int], most: int = MOST_DISCOUNTED) -> np.ndarray:
    """Katz's factors for counts 1 .. most (index 0 unused) from n[r], the number of events counted r times. With too little data fewer counts are discounted."""
    for k in range(min(most, len(n) - 2), 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            tail = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail != 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d])
    return np.array([1.0])


class Model:
    """The few numbers that hold for the whole corpus."""

    def __init__(self, counts: list[list[int]], tokens: int, vocabulary: int):
        """counts: for each length of n-grams, how many were seen r times."""
        self.order, self.tokens, self.vocabulary = len(counts), tokens, vocabulary
        self.factors = [discounts(c) for c in counts]
        self.rest = 1 / (tokens + 1)  # every distribution leaves at least this to the unseen
        kept = tokens - sum(r * counts[0][r] * (1 - self.factors[0][r]) for r in range(1, len(self.factors[0])))
        self.unknown = 1 - (1 - self.rest) * kept / tokens if tokens else 1.0

    def _factor(self, length: int, c: np.ndarray) -> np.ndarray:
        table = self.factors[length - 1]
        return np.where(c < len(table), table[np.minimum(c, len(table) - 1)], 1.0)

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of words by their counts."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, (1 - self.rest) * self._factor(1, c) * c / self.tokens, self.unknown)

    def seen(self, length: int, c: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Probability of n-grams that were seen c times after a history that was seen ``history`` times."""
        return (1 - self.rest) * self._factor(length, c) * c / np.maximum(history, 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))


class Grams:
    """The distinct n-grams of one length in a block. ``ids``: the one that ends at each token; ``first``: the n-gram without its last word, ``shorter``: without its
    first, both as numbers among those one shorter; ``start``: the one made of starts alone, which is the history of a document's first word."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, shorter: np.ndarray, marks: np.ndarray, start: int):
        self.ids, self.first, self.shorter, self.marks, self.start = ids, first, shorter, marks, start

    def __len__(self) -> int:
        return len(self.marks)

    @classmethod
    def longer(cls, short: Grams, words: Grams, starts: np.ndarray) -> Grams:
        before = np.empty_like(short.ids)
        before[1:] = short.ids[:-1]
        before[starts] = short.start
        size = len(words)
        found, at = np.unique(np.append(before * size + words.ids, short.start * size + words.start), return_inverse=True)
        first, last = found // size, found % size
        shorter = np.zeros(len(found), np.int64)
        shorter[at] = np.append(short.ids, short.start)
        with np.errstate(over="ignore"):
            marks = mixed(short.marks[first] * _C[0] + mixed(words.marks[last] * _C[1]))
        return cls(at[:-1], first, shorter, marks, int(at[-1]))


def start_mark(length: int) -> np.uint64:
    """Of the n-gram made of starts alone."""
    word = np.array([xxhash.xxh3_64_intdigest(START)], np.uint64)
    mark = word
    for _ in range(length - 1):
        with np.errstate(over="ignore"):
            mark = mixed(mark * _C[0] + mixed(word * _C[1]))
    return mark[0]


def place(marks: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a hash: equal ranges of its upper half."""
    return (((marks >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def hops(parts: int) -> list[int]:
    """How many places there are at each hop, the parts of the tables last. Every hop multiplies them by about the same."""
    n = next(n for n in count(1) if FANOUT**n >= parts)
    each = next(f for f in count(1) if f**n >= parts)
    return [*(each**i for i in range(1, n)), parts]


class Block:
    """Documents as numbers. Word 0 is the end, word 1 the start; ``lengths`` are tokens with the end."""

    def __init__(self, keys: list, held: np.ndarray, lengths: np.ndarray, current: np.ndarray, hashes: np.ndarray, order: int):
        self.keys, self.held, self.lengths, self.current, self.hashes, self.order = keys, held, lengths, current, hashes, order
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        words = Grams(current.astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), hashes, 1)
        self.grams = [words]
        for _ in range(order - 1):
            self.grams.append(Grams.longer(self.grams[-1], words, starts))
        self.document = np.repeat(np.arange(len(lengths)), lengths)

    def pack(self) -> bytes:
        return pickle.dumps((self.keys, squeeze(self.held), squeeze(self.lengths), squeeze(self.current.astype(np.int32)), squeeze(self.hashes), self.order))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        keys, held, lengths, current, hashes, order = pickle.loads(data)
        return cls(keys, unsqueeze(held, "?"), unsqueeze(lengths, "<i8"), unsqueeze(current, "<i4"), unsqueeze(hashes, "<u8"), order)

    def counts(self) -> list[np.ndarray]:
        """Training counts. A history of starts alone counts the training documents."""
        learn, out = ~self.held[self.document], []
        for g in self.grams:
            c = np.bincount(g.ids[learn], minlength=len(g))
            c[g.start] = (~self.held).sum()
            out.append(c)
        return out


def split(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, ascending places that have it)"""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    values, starts = np.unique(where[order], return_index=True)
    for v, at in zip(values, np.split(order, starts[1:]), strict=True):
        yield int(v), at


def scatter(size: int, where: np.ndarray, answers: dict[int, bytes], kind: str) -> np.ndarray:
    """Answers by part, back in the order of what was asked."""
    out = np.zeros(size, kind)
    for part, at in split(where):
        if part in answers:
            out[at] = unsqueeze(answers[part], kind)
    return out


_ROW = "block string, part long, data binary, counts binary, kind int"
_SCHEMA = pa.schema([("block", pa.string()), ("part", pa.int64()), ("data", pa.binary()), ("counts", pa.binary()), ("kind", pa.int32())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)


def _listed(table: pa.Table, *columns: str) -> list[tuple]:
    return list(zip(*[table.column(c).to_pylist() for c in columns], strict=True))


def _asked(name: str, kind: int, marks: np.ndarray, values: np.ndarray, parts: int, short: bool) -> Iterator[tuple]:
    """A row for each part: the hashes, and a row of values for each."""
    raw = marks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BYTES if short else 8]
    for part, at in split(place(marks, parts)):
        yield name, part, np.ascontiguousarray(raw[at]).tobytes(), squeeze(np.ascontiguousarray(values[:, at]).ravel()), kind


def _blocks(size: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[bool] = []
        lengths: list[int] = []
        numbers: dict[bytes, int] = {END: 0, START: 1}
        current: list[int] = []
        partition, flushed = TaskContext.get().partitionId(), count()

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
            data = pickle.dumps((list(keys), squeeze(np.array(held, bool)), squeeze(np.array(lengths, np.int64)), squeeze(np.array(current, np.int32)), squeeze(hashes), order))
            # blocks of the same content have names of their own; they are stored before a name is used, so a rerun does no harm
            yield from _rows([(f"{xxhash.xxh3_128_hexdigest(data)}-{partition}-{next(flushed)}", -1, data, b"", PLAN)]).to_batches()
            for x in (keys, held, lengths, current):
                x.clear()
            numbers.clear()
            numbers.update({END: 0, START: 1})

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = text.lower().split()
                current += [numbers.setdefault(w, len(numbers)) for w in words]
                current.append(0)
                keys.append(k)
                held.append(crc_mod(k, FOLDS) == HELD_OUT)
                lengths.append(len(words) + 1)
                if len(current) >= size:
                    yield from flush()
        if keys:
            yield from flush()

    return run


def _questions(length: int, parts: int, short: bool):
    """For the counts of n-grams of one length, from the blocks that are kept: the same each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                block = Block.unpack(data)
                rows = list(_asked(name, length, block.grams[length - 1].marks, block.counts()[length - 1][None].astype("<i8"), parts, short))
                yield from _rows(rows).to_batches(max_chunksize=64)

    return run


_COUNTS = MOST_DISCOUNTED + 2


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_COUNTS + 2, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total += np.frombuffer(data, "<i8")
    yield pa.RecordBatch.from_pydict({"data": pa.array([total.tobytes()], pa.binary())})


class Asked:
    """The questions that meet in one place, in a stable order, and their distinct hashes."""

    def __init__(self, rows: list[tuple[str, int, bytes, bytes]], kind: int):
        self.rows, self.kind, self.weigh = sorted(rows), kind, kind >= WEIGHT
        columns = 2 if self.weigh else 1
        width = len(rows[0][2]) * columns // len(unsqueeze(rows[0][3], "<i8"))  # bytes of a hash
        raw = np.frombuffer(b"".join(r[2] for r in self.rows), np.uint8).reshape(-1, width)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, :width] = raw
        self.sizes = [len(r[2]) // width for r in self.rows]
        self.found, self.entry = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        self.values = np.concatenate([unsqueeze(r[3], "<i8").reshape(-1, n) for r, n in zip(self.rows, self.sizes, strict=True)], 1)
        self.sums = np.stack([np.bincount(self.entry, v, len(self.found)) for v in self.values]).astype(np.int64)  # exact up to 2 to the 53

    def answers(self, of_found: np.ndarray) -> pa.Table:
        """A row for each question, from the answer for each hash. Of those who have counts of an n-gram, the first gets the mark of its owner (1); who alone has it, even
        in texts that are held out, gets the mark of that (2)."""
        out = of_found[self.entry]
        if not self.weigh:
            trained = np.flatnonzero(self.values[0])
            marks = 2 * (np.bincount(self.entry, minlength=len(self.found)) == 1)[self.entry]
            marks[trained[np.unique(self.entry[trained], return_index=True)[1]]] += 1
            out = (out & ~3) | (out & marks)
        made, at = [], 0
        for (block, part, _, _), n in zip(self.rows, self.sizes, strict=True):
            made.append((block, part, squeeze(out[at : at + n].astype("<i8")), b"", self.kind + ANSWER))
            at += n
        return _rows(made)


def _met(table: pa.Table) -> Asked:
    return Asked(_listed(table, "block", "part", "data", "counts"), table.column("kind")[0].as_py())


def log_weights(masses: np.ndarray) -> np.ndarray:
    """Backoff weights, from the masses of what was seen after a history: by its own probabilities, and by those it would have after backing off."""
    seen, lower = masses / MASS
    return np.rint(np.log10(np.maximum(1 - seen, 1e-300) / np.maximum(1 - lower, 1e-300)) * LOG).astype(np.int64)


def _totals(table: pa.Table) -> pa.Table:
    """Answers of one part of the tables: for counts the total (times 4) with both marks, and the counts of counts in a row without block; for weights their logarithm."""
    met = _met(table)
    if met.weigh:
        return met.answers(log_weights(met.sums))
    total, start = met.sums[0], start_mark(met.kind)
    same = met.found == (start if len(met.rows[0][2]) == 8 * met.sizes[0] else start & np.uint64((1 << 8 * _KEY_BYTES) - 1))
    real = total[~same]
    summary = np.append(np.bincount(np.minimum(real, _COUNTS), minlength=_COUNTS + 1)[:_COUNTS], [real.sum(), (real > 0).sum()])
    return pa.concat_tables([met.answers(total * 4 + 3), _rows([("", met.rows[0][1], summary.astype("<i8").tobytes(), b"", met.kind + ANSWER)])])


def _merged(parts: int):
    """A node's questions: the distinct ones of those that reach it, to the places of the next hop."""

    def run(table: pa.Table) -> pa.Table:
        met = _met(table)
        return _rows(list(_asked(table.column("node")[0].as_py(), met.kind, met.found, met.sums.astype("<i8"), parts, False)))

    return run


def _returned(parts: int):
    """A node's answers to those who asked it."""

    def run(table: pa.Table) -> pa.Table:
        rows = _listed(table, "block", "part", "data", "counts", "kind")
        asked = [r for r in rows if r[4] < ANSWER]
        met = Asked([r[:4] for r in asked], asked[0][4])
        got = {part: data for _, part, data, _, kind in rows if kind >= ANSWER}
        return met.answers(scatter(len(met.found), place(met.found, parts), got, "<i8"))

    return run


def exchange(questions: DataFrame, sources: int, places: list[int], made: list[str]) -> DataFrame:
    """Answers to all questions (rows without block: counts of counts). ``places``: of every hop; ``made`` gets the paths of what is stored on the way."""
    if len(places) == 1:
        return questions.groupBy("kind", "part").applyInArrow(_totals, _ROW)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        made.append(path)
        return df

    questions = kept(questions, "asked")
    groups = -(-sources // places[0])  # so many merge in a node that it has as much to send as each of them
    at = questions.withColumn("node", F.concat_ws("-", "kind", "part", F.pmod(F.xxhash64("block"), F.lit(groups))))
    below = kept(exchange(at.groupBy("node").applyInArrow(_merged(places[1]), _ROW), groups, places[1:], made), "answers")
    answers = below.where("block != ''").withColumn("node", F.col("block"))
    return at.unionByName(answers).groupBy("node").applyInArrow(_returned(places[1]), _ROW).unionByName(below.where("block = ''"))


def _hits(model: Model, parts: int, short: bool):
    """Step 3: from a block and its counts, what its documents have without backoff weights, and the questions for these."""

    def run(table: pa.Table) -> pa.Table:
        block, answers, name = None, {k: {} for k in range(1, model.order + 1)}, table.column("block")[0].as_py()
        for kind, part, data in _listed(table, "kind", "part", "data"):
            if kind == PLAN:
                block = Block.unpack(data)
            else:
                answers[kind - ANSWER][part] = data
        known = [scatter(len(g), place(g.marks, parts), answers[k], "<i8") for k, g in enumerate(block.grams, 1)]
        own, total, n = [x & 1 for x in known], [x >> 2 for x in known], len(block.lengths)
        direct = [model.word(total[0])]  # what each n-gram has of its own, 0 if it wasn't seen
        hits, local, out = [], [], []
        for k in range(2, model.order + 1):
            g, history = block.grams[k - 1], block.grams[k - 2]
            p = model.seen(k, total[k - 1], total[k - 2][g.first])
            direct.append(p)
            mine = own[k - 1] > 0
            mine[g.start] = False
            masses = np.stack([np.bincount(g.first[mine], np.rint(x[mine] * MASS), len(history)) for x in (p, direct[k - 2][g.shorter])]).astype("<i8")
            alone = (known[k - 2] & 2) > 0  # a history that only this block has has all its continuations here, and nobody else asks
            missed = np.zeros(len(history), bool)
            missed[g.first[total[k - 1] == 0]] = True
            asked = np.flatnonzero(~alone & (missed | (masses[0] > 0)))
            out += _asked(name, WEIGHT + k - 1, history.marks[asked], masses[:, asked], parts, short)
            outside = np.zeros(len(history), bool)
            outside[asked] = True
            hits.append(total[k - 1] > 0)
            local.append((np.packbits(outside), squeeze(log_weights(masses[:, ~outside & missed])), np.packbits(missed)))
        # down from the longest: the first that was seen gives its own probability
        level, at, score = model.order, np.arange(len(block.current)), np.zeros(n)
        while level > 1:
            found = hits[level - 2][block.grams[level - 1].ids[at]]
            score += np.bincount(block.document[at[found]], np.log10(direct[level - 1][block.grams[level - 1].ids[at[found]]]), n)
            at, level = at[~found], level - 1
        score += np.bincount(block.document[at], np.log10(direct[0][block.current[at]]), n)
        state = {
            "known": np.bincount(block.document, total[0][block.current] > 0, n).astype(np.int64), "base": np.bincount(block.document, model.base(total[0])[block.current], n),
            "score": score, "hits": [np.packbits(h) for h in hits], "local": local,
        }
        out.append((name, -1, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(state)), b"", STATE))
        return _rows(out)

    return run


def _finish(schema: pa.Schema, tokens: int, parts: int):
    """Step 5: the backoff weights of all misses, added to what ``_hits`` kept."""

    def run(table: pa.Table) -> pa.Table:
        block, state, answers = None, {}, {}
        for kind, part, data in _listed(table, "kind", "part", "data"):
            if kind == PLAN:
                block = Block.unpack(data)
            elif kind == STATE:
                state = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
            else:
                answers.setdefault(kind - ANSWER - WEIGHT, {})[part] = data
        total, at, n = state["score"], np.arange(len(block.current)), len(block.lengths)
        for k in range(block.order, 1, -1):
            g, history = block.grams[k - 1], block.grams[k - 2]
            outside, own, missed = state["local"][k - 2]
            asked, missed = np.unpackbits(outside, count=len(history)).astype(bool), np.unpackbits(missed, count=len(history)).astype(bool)
            weight = np.zeros(len(history))
            weight[~asked & missed] = unsqueeze(own, "<i8") / LOG
            where = np.flatnonzero(asked)
            weight[where] = scatter(len(where), place(history.marks[where], parts), answers.get(k - 1, {}), "<i8") / LOG
            seen = np.unpackbits(state["hits"][k - 2], count=len(g)).astype(bool)
            at = at[~seen[g.ids[at]]]
            total = total + np.bincount(block.document[at], weight[g.first[g.ids[at]]], n)
        columns = [block.keys, block.held, block.lengths, state["known"], np.full(n, tokens), state["base"], total]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null or empty text is its end alone. Rows that repeat are scored each, and counted each if they aren't held out. Without training texts every token is
    unknown and has probability 1. An empty table gives an empty result; other columns aren't read.

    Words and n-grams are told apart by hashes: words by 64 bits, n-grams by their part of the table and 48 bits (64 where there are several hops). With a
    million tokens for each part, about one n-gram in a hundred million is taken for another.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema[key].dataType
    bounded_batches(spark)  # also of blocks, which are rows of some MB
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(chars / 6 / block_tokens))
    places, made = hops(parts), []
    short, first = len(places) == 1, places[0]

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        made.append(path)
        return df

    plans, plans_path = stored(docs.select(key, text).mapInArrow(_blocks(block_tokens, order), _ROW), "blocks")
    blocks = plans.count()
    # one length after the other: the shuffle of each goes when its answers are stored
    counts = [kept(exchange(plans.mapInArrow(_questions(k, first, short and k > 1), _ROW), blocks, places, made), f"counts-{k}") for k in range(1, order + 1)]
    sums = [np.zeros(_COUNTS + 2, np.int64) for _ in counts]
    for total, table in zip(sums, counts, strict=True):
        for r in table.where("block = ''").select("data").mapInArrow(_summed, "data binary").collect():  # a few numbers from each task
            total += np.frombuffer(bytes(r["data"]), "<i8")
    model = Model([x[:_COUNTS].tolist() for x in sums], int(sums[0][-2]), int(sums[0][-1]))

    whole = plans
    for table in counts:
        whole = whole.unionByName(table.where("block != ''"))
    held, held_path = stored(whole.groupBy("block").applyInArrow(_hits(model, first, short), _ROW), "hits", by="kind")
    for path in made:
        discard(spark, path)
    made.clear()
    answered = plans.unionByName(held.where(F.col("kind") == STATE).select(*_SCHEMA.names))
    for k in range(order - 1, 0, -1):  # one length after the other, as with the counts
        answered = answered.unionByName(kept(exchange(held.where(F.col("kind") == WEIGHT + k).select(*_SCHEMA.names), blocks, places, made), f"weights-{k}"))
        discard(spark, f"{held_path}/kind={WEIGHT + k}")
    schema = pa.schema([(key, to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out, _ = stored(answered.groupBy("block").applyInArrow(_finish(schema, model.tokens, first), f"`{key}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    for path in (*made, plans_path, held_path):
        discard(spark, path)
    return out
