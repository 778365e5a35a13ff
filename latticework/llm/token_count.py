"""[3] Token counts of whole texts, huge ones by overlap resynchronisation.

A huge document is encoded in chunks that overlap, with offsets. Two neighbouring chunks are spliced at a position where both have a token
boundary and where the boundary is proven: a blank after a letter, a digit or a sign. The pattern that splits text before the merges has no
alternative that goes on from such a character to a blank, and it looks neither back nor, past a run of blanks, ahead; so in the whole text a
token also ends there, and what comes later doesn't depend on what came earlier. Where an overlap holds no such position, it is widened, at
last to the end of the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_batch, quiet_tokenizers

CHUNK, OVERLAP = 1 << 15, 256
#: Characters that one call of the library gets; its results take some hundred bytes a token.
CALL_CHARS = 1 << 18
VOCABULARY = "byte_bpe_50k.json"
_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Where ``stable`` may hold.
_MAYBE = re.compile(r"(?<=[\w!-/:-@\[-`{-~])[ \n\t\r]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's own reading of the file, once a Python worker."""
    quiet_tokenizers()
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def stable(text: str, p: int) -> bool:
    """Is there a token boundary at ``p`` whatever surrounds it?"""
    return text[p] in " \n\t\r" and (text[p - 1].isalnum() or text[p - 1] in _SIGNS)


class Resynchroniser:
    """Encodes texts longer than ``chunk`` characters piece by piece."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.path, self.chunk, self.overlap, self.widened = path, max(1, chunk), max(1, overlap), 0

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """(ids, places in the whole text where the tokens start)"""
        made = load_tokenizer(self.path).encode(text[start:end], add_special_tokens=False)
        return made.ids, [start + a for a, _ in made.offsets]

    def pieces(self, text: str):
        """The ids of the whole text, in runs."""
        n, end = len(text), self.chunk
        ids, starts = self._encode(text, 0, min(n, end + self.overlap))
        covered, overlap, begin = min(n, end + self.overlap), self.overlap, 0
        while covered < n:
            right_end = min(n, end + self.chunk + overlap)
            right, right_starts = self._encode(text, end, right_end)
            common = set(starts).intersection(right_starts)
            at = min((p for p in common if end < p < covered and stable(text, p)), default=None)
            if at is None:  # widen: the left chunk goes on further, to twice the overlap and beyond the next place that may be stable
                self.widened += 1
                there = next((m.start() for m in _MAYBE.finditer(text, covered) if stable(text, m.start())), n)
                overlap = max(2 * overlap, there + 2 - end)
                covered = min(n, end + overlap)
                ids, starts = self._encode(text, begin, covered)
                continue
            yield ids[: _first(starts, at)]
            keep = _first(right_starts, at)
            ids, starts, begin = right[keep:], right_starts[keep:], at
            end, covered, overlap = end + self.chunk, right_end, self.overlap
        yield ids

    def ids(self, text: str) -> list[int]:
        return [x for run in self.pieces(text) for x in run] if len(text) > self.chunk else load_tokenizer(self.path).encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) if len(text) > self.chunk else len(load_tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def counts(self, some: list[str]) -> list[int]:
        """Counts of many texts; short ones go to the library together."""
        out, group, size = [0] * len(some), [], 0

        def flush() -> None:
            for i, made in zip(group, load_tokenizer(self.path).encode_batch_fast([some[i] for i in group], add_special_tokens=False), strict=True):
                out[i] = len(made.ids)
            group.clear()

        for i, text in enumerate(some):
            if len(text) > self.chunk:
                out[i] = self.count(text)
            else:
                group.append(i)
                size += len(text)
                if size > CALL_CHARS:
                    flush()
                    size = 0
        flush()
        return out


def _first(starts: list[int], at: int) -> int:
    """Index of the first token that starts at ``at`` or later."""
    from bisect import bisect_left

    return bisect_left(starts, at)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives an empty result; other columns aren't
    read. ``path``: the vocabulary file, at the same place on every machine.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind, path = docs.schema[key].dataType, path or vocabulary_path()
    schema = pa.schema([(key, to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counted(batch: pa.RecordBatch) -> dict[str, object]:
        some = [x or "" for x in batch.column(1).to_pylist()]
        n = Resynchroniser(path, chunk, overlap).counts(some)
        return {key: batch.column(0), "n_bytes": [len(x.encode()) for x in some], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return docs.select(key, text).mapInArrow(by_batch(counted, schema), f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
