"""[1] URL filter: all rules at once, as multiword Shift-And automata.

A rule is a host and the beginning of a path (``example.net/en/``); it fits that host and all its subdomains. A glob is a host pattern, and
after a slash perhaps a path pattern; ``*`` in a host stands for any characters of the host, in a path for any characters. Every element of
every pattern is one bit of a row of 64-bit words. Reading a character shifts the bits of a URL's row and masks them with that character's
row, for a whole Arrow batch of URLs at a time; a bit that is left on at a pattern's last element says that the pattern fits.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_batch, texts

#: Stands between host and path; no UTF-8 text has this byte.
EDGE = 0xFF
#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Where no rule fits: hosts with these names are blocked.
GLOBS = ("*spam-farm.*", "*cheap-pills.*", "*casino*", "*free-downloads.*", "*/*sessionid=*")
CELLS = 4_000_000

_PARTS = re.compile(rb"^.*?://([^/?#]*)([^?#]*)", re.S)


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """(host, path); both empty where there is no ``://``."""
    found = _PARTS.match(url)
    return (found[1].lower(), found[2]) if found else (b"", b"")


class Automaton:
    """The patterns' masks. ``first`` and ``last``: the bits of each pattern's start and of its last element."""

    def __init__(self, patterns: Sequence[tuple[bytes, bytes | None]]):
        """patterns: (host pattern, path pattern or None for any path). In either, ``*`` stands for any run of characters."""
        bits, enter, stay = 0, [], []  # for each bit: the byte that leads into it, the bytes that keep it
        self.first, self.last = [], []
        host_bytes, any_byte = [b for b in range(256) if b != EDGE], list(range(256))
        for host, path in patterns:
            self.first.append(bits)
            enter.append(None)
            stay.append([])
            for b in host:
                if b == ord("*"):
                    stay[-1] = host_bytes
                else:
                    enter.append(b)
                    stay.append([])
            enter.append(EDGE)
            stay.append([])
            for b in b"*" if path is None else path:
                if b == ord("*"):
                    stay[-1] = any_byte
                else:
                    enter.append(b)
                    stay.append([])
            bits = len(enter)
            self.last.append(bits - 1)
        words = max(1, -(-bits // 64))
        self.into, self.keep, self.start = (np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64))
        for i in range(bits):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if enter[i] is not None:
                self.into[enter[i], word] |= bit
            for b in stay[i]:
                self.keep[b, word] |= bit
        for i in self.first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def matches(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row for each URL (host, EDGE, path), a column for each pattern: does it fit?"""
        out = np.zeros((len(urls), len(self.first)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        at = 0
        while at < len(order):  # rows of like length together: a very long URL doesn't widen the others
            some = order[at : at + max(1, CELLS // max(1, len(urls[order[at]])))]
            at += len(some)
            out[some] = self._run([urls[i] for i in some])
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        cells = np.zeros((len(urls), lengths[0]), np.uint8)
        for i, u in enumerate(urls):
            cells[i, : len(u)] = np.frombuffer(u, np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(lengths[0]):
            n = int(np.searchsorted(-lengths, -t, "left"))  # the rows that have a character t
            now, c = state[:n], cells[:n, t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.into[c]) | (now & self.keep[c])
        last = np.array(self.last)
        return (state[:, last // 64] >> (last % 64).astype(np.uint64) & one).astype(bool)


class UrlJudge:
    """Rules by precedence (longer text first, then the earlier one), then globs."""

    def __init__(self, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS):
        self.rules = sorted(rules, key=lambda r: -len(r[0]))
        patterns: list[tuple[bytes, bytes | None]] = []
        for rule, _ in self.rules:
            host, slash, path = rule.encode().partition(b"/")
            patterns += [(host.lower(), slash + path + b"*"), (b"*." + host.lower(), slash + path + b"*")]
        for glob in globs:
            host, slash, path = glob.encode().partition(b"/")
            patterns.append((host.lower(), slash + path + b"*" if slash else None))
        self.automaton = Automaton(patterns)

    def __call__(self, urls: Sequence[bytes]) -> tuple[list[bytes], list[bytes], list[str | None], list[str]]:
        hosts, paths = zip(*map(split_url, urls), strict=True) if urls else ((), ())
        hit = self.automaton.matches([h + bytes([EDGE]) + p for h, p in zip(hosts, paths, strict=True)])
        n = len(self.rules)
        fits = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
        best = np.where(fits.any(1), fits.argmax(1), -1) if n else np.full(len(urls), -1)
        bad = hit[:, 2 * n :].any(1)
        rules = [self.rules[b][0] if b >= 0 else None for b in best]
        verdicts = [self.rules[b][1] if b >= 0 else ("block" if x else "allow") for b, x in zip(best, bad, strict=True)]
        return list(hosts), list(paths), rules, verdicts


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, and is allowed unless a glob fits the empty host. Rows that
    repeat are judged each; an empty table gives an empty result; columns other than ``key`` and ``url`` aren't read.
    """
    bounded_batches(pages.sparkSession)
    judge, kind = UrlJudge(rules, globs), pages.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(key, to_arrow_type(kind))] + [(x, pa.string()) for x in ("host", "path", "rule", "verdict")])

    def judged(batch: pa.RecordBatch) -> dict[str, object]:
        host, path, rule, verdict = judge(texts(batch.column(1)))
        return {key: batch.column(0), "host": pa.array(host, pa.binary()), "path": pa.array(path, pa.binary()), "rule": rule, "verdict": verdict}

    return pages.select(key, url).mapInArrow(by_batch(judged, schema), f"`{key}` {kind.simpleString()}, host string, path string, rule string, verdict string")
