"""[4] Quality rules as weak supervision.

Each rule votes for a text (+1), against it (-1) or abstains (0). How often each rule is right isn't given but estimated: expectation-
maximisation over the counts of all vote patterns of the corpus (there are at most 3 to the power of the number of rules, however many
documents), with a latent class for every pattern. The posterior probability of the good class decides, instead of all-must-pass: votes for a
text can outweigh an objection, by as much as the estimate trusts the rules that cast them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, code_points, stored, texts

SYMBOLS = b"#*$%&|<>"
#: A word of letters with inner hyphens and apostrophes, between ordinary marks.
_PLAIN = re.compile(rb"[\"'(\xc2\xab]*[A-Za-z\x80-\xff]+(?:['-][A-Za-z\x80-\xff]+)*[.,;:!?)\"'\xbb]*").fullmatch
_SYMBOL = re.compile(rb"[#*$%&|<>]").search
_NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_FROM = 0.5

# Frequent short words of the four languages.
STOP_WORDS = frozenset("""
the of and to in is that it for was on are as with his they at be this from or had by but not what all were we when
le la les de des du un une et est en que qui dans pour par sur au aux avec ce il elle ne pas plus son se ou
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las del y en un una por con no su para al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre
""".encode().split())


def measures(text: bytes) -> dict[str, int]:
    """Counts of one whole text; see the op's contract in the README. All are 0 for an empty one."""
    words = text.split()
    n = len(words)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen: dict[tuple[bytes, ...], int] = {}
            twice = np.zeros(len(windows), bool)
            for i, w in enumerate(windows):
                j = seen.setdefault(w, i)
                if j != i:
                    twice[i] = twice[j] = True
            covered = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            repeated = int((np.cumsum(covered)[:n] > 0).sum())
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACES)]
    bare = text.translate(None, SPACES)
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    return {
        "n_words": n,
        "word_chars": code_points(bare),
        "n_symbols": symbols,
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "n_lines": len(lines),
        "n_stop": sum(map(STOP_WORDS.__contains__, map(bytes.lower, words))),
        "n_upper": len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_distinct": len(set(words)),
        "n_shouts": bare.count(b"!!"),
        "n_letters": code_points(bare.translate(None, _NO_LETTERS)),
        "n_symbol_words": sum(1 for w in words if _SYMBOL(w)) if symbols else 0,
        "n_plain": sum(1 for w in words if _PLAIN(w)),
        "n_ends": len(bare) - len(bare.translate(None, b".!?")),
    }


def base_failed(m: dict[str, int]) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def _low(value: float, good: float, bad: float) -> int:
    """+1 up to ``good``, -1 from ``bad`` on, else 0 (``good`` < ``bad``)."""
    return 1 if value <= good else -1 if value >= bad else 0


def _within(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """+1 inside ``good``, -1 outside ``bad``, else 0 (``bad`` holds ``good``)."""
    return 1 if good[0] <= value <= good[1] else -1 if not bad[0] <= value <= bad[1] else 0


#: Name, the fewest words to say anything at, and the vote; n: words, c: characters in words. All but the last vote either way.
RULES = (
    ("symbols", 1, lambda m, n, c: _low(m["n_symbols"] / n, 0.03, 0.15)),
    ("words with symbols", 10, lambda m, n, c: _low(m["n_symbol_words"] / n, 0.05, 0.3)),
    ("stop words", 20, lambda m, n, c: _low(-m["n_stop"] / n, -0.08, -0.03)),
    ("letters", 10, lambda m, n, c: _low(-m["n_letters"] / c, -0.9, -0.75)),
    ("plain words", 10, lambda m, n, c: _low(-m["n_plain"] / n, -0.85, -0.6)),
    ("word length", 10, lambda m, n, c: _within(c / n, (3, 9), (2, 14))),
    ("capitals", 10, lambda m, n, c: _low(m["n_upper"] / c, 0.15, 0.5)),
    ("sentences", 40, lambda m, n, c: _within(n / (m["n_ends"] + 1), (3, 40), (1.5, 80))),
    ("repeated windows", 10, lambda m, n, c: _low(m["n_repeat_words"] / n, 0.02, 0.15)),
    ("repeated lines", 20, lambda m, n, c: _low(m["n_dup_lines"] / max(4, m["n_lines"]), 0.1, 0.4)),
    ("distinct words", 20, lambda m, n, c: _low(-m["n_distinct"] / n**0.9, -0.3, -0.1)),
    ("shouts", 10, lambda m, n, c: -1 if 5 * m["n_shouts"] > n else 0),
)


def votes(m: dict[str, int]) -> tuple[int, ...]:
    n, c = m["n_words"], max(1, m["word_chars"])
    return tuple(rule(m, n, c) if n >= least else 0 for _, least, rule in RULES)


def pattern_code(v: tuple[int, ...]) -> int:
    """The votes as a number in base 3."""
    code = 0
    for x in v:
        code = 3 * code + x + 1
    return code


def pattern_votes(code: int) -> tuple[int, ...]:
    out = []
    for _ in RULES:
        code, x = divmod(code, 3)
        out.append(x - 1)
    return tuple(out[::-1])


#: The beta priors: how often a rule that votes objects to a bad text and to a good one, as one would guess, worth so many votes each; and the share of good texts.
OBJECTS = (0.7, 0.08)
GOOD_SHARE, WORTH = 0.8, 10.0


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation. patterns: a row of votes for each pattern, counts: how many texts show it.

    Returns the posterior probability of the good class for each pattern, how often each rule that votes objects to a text of the bad and the good
    class (2 x rules), and the share of good texts. An abstention says nothing. Nothing holds a rule to be right: one whose objections fall on good
    texts as often as on bad ones ends with equal chances in both classes and weighs nothing, and one that is wrong more often than right is
    counted the other way round. The priors name the classes, as the start, and keep chances off 0 and 1.
    """
    against, favour, total = (patterns < 0).astype(float), (patterns > 0).astype(float), counts.sum()
    guess = np.array(OBJECTS)[:, None]
    objects, prior = np.repeat(guess, patterns.shape[1], 1), GOOD_SHARE
    post = np.full(len(counts), prior)
    for _ in range(rounds):
        log = np.log(objects) @ against.T + np.log1p(-objects) @ favour.T + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        weight = np.stack([(1 - post) * counts, post * counts])
        no, yes = weight @ against, weight @ favour
        objects = (no + WORTH * guess) / (no + yes + WORTH)
        prior = float((weight[1].sum() + WORTH * GOOD_SHARE) / (total + WORTH))
        if done:
            break
    return post, objects, prior


class Verdicts:
    """Posterior of every pattern of a corpus."""

    def __init__(self, counts: dict[int, int]):
        codes = sorted(counts)
        patterns = np.array([pattern_votes(c) for c in codes], int).reshape(len(codes), len(RULES))
        post, self.objects, self.prior = estimate(patterns, np.array([counts[c] for c in codes], float))
        self.posterior = dict(zip(codes, post.tolist(), strict=True))

    def __getitem__(self, code: int) -> float:
        return self.posterior.get(code, self.prior)


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch], at: int, kept: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` of each batch, the five counts, whether the base rule fails, and the code of the votes of the text in column ``at``."""
    kinds = [pa.int64()] * len(_BASE) + [pa.bool_(), pa.int64()]
    for batch in batches:
        ms = [measures(x) for x in texts(batch.column(at))]
        made = [*([m[x] for m in ms] for x in _BASE), [base_failed(m) for m in ms], [pattern_code(votes(m)) for m in ms]]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(c, t) for c, t in zip(made, kinds, strict=True))], names=names)


def measured(rows: DataFrame, text: str, kept: list[str], name: str) -> DataFrame:
    """``kept`` columns of ``rows`` with the five counts, base_failed and code, computed once and stored in the shared folder."""
    bounded_batches(rows.sparkSession)
    at, places, names = rows.columns.index(text), [rows.columns.index(c) for c in kept], [*kept, *_BASE, "base_failed", "code"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{x} long" for x in _BASE] + ["base_failed boolean", "code long"])
    return stored(rows.mapInArrow(lambda batches: _measured(batches, at, places, names), schema), name)[0]


def fit(rows: DataFrame) -> Verdicts:
    """From what ``measured`` gave of all texts that pass the base rule, as the posterior decides on these. What reaches the driver is a count for each
    pattern that occurs. An empty table, or one where no text passes, gives the prior."""
    return Verdicts({r["code"]: r["n"] for r in rows.where("not base_failed").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()})


def with_quality(rows: DataFrame, found: Verdicts, keep_from: float) -> DataFrame:
    """Adds quality (the posterior probability) and kept. What is broadcast are the patterns, 3 to the power of the number of rules (531,441) at most."""
    known = rows.sparkSession.createDataFrame(list(found.posterior.items()) or [(-1, found.prior)], "_code long, _quality double")
    quality = F.coalesce("_quality", F.lit(found.prior))
    joined = rows.join(F.broadcast(known), F.col("code") == F.col("_code"), "left")
    return joined.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from)).drop("_code", "_quality")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """(key, five counts, base_failed, kept, quality) for every row; quality is the posterior probability.

    Null and empty texts have counts of 0 and fail the base rule. Repeated rows are judged alike; a null key stays null; an empty table gives an empty
    result; other columns aren't read. Texts are read once; their counts are stored in the shared folder.
    """
    rows = measured(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", ["k"], "quality")
    return with_quality(rows, fit(rows), keep_from).select(F.col("k").alias(key), *_BASE, "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns, whatever these are called. A null or empty text doesn't pass."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = measured(inner, f"c{names.index(text)}", inner.columns, "quality-rows")
    return with_quality(rows, fit(rows), keep_from).where("kept").select(*inner.columns).toDF(*names)
