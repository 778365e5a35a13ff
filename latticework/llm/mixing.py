"""[10] Mixing sources to target weights.

Sizes are added up for each source, each source gets a target and from it a repetition rate, and every document is emitted floor(rate) times
plus once more if a seeded hash of its id falls below the fraction. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, numbered

#: Targets stop at this many times a source's size.
MOST = 3
CYCLE = 3
SEED = "mix-1"
#: A table of rates with no more rows than this is broadcast (some MB at most); a longer one is joined by shuffling.
BROADCAST_SOURCES = 10_000


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 32 bits of an MD5."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, target) from a table of sizes by document.

    Sources in order of code points, null last, weigh 1, 2, ..., ``cycle`` and again. The whole is shared by weight; a source whose share is
    above ``most`` times its size is held there, and what is left is shared anew among the others, until none is above. A round is one sum over
    the sources, which stay distributed; there are no more rounds than sources, in practice a few.
    """
    whole = cut(sizes.groupBy(F.col(source).alias("_s")).agg(F.sum(size).alias("_n")))
    ranked = cut(numbered(whole, [F.col("_s").asc_nulls_last()], "_rank", parts=1 if whole.limit(BROADCAST_SOURCES).count() < BROADCAST_SOURCES else None).withColumn("_w", F.col("_rank") % cycle + 1))
    total = ranked.agg(F.sum("_n")).first()[0] or 0
    share, held = 0.0, -1
    above = F.lit(False)
    while True:
        row = ranked.agg(F.count_if(above).alias("k"), F.sum(F.when(above, F.col("_n") * most)).alias("n"), F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        if row["k"] == held or not row["w"]:
            break
        held = row["k"]
        share = (total - (row["n"] or 0)) / row["w"]
        above = F.col("_w") * F.lit(float(share)) >= F.col("_n") * most
    return ranked.select(F.col("_s").alias(source), F.col("_n").alias("source_size"), F.when(above, (F.col("_n") * most).cast("double")).otherwise(F.col("_w") * F.lit(float(share))).alias("target"))


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, sizes: DataFrame | None = None) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies. ``sizes``: (source, size) of the same documents, if they are at hand."""
    found = targets(sizes if sizes is not None else docs.select(F.col(source), word_count(text).alias("size")), source)
    found = cut(found.select(F.col(source).alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return (
        docs.withColumn("_size", word_count(text) if sizes is None else F.col("size"))
        .join(found, F.col(source).eqNullSafe(F.col("_s")), "left")
        .withColumn("_copies", (F.floor(rate) + F.when(chance(key, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))
        .drop("_s")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    A null text has size 0 and a null source is a source of its own, last in order; a source without words has target 0 and is left out.
    Repeated rows share a fate. Runs agree whatever the partitioning. An empty table gives an empty result.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # columns with any names, also those used here
    at = {n: f"c{i}" for i, n in enumerate(names)}
    out = with_copies(inner, at[key], at[text], at[source], seed)
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_copies"), F.lit(1))))).where("_copies > 0").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(key, size, source_size, target, taken) for every row: ``taken`` is the words the mixture takes of it, repeats counted."""
    sizes = cut(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), word_count(text).alias("size")))
    out = with_copies(sizes, "k", "size", "s", seed, sizes.select("s", "size"))
    return out.select(F.col("k").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
