"""A sealed log of decisions: hash chain, consent rules, replay."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .ordering import numbered

# What is hashed, in order; the link of the first event.
SEALED = ("id", "ts", "actor", "role", "org", "verb", "object", "pair", "note", "code", "source", "prev")
GENESIS = "0" * 64
ROLES = ("registrar", "reviewer", "requester", "auditor")


def canonical(fields: tuple[str, ...] = SEALED, **columns: Column) -> Column:
    """The exact text that is hashed: a JSON array without blanks, null for what is missing, everything else as text."""
    return F.to_json(F.array(*[(columns[f] if f in columns else F.col(f)).cast("string") for f in fields]))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _chained(log: str, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds batches that come in the order of their logs; what is carried from row to row is the log and its last hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), GENESIS
        for batch in batches:
            prevs, hashes = [], []
            for name, head in zip(batch.column(log).to_pylist(), batch.column("_head").to_pylist(), strict=True):
                if name != current:
                    current, last = name, GENESIS
                prevs.append(last)
                last = hashlib.sha256(f'{head[:-1]},"{last}"]'.encode()).hexdigest()
                hashes.append(last)
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=schema.names)

    return run


def seal(events: DataFrame, log: str, order: str) -> DataFrame:
    """Adds ``prev`` and ``hash``: every event carries the hash of the one before it in its log.

    A chain is sequential by its nature: a log lies in one partition, sorted (which spills), and one pass over Arrow batches carries the last hash on, so that
    the work is linear in the events and memory is a batch. Different logs run side by side. Events of equal order are taken in the order of their text.
    """
    fields = [f for f in SEALED if f != "prev"]
    schema = StructType([*events.schema.fields, StructField("prev", StringType()), StructField("hash", StringType())])
    heads = events.withColumn("_head", F.to_json(F.array(*[F.col(f).cast("string") for f in fields])))
    return heads.repartition(log).sortWithinPartitions(log, order, "_head").mapInArrow(_chained(log, schema), schema)


def verify(events: DataFrame, log: str, order: str) -> DataFrame:
    """(log, ok, checked, broken_at, reason, trimmed), a row for each log; broken_at counts from 0, -1 if nothing is broken.

    Each event is hashed where it lies; then the seals alone are numbered by range and joined with their neighbours by log and number, so that a log of any size
    is checked by many tasks. A log whose head was trimmed is legal.
    """
    seals = events.select(F.col(log).alias("_log"), F.col(order).alias("_o"), "prev", "hash", (digest(canonical()) == F.col("hash")).alias("_holds"))
    rows = numbered(seals, ["_log"], [F.col("_o"), F.col("hash")], "_n").withColumn("_i", F.col("_n") - 1)
    before = rows.select(F.col("_log").alias("_l"), F.col("_n").alias("_m"), F.col("hash").alias("_before"))
    linked = rows.join(before, F.col("_log").eqNullSafe(F.col("_l")) & (F.col("_i") == F.col("_m")), "left")
    reason = (
        F.when(F.coalesce("hash", F.lit("")) == "", "an event has no seal")
        .when((F.col("_i") > 0) & ~F.col("prev").eqNullSafe(F.col("_before")), "the link to the event before is broken")
        .when(~F.col("_holds"), "the event was changed after it was sealed")
    )
    found = linked.withColumn("_why", reason).groupBy("_log").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("_why").isNotNull(), F.struct("_i", "_why"))).alias("b"), F.max(F.when(F.col("_i") == 0, F.col("prev"))).alias("head"))
    ok = F.col("b").isNull()
    return found.select(F.col("_log").alias(log), ok.alias("ok"), F.when(ok, F.col("n")).otherwise(F.col("b._i")).cast("long").alias("checked"), F.coalesce("b._i", F.lit(-1)).cast("long").alias("broken_at"), F.coalesce("b._why", F.lit("")).alias("reason"), (ok & (F.coalesce("head", F.lit("")) != GENESIS)).alias("trimmed"))


def allowed(action: Column, role: Column, org: Column, target: dict[str, Column]) -> Column:
    """Struct (ok, why). ``target``: a_cpse and b_cpse of a pair, cpses of a disputed code, cpse of a code to retire."""
    say = lambda ok, why: F.struct(F.lit(ok).alias("ok"), (why if isinstance(why, Column) else F.lit(why)).alias("why"))
    null = F.lit(None).cast("string")
    a, b, owner = target.get("a_cpse", null), target.get("b_cpse", null), target.get("cpse", null)
    members = target.get("cpses", F.array().cast("array<string>"))
    cross = ~a.eqNullSafe(b)
    reviewer = role == "reviewer"
    return (
        F.when((action == "decide_pair") & (role == "registrar"), F.when(cross, say(True, "")).otherwise(say(False, "pairs inside one company go to that company's reviewer")))
        .when((action == "decide_pair") & reviewer & ~cross & (a == org), say(True, ""))
        .when((action == "decide_pair") & cross, say(False, "a link between two companies is the registrar's"))
        .when(action == "decide_pair", say(False, F.concat(F.lit("this pair belongs to "), a, F.lit("'s reviewer"))))
        .when((action == "dispute") & reviewer & F.coalesce(F.array_contains(members, org), F.lit(False)), say(True, ""))
        .when(action == "dispute", say(False, "only a company whose code is in the link can dispute it"))
        .when((action == "retire") & reviewer & (org == owner), say(True, ""))
        .when(action == "retire", say(False, F.concat(F.lit("only "), owner, F.lit(" can retire "), owner, F.lit("'s code"))))
        .otherwise(say(False, "not permitted"))
    )


def proposals(codes: DataFrame) -> DataFrame:
    """(national_code, cpse, source_code) from nested codes."""
    return codes.select("national_code", F.explode("members").alias("m")).select("national_code", "m.cpse", "m.source_code")


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a.cast("string"), b.cast("string"))), "~")


def judged_decisions(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accept and reject events with ok and why. ``pairs``: (pair, a_cpse, b_cpse); an event about no proposal is refused."""
    known = pairs.select(F.col("pair").alias("_p"), F.col("a_cpse").alias("_a"), F.col("b_cpse").alias("_b"))
    rows = events.where(F.col("verb").isin("ACCEPT", "REJECT")).join(known, F.col("pair") == F.col("_p"), "left")
    may = allowed(F.lit("decide_pair"), F.col("role"), F.col("org"), {"a_cpse": F.col("_a"), "b_cpse": F.col("_b")})
    none = F.struct(F.lit(False).alias("ok"), F.lit("no such proposal").alias("why"))
    return rows.withColumn("_m", F.when(F.col("_p").isNull(), none).otherwise(may)).withColumn("ok", F.col("_m.ok")).withColumn("why", F.col("_m.why")).drop("_p", "_a", "_b", "_m")


def judged_disputes(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Dispute events with ok and why. ``codes``: (national_code, cpses)."""
    rows = events.where("verb = 'DISPUTE'").join(codes.select(F.col("national_code").alias("_c"), F.col("cpses").alias("_s")), F.col("object") == F.col("_c"), "left")
    none = F.struct(F.lit(False).alias("ok"), F.lit("no such national code").alias("why"))
    may = F.when(F.col("_c").isNull(), none).otherwise(allowed(F.lit("dispute"), F.col("role"), F.col("org"), {"cpses": F.col("_s")}))
    return rows.withColumn("_m", may).withColumn("ok", F.col("_m.ok")).withColumn("why", F.col("_m.why")).drop("_c", "_s", "_m")


def judged_retirements(events: DataFrame, owners: DataFrame) -> DataFrame:
    """Retirement events with ok, why and owner. ``owners``: (national_code, source_code, cpse)."""
    known = owners.select(F.col("national_code").alias("_c"), F.col("source_code").alias("_s"), F.col("cpse").alias("owner"))
    rows = events.where("verb = 'RETIRE_PROPOSED'").join(known, (F.col("code") == F.col("_c")) & (F.col("source") == F.col("_s")), "left")
    none = F.struct(F.lit(False).alias("ok"), F.lit("no such company code").alias("why"))
    may = F.when(F.col("owner").isNull(), none).otherwise(allowed(F.lit("retire"), F.col("role"), F.col("org"), {"cpse": F.col("owner")}))
    return rows.withColumn("_m", may).withColumn("ok", F.col("_m.ok")).withColumn("why", F.col("_m.why")).drop("_c", "_s", "_m")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key: a maximum, formed before the shuffle."""
    rest = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("l")).select(key, "l.*")


def replay(events: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """(pair, state, by, at): LINKED or APART, by the latest decision that consent allows."""
    ok = judged_decisions(events, pairs).where("ok").select("pair", order, "verb", "actor", "ts")
    return latest(ok, "pair", order).select("pair", F.when(F.col("verb") == "ACCEPT", "LINKED").otherwise("APART").alias("state"), F.col("actor").alias("by"), F.col("ts").alias("at"))


def state_digest(state: DataFrame) -> DataFrame:
    """One hash of all decisions: of the sorted hashes of 4096 parts, so that no task sees them all."""
    rows = state.select(F.to_json(F.struct(F.col("pair").cast("string").alias("pair"), "state")).alias("j"), F.substring(F.sha2(F.col("pair").cast("string").cast("binary"), 256), 1, 3).alias("part"))
    parts = rows.groupBy("part").agg(digest(F.array_join(F.sort_array(F.collect_list("j")), ",")).alias("h"))
    return parts.agg(digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda p: p.h), ",")).alias("digest"), F.count(F.lit(1)).alias("parts"))


def can(action: Column, role: Column, org: Column, target_a: Column, target_b: Column) -> Column:
    """May this session do this? Six actions: propose, decide_pair, dispute, retire, export, view_log."""
    cross = ~target_a.eqNullSafe(target_b)
    return (
        F.when(action == "propose", role.isin("requester", "reviewer", "registrar"))
        .when(action == "decide_pair", ((role == "registrar") & cross) | ((role == "reviewer") & ~cross & (target_a == org)))
        .when(action == "dispute", (role == "reviewer") & ((target_a == org) | (target_b == org)))
        .when(action == "retire", (role == "reviewer") & (target_a == org))
        .when(action == "export", role.isin("registrar", "reviewer"))
        .when(action == "view_log", role.isin("auditor", "registrar", "reviewer"))
        .otherwise(False)
    )
