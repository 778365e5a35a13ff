"""Extensions: the incremental forms of log verification and of the gate, and windows over events."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.registry import REGISTRY, Registry
from ..operators.gate import verdicts
from ..operators.governance import SEALED

VERDICT = "log string, seq long, id string, ok boolean, reason string"


def verified_log(events: DataFrame, log: str = "log", seq: str = "seq") -> DataFrame:
    """Each event of a stream with whether its seal holds and links to the event before; the last hash of every log is the state."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for e in rows.to_dict("records"):
            fields = [None if pd.isna(e.get(f)) else str(e[f]) for f in SEALED]
            own = hashlib.sha256(json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
            why = "an event has no seal" if not e.get("hash") else "the link to the event before is broken" if last is not None and e["prev"] != last else "the event was changed after it was sealed" if own != e["hash"] else ""
            out.append((key[0], int(e[seq]), e["id"], not why, why))
            last = e["hash"]
        state.update((last,))
        yield pd.DataFrame(out, columns=["log", "seq", "id", "ok", "reason"])

    return events.groupBy(log).applyInPandasWithState(check, VERDICT, "last string", "append", GroupStateTimeout.NoTimeout)


def gate_stream(requests: DataFrame, catalogue: DataFrame, folder: str, checkpoint: str, registry: Registry = REGISTRY) -> StreamingQuery:
    """Every micro-batch of requests against the catalogue; verdicts are appended to ``folder``."""

    def decide(batch: DataFrame, _: int) -> None:
        verdicts(batch, catalogue, registry).write.mode("append").parquet(folder)

    return requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each window; events later than ``late`` are dropped in a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *by, "events", "value")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "events")
