"""Per-session stream logic: endpointing, clauses, chunks, context, realtime events.

Each operator is a step function from (state, event) to (state, outputs). ``replay`` runs it over a batch
table, session by session in order of arrival; ``stream`` runs the same steps with Spark's keyed state,
so both give the same outputs for the same arrivals. There is no event time in these protocols: order is
the order of ``seq``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], tuple[dict, list[dict]]]

FRAME_MS = 20


def endpoint_step(state: dict, event: dict, ratio: float = 3.0, least_ms: int = 200, silence_ms: int = 300, floor: float = 0.005) -> tuple[dict, list[dict]]:
    """One frame's energy: ends a turn once speech was heard and silence has lasted.

    Speech is energy over the noise floor times ``ratio``; speech adds up over pauses; the floor moves
    only while it is quiet, and silence only counts once speech has begun.
    """
    s = state or {"floor": floor, "speech": 0, "silence": 0, "armed": False}
    energy = event["energy"] or 0.0
    if energy > s["floor"] * ratio:
        speech = s["speech"] + FRAME_MS
        return {**s, "speech": speech, "silence": 0, "armed": s["armed"] or speech >= least_ms}, []
    s = {**s, "floor": 0.95 * s["floor"] + 0.05 * energy}
    if not s["armed"]:
        return s, []
    s["silence"] += FRAME_MS
    if s["silence"] < silence_ms:
        return s, []
    return {"floor": floor, "speech": 0, "silence": 0, "armed": False}, [{"kind": "endpoint", "value": str(event["seq"])}]


#: Signs that end a sentence, and signs that end a clause.
_SPOKEN = re.compile(r"(?P<sentence>[^。！？!?]*[。！？!?])|.*[，、,]", re.DOTALL)


def first_utterance(text: str, longest: int = 24, least: int = 12) -> str | None:
    """The part of a text that can be spoken already: a sentence, or a long enough clause."""
    found = _SPOKEN.match(text)
    if found is None or (found["sentence"] is None and (len(text) < longest or found.end() <= least)):
        return None
    return found[0]


def clause_step(state: dict, event: dict) -> tuple[dict, list[dict]]:
    """One delta of a reply: at most one clause leaves with it; what is pending leaves at the end (a null delta)."""
    pending = (state or {"pending": ""})["pending"]
    if event["delta"] is None:
        rest = pending.strip()
        return {"pending": ""}, [{"kind": "remainder", "value": rest}] if rest else []
    pending += event["delta"]
    clause = first_utterance(pending)
    if clause is None:
        return {"pending": pending}, []
    return {"pending": pending[len(clause) :]}, [{"kind": "clause", "value": clause}]


def chunk_step(state: dict, event: dict, size: int = 4, overlap: int = 2) -> tuple[dict, list[dict]]:
    """One codec frame: a chunk leaves once ``size`` frames are new, led in by up to ``overlap`` before; a null frame ends."""
    s = state or {"frames": 0, "emitted": 0}
    frames, emitted = s["frames"], s["emitted"]
    if event["frame"] is not None:
        frames += 1
        if frames - emitted < size:
            return {"frames": frames, "emitted": emitted}, []
        lead = min(overlap, emitted)
        return {"frames": frames, "emitted": emitted + size}, [{"kind": "chunk", "value": f"{emitted - lead}:{emitted + size}"}]
    if frames > emitted:
        return {}, [{"kind": "final", "value": f"{emitted - min(overlap, emitted)}:{frames}"}]
    return {}, [{"kind": "final", "value": ""}]


def context_step(state: dict, event: dict, budget: int = 3072 - 512) -> tuple[dict, list[dict]]:
    """One turn: the oldest turns leave until the rest fits; the newest always stays."""
    costs = [*(state or {"costs": []})["costs"], [event["seq"], int(len(event["text"] or "") / 1.5) + 1]]
    out = []
    while len(costs) > 1 and sum(c for _, c in costs) > budget:
        out.append({"kind": "dropped", "value": str(costs.pop(0)[0])})
    return {"costs": costs}, out


def realtime_step(state: dict, event: dict) -> tuple[dict, list[dict]]:
    """One event of a realtime session: buffer, commit, cancel, clear."""
    s = state or {"buffered": 0, "busy": False, "turns": 0}
    kind = event["type"]
    if kind == "input_audio_buffer.append":
        return {**s, "buffered": s["buffered"] + int(event["size"] or 0)}, []
    if kind == "input_audio_buffer.clear":
        return {**s, "buffered": 0}, [{"kind": "input_audio_buffer.cleared", "value": ""}]
    if kind == "input_audio_buffer.commit":
        if not s["buffered"]:
            return s, [{"kind": "error", "value": "empty buffer"}]
        return {**s, "buffered": 0, "busy": True, "turns": s["turns"] + 1}, [{"kind": "response.created", "value": str(s["buffered"])}]
    if kind == "response.cancel":
        # While idle a cancel drops what was buffered; during a reply the buffer is the next turn's.
        return {**s, "busy": False, "buffered": s["buffered"] if s["busy"] else 0}, [{"kind": "response.cancelled", "value": "reply" if s["busy"] else "buffer"}]
    if kind == "response.done":
        return {**s, "busy": False}, [{"kind": "response.done", "value": str(s["turns"])}]
    if kind == "session.update":
        return s, [{"kind": "session.updated", "value": ""}]
    if kind == "session.clear":
        return {"buffered": 0, "busy": False, "turns": 0}, [{"kind": "session.cleared", "value": ""}]
    return s, [{"kind": "error", "value": f"unknown event {kind}"}]


_OUT = "session string, seq long, kind string, value string"


def _run(step: Step, session: str, rows: pd.DataFrame, state: dict) -> tuple[dict, pd.DataFrame]:
    out = []
    for event in rows.sort_values("seq", kind="stable").astype(object).where(lambda x: x.notna(), None).to_dict("records"):
        state, found = step(state, event)
        out += [(session, int(event["seq"]), o["kind"], o["value"]) for o in found]
    return state, pd.DataFrame(out, columns=["session", "seq", "kind", "value"])


def replay(events: DataFrame, step: Step) -> DataFrame:
    """(session, seq, kind, value) of a batch of (session, seq, ...) events; a session's events meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _run(step, key[0], rows, {})[1]

    return events.groupBy("session").applyInPandas(run, _OUT)


def stream(events: DataFrame, step: Step) -> DataFrame:
    """The same over a stream: each session's state is kept between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else {}
        rows = pd.concat(list(batches))
        state, out = _run(step, key[0], rows, state)
        kept.update((json.dumps(state),))
        yield out

    return events.groupBy("session").applyInPandasWithState(run, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def frames_in_flight(events: DataFrame) -> DataFrame:
    """(session, frames): audio deltas between a session's cancel and the reply's end."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cancels = F.sum((F.col("type") == "response.cancel").cast("int")).over(order)
    dones = F.sum((F.col("type") == "response.done").cast("int")).over(order)
    late = (F.coalesce(cancels, F.lit(0)) > 0) & (F.coalesce(dones, F.lit(0)) == 0) & (F.col("type") == "response.audio.delta")
    return events.withColumn("late", late).groupBy("session").agg(F.count_if("late").alias("frames"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, for batch tables and streams (an extension: the protocols have no event time)."""
    from pyspark.sql import functions as F

    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
