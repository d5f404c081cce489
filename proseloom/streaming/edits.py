"""The state of an author's edits, by session and file, over a stream of events.

Events: session, file, at (seconds), seq (orders events of one time), event, text, keys, outcome. `pre` saves the text before an edit;
`post` compares it with the text after and records the units that the edit added, with no attempts yet (older counts stay);
`stop` asks for what is recorded; `settle` says what became of the units that were sent: done drops them, conflict keeps
them, retry counts an attempt and drops them at the third; units that the file no longer holds go too.
A key's events come to one task in order of (at, seq) within a batch, which replaces the lock; the checkpoint makes a batch count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.markdown import new_unit_keys, recorded_passages, unit_keys

#: Attempts after which a unit is given up; seconds that the log of edits reaches back.
ATTEMPTS, KEPT = 3, 86_400
OUT = "session string, file string, at double, event string, units int, passages array<string>, edited boolean"
STATE = "held string"


def step(state: dict, e: dict) -> dict | None:
    """One event's effect on a state (before, units, edits); what it emits, if anything."""
    units, log = state["units"], [t for t in state["edits"] if t >= e["at"] - KEPT]
    state["edits"] = log
    if e["event"] == "pre":
        state["before"] = e["text"] or ""
        return None
    if e["event"] == "post":
        log.append(e["at"])
        if state["before"] is not None:
            for key in sorted(new_unit_keys(state["before"], e["text"] or "", set(units))):
                units.setdefault(key, 0)
            state["before"] = None
        return None
    if e["event"] == "stop":
        return {"units": len(units), "passages": [p["text"] for p in recorded_passages(e["text"] or "", set(units))], "edited": False}
    if e["event"] == "settle":
        for key in e["keys"] if e["keys"] is not None else ():
            if key in units:
                if e["outcome"] == "retry":
                    units[key] += 1
                if e["outcome"] == "done" or units[key] >= ATTEMPTS:
                    del units[key]
        present = unit_keys(e["text"] or "")
        state["units"] = {k: n for k, n in units.items() if k in present}
        since = e["since"]
        return {"units": len(state["units"]), "passages": [], "edited": since is not None and not pd.isna(since) and any(t >= since for t in log)}
    return None


def _run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {"before": None, "units": {}, "edits": []}
    rows = []
    for e in pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable").to_dict("records"):
        out = step(held, e)
        if out:
            rows.append({"session": key[0], "file": key[1], "at": e["at"], "event": e["event"], **out})
    if held["units"] or held["before"] is not None or held["edits"]:
        state.update((json.dumps(held),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["session", "file", "at", "event", "units", "passages", "edited"])


def recorded_units(events: DataFrame) -> DataFrame:
    """session, file, at, event, units, passages, edited for each stop and settle event of a stream."""
    return events.groupBy("session", "file").applyInPandasWithState(_run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame) -> DataFrame:
    """The same of a finished table: each key's events from an empty state."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held, rows = {"before": None, "units": {}, "edits": []}, []
        for e in frame.sort_values(["at", "seq"], kind="stable").to_dict("records"):
            out = step(held, e)
            if out:
                rows.append({"session": key[0], "file": key[1], "at": e["at"], "event": e["event"], **out})
        return pd.DataFrame(rows, columns=["session", "file", "at", "event", "units", "passages", "edited"])

    return events.groupBy("session", "file").applyInPandas(run, OUT)
