"""Trips as a fold over a user's events: in batches, or as state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "state string"
OUT = "user_id long, trips string, active string, on_draft boolean, draft string, dirty boolean, can_undo_delete boolean, can_undo_unsave boolean"
#: The actions on trips, and what of a draft counts as an edit.
ACTIONS = ("create", "update", "openDraft", "updateDraft", "saveDraft", "unsave", "undoUnsave", "dismissUnsave", "setActive", "closeActive", "delete", "undoDelete", "import", "reopenDraft")
EDITS = ("huts", "start", "exit", "startDate", "partySize")


def start() -> dict:
    """Saved trips in order, the one shown, the draft with its state when opened, and what can be undone."""
    return {"trips": [], "active": None, "on_draft": False, "draft": None, "opened": None, "deleted": None, "unsaved": None}


def _at(state: dict, key: str | None) -> int | None:
    return next((i for i, t in enumerate(state["trips"]) if t["id"] == key), None)


def _inserted(trips: list, place: int, trip: dict) -> list:
    return [*trips[:place], trip, *trips[place:]]


def _dated(trip: dict, body: dict) -> dict:
    return {**trip, "updatedAt": body["now"]} if body.get("now") else trip


def _drafting(trip: dict) -> dict:
    return {"draft": trip, "opened": trip, "active": None, "on_draft": True}


NO_DRAFT = {"draft": None, "opened": None, "on_draft": False, "unsaved": None}


def _changes(state: dict, action: str, body: dict) -> dict:
    """What an action changes; empty if it does not apply. body: trip or trips, id, name, now."""
    trip, draft, place = body.get("trip"), state["draft"], _at(state, body.get("id"))
    match action:
        case "create":
            return {"trips": [*state["trips"], trip], "active": trip["id"], "on_draft": False}
        case "update":
            return {"trips": [_dated(trip, body) if t["id"] == trip["id"] else t for t in state["trips"]]}
        case "openDraft":
            return _drafting(trip) | {"unsaved": None}
        case "updateDraft" if draft:
            return {"draft": _dated(trip, body)}
        case "saveDraft" if draft:
            kept = _dated({**draft, "name": body.get("name", draft.get("name"))}, body)
            return NO_DRAFT | {"trips": [*state["trips"], kept], "active": kept["id"]}
        case "unsave" if place is not None:
            saved = state["trips"][place]
            left = [t for t in state["trips"] if t["id"] != saved["id"]]
            return _drafting({**saved, "name": body.get("name", saved.get("name"))}) | {"trips": left, "unsaved": {"id": saved["id"], "place": place, "name": saved.get("name")}}
        case "undoUnsave" if state["unsaved"] and draft and draft["id"] == state["unsaved"]["id"]:
            back = {**draft, "name": state["unsaved"]["name"]}
            return NO_DRAFT | {"trips": _inserted(state["trips"], state["unsaved"]["place"], back), "active": draft["id"] if state["on_draft"] else state["active"]}
        case "dismissUnsave":
            return {"unsaved": None}
        case "reopenDraft" if draft:
            return {"active": None, "on_draft": True}
        case "setActive":
            return {"active": body.get("id"), "on_draft": False}
        case "closeActive":
            return {"active": None, "on_draft": False}
        case "delete" if place is not None:
            gone = state["trips"][place]
            return {"trips": [t for t in state["trips"] if t["id"] != gone["id"]], "active": None if state["active"] == gone["id"] else state["active"], "deleted": {"trip": gone, "place": place}}
        case "undoDelete" if state["deleted"]:
            return {"trips": _inserted(state["trips"], state["deleted"]["place"], state["deleted"]["trip"]), "deleted": None}
        case "import":
            trips = list(state["trips"])
            for new in body.get("trips") or []:
                taken, key = {t["id"] for t in trips}, new["id"]
                while key in taken:  # a trip whose id is taken comes in under another
                    key = f"{key}-copy"
                trips.append({**new, "id": key})
            return {"trips": trips}
    return {}


def reduced(state: dict, action: str, body: dict | None) -> dict:
    """The state after an action; unknown actions, and those that don't apply, change nothing."""
    return state | _changes(state, action, body or {})


def dirty(state: dict) -> bool:
    """Whether the draft has been edited since it was opened; a new name is no edit."""
    return bool(state["draft"] and state["opened"]) and any(state["draft"].get(k) != state["opened"].get(k) for k in EDITS)


def _row(user: int, state: dict) -> dict:
    return {
        "user_id": user, "trips": ",".join(t["id"] for t in state["trips"]), "active": state["active"], "on_draft": state["on_draft"],
        "draft": json.dumps(state["draft"], sort_keys=True) if state["draft"] else None, "dirty": dirty(state),
        "can_undo_delete": state["deleted"] is not None, "can_undo_unsave": state["unsaved"] is not None,
    }


def folded(events: DataFrame) -> DataFrame:
    """The state of each user after all of their events (user_id, ord, action, body as JSON)."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = start()
        for r in rows.sort_values("ord").itertuples():
            state = reduced(state, r.action, json.loads(r.body) if r.body else None)
        return pd.DataFrame([_row(int(rows["user_id"].iloc[0]), state)])

    return events.select("user_id", "ord", "action", "body").groupBy("user_id").applyInPandas(fold, OUT)


def streamed(events: DataFrame) -> DataFrame:
    """The same as a stream: a row for each user whose state a batch changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else start()
        rows = pd.concat(list(batches))
        for r in rows.sort_values("ord").itertuples():
            state = reduced(state, r.action, json.loads(r.body) if r.body else None)
        held.update((json.dumps(state),))
        yield pd.DataFrame([_row(int(key[0]), state)])

    return events.select("user_id", "ord", "action", "body").groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and type of a stream or table of events (ts, event_type, value); late rows beyond the watermark are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("since"), "event_type", "n", "value")
