"""The contract of a rollout: what a plan must look like, and when a step may be saved, claimed or marked and a report handed in.

Events are rows (rollout, seq, operation, steps array, dependencies map<int, array<int>>, step_id string, content string,
evidence_ids array, returned array<int>, status string); each gives (valid, verdict, missing, saved, submitted). One step
function serves batch (``judged``) and stream (``judged_stream``). The state is small: a plan has at most 12 steps.

C18: a plan has 2 to 12 steps, the last of which makes the report. A step but the last is saved once, after the steps it depends
on, with a summary of 40 characters and evidence that a search has returned before. A report of 200 characters is accepted once
every other step is saved. T6: a step is claimed if it is not started and what it depends on is completed; completed never goes
back, and in_progress and completed need the dependencies. A new plan keeps what was saved and restarts the board.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tessera.functions.shared import tasks
from tessera.streaming.fold import FoldedStream, folded, folded_stream

#: Bounds of a plan and of texts, words of a last step.
LEAST_STEPS, MOST_STEPS, SUMMARY, REPORT = 2, 12, 40, 200
LAST_STEP = r"(?i)report|报告|总结|synth"
VERDICTS = "valid boolean, verdict string, missing array<int>, saved int, submitted boolean"
START = {"steps": [], "needs": {}, "saved": [], "seen": [], "blocked": 0, "candidate": 0, "submitted": False, "board": {}}


def _number(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _pairs(m: object) -> list[tuple]:
    """A map's entries, however it came: Arrow gives pairs, JSON a dict with text keys."""
    return list(m.items() if isinstance(m, dict) else m or ())


def _plan(state: dict, e: dict) -> tuple[bool, str, list]:
    steps = [s.strip() for s in e["steps"] or () if s and s.strip()]
    if not LEAST_STEPS <= len(steps) <= MOST_STEPS:
        return False, "plan_size", []
    if not re.search(LAST_STEP, steps[-1]):
        return False, "no_report_step", []
    needs = {}
    for k, deps in _pairs(e["dependencies"]):
        at = _number(k)
        if at is not None and 0 <= at < len(steps):
            needs[str(at)] = sorted({d for d in map(_number, deps or ()) if d is not None and 0 <= d < len(steps) and d != at})
    state |= {"steps": steps, "needs": needs, "board": {}}
    return True, "plan_accepted", []


def _save(state: dict, e: dict) -> tuple[bool, str, list]:
    at = _number(e["step_id"])
    if not state["steps"]:
        return False, "no_plan", []
    if at is None:
        return False, "no_step_id", []
    if not 0 <= at < len(state["steps"]) - 1:
        return False, "no_working_step", []
    if missing := [d for d in state["needs"].get(str(at), []) if d not in state["saved"]]:
        state["blocked"] += 1
        return False, "blocked", missing
    if at in state["saved"]:
        return False, "already_saved", []
    if len((e["content"] or "").strip()) < SUMMARY:
        return False, "thin_summary", []
    named = [i.strip().upper() for i in e["evidence_ids"] or () if i and i.strip()]
    if not set(named) <= {f"E{n}" for n in state["seen"]}:
        return False, "unknown_evidence", []
    state["saved"].append(at)
    state["board"][str(at)] = "completed"
    return True, "step_saved", []


def _submit(state: dict, e: dict) -> tuple[bool, str, list]:
    if not state["steps"]:
        return False, "no_plan", []
    size = len((e["content"] or "").strip())
    if size >= REPORT:
        state["candidate"] = size  # kept even where the call is turned down
    if missing := [i for i in range(len(state["steps"]) - 1) if i not in state["saved"]]:
        return False, "blocked", missing
    if size < REPORT:
        return False, "thin_report", []
    state["submitted"] = True
    return True, "report_submitted", []


def _mark(state: dict, e: dict, claim: bool) -> tuple[bool, str, list]:
    at, to = _number(e["step_id"]), "in_progress" if claim else (e["status"] or "")
    if at is None or not 0 <= at < len(state["steps"]):
        return False, "no_step", []
    now = state["board"].get(str(at), "not_started")
    missing = [d for d in state["needs"].get(str(at), []) if state["board"].get(str(d)) != "completed"]
    if claim and now != "not_started":
        return False, "not_free", []
    if now == "completed" and to in ("in_progress", "blocked"):
        return False, "kept_completed", []
    if to in ("in_progress", "completed") and missing:
        return False, "blocked", missing
    state["board"][str(at)] = to or now
    return True, "claimed" if claim else "marked", []


def judge(state: dict, e: dict) -> tuple:
    """One event's verdict; changes the state."""
    op = (e["operation"] or "").strip().lower()
    if op == "create_plan":
        got = _plan(state, e)
    elif op == "search_evidence" and not (e["content"] or "").strip():
        got = False, "no_query", []
    elif op in ("search_evidence", "inspect_visual"):
        state["seen"] = sorted({*state["seen"], *(e["returned"] or ())})
        got = True, "searched", []
    elif op in ("read_workspace", "status"):
        got = True, "read", []
    elif op == "save_step":
        got = _save(state, e)
    elif op == "submit_report":
        got = _submit(state, e)
    elif op in ("claim_step", "mark_step"):
        got = _mark(state, e, op == "claim_step")
    else:
        got = False, "unknown_operation", []
    return *got, len(state["saved"]), state["submitted"]


def judged(events: DataFrame) -> DataFrame:
    return folded(events, "rollout", "seq", START, judge, VERDICTS, tasks(events.sparkSession))


def judged_stream(events: DataFrame) -> FoldedStream:
    return folded_stream(events, "rollout", "seq", START, judge, VERDICTS)
