"""Tool calls in a model's text, read at three levels: JSON, JSON in a fence, and what pairs of a broken object say."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import flat_map

#: How calls are marked, where a name may stand, and arguments that tools also take under other names.
BLOCK = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.I | re.S)
OPEN, CLOSE = re.compile("<tool_call>", re.I), re.compile("</tool_call>", re.I)
NAMES = ("name", "tool", "function")
OTHER_NAMES = {"ask_question_about_image": ("image", "image_path_url"), "ask_question_about_video": ("image", "image_path_url"), "serper_search": ("q", "query")}
DEFAULTS = {t: {"task_prompt": "Please analyze the file and answer the task."} for t in ("ask_question_about_image", "ask_question_about_video")}
CUT_OFF = ("length", "max_tokens")


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _unfenced(text: str) -> str:
    """A fenced block's inside: back ticks at both ends and the rest of the first line go."""
    if not text.startswith("```"):
        return text
    inner = text.strip("`")
    return inner.partition("\n")[2].strip() if "\n" in inner else inner


def _pairs(block: str) -> tuple[str, dict] | None:
    """A broken object's name and those of its arguments that are quoted texts."""
    name = re.search(r'"name"\s*:\s*"([^"]+)"', block)
    if not name:
        return None
    tool, body = name[1].strip(), re.search(r'"arguments"\s*:\s*\{(.*)\}\s*$', block, re.S)
    args = dict(re.findall(r'"([^"\\]+)"\s*:\s*"([^"]*)"', body[1])) if body else {}
    said, wanted = OTHER_NAMES.get(tool, (None, None))
    if said in args:
        args.setdefault(wanted, args[said])
    return tool, args | {k: v for k, v in DEFAULTS.get(tool, {}).items() if k not in args}


def calls_in(content: str | None) -> list[tuple[int, str, str, str]]:
    """(place, level, name, arguments as JSON) of a text's calls; blocks without a name are left out."""
    out = []
    for k, block in enumerate(b.strip() for b in BLOCK.findall(content or "")):
        if not block:
            continue
        found, level = _json(block), "json"
        if found is None:
            found, level = _json(_unfenced(block)), "fenced"
        if isinstance(found, dict):
            name = next((found[n] for n in NAMES if found.get(n)), None)
            args = found.get("arguments", {})
        elif got := _pairs(block):
            (name, args), level = got, "pairs"
        else:
            continue
        if name:
            out.append((k, level, str(name), args if isinstance(args, str) else json.dumps(args, ensure_ascii=False)))
    return out


def looks_cut_off(content: str | None, finish_reason: str | None) -> bool:
    """Whether a text ends within a call: more opening marks than closing ones, or none closed where the length ran out."""
    text = content or ""
    if "<tool_call>" not in text:
        return False
    opened, closed = len(OPEN.findall(text)), len(CLOSE.findall(text))
    return opened > closed or (closed == 0 and (finish_reason or "").lower() in CUT_OFF)


def repaired(messages: DataFrame, id_col: str) -> DataFrame:
    """(id, call, level, name, arguments, truncated) of messages (id, content, finish_reason): a row for each call, or one
    with nulls for a text that holds marks but no call, so that cut-off calls show; texts without marks give no row."""
    kind = messages.schema[id_col].dataType.simpleString()

    def one(key: object, content: str | None, reason: str | None) -> list[tuple]:
        cut = looks_cut_off(content, reason)
        return [(key, *c, cut) for c in calls_in(content)] or [(key, None, None, None, None, cut)]

    marked = messages.where(F.contains(F.lower("content"), F.lit("<tool_call>")))
    return flat_map(marked.select(id_col, "content", "finish_reason"), one, f"{id_col} {kind}, call int, level string, name string, arguments string, truncated boolean", held=500)
