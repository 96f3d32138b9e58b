"""Text that holds lists and objects, as language models and scrapers write it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[a-zA-Z]*")


def repaired(text: str | None) -> str | None:
    """The first complete object or list of ``text``: without code fences and
    trailing commas, cut after the last complete element where the end is
    missing. None where there is none."""
    if not text:
        return None
    t = _FENCE.sub("", text)
    start = min((i for i in (t.find("["), t.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    depth, stack, quoted, escaped, safe = 0, [], False, False, None
    end = None
    for i in range(start, len(t)):
        ch = t[i]
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
                if stack == ["]"]:
                    safe = (i + 1, list(stack))
            continue
        if ch == '"':
            quoted = True
        elif ch in "[{":
            stack.append("]" if ch == "[" else "}")
            depth += 1
        elif ch in "]}":
            if not stack or stack[-1] != ch:
                break
            stack.pop()
            if not stack:
                end = i + 1
                break
            safe = (i + 1, list(stack))
    if end is None:
        if safe is None:
            return None
        body = t[start : safe[0]] + "".join(reversed(safe[1]))
    else:
        body = t[start:end]
    body = re.sub(r",\s*([\]}])", r"\1", body)
    try:
        json.loads(body)
    except ValueError:
        return None
    return body


def truncated(text: str) -> str:
    """``text`` without commas before closing brackets and, if its braces stay
    open, cut after the last object that is complete at the top level."""
    t = re.sub(r",(?=\s*[\]}])", "", text)
    depth = end = 0
    for m in re.finditer("[{}]", t):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            end = m.end()
    return t[:end] if depth > 0 and end else t


def items(text: str | None) -> list[str]:
    """The statements of a list, object or lines, decoded twice if a string holds
    another notation."""
    for _ in range(2):
        body = repaired(text)
        if body is None:
            break
        v = json.loads(body)
        if isinstance(v, dict):
            v = next((x for x in v.values() if isinstance(x, list)), list(v.values()))
        out = [x if isinstance(x, str) else next((str(y) for y in x.values() if y), "") if isinstance(x, dict) else str(x) for x in v if x is not None]
        if len(out) == 1 and out[0].lstrip()[:1] in "[{":
            text = out[0]
            continue
        return [x.strip() for x in out if x.strip()]
    if text and text.strip()[:2] in ('"[', '"{'):
        try:
            return items(json.loads(text.strip()))
        except ValueError:
            return []
    return bullets(text or "")


def bullets(text: str, least: int = 10) -> list[str]:
    """Lines of more than ``least`` characters without their bullet or number."""
    lines = [re.sub(r"^\s*(?:[-*•·]|\d{1,2}[.)])\s+", "", x).strip() for x in _FENCE.sub("", text).splitlines()]
    return [x for x in lines if len(x) > least and x.upper() != "N/A"]


def exploded(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, item): one row per statement, positions from 1."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, x) for k, t in zip(b[key], b[column], strict=True) for i, x in enumerate(items(t), 1)]
            yield pd.DataFrame(out, columns=[key, "position", "item"])

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, position int, item string")


def malformed(column: Column) -> Column:
    """Why a response can't be read as a list of strings: 'empty', 'not a list'
    or null."""
    t = F.trim(F.regexp_replace(column, "```[a-zA-Z]*", ""))
    return F.when(column.isNull() | (t == ""), "empty").when(F.from_json(t, "array<string>").isNull(), "not a list")


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])
