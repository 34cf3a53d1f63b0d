"""JSON in free text: the value that a text holds, and repair of values that break off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _loads(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def balanced(text: str) -> str | None:
    """The first balanced object or array in a text, strings taken into account."""
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start.start(), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start.start() : i + 1]
    return None


def find_json(text: str) -> str | None:
    """The JSON value of a text as compact JSON: the whole text, a fenced part, or the first balanced part; what stands in think tags is ignored."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text).strip()
    fenced = re.search(r"(?s)```(?:json)?\s*(.*?)```", text)
    for part in (text, fenced[1].strip() if fenced else None, balanced(text)):
        if part:
            ok, value = _loads(part)
            if ok:
                return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return None


#: A token of JSON: brackets, comma, colon, a whole string, a number or a word; and an open string up to its last whole character.
_TOKEN = re.compile(r'\s*(?:([\[{])|([\]}])|(,)|(:)|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S)
_OPEN_STRING = re.compile(r'\s*"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')
_CLOSER = {"{": "}", "[": "]"}


def repaired(text: str) -> str | None:
    """A JSON value that breaks off, closed: an open string ends, dangling keys and commas go, open brackets close.

    One pass over the tokens remembers the last place where the value could end; null if there is none.
    """
    at, stack, state, good = 0, [], "value", None  # state: what may come next
    while token := _TOKEN.match(text, at):
        opened, closed, comma, colon, string, plain = token.groups()
        at, in_object = token.end(), bool(stack) and stack[-1] == "{"
        if opened and state in ("value", "value or end"):
            stack.append(opened)
            state = "key or end" if opened == "{" else "value or end"
        elif closed and stack and _CLOSER[stack[-1]] == closed and state in ("next", "key or end", "value or end"):
            stack.pop()
            state = "next"
        elif comma and state == "next" and stack:
            state = "key" if in_object else "value"
        elif colon and state == "colon":
            state = "value"
        elif string and state in ("key", "key or end"):
            state = "colon"
        elif (string or plain) and state in ("value", "value or end"):
            state = "next"
        else:
            break
        if state in ("next", "key or end", "value or end"):
            good = text[:at] + "".join(_CLOSER[x] for x in reversed(stack))
            if not stack:
                break
    else:
        if state in ("value", "value or end") and (begun := _OPEN_STRING.match(text, at)):
            good = begun[0].join((text[:at], '"')) + "".join(_CLOSER[x] for x in reversed(stack))
    ok, value = _loads(good) if good is not None else (False, None)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False) if ok else None


def _udf(f):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else f(t))

    return run


extract_json, repair_json = _udf(find_json), _udf(repaired)
canonical_json = _udf(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def fits(text: Column, schema: str) -> Column:
    """Whether a text is JSON of the given DDL schema without a field that has another type."""
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.coalesce(parsed.isNotNull() & parsed["_corrupt"].isNull(), F.lit(False))
