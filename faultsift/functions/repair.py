"""JSON values in free text: found, their missing end supplied, and the first that fits taken."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _closed(text: str) -> str:
    """text with the brackets and the quote closed that are open at its end."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
    return text + '"' * quoted + "".join(reversed(stack))


def first_json(text: str | None, key: str) -> str | None:
    """The first JSON object or array in text that has key, at whatever depth, as JSON; null without one."""
    decoder, text = json.JSONDecoder(), text or ""
    at = 0
    while (at := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
        for part in (text[at:], _closed(text[at:])):
            try:
                value, _ = decoder.raw_decode(part)
            except ValueError:
                continue
            todo = [value]
            while todo:
                v = todo.pop(0)
                if isinstance(v, dict):
                    if key in v:
                        return json.dumps(v, ensure_ascii=False, sort_keys=True)
                    todo += v.values()
                elif isinstance(v, list):
                    todo += v
            break
        at += 1
    return None


def json_with(text: Column, key: str) -> Column:
    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda t: first_json(t, key))

    return find(text)
