"""JSON that models write: recovery, key paths, text of nested values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?P<lang>[A-Za-z0-9_+-]*)[ \t]*\n?(?P<body>.*?)```", re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_CLOSER = {"{": "}", "[": "]"}
RECOVERED = T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("format", "json", "error_type"))])


def _brackets(text: str) -> tuple[int | None, list[str] | None]:
    """(place after the bracket that closes the first one, or None; closers still open at the end, None if one was wrong or a string is open)."""
    stack: list[str] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c == '"':
            m = _STRING.match(text, at)
            if not m:
                return None, None
            at = m.end()
            continue
        if c in _CLOSER:
            stack.append(_CLOSER[c])
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None, None
            if not stack:
                return at + 1, []
        at += 1
    return None, stack


def balanced(text: str) -> str | None:
    """The first stretch from a bracket to the one that closes it."""
    for m in re.finditer(r"[\[{]", text):
        end, _ = _brackets(text[m.start() :])
        if end:
            return text[m.start() : m.start() + end]
    return None


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _repaired(text: str) -> str | None:
    """Without commas before closing brackets, then with missing brackets closed."""
    text = re.sub(r",\s*([}\]])", r"\1", text.replace("﻿", "").strip())
    if _loads(text) is not None:
        return text
    _, missing = _brackets(text)
    if missing:
        closed = re.sub(r",\s*([}\]])", r"\1", text.rstrip() + "".join(reversed(missing)))
        return closed if _loads(closed) is not None else None
    return None


def _yaml(text: str):
    try:
        import yaml
    except ImportError:  # optional: YAML answers are then not recovered
        return None
    lines = text.splitlines()
    start = next((i for i, x in enumerate(lines) if re.match(r"\s*(?:[A-Za-z_][A-Za-z0-9_-]*\s*:|- )", x)), 0)
    try:
        found = yaml.safe_load(re.sub(r"#(\d+)", r"issue-\1", "\n".join(lines[start:]).strip()))
    except yaml.YAMLError:
        return None
    return found if isinstance(found, (dict, list)) else None


def recover(raw: str | None) -> tuple[bool, str | None, str | None, str | None]:
    """(ok, format, JSON text, error type) of a model's answer: fenced YAML, JSON as it is or balanced in prose, repaired JSON, YAML."""
    raw = raw or ""
    fence = _FENCE.search(raw)
    body, lang = (fence["body"].strip(), fence["lang"].lower()) if fence else (raw.strip(), "")
    is_yaml = lang in ("yaml", "yml")
    if is_yaml and (found := _yaml(body)) is not None:
        return True, "yaml", json.dumps(found, default=str), None
    tries = [body] if is_yaml or body.startswith(("{", "[")) else [body, balanced(raw)]
    for text in tries:
        if text and (_loads(text) is not None or text == "null"):
            return True, "json", text, None
    first = raw.find("{")
    last = raw.rfind("}")
    for text in (body, balanced(raw), None if first < 0 else raw[first : last + 1 if last >= first else None]):
        if text and (fixed := _repaired(text)):
            return True, "json_repaired", fixed, None
    if (found := _yaml(body)) is not None:
        return True, "yaml", json.dumps(found, default=str), None
    return False, None, None, "truncated_json" if body.startswith(("{", "[")) and balanced(body) is None else "invalid_json"


@F.pandas_udf(RECOVERED)
def _recover_rest(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([recover(x) for x in raw], columns=["ok", "format", "json", "error_type"])


def recovered(df: DataFrame, raw: str) -> DataFrame:
    """Adds `parsed`. Valid JSON is settled by built-ins; only the rest reaches Python."""
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    good = F.try_parse_json(text).isNotNull() & text.rlike(r"^[\[{]")
    easy = F.when(good, F.struct(F.lit(True).alias("ok"), F.lit("json").alias("format"), text.alias("json"), F.lit(None).cast("string").alias("error_type")))
    marked = df.withColumn("parsed", easy)
    rest = marked.where("parsed is null").withColumn("parsed", _recover_rest(F.col(raw)))
    return marked.where("parsed is not null").unionByName(rest)


def json_kind(c: Column) -> Column:
    """object, array, scalar or invalid, without Python."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.when(kind.isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("scalar")


def key_paths(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, path) of every object key in a column of JSON, as $.a.b[0].c. Depth has no bound, which built-ins can't say without one on rows: in Arrow batches.

    Valid JSON only: rows that don't parse, and scalars, give none.
    """
    parsed = F.when(F.try_parse_json(F.col(raw)).isNotNull(), F.col(raw))
    return df.select(F.col(key), F.explode(_paths(parsed)).alias("path"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(raw: pd.Series) -> pd.Series:
    def walk(text: str | None) -> list[str]:
        out: list[str] = []
        todo = [("$", json.loads(text))] if text is not None else []
        while todo:
            at, value = todo.pop()
            for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
                path = f"{at}.{k}" if isinstance(value, dict) else f"{at}[{k}]"
                if isinstance(value, dict):
                    out.append(path)
                todo.append((path, v))
        return out

    return raw.map(walk)
