"""Rules as data: a rule is a condition and what it says; a list of them folds to messages and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """broken: when the rule is broken (null counts as not). text: its message, a string or a Column; each: an array of messages instead."""

    broken: Column | None = None
    text: str | Column = ""
    each: Column | None = None
    soft: bool = False


def _messages(rules: Sequence[Rule], soft: bool) -> Column:
    parts = []
    for r in rules:
        if r.soft == soft:
            said = r.text if isinstance(r.text, Column) else F.lit(r.text)
            parts.append(r.each if r.each is not None else F.array_compact(F.array(F.when(r.broken, said))))
    return F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")


def errors(rules: Sequence[Rule]) -> Column:
    return _messages(rules, False)


def warnings(rules: Sequence[Rule]) -> Column:
    return _messages(rules, True)


def at_each(items: Column, broken, said) -> Column:
    """A message for each item that breaks a rule; both take the item and its place."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(broken(x, i), said(x, i))))
