"""Alignment tokens: one tokenizer with parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset import patterns as P


def alignment_tokens(c: Column, stop: Sequence[str] = P.STOP_WORDS, aliases: Mapping[str, str] | None = None) -> Column:
    """Distinct lower-case words of three letters and digits or more, without ing, ed or s at the end of longer ones, without stop words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9]{2,})"), F.lit(1))
    named = (lambda x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv)), x), x)) if aliases else (lambda x: x)

    def stem(x):
        x = named(F.lower(x))
        n = F.length(x)
        cut = lambda k: F.substr(x, F.lit(1), n - k)
        x2 = F.when(x.endswith("ing") & (n > 5), cut(3)).when(x.endswith("ed") & (n > 4), cut(2)).when(x.endswith("s") & (n > 4), cut(1)).otherwise(x)
        return named(x2)

    return F.array_except(F.array_distinct(F.transform(words, stem)), F.array(*map(F.lit, stop)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's tokens that b has; 0 for none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def flat_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def repeats_intent(utterance: Column, objective: Column, prompt: Column) -> Column:
    """Whether a confirmation says the whole intent again."""
    u, o = flat_text(utterance), flat_text(objective)
    ut, ot, pt = alignment_tokens(utterance), alignment_tokens(objective), alignment_tokens(prompt)
    n = F.length(utterance)
    return ((o != "") & F.contains(u, o)) | ((overlap_ratio(ot, ut) >= 0.8) & (n > 100)) | ((overlap_ratio(pt, ut) >= 0.65) & (n > 120))
