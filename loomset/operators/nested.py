"""Units, turns and references inside a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset import patterns as P


def exposed(units: Column) -> Column:
    """Units that users may see: not marked as hidden (null is visible) and no implementation hint."""
    return F.filter(units, lambda u: ~u["expose_to_user"].eqNullSafe(False) & ~u["type"].eqNullSafe("implementation_hint"))


def ids(units: Column, name: str = "unit_id") -> Column:
    return F.transform(units, lambda u: u[name])


def pick(units: Column, wanted: Column) -> Column:
    """The units with the wanted ids, in the order of those; unknown ids are left out."""
    table = F.map_from_entries(F.transform(units, lambda u: F.struct(u["unit_id"], u)))
    return F.array_compact(F.transform(wanted, lambda i: F.try_element_at(table, i)))


def unknown_refs(wanted: Column, units: Column) -> Column:
    return F.array_except(wanted, ids(units))


def remap(wanted: Column, table: Column) -> Column:
    return F.transform(wanted, lambda i: F.coalesce(F.try_element_at(table, i), i))


def texts_of(units: Column, types: tuple[str, ...]) -> Column:
    held = F.transform(F.filter(units, lambda u: u["type"].isin(*types)), lambda u: F.trim(u["text"]))
    return F.array_distinct(F.filter(held, lambda x: x != ""))


def with_utterances(turns: Column, utterances: Column) -> Column:
    """Turns with their utterances by turn_id; empty where there is none."""
    table = F.map_from_entries(F.transform(utterances, lambda u: F.struct(u["turn_id"], u["user_utterance"])))
    return F.transform(turns, lambda t: t.withField("user_utterance", F.coalesce(F.try_element_at(table, t["turn_id"]), F.lit(""))))


def leaked_texts(units: Column, text: Column) -> Column:
    """Texts of hidden units that stand in a text, in any case."""
    hidden = F.filter(units, lambda u: u["expose_to_user"].eqNullSafe(False) | u["type"].eqNullSafe("implementation_hint"))
    told = F.transform(hidden, lambda u: F.lower(F.trim(u["text"])))
    return F.filter(told, lambda x: (x != "") & F.contains(F.lower(text), x))


def unresolved(turns: Column) -> Column:
    """Ids of turns that are wrong or speculative, by operation or claim, and that nothing resolves: no resolution after the first turn names them,
    and none after them carries a claim."""
    placed = F.transform(turns, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    solving = F.filter(placed, lambda r: r["t"]["operation"].isin(*P.RESOLUTION) & (r["i"] > 0))
    named = F.flatten(F.transform(solving, lambda r: r["t"]["revises_turns"]))
    loaded = F.filter(solving, lambda r: (F.size(r["t"]["activates_claims"]) > 0) | (F.size(r["t"]["deactivates_claims"]) > 0))
    last = F.coalesce(F.array_max(F.transform(loaded, lambda r: r["i"])), F.lit(-1))
    wrong = F.filter(placed, lambda r: F.coalesce(r["t"]["operation"].isin(*P.WRONG_OR_SPECULATIVE), F.lit(False)) | F.coalesce(r["t"]["claim_status"].isin("speculative", "mistaken"), F.lit(False)))
    return F.transform(F.filter(wrong, lambda r: ~F.array_contains(named, r["t"]["turn_id"]) & (r["i"] >= last)), lambda r: r["t"]["turn_id"])


def best_revision(units: Column, priority: dict[str, int]) -> Column:
    """The unit of the best type, the first of equals."""
    table = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))
    held = F.transform(units, lambda u, i: F.struct(F.try_element_at(table, u["type"]).alias("p"), i.alias("i"), u.alias("u")))
    return F.array_min(F.filter(held, lambda r: r["p"].isNotNull()))["u"]


def path_order(turns: Column) -> Column:
    """Whether the ids are T1 to Tn in order."""
    return ids(turns, "turn_id") == F.transform(turns, lambda t, i: F.concat(F.lit("T"), i + 1))
