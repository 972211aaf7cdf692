"""Personal data: exact expressions, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone")
_SPACE = "\x20\t\n\r\x0b\x0c"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLACE = re.compile(r"[0-9@]|\[at\]|\(at\)")
_WORD = re.compile(rf"[^{_SPACE}]*+")
_BLANKS = re.compile(rf"[{_SPACE}]*+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base expressions, by kind and then start. Time in proportion to the text: no start is tried twice."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            found.append(("email", start, end))
        else:
            end = at + 1  # this sign and all before it can be in no later match
        at = text.find("@", end)
    end = 0
    for run in _RUN.finditer(text):  # a match starts where a run of digits does
        if run.start() >= end and (m := _IP.match(text, run.start())):
            end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), end))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# The labelled table ---------------------------------------------------------------------------------------------------

#: Marked sentences, {kind|text}; 9 stands for any digit and x for any lower-case letter inside braces.
MARKED = (
    "Call me at {phone|(999) 555-9999} tomorrow", "My number is {phone|999-555-9999} thanks", "Phone {phone|999.555.9999} or come by", "tel {phone|+99 999 9999 999} office",
    "Reach us on {phone|+1 (999) 555-9999} now", "She left {phone|0999 999 9999} as contact", "fax {phone|(099) 9999-9999}, please", "mobile {phone|+99 (9) 99 99 99 99} anytime", "Appelez le {phone|09 99 99 99 99} demain",
    "Telefon: {phone|099 9999999} abends", "Tel. {phone|0999/9999999} oder", "ring {phone|(999)999-9999} first", "number {phone|9999999999} is mine", "Anruf unter {phone|+99-999-9999999} bitte",
    "Write to {email|xxxx.xx@xxxxxx.com} today", "mail {email|xxx99@xxxx} soon", "contact {email|xxxx[at]xxxxx.com} for more", "use {email|xxx(at)xxxx(dot)org} instead", "Send it to {email|xxxxx_xx@xxx.xxxx.net}, thanks", "Mail an {email|xxxx-xxx@xxx.de} bitte",
    "server {ip|99.9.99.199} is down", "from {ip|199.99.9.99} came noise", "host {ip|fe99::9ff:fe99:9} answered", "gateway {ip|2009:db9::9} replied",
    "card {card|4999 9999 9999 9999} was used", "paid with {card|4999-9999-9999-9999} yesterday", "the card {card|5999.9999.9999.9999} expired", "account {card|4999999999999999} please",
)
#: Sentences without personal data, marked in the same way.
UNMARKED = (
    "Version {9.9.9} came out", "Licensed under CC BY-NC {9.9.}", "the License, Version {9.9.}", "License, version {9.}", "in the year {9999} it was", "it cost {$99.99} then", "at {99:99} sharp", "on {9999-99-99} we met",
    "chapter {99} and chapter {9,}", "some {9,999,999} people", "item {#99} is gone", "build {v9.99.9} passed", "water is {x9x,} they said", "a set of {99-99} pages", "ratio {9.99} or {9/9}", "password={x9xx99xx9x9x99x9} here", 'token = "{x99x9x9xx9x9x9x99xx99x9x9x99x9}" there',
    "key {XXXX9XXX99XX9XXX9X9} leaked", "sha {9x9x9x9x9x9x99xx} done", "room {9x} on floor {9th}", "about {99%} of it", "see {[9]} and {(9)} there", "x{99} y{99}", "order {99999999} shipped", "id {999999} in table {9_9}", "handle {@xxxxx} wrote", "{@9x} said so", "a {9xx-9xx} b", "{99.99.9999} war es", "{9} {9} {9} {9}", "{999} {999} {9999} rows", "there were {999} {999} {9999} people", "years {9999} {9999} and {9999} again", "counts of {99} {999} {9999} in all", "see pages {99} {99} {99} {999}", "steps {9} {9} {9} {9} {9} {9} {99} {99} {99} {99} {99} done", "lottery {9} {99} {99} {99} {99} {99}", "{99} {99} {99} {99} {99} {99} {99}",
)


#: How two or three pieces of personal data stand next to each other.
JOINED = ("{0} {1}", "{0}, {1}", "{0}; {1}", "{0} / {1}", "{0} or {1}", "contacts: {0} {1} {2}", "reach {0}, {1}, {2} now", "both {0} and {1} work", "{0} {1} today", "see ({0}, {1})", "{0} - {1}")


def labelled_table(copies: int = 8, seed: int = 11, joined: int = 40) -> list[list[tuple[str, str]]]:
    """Sentences as (token, label) lists: the marked and unmarked sentences, some times each, with other digits and letters, and each time
    `joined` more in which several pieces of personal data stand next to each other."""
    rng, rows = random.Random(seed), []

    def filled(text: str) -> str:
        return re.sub("[9xX]", lambda m: rng.choice({"9": "0123456789", "x": "abcdefghijklmnoprstuvw", "X": "ABCDEFGHIJKLMNOPQRST"}[m[0]]), text)

    pieces = [m[0] for s in MARKED for m in re.finditer(r"\{\w+\|[^}]*\}", s)]
    for _ in range(copies):
        mixed = [re.sub(r"\{(\d)\}", lambda m, some=rng.sample(pieces, 3): some[int(m[1])], rng.choice(JOINED)) for _ in range(joined)]
        for sentence in (*MARKED, *UNMARKED, *mixed):
            tokens: list[tuple[str, str]] = []
            for part in re.split(r"([^\s{}]*\{[^}]*\}\S*)", sentence):
                marked = re.fullmatch(r"([^\s{}]*)\{(?:(\w+)\|)?([^}]*)\}(\S*)", part)
                if not marked:
                    glued = bool(tokens) and not part.startswith(" ") or not tokens
                    tokens += [(w, "O") for w in part.split()] if part.strip() or glued else []
                    continue
                kind = marked[2]
                words = [w for w in (marked[1] + filled(marked[3]) + marked[4]).split()]
                tokens += [(w, "O" if not kind else ("B-" if i == 0 or kind in ("email", "ip") else "I-") + kind) for i, w in enumerate(words)]
            rows.append(tokens)
    return rows


# Features and the field -----------------------------------------------------------------------------------------------


def _class(c: str) -> str:
    return "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c


@lru_cache(1 << 14)
def _shapes(token: str) -> tuple[str, str]:
    full = "".join(map(_class, token))
    return full, re.sub(r"(?s)(.)\1+", r"\1", full)


def shapes(token: str) -> tuple[str, str]:
    """A token's shape, and the same with runs collapsed. Long tokens aren't remembered."""
    return _shapes(token) if len(token) <= 64 else _shapes.__wrapped__(token)


def sensitive(token: str) -> bool:
    return bool(_PLACE.search(token))


def own_features(token: str) -> list[str]:
    core = token.strip("\"'.,;:!?")
    full, short = shapes(core)
    digits = sum("0" <= c <= "9" for c in core)
    return ["s=" + short, "S=" + full, f"d={min(digits, 20)}", f"a={'@' in core}{'[at]' in core or '(at)' in core}", f"c={core.count('.')}{core.count(':')}", "x=" + "".join(sorted(set(short)))]


def near_features(token: str, where: str) -> list[str]:
    if not token:
        return [f"{where}none"]
    word = token.strip("\"'.,;:!?()").lower()
    return [f"{where}s={shapes(token)[1]}"] + ([f"{where}w={word}"] if word.isalpha() else [])


@dataclass
class Field:
    """Weights of the chain: emission (feature x label), transition and start (from a plain token, which is O)."""

    index: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def emit(self, before: str, tokens: list[str], after: str) -> np.ndarray:
        own = [self._own(t) for t in tokens]
        around = [before, *tokens, after]
        return np.array([o + self._near(around[i], "-") + self._near(around[i + 2], "+") for i, o in enumerate(own)])

    def _sum(self, features: list[str]) -> np.ndarray:
        at = [i for f in features if (i := self.index.get(f)) is not None]
        return self.emission[at].sum(0) if at else np.zeros(len(LABELS))

    def _own(self, token: str) -> np.ndarray:
        return self._sum(own_features(token))

    def _near(self, token: str, where: str) -> np.ndarray:
        return self._sum(near_features(token, where))


def _islands(tokens: list[tuple[str, str]]) -> Iterator[tuple[str, list[str], str, list[int]]]:
    """Maximal runs of sensitive tokens of a labelled sentence, with the tokens beside them. All others are O."""
    at = 0
    while at < len(tokens):
        if not sensitive(tokens[at][0]):
            at += 1
            continue
        end = at
        while end < len(tokens) and sensitive(tokens[end][0]):
            end += 1
        yield tokens[at - 1][0] if at else "", [t for t, _ in tokens[at:end]], tokens[end][0] if end < len(tokens) else "", [LABELS.index(y) for _, y in tokens[at:end]]
        at = end


def _allowed() -> np.ndarray:
    """Transitions: I- follows B- or I- of its kind only."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b.startswith("I-"):
            ok[:, j] = [0 if a[2:] == b[2:] else -1e4 for a in LABELS]
    return ok


def train(rows: list[list[tuple[str, str]]], epochs: int = 60, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Fits the field to a small labelled table by the gradient of the log-likelihood (forward-backward), with AdaGrad."""
    data = [x for row in rows for x in _islands(row)]
    index: dict[str, int] = {}
    seen = []
    for before, tokens, after, y in data:
        around = [before, *tokens, after]
        seen.append(([[index.setdefault(f, len(index)) for f in own_features(t) + near_features(around[i], "-") + near_features(around[i + 2], "+")] for i, t in enumerate(tokens)], y))
    n = len(LABELS)
    field = Field(index, np.zeros((len(index), n)), np.zeros((n, n)), np.zeros(n), np.zeros(n))
    fixed, first = _allowed(), np.array([-1e4 if b.startswith("I-") else 0.0 for b in LABELS])
    squares = [np.full_like(w, 1e-2) for w in (field.emission, field.transition, field.start, field.end)]
    order, rng = np.arange(len(seen)), np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        for batch in np.array_split(order, max(1, len(order) // 64)):
            grads = [decay * w for w in (field.emission, field.transition, field.start, field.end)]
            for k in batch:
                feats, y = seen[k]
                e = np.array([field.emission[f].sum(0) for f in feats])
                node, edge = _marginals(e, field.transition + fixed, field.start + first, field.end)
                for t, f in enumerate(feats):
                    g = node[t].copy()
                    g[y[t]] -= 1
                    np.add.at(grads[0], f, g / len(batch))
                for t in range(1, len(y)):
                    edge[t - 1][y[t - 1], y[t]] -= 1
                    grads[1] += edge[t - 1] / len(batch)
                ends = node[[0, -1]].copy()
                ends[0][y[0]] -= 1
                ends[1][y[-1]] -= 1
                grads[2] += ends[0] / len(batch)
                grads[3] += ends[1] / len(batch)
            for w, g, s in zip((field.emission, field.transition, field.start, field.end), grads, squares):
                s += g * g
                w -= rate * g / np.sqrt(s)
    field.transition += fixed
    field.start += first
    return field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(e: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    a, b = [start + e[0]], [end]
    for x in e[1:]:
        a.append(_lse(a[-1][:, None] + t, 0) + x)
    for x in e[:0:-1]:
        b.append(_lse(t + (x + b[-1])[None, :], 1))
    b = b[::-1]
    z = _lse(a[-1] + end, 0)
    node = np.exp(np.array(a) + np.array(b) - z)
    return node, [np.exp(a[i][:, None] + t + (e[i + 1] + b[i + 1])[None, :] - z) for i in range(len(e) - 1)]


def viterbi(emissions: list[np.ndarray], field: Field, block: int = 1 << 16) -> list[np.ndarray]:
    """The best labels of each island; islands of like length are decoded together, at most `block` tokens at a time."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order) and (end == at or len(emissions[order[end]]) * (end - at + 1) <= block):
            longest = len(emissions[order[end]])
            end += 1
        some, n = order[at:end], len(LABELS)
        size = np.array([len(emissions[i]) for i in some])
        e = np.zeros((len(some), longest, n))
        for row, i in enumerate(some):
            e[row, : size[row]] = emissions[i]
        back = np.zeros((longest, len(some), n), np.int8)
        score = e[:, 0] + field.start
        last = np.where((size == 1)[:, None], score + field.end, -np.inf)
        for t in range(1, longest):
            paths = score[:, :, None] + field.transition[None]
            back[t] = paths.argmax(1)
            score = paths.max(1) + e[:, t]
            last = np.where((size == t + 1)[:, None], score + field.end, last)
        label = last.argmax(1)
        best = np.zeros((len(some), longest), int)
        for t in range(longest - 1, -1, -1):
            ends = size - 1 == t
            inside = size - 1 > t
            if t + 1 < longest:
                label = np.where(inside, back[t + 1][np.arange(len(some)), np.where(inside, best[:, t + 1], 0)], label)
            best[:, t] = np.where(ends, last.argmax(1), label)
        for row, i in enumerate(some):
            out[i] = best[row, : size[row]]
        at = end
    return out


def islands_of(text: str) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """Runs of sensitive tokens of a text: the token before, the places of the run's tokens, the token after."""
    held: list[tuple[int, int]] = []
    floor = 0
    for m in _PLACE.finditer(text):
        if m.start() < floor:
            continue
        start = max(text.rfind(c, floor, m.start()) for c in _SPACE) + 1
        start = max(start, floor)
        end = _WORD.match(text, m.start()).end()
        if held and text[held[-1][1] : start].strip(_SPACE):
            yield _beside(text, held)
            held = []
        held.append((start, end))
        floor = end
    if held:
        yield _beside(text, held)


def _beside(text: str, held: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], str]:
    end = held[0][0]
    while end and text[end - 1] in _SPACE:
        end -= 1
    start = end
    while start and text[start - 1] not in _SPACE:
        start -= 1
    after = _BLANKS.match(text, held[-1][1]).end()
    return text[start:end], held, text[after : _WORD.match(text, after).end()]


def _holds(kind: str, span: str) -> bool:
    """The exact check that a decoded span must pass."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in span)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9](?:@|\[at\]|\(at\))[A-Za-z0-9]", span))
    try:
        return bool(ipaddress.ip_address(span))
    except ValueError:
        return False


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the quotes and punctuation around it, and without a bracket whose other half lies outside."""
    while start < end:
        inside = text[start:end]
        if text[start] in "([" and text[end - 1] in ")]" and not set(inside[1:-1]) & set("()[]"):
            start, end = start + 1, end - 1
        elif text[start] in "\"'<,;:" or (text[start] in "([" and inside.count("(") + inside.count("[") > inside.count(")") + inside.count("]")):
            start += 1
        elif text[end - 1] in "\"'.,;:!?>-/\x20" or (text[end - 1] in ")]" and inside.count("(") + inside.count("[") < inside.count(")") + inside.count("]")):
            end -= 1
        else:
            break
    return start, end


def _parts(text: str, places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The tokens of an overlong span, cut where a piece seems to begin: at an opening bracket or plus sign, or after a sign that separates."""
    out: list[list[tuple[int, int]]] = []
    for s, e in places:
        if not out or text[s] in "(+" or text[out[-1][-1][1] - 1] in ",;/":
            out.append([])
        out[-1].append((s, e))
    return out


def find_all(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind and then start. A decoded span that touches a base span is left out; one that fails the
    exact check of its kind is tried in parts."""
    out, runs, whose = [], [], []
    for i, text in enumerate(texts):
        out.append([(*x, True) for x in base_spans(text)])
        for run in islands_of(text):
            runs.append(run)
            whose.append(i)
    emissions = [field.emit(before, [texts[i][s:e] for s, e in places], after) for (before, places, after), i in zip(runs, whose)]
    for labels, (_, places, _), i in zip(viterbi(emissions, field), runs, whose):
        text, base = texts[i], [x for x in out[i] if x[3]]
        at = 0
        while at < len(labels):
            name = LABELS[labels[at]]
            end = at + 1
            while end < len(labels) and LABELS[labels[end]] == "I-" + name[2:]:
                end += 1
            if name != "O":
                whole = places[at:end]
                for part in [whole] if _holds(name[2:], text[slice(*_trimmed(text, whole[0][0], whole[-1][1]))]) else _parts(text, whole):
                    s, e = _trimmed(text, part[0][0], part[-1][1])
                    if _holds(name[2:], text[s:e]) and not any(b < e and s < f for _, b, f, _ in base):
                        out[i].append((name[2:], s, e, False))
            at = end
    return [sorted(x, key=lambda y: (KINDS.index(y[0]), y[1], y[2])) for x in out]


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find(docs: DataFrame, rows: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """The rows and columns of `docs`, and pii_spans: kind, start, end (code points, end exclusive), base, by kind and start.

    base spans are those of the exact expressions; the others are decoded by the field, which is trained on `rows` (by default
    labelled_table()). Tokens without a digit, an at sign or its spelling are O by construction, so only runs of other
    tokens are decoded; the result is that of decoding whole texts. Null and empty texts give no span; null ids, repeated
    rows, extra columns and empty tables pass through; a column pii_spans is replaced. One pass, no shuffle.
    """
    common.tune(docs.sparkSession)
    field = train(labelled_table() if rows is None else rows)
    plain = docs.drop("pii_spans") if "pii_spans" in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in x] for x in find_all(common.texts_of(batch), field)]
            names = [*batch.schema.names, "pii_spans"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _TYPE)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, pii_spans {SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    told = lambda held: F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii_spans", lambda x: x["base"])
    return found.select(
        "doc_id", *(F.size(F.array_remove(F.transform(base, lambda x: x["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"),
    )


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for span in sorted(spans, key=lambda x: (x["start"], x["end"], KINDS.index(x["kind"]))):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(found: DataFrame) -> DataFrame:
    """The columns that find() got, spans replaced in the text. Time in proportion to the text; n_chars follows where the text changes."""
    common.tune(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != "pii_spans"}
            spans = common.column_of(batch, "pii_spans")
            texts = [redacted(t, s) if t and s else t for t, s in zip(common.column_of(batch, "text"), spans)]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                lengths = [len(t) if s else n for t, s, n in zip(texts, spans, common.column_of(batch, "n_chars"))]
                columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "pii_spans")
    return found.mapInArrow(run, fields)
