"""Column functions on strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset import patterns as P


def like(c: Column, pattern: str, flags: str = "i") -> Column:
    """Whether a pattern is found. `flags` as in (?flags); `d` is added where lines matter, so that only \\n ends one."""
    flags = flags + ("d" if "m" in flags else "")
    return F.coalesce(c, F.lit("")).rlike(f"(?{flags}){pattern}" if flags else pattern)


def first_nonempty(*cs: Column) -> Column:
    """The first value that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def strip(c: Column) -> Column:
    """Without ASCII white space at the ends; trim() takes blanks only. A pattern that ends in $ would take the square of a run of blanks."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n")


def title(c: Column) -> Column:
    """The first line that isn't blank or a comment, without # and blanks at its ends."""
    held = F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.startswith("<!--"))
    return F.coalesce(F.regexp_replace(F.get(held, F.lit(0)), r"^[# ]+|[# ]+$", ""), F.lit("Repository issue"))


#: Words that name an issue's type, tried in this order.
ISSUE_WORDS = {
    "bug": ("error", "failed", "fails", "bug", "traceback", "exception"),
    "feature": ("feature", "support", "option", "enable", "allow"),
    "upgrade": ("deprecat", "upgrade", "version"),
}


def issue_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F
    for kind, words in ISSUE_WORDS.items():
        out = out.when(low.rlike("|".join(words)), kind)
    return out.otherwise("maintenance")


def section(c: Column, names: list[str]) -> Column:
    """The lines after the first one that has one of the names, up to the next heading.

    One pass over the lines: what a lambda refers to outside itself is computed again for each element, so the lines, and those after the name,
    are bound as elements of arrays of one.
    """
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    first = lambda held, test: F.array_position(F.transform(held, test), F.lit(True)).cast("int")
    named = lambda x: F.lower(x).rlike("|".join(names))
    heading = lambda x: F.ltrim(x).startswith("#")
    after = lambda held: bound(first(held, named), lambda at: F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(held, at + 1, F.size(held) - at)))
    body = lambda held: bound(first(held, heading), lambda end: F.when(end == 0, held).otherwise(F.slice(held, F.lit(1), end - 1)))
    return strip(F.array_join(bound(bound(lines(c), after), body), "\n"))


def error_block(c: Column, most: int = 12) -> Column:
    """The first fenced block if it names an error; else the first lines that do, or that fail."""
    fence = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)```(.*?)```", 1)
    told = F.filter(lines(c), lambda x: x.rlike(r"(?i)error|traceback|exception|fail"))
    return F.when(fence.rlike(r"(?i)error|traceback|exception|failed"), strip(fence)).otherwise(strip(F.array_join(F.slice(told, 1, most), "\n")))


def patch_of(c: Column) -> Column:
    """From the first diff marker to the end, with one line end; empty without a marker."""
    found = strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(?:^|\n)((?:diff --git |--- |\*\*\* Begin Patch).*)$", 1))
    return F.when(found == "", "").otherwise(F.concat(found, F.lit("\n")))


def leaks_metadata(c: Column) -> Column:
    return like(c, P.BENCHMARK_METADATA)


def hints_implementation(c: Column) -> Column:
    return like(c, P.IMPLEMENTATION_HINT, "im")


def uncertain(c: Column) -> Column:
    out = F.lit(False)
    for p in P.UNCERTAINTY:
        out = out | like(c, p)
    return out


#: What makes a leak private.
PRIVATE = r"\boracle\b|\bgold\b|FAIL_TO_PASS|PASS_TO_PASS|test_patch|reference\s+patch|diff\s+--git|hidden\s+tests?|\braw_llm_outputs\b|\btest_[A-Za-z0-9_]+\b"
#: What private phrases become.
SCRUBBED = (
    (r"(?i)FAIL_TO_PASS", "private failing-test metadata"),
    (r"(?i)PASS_TO_PASS", "private regression-test metadata"),
    (r"(?i)reference\s+patch", "implementation details"),
    (r"(?i)hidden\s+test", "private test"),
    (r"(?i)diff --git", "implementation diff"),
    (r"\btest_[A-Za-z0-9_]+\b", "private_test"),
    (r"(?i)\btests/[A-Za-z0-9_./-]+", "private test file"),
)


def leak_severity(c: Column) -> Column:
    return F.when(like(c, PRIVATE), "private_or_evaluator_leakage").otherwise("benchmarkish_or_implementation_hint")


def scrub(c: Column) -> Column:
    """Private phrases, test names and test paths in general words; trimmed. Changed where it differs from the text before."""
    for pattern, other in SCRUBBED:
        c = F.regexp_replace(c, pattern, other)
    return strip(c)


def public_text(c: Column) -> Column:
    """Calls of named functions in general words, white space as single blanks."""
    call = r"call\s+[A-Za-z_][A-Za-z0-9_.]*\([^)]*\)"
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\bthen\s+{call}", "then trigger that case")
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?i)\b{call}", "trigger that case"), r"[ \t\n\r\x0b\x0c]+", " "))


#: First queries by persona; {0} repository, {1} title.
QUERIES = {
    "novice": "Can you help me with something odd in `{0}`? It seems related to: {1}.",
    "impatient": "I need a quick fix for `{0}`. I think the issue is: {1}.",
    "uncertain": "Can you help me check an issue in `{0}`? I may be wrong, but it looks like {1}.",
    "default": "Can you help me with this `{0}` issue: {1}?",
}


def initial_query(repo: Column, problem: Column, style: Column) -> Column:
    short = F.rtrim(F.left(F.trim(F.regexp_replace(title(problem), r"[ \t\r\x0b\x0c]+", " ")), F.lit(160)))
    told = lambda t: F.concat(*(repo if x == "{0}" else short if x == "{1}" else F.lit(x) for x in re.split(r"(\{[01]\})", t)))
    out = F
    for name, t in QUERIES.items():
        if name != "default":
            out = out.when(style == name, told(t))
    return out.otherwise(told(QUERIES["default"]))


def simulated_reply(problem: Column, message: Column) -> Column:
    """The simulated user's answer by what the message asks for, in this order."""
    m = F.lower(message)
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    return (
        F.when(m.rlike("reproduce|repro|steps|example|code"), or_else(section(problem, ["steps to reproduce", "reproduce", "code to reproduce"]), "I do not have a smaller repro handy beyond what I already described."))
        .when(m.rlike("error|traceback|exception|stack"), or_else(error_block(problem), "I do not have the full traceback handy."))
        .when(m.rlike("expected|want|should"), or_else(section(problem, ["expected behavior", "expected"]), "I mainly want the issue fixed without breaking existing behavior."))
        .when(m.rlike("run|test|verify"), "I cannot run code right now; please run the relevant tests in the repository.")
        .when(m.rlike("i will|i'm going to|i found|i think|next i"), "Sounds good.")
        .otherwise("I am not sure. What specific detail would help you?")
    )


def revised_reply(c: Column) -> Column:
    """A user's reply kept short and in its role; later rules win."""
    text = strip(c)
    words, low = F.filter(F.split(text, r"[ \t\n\r]+"), lambda x: x != ""), F.lower(text)
    short = F.when(F.size(words) > 180, F.array_join(F.slice(words, 1, 120), " ")).otherwise(text)
    return (
        F.when(low.rlike("problem statement|as a simulator"), "I can only share the details I have from seeing the issue.")
        .when(low.rlike("i ran|i will run|i'll run|i can test that"), "I cannot run code right now; please run the relevant check on your side.").otherwise(short)
    )


def persona(c: Column, n: int = 5) -> Column:
    """A number below n from the SHA-256 of a key: the same on every run and engine."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % n).cast("bigint")


def slug(c: Column, most: int = 80) -> Column:
    name = F.left(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", ""), F.lit(most))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("llm_call"))


def error_type(code: Column) -> Column:
    return F.when(code.isin(408, 504), "timeout").when(code == 429, "rate_limited").when(code.between(500, 599), "server_error").when(code.between(400, 499), "client_exception").otherwise("unknown")


def redact_url(c: Column) -> Column:
    return F.regexp_replace(c, r"\?.*$", "?<redacted>")
