"""Paths, symbols and repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions.text import like, strip


def canonical_path(c: Column) -> Column:
    """Slashes forward, leading ./ gone, one a/ or b/ gone, no empty or . part; .. stays, and so do exactly two leading slashes."""
    c = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\\", "/")
    c = F.regexp_replace(c, r"^(\./)+", "")
    c = F.regexp_replace(c, r"^[ab]/", "")
    root = F.when(c.rlike("^//([^/]|$)"), "//").when(c.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    return F.concat(root, F.array_join(parts, "/"))


def canonical_symbol(c: Column) -> Column:
    """path::name with the path made canonical and the name trimmed; without :: unchanged."""
    at = F.instr(c, "::")
    return F.when(at == 0, c).otherwise(F.concat(canonical_path(F.substr(c, F.lit(1), at - 1)), F.lit("::"), strip(F.substr(c, at + 2))))


def repo_slug(c: Column) -> Column:
    clean = F.lower(strip(F.coalesce(c, F.lit(""))))
    at = F.instr(clean, "__")
    clean = F.when(at > 0, F.concat(F.substr(clean, F.lit(1), at - 1), F.lit("/"), F.substr(clean, at + 2))).otherwise(clean)
    name = F.substring_index(clean, "/", -1)
    out = F.when(name == "django", "django").when(F.contains(clean, F.lit("scikit-learn")) | (name == "sklearn"), "scikit-learn")
    for word in ("xarray", "astropy", "pylint", "sympy", "sphinx", "matplotlib", "pytest"):
        out = out.when(F.contains(clean, F.lit(word)), word)
    return out.otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))


def domain(c: Column) -> Column:
    """The repository's domain, by slug; other where it has none."""
    table = F.create_map(*(F.lit(x) for pair in P.DOMAINS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, repo_slug(c)), F.lit("other"))


def is_test_path(c: Column) -> Column:
    return like(c, P.TEST_PATH)


def is_doc_path(c: Column) -> Column:
    return like(c, P.DOC_PATH)


def is_dependency_path(c: Column) -> Column:
    return like(c, P.DEPENDENCY_PATH)


def components_of(paths: Column, depth: int = 2) -> Column:
    """The first parts of each path, distinct and sorted."""
    head = F.transform(paths, lambda p: F.array_join(F.slice(F.filter(F.split(p, "/"), lambda x: x != ""), 1, depth), "/"))
    return F.array_sort(F.array_distinct(F.filter(head, lambda x: x != "")))
