"""All text of a nested column, by its schema; cleaning of scalars; parameters by allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_blob(c: Column, kind: T.DataType) -> Column:
    """The values of a nested column, one a line, in the order of its fields. Null and false count as empty."""
    if isinstance(kind, T.StructType):
        return F.array_join(F.array(*(text_blob(c[f.name], f.dataType) for f in kind.fields)), "\n") if kind.fields else F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: text_blob(x, kind.elementType)), "\n"), F.lit(""))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_join(F.transform(F.map_values(c), lambda x: text_blob(x, kind.valueType)), "\n"), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


def with_blob(df: DataFrame, column: str, name: str = "blob") -> DataFrame:
    return df.withColumn(name, text_blob(F.col(column), df.schema[column].dataType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN as null, in every column."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, k in df.dtypes if k in ("double", "float")})


def allowed(params: Column, names: Sequence[str]) -> Column:
    """A map's entries with the given keys."""
    return F.map_filter(params, lambda k, _: k.isin(*names))


def shorten(c: Column, most: int) -> Column:
    """At most `most` characters, cut at a word's end, without dangling small words."""
    cut = F.regexp_replace(F.left(c, F.lit(most + 1)), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(cut, r"(?i)(\s+(a|an|the|of|to|in|on|for|with|and|or|that|when|is))+$", ""))
