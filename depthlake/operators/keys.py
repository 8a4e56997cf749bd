"""Comparable keys of names in any Unicode form, by coding the distinct values of a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from depthlake.functions.text import nfkc

PLAIN = r"^[\x00-\x7F]*$"


def compatible(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with ``into``: the compatibility form (NFKC) of a text column.

    Spark has no such function, so each distinct value beyond ASCII is normalised once in an Arrow
    batch and joined back; ASCII is its own form.  Keys, not texts: a column of names has far fewer
    values than rows.
    """
    odd = df.select(F.col(column).alias("__value")).filter(~F.col("__value").rlike(PLAIN)).distinct().withColumn("__form", nfkc(F.col("__value")))
    joined = df.join(odd, df[column] == F.col("__value"), "left")
    return joined.select(*[df[c] for c in df.columns if c != into], F.coalesce("__form", df[column]).alias(into))


def with_key(df: DataFrame, column: str, into: str, key: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``into``: ``key`` (a well, pair or text key) of the compatibility form.

    The form is taken before anything else, so full-width letters, ligatures and the numero sign
    glued to a word count as what they stand for.
    """
    return compatible(df, column, "__compatible").withColumn(into, key(F.col("__compatible"))).drop("__compatible")
