"""Looking into postings: listings, the commonest terms, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CELL


def top_terms(grams: DataFrame, n: int, prefix: str = "") -> DataFrame:
    """term, cells: the n terms with most cells; ties by term."""
    rows = grams.where(F.col("term").startswith(prefix)) if prefix else grams
    return rows.select("term", *CELL).distinct().groupBy("term").agg(F.count("*").alias("cells")).orderBy(F.desc("cells"), "term").limit(n)


def listing(grams: DataFrame, prefix: str = "", n: int | None = None) -> DataFrame:
    """term, cells: ascending terms."""
    rows = grams.where(F.col("term").startswith(prefix)) if prefix else grams
    out = rows.select("term", *CELL).distinct().groupBy("term").agg(F.count("*").alias("cells")).orderBy("term")
    return out if n is None else out.limit(n)


def statistics(grams: DataFrame) -> DataFrame:
    """entries, cells over all terms, key_bytes."""
    per = grams.select("term", *CELL).distinct().groupBy("term").agg(F.count("*").alias("cells"))
    return per.agg(F.count("*").alias("entries"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).cast("long").alias("key_bytes"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """table, cells: the sum over keys of their numbers of cells. Each table has a `term` column or is listed by its other columns."""
    out = None
    for name, rows in tables.items():
        key = [c for c in rows.columns if c not in (*CELL, "begin", "end")]
        one = rows.select(*key, *CELL).distinct().agg(F.count("*").alias("cells")).select(F.lit(name).alias("table"), "cells")
        out = one if out is None else out.unionByName(one)
    return out
