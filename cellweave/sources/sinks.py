"""Where results go."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from html import escape

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, kind: str = "csv", one_file: bool = False) -> None:
    """csv (header, nulls empty), json or html. html is one local file of the driver, written row by row as partitions come in."""
    out = df.coalesce(1) if one_file else df
    if kind == "csv":
        out.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    elif kind == "json":
        out.write.mode("overwrite").json(path)
    elif kind == "html":
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(html_lines(df))
    else:
        raise ValueError(f"unknown kind of output: {kind}")


def html_lines(df: DataFrame) -> Iterator[str]:
    """A table as HTML; nulls are empty cells."""

    def row(values, mark: str) -> str:
        return "<tr>" + "".join(f"<{mark}>{'' if v is None else escape(str(v))}</{mark}>" for v in values) + "</tr>\n"

    yield "<table>\n" + row(df.columns, "th")
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield row(r, "td")
    yield "</table>\n"


def console(df: DataFrame, rows: int = 20) -> str:
    """Header, the first rows and the number of all rows. The query runs once; its rows wait on the executors' disks meanwhile."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        total, taken = held.count(), held.limit(rows).collect()
    finally:
        held.unpersist()
    lines = [" | ".join(df.columns)] + [" | ".join("NULL" if v is None else str(v) for v in r) for r in taken]
    return "\n".join([*lines, f"({total} rows)"])


def features(df: DataFrame, path: str, key: str = "term", partition_by: list[str] | None = None) -> None:
    """A feature table sorted by key in each file, so that a key's lookup skips row groups by their statistics."""
    out = df.sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


@contextmanager
def timed(name: str = "BENCHMARK_EXECUTION_TIME_MS"):
    start = time.perf_counter()
    yield
    print(f"{name}: {(time.perf_counter() - start) * 1000:.3f}")
