"""What the text operators share: folds, shared storage, Arrow plumbing and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 20


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def unused(table: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of `table`."""
    taken = {c.lower() for c in table.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one is set, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cellweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("cellweave.shared.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.
    The table stays until `discard` or `discard_all`, as what reads it may run later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cellweave_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most `rows` rows in what is run within: rows that hold whole texts are long, and each task holds a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches, rows: int = 1000):
    """Arrow batches in slices of at most `rows` rows, which share their memory: what is made of a whole batch of texts (strings, results) would
    stand in memory beside it."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of `materialise` that nothing reads any more."""
    if getattr(table, "cellweave_path", None):
        _delete(table.sparkSession, table.cellweave_path)


def discard_all(spark: SparkSession) -> None:
    """Deletes all tables of this application, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/cellweave-{spark.sparkContext.applicationId}")


def sample_rows(rows: DataFrame, max_rows: int, max_bytes: int) -> list:
    """A bounded sample on the driver: of `rows` (cw_place, a hash; cw_text; others) those of the least places, at most `max_rows` of them
    with at most `max_bytes` of text, in order of place and text. Rows that repeat count once."""
    n = rows.count()
    limit = int(min(1.0, 1.3 * max_rows / max(n, 1)) * (1 << 30))
    near = rows.where(F.pmod("cw_place", F.lit(1 << 30)) <= limit).dropDuplicates()
    sizes = sorted((r["cw_place"], r["size"]) for r in near.select("cw_place", F.octet_length("cw_text").alias("size")).toLocalIterator())[:max_rows]
    if not sizes:
        return []
    within = int(np.searchsorted(np.cumsum([s for _, s in sizes]), max_bytes, side="right"))
    found = near.where(F.col("cw_place") <= sizes[min(within, len(sizes) - 1)][0])
    out, held = [], 0
    for r in sorted(found.toLocalIterator(), key=lambda r: (r["cw_place"], r["cw_text"]))[:max_rows]:
        held += len(r["cw_text"].encode("utf-8", "surrogatepass"))
        if held > max_bytes and out:
            break
        out.append(r)
    return out


def slices(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters; a longer text is a range of its own and stays whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


#: Bytes that make words: ASCII letters, digits, underscore and all of the bytes of other characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True
WORD_BYTE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Odd multipliers by the place of a byte in its word; places past the end take powers of a constant.
PLACE_CODE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of several texts: `start`, `end` in `data`, `row` of the text, 64-bit `code` of the lower-cased bytes."""

    def __init__(self, texts: list[str], lower: bool = True):
        coded = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(coded) + b"\n"
        self.n_rows = len(coded)
        buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        self.row_start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        inside = WORD_BYTE[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.row = np.searchsorted(self.row_start, self.start, side="right") - 1
        self.buf = buf
        self.code = self._codes()

    def _codes(self) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first - self.start, size)
        place = at - np.repeat(self.start, size)
        value = BYTE_CODE[self.buf[at]]
        value *= PLACE_CODE[place & 4095]
        if len(place) and int(place.max()) > 4095:
            value += mix((place >> 12).astype(np.uint64))
        value ^= value >> np.uint64(29)
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64))

    def first_of_row(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit codes of its runs of `width` words; of shorter texts the one run of all their words; none without words."""
    words = Words(texts)
    bounds = words.first_of_row()
    n = len(words.code)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled *= np.uint64(0x100000001B3)
            rolled += words.code[k : n - width + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for i in range(len(texts)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            code = np.uint64(b - a)
            for k in range(a, b):
                code = mix(np.array([code]) + words.code[k : k + 1])[0]
            out.append(np.array([code], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
