"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the shares of its words that fall into each of `buckets` hash buckets, `STATS` structure
statistics, and the metadata columns named in `metadata` (hashed values; none by default). The machine scores
w0 + sum(w x) + 1/2 sum_f((sum v_f x)^2 - sum v_f^2 x^2): pairwise interactions in time linear in the features.

Fitting uses a bounded sample (`max_rows` labelled rows with `max_bytes` of text, those of the smallest hash of their id). Scoring covers every
whole text in blocks of rows.

Defined results: null and empty texts are scored from their (zero) statistics, so they have a score between 0 and 1 as
all others do. Rows with a null label are not learnt from. With no labelled rows, or one label only, every score is the
share of label 1 (0.5 if there is none). Null metadata is a value of its own. Repeated rows repeat their score and are learnt from once; columns
other than `keep` are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, sample_rows, slices

STATS = 14


def statistics(words: Words) -> np.ndarray:
    """Rows x STATS: shares and logarithms of what stands in each whole text."""
    buf, n = words.buf, words.n_rows
    ends = np.concatenate([words.row_start[1:], [len(buf)]])
    size = (ends - words.row_start - 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(mask, words.row_start, dtype=np.int64).astype(np.float64)
        return total / np.maximum(size, 1)

    upper = (buf >= 65) & (buf <= 90)
    lower = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    digit = (buf >= 48) & (buf <= 57)
    space = (buf == 32) | (buf == 10)
    line = buf == 10
    stop = (buf == 46) | (buf == 63)
    mark = ~(upper | lower | digit | space)
    length = (words.end - words.start).astype(np.float64)
    bounds = words.first_of_row()
    count = np.diff(bounds).astype(np.float64)
    per = np.maximum(count, 1)
    long_words = np.bincount(words.row, length, n) / per
    squares = np.bincount(words.row, length * length, n) / per
    key = mix(words.code + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(words.row[at], minlength=n)
    return np.stack([share(upper), share(lower), share(digit), share(space), share(line) * 10, share(stop) * 10, share(mark), share((buf == 33) | (buf == 35) | (buf == 36) | (buf == 37) | (buf == 38) | (buf == 42)), share(buf == 124), long_words / 10, np.sqrt(np.maximum(squares - long_words**2, 0)) / 10, distinct / per, np.log1p(count) / 10, (count == 0) * 1.0], axis=1)


class Batch:
    """Features of several texts in compressed rows: `at[k]:at[k+1]` of `index` and `value`."""

    def __init__(self, texts: list[str], buckets: int, metadata: list[list[str]] = ()):
        plain = Words(texts, lower=False)
        n = len(texts)
        bucket = (plain.code >> np.uint64(17)).astype(np.int64) % buckets
        key, times = np.unique(plain.row.astype(np.int64) * buckets + bucket, return_counts=True)
        row, index = key // buckets, key % buckets
        total = np.bincount(row, times, n)
        value = np.sqrt(times / np.maximum(total[row], 1))
        stats = statistics(plain)
        rows, indexes, values = [row, np.repeat(np.arange(n), STATS)], [index, np.tile(np.arange(STATS) + buckets, n)], [value, stats.ravel()]
        for k, column in enumerate(metadata):
            rows.append(np.arange(n))
            indexes.append(np.array([buckets + STATS + (hash_text(f"{k}:{v}") % 1024) for v in column], np.int64))
            values.append(np.ones(n))
        row, index, value = map(np.concatenate, (rows, indexes, values))
        order = np.argsort(row, kind="stable")
        self.index, self.value = index[order], value[order].astype(np.float32)
        self.at = np.searchsorted(row[order], np.arange(n + 1))


def hash_text(text: str) -> int:
    out = 14695981039346656037
    for b in text.encode():
        out = ((out ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return out


class FactorMachine:
    def __init__(self, size: int, rank: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.weight = np.float32(0), np.zeros(size, np.float32)
        self.factor = (rng.standard_normal((size, rank)) * 0.02).astype(np.float32)

    def parts(self, index, value, at):
        v = self.factor[index] * value[:, None]
        sums = np.add.reduceat(v, at[:-1], axis=0)
        squares = np.add.reduceat(v * v, at[:-1], axis=0)
        linear = np.add.reduceat(self.weight[index] * value, at[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, b: Batch, y: np.ndarray, epochs: int, rate: float, decay: float, seed: int = 7) -> None:
        rng, n = np.random.default_rng(seed), len(y)
        block = max(16, min(256, n // 12))
        g_w, g_v, g_b = np.full_like(self.weight, 1e-6), np.full_like(self.factor, 1e-6), 1e-6
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // block)):
                take = np.concatenate([np.arange(b.at[r], b.at[r + 1]) for r in rows])
                at = np.concatenate([[0], np.cumsum([b.at[r + 1] - b.at[r] for r in rows])])
                index, value = b.index[take], b.value[take]
                score, sums = self.parts(index, value, at)
                err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
                each = np.repeat(err, np.diff(at))
                used, inverse = np.unique(index, return_inverse=True)
                d_w = np.bincount(inverse, each * value, len(used)).astype(np.float32) + decay * self.weight[used]
                full = (each * value)[:, None] * (np.repeat(sums, np.diff(at), axis=0) - self.factor[index] * value[:, None])
                order = np.argsort(inverse, kind="stable")
                d_v = np.add.reduceat(full[order], np.searchsorted(inverse[order], np.arange(len(used))), axis=0) + decay * self.factor[used]
                g_w[used] += d_w * d_w
                g_v[used] += d_v * d_v
                d_b = float(err.sum())
                g_b += d_b * d_b
                self.weight[used] -= rate * d_w / np.sqrt(g_w[used])
                self.factor[used] -= rate * d_v / np.sqrt(g_v[used])
                self.bias -= np.float32(rate * d_b / math.sqrt(g_b))


class QualityModel:
    def __init__(self, machine: FactorMachine | None, prior: float, buckets: int, metadata: tuple[str, ...]):
        self.machine, self.prior, self.buckets, self.metadata = machine, prior, buckets, metadata

    def score(self, texts: list[str], metadata: list[list[str]] = ()) -> np.ndarray:
        if self.machine is None:
            return np.full(len(texts), self.prior)
        out = []
        for a, z in slices(texts):
            b = Batch(texts[a:z], self.buckets, [m[a:z] for m in metadata])
            raw, _ = self.machine.parts(b.index, b.value, b.at)
            out.append(1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(train: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", metadata: tuple[str, ...] = (), max_rows: int = 4000, max_bytes: int = 64 << 20, buckets: int = 1 << 15, rank: int = 8, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5) -> QualityModel:
    rows = train.where(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(id_col).cast("string")).alias("cw_place"), F.coalesce(F.col(text), F.lit("")).alias("cw_text"), F.col(label).cast("int").alias("cw_label"), *[F.col(m).cast("string").alias(f"cw_meta{k}") for k, m in enumerate(metadata)])
    found = sample_rows(rows, max_rows, max_bytes)
    y = np.array([r["cw_label"] for r in found], np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(None, float(y.mean()) if len(y) else 0.5, buckets, metadata)
    b = Batch([r["cw_text"] for r in found], buckets, [[r[f"cw_meta{k}"] for r in found] for k in range(len(metadata))])
    machine = FactorMachine(buckets + STATS + 1024 * bool(metadata), rank)
    machine.bias = np.float32(math.log(y.mean() / (1 - y.mean())))
    machine.fit(b, y, epochs, rate, decay)
    return QualityModel(machine, float(y.mean()), buckets, metadata)


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and score."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("cw_text").to_pylist()]
            got = model.score(texts, [batch.column(f"cw_meta{k}").to_pylist() for k in range(len(model.metadata))])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, docs[text].alias("cw_text"), *[docs[m].cast("string").alias(f"cw_meta{k}") for k, m in enumerate(model.metadata)]).mapInArrow(run, f"{schema}, score double")
