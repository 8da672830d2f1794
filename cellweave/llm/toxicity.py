"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

A character trigram model is counted over all texts. Stretches that can hide a word (leetspeak inside a word, runs of
three or more equal letters, single letters apart) become lattices: a digit or sign can stand for itself or for letters,
a repeated letter can be dropped, a separator can be dropped; each change has a cost, and so has a sign or separator that
stays inside. Viterbi decoding under the trigram model picks the restored stretch; the next best readings follow the
text. Other stretches have lattices of one path, which are left as they are.
The restored text's words and word beginnings are scored by logistic regression over those that labelled toxic texts
hold markedly more often.

Fitting uses a bounded sample of labelled rows (`max_rows` with `max_bytes` of text, those of the smallest hash of their id); the trigram counts
cover all rows. Scoring covers whole texts. Lattices know the Latin letters of `LETTERS`; other letters pass as they are.

Defined results: null and empty texts get the score of a text without words. Rows without a label are not learnt from;
without both labels every score is the share of label 1 (0 with no rows). Repeated rows repeat their score and are learnt from once. Of equally
cheap readings the one found first stands. An empty table gives no rows; extra columns are dropped unless in `keep`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, PLACE_CODE, Words, mix, sample_rows, slices

#: Letters of the trigram model; all else is a word's edge. Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Signs and the letters that they stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
WIDE = len(LETTERS) + 1
PLACE = {c: k + 1 for k, c in enumerate(LETTERS)}
CODE = np.zeros(512, np.int64)
for _c, _k in PLACE.items():
    CODE[ord(_c)] = _k
#: Words with a sign inside, or before them; a letter three times or more; three or more single letters apart.
HIDDEN = re.compile(r"(?<![^\W_])(?:[^\W_@$!|+(€]|[@$!|+(€])(?:([ .\-_*])(?:[^\W_]|[@$!|+(€]))(?:\1(?:[^\W_]|[@$!|+(€]))+(?![^\W_])|(?<![^\W_])[@$!|+(€]?[^\W_]*[^\W\d_][0-9@$!|+(€*#]{1,2}[^\W_]+(?:[^\W_]|[@$!|+(€*#])*|(?<![^\W_])[^\W_]*[^\W\d_][@$!|+(€]{1,2}(?![\w@$!|+(€*#])|(?<![\w@$!|+(€*#])[0-9@$!|+(€][^\W\d_](?:[^\W_]|[@$!|+(€*#])+|(?<![^\W_])[^\W_]*([^\W\d_])\2\2[^\W_]*")
#: What every such stretch holds; most texts hold none, and one linear search tells.
CORE = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(€])([ .\-_*])(?:[^\W_]|[@$!|+(€])\1(?:[^\W_]|[@$!|+(€])(?![^\W_])|[^\W\d_][0-9@$!|+(€*#]{1,2}[^\W_]|[^\W\d_][@$!|+(€]{1,2}(?![\w@$!|+(€*#])|(?<![\w@$!|+(€*#])[0-9@$!|+(€][^\W\d_][^\W_@$!|+(€*#]|([^\W\d_])\2\2")
#: Costs of reading a sign as a letter, of leaving it, of dropping a repeated letter, of dropping a separator and of leaving it.
COST_SIGN, COST_LEAVE, COST_DROP, COST_JOIN, COST_PART = 1.0, 6.0, 0.4, 0.3, 4.0
#: Restorations that are kept for a stretch: the best stands in the text, the others follow it.
BEST = 4
REPEATED = re.compile(r"([^\W\d_])\1+")


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: counts over every text; one row a gram and task before the exchange."""

    def run(batches):
        total = np.zeros(WIDE**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, z in slices(texts):
                points = np.frombuffer("\n".join(texts[a:z]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                k = CODE[np.minimum(points, 511)]
                if len(k) > 2:
                    total += np.bincount((k[:-2] * WIDE + k[1:-1]) * WIDE + k[2:], minlength=WIDE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores stretches. `model[a, b, c]`: cost (minus natural logarithm) of letter c after a and b."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(WIDE, WIDE, WIDE).astype(np.float64)
        two = n.sum(axis=0)
        one = two.sum(axis=0)
        p1 = (one + 1) / (one.sum() + WIDE)
        p2 = (two + 2 * p1) / (two.sum(axis=1, keepdims=True) + 2)
        p3 = (n + 4 * p2[None]) / (n.sum(axis=2, keepdims=True) + 4)
        self.model = (-np.log(p3)).astype(np.float32)
        self.known: dict[str, str] = {}
        self.rows: dict[tuple[int, int], list[float]] = {}

    def _row(self, a: int, b: int) -> list[float]:
        found = self.rows.get((a, b))
        if found is None:
            found = self.rows[a, b] = self.model[a, b].tolist()
        return found

    def restore(self, stretch: str) -> list[str]:
        """The `BEST` cheapest readings by Viterbi over (last two letters, last sign read), cheapest first; of equal costs the one found first."""
        found = self.known.get(stretch)
        if found is None:
            states: dict[tuple[int, int, str], list[tuple[float, tuple]]] = {(0, 0, ""): [(0.0, ())]}
            for k, c in enumerate(stretch):
                between = 0 < k < len(stretch) - 1 and c in " .-_*"
                options = [(c, COST_PART if between else 0.0 if c in PLACE else COST_LEAVE)] + [(o, COST_SIGN) for o in LEET.get(c, "")]
                after: dict[tuple[int, int, str], list[tuple[float, tuple]]] = {}
                for (a, b, was), paths in states.items():
                    ways = options + ([("", COST_DROP)] if was == c and c in PLACE else []) + ([("", COST_JOIN)] if between else [])
                    for o, x in ways:
                        p = PLACE.get(o, 0)
                        key, more = ((b, p, c), x + self._row(a, b)[p]) if o else ((a, b, c), x)
                        after.setdefault(key, []).extend([(cost + more, (path, o) if o else path) for cost, path in paths])
                states = {key: sorted(paths, key=lambda v: v[0])[:BEST] for key, paths in after.items()}
            ends = sorted(((cost + self._row(a, b)[0], path) for (a, b, _), paths in states.items() for cost, path in paths), key=lambda v: v[0])
            found = []
            for _, path in ends:
                letters = []
                while path:
                    path, o = path
                    letters.append(o)
                reading = "".join(reversed(letters))
                if reading not in found:
                    found.append(reading)
                if len(found) == BEST:
                    break
            if len(stretch) <= 40:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[stretch] = found
        return found

    def text(self, text: str) -> str:
        low = text.lower()
        if not CORE.search(low):
            return low
        others: list[str] = []

        def read(m: re.Match) -> str:
            best, *rest = self.restore(m[0])
            others.extend(rest)
            return best

        return " ".join([HIDDEN.sub(read, low), *others])


BEGINNINGS = (3, 4, 6)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of each word and of its beginnings of 3, 4 and 6 bytes, and the number of words of each text. Repeated letters count once."""
    w = Words([REPEATED.sub(r"\1", t) for t in texts], lower=False)
    size = w.end - w.start
    rows, codes = [w.row], [w.code]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        code = np.full(len(long), n, np.uint64)
        for k in range(n):
            code += BYTE_CODE[w.buf[w.start[long] + k]] * PLACE_CODE[4000 + k]
        rows.append(w.row[long])
        codes.append(mix(code))
    return np.concatenate(rows), np.concatenate(codes), np.bincount(w.row, minlength=len(texts))


class ToxicityModel:
    def __init__(self, counts: np.ndarray, codes: np.ndarray, weights: np.ndarray, size_weight: float, bias: float):
        self.counts, self.codes, self.weights, self.size_weight, self.bias = counts, codes, weights, size_weight, bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of restored texts."""
        raw = np.full(len(texts), self.bias)
        for a, z in slices(texts):
            row, code, words = features(texts[a:z])
            raw[a:z] += self.size_weight * np.log1p(words)
            if len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                cell, n = np.unique(row[hit] * len(self.codes) + at[hit], return_counts=True)
                raw[a:z] += np.bincount(cell // len(self.codes), np.log1p(n) * self.weights[cell % len(self.codes)], z - a)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def learn(counts: np.ndarray, texts: list[str], y: np.ndarray, most: int = 1500, steps: int = 400) -> ToxicityModel:
    none = np.zeros(0, np.uint64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(counts, none, np.zeros(0), 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    channel = Channel(counts)
    rows, codes, sizes, start = [], [], [], 0
    restored = [channel.text(t) for t in texts]
    for a, z in slices(restored):
        row, code, words = features(restored[a:z])
        rows.append(row + a)
        codes.append(code)
        sizes.append(words)
    row, code, words = np.concatenate(rows), np.concatenate(codes), np.concatenate(sizes)
    order = np.lexsort((row, code))
    row, code = row[order], code[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    at = np.flatnonzero(first)
    n = np.diff(np.concatenate([at, [len(row)]]))
    row, code = row[at], code[at]
    every, inverse = np.unique(code, return_inverse=True)
    bad, good = np.bincount(inverse, y[row]), np.bincount(inverse, 1 - y[row])
    n_bad, n_good = y.sum(), (1 - y).sum()
    lift = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    gain = bad * lift
    chosen = np.flatnonzero((bad >= max(3, 0.003 * n_bad)) & (lift > math.log(3)))
    chosen = np.sort(chosen[np.argsort(-gain[chosen], kind="stable")[:most]])
    place = np.full(len(every), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[inverse] >= 0
    r, c, v = row[use], place[inverse[use]], np.log1p(n[use])
    log_words = np.log1p(words)
    weights, size_weight, bias = np.zeros(len(chosen)), 0.0, math.log(n_bad / n_good)
    m = [np.zeros(len(chosen)), 0.0, 0.0]
    s = [np.zeros(len(chosen)), 0.0, 0.0]
    for step in range(1, steps + 1):
        raw = bias + size_weight * log_words + np.bincount(r, v * weights[c], len(y))
        err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        g = [np.bincount(c, v * err[r], len(chosen)) / len(y) + 1e-4 * weights, float((err * log_words).mean()) + 1e-3 * size_weight, float(err.mean())]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g, strict=True)]
        s = [0.99 * a + 0.01 * b * b for a, b in zip(s, g, strict=True)]
        d = [0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8) for a, b in zip(m, s, strict=True)]
        weights, size_weight, bias = weights - d[0], size_weight - float(d[1]), bias - float(d[2])
    return ToxicityModel(counts, every[chosen], weights, size_weight, bias)


def fit(docs: DataFrame, train: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", max_rows: int = 5000, max_bytes: int = 64 << 20) -> ToxicityModel:
    """`docs`: all texts, for the character model; `train`: rows with `label`."""
    counts = np.zeros(WIDE**3, np.int64)
    for r in trigram_counts(docs, text).toLocalIterator():
        counts[r["gram"]] = r["n"]
    rows = train.where(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(id_col).cast("string")).alias("cw_place"), F.coalesce(F.col(text), F.lit("")).alias("cw_text"), F.col(label).cast("int").alias("cw_label"))
    found = sample_rows(rows, max_rows, max_bytes)
    return learn(counts, [r["cw_text"] for r in found], np.array([r["cw_label"] for r in found], np.float64))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", with_restored: bool = False) -> DataFrame:
    """Columns `keep`, score; with `with_restored` also the restored text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        channel = Channel(model.counts)
        for batch in batches:
            restored = [channel.text(t or "") for t in batch.column("cw_text").to_pylist()]
            cols = [batch.column(c) for c in keep] + [pa.array(model.score(restored), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(restored, pa.string())] * with_restored, names=[*keep, "score"] + ["restored"] * with_restored)

    return docs.select(*keep, docs[text].alias("cw_text")).mapInArrow(run, f"{schema}, score double" + ", restored string" * with_restored)
