"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark items; their passage frequencies are counted over all documents.
2. A randomised SVD of the TF-IDF passage matrix is computed in a distributed way: tasks multiply their passages' rows
   with a thin matrix and sum the products; two such passes over all documents and the items give the right singular vectors.
3. Every document is cut into overlapping passages of `2 * step` words; each is projected and compared with all items
   by cosine. Frequencies and singular vectors are those of all items at once; a task compares its passages with blocks of at most
   `block` items, and documents are read again only for each further `pass_bytes` of item text, so neither changes a result. Items of more
   than `4 * step` words are searched by their parts of `2 * step` words, so the bound follows their length. Terms in more
   than `common` of the passages carry no weight here. Parts that hold under `RARE` of their full weight in rarer terms (as
   when many documents leak them) are compared by all of their terms at full weight instead, without the projection.
4. Candidates that share at least `overlap` of a part's weight in that passage are checked by the longest common subsequence of the item and the passage's surroundings, in words weighted
   by inverse passage frequency. A document is a leak where the common part is at least `cover` of the item's weight, or
   at least `cover_with_answer` and the item's answer (its last `answer` words) is there in the same manner.

The items are the stated query set: their words are held by the driver and by each task, so a benchmark has to fit there; documents
never do. The cosine of a candidate comes first, its shared words are a bound that the check implies: what holds the needed cover of an item holds
a fifth of some part's weight in a passage, or nearly.

Defined results: null, empty and wordless documents and items match nothing. Rows of equal id are judged each on their
own, and give equal rows if their texts are equal; items of equal id and text count once. Of several places in a document the best counts. With no items or no documents there are no leaks. Extra columns are not read.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices


#: A document without a fifth of a part's rare weight can reach `cover_with_answer` of its full weight only below 0.6875.
RARE = 0.7
#: Parts compared at full weight at once.
WIDE = 32
#: Stretches of the terms in which tasks send their part of a product.
PARTS = 8
#: What is kept of eight bytes where a word ends after so many.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Coded(Words):
    """Words with codes made of eight bytes at a time: those of up to eight bytes differ for sure, longer ones as hashes do."""

    def _codes(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray(len(self.data), "<u8", self.data + bytes(7), strides=(1,))
        code = mix(eight[self.start] & KEEP[np.minimum(size, 8)])
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] + 7) >> 3
            first = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(first, n)
            piece = eight[np.repeat(self.start[long], n) + 8 * k] & KEEP[np.minimum(np.repeat(size[long], n) - 8 * k, 8)]
            code[long] = mix(np.add.reduceat(mix(piece + mix(k + 1)), first))
        return code


def run_sums(table: np.ndarray, at: np.ndarray, start: np.ndarray, steps: int = 16) -> np.ndarray:
    """Sums of the rows `at` of `table` over the runs that begin at `start`. The first rows of all runs are taken at once, then the second ones:
    runs are short, so this takes few steps; longer ones are cut into pieces of `steps` rows."""
    size = np.diff(start, append=len(at))
    pieces = -(-size // steps)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(start - steps * first, pieces) + steps * np.arange(int(pieces.sum()))
    length = np.minimum(np.repeat(start + size, pieces) - begin, steps)
    order = np.argsort(-length, kind="stable")
    begin, longer = begin[order], np.cumsum(np.bincount(length, minlength=steps + 1)[::-1])[::-1]
    rows = table[at[begin]]
    for k in range(1, steps):
        m = int(longer[k + 1])
        if not m:
            break
        rows[:m] += table[at[begin[:m] + k]]
    out = np.empty_like(rows)
    out[order] = rows
    return out if len(out) == len(start) else np.add.reduceat(out, first, axis=0)


class Terms:
    """Codes of the items' words, found among other codes by a table of their first bits. Their numbers are in the order of `by`."""

    SHIFT = np.uint64(44)

    def __init__(self, codes: np.ndarray, by: np.ndarray):
        self.codes, at = np.unique(codes, return_index=True)
        self.number = np.argsort(np.argsort(by[at], kind="stable"))
        self.slot = np.zeros(1 << 20, bool)
        self.slot[(self.codes >> self.SHIFT).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `codes` of known words, and their numbers."""
        at = np.flatnonzero(self.slot[(codes >> self.SHIFT).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        ok = self.codes[k] == codes[at]
        return at[ok], self.number[k[ok]]


def _parts(words: np.ndarray, width: int) -> list[np.ndarray]:
    """The words whole up to twice the width, else in runs of `width` that end with the last word."""
    if len(words) <= 2 * width:
        return [words]
    starts = [*range(0, len(words) - width, width), len(words) - width]
    return [words[a : a + width] for a in starts]


class Items:
    """Benchmark items: ids, their words' codes, the terms of all of them, and the parts they are searched by."""

    def __init__(self, ids: list, texts: list[str], step: int):
        w = Coded(texts)
        bounds = w.first_of_row()
        keep = [i for i in range(len(texts)) if bounds[i + 1] > bounds[i]]
        self.ids, self.step = [ids[i] for i in keep], step
        # the order of the terms decides the random start of the fit; that of `Words` keeps results as they were with its codes
        self.terms = Terms(w.code, Words(texts).code)
        _, number = self.terms.find(w.code)
        self.words = [number[bounds[i] : bounds[i + 1]] for i in keep]
        self.parts = [(i, part) for i, words in enumerate(self.words) for part in _parts(words, 2 * step)]
        self.item_of = np.array([i for i, _ in self.parts], np.int64)

    def block(self, a: int, z: int) -> Items:
        """Items a to z, with the terms of all."""
        out = Items.__new__(Items)
        out.ids, out.step, out.terms, out.words = self.ids[a:z], self.step, self.terms, self.words[a:z]
        out.parts = [(i - a, part) for i, part in self.parts if a <= i < z]
        out.item_of = np.array([i for i, _ in out.parts], np.int64)
        return out


class Passages:
    """Blocks of `step` words of several texts: term numbers by place, and where each block and each text begins."""

    def __init__(self, texts: list[str], terms: Terms, step: int):
        w = Coded(texts)
        self.bounds = w.first_of_row()
        count = np.diff(self.bounds)
        blocks = -(-count // step)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.at, self.term = terms.find(w.code)
        row = w.row[self.at]
        self.block = self.first_block[row] + (self.at - self.bounds[row]) // step
        self.all_terms, self.step = self.term, step
        self.codes, self.n_blocks = w.code, int(self.first_block[-1])
        row_of = np.repeat(np.arange(len(texts)), blocks)
        self.row_of = row_of
        self.paired = np.concatenate([row_of[1:] == row_of[:-1], [False]]) if self.n_blocks else np.zeros(0, bool)

    def only(self, use: np.ndarray) -> Passages:
        """The same passages, where only terms marked in `use` count in sums and overlaps."""
        out, k = copy.copy(self), use[self.term]
        out.block, out.term = self.block[k], self.term[k]
        return out

    def overlaps(self, passage: np.ndarray, part: np.ndarray, index: Index) -> np.ndarray:
        """For each pair, the sum of the part's shares over the passage's terms."""
        start = np.searchsorted(self.block, np.arange(self.n_blocks + 1))
        a, z = start[passage], start[passage + 1 + self.paired[passage]]
        size = z - a
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(a - first, size)
        return np.bincount(np.repeat(np.arange(len(passage)), size), index.shares(np.repeat(part, size), self.term[at]), len(passage))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each passage (a block and the next of the same text) the sum of its terms' rows of `table`."""
        out = np.zeros((self.n_blocks, table.shape[1]), np.float32)
        if len(self.block):
            start = np.flatnonzero(np.concatenate([[True], self.block[1:] != self.block[:-1]]))
            out[self.block[start]] = run_sums(table, self.term, start)
        both = out.copy()
        both[:-1][self.paired[:-1]] += out[1:][self.paired[:-1]]
        return both


def _frequencies(docs: DataFrame, items: Items, text: str) -> tuple[np.ndarray, int]:
    """Passage frequencies of the terms and the number of passages, over all documents."""
    terms, step = items.terms, items.step

    def run(batches):
        total, passages = np.zeros(len(terms.codes), np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, z in slices(texts):
                p = Passages(texts[a:z], terms, step)
                passages += p.n_blocks
                key = np.sort(p.block * len(terms.codes) + p.term)
                total += np.bincount(key[np.diff(key, prepend=-1) != 0] % len(terms.codes), minlength=len(terms.codes))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int64()), pa.array([passages, *total[found].tolist()], pa.int64())], names=["term", "n"])

    counts, n = np.zeros(len(terms.codes), np.int64), 0
    for r in docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return counts, n


class Weights:
    """Of all terms: `idf`, `used` (0 in `rare` for common terms) and `table`, their rows in the projection."""

    def __init__(self, items: Items, idf: np.ndarray, rare: np.ndarray, basis: np.ndarray):
        self.items, self.idf, self.rare, self.used = items, idf, rare, rare > 0
        self.table = (rare[:, None] * basis).astype(np.float32)
        self.squares = (idf[:, None] ** 2).astype(np.float32)


class Index:
    """A block of items. `pair`: sorted (number of a part, term) as one number; `share`: the portion of the
    part's rare weight that the term has. `whole`: parts that are compared by all of their terms, `WIDE` at once."""

    def __init__(self, items: Items, weights: Weights):
        idf, rare = weights.idf, weights.rare
        self.items = items
        parts = [w for _, w in items.parts]
        distinct = [np.unique(w) for w in parts]
        self.n_terms = len(idf)
        self.pair = np.concatenate([k * self.n_terms + w for k, w in enumerate(distinct)])
        self.slot = np.zeros(1 << 20, bool)
        self.slot[self.place(self.pair)] = True
        self.full = np.array([rare[w].sum() < RARE * idf[w].sum() for w in distinct])
        by = [idf if f else rare for f in self.full]
        self.share = np.concatenate([x[w] / max(x[w].sum(), 1e-9) for x, w in zip(by, distinct, strict=True)]).astype(np.float32)
        self.whole = np.flatnonzero(self.full)
        self.bags = [np.unique(parts[i], return_counts=True) for i in self.whole.tolist()]
        self.idf = idf.astype(np.float32)
        made = np.stack([weights.table[w].sum(axis=0) for w in parts])
        self.vectors = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
        self.weights = [idf[w] for w in items.words]

    def whole_tables(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For `WIDE` whole parts from the k-th on: their terms' unit weights and shares, a column a part."""
        bags = self.bags[k : k + WIDE]
        near = np.zeros((self.n_terms, len(bags)), np.float32)
        portion = np.zeros_like(near)
        for j, (w, n) in enumerate(bags):
            unit = n * self.idf[w]
            near[w, j] = unit * self.idf[w] / max(float(np.linalg.norm(unit)), 1e-9)
            portion[w, j] = self.idf[w] / max(float(self.idf[w].sum()), 1e-9)
        return near, portion

    def shares(self, part: np.ndarray, term: np.ndarray) -> np.ndarray:
        key, out = part * self.n_terms + term, np.zeros(len(part), np.float32)
        some = np.flatnonzero(self.slot[self.place(key)])
        key = key[some]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        out[some] = np.where(self.pair[at] == key, self.share[at], 0)
        return out

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        """Where `slot` tells whether a key may be among the pairs."""
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> Terms.SHIFT).astype(np.int64)


def _product(docs: DataFrame, items: Items, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """(A^T A) thin, where A's rows are the TF-IDF passages of all documents and items at unit length. Tasks send their sums in `PARTS` stretches of
    the terms, and each stretch is added up in the order of the tasks before the driver gets it."""
    terms, step, used = items.terms, items.step, idf > 0
    wide = -(-len(thin) // PARTS)

    def add(total: np.ndarray, scaled: np.ndarray, texts: list[str]) -> None:
        p = Passages(texts, terms, step).only(used)
        if not len(p.block):
            return
        # terms stand in the order of their blocks
        new = np.concatenate([[True], p.block[1:] != p.block[:-1]])
        first, row = np.flatnonzero(new), np.cumsum(new) - 1
        squares = np.add.reduceat(idf[p.term] ** 2, first)
        rows = run_sums(scaled, p.term, first) / np.maximum(squares, 1e-9).astype(np.float32)[:, None]
        order = np.argsort(p.term, kind="stable")
        start = np.flatnonzero(np.diff(p.term[order], prepend=-1))
        total[p.term[order][start]] += run_sums(rows, row[order], start)

    def run(batches):
        from pyspark import TaskContext

        total, scaled = np.zeros(thin.shape, np.float64), (idf[:, None] * thin).astype(np.float32)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, z in slices(texts):
                add(total, scaled, texts[a:z])
        total *= idf[:, None]
        some = [k for k in range(0, len(thin), wide) if total[k : k + wide].any()]
        made = pa.array([total[k : k + wide].astype(np.float32).tobytes() for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()), made], names=["at", "task", "part"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                held[at] = held[at] + part if at in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "part"])

    sums = docs.mapInArrow(run, "at long, task long, part binary").repartition("at").sortWithinPartitions("at", "task").mapInArrow(merge, "at long, part binary")
    total = np.zeros(thin.shape, np.float64)
    for r in sums.toLocalIterator():
        part = np.frombuffer(r["part"], np.float64).reshape(-1, thin.shape[1])
        total[r["at"] : r["at"] + len(part)] = part
    for _, w in items.parts:
        n = np.sqrt((idf[w] ** 2).sum())
        x = idf[w] / max(n, 1e-9)
        np.add.at(total, w, 4 * x[:, None] * (x @ thin[w])[None, :])
    return total


def fit(docs: DataFrame, items: Items, text: str = "text", rank: int = 64, common: float = 0.02, seed: int = 3) -> Weights:
    """Frequencies and singular vectors, both of all passages: three passes over the documents."""
    counts, n = _frequencies(docs, items, text)
    idf = np.log(1 + (n + 1) / (counts + 1.0))
    rare = np.where(counts <= common * n, idf, 0)
    texts = docs.select(text)
    rng = np.random.default_rng(seed)
    wide = min(rank + 16, len(items.terms.codes))
    q, _ = np.linalg.qr(_product(texts, items, rare, rng.standard_normal((len(items.terms.codes), wide)).astype(np.float32)))
    values, vectors = np.linalg.eigh(q.T @ _product(texts, items, rare, q.astype(np.float32)))
    return Weights(items, idf, rare, q @ vectors[:, np.argsort(-values)[:rank]])


def common_weight(region: np.ndarray, words: np.ndarray, weights: np.ndarray) -> float:
    """The largest weight of a common subsequence."""
    best = np.zeros(len(region) + 1)
    for word, weight in zip(words, weights, strict=True):
        taken = best.copy()
        taken[1:] = np.maximum(best[1:], np.where(region == word, best[:-1] + weight, 0))
        best = np.maximum.accumulate(taken)
    return float(best[-1])


def search(docs: DataFrame, weights: Weights, indexes: list[Index], id_col: str = "doc_id", text: str = "text", cosine: float = 0.4, overlap: float = 0.2, cover: float = 0.6, cover_with_answer: float = 0.45, answer: int = 5) -> DataFrame:
    """id_col, item, cosine, cover, answer_cover: the leaks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def candidates(p: Passages, used: Passages, made: np.ndarray, length: np.ndarray, index: Index) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """(row, item): passages that are near one of the item's parts, with their cosine."""
        items, hits = index.items, {}
        for k in range(0, len(index.whole), WIDE):
            unit, portion = index.whole_tables(k)
            near = p.sums(unit) / length
            b, i = np.nonzero(p.sums(portion) >= overlap)
            for b, i in zip(b.tolist(), i.tolist(), strict=True):
                hits.setdefault((int(p.row_of[b]), int(items.item_of[index.whole[k + i]])), []).append((b, float(near[b, i])))
        rows = max(1, min(8192, (8192 << 10) // len(items.parts)))
        for k in range(0, p.n_blocks, rows):
            near = made[k : k + rows] @ index.vectors.T
            near[:, index.whole] = -1
            b, i = np.divmod(np.flatnonzero(near >= cosine), len(items.parts))
            enough = used.overlaps(b + k, i, index) >= overlap
            for b, i in zip(b[enough].tolist(), i[enough].tolist(), strict=True):
                hits.setdefault((int(p.row_of[k + b]), int(items.item_of[i])), []).append((k + b, float(near[b, i])))
        return hits

    def best_cover(p: Passages, number: np.ndarray, row: int, found: list[tuple[int, float]], words: np.ndarray, own: np.ndarray) -> tuple[float, float]:
        """The item's largest share, and its answer's, in the surroundings of a run of passages."""
        step, total, best, at = p.step, own.sum(), (0.0, 0.0), 0
        held = np.zeros(len(weights.idf) + 1, bool)
        while at < len(found):
            end = at
            while end + 1 < len(found) and found[end + 1][0] - found[end][0] <= 2:
                end += 1
            first = p.bounds[row] + (found[at][0] - p.first_block[row]) * step
            last = p.bounds[row] + (found[end][0] - p.first_block[row] + 2) * step
            region = number[max(p.bounds[row], first - len(words)) : min(p.bounds[row + 1], last + len(words))]
            held[region] = True
            held[-1] = False
            there = own[held[words]].sum()
            held[region] = False
            if there >= cover_with_answer * total:
                tail = own[-answer:].sum()
                best = max(best, (common_weight(region, words, own) / total, common_weight(region, words[-answer:], own[-answer:]) / tail))
            at = end + 1
        return best

    def run(batches):
        terms, step = weights.items.terms, weights.items.step
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for a, z in slices(texts):
                p = Passages(texts[a:z], terms, step)
                if not p.n_blocks:
                    continue
                number = np.full(len(p.codes), -1, np.int64)
                number[p.at] = p.all_terms
                used = p.only(weights.used)
                made = used.sums(weights.table)
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                length = np.sqrt(np.maximum(p.sums(weights.squares), 1e-9)) if any(len(x.whole) for x in indexes) else None
                for index in indexes:
                    for (row, i), found in candidates(p, used, made, length, index).items():
                        best = best_cover(p, number, row, sorted(found), index.items.words[i], index.weights[i])
                        if best[0] >= cover or (best[0] >= cover_with_answer and best[1] >= 0.8):
                            out.append((ids[a + row], index.items.ids[i], max(c for _, c in found), *best))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64())] + [pa.array(cols[k], pa.float64()) for k in (2, 3, 4)], names=[id_col, "item", "cosine", "cover", "answer_cover"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, item long, cosine double, cover double, answer_cover double")


def leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", block: int = 1000, pass_bytes: int = 64 << 20, step: int = 16, **kw) -> DataFrame:
    """The leaks of all items. One fit holds for all of them; blocks and passes bound what a task holds at once."""
    fits = ("text", "rank", "common")
    rows = list(benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct().orderBy("i", "t").toLocalIterator())
    items = Items([r["i"] for r in rows], [r["t"] for r in rows], step)
    out = None
    if items.ids:
        weights = fit(docs, items, **{n: v for n, v in kw.items() if n in fits})
        edges = [*range(0, len(items.ids), block), len(items.ids)]
        now: list[Index] = []
        held = 0
        for a, z in zip(edges, edges[1:], strict=False):
            now.append(Index(items.block(a, z), weights))
            held += sum(8 * len(w) for w in now[-1].items.words)
            if held >= pass_bytes or z == len(items.ids):
                found = search(docs, weights, now, **{n: v for n, v in kw.items() if n not in ("rank", "common")})
                out, now, held = found if out is None else out.unionByName(found), [], 0
    if out is None:
        id_col = kw.get("id_col", "doc_id")
        out = docs.where(F.lit(False)).select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in (("item", "long"), ("cosine", "double"), ("cover", "double"), ("answer_cover", "double"))])
    return out
