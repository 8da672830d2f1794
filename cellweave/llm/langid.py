"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Every whole text is normalised (lower case, letters, single spaces) and compressed once for each language with that
language's Zstandard raw-content dictionary; the smallest frame wins. A text is rejected when the runner-up is less than `margin`
bytes larger, or when it has no letter. `fit` chooses the margin on all training rows that no dictionary may take from.

A dictionary is a bounded sample (`dictionary_chars` characters a language) of segments from anywhere in the training texts, chosen by
hash, so any part of any text can be in it.

Defined results: null text or text without letters gives `und`, score 0, rejected. Ties go to the language with more
training rows, then by name, and are rejected. A language whose training texts have letters is learnt, however few; without any usable
training rows every text gives `und`. Rows are treated alone, so repeated rows repeat their result, and extra columns are dropped unless named
in `keep`. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

UNKNOWN = "und"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


class LanguageModel:
    """`dictionaries`: raw bytes by language. Sizes come from level `level` without checksums or dictionary ids."""

    def __init__(self, dictionaries: dict[str, bytes], rows: dict[str, int], level: int = 3, margin: int = 1):
        self.order = sorted(dictionaries, key=lambda k: (-rows.get(k, 0), k))
        self.dictionaries, self.level, self.margin = dictionaries, level, margin

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for name in self.order:
            raw = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False))
        return out


def _hashed(name: str, *columns) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), *columns), F.lit(1 << 30))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", dictionary_chars: int = 192_000, segment: int = 240, level: int = 3, lost: float = 0.002, most_margin: int = 3) -> LanguageModel:
    """Dictionaries from seven eighths of the rows: about `dictionary_chars` of each language, in segments of `segment` characters, those of the
    smallest hash. The margin, 1 to `most_margin` bytes, is the largest that loses at most the share `lost` of all other rows (an eighth)
    that are told right. Counts are of all rows."""
    key = F.col(id_col).cast("string")
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN)).select(key.alias("cw_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts, chars = {}, {}
    for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect():
        counts[r["lang"]], chars[r["lang"]] = r["n"], r["c"]
    if not counts:
        return LanguageModel({}, {}, level)

    def share(most: dict[str, float]) -> Column:
        return F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(int(min(1.0, v) * (1 << 30))))])[F.col("lang")]

    # some of the rows first, then some of their segments
    of_rows = {k: 16 * dictionary_chars / max(c, 1) for k, c in chars.items()}
    of_segments = {k: 2.5 * dictionary_chars / max(c * min(1.0, of_rows[k]), 1) for k, c in chars.items()}
    side = F.pmod(F.xxhash64(F.lit("side"), "cw_id"), F.lit(8))
    held = rows.where((side != 0) & (_hashed("rows", "cw_id") < share(of_rows)))
    cut = held.select("lang", "cw_id", F.posexplode(F.regexp_extract_all(normal(F.col("text")), F.lit(f".{{1,{segment}}}"), F.lit(0))).alias("at", "piece"))
    cut = cut.select("lang", _hashed("segments", "cw_id", "at").alias("place"), "piece").where(F.col("place") < share(of_segments))
    pieces: dict[str, list] = {k: [] for k in counts}
    for r in cut.toLocalIterator():
        pieces[r["lang"]].append((r["place"], r["piece"]))
    made = {}
    for k, v in pieces.items():
        chosen, size = [], 0
        for _, piece in sorted(v):
            if size >= dictionary_chars:
                break
            chosen.append(piece)
            size += len(piece) + 1
        raw = " ".join(chosen).encode("utf-8", "surrogatepass")
        if raw:
            made[k] = (raw + b" ") * (8 // len(raw) + 1) if len(raw) < 8 else raw
    model = LanguageModel(made, counts, level)
    told = identify(rows.where(side == 0), model, ["lang"]).where("lang = lang_pred")
    right = {r["m"]: r["n"] for r in told.groupBy(F.least("margin_bytes", F.lit(most_margin)).alias("m")).agg(F.count("*").alias("n")).collect()}
    while model.margin < most_margin and sum(n for m, n in right.items() if 1 <= m <= model.margin) <= lost * sum(right.values()):
        model.margin += 1
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and lang_pred, score, margin_bytes, rejected. `score` is the winner's share of 2^-bytes over the languages."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        tools = model.compressors()
        for batch in pieces(batches):
            texts = batch.column("cw_normal").to_pylist()
            names, scores, margins = [], [], []
            for t in texts:
                if not t or not tools:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    margins.append(0)
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                sizes = [len(c.compress(raw)) for c in tools]
                best = min(sizes)
                at = sizes.index(best)
                rest = sizes[:at] + sizes[at + 1 :]
                names.append(model.order[at])
                scores.append(float(1 / np.sum(np.exp2(-np.minimum(np.array(sizes) - best, 60.0)))))
                margins.append(min(rest) - best if rest else best)
            cols = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array([n == UNKNOWN or m < model.margin for n, m in zip(names, margins, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "margin_bytes", "rejected"])

    return docs.select(*keep, normal(F.col(text)).alias("cw_normal")).mapInArrow(run, f"{schema}, lang_pred string, score double, margin_bytes long, rejected boolean")
