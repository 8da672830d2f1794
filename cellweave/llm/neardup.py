"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Texts of equal n-gram set form one class of copies; a 96-bit key of the set is the node of all that follows.
2. `rows` and `bands` are chosen for a target recall at the threshold; sets meet in the shuffle on band hashes, where each
   is tied to the least one of its bucket. No pairs are made there: ties are sets times bands at most, and each task keeps a
   spanning forest of its own. In ties and groups 64 bits of the key stand for a set: a collision there costs comparisons only.
3. Ties give groups of candidates. A group is cut into parts of at most about `block` sets and `part_grams` n-grams by a hash. A part's
   sets are gathered once, compared among each other, and packed (n-grams as places in the part's own list). Packed parts
   of a group meet in pairs. So rows are sets, and for groups of several parts their pairs of parts, never pairs of sets; text is
   sent once.
4. Each comparison gives, for each set, its number of links and the least set that it is connected to; links join sets into classes.

N-grams are runs of `width` words in lower case (a word: ASCII letters, digits, underscores and all non-ASCII
characters), held as 64-bit codes; a shorter text has one n-gram, of all its words.

Defined results: null, empty and wordless texts are alone, named by their own id, with no links and one copy. Repeated rows are
copies. A class is named by the least id that no other class holds. Ids may be null or repeat with other texts: texts are joined only by
what they say, never by their id. A class all of whose ids are null has the class id null; one whose ids all are
in other classes too has a negative one made from its key. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, shingle_sets, slices, small_batches, unused
from .graph import components

KEY_BYTES = 12
#: Most sets that a task remembers having sent; forgetting costs only bytes of exchange.
REMEMBERED = 400_000


def plan_bands(threshold: float, recall: float, rows: int = 6) -> int:
    """The least number of bands of `rows` rows by which a pair at the threshold meets with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit value a set and band."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    adds = mix(seeds)
    out = np.zeros((len(sets), bands), np.uint64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    flat = np.concatenate(sets)
    for k in range(bands):
        code = np.full(len(sets), k + 1, np.uint64)
        for r in range(rows):
            j = k * rows + r
            x = (flat ^ adds[j]) * seeds[j]
            x ^= x >> np.uint64(32)
            code = mix(code * np.uint64(0x100000001B3) + np.minimum.reduceat(x, at[:-1]))
        out[:, k] = code
    return out


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text)).alias("row_key")


def _sets(docs: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc, row_key (hash of id and text), set_key (null without words); and code, size, bands, packed (the text) where the same task has not just
    met the set."""

    def run(batches):
        met: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            keys, hashes, sizes, bodies = [], [], [], []
            for a, z in slices(texts):
                sets = shingle_sets(texts[a:z], width)
                own = [hashlib.blake2b(s.tobytes(), digest_size=KEY_BYTES).digest() if len(s) else None for s in sets]
                if len(met) > REMEMBERED:
                    met.clear()
                new = []
                for k, key in enumerate(own):
                    if key is not None and key not in met:
                        met.add(key)
                        new.append(k)
                got = dict(zip(new, band_hashes([sets[k] for k in new], bands, rows), strict=True)) if new else {}
                keys += [None if key is None else key.hex() for key in own]
                hashes += [got[k].view(np.int64).tolist() if k in got else None for k in range(len(sets))]
                sizes += [len(s) for s in sets]
                bodies += [press.compress(texts[a + k].encode("utf-8", "surrogatepass")) if k in got else None for k in range(len(sets))]
            codes = [None if h is None else int(key[:16], 16) - (1 << 63) for key, h in zip(keys, hashes, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(codes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row_key", "set_key", "code", "size", "bands", "packed"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), row_key(id_col, text), F.col(text).alias("text")).mapInArrow(run, "doc long, row_key long, set_key string, code long, size long, bands array<long>, packed binary")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of `left` (rows) have Jaccard similarity of at least `threshold` with which of `right`, or with which others of `left`."""
    every = left + (right or [])
    n, sizes = len(every), np.array([len(s) for s in every], np.float64)
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times[code] > 1
    code, owner = code[use], owner[use]
    common = np.zeros((len(left), n if right is None else len(right)), np.float32)
    if len(code):
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        total, wide = int(code[-1]) + 1, 4096
        edge = np.searchsorted(code, np.arange(0, total + wide, wide))
        for k, a in enumerate(range(0, total, wide)):
            part = slice(edge[k], edge[k + 1])
            x = np.zeros((n, min(wide, total - a)), np.float32)
            x[owner[part], code[part] - a] = 1
            common += x[: len(left)] @ (x if right is None else x[len(left) :]).T
    other = sizes if right is None else sizes[len(left) :]
    near = common >= threshold * (sizes[: len(left), None] + other[None, :] - common) - 1e-6
    if right is None:
        np.fill_diagonal(near, False)
    return near


def _links(keys: list[bytes], near: np.ndarray, two: bool) -> list[tuple[str, int, str]]:
    """set_key, number of links and the least set_key that it is connected to, of those that have links. With `two` the rows are
    the first keys and the columns the others."""
    n = len(keys)
    rank = np.empty(n, np.int64)
    order = sorted(range(n), key=keys.__getitem__)
    rank[order] = np.arange(n)
    split = near.shape[0] if two else n
    a, b = np.nonzero(near)
    b = b + split if two else b
    count = np.bincount(a, minlength=n) + (np.bincount(b, minlength=n) if two else 0)
    label = rank.copy()
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[np.asarray(order)[new]])
        if (new == label).all():
            break
        label = new
    return [(keys[k].hex(), int(count[k]), keys[order[label[k]]].hex()) for k in np.flatnonzero(count).tolist()]


def _pack(keys: list[bytes], sets: list[np.ndarray]) -> bytes:
    """Sets as places in the list of all of their n-grams."""
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int32)
    head = np.array([len(keys), len(grams)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *keys, sizes.tobytes(), grams.tobytes(), place.astype(np.uint32).tobytes()]))


def _unpack(raw: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + n * KEY_BYTES
    keys = [raw[16 + k * KEY_BYTES : 16 + (k + 1) * KEY_BYTES] for k in range(n)]
    sizes = np.frombuffer(raw, np.int32, n, at)
    grams = np.frombuffer(raw[at + 4 * n : at + 4 * n + 8 * m], np.uint64)
    place = np.frombuffer(raw, np.uint32, -1, at + 4 * n + 8 * m)
    return keys, np.split(grams[place], np.cumsum(sizes)[:-1])


FOUND = "`group` long, part int, payload binary, set_key string, links long, least string"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["group", "part", "payload", "set_key", "links", "least"])


def _gather(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """members: group, part, parts, set_key, packed, sorted by part. Links within each part; and each part packed where its group has others."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        now, many, held, out = None, False, {}, []

        def judged():
            texts = [open_.decompress(p).decode("utf-8", "surrogatepass") for p in held.values()]
            keys = [bytes.fromhex(k) for k in held]
            sets = [s for a, z in slices(texts) for s in shingle_sets(texts[a:z], width)]
            rows = [(None, None, None, *r) for r in _links(keys, similar(sets, None, threshold), False)] if len(sets) > 1 else []
            return rows + [(*now, _pack(keys, sets), None, None, None)] * many

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("group", "part", "parts", "set_key", "packed")]
            for group, part, parts, key, packed in zip(*cols, strict=True):
                if (group, part) != now:
                    out += judged() if held else []
                    now, many, held = (group, part), parts > 1, {}
                held[key] = packed
                if len(out) > 5000 or sum(len(r[2] or b"") for r in out[-8:]) > 1 << 22:
                    yield _found(out)
                    out = []
        yield _found(out + (judged() if held else []))

    return members.mapInArrow(run, FOUND)


def _across(pairs: DataFrame, threshold: float) -> DataFrame:
    """Links between the two packed parts of each row."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (x_keys, x), (y_keys, y) = _unpack(a), _unpack(b)
                yield _found([(None, None, None, *r) for r in _links(x_keys + y_keys, similar(x, y, threshold), True)])

    return pairs.select("payload", "other").mapInArrow(run, FOUND).select("set_key", "links", "least")


def links(seen: DataFrame, width: int, threshold: float, block: int, part_grams: int) -> DataFrame:
    """set_key, links, least: for each comparison that a set has links in, their number and the least set that it joins there."""
    n = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = seen.where(F.col("bands").isNotNull())
    each = sent.select("code", F.explode("bands").alias("band"))
    hubs = each.groupBy("band").agg(F.min("code").alias("hub"), F.max("code").alias("most")).where("most <> hub").select("band", "hub")
    ties = each.join(hubs, "band").where("code <> hub").select(F.col("code").alias("a"), F.col("hub").alias("b"))
    groups = components(ties).select(F.col("node").alias("code"), F.col("label").alias("group"))
    sizes = sent.select("code", "size").join(groups, "code").groupBy("group", "code").agg(F.max("size").alias("size"))
    sized = sizes.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    parts = materialise(sized.select("group", F.ceil(F.greatest(F.col("n") / block, F.col("grams") / part_grams)).cast("int").alias("parts")), "parts")
    places = groups.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    placed = sent.select("code", "set_key", "packed").hint("merge").join(places, "code")  # the same plan at every size
    with small_batches(seen.sparkSession):
        found = materialise(_gather(placed.repartition(n, "group", "part").sortWithinPartitions("group", "part"), width, threshold), "links")
    packed = found.where(F.col("payload").isNotNull())
    first = parts.where("parts > 1").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 2)).alias("part"), "parts")
    pairs = first.select("group", "part", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("second"))
    left = pairs.join(packed.select("group", "part", "payload"), ["group", "part"])
    both = left.join(packed.select("group", F.col("part").alias("second"), F.col("payload").alias("other")), ["group", "second"])
    with small_batches(seen.sparkSession, 8):
        more = materialise(_across(both.repartition(n, "group", "part", "second"), threshold), "links")
    return found.where(F.col("links").isNotNull()).select("set_key", "links", "least").unionByName(more)


def _named(seen: DataFrame, classes: DataFrame) -> DataFrame:
    """set_key, class_id: see the module's words on names; a set is missing where it has none. classes: node, label."""
    key = F.coalesce("set_key", F.lit(""))
    per_id = seen.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min(key).alias("set_key"), F.max(key).alias("last"))
    sets = per_id.where("set_key = last and set_key <> ''").groupBy("set_key").agg(F.min("doc").alias("doc"))
    shared = materialise(per_id.where("set_key <> last").select("doc"), "ids")
    if shared.limit(1).count():
        held = seen.join(shared, "doc").select("doc", key.alias("set_key")).distinct()
        placed = held.join(classes, held["set_key"] == classes["node"], "left").select("doc", "set_key", F.coalesce("label", "set_key").alias("label"))
        alone = placed.groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("last"), F.max("set_key").alias("set_key")).where("label = last")
        unnamed = held.where("set_key <> ''").select(F.lit(None).cast("long").alias("doc"), "set_key")
        sets = sets.unionByName(alone.select("doc", "set_key")).unionByName(unnamed).groupBy("set_key").agg(F.min("doc").alias("doc"))
    of_class = sets.join(classes, sets["set_key"] == classes["node"]).groupBy("label").agg(F.min("doc").alias("doc"))

    def name(key: str) -> Column:
        return F.coalesce("doc", -F.conv(F.substring(key, 1, 15), 16, 10).cast("long") - 1).alias("class_id")

    linked = classes.join(of_class, "label").select(F.col("node").alias("set_key"), name("label"))
    return linked.unionByName(sets.join(classes, sets["set_key"] == classes["node"], "left_anti").select("set_key", name("set_key")))


def _classes(docs: DataFrame, id_col: str, text: str, width: int, threshold: float, recall: float, rows: int, block: int, part_grams: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets, the links found, and node, label of the sets that have links."""
    with small_batches(docs.sparkSession):
        seen = materialise(_sets(docs, id_col, text, width, plan_bands(threshold, recall, rows), rows), "sets")
    found = materialise(links(seen, width, threshold, block, part_grams), "links")
    return seen, found, components(found.select(F.col("set_key").alias("a"), F.col("least").alias("b")))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6, block: int = 512, part_grams: int = 1 << 18) -> DataFrame:
    """For each row: `id_col`, class_id, n_links (other texts with at least `threshold` in common), n_copies (rows of the same set)."""
    seen, found, classes = _classes(docs, id_col, text, width, threshold, recall, rows, block, part_grams)
    counts = found.groupBy("set_key").agg(F.sum("links").alias("n_links"))
    copies = seen.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.count("*").alias("n_copies"))
    of_set = copies.join(counts, "set_key", "left").join(_named(seen, classes), "set_key", "left")
    out = seen.select("doc", "set_key").join(of_set, "set_key", "left")
    known = F.when(F.col("set_key").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), known.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6, block: int = 512, part_grams: int = 1 << 18) -> DataFrame:
    """One row of each class, with all columns of `docs`: that of the least id (null last), then of the least hash of id and text; of rows
    that repeat it, one. Rows without words stay as they are."""
    seen, _, classes = _classes(docs, id_col, text, width, threshold, recall, rows, block, part_grams)
    worded = seen.where(F.col("set_key").isNotNull()).select("doc", "row_key", "set_key")
    labelled = worded.join(classes, worded["set_key"] == classes["node"], "left").select("doc", "row_key", F.coalesce("label", "set_key").alias("class"))
    first = labelled.groupBy("class").agg(F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row_key")).alias("first"))
    own_id, own_row, its_id, its_row = unused(docs, "id", "row", "first_id", "first_row")
    # how often the chosen row stands in the table: the rest of its repeats go
    chosen = first.select(F.col("first.doc").alias(its_id), F.col("first.row_key").alias(its_row))
    often = labelled.groupBy("doc", "row_key").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(chosen.join(often, chosen[its_id].eqNullSafe(often["doc"]) & (chosen[its_row] == often["row_key"])).select(its_id, its_row), "repeated")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_row: row_key(id_col, text)})
    same = F.col(own_id).eqNullSafe(F.col(its_id)) & (F.col(own_row) == F.col(its_row))
    has_word = F.coalesce(F.col(text).rlike(r"[0-9A-Za-z_]|[^\x00-\x7F]"), F.lit(False))
    kept = keyed.where(has_word).join(chosen, same, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.where(~has_word)
    if again.isEmpty():
        return out.unionByName(kept.select(*columns))
    once = kept.join(again, same, "left_semi").groupBy(own_id, own_row).agg(F.first(F.struct(*columns)).alias(f"{own_row}_all")).select(f"{own_row}_all.*")
    return out.unionByName(kept.join(again, same, "left_anti").select(*columns)).unionByName(once)
