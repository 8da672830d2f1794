"""SimHash fingerprints and all fingerprints within a Hamming radius, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (or its one word), in lower case; a term's weight is 1 to 3 by its
length. Each term hashes to 128 bits that vote; bit k of the fingerprint is set where the weight of terms with that bit
exceeds half of all weight. Votes are counted four to a 64-bit sum, over runs of terms short enough not to overflow,
and unpacked once a text. The search cuts fingerprints into radius + 1 blocks; two within the radius agree in a block,
so each block in turn is moved to the front as a table's key. A key that many fingerprints share is cut into chunks.

Defined results: null text counts as empty; a text without words has the fingerprint 0. Rows are ordered by id (null
first), then text; rows of equal id and text are neighbours in either order, with equal results but for what follows
the last of them. A sole row is its own successor. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 128
#: Terms of one run of votes: their weights (3 at most) stay below 2^15, so the top counter keeps the sum's sign.
RUN = 10000
LANES = 0x0001000100010001


def terms(text: Column, side: int) -> Column:
    """An array of term hashes, whose lowest bits are replaced: two of weight, one for the side."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def coded(a: Column, b: Column) -> Column:
        weight = F.when(F.length(a) + F.length(b) <= 6, 1).when(F.length(a) + F.length(b) <= 12, 2).otherwise(3)
        return F.xxhash64(a, b).bitwiseAND(F.lit(-8)).bitwiseOR(weight.cast("long") * 2 + side)

    def pairs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n <= 1, F.transform(w, lambda x: coded(x, F.lit("")))).otherwise(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(1))), F.slice(w, 2, F.greatest(n - 1, F.lit(1))), coded))

    return F.flatten(F.transform(F.array(words), pairs))


def votes(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """`keys` (that tell rows apart) and for each of `texts` columns high0, low0, high1, low1 ...: the fingerprint's two halves."""
    one = rows.select(*keys, F.posexplode_outer(F.concat(*[terms(F.col(t), k) for k, t in enumerate(texts)])).alias("pos", "h"))
    term = F.coalesce(F.col("h").bitwiseAND(F.lit(-2)), F.lit(0))
    weight = F.shiftright("h", 1).bitwiseAND(F.lit(3))
    one = one.select(*keys, F.coalesce(F.col("h").bitwiseAND(F.lit(1)), F.lit(0)).alias("side"), F.coalesce(F.floor(F.col("pos") / RUN), F.lit(0)).alias("run"), F.coalesce(weight, F.lit(0)).alias("w"), F.xxhash64(term).alias("a"), F.xxhash64(term, F.lit(1)).alias("b"))
    sums = [F.sum(F.shiftrightunsigned(c, j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{c}{j}") for c in ("a", "b") for j in range(16)]
    runs = one.groupBy(*keys, "side", "run").agg(F.sum("w").alias("w"), *sums)

    def lane(c: str, k: int) -> Column:
        return F.shiftrightunsigned(f"{c}{k % 16}", 16 * (k // 16)).bitwiseAND(F.lit(0xFFFF))

    counts = runs.groupBy(*keys, "side").agg(F.sum("w").alias("w"), *[F.sum(lane(c, k)).alias(f"{c}_{k}") for c in ("a", "b") for k in range(64)])

    def half(c: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(64):
            out = out.bitwiseOR(F.when(F.col(f"{c}_{k}") * 2 > F.col("w"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    prints = counts.select(*keys, "side", half("a").alias("high"), half("b").alias("low"))
    return prints.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("side") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(len(texts)) for c in ("high", "low")])


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def hexed(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


class Ranges:
    """Ranges of ids, each with the row that follows it: bounds are quantiles, which are ids of the table."""

    def __init__(self, docs: DataFrame, id_col: str, ranges: int):
        shares = [k / ranges for k in range(1, ranges)] or [0.5]
        found = docs.agg(F.percentile_approx(id_col, shares, max(10000, 20 * ranges)).alias("q"), F.min(id_col).alias("least"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
        self.least, self.nulls = found["least"], found["nulls"]
        self.bounds = sorted({b for b in found["q"] or [] if b > found["least"] or self.nulls}) if self.least is not None else []
        self.id_col = id_col

    def number(self) -> Column:
        """How many bounds are at most the id, by a search in two steps."""
        if not self.bounds:
            return F.lit(0)
        wide = math.isqrt(len(self.bounds)) + 1
        every, tops = F.array(*map(F.lit, self.bounds)), F.array(*map(F.lit, self.bounds[::wide]))
        top = F.size(F.filter(tops, lambda x: x <= F.col(self.id_col)))
        inner = F.size(F.filter(F.slice(every, (top - 1) * wide + 1, F.lit(wide)), lambda x: x <= F.col(self.id_col)))
        return F.when(top > 0, (top - 1) * wide + inner).otherwise(0)

    def followers(self, docs: DataFrame, text: str) -> DataFrame:
        """The first row of each range, numbered for the range before it; the table's first row for the last range."""
        i, last = F.col(self.id_col), len(self.bounds)
        first = docs.where(i.isin(*self.bounds)) if self.bounds else docs.where(F.lit(False))
        first = first.groupBy(self.id_col).agg(F.min(text).alias(text)).withColumn("range", self.number() - 1)
        start = docs.where(i.isNull() if self.nulls else i == F.lit(self.least)).groupBy(self.id_col).agg(F.min(text).alias(text)).withColumn("range", F.lit(last))
        return first.unionByName(start)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """range, rn, follower, `id_col`, text, n_chars, edited: each text, and with its last half replaced from the next row's start."""
    spark = docs.sparkSession
    plain = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias(text))
    parts = Ranges(plain, id_col, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = plain.withColumn("range", parts.number()).withColumn("follower", F.lit(False)).unionByName(parts.followers(plain, text).withColumn("follower", F.lit(True)))
    order = Window.partitionBy("range").orderBy("follower", F.col(id_col).asc_nulls_first(), text)
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead(text).over(order)).withColumn("n_chars", F.length(text).cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half))
    return rows.select("range", "rn", "follower", id_col, text, "n_chars", edited.alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row's fingerprint, its edited text's and its successor's, as two halves each. One exchange, of the texts by range."""
    rows = with_edited(docs, id_col, text, ranges)
    sha = F.sha2(F.col("edited"), 256)
    words = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"s{k}") for k in range(4)]
    keys = ["range", "rn", "follower", id_col, "n_chars", "s0", "s1", "s2", "s3"]
    got = votes(rows.select(*keys[:5], *words, text, "edited"), keys, [text, "edited"])
    order = Window.partitionBy("range").orderBy("rn")
    got = got.withColumn("next_high", F.lead("high0").over(order)).withColumn("next_low", F.lead("low0").over(order)).where(~F.col("follower"))
    return got.select(id_col, "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"s{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"), F.col("high0").alias("high"), F.col("low0").alias("low"), F.col("high1").alias("edited_high"), F.col("low1").alias("edited_low"), "next_high", "next_low")


def within(prints: DataFrame, radius: int = 3, chunk: int = 128) -> DataFrame:
    """high, low, n_near: how many other distinct fingerprints of `prints` are within `radius` bits (of those that have any).

    Each pair counts in the first table whose block it shares. Rows made are fingerprints times chunks of their key."""
    blocks = radius + 1
    size = -(-BITS // blocks)

    def block(high: Column, low: Column, k: int) -> Column:
        """Bits k*size and on; blocks don't straddle the halves where size divides 64."""
        out = F.lit(0).cast("long")
        for half, start in ((high, 0), (low, 64)):
            a, z = max(k * size, start) - start, min((k + 1) * size, start + 64, BITS) - start
            if z > a:
                mask = (1 << (z - a)) - 1
                part = F.shiftrightunsigned(half, a).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))
                out = out * F.lit(1 << min(z - a, 62)).cast("long") + part if start and k * size < 64 else part
        return out

    distinct = prints.select("high", "low").distinct()
    tables = distinct.select("high", "low", F.posexplode(F.array(*[block(F.col("high"), F.col("low"), k) for k in range(blocks)])).alias("table", "key"))
    shared = tables.groupBy("table", "key").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / chunk).cast("int")
    member = tables.join(shared, ["table", "key"]).withColumn("part", F.pmod(F.xxhash64("high", "low"), parts).cast("int"))
    chunks = member.groupBy("table", "key", "part").agg(F.collect_list(F.struct("high", "low")).alias("others"))
    asked = member.select("high", "low", "table", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = asked.join(chunks, ["table", "key", "part"])

    def near(o: Column) -> Column:
        x, y = (F.col("high"), F.col("low")), (o["high"], o["low"])
        ok = (distance(x, y) <= radius) & ((x[0] != y[0]) | (x[1] != y[1]))
        for k in range(blocks - 1):
            ok = ok & ((F.col("table") <= k) | (block(*x, k) != block(*y, k)))
        return ok

    return both.select("high", "low", F.size(F.filter("others", near)).alias("n")).where("n > 0").groupBy("high", "low").agg(F.sum("n").alias("n_near"))
