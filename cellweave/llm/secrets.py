"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the spans of three base kinds (assign, access, hex) and of `owned`: runs of 24 or more letters, digits
and +/_-, of any length, that have both letters and digits. Their hashes (128 bits) are aggregated by distinct repository and owner. A value that
many repositories and many owners hold is a widely copied example; all others are live-looking. How many are many follows
the table (see `copied`), unless `max_owners` is given: then more owners than that are many, whatever the repositories. Base spans are always reported;
spans of kind `owned` are reported where their value is live-looking and no base span covers the same place.

Defined results: null text counts as empty and has no spans; an empty table gives no rows. A null repository or owner counts as one more of its kind.
Rows that repeat get the same result each. Offsets are code points, ends exclusive. Of equal values, all places count alike. Extra columns are
dropped by `scan` unless in `keep`, and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
OWNED = r"([A-Za-z0-9+/_-]{24,})"
#: kind, pattern with the value as group 1, a quick test for texts without any, least length of the value. Runs of hex
#: digits are maximal, so their least length can stand in the pattern; elsewhere it is tested after matching.
KINDS = (("assign", ASSIGN, r"(?i)(?:passw|secret|token|api_?key)[^\n]*[:=]|(?:passw|secret|token|key)", 8), ("access", ACCESS, "AKIA", 16), ("hex", HEX, "[0-9a-f]{32}", 32), ("owned", OWNED, r"[A-Za-z0-9+/_-]{24}", 24))
#: What else a value of a kind must hold; tested on the whole value, in linear time.
HOLDS = {"owned": ("[0-9]", "[A-Za-z]")}
#: Matches that are added up at once, so that a text with very many takes no quadratic time.
STEP = 256
SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, no: int) -> Column:
    """All matches of a kind: their places follow from the lengths of the pieces between them."""
    kind, pattern, quick, least = KINDS[no]
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, 1))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        end = a + F.length(x["whole"])
        span = F.struct(a.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        good = F.length(x["value"]) >= least
        for one in HOLDS.get(kind, ()):
            good = good & x["value"].rlike(one)
        return F.struct(F.coalesce(end, a).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def some(acc: Column, k: Column) -> Column:
        made = F.aggregate(F.slice(found, k * STEP + 1, STEP), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(made), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    steps = F.sequence(F.lit(0), F.floor(F.size(found) / STEP).cast("int"))
    return F.when(text.rlike(quick), F.flatten(F.aggregate(steps, start, some, lambda acc: acc["out"]))).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: What tells rows apart: the id, and a hash of it and the text.
ROW = ["cw_id", "cw_key"]


def row_key(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    return [F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("cw_id"), F.xxhash64(docs[id_col], F.coalesce(docs[text], F.lit(""))).alias("cw_key")]


def value_hash(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def candidates(docs: DataFrame, keep: list[str], repository: str, owner: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `keep`, cw_id, cw_key, cw_repository, cw_owner, base, owned: the spans of each whole text."""
    plain = F.coalesce(docs[text], F.lit(""))
    base = F.array_sort(F.concat(*[_spans(plain, k) for k in range(3)]))
    out = docs.select(*keep, *row_key(docs, id_col, text), docs[repository].alias("cw_repository"), docs[owner].alias("cw_owner"), base.alias("base"), _spans(plain, 3).alias("owned"))
    return out.withColumn("owned", F.filter("owned", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories, owners: distinct holders of each candidate value. Both counts are made in two steps, the
    first of which a widely copied value passes as one row a task and holder."""
    held = found.where((F.size("base") > 0) | (F.size("owned") > 0)).select("cw_repository", "cw_owner", F.explode(F.concat("base", "owned")).alias("s"))
    held = held.select(value_hash(F.col("s.value")).alias("value_hash"), F.coalesce(F.col("cw_repository").cast("string"), F.lit("\0")).alias("r"), F.coalesce(F.col("cw_owner").cast("string"), F.lit("\0")).alias("o"))
    repositories = held.groupBy("value_hash", "r").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    owners = held.groupBy("value_hash", "o").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "value_hash")


def copied(found: DataFrame, max_owners: int | None) -> Column:
    """Whether a value is widely copied: at least a hundredth of the table's repositories, but 2 to 100, and a quarter of its owners,
    but 2 to 10, hold it."""
    if max_owners is not None:
        return F.col("owners") > max_owners
    repositories, owners = (found.groupBy(c).agg(F.lit(1).alias("one")).agg(F.count("*")).first()[0] for c in ("cw_repository", "cw_owner"))
    return (F.col("repositories") >= min(100, max(2, -(-repositories // 100)))) & (F.col("owners") >= min(10, max(2, -(-owners // 4))))


def judged(found: DataFrame, max_owners: int | None) -> DataFrame:
    """cw_id, cw_key and their spans with repositories, owners and live (not widely copied); distinct."""
    each = found.where((F.size("base") > 0) | (F.size("owned") > 0)).select(*ROW, F.explode(F.concat("base", "owned")).alias("s")).distinct()
    return each.withColumn("value_hash", value_hash(F.col("s.value"))).join(ownership(found), "value_hash").select(*ROW, "s", "repositories", "owners", (~copied(found, max_owners)).alias("live"))


def scan(docs: DataFrame, keep: list[str], repository: str = "doc_id", owner: str = "source", id_col: str = "doc_id", text: str = "text", max_owners: int | None = None) -> DataFrame:
    """For each row `keep`, base, spans (base and live `owned` ones), n_live, n_copied."""
    found = materialise(candidates(docs, keep, repository, owner, id_col, text), "secrets")
    by_row = judged(found, max_owners).groupBy(*ROW).agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.collect_list(F.when(F.col("live") & (F.col("s.kind") == "owned"), F.col("s"))).alias("more"))
    out = found.join(by_row, ROW, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select(*keep, "base", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", id_col: str = "doc_id", text: str = "text", max_owners: int | None = None, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the live-looking spans of each text replaced by `mark`; widely copied examples stay."""
    found = materialise(candidates(docs, [], repository, owner, id_col, text), "secrets")
    own_id, own_key, cut = unused(docs, "id", "key", "live")
    live = judged(found, max_owners).where("live").groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end"))).alias(cut)).withColumnsRenamed({ROW[0]: own_id, ROW[1]: own_key})
    keyed = docs.withColumns(dict(zip((own_id, own_key), row_key(docs, id_col, text), strict=True))).join(live, [own_id, own_key], "left")
    body = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        more = F.concat(acc["out"], F.array(F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    clean = F.aggregate(cut, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))), ""))
    return keyed.select(*[F.when(F.col(cut).isNull(), body).otherwise(clean).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
