"""Feature tables from token annotations, as window functions and aggregations. All partition by document and sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["document_id", "sentence_id"]
#: Tags of tokens that are not kept. Fixed values.
SKIPPED_TAGS = (",", ".", ":", "``", "''", "$", "SYM", "HYPH", "NFP", "AFX", "LS", "X", "-LRB-", "-RRB-", "FW", "ADD")
#: Tags of tokens that the tag table leaves out. Fixed values.
UNTAGGED = (",", ".", ":", "`", "'", "$", "SYM", "HYPH", "NFP", "AFX", "LS", "X", "-LRB-", "-RRB-", "FW", "", "''", "DT", "WDT", "CC", "PRP$", "POS", "EX", "UH", "IN")
#: Tags that n-grams leave out. Fixed values.
NO_GRAM = ("FW", "ADD")
#: Relations that the dependency table leaves out. Fixed values.
NO_RELATION = ("punct", "dep", "det")
#: Characters of a sentence that are kept; characters between neighbours.
SENTENCE_END, GAP = 150, 2


def keep_token(token: Column, pos: Column) -> Column:
    return token.isNotNull() & (F.trim(token) != "") & (pos.isNull() | ~pos.isin(*SKIPPED_TAGS)) & token.rlike(r"[\p{L}\p{Nd}]") & ~token.startswith("'")


def relative_offsets(tokens: DataFrame) -> DataFrame:
    """Offsets from the sentence's first token; from the first token that ends past the limit on, the sentence is dropped."""
    whole = Window.partitionBy(*CELL)
    so_far = whole.orderBy("begin_char", "end_char").rowsBetween(Window.unboundedPreceding, 0)
    base = F.min("begin_char").over(whole)
    moved = tokens.withColumn("base", base).withColumn("begin_char", F.col("begin_char") - F.col("base")).withColumn("end_char", F.col("end_char") - F.col("base"))
    return moved.withColumn("furthest", F.max("end_char").over(so_far)).where(F.col("furthest") <= SENTENCE_END).drop("base", "furthest")


def not_stopword(c: Column, stopwords: frozenset[str]) -> Column:
    return ~c.isin(*sorted(stopwords)) if stopwords else F.lit(True)


def _words(annotations: DataFrame) -> DataFrame:
    return annotations.select(*CELL, "begin_char", "end_char", F.lower(F.trim("token")).alias("term"), "pos").where("term <> ''")


def unigrams(annotations: DataFrame, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """document_id, sentence_id, term, begin, end. Tokens without a tag stay."""
    rows = _words(annotations).where(F.col("pos").isNull() | ~F.col("pos").isin(*NO_GRAM)).where(not_stopword(F.col("term"), stopwords))
    return rows.select(*CELL, "term", F.col("begin_char").alias("begin"), F.col("end_char").alias("end"))


def ngrams(annotations: DataFrame, n: int, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """Runs of n tokens of a sentence with gaps of at most two characters and no stopword. Tokens without a tag are left out
    for n over 1. Words that are dropped here leave their gap; stopwords stay in line and break runs."""
    if n == 1:
        return unigrams(annotations, stopwords)
    line = Window.partitionBy(*CELL).orderBy("begin_char", "end_char", "term")
    rows = _words(annotations).where(F.col("pos").isNotNull() & ~F.col("pos").isin(*NO_GRAM))
    for k in range(1, n):
        rows = rows.withColumn(f"t{k}", F.lead("term", k).over(line)).withColumn(f"b{k}", F.lead("begin_char", k).over(line)).withColumn(f"e{k}", F.lead("end_char", k).over(line))
    good = not_stopword(F.col("term"), stopwords)
    for k in range(1, n):
        good = good & F.col(f"t{k}").isNotNull() & not_stopword(F.col(f"t{k}"), stopwords) & (F.col(f"b{k}") <= F.col("end_char" if k == 1 else f"e{k - 1}") + GAP)
    return rows.where(good).select(*CELL, F.concat_ws(" ", "term", *[f"t{k}" for k in range(1, n)]).alias("term"), F.col("begin_char").alias("begin"), F.col(f"e{n - 1}").alias("end"))


def _islands(rows: DataFrame, key: str) -> DataFrame:
    """`island`: neighbours of one cell with equal `key` and a gap of at most two characters share a number."""
    line = Window.partitionBy(*CELL).orderBy("begin_char", "end_char")
    opens = F.lag(key).over(line).isNull() | (F.lag(key).over(line) != F.col(key)) | (F.col("begin_char") > F.lag("end_char").over(line) + GAP)
    return rows.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def entities(annotations: DataFrame) -> DataFrame:
    """document_id, sentence_id, type, value, begin, end: runs of one tag become one entity."""
    rows = annotations.where(F.col("ner").isNotNull() & ~F.upper("ner").isin("O", "DATE", "") & F.col("token").isNotNull()).select(*CELL, "begin_char", "end_char", "token", F.upper("ner").alias("type"))
    merged = _islands(rows, "type").groupBy(*CELL, "island", "type").agg(F.min("begin_char").alias("begin"), F.max("end_char").alias("end"), F.array_sort(F.collect_list(F.struct("begin_char", "end_char", "token"))).alias("parts"))
    return merged.select(*CELL, "type", F.lower(F.array_join(F.col("parts.token"), " ")).alias("value"), "begin", "end")


def normal_date(text: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy to a day; null for all else, for blanks and for year 0."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    return F.when(~t.startswith("0000"), F.try_to_date(full, "yyyy-MM-dd"))


def dates(annotations: DataFrame) -> DataFrame:
    """document_id, sentence_id, date, begin, end: normalised dates, equal neighbours merged."""
    rows = annotations.where(F.upper("ner") == "DATE").select(*CELL, "begin_char", "end_char", normal_date(F.col("normalized_ner")).alias("date")).where("date is not null")
    return _islands(rows, "date").groupBy(*CELL, "island", "date").agg(F.min("begin_char").alias("begin"), F.max("end_char").alias("end")).drop("island")


def tags(annotations: DataFrame) -> DataFrame:
    """document_id, sentence_id, tag, term, begin, end."""
    rows = annotations.where(F.col("pos").isNotNull() & ~F.col("pos").isin(*UNTAGGED) & (F.length(F.trim("token")) > 1))
    return rows.select(*CELL, F.upper("pos").alias("tag"), F.lower("token").alias("term"), F.col("begin_char").alias("begin"), F.col("end_char").alias("end"))


def dependencies(rows: DataFrame, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """document_id, sentence_id, head, relation, dependent, begin, end."""
    low = rows.select(*CELL, F.lower("head_token").alias("head"), F.lower("relation").alias("relation"), F.lower("dependent_token").alias("dependent"), F.col("begin_char").alias("begin"), F.col("end_char").alias("end"))
    return low.where(F.col("head").isNotNull() & F.col("dependent").isNotNull() & ~F.col("relation").isin(*NO_RELATION)).where(not_stopword(F.col("head"), stopwords) & not_stopword(F.col("dependent"), stopwords))


def postings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document_id, sentence_id, begins: distinct, ascending."""
    return rows.groupBy(*keys, *CELL).agg(F.array_sort(F.collect_set("begin")).alias("begins"))


def posting_union(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Postings of several tables as one: cells united, begins merged without repeats."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys, *CELL).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("begins")))).alias("begins"))


def restrict(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Occurrences whose cell survives."""
    return rows.join(cells, CELL, "left_semi")


def stitch(grams: DataFrame, notes: DataFrame, kind: str | None = None) -> DataFrame:
    """ngram, type, value, document_id, sentence_id, begins: n-grams beside each annotation of their sentence.
    `notes` has `value`, and `type` unless `kind` names it."""
    note = notes.select(*CELL, (F.lit(kind) if kind else F.col("type")).alias("type"), F.col("value").cast("string").alias("value")).distinct()
    per = grams.groupBy(*CELL, F.col("term").alias("ngram")).agg(F.array_sort(F.collect_set("begin")).alias("begins"))
    return per.join(note, CELL).select("ngram", "type", "value", *CELL, "begins")


def stitch_faults(stitched: DataFrame, grams: DataFrame, notes: DataFrame, kind: str | None = None) -> DataFrame:
    """Cells whose number of stitched rows is not distinct n-grams times distinct annotations."""
    a = grams.groupBy(*CELL).agg(F.count_distinct("term").alias("n_grams"))
    note = notes.select(*CELL, (F.lit(kind) if kind else F.col("type")).alias("type"), F.col("value").cast("string").alias("value")).distinct()
    b = note.groupBy(*CELL).agg(F.count("*").alias("n_notes"))
    s = stitched.groupBy(*CELL).agg(F.count("*").alias("n_rows"))
    return a.join(b, CELL).join(s, CELL, "left").where(F.coalesce("n_rows", F.lit(0)) != F.col("n_grams") * F.col("n_notes"))


def index_faults(corpus, grams: tuple[int, ...], stitched: tuple[tuple[str, int], ...]) -> DataFrame:
    """check, faults: what each check of a corpus' tables finds. Terms are not blank and have at most n words, offsets run forward, cells of
    longer n-grams have words, documents are known, and stitched tables are the product of their cells' n-grams and annotations."""
    known, out = corpus.documents.select("document_id"), []

    def tell(name: str, faults: DataFrame) -> None:
        out.append(faults.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults"))

    for n in grams:
        rows = corpus.grams(n)
        tell(f"gram {n}: blank term", rows.where(F.col("term").isNull() | (F.trim("term") == "")))
        tell(f"gram {n}: too many words", rows.where(F.size(F.split("term", " ")) > n))
        tell(f"gram {n}: offsets out of order", rows.where("begin > end"))
        tell(f"gram {n}: cell without word", rows.join(corpus.cells, CELL, "left_anti"))
        tell(f"gram {n}: unknown document", rows.join(known, "document_id", "left_anti"))
    for name in ("entities", "dates", "tags", "dependencies"):
        if corpus.has(name):
            tell(f"{name}: unknown document", corpus.table(name).join(known, "document_id", "left_anti"))
    tables = {"ner": ("entities", {}, None), "date": ("dates", {"date": "value"}, "DATE"), "pos": ("tags", {"tag": "type", "term": "value"}, None)}
    for kind, n in stitched:
        table, names, fixed = tables[kind]
        tell(f"stitched {kind} {n}: not the product", stitch_faults(corpus.stitched(kind, n), corpus.grams(n), corpus.table(table).withColumnsRenamed(names), fixed))
    made = out[0]
    for one in out[1:]:
        made = made.unionByName(one)
    return made


def renumbered(documents: DataFrame, annotated: DataFrame) -> DataFrame:
    """old_id, new_id of documents without annotations, numbered above the largest annotated id in order of their ids.

    Numbers come from counts a range of ids and places in it, so no task sees all rows."""
    rest = documents.select("document_id").join(annotated.select("document_id").distinct(), "document_id", "left_anti")
    top = annotated.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("top"))
    ranged = rest.withColumn("range", F.floor(F.col("document_id") / 4096))
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("coarse", F.floor(F.col("range") / 4096))
    heads = before.groupBy("coarse").agg(F.sum("n").alias("m")).withColumn("skipped", F.sum("m").over(Window.orderBy("coarse")) - F.col("m"))
    offset = before.join(heads, "coarse").withColumn("offset", F.col("skipped") + F.sum("n").over(Window.partitionBy("coarse").orderBy("range")) - F.col("n"))
    placed = ranged.join(offset.select("range", "offset"), "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("document_id")))
    return placed.crossJoin(F.broadcast(top)).select(F.col("document_id").alias("old_id"), (F.col("top") + F.col("offset") + F.col("place")).alias("new_id"))
