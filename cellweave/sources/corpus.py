"""A corpus: named feature tables over (document, sentence) cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import features

from . import sinks

GRAM = "document_id long, sentence_id long, term string, begin int, end int"


class Corpus:
    """Feature tables, each built only when a query reads it.

    grams(n): document_id, sentence_id, term, begin, end · entities: type, value · dates: date · tags: tag, term ·
    dependencies: head, relation, dependent · documents: document_id, title, text, timestamp ·
    sentences: document_id, sentence_id, offset (of the sentence's first word in the text; None where offsets count from the text's start) ·
    stitched(kind, n): n-grams beside annotations of kind ner, date or pos, where such a table is stored, else None ·
    grams_of(n, words): as grams(n), but sentences without all of these words (or beginnings of words) may be missing."""

    def __init__(self, documents: DataFrame, grams: Callable[[int], DataFrame], entities: Callable[[], DataFrame] | None = None, dates: Callable[[], DataFrame] | None = None, tags: Callable[[], DataFrame] | None = None, dependencies: Callable[[], DataFrame] | None = None, sentences: DataFrame | None = None, stitched: Callable[[str, int], DataFrame | None] = lambda kind, n: None, grams_of: Callable[[int, tuple[str, ...]], DataFrame] | None = None):
        self.documents, self.grams, self.sentences, self.stitched = documents, grams, sentences, stitched
        self.grams_of = grams_of or (lambda n, words: grams(n))
        self._made = {"entities": entities, "dates": dates, "tags": tags, "dependencies": dependencies}

    def has(self, name: str) -> bool:
        return self._made[name] is not None

    def table(self, name: str) -> DataFrame:
        return self._made[name]()

    @cached_property
    def cells(self) -> DataFrame:
        """The universe: cells with at least one indexed word."""
        return self.grams(1).select(*features.CELL).distinct()


def from_annotations(documents: DataFrame, annotations: DataFrame, dependencies: DataFrame | None = None, stopwords: frozenset[str] = frozenset(), sentences: DataFrame | None = None) -> Corpus:
    return Corpus(documents, lambda n: features.ngrams(annotations, n, stopwords), lambda: features.entities(annotations), lambda: features.dates(annotations), lambda: features.tags(annotations), (lambda: features.dependencies(dependencies, stopwords)) if dependencies is not None else None, sentences)


SENTENCE_END, WORD = r"[.!?\n]+", r"[\p{L}\p{N}]+"


def running_sums(rows: DataFrame, values: str, out: str, levels: int = 3, width: int = 64) -> DataFrame:
    """Adds `out`: the running sums of `values`, an array of ints, within the row. Sums are taken within runs of `width` and then over the runs'
    sums, in `levels` levels, as an array that grows by one is copied each time."""

    def plain(c: Column) -> Column:
        return F.aggregate(c, F.array().cast("array<int>"), lambda made, x: F.concat(made, F.array(x + F.coalesce(F.try_element_at(made, F.lit(-1)), F.lit(0)))))

    if levels == 1:
        return rows.withColumn(out, plain(F.col(values)))
    runs, last, sums = f"{out}_runs", f"{out}_last", f"{out}_sums"
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(width))
    rows = rows.withColumn(runs, F.transform(starts, lambda at: plain(F.slice(values, at, F.lit(width)))))
    rows = rows.withColumn(last, F.transform(runs, lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0))))
    rows = running_sums(rows, last, sums, levels - 1, width)
    moved = F.zip_with(runs, F.arrays_zip(F.col(last).alias("own"), F.col(sums).alias("sum")), lambda r, s: F.transform(r, lambda x: x + s["sum"] - s["own"]))
    return rows.withColumn(out, F.flatten(moved)).drop(runs, last, sums)


def sentence_offsets(documents: DataFrame) -> DataFrame:
    """document_id, sentence_id, offset: where in its text the first word of each sentence of `annotate` begins."""
    parts = documents.select("document_id", F.split("text", SENTENCE_END).alias("piece"), F.regexp_extract_all("text", F.lit(SENTENCE_END), F.lit(0)).alias("gap"))
    parts = parts.select("document_id", "piece", F.transform(F.arrays_zip("piece", "gap"), lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("size"))
    rows = running_sums(parts, "size", "end").select("document_id", F.posexplode(F.arrays_zip("piece", "size", "end")).alias("sentence_id", "x"))
    lead = F.length(F.split("x.piece", WORD, 2)[0])
    return rows.where(F.col("x.piece").rlike(r"[\p{L}\p{N}]")).select("document_id", F.col("sentence_id").cast("long"), (F.col("x.end") - F.col("x.size") + lead).alias("offset"))


def annotate(documents: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """The default annotator, in native expressions: sentences end at . ! ? or a line break, words are runs of letters and digits.
    Numbers of four digits from 1925 to 2025 are dates; other words have the tag NN and no entity. Offsets count from the sentence's first word
    and are made within the row, so words are not exchanged for them. With `words` (in lower case) sentences that cannot hold all of them may be left out."""
    sentence = documents.select("document_id", F.posexplode(F.split("text", SENTENCE_END)).alias("sentence_id", "sentence")).where(F.col("sentence").rlike(r"[\p{L}\p{N}]"))
    for w in words:
        # a sigma's lower case depends on what follows the word
        if w and not set(w) & set("σς"):
            sentence = sentence.where(F.lower("sentence").contains(w))
    # the gaps before the words and the words: lengths add up to offsets
    split = sentence.select("document_id", F.col("sentence_id").cast("long"), F.regexp_extract_all("sentence", F.lit(WORD), F.lit(0)).alias("token"), F.split("sentence", WORD, -1).alias("gap"))
    split = split.select("document_id", "sentence_id", "token", F.length(F.col("gap")[0]).alias("lead"), F.transform("token", lambda w, k: F.length(w) + F.length(F.get("gap", k))).alias("size"))
    rows = running_sums(split, "size", "end").select("document_id", "sentence_id", "lead", F.explode(F.arrays_zip("token", "end")).alias("x"))
    year = F.col("token").rlike(r"^(19[2-9]\d|20[01]\d|202[0-5])$")
    made = rows.select("document_id", "sentence_id", (F.col("x.end") - F.col("lead")).alias("end_char"), F.col("x.token").alias("token"))
    return made.select("document_id", "sentence_id", (F.col("end_char") - F.length("token")).alias("begin_char"), "end_char", "token", F.lit("NN").alias("pos"), F.when(year, "DATE").otherwise("O").alias("ner"), F.when(year, F.col("token")).alias("normalized_ner"))


def text_corpus(spark: SparkSession, path: str, table: str = "documents", key: str = "doc_id", title: str = "source", stopwords: frozenset[str] = frozenset()) -> Corpus:
    rows = spark.read.parquet(f"{path}/{table}.parquet")
    documents = rows.select(F.col(key).alias("document_id"), F.col(title).cast("string").alias("title"), "text", F.lit(None).cast("string").alias("timestamp"))
    out = from_annotations(documents, annotate(documents), None, stopwords, sentence_offsets(documents))
    out.grams_of = lambda n, words: features.ngrams(annotate(documents, words), n, stopwords)
    return out


def relational_corpus(spark: SparkSession, path: str) -> Corpus:
    """Orders as documents, order lines as sentences: the part's name is the text, and the names and dates beside it are entities.
    Each table joins only what it needs."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    cell = [F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("sentence_id")]
    line = read("lineitem")
    zero = F.lit(0)

    def named() -> DataFrame:
        part = read("part").select("p_partkey", F.lower("p_name").alias("name"), F.split(F.lower("p_name"), " ")[0].alias("w1"), F.split(F.lower("p_name"), " ")[1].alias("w2"))
        return line.join(part, line["l_partkey"] == part["p_partkey"])

    def words(rows: DataFrame) -> DataFrame:
        first, second = F.struct(F.col("w1").alias("term"), zero.alias("begin"), F.length("w1").alias("end"), F.lit("JJ").alias("tag")), F.struct(F.col("w2").alias("term"), (F.length("w1") + 1).alias("begin"), F.length("name").alias("end"), F.lit("NN").alias("tag"))
        return rows.select(*cell, F.inline(F.array(first, second)))

    def grams(n: int) -> DataFrame:
        if n == 1:
            return words(named()).drop("tag")
        if n == 2:
            return named().select(*cell, F.col("name").alias("term"), zero.alias("begin"), F.length("name").alias("end"))
        return spark.createDataFrame([], GRAM)

    def entities() -> DataFrame:
        nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("s_name").alias("o"), F.lower("n_name").alias("c"), F.lower("r_name").alias("l"))
        of_supplier = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(*cell, F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.col(k).alias("value")) for t, k in (("ORGANIZATION", "o"), ("COUNTRY", "c"), ("LOCATION", "l"))])))
        buyer = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.lower("c_name").alias("value"))
        of_buyer = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).select(*cell, F.lit("PERSON").alias("type"), "value")
        return of_supplier.unionByName(of_buyer).withColumns({"begin": zero, "end": F.length("value")})

    def dates() -> DataFrame:
        return line.select(*cell, F.to_date("l_shipdate").alias("date"), zero.alias("begin"), zero.alias("end"))

    def dependencies() -> DataFrame:
        return named().select(*cell, F.col("w2").alias("head"), F.lit("amod").alias("relation"), F.col("w1").alias("dependent"), zero.alias("begin"), F.length("name").alias("end"))

    documents = read("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("title"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.col("o_orderdate").cast("string").alias("timestamp"))
    return Corpus(documents, grams, entities, dates, lambda: words(named()), dependencies)


def event_corpus(spark: SparkSession, path: str) -> Corpus:
    """Users as documents, events as sentences."""
    rows = spark.read.parquet(f"{path}/events.parquet")
    cell, zero = [F.col("user_id").alias("document_id"), F.col("event_id").alias("sentence_id")], F.lit(0)
    documents = rows.select(F.col("user_id").alias("document_id")).distinct().select("document_id", F.concat(F.lit("user "), F.col("document_id")).alias("title"), F.lit("").alias("text"), F.lit(None).cast("string").alias("timestamp"))

    def grams(n: int) -> DataFrame:
        return rows.select(*cell, F.lower("event_type").alias("term"), zero.alias("begin"), F.length("event_type").alias("end")) if n == 1 else spark.createDataFrame([], GRAM)

    return Corpus(documents, grams, None, lambda: rows.select(*cell, F.to_date("ts").alias("date"), zero.alias("begin"), zero.alias("end")))


#: The column that each stored table is searched by. Stitched tables are searched by their n-gram.
KEYS = {"documents": "document_id", "sentences": "document_id", "entities": "value", "dates": "date", "tags": "term", "dependencies": "head"}
NOTES = {"ner": ("entities", None), "date": ("dates", "DATE"), "pos": ("tags", None)}


def _place(path: str, name: str) -> str:
    return f"{path}/{name}"


def store(corpus: Corpus, path: str, grams: tuple[int, ...] = (1, 2, 3), tables: tuple[str, ...] = ("documents", "sentences", "entities", "dates", "tags", "dependencies"), stitched: tuple[tuple[str, int], ...] = ()) -> None:
    """Writes feature tables, each in ranges of its key and sorted by it, so that a lookup reads the files and row groups of its key only.
    A hot key spreads over files by document. `stitched`: which (kind, n) are written as well."""

    def write(rows: DataFrame, name: str, key: str) -> None:
        sinks.features(rows.repartitionByRange(key, "document_id"), _place(path, name), key)

    for n in grams:
        write(corpus.grams(n), f"gram{n}", "term")
    for name in tables:
        rows = corpus.documents if name == "documents" else corpus.sentences if name == "sentences" else corpus.table(name) if corpus.has(name) else None
        if rows is not None:
            write(rows, name, KEYS[name])
    for kind, n in stitched:
        table, type_ = NOTES[kind]
        notes = corpus.table(table).withColumnsRenamed({"tag": "type", "term": "value"} if kind == "pos" else {"date": "value"} if kind == "date" else {})
        write(features.stitch(corpus.grams(n), notes, type_), f"stitched_{kind}{n}", "ngram")


def stored_corpus(spark: SparkSession, path: str) -> Corpus:
    """The corpus that `store` wrote at `path`; nothing is tokenised again, and filters on keys reach the files."""

    def there(name: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(_place(path, name))
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(_place(path, name))

    made = {name: (lambda name=name: read(name)) if there(name) else None for name in ("entities", "dates", "tags", "dependencies")}
    documents = read("documents") if there("documents") else spark.createDataFrame([], "document_id long, title string, text string, timestamp string")
    return Corpus(documents, lambda n: read(f"gram{n}"), *made.values(), read("sentences") if there("sentences") else None, lambda kind, n: read(f"stitched_{kind}{n}") if there(f"stitched_{kind}{n}") else None)
