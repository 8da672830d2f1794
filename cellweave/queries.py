"""One query for each operator of the engine, over whole tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import aggregates, cells, dates
from cellweave.operators import browse, features
from cellweave.plans.engine import Engine, count_pairs
from cellweave.plans.parser import period
from cellweave.sources import corpus, readers, sinks

STOPWORDS = frozenset(("the", "and", "of", "to", "de", "la", "der", "que"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The relational corpus in SQL.
REL = """tok AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS sentence_id, lower(p_name) AS name, split_part(lower(p_name), ' ', 1) AS w1, split_part(lower(p_name), ' ', 2) AS w2 FROM lineitem JOIN part ON l_partkey = p_partkey),
uni AS (SELECT document_id, sentence_id, w1 AS term, 'JJ' AS tag FROM tok UNION ALL SELECT document_id, sentence_id, w2, 'NN' FROM tok),
line AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS sentence_id, l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem),
ent AS (SELECT document_id, sentence_id, 'ORGANIZATION' AS type, lower(s_name) AS value FROM line JOIN supplier ON l_suppkey = s_suppkey UNION ALL
 SELECT document_id, sentence_id, 'COUNTRY', lower(n_name) FROM line JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL
 SELECT document_id, sentence_id, 'LOCATION', lower(r_name) FROM line JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL
 SELECT document_id, sentence_id, 'PERSON', lower(c_name) FROM line JOIN orders ON document_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
#: The text corpus in SQL: words with their place and the length of the gap after them.
TXT = """sent AS (SELECT document_id, unnest(x) AS s, CAST(unnest(range(len(x))) AS BIGINT) AS sentence_id FROM (SELECT doc_id AS document_id, string_split_regex(text, '[.!?\n]+') AS x FROM documents)),
words AS (SELECT document_id, sentence_id, regexp_extract_all(s, '[\\p{L}\\p{N}]+') AS w, string_split_regex(s, '[\\p{L}\\p{N}]+') AS g FROM sent),
tok AS (SELECT document_id, sentence_id, lower(unnest(w)) AS term, unnest(range(len(w))) AS k, length(unnest(g[2:])) AS gap FROM words WHERE len(w) > 0),
seq AS (SELECT *, lead(term, 1) OVER p AS t1, lead(term, 2) OVER p AS t2, lead(gap, 1) OVER p AS gap1 FROM tok WINDOW p AS (PARTITION BY document_id, sentence_id ORDER BY k))"""
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + ")"
CELLS = ["document_id", "sentence_id"]


def rel(spark: SparkSession, path: str, **kw) -> Engine:
    return Engine(spark, {"rel": corpus.relational_corpus(spark, path), "events": corpus.event_corpus(spark, path)}, ordered=False, **kw)


def txt(spark: SparkSession, path: str, stopwords: frozenset[str] = frozenset(), **kw) -> Engine:
    return Engine(spark, {"docs": corpus.text_corpus(spark, path, stopwords=stopwords)}, ordered=False, **kw)


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _language(name: str, text: str, columns: list[str], sql: str, make=rel, base: str = REL, **kw) -> None:
    """A query in the language; `sql` goes on from the corpus' tables in SQL."""
    _add(name, lambda spark, path: make(spark, path, **kw).sql(text).toDF(*columns), f"WITH {base} {sql}")


def _where(name: str, where: str, sql: str, make=rel, base: str = REL, source: str = "rel") -> None:
    """A query for the cells that fit; `sql` selects them."""
    _language(name, f"SELECT DOCUMENT_ID, SENTENCE_ID FROM {source} WHERE {where}", CELLS, f"SELECT DISTINCT document_id, sentence_id FROM ({sql})", make, base)


# scans and word conditions
_where("contains_unigram", "CONTAINS('red')", "SELECT * FROM uni WHERE term = 'red'")
_where("contains_bigram", "CONTAINS('Red widget')", "SELECT * FROM tok WHERE name = 'red widget'")
_where("contains_trigram", "CONTAINS('the', 'and', 'of')", "SELECT * FROM seq WHERE term = 'the' AND t1 = 'and' AND t2 = 'of' AND gap <= 2 AND gap1 <= 2", txt, TXT, "docs")
_where("contains_text", "CONTAINS('the')", "SELECT * FROM tok WHERE term = 'the'", txt, TXT, "docs")
_where("contains_prefix", "CONTAINS('g*')", "SELECT * FROM uni WHERE term LIKE 'g%'")
_where("contains_prefix_bigram", "CONTAINS('red g*')", "SELECT * FROM tok WHERE name LIKE 'red g%'")
_language("contains_bind", "SELECT w, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('r*') BIND w", ["w", *CELLS], "SELECT min(term) AS w, document_id, sentence_id FROM uni WHERE term LIKE 'r%' GROUP BY ALL")
# entity, tag and dependency conditions
_where("ner_type", "NER(LOCATION)", "SELECT * FROM ent WHERE type = 'LOCATION'")
_where("ner_targets", "NER(LOCATION, 'Asia', 'EUROPE')", "SELECT * FROM ent WHERE type = 'LOCATION' AND value IN ('asia', 'europe')")
_language("ner_bind", "SELECT p, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE NER(ORGANIZATION) BIND p", ["p", *CELLS], "SELECT min(value) AS p, document_id, sentence_id FROM ent WHERE type = 'ORGANIZATION' GROUP BY ALL")
_where("ner_date", "NER(DATE)", "SELECT * FROM line")
_where("pos_tag", "POS(NN)", "SELECT * FROM uni WHERE tag = 'NN'")
_where("pos_term", "POS('jj', 'Red')", "SELECT * FROM uni WHERE tag = 'JJ' AND term = 'red'")
_language("pos_bind", "SELECT w, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE POS(JJ) BIND w", ["w", *CELLS], "SELECT min(term) AS w, document_id, sentence_id FROM uni WHERE tag = 'JJ' GROUP BY ALL")
_where("depends_exact", "DEPENDS('widget', 'amod', 'red')", "SELECT * FROM tok WHERE w2 = 'widget' AND w1 = 'red'")
_language("depends_wildcard", "SELECT a, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE DEPENDS('widget', 'amod', *) BIND a", ["a", *CELLS], "SELECT min(w1) AS a, document_id, sentence_id FROM tok WHERE w2 = 'widget' GROUP BY ALL")
# dates
for _name, _text, _sql in (
    ("date_eq_year", "= 1997", "d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
    ("date_eq_month", "== 1997-02", "d BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'"),
    ("date_eq_day", "= 1997-02-05", "d = DATE '1997-02-05'"),
    ("date_lt", "< 1996-03", "d < DATE '1996-03-01'"),
    ("date_le", "<= 1996-03", "d <= DATE '1996-03-31'"),
    ("date_gt", "> 2000", "d > DATE '2000-01-01'"),
    ("date_ge", ">= 2001-06-15", "d >= DATE '2001-06-15'"),
    ("date_intersect", "INTERSECT [1996, 1997]", "d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    ("date_contains", "CONTAINS 1998-01, 1998-02", "d BETWEEN DATE '1998-01-01' AND DATE '1998-02-28'"),
    ("date_contained_by", "CONTAINED_BY 1999-05-05", "d = DATE '1999-05-05'"),
    ("date_before", "BEFORE 1995-06", "d < DATE '1995-06-01'"),
    ("date_after", "AFTER 2001-01", "d > DATE '2001-01-01'"),
):
    _where(_name, f"DATE({_text})", f"SELECT * FROM line WHERE {_sql}")
_language("date_bind", "SELECT when_, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE DATE(= 1996) BIND when_", ["d", *CELLS], "SELECT CAST(min(d) AS VARCHAR) AS d, document_id, sentence_id FROM line WHERE year(d) = 1996 GROUP BY document_id, sentence_id")
# algebra of cells
RED, ASIA = "SELECT document_id, sentence_id FROM uni WHERE term = 'red'", "SELECT document_id, sentence_id FROM ent WHERE type = 'LOCATION' AND value = 'asia'"
Y97 = "SELECT document_id, sentence_id FROM line WHERE year(d) = 1997"
_where("and_cells", "NER(LOCATION, 'asia') AND CONTAINS('red') AND DATE(= 1997)", f"{RED} INTERSECT {ASIA} INTERSECT {Y97}")
_where("or_cells", "CONTAINS('red') OR NER(LOCATION, 'asia')", f"{RED} UNION {ASIA}")
_where("not_cells", "NOT CONTAINS('red')", f"SELECT document_id, sentence_id FROM uni EXCEPT {RED}")
_where("and_not_cells", "NER(LOCATION, 'asia') AND NOT (CONTAINS('red') OR DATE(= 1997))", f"{ASIA} EXCEPT ({RED} UNION {Y97})")
_where("mixed_precedence", "CONTAINS('red') OR NER(LOCATION, 'asia') AND DATE(= 1997)", f"({RED} UNION {ASIA}) INTERSECT {Y97}")
_language("or_bindings", "SELECT v, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE NER(LOCATION, 'asia') BIND v OR POS(JJ, 'red') BIND v", ["v", *CELLS], f"SELECT coalesce(a.v, b.v) AS v, document_id, sentence_id FROM (SELECT DISTINCT document_id, sentence_id, 'asia' AS v FROM ({ASIA})) a FULL JOIN (SELECT DISTINCT document_id, sentence_id, 'red' AS v FROM ({RED})) b USING (document_id, sentence_id)")
_language("correlated_operand", "SELECT a, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE POS(JJ) BIND a AND DEPENDS('widget', 'amod', a)", ["a", *CELLS], "SELECT DISTINCT m.a, document_id, sentence_id FROM (SELECT min(w1) AS a, document_id, sentence_id FROM tok GROUP BY ALL) m JOIN tok USING (document_id, sentence_id) WHERE w2 = 'widget' AND w1 = m.a")
# grouping, counting, order
ORG, LOC = "(SELECT min(value) AS p, document_id, sentence_id FROM ent WHERE type = 'ORGANIZATION' GROUP BY ALL)", "(SELECT min(value) AS l, document_id, sentence_id FROM ent WHERE type = 'LOCATION' GROUP BY ALL)"
_language("group_count", "SELECT p, COUNT(*) FROM rel WHERE CONTAINS('red') AND DATE(INTERSECT [1996,1998]) AND NER(ORGANIZATION) BIND p GROUP BY p GRANULARITY SENTENCE ORDER BY COUNT(*) DESC", ["p", "cnt"], f"SELECT p, count(*) AS cnt FROM {ORG} SEMI JOIN ({RED}) USING (document_id, sentence_id) SEMI JOIN (SELECT * FROM line WHERE year(d) BETWEEN 1996 AND 1998) USING (document_id, sentence_id) GROUP BY p")
_language("group_two", "SELECT p, t, COUNT(*) FROM rel WHERE CONTAINS('red') AND DATE(= 1996-05) BIND t AND NER(LOCATION) BIND p GROUP BY p, t ORDER BY COUNT(*)", ["p", "d", "cnt"], f"SELECT l AS p, CAST(d AS VARCHAR) AS d, count(*) AS cnt FROM {LOC} JOIN (SELECT min(d) AS d, document_id, sentence_id FROM line WHERE d BETWEEN DATE '1996-05-01' AND DATE '1996-05-31' GROUP BY document_id, sentence_id) USING (document_id, sentence_id) SEMI JOIN ({RED}) USING (document_id, sentence_id) GROUP BY ALL")
_language("group_default_count", "SELECT l FROM rel WHERE NER(LOCATION) BIND l GROUP BY l", ["l", "cnt"], f"SELECT l, count(*) AS cnt FROM {LOC} GROUP BY l")
_language("count_unique", "SELECT l, COUNT(UNIQUE p) FROM rel WHERE NER(LOCATION) BIND l AND NER(ORGANIZATION) BIND p GROUP BY l", ["l", "cnt"], f"SELECT l, count(DISTINCT p) AS cnt FROM {LOC} JOIN {ORG} USING (document_id, sentence_id) GROUP BY l")
_language("count_documents", "SELECT l, COUNT(DOCUMENTS) FROM rel WHERE NER(LOCATION) BIND l GROUP BY l", ["l", "cnt"], f"SELECT l, count(DISTINCT document_id) AS cnt FROM {LOC} GROUP BY l")
_language("count_var", "SELECT l, COUNT(p) FROM rel WHERE NER(LOCATION) BIND l AND NER(ORGANIZATION) BIND p GROUP BY l", ["l", "cnt"], f"SELECT l, count(p) AS cnt FROM {LOC} JOIN {ORG} USING (document_id, sentence_id) GROUP BY l")
_language("count_global", "SELECT COUNT(*), COUNT(DOCUMENTS) FROM rel WHERE CONTAINS('red')", ["cnt", "docs"], f"SELECT count(*) AS cnt, count(DISTINCT document_id) AS docs FROM (SELECT DISTINCT * FROM ({RED}))")
_language("order_limit", "SELECT p, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE NER(PERSON) BIND p ORDER BY p ASC, DOCUMENT_ID, SENTENCE_ID LIMIT 25", ["p", *CELLS], "SELECT min(value) AS p, document_id, sentence_id FROM ent WHERE type = 'PERSON' GROUP BY ALL ORDER BY p, document_id DESC, sentence_id DESC LIMIT 25")
_language("order_nulls", "SELECT v, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('red') OR NER(LOCATION, 'asia') BIND v ORDER BY v DESC, DOCUMENT_ID ASC, SENTENCE_ID ASC LIMIT 40", ["v", *CELLS], f"SELECT v, document_id, sentence_id FROM (SELECT DISTINCT * FROM ({RED} UNION {ASIA})) LEFT JOIN (SELECT DISTINCT document_id, sentence_id, 'asia' AS v FROM ({ASIA})) USING (document_id, sentence_id) ORDER BY v DESC NULLS FIRST, document_id, sentence_id LIMIT 40")
_language("no_where", "SELECT DOCUMENT_ID, SENTENCE_ID FROM rel", CELLS, "SELECT document_id, sentence_id FROM tok WHERE false")
# projection
_language("project_structural", "SELECT DOCUMENT_ID, SENTENCE_ID, TITLE, TIMESTAMP FROM rel WHERE CONTAINS('red widget')", [*CELLS, "title", "ts"], "SELECT DISTINCT document_id, sentence_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS ts FROM tok JOIN orders ON document_id = o_orderkey WHERE name = 'red widget'")
_language("snippet", "SELECT DOCUMENT_ID, SENTENCE_ID, SNIPPET(w, 4) FROM rel WHERE POS(JJ, 'red') BIND w", [*CELLS, "snip"], "SELECT DISTINCT document_id, sentence_id, trim(substring(t, 1, least(7, length(t)))) || CASE WHEN length(t) > 7 THEN '...' ELSE '' END AS snip FROM uni JOIN (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS t FROM orders) ON document_id = o_orderkey WHERE term = 'red' AND tag = 'JJ'")
_language("begin_end", "SELECT m.DOCUMENT_ID, m.SENTENCE_ID, m.BEGIN, m.END FROM rel ALIAS m WHERE CONTAINS('blue') BIND w", [*CELLS, "b", "e"], "SELECT DISTINCT document_id, sentence_id, CAST(0 AS INTEGER) AS b, CAST(4 AS INTEGER) AS e FROM uni WHERE term = 'blue'")
# joins
ERR, BUY = ("(SELECT DISTINCT user_id AS document_id, event_id AS sentence_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = '%s')" % t for t in ("error", "purchase"))


def _join(name: str, left: str, right: str, kind: str, op: str, sql: str, source: str = "rel", **kw) -> None:
    text = f"SELECT x, b.v, COUNT(*) FROM {source} {kind} JOIN (SELECT v FROM {source} WHERE {right}) ALIAS b ON x {op} b.v WHERE {left} GROUP BY x, b.v"
    _language(name, text, ["x", "y", "cnt"], sql, **kw)


RED_L = f"(SELECT l AS x, document_id, sentence_id FROM {LOC} SEMI JOIN (SELECT * FROM tok WHERE name = 'red widget') USING (document_id, sentence_id))"
OLD_L = "(SELECT min(value) AS y, document_id, sentence_id FROM ent SEMI JOIN (SELECT * FROM tok WHERE name = 'old gear') USING (document_id, sentence_id) WHERE type = 'LOCATION' AND value <> 'asia' GROUP BY document_id, sentence_id)"
_EQ = ("CONTAINS('red widget') AND NER(LOCATION) BIND x", "CONTAINS('old gear') AND NER(LOCATION, 'africa', 'america', 'europe', 'middle east') BIND v")
_join("join_equality", *_EQ, "INNER", "=", f"SELECT x, y, count(*) AS cnt FROM {RED_L} JOIN {OLD_L} ON x = y GROUP BY ALL", pushdown=False)
_join("join_left", *_EQ, "LEFT", "=", f"SELECT x, y, count(*) AS cnt FROM {RED_L} LEFT JOIN {OLD_L} ON x = y GROUP BY ALL")
_join("join_right", _EQ[1].replace("BIND v", "BIND x"), _EQ[0].replace("BIND x", "BIND v"), "RIGHT", "==", f"SELECT b.y AS x, a.x AS y, count(*) AS cnt FROM {RED_L} a LEFT JOIN {OLD_L} b ON a.x = b.y GROUP BY ALL")
_RW = "(SELECT min(d) AS {v}, document_id, sentence_id FROM line WHERE d BETWEEN DATE '{a}' AND DATE '{z}' GROUP BY document_id, sentence_id)"
_D = "(SELECT * FROM {rw} SEMI JOIN (SELECT * FROM tok WHERE name = '{n}') USING (document_id, sentence_id))"
X, Y = _D.format(rw=_RW.format(v="x", a="1996-01-01", z="1996-12-31"), n="red widget"), _D.format(rw=_RW.format(v="y", a="1996-06-01", z="1996-06-30"), n="old gear")
_DATED = ("CONTAINS('red widget') AND DATE(= 1996) BIND x", "CONTAINS('old gear') AND DATE(= 1996-06) BIND v")
for _name, _op, _sql in (("join_before", "BEFORE", "<"), ("join_after", "AFTER", ">"), ("join_interval", "INTERSECT", "=")):
    _join(_name, *_DATED, "INNER", _op, pushdown=_op == "INTERSECT", sql=f"SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, count(*) AS cnt FROM {X} JOIN {Y} ON x {_sql} y GROUP BY ALL")
_join("pushdown_temporal", *_DATED, "INNER", "BEFORE", ORACLES["join_before"].removeprefix(f"WITH {REL} "), pushdown=True)
_join("pushdown_entity", *_EQ, "INNER", "=", ORACLES["join_equality"].removeprefix(f"WITH {REL} "), pushdown=True)
_language("join_chain", "SELECT x, b.v, c.z, COUNT(*) FROM rel JOIN (SELECT v FROM rel WHERE CONTAINS('old gear') AND NER(LOCATION) BIND v) ALIAS b ON x = b.v JOIN (SELECT z FROM rel WHERE CONTAINS('new bolt') AND NER(LOCATION) BIND z) ALIAS c ON b.v = c.z WHERE CONTAINS('red widget') AND NER(LOCATION) BIND x GROUP BY x, b.v, c.z", ["x", "y", "z", "cnt"], f"SELECT x, x AS y, x AS z, a * b * c AS cnt FROM (SELECT x, count(*) AS a FROM {RED_L} GROUP BY x) JOIN (SELECT l AS x, count(*) AS b FROM {LOC} SEMI JOIN (SELECT * FROM tok WHERE name = 'old gear') USING (document_id, sentence_id) GROUP BY l) USING (x) JOIN (SELECT l AS x, count(*) AS c FROM {LOC} SEMI JOIN (SELECT * FROM tok WHERE name = 'new bolt') USING (document_id, sentence_id) GROUP BY l) USING (x)")
_language("join_cells", "SELECT DOCUMENT_ID, COUNT(*) FROM rel JOIN (SELECT DOCUMENT_ID FROM rel WHERE CONTAINS('old gear')) ALIAS b ON DOCUMENT_ID = b.DOCUMENT_ID WHERE CONTAINS('red widget') GROUP BY DOCUMENT_ID", ["document_id", "cnt"], "SELECT document_id, a.n * b.n AS cnt FROM (SELECT document_id, count(DISTINCT sentence_id) AS n FROM tok WHERE name = 'red widget' GROUP BY 1) a JOIN (SELECT document_id, count(DISTINCT sentence_id) AS n FROM tok WHERE name = 'old gear' GROUP BY 1) b USING (document_id)")
_join("event_sequence", "CONTAINS('error') AND DATE(= 2024-01-05) BIND x", "CONTAINS('purchase') AND DATE(= 2024-01) BIND v", "INNER", "BEFORE", f"SELECT CAST(a.d AS VARCHAR) AS x, CAST(b.d AS VARCHAR) AS y, count(*) AS cnt FROM {ERR} a JOIN {BUY} b ON a.d < b.d WHERE a.d = DATE '2024-01-05' AND b.d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL", "events")


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    days = corpus.relational_corpus(spark, path).table("dates")
    return count_pairs(days, days)


_add("pair_counts", pair_counts, "WITH g AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM g a JOIN g b ON a.d < b.d")


# feature tables
def _notes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    return corpus.annotate(rows)


def gram_build(n: int):
    return lambda spark, path: features.ngrams(_notes(spark, path), n, STOPWORDS).select("document_id", "sentence_id", "term").groupBy("term").agg(F.count("*").alias("uses"), F.count_distinct("document_id").alias("docs"))


_ok = [f"{t} NOT IN {STOP_SQL}" for t in ("term", "t1", "t2")]
for _n, _text, _test in ((1, "term", _ok[0]), (2, "term || ' ' || t1", f"t1 IS NOT NULL AND gap <= 2 AND {_ok[0]} AND {_ok[1]}"), (3, "term || ' ' || t1 || ' ' || t2", f"t2 IS NOT NULL AND gap <= 2 AND gap1 <= 2 AND {' AND '.join(_ok)}")):
    _add({1: "stopword_filter", 2: "ngram_bigram_build", 3: "ngram_trigram_build"}[_n], gram_build(_n), f"WITH {TXT} SELECT {_text} AS term, count(*) AS uses, count(DISTINCT document_id) AS docs FROM seq WHERE {_test} GROUP BY 1")


def entity_merge(spark: SparkSession, path: str) -> DataFrame:
    """Events of a user in time order; equal neighbours within two seconds' worth of offsets become one entity."""
    line = Window.partitionBy("document_id", "sentence_id").orderBy("event_id")
    rows = spark.read.parquet(f"{path}/events.parquet").select(F.col("user_id").alias("document_id"), F.lit(0).cast("long").alias("sentence_id"), "event_id", F.col("event_type").alias("token"), F.upper(F.substring("event_type", 1, 1)).alias("ner"))
    rows = rows.withColumn("begin_char", (F.row_number().over(line) * 10).cast("int")).withColumn("end_char", F.col("begin_char") + 8)
    return features.entities(rows.where("ner <> 'V'")).groupBy("document_id", "type", "value").agg(F.count("*").alias("n"), F.min("begin").alias("first_begin"))


_add("entity_merge", entity_merge, """WITH r AS (SELECT user_id AS document_id, event_type AS token, upper(substring(event_type, 1, 1)) AS type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 10 AS INTEGER) AS b FROM events),
f AS (SELECT * FROM r WHERE type <> 'V'),
g AS (SELECT *, CASE WHEN lag(type) OVER p = type AND b <= lag(b) OVER p + 10 THEN 0 ELSE 1 END AS opens FROM f WINDOW p AS (PARTITION BY document_id ORDER BY b)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY b) AS island FROM g),
m AS (SELECT document_id, type, island, string_agg(token, ' ' ORDER BY b) AS value, min(b) AS b FROM i GROUP BY ALL)
SELECT document_id, type, value, count(*) AS n, min(b) AS first_begin FROM m GROUP BY document_id, type, value""")


def date_notes(spark: SparkSession, path: str) -> DataFrame:
    """Order lines as tokens, their ship dates written as a day, a month, a year or nonsense."""
    place = Window.partitionBy("document_id", "sentence_id").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = F.when(F.col("l_suppkey") % 4 == 0, day).when(F.col("l_suppkey") % 4 == 1, F.substring(day, 1, 7)).when(F.col("l_suppkey") % 4 == 2, F.substring(day, 1, 4)).otherwise(F.concat(F.lit("0000-"), F.substring(day, 6, 5)))
    rows = spark.read.parquet(f"{path}/lineitem.parquet").withColumn("document_id", F.col("l_orderkey")).withColumn("sentence_id", F.col("l_linenumber").cast("long"))
    return rows.withColumn("begin_char", (F.row_number().over(place) * 10).cast("int")).select("document_id", "sentence_id", "begin_char", (F.col("begin_char") + 8).alias("end_char"), F.lit("x").alias("token"), F.lit("DATE").alias("ner"), text.alias("normalized_ner"))


_DATES = """r AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS sentence_id, strftime(l_shipdate, '%Y-%m-%d') AS day, l_suppkey % 4 AS m, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) * 10 AS INTEGER) AS b FROM lineitem),
n AS (SELECT document_id, sentence_id, b, CASE m WHEN 0 THEN CAST(day AS DATE) WHEN 1 THEN CAST(substring(day, 1, 7) || '-01' AS DATE) WHEN 2 THEN CAST(substring(day, 1, 4) || '-01-01' AS DATE) END AS date FROM r)"""
_add("date_normalise", lambda spark, path: date_notes(spark, path).groupBy(features.normal_date(F.col("normalized_ner")).alias("date")).agg(F.count("*").alias("n")), f"WITH {_DATES} SELECT date, count(*) AS n FROM n GROUP BY date")
_add("date_merge", lambda spark, path: features.dates(date_notes(spark, path)).select("document_id", "sentence_id", "date", "begin"), f"""WITH {_DATES}, g AS (SELECT *, CASE WHEN lag(date) OVER p = date AND b <= lag(b) OVER p + 10 THEN 0 ELSE 1 END AS opens FROM n WHERE date IS NOT NULL WINDOW p AS (PARTITION BY document_id, sentence_id ORDER BY b)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY document_id, sentence_id ORDER BY b) AS island FROM g) SELECT document_id, sentence_id, date, min(b) AS begin FROM i GROUP BY document_id, sentence_id, date, island""")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    words = corpus.relational_corpus(spark, path).table("tags")
    tag = F.when(F.col("term") == "rod", "DT").when(F.col("term") == "hot", None).when(F.col("term") == "old", "FW").otherwise(F.col("tag"))
    return words.select("document_id", "sentence_id", F.col("begin").alias("begin_char"), F.col("end").alias("end_char"), F.upper("term").alias("token"), tag.alias("pos"))


_add("pos_index", lambda spark, path: features.tags(_tokens(spark, path)).groupBy("tag", "term").agg(F.count("*").alias("n")), f"WITH {REL} SELECT tag, term, count(*) AS n FROM uni WHERE term NOT IN ('rod', 'hot', 'old') GROUP BY ALL")
_add("unigram_index", lambda spark, path: features.postings(features.unigrams(_tokens(spark, path), frozenset(("gear",))), ["term"]).groupBy("term").agg(F.count("*").alias("cells")), f"WITH {REL} SELECT term, count(DISTINCT (document_id, sentence_id)) AS cells FROM uni WHERE term NOT IN ('old', 'gear') GROUP BY term")
_add("keep_tokens", lambda spark, path: _tokens(spark, path).where(features.keep_token(F.col("token"), F.col("pos"))).groupBy("token").agg(F.count("*").alias("n")), f"WITH {REL} SELECT upper(term) AS token, count(*) AS n FROM uni WHERE term <> 'old' GROUP BY 1")


def dependency_index(spark: SparkSession, path: str) -> DataFrame:
    made = corpus.relational_corpus(spark, path).table("dependencies")
    rows = made.select("document_id", "sentence_id", F.col("begin").alias("begin_char"), F.col("end").alias("end_char"), F.upper("head").alias("head_token"), F.when(F.col("dependent") == "new", "det").otherwise("AMOD").alias("relation"), F.col("dependent").alias("dependent_token"))
    return features.dependencies(rows, frozenset(("rod",))).groupBy("head", "relation", "dependent").agg(F.count("*").alias("n"))


_add("dependency_index", dependency_index, f"WITH {REL} SELECT w2 AS head, 'amod' AS relation, w1 AS dependent, count(*) AS n FROM tok WHERE w1 <> 'new' AND w2 <> 'rod' GROUP BY ALL")


def stitched(kind: str, n: int, make=corpus.relational_corpus, by: tuple[str, ...] = ("ngram", "type", "value")):
    def run(spark: SparkSession, path: str) -> DataFrame:
        c = make(spark, path)
        notes = {"ner": lambda: c.table("entities"), "date": lambda: c.table("dates").withColumn("value", F.col("date")), "pos": lambda: c.table("tags").withColumnsRenamed({"tag": "type", "term": "value"})}[kind]()
        return features.stitch(c.grams(n), notes, "DATE" if kind == "date" else None).groupBy(*by).agg(F.count("*").alias("cells"))

    return run


_GRAM = {1: "SELECT DISTINCT document_id, sentence_id, term AS ngram FROM uni", 2: "SELECT DISTINCT document_id, sentence_id, name AS ngram FROM tok"}
_NOTE = {"ner": "SELECT DISTINCT document_id, sentence_id, type, value FROM ent", "date": "SELECT DISTINCT document_id, sentence_id, 'DATE' AS type, CAST(d AS VARCHAR) AS value FROM line", "pos": "SELECT DISTINCT document_id, sentence_id, tag AS type, term AS value FROM uni"}
for _kind in ("ner", "date", "pos"):
    for _n in (1, 2):
        _add(f"stitch_{_kind}" + "_bigram" * (_n == 2), stitched(_kind, _n), f"WITH {REL} SELECT ngram, type, value, count(*) AS cells FROM ({_GRAM[_n]}) JOIN ({_NOTE[_kind]}) USING (document_id, sentence_id) GROUP BY ALL")


def stitch_consistency(spark: SparkSession, path: str) -> DataFrame:
    """Per type, how many stitched rows there are, and how many cells do not have the product of their n-grams and annotations."""
    c = corpus.relational_corpus(spark, path)
    grams, notes = c.grams(1), c.table("entities")
    made = features.stitch(grams, notes)
    faults = features.stitch_faults(made, grams, notes).agg(F.count("*").alias("faults"))
    return made.groupBy("type").agg(F.count("*").alias("rows")).join(F.broadcast(faults))


_add("stitch_consistency", stitch_consistency, f"WITH {REL}, g AS (SELECT document_id, sentence_id, count(DISTINCT term) AS n FROM uni GROUP BY ALL), e AS (SELECT document_id, sentence_id, type, count(DISTINCT value) AS n FROM ent GROUP BY ALL) SELECT type, CAST(sum(g.n * e.n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS faults FROM g JOIN e USING (document_id, sentence_id) GROUP BY type")
# names of parts have two words, so three stand in the text corpus only, whose annotator knows dates and tags
_NOTE_TXT = {"date": "SELECT DISTINCT document_id, sentence_id, 'DATE' AS type, term || '-01-01' AS value FROM tok WHERE regexp_full_match(term, '19[2-9][0-9]|20[01][0-9]|202[0-5]')", "pos": "SELECT DISTINCT document_id, sentence_id, 'NN' AS type, term AS value FROM tok WHERE length(term) > 1"}
for _kind in ("date", "pos"):
    _add(f"stitch_{_kind}_trigram", stitched(_kind, 3, corpus.text_corpus, ("type", "value")), f"WITH {TXT} SELECT type, value, count(*) AS cells FROM (SELECT DISTINCT document_id, sentence_id, term || ' ' || t1 || ' ' || t2 AS ngram FROM seq WHERE t2 IS NOT NULL AND gap <= 2 AND gap1 <= 2) JOIN ({_NOTE_TXT[_kind]}) USING (document_id, sentence_id) GROUP BY ALL")


def posting_union(spark: SparkSession, path: str) -> DataFrame:
    c = corpus.relational_corpus(spark, path)
    one, two = (features.postings(c.grams(n), ["term"]) for n in (1, 2))
    return features.posting_union(one, one, two, keys=["term"]).select("term", "document_id", "sentence_id", F.array_join("begins", ",").alias("begins")).groupBy("term", "begins").agg(F.count("*").alias("cells"))


_add("posting_union", posting_union, f"""WITH {REL}, o AS (SELECT document_id, sentence_id, w1 AS term, 0 AS b FROM tok UNION SELECT document_id, sentence_id, w2, length(w1) + 1 FROM tok UNION SELECT document_id, sentence_id, name, 0 FROM tok),
p AS (SELECT term, document_id, sentence_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS begins FROM o GROUP BY ALL) SELECT term, begins, count(*) AS cells FROM p GROUP BY ALL""")
_add("occurrence_restriction", lambda spark, path: features.restrict(corpus.relational_corpus(spark, path).grams(1), rel(spark, path).sql("SELECT DOCUMENT_ID, SENTENCE_ID FROM rel WHERE NER(LOCATION, 'asia')").toDF(*CELLS)).groupBy("term").agg(F.count("*").alias("n")), f"WITH {REL} SELECT term, count(*) AS n FROM uni SEMI JOIN ({ASIA}) USING (document_id, sentence_id) GROUP BY term")
_add("cell_keys", lambda spark, path: corpus.relational_corpus(spark, path).cells.select(cells.pack(F.col("document_id"), F.col("sentence_id")).alias("k")).select("k", cells.document_of(F.col("k")).alias("d"), cells.sentence_of(F.col("k")).alias("s")), "SELECT DISTINCT (l_orderkey << 32) | CAST(l_linenumber AS BIGINT) AS k, l_orderkey AS d, CAST(l_linenumber AS INTEGER) AS s FROM lineitem")
_add("number_dates", lambda spark, path: spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", dates.day_of_number((F.date_format("o_orderdate", "yyyyMMdd").cast("int") + F.when(F.col("o_orderkey") % 5 == 0, 60).otherwise(0))).alias("d")).groupBy("d").agg(F.count("*").alias("n")), "SELECT d, count(*) AS n FROM (SELECT try_cast(substring(t, 1, 4) || '-' || substring(t, 5, 2) || '-' || substring(t, 7, 2) AS DATE) AS d FROM (SELECT CAST(CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) + CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 0 END AS VARCHAR) AS t FROM orders)) GROUP BY d")
_add("period_ends", lambda spark, path: spark.read.parquet(f"{path}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", dates.period_end(F.col("d"), "month").alias("m"), dates.period_end(F.col("d"), "year").alias("y")), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, last_day(CAST(o_orderdate AS DATE)) AS m, make_date(year(o_orderdate), 12, 31) AS y FROM orders")
_add("aggregates_library", lambda spark, path: aggregates.group(spark.read.parquet(f"{path}/events.parquet"), ["event_type"], {"n": aggregates.count_all(), "present": aggregates.count_present("props"), "users": aggregates.count_unique("user_id"), "first_user": aggregates.first_by("user_id", "event_id")}), "SELECT event_type, count(*) AS n, count(props) AS present, count(DISTINCT user_id) AS users, arg_min(user_id, event_id) AS first_user FROM events GROUP BY event_type")
_add("timestamp_filter", lambda spark, path: spark.read.parquet(f"{path}/orders.parquet").where(dates.matches("INTERSECT", *period("1996-02"), F.to_date("o_orderdate"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
# browsing
_add("top_terms", lambda spark, path: browse.top_terms(corpus.relational_corpus(spark, path).grams(2), 20), f"WITH {REL} SELECT name AS term, count(DISTINCT (document_id, sentence_id)) AS cells FROM tok GROUP BY name ORDER BY cells DESC, term LIMIT 20")
_add("top_terms_prefix", lambda spark, path: browse.top_terms(txt(spark, path).corpus("docs").grams(1), 15, "th"), f"WITH {TXT} SELECT term, count(DISTINCT (document_id, sentence_id)) AS cells FROM tok WHERE term LIKE 'th%' GROUP BY term ORDER BY cells DESC, term LIMIT 15")
_add("prefix_listing", lambda spark, path: browse.listing(corpus.relational_corpus(spark, path).grams(2), "red"), f"WITH {REL} SELECT name AS term, count(DISTINCT (document_id, sentence_id)) AS cells FROM tok WHERE name LIKE 'red%' GROUP BY name")
_add("index_stats", lambda spark, path: browse.statistics(corpus.relational_corpus(spark, path).grams(2)), f"WITH {REL}, p AS (SELECT name AS term, count(DISTINCT (document_id, sentence_id)) AS cells FROM tok GROUP BY name) SELECT count(*) AS entries, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(strlen(term)) AS BIGINT) AS key_bytes FROM p")
_add("index_summary", lambda spark, path: browse.summary({"unigram": corpus.relational_corpus(spark, path).grams(1), "ner": corpus.relational_corpus(spark, path).table("entities")}), f"WITH {REL} SELECT 'unigram' AS \"table\", count(*) AS cells FROM (SELECT DISTINCT term, document_id, sentence_id FROM uni) UNION ALL SELECT 'ner', count(*) FROM (SELECT DISTINCT * FROM ent)")
# sources
_add("stratified_limit", lambda spark, path: readers.per_year(spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("year")), 1003, "year", ["o_orderkey"]), "WITH r AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS k FROM orders), y AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM r)) SELECT o_orderkey, r.year AS year FROM r JOIN y ON r.year = y.year WHERE k <= 1003 // n + CASE WHEN p < 1003 % n THEN 1 ELSE 0 END")


def resume_scan(spark: SparkSession, path: str) -> DataFrame:
    orders = spark.read.parquet(f"{path}/orders.parquet").select(F.col("o_orderkey").alias("document_id"))
    done = spark.read.parquet(f"{path}/lineitem.parquet").select(F.col("l_orderkey").alias("document_id"))
    return readers.unannotated(orders, done)


_add("resume_scan", resume_scan, "SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")


def doc_renumber(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    return features.renumbered(docs, spark.read.parquet(f"{path}/labels.parquet").select(F.col("doc_id").alias("document_id")))


_add("doc_renumber", doc_renumber, "SELECT doc_id AS old_id, (SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY doc_id) AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def _scratch(spark: SparkSession) -> str:
    """A folder for files of this run: shared on a cluster, temporary in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="cellweave-")
    return f"{base}/{uuid.uuid4().hex}"


def jsonl_source(spark: SparkSession, path: str) -> DataFrame:
    target = _scratch(spark)
    orders = spark.read.parquet(f"{path}/orders.parquet")
    orders.select(F.when(F.col("o_orderkey") % 3 == 0, "_doc").alias("_type"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("text"), F.col("o_orderdate").cast("string").alias("timestamp")).write.json(target)
    return readers.json_lines(spark, target).groupBy("title", "text").agg(F.count("*").alias("n"))


_add("jsonl_source", jsonl_source, "SELECT o_orderstatus AS title, o_orderpriority AS text, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 GROUP BY ALL")


def csv_sink(spark: SparkSession, path: str) -> DataFrame:
    target = _scratch(spark)
    sinks.write(spark.read.parquet(f"{path}/part.parquet").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.concat(F.lit('a "b", '), "p_type")).alias("t")), target)
    return spark.read.schema("p_partkey long, p_name string, t string").option("header", True).option("escape", '"').csv(target)


_add("csv_sink", csv_sink, "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN 'a \"b\", ' || p_type END AS t FROM part")


def json_sink(spark: SparkSession, path: str) -> DataFrame:
    target = _scratch(spark)
    sinks.write(spark.read.parquet(f"{path}/nation.parquet").select("n_nationkey", "n_name"), target, "json")
    return spark.read.schema("n_nationkey long, n_name string").json(target)


_add("json_sink", json_sink, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def feature_sink(spark: SparkSession, path: str) -> DataFrame:
    target = _scratch(spark)
    sinks.features(corpus.relational_corpus(spark, path).grams(2), target)
    return spark.read.parquet(target).where("term = 'red widget'").select("document_id", "sentence_id")


_add("feature_sink", feature_sink, f"WITH {REL} SELECT document_id, sentence_id FROM tok WHERE name = 'red widget'")


def streaming_ingest(spark: SparkSession, path: str) -> DataFrame:
    from cellweave.streaming.ingest import ingest

    base = _scratch(spark)
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    docs.write.parquet(f"{base}/in")
    query = ingest(spark, f"{base}/in", "document_id long, text string", f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("document_id").agg(F.count("*").alias("tokens"))


_add("streaming_ingest", streaming_ingest, f"WITH {TXT} SELECT document_id, count(*) AS tokens FROM tok GROUP BY document_id")


# snippets of texts: the word may stand in any sentence, its place in the text is the sentence's place and its own
_SNIP = """pl AS (SELECT doc_id AS document_id, text AS t, string_split_regex(text, '[.!?\n]+') AS p, regexp_extract_all(text, '[.!?\n]+') AS q FROM documents),
st AS (SELECT document_id, t, unnest(p) AS s, unnest(range(len(p))) AS sentence_id, unnest(list_transform(range(len(p)), lambda k: coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(q[1:k], lambda x: length(x))), 0))) AS off FROM pl),
wd AS (SELECT document_id, CAST(sentence_id AS BIGINT) AS sentence_id, t, off, regexp_extract_all(s, '[\\p{L}\\p{N}]+') AS w, string_split_regex(s, '[\\p{L}\\p{N}]+') AS g FROM st),
hit AS (SELECT *, list_position(list_transform(w, lambda x: lower(x)), 'the') AS k FROM wd),
rng AS (SELECT document_id, sentence_id, t, CAST(greatest(off + list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) - 12, 0) AS BIGINT) AS a, CAST(least(off + list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) + 15, length(t)) AS BIGINT) AS z FROM hit WHERE k > 0)
SELECT document_id, sentence_id, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(replace(substring(t, a + 1, z - a), chr(10), ' ')) || CASE WHEN z < length(t) THEN '...' ELSE '' END AS snip FROM rng"""
_add("snippet_text", lambda spark, path: txt(spark, path).sql("SELECT DOCUMENT_ID, SENTENCE_ID, SNIPPET(w, 12) FROM docs WHERE CONTAINS('the') BIND w").toDF(*CELLS, "snip"), f"WITH {_SNIP}")
# scopes, all values of a cell, the order of cells
_language("document_scope", "SELECT DOCUMENT_ID FROM rel WHERE CONTAINS('red widget') AND NER(LOCATION, 'asia') GRANULARITY DOCUMENT", ["document_id"], "SELECT DISTINCT document_id FROM tok WHERE name = 'red widget' INTERSECT SELECT document_id FROM ent WHERE type = 'LOCATION' AND value = 'asia'", document_scope=True)
_language("sentence_window", "SELECT DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('red widget') AND NER(LOCATION, 'asia') GRANULARITY SENTENCE 1", CELLS, "SELECT DISTINCT a.document_id, a.sentence_id FROM tok a JOIN ent b ON a.document_id = b.document_id AND abs(a.sentence_id - b.sentence_id) <= 1 WHERE a.name = 'red widget' AND type = 'LOCATION' AND value = 'asia'", sentence_window=True)
_language("multi_bindings", "SELECT p, l, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE NER(ORGANIZATION) BIND p AND NER(LOCATION) BIND l AND CONTAINS('red')", ["p", "l", *CELLS], f"SELECT DISTINCT a.value AS p, b.value AS l, document_id, sentence_id FROM ent a JOIN ent b USING (document_id, sentence_id) SEMI JOIN ({RED}) USING (document_id, sentence_id) WHERE a.type = 'ORGANIZATION' AND b.type = 'LOCATION'", multi=True)
_language("implicit_order", "SELECT p, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('red') AND NER(ORGANIZATION) BIND p LIMIT 30", ["p", *CELLS], f"SELECT p, document_id, sentence_id FROM {ORG} SEMI JOIN ({RED}) USING (document_id, sentence_id) ORDER BY document_id, sentence_id LIMIT 30")


# stored feature tables: written once, then every condition is a filter of files
def stored(spark: SparkSession, path: str, text: str, columns: list[str], stitch: bool = False, **kw) -> DataFrame:
    target = _scratch(spark)
    corpus.store(corpus.relational_corpus(spark, path), target, **kw)
    return Engine(spark, {"rel": corpus.stored_corpus(spark, target)}, stitch=stitch, ordered=False).sql(text).toDF(*columns)


def _stored(name: str, like: str, text: str, columns: list[str], **kw) -> None:
    """The query `like`, over stored tables; the same SQL holds."""
    _add(name, lambda spark, path: stored(spark, path, text, columns, **kw), ORACLES[like])


_CELLS_OF = "SELECT DOCUMENT_ID, SENTENCE_ID FROM rel WHERE "
_stored("stored_unigram", "contains_unigram", _CELLS_OF + "CONTAINS('red')", CELLS, grams=(1,), tables=())
_stored("stored_prefix", "contains_prefix_bigram", _CELLS_OF + "CONTAINS('red g*')", CELLS, grams=(2,), tables=())
_stored("stored_and", "and_cells", _CELLS_OF + "NER(LOCATION, 'asia') AND CONTAINS('red') AND DATE(= 1997)", CELLS, grams=(1,), tables=("entities", "dates"))
_stored("stored_not", "not_cells", _CELLS_OF + "NOT CONTAINS('red')", CELLS, grams=(1,), tables=())
_stored("stitched_lookup", "and_cells", _CELLS_OF + "NER(LOCATION, 'asia') AND CONTAINS('red') AND DATE(= 1997)", CELLS, stitch=True, grams=(), tables=("dates",), stitched=(("ner", 1),))
_language("stitched_base", "SELECT t, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('red widget') AND DATE(= 1996) BIND t", ["d", *CELLS], "SELECT CAST(min(d) AS VARCHAR) AS d, document_id, sentence_id FROM line SEMI JOIN (SELECT * FROM tok WHERE name = 'red widget') USING (document_id, sentence_id) WHERE year(d) = 1996 GROUP BY document_id, sentence_id")
_stored("stitched_date_lookup", "stitched_base", "SELECT t, DOCUMENT_ID, SENTENCE_ID FROM rel WHERE CONTAINS('red widget') AND DATE(= 1996) BIND t", ["d", *CELLS], stitch=True, grams=(), tables=(), stitched=(("date", 2),))


def allowed_cells(spark: SparkSession, path: str) -> DataFrame:
    """A condition within given cells only."""
    from cellweave.operators.predicates import Evaluator
    from cellweave.plans.parser import parse

    c = corpus.relational_corpus(spark, path)
    allowed = c.table("dates").where("year(date) = 1997").select(*CELLS).distinct()
    return Evaluator(c, allowed=allowed).evaluate(parse("SELECT DOCUMENT_ID FROM rel WHERE NOT CONTAINS('red') OR NER(LOCATION, 'asia')").where)


_add("allowed_cells", allowed_cells, f"WITH {REL} SELECT * FROM (SELECT document_id, sentence_id FROM uni EXCEPT {RED} UNION {ASIA}) INTERSECT {Y97}")


def consistency(spark: SparkSession, path: str) -> DataFrame:
    """All checks of stored tables, by check: how many rows break it."""
    target, c = _scratch(spark), corpus.relational_corpus(spark, path)
    corpus.store(c, target, grams=(1, 2), stitched=(("ner", 1), ("pos", 2)))
    return features.index_faults(corpus.stored_corpus(spark, target), (1, 2), (("ner", 1), ("pos", 2)))


_add("index_consistency", consistency, "SELECT 'gram ' || n || ': ' || c AS \"check\", CAST(0 AS BIGINT) AS faults FROM (SELECT unnest(['1', '2']) AS n), (SELECT unnest(['blank term', 'too many words', 'offsets out of order', 'cell without word', 'unknown document']) AS c) UNION ALL SELECT unnest(['entities: unknown document', 'dates: unknown document', 'tags: unknown document', 'dependencies: unknown document', 'stitched ner 1: not the product', 'stitched pos 2: not the product']), 0")


def relative_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Words of texts with offsets from the sentence's first kept word, cut where a sentence grows too long."""
    notes = _notes(spark, path)
    kept = notes.where(features.keep_token(F.col("token"), F.col("pos"))).withColumns({"begin_char": F.col("begin_char") + 1000, "end_char": F.col("end_char") + 1000})
    return features.relative_offsets(kept).groupBy("begin_char", "end_char").agg(F.count("*").alias("n"))


_add("relative_offsets", relative_offsets, f"WITH {TXT}, o AS (SELECT document_id, sentence_id, k, length(term) AS n, CAST(sum(length(term) + gap) OVER (PARTITION BY document_id, sentence_id ORDER BY k) AS BIGINT) - gap AS e FROM (SELECT document_id, sentence_id, unnest(w) AS term, unnest(range(len(w))) AS k, length(unnest(g[2:])) AS gap FROM words WHERE len(w) > 0)) SELECT CAST(e - n AS INTEGER) AS begin_char, CAST(e AS INTEGER) AS end_char, count(*) AS n FROM o WHERE e <= 150 GROUP BY ALL")


def shared_periods(spark: SparkSession, path: str) -> DataFrame:
    """The days that an order's period (its date and the 40 days after) shares with its month, as text of the whole month's kind."""
    day = F.to_date("o_orderdate")
    rows = spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", day.alias("a"), F.date_add(day, 40).alias("z"), F.trunc(day, "month").alias("m"))
    start, end = dates.shared_period((F.col("a"), F.col("z")), (F.col("m"), dates.period_end(F.col("m"), "month")))
    return rows.select("o_orderkey", start.alias("first_day"), end.alias("last_day"))


_add("shared_periods", shared_periods, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, least(CAST(o_orderdate AS DATE) + 40, last_day(CAST(o_orderdate AS DATE))) AS last_day FROM orders")
_add("custom_aggregate", lambda spark, path: aggregates.group(spark.read.parquet(f"{path}/events.parquet"), ["user_id"], {"reach": aggregates.custom(lambda v: int(v.max() - v.min()), "long")("event_id")}), "SELECT user_id, max(event_id) - min(event_id) AS reach FROM events GROUP BY user_id")


def html_sink(spark: SparkSession, path: str) -> DataFrame:
    nation = spark.read.parquet(f"{path}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame([(line.strip(),) for line in sinks.html_lines(nation)], "line string")


_add("html_sink", html_sink, "SELECT unnest(['<table>' || chr(10) || '<tr><th>n_nationkey</th><th>n_name</th></tr>', '</table>']) AS line UNION ALL SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' FROM nation")


def console_sink(spark: SparkSession, path: str) -> DataFrame:
    said = sinks.console(spark.read.parquet(f"{path}/supplier.parquet").select("s_suppkey", "s_name").orderBy("s_suppkey"), 3)
    return spark.createDataFrame([(line,) for line in said.split("\n")], "line string")


_add("console_sink", console_sink, "SELECT 's_suppkey | s_name' AS line UNION ALL SELECT * FROM (SELECT s_suppkey || ' | ' || s_name FROM supplier ORDER BY s_suppkey LIMIT 3) UNION ALL SELECT '(' || count(*) || ' rows)' FROM supplier")


def archive_source(spark: SparkSession, path: str) -> DataFrame:
    """Nations as news documents in two archives, written through the file system of the shared folder."""
    import io
    import tarfile

    base = _scratch(spark)
    rows = spark.read.parquet(f"{path}/nation.parquet").orderBy("n_nationkey").collect()
    for part in range(2):
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz") as tar:
            for r in rows[part::2]:
                title = r["n_name"] if r["n_nationkey"] % 5 else ""
                body = f'<nitf><head><meta name="dsk" content="Desk {r["n_regionkey"]}"/><pubdata date.publication="19870{1 + r["n_nationkey"] % 9}01T000000"/></head><body><body.head><hedline><hl1>{title}</hl1></hedline></body.head><body.content><block class="full_text"><p>Of {r["n_name"]}.</p><p>End.</p></block></body.content></body></nitf>'.encode()
                info = tarfile.TarInfo(f"{r['n_nationkey']}.xml")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/news{part}.tar.gz")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(raw.getvalue()))
        out.close()
    return readers.news_archives(spark, base, extras=True).select("title", "text", "timestamp", F.col("fields")["dsk"][0].alias("desk"))


_add("archive_source", archive_source, "SELECT n_name AS title, 'Of ' || n_name || '.' || chr(10) || 'End.' AS text, '1987-0' || (1 + n_nationkey % 9) || '-01T00:00:00Z' AS timestamp, 'Desk ' || n_regionkey AS desk FROM nation WHERE n_nationkey % 5 <> 0")


def ranged_resume(spark: SparkSession, path: str) -> DataFrame:
    orders = spark.read.parquet(f"{path}/orders.parquet").select(F.col("o_orderkey").alias("document_id"))
    return readers.unannotated(orders, orders.where("document_id % 2 = 0"), start=100, limit=50)


_add("resume_range", ranged_resume, "SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey >= 100 ORDER BY 1 LIMIT 50")
FLAGSHIP = "group_count"
