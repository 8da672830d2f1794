"""Queries end to end on a small corpus, and laws that hold for any."""

from datetime import date

import pytest

from cellweave.functions import dates
from cellweave.plans.engine import Engine, count_pairs
from cellweave.plans.model import ExecutionError
from cellweave.shell import Session
from cellweave.sources import readers, sinks
from cellweave.sources.corpus import Corpus, annotate

OCC = "document_id long, sentence_id long, {} begin int, end int"


@pytest.fixture(scope="module")
def engine(spark):
    def table(kind, rows):
        return spark.createDataFrame([(*r, 0, 5) for r in rows], OCC.format(kind))

    words = {1: [(1, 1, "apple"), (2, 1, "apple"), (2, 2, "banana"), (0, 0, "test"), (1, 1, "test"), (0, 1, "window"), (0, 3, "window"), (3, 1, "grape")], 2: [(3, 1, "read monkey"), (4, 1, "big cat")], 3: [(5, 1, "the quick fox")]}
    entities = [(6, 1, "PERSON", "albert einstein"), (6, 2, "PERSON", "marie curie"), (7, 1, "PERSON", "isaac newton"), (12, 1, "PERSON", "albrecht kossel"), (7, 2, "ORGANIZATION", "google"), (1, 1, "CITY", "apple"), (2, 1, "CITY", "rome")]
    days = [(1, 1, date(2023, 3, 20)), (2, 1, date(2023, 1, 15)), (3, 1, date(2024, 1, 1)), (30, 1, date(2024, 1, 15)), (31, 1, date(1925, 1, 1)), (32, 1, date(2025, 12, 31))]
    docs = spark.createDataFrame([(1, "One", "apple pie is\ngood for all of us here", "2023-01-01T00:00:00Z"), (2, None, "x", "nonsense")], "document_id long, title string, text string, timestamp string")
    deps = [(1, 1, "fox", "amod", "quick"), (1, 1, "fox", "nsubj", "apple")]
    c = Corpus(docs, lambda n: table("term string,", words[n]), lambda: table("type string, value string,", entities), lambda: table("date date,", days), lambda: table("tag string, term string,", [(1, 1, "NN", "apple"), (2, 1, "NN", "apple")]), lambda: table("head string, relation string, dependent string,", deps))
    bare = Corpus(docs, lambda n: table("term string,", words[n]))
    return Engine(spark, {"c": c, "bare": bare})


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def cells(engine, where, tail=""):
    return rows(engine, f"SELECT DOCUMENT_ID, SENTENCE_ID FROM c WHERE {where} {tail}")


@pytest.mark.parametrize(("where", "wanted"), [
    ("CONTAINS('apple')", [(1, 1), (2, 1)]),
    ("CONTAINS('nonexistent')", []),
    ("CONTAINS('Big Cat')", [(4, 1)]),
    ("CONTAINS('the', 'quick', 'fox')", [(5, 1)]),
    ("CONTAINS('ban*')", [(2, 2)]),
    ("NER(PERSON)", [(6, 1), (6, 2), (7, 1), (12, 1)]),
    ("NER(PERSON, 'Isaac Newton', 'nobody')", [(7, 1)]),
    ("NER(MONEY)", []),
    ("NER(DATE) AND CONTAINS('apple')", [(1, 1), (2, 1)]),
    ("DATE(= 2023)", [(1, 1), (2, 1)]),
    ("DATE(< 2023-03)", [(2, 1), (31, 1)]),
    ("DATE(<= 2023-03)", [(1, 1), (2, 1), (31, 1)]),
    ("DATE(> 2024)", [(30, 1), (32, 1)]),
    ("DATE(>= 2024)", [(3, 1), (30, 1), (32, 1)]),
    ("DATE(CONTAINED_BY 2023-01-15)", [(2, 1)]),
    ("DATE(INTERSECT [2023-01, 2024-01-01])", [(1, 1), (2, 1), (3, 1)]),
    ("CONTAINS('apple') AND NOT CONTAINS('test')", [(2, 1)]),
    ("NOT CONTAINS('apple')", [(0, 0), (0, 1), (0, 3), (2, 2), (3, 1)]),
    ("NOT CONTAINS('apple') AND NER(PERSON)", []),
    ("CONTAINS('apple') OR CONTAINS('banana') AND CONTAINS('test')", [(1, 1)]),
    ("DEPENDS('fox', 'amod', 'quick')", [(1, 1)]),
    ("POS(NN) BIND w AND NER(CITY, w)", [(1, 1)]),
    ("POS(NN) BIND w AND DEPENDS('fox', 'nsubj', w)", [(1, 1)]),
])
def test_cells(engine, where, wanted):
    assert cells(engine, where) == wanted


def test_granularity_leaves_cells(engine):
    for tail in ("", "GRANULARITY DOCUMENT", "GRANULARITY SENTENCE 1", "GRANULARITY SENTENCE 2"):
        assert cells(engine, "CONTAINS('window')", tail) == [(0, 1), (0, 3)]


def test_scopes_on_request(engine, spark):
    wide = Engine(spark, engine.corpora, document_scope=True)
    assert wide.sql("SELECT DOCUMENT_ID FROM c WHERE CONTAINS('apple') AND CONTAINS('banana')").collect()[0][0] == 2
    near = Engine(spark, engine.corpora, sentence_window=True)
    text = "SELECT DOCUMENT_ID, SENTENCE_ID FROM c WHERE CONTAINS('apple') AND CONTAINS('banana') GRANULARITY SENTENCE {}"
    assert [tuple(r) for r in near.sql(text.format(1)).collect()] == [(2, 1)] and near.sql(text.format(0)).count() == 0


def test_no_where_is_empty(engine):
    assert rows(engine, "SELECT DOCUMENT_ID FROM c") == []


def test_group_order_limit(engine):
    got = rows(engine, "SELECT DOCUMENT_ID, COUNT(*) FROM c WHERE NER(PERSON) BIND p GROUP BY DOCUMENT_ID ORDER BY COUNT(*), DOCUMENT_ID ASC LIMIT 2")
    assert got == [(6, 2), (7, 1)]
    assert rows(engine, "SELECT COUNT(*), COUNT(DOCUMENTS) FROM c WHERE NER(PERSON)") == [(4, 3)]


def test_nulls_in_order(engine):
    text = "SELECT v, DOCUMENT_ID FROM c WHERE CONTAINS('banana') OR NER(ORGANIZATION) BIND v ORDER BY v {}"
    assert [r[0] for r in rows(engine, text.format("DESC"))] == [None, "google"]
    assert [r[0] for r in rows(engine, text.format("ASC"))] == ["google", None]


def test_projection(engine):
    got = rows(engine, "SELECT w, TITLE, TIMESTAMP, SNIPPET(w, 8) FROM c WHERE CONTAINS('apple') BIND w")
    assert got == [("apple", "One", date(2023, 1, 1), "apple pie is..."), ("apple", "", None, "x")]


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT"])
@pytest.mark.parametrize("op", ["=", "BEFORE", "AFTER", "INTERSECT"])
def test_joins_are_the_same_with_pushdown(engine, spark, kind, op):
    text = f"SELECT a.t, b.u, COUNT(*) FROM c ALIAS a {kind} JOIN (SELECT u FROM c WHERE DATE(>= 2023) BIND u) ALIAS b ON a.t {op} b.u WHERE DATE(< 2024) BIND t GROUP BY a.t, b.u"
    plain = Engine(spark, engine.corpora, pushdown=False)
    a, b = (sorted(map(str, e.sql(text).collect())) for e in (engine, plain))
    assert a == b and a


def test_date_join_pairs(engine):
    text = "SELECT a.t, b.u FROM c ALIAS a JOIN (SELECT u FROM c WHERE DATE(= 2024) BIND u) ALIAS b ON a.t BEFORE b.u WHERE DATE(= 2023) BIND t"
    assert len(rows(engine, text)) == 4


def test_subquery_limit(engine):
    text = "SELECT a.p, b.q FROM c ALIAS a JOIN (SELECT q FROM c WHERE NER(PERSON) BIND q ORDER BY q ASC LIMIT 1) ALIAS b ON a.p = b.q WHERE NER(PERSON) BIND p"
    assert rows(engine, text) == [("albert einstein", "albert einstein")]


def test_errors(engine):
    with pytest.raises(ExecutionError) as e:
        engine.sql("SELECT DOCUMENT_ID FROM nowhere WHERE CONTAINS('a')")
    assert e.value.kind == "MISSING_INDEX"
    with pytest.raises(ExecutionError):
        engine.sql("SELECT DOCUMENT_ID FROM bare WHERE NER(PERSON)")


def test_laws(engine):
    a, b = "CONTAINS('apple')", "CONTAINS('test')"
    assert set(cells(engine, f"{a} AND {b}")) == set(cells(engine, a)) & set(cells(engine, b))
    assert set(cells(engine, f"{a} OR {b}")) == set(cells(engine, a)) | set(cells(engine, b))
    assert set(cells(engine, f"NOT ({a} OR {b})")) == set(cells(engine, f"NOT {a}")) & set(cells(engine, f"NOT {b}"))


def test_count_pairs(spark):
    a = spark.createDataFrame([(date(2023, 1, 10),), (date(2023, 1, 15),)], "date date")
    b = spark.createDataFrame([(date(2023, 1, 12),), (date(2023, 1, 20),)], "date date")
    assert count_pairs(a, b).first().n == 3 and count_pairs(a, b, before=False).first().n == 1


def test_periods():
    assert dates.common((date(2000, 1, 1), date(2000, 6, 1)), (date(2000, 3, 1), date(2001, 1, 1))) == (date(2000, 3, 1), date(2000, 6, 1))
    assert dates.common((date(2000, 1, 1), date(2000, 1, 2)), (date(2001, 1, 1), date(2001, 1, 2))) is None
    assert dates.period_text(date(2000, 1, 1), date(2000, 12, 31)) == "2000" and dates.period_text(date(2000, 1, 1), date(2001, 12, 31)) == "[2000, 2001]"


def test_annotator(spark):
    docs = spark.createDataFrame([(1, " Hello, world! It is 1999.\nÉté"), (2, None), (3, "")], "document_id long, text string")
    got = [(r.sentence_id, r.begin_char, r.end_char, r.token, r.ner) for r in annotate(docs).orderBy("sentence_id", "begin_char").collect()]
    assert got == [(0, 0, 5, "Hello", "O"), (0, 7, 12, "world", "O"), (1, 0, 2, "It", "O"), (1, 3, 5, "is", "O"), (1, 6, 10, "1999", "DATE"), (2, 0, 3, "Été", "O")]


def test_sources_and_sinks(spark, tmp_path, engine):
    (tmp_path / "in.jsonl").write_text('{"title": "a", "text": "b"}\n{"_type": "_doc", "text": "c"}\nbroken\n{"title": "x"}\n')
    assert [(r.title, r.text) for r in readers.json_lines(spark, str(tmp_path / "in.jsonl")).collect()] == [("a", "b")]
    (tmp_path / "stop.txt").write_text("# comment\nThe\n\nand\n")
    assert readers.stopwords(str(tmp_path / "stop.txt")) == {"the", "and"} and readers.stopwords("/nowhere") == frozenset()
    df = spark.createDataFrame([(1, 'say "a", b'), (2, None)], "k long, t string")
    for kind in ("csv", "json"):
        sinks.write(df, str(tmp_path / kind), kind)
    assert sorted(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()) == [("1", 'say "a", b'), ("2", None)]
    assert "NULL" in sinks.console(df) and "(2 rows)" in sinks.console(df)
    said = list(Session(engine).run(["SELECT DOCUMENT_ID FROM c WHERE CONTAINS('apple')", "SELECT", f"SET OUTPUT json {tmp_path}/out", "SELECT DOCUMENT_ID FROM c WHERE CONTAINS('apple')", "SET STRATEGY pushdown=base", "QUIT", "never"]))
    assert "(2 rows)" in said[0] and said[1].startswith("error") and len(said) == 5 and not engine.pushdown
    engine.pushdown = True


def test_archives(spark, tmp_path):
    import io
    import tarfile

    xml = '<nitf><head><pubdata date.publication="19870101T000000"/></head><body><body.head><hedline><hl1>Title</hl1></hedline></body.head><body.content><block class="full_text"><p>One.</p><p>Two.</p></block></body.content></body></nitf>'
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, text in (("a.xml", xml), ("b.xml", "<broken"), ("c.txt", xml), ("d.xml", xml.replace("Title", ""))):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    got = readers.news_archives(spark, str(tmp_path / "a.tar.gz")).collect()
    assert [(r.title, r.text, r.timestamp) for r in got] == [("Title", "One.\nTwo.", "1987-01-01T00:00:00Z")]


def test_years(spark):
    df = spark.createDataFrame([(y, k) for y in (2000, 2001, 2002) for k in range(5)], "year int, k int")
    got = readers.per_year(df, 7).groupBy("year").count().collect()
    assert {r.year: r["count"] for r in got} == {2000: 3, 2001: 2, 2002: 2}


def test_streaming_takes_only_new_files(spark, tmp_path):
    from cellweave.streaming.ingest import ingest

    schema = "document_id long, text string"
    for k in range(2):
        spark.createDataFrame([(k, "a b")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * (k + 1)


def test_counts_through_joins_are_those_of_pairs(engine, spark):
    """Counts by distinct values of each side equal counts over the joined rows."""
    joins = "{kind} JOIN (SELECT u FROM c WHERE NER(CITY) BIND u OR DATE(>= 2023) BIND g) ALIAS b ON a.t {op} b.g {kind} JOIN (SELECT p FROM c WHERE NER(PERSON) BIND p AND NER(PERSON) BIND e) ALIAS x ON b.u = x.p"
    for kind in ("INNER", "LEFT"):
        for op in ("BEFORE", "="):
            tail = f"FROM c ALIAS a {joins.format(kind=kind, op=op)} WHERE DATE(< 2025) BIND t"
            every = rows(engine, f"SELECT a.t, b.u, x.p, a.DOCUMENT_ID {tail}")
            got = rows(engine, f"SELECT a.t, b.u, COUNT(*), COUNT(x.p), COUNT(UNIQUE x.p), COUNT(DOCUMENTS) {tail} GROUP BY a.t, b.u")
            want = {}
            for t, u, p, d in every:
                n = want.setdefault((t, u), [0, 0, set(), set()])
                n[0], n[1] = n[0] + 1, n[1] + (p is not None)
                n[2] |= {p} - {None}
                n[3].add(d)
            assert {g[:2]: list(g[2:]) for g in got} == {k: [n[0], n[1], len(n[2]), len(n[3])] for k, n in want.items()}, (kind, op)
            assert rows(engine, f"SELECT COUNT(*) {tail}") == [(len(every),)]


def test_joins_make_no_pairs_to_count(engine):
    from cellweave.plans.engine import explain

    plan = explain(engine.sql("SELECT a.p, COUNT(*) FROM c ALIAS a JOIN (SELECT q FROM c WHERE NER(PERSON) BIND q) ALIAS b ON a.p = b.q WHERE NER(PERSON) BIND p GROUP BY a.p"))
    tree = plan.split("\n\n")[0]
    assert tree.count("Aggregate") >= 6, tree


def test_not_needs_cells(spark, engine):
    docs = engine.corpora["c"].documents
    empty = Corpus(docs, lambda n: spark.createDataFrame([], OCC.format("term string,")))
    with pytest.raises(ExecutionError):
        Engine(spark, {"none": empty}).sql("SELECT DOCUMENT_ID FROM none WHERE NOT CONTAINS('a')")


def test_snippets_of_later_sentences(spark):
    from cellweave.sources.corpus import from_annotations, sentence_offsets

    docs = spark.createDataFrame([(1, "  The first sentence here. A zebra ran away."), (2, "zebra"), (3, "Oh!?\n\n (zebra) é"), (4, None), (5, "")], "document_id long, text string").selectExpr("document_id", "'t' AS title", "text", "CAST(NULL AS STRING) AS timestamp")
    e = Engine(spark, {"docs": from_annotations(docs, annotate(docs), None, frozenset(), sentence_offsets(docs))})
    assert rows(e, "SELECT DOCUMENT_ID, SNIPPET(w, 3) FROM docs WHERE CONTAINS('zebra') BIND w") == [(1, "...A zebra ra..."), (2, "zebra"), (3, "...(zebra) é")]


def test_all_values_of_a_cell(spark):
    words = spark.createDataFrame([(1, 1, "ab", 0, 2), (1, 1, "ac", 3, 5), (1, 2, "ad", 0, 2)], OCC.format("term string,"))
    ents = spark.createDataFrame([(1, 1, "CITY", "rome", 0, 2), (1, 1, "CITY", "oslo", 3, 5)], OCC.format("type string, value string,"))
    c = Corpus(spark.createDataFrame([(1, None, "", None)], "document_id long, title string, text string, timestamp string"), lambda n: words, lambda: ents)
    one, many = Engine(spark, {"c": c}), Engine(spark, {"c": c}, multi=True)
    text = "SELECT w, v, DOCUMENT_ID, SENTENCE_ID FROM c WHERE CONTAINS('a*') BIND w AND NER(CITY) BIND v"
    assert rows(one, text) == [("ab", "oslo", 1, 1)]
    assert sorted(rows(many, text)) == [(w, v, 1, 1) for w in ("ab", "ac") for v in ("oslo", "rome")]
    either = "SELECT w, v, SENTENCE_ID FROM c WHERE CONTAINS('ad') BIND w OR NER(CITY) BIND v"
    assert sorted(rows(many, either), key=str) == sorted([("ad", None, 2), (None, "oslo", 1), (None, "rome", 1)], key=str)


def test_stored_tables_answer_alike(spark, engine, tmp_path):
    from cellweave.operators.features import index_faults
    from cellweave.plans.engine import explain
    from cellweave.sources.corpus import store, stored_corpus

    c = engine.corpora["c"]
    store(c, str(tmp_path), tables=("documents", "entities", "dates", "tags", "dependencies"), stitched=(("ner", 1), ("date", 1), ("pos", 1)))
    back = stored_corpus(spark, str(tmp_path))
    plain, stitch = Engine(spark, {"c": back}), Engine(spark, {"c": back}, stitch=True)
    for where in ("CONTAINS('apple')", "CONTAINS('ban*')", "NOT CONTAINS('apple')", "CONTAINS('apple') AND NER(CITY)", "CONTAINS('apple') AND NER(CITY, 'Rome')", "CONTAINS('apple') AND DATE(= 2023-01)", "CONTAINS('apple') AND POS(NN, 'Apple') AND NOT CONTAINS('test')", "CONTAINS('apple') AND NER(CITY) AND DATE(= 2023)", "CONTAINS('big cat') AND NER(PERSON)"):
        assert cells(engine, where) == cells(plain, where) == cells(stitch, where), where
    text = "SELECT t, w, DOCUMENT_ID FROM c WHERE CONTAINS('apple') BIND w AND DATE(= 2023) BIND t"
    assert rows(plain, text) == rows(stitch, text) == rows(engine, text)
    assert "EqualTo(term,apple)" in explain(plain.sql("SELECT DOCUMENT_ID FROM c WHERE CONTAINS('apple')"))
    assert "EqualTo(ngram,apple)" in explain(stitch.sql("SELECT DOCUMENT_ID FROM c WHERE CONTAINS('apple') AND NER(CITY)"))
    faults = {r.check: r.faults for r in index_faults(back, (1,), (("ner", 1),)).collect()}
    assert faults["gram 1: blank term"] == 0 and faults["stitched ner 1: not the product"] == 0 and faults["gram 1: unknown document"] == 4


def test_strategies_are_checked(engine):
    s = Session(engine)
    assert s.execute("SET STRATEGY stitch=optimized") == "strategy: stitch=optimized" and engine.stitch
    assert s.execute("SET STRATEGY nash=on").startswith("error") and s.execute("SET STRATEGY pushdown=maybe").startswith("error")
    s.execute("SET STRATEGY stitch=base")
    assert not engine.stitch


def test_news_fields(spark, tmp_path):
    import io
    import tarfile

    xml = '<nitf><head><meta name="dsk" content="Sports"/><docdata><identified-content><classifier type="descriptor">A</classifier><classifier type="descriptor">B</classifier><person>P</person></identified-content></docdata></head><body><body.head><hedline><hl1>T</hl1></hedline></body.head><body.content><block class="full_text"><p>x</p></block></body.content></body></nitf>'
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for k in range(1200):
            info = tarfile.TarInfo(f"{k}.xml")
            info.size = len(xml)
            tar.addfile(info, io.BytesIO(xml.encode()))
    got = readers.news_archives(spark, str(tmp_path / "a.tar.gz"), extras=True).collect()
    assert len(got) == 1200 and got[0].fields == {"descriptors": ["A", "B"], "people": ["P"], "dsk": ["Sports"]} and got[0].timestamp is None


def test_text_offsets_without_exchange(spark):
    """Offsets of words and sentences are made within a row, whatever its length, and are those of a plain count; texts meet a query's cells last."""
    import re

    from pyspark.sql import functions as F

    from cellweave.plans.engine import explain
    from cellweave.sources import corpus

    rows = [(1, "The first one. A the-cat!? \n\n the end"), (2, ""), (3, None), (4, "..!"), (5, "  The " * 9000 + "."), (6, ". the" * 5000), (7, "1999 Ünder the ice\nx")]
    docs = spark.createDataFrame(rows, "document_id long, text string")
    want, starts = set(), set()
    for doc, text in rows:
        ends = [0, *(m.end() for m in re.finditer(r"[.!?\n]+", text or ""))]
        for k, piece in enumerate(re.split(r"[.!?\n]+", text or "")):
            found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+", piece)]
            want |= {(doc, k, a - found[0][0], z - found[0][0], w) for a, z, w in found}
            starts |= {(doc, k, ends[k] + found[0][0])} if found else set()
    made, at = corpus.annotate(docs), corpus.sentence_offsets(docs)
    assert {tuple(r) for r in made.select("document_id", "sentence_id", "begin_char", "end_char", "token").collect()} == want
    assert {tuple(r) for r in at.collect()} == starts
    assert "Exchange" not in explain(made) and "Exchange" not in explain(at)
    some = {tuple(r) for r in corpus.annotate(docs, ("the",)).select("document_id", "sentence_id", "begin_char", "end_char", "token").collect()}
    assert some < want and {r for r in some if r[4].lower() == "the"} == {r for r in want if r[4].lower() == "the"}
    texts = corpus.from_annotations(docs.select("document_id", F.lit("").alias("title"), "text", F.lit(None).cast("string").alias("timestamp")), made, None, frozenset(), at)
    plan = Engine(spark, {"docs": texts}).sql("SELECT DOCUMENT_ID, SNIPPET(w, 3) FROM docs WHERE CONTAINS('the') BIND w")._jdf.queryExecution().optimizedPlan()
    joins = [n for n in plan.toString().splitlines() if "Join " in n]
    assert len(joins) == 2 and "cw_sentence" not in joins[0]
