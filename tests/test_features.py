"""Feature tables on the small fixtures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cellweave.functions import cells
from cellweave.operators import features

SCHEMA = "document_id long, sentence_id long, begin_char int, end_char int, token string, pos string, ner string, normalized_ner string"


def notes(spark, rows):
    return spark.createDataFrame([(d, s, b, e, t, p, n, v) for d, s, b, e, t, p, n, v in rows], SCHEMA)


def words(spark, doc, sent, pairs, pos="NN"):
    return [(doc, sent, b, e, t, pos, "O", None) for t, b, e in pairs]


@pytest.fixture(scope="module")
def cats(spark):
    rows = words(spark, 1, 0, [("The", 0, 3), ("black", 4, 9), ("cat", 10, 13), ("sits", 14, 18), ("quietly", 19, 26)])
    rows += words(spark, 1, 1, [("It", 27, 29), ("purrs", 30, 35), ("softly", 36, 42)])
    rows += words(spark, 2, 0, [("The", 0, 3), ("black", 4, 9), ("dog", 10, 13), ("barks", 14, 19), ("loudly", 20, 26)])
    return notes(spark, rows)


def test_bigrams(cats):
    got = {(r.document_id, r.sentence_id, r.term, r.begin, r.end) for r in features.ngrams(cats, 2, frozenset(("the", "a", "is"))).collect()}
    assert {(1, 0, "black cat", 4, 13), (1, 0, "cat sits", 10, 18), (1, 1, "it purrs", 27, 35), (1, 1, "purrs softly", 30, 42), (2, 0, "barks loudly", 14, 26)} <= got
    assert len(got) == 8 and not any("the" in g[2].split() or g[2] in ("quietly it",) for g in got)


def test_trigrams_and_gaps(spark, cats):
    assert {r.term for r in features.ngrams(cats, 3, frozenset(("the",))).where("document_id = 1").collect()} == {"black cat sits", "cat sits quietly", "it purrs softly"}
    far = notes(spark, words(spark, 1, 0, [("a", 0, 1), ("b", 4, 5), ("c", 6, 7)]))
    assert [r.term for r in features.ngrams(far, 2).collect()] == ["b c"]


def test_missing_tags(spark):
    rows = notes(spark, [(1, 0, 0, 1, "a", None, "O", None), (1, 0, 2, 3, "b", "NN", "O", None), (1, 0, 4, 5, "f", "FW", "O", None)])
    assert {r.term for r in features.unigrams(rows).collect()} == {"a", "b"}
    assert features.ngrams(rows, 2).count() == 0


def test_dates(spark):
    rows = notes(spark, [(1, 0, 18, 33, "January 15, 2024", "NN", "DATE", "2024-01-15"), (1, 1, 50, 67, "x", "NN", "DATE", "2024-02-01"), *[(2, 0, b, e, "x", "NN", "DATE", "2024-01-15") for b, e in ((0, 15), (16, 31), (32, 42))]])
    got = [(r.document_id, r.sentence_id, r.date, r.begin, r.end) for r in features.dates(rows).orderBy("document_id", "sentence_id").collect()]
    assert got == [(1, 0, date(2024, 1, 15), 18, 33), (1, 1, date(2024, 2, 1), 50, 67), (2, 0, date(2024, 1, 15), 0, 42)]


def test_normal_dates(spark):
    values = ["2023-05-06", "2023-05", "2023", "0000-01-01", "", None, "XXXX-05", "2023-02-30", " 2023 "]
    got = [r.d for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(features.normal_date(F.col("v")).alias("d")).collect()]
    assert got == [date(2023, 5, 6), date(2023, 5, 1), date(2023, 1, 1), None, None, None, None, None, date(2023, 1, 1)]


def test_entities(spark):
    rows = notes(spark, [(1, 0, 0, 4, "John", "NNP", "PERSON", None), (1, 0, 5, 10, "Smith", "NNP", "PERSON", None), (1, 0, 20, 26, "Google", "NNP", "ORGANIZATION", None), (1, 0, 30, 38, "Mountain", "NNP", "LOCATION", None), (1, 0, 39, 43, "View", "NNP", "LOCATION", None), (1, 1, 44, 53, "Microsoft", "NNP", "ORGANIZATION", None), (1, 1, 60, 64, "2024", "CD", "DATE", "2024"), (1, 1, 70, 74, "none", "NN", None, None)])
    got = {(r.sentence_id, r.type, r.value, r.begin, r.end) for r in features.entities(rows).collect()}
    assert got == {(0, "PERSON", "john smith", 0, 10), (0, "ORGANIZATION", "google", 20, 26), (0, "LOCATION", "mountain view", 30, 43), (1, "ORGANIZATION", "microsoft", 44, 53)}


def test_dependencies(spark):
    triples = [("fox", "The", "det"), ("fox", "quick", "amod"), ("fox", "jumps", "nsubj"), ("ROOT", "jumps", "root"), ("jumps", "over", "prep"), ("dog", "the", "det"), ("over", "dog", "pobj")]
    rows = spark.createDataFrame([(1, 0, 0, 1, h, d, r) for h, d, r in triples], "document_id long, sentence_id long, begin_char int, end_char int, head_token string, dependent_token string, relation string")
    got = {(r.head, r.relation, r.dependent) for r in features.dependencies(rows, frozenset(("over",))).collect()}
    assert got == {("fox", "amod", "quick"), ("fox", "nsubj", "jumps"), ("root", "root", "jumps")}


def test_tags_and_tokens(spark):
    rows = notes(spark, [(1, 0, 0, 3, "The", "DT", "O", None), (1, 0, 4, 7, "Dog", "nn", "O", None), (1, 0, 8, 9, "a", "NN", "O", None), (1, 0, 10, 12, "'s", "POS", "O", None), (1, 0, 13, 15, "--", ":", "O", None)])
    assert [(r.tag, r.term) for r in features.tags(rows).collect()] == [("NN", "dog")]
    assert {r.token for r in rows.where(features.keep_token(F.col("token"), F.col("pos"))).collect()} == {"The", "Dog", "a"}


def test_offsets(spark):
    rows = notes(spark, words(spark, 1, 0, [("a", 100, 101), ("b", 240, 249), ("c", 245, 260), ("d", 249, 250)]))
    assert [(r.token, r.begin_char, r.end_char) for r in features.relative_offsets(rows).orderBy("begin_char").collect()] == [("a", 0, 1), ("b", 140, 149)]


def test_stitch_counts(spark, cats):
    grams = features.unigrams(cats)
    entity = spark.createDataFrame([(1, 0, "PERSON", "x"), (1, 0, "PERSON", "z"), (2, 0, "CITY", "x")], "document_id long, sentence_id long, type string, value string")
    made = features.stitch(grams, entity)
    assert made.count() == 5 * 2 + 5 and features.stitch_faults(made, grams, entity).count() == 0


def test_renumbering(spark):
    docs = spark.createDataFrame([(k,) for k in (5, 9000, 7, 20_000_000, 1)], "document_id long")
    got = {r.old_id: r.new_id for r in features.renumbered(docs, docs.where("document_id = 7")).collect()}
    assert got == {1: 8, 5: 9, 9000: 10, 20_000_000: 11}


def test_cell_keys(spark):
    r = spark.createDataFrame([(7, 3), (1, 0)], "d long, s long").select("d", "s", cells.pack(F.col("d"), F.col("s")).alias("k")).select("d", "s", cells.document_of(F.col("k")).alias("x"), cells.sentence_of(F.col("k")).alias("z")).collect()
    assert all((q.d, q.s) == (q.x, q.z) for q in r)


def test_stitched_views_hold_all_annotations(spark):
    """Every type and every date is in the whole-table views, and trigrams are registered; all equal their SQL."""
    import duckdb

    from cellweave.queries import ORACLES, QUERIES

    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "nation", "region", "orders", "customer", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    for name in ("stitch_ner_all", "stitch_ner_all_bigram", "stitch_date_all", "stitch_date_all_bigram", "stitch_consistency_all", "stitch_date_trigram", "stitch_pos_trigram"):
        assert sorted(map(tuple, QUERIES[name](spark, path).collect())) == sorted(db.execute(ORACLES[name]).fetchall()), name
    assert {r.type for r in QUERIES["stitch_ner_all"](spark, path).select("type").distinct().collect()} == {"ORGANIZATION", "COUNTRY", "LOCATION", "PERSON"}
    assert QUERIES["stitch_date_all"](spark, path).agg({"cells": "sum"}).first()[0] > QUERIES["stitch_date"](spark, path).agg({"cells": "sum"}).first()[0]
