"""The pipeline against a plain version of each stage, and the registered queries' contracts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cellweave.llm import queries

from .test_texts import CLASHES, EN, FR, prose, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose in two languages with copies, near copies, leaks, secrets, and texts that no language claims."""
    rng, out = random.Random(21), tmp_path_factory.mktemp("tables")
    items = [(k, prose(rng, 30)) for k in range(6)]
    docs = []
    for k in range(120):
        lang = "fr" if k % 3 == 0 else "en"
        text = prose(rng, 80, FR if lang == "fr" else EN)
        if k % 17 == 5:
            text += " " + items[k % 6][1]
        if k % 13 == 4:
            text += f' token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and more'
        if k % 21 == 9:
            text += " password = changeme1234 end"
        docs.append((k, text, lang, f"src{k % 5}"))
    docs += [(200, docs[7][1], "en", "src1"), (201, docs[8][1] + " extra", "en", "src2"), (202, "12345 !!", "en", "src0"), (203, None, None, None), (204, "", "fr", "src0")]
    rows = [(d, t, g, s, len(t or "")) for d, t, g, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 5 != 2), int(k % 7 == 1)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), items, docs


def test_pipeline(spark, folder):
    path, items, docs = folder
    kept, sets = {}, []
    for doc, text, _, _ in docs:
        if not text or not any(c.isalpha() for c in text):
            continue
        s = shingles(text)
        if any(len(s & o) >= 0.8 * len(s | o) for o in sets):
            continue
        sets.append(s)
        if any(t in text for _, t in items):
            continue
        if 'token = "' in text:
            a = text.index('token = "')
            text = text[:a] + "[SECRET]" + text[a + len('token = "') + 40 :]
        kept[doc] = text
    tool = Tokenizer.from_file(queries.tokenizer_path())
    tool.no_truncation()
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == set(kept) and len(got) == len(kept)
    for r in got:
        text = kept[r.doc_id]
        ids = tool.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), text


def test_stages_on_odd_rows(spark, folder):
    """Nulls in every column, empty and wordless texts, repeated rows, ids of several texts, clashing columns; and empty tables."""
    path, items, docs = folder
    rows = [(1, docs[1][1], "en", "s", 5), (1, docs[1][1], "en", "s", 5), (2, None, None, None, None), (None, docs[2][1], None, "s", 1), (3, "", "fr", "s", 0), (3, docs[4][1], None, None, None), (4, "12 !?", "en", "s", 3), (5, items[0][1], "en", "s", 9), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASHES})
    want = {"language": 6, "near_copies": 8, "benchmark_passages": 8, "secret_spans": 9, "tokens": 9}
    many = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("x") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        given = odd.unionByName(many) if name == "language" else odd
        got = stage(spark, given, path).collect()
        if name == "language":
            left = [r for r in got if r.text in {t for _, t, *_ in rows if t}]
            assert all(any(c.isalpha() for c in r.text or "") for r in got) and {r.text for r in left} >= {docs[1][1], docs[2][1]}
        else:
            assert len(got) == want[name], name
        assert stage(spark, odd.where("false"), path).count() == 0, name


def test_stages_keep_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op2_quality", ["doc_id", "held_out", "score", "predicted"]),
    ("op3_suffix", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ("op5_language", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op6_simhash", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    ("op7_secrets", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    ("op8_jaccard", ["doc_id", "class_id", "n_links"]),
    ("op9_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
])
def test_contracts(spark, folder, name, columns):
    got = __spark_entry__.queries()[name](spark, folder[0])
    assert got.columns[: len(columns)] == columns
    rows = got.collect()
    assert len(rows) == len(folder[2])
    for r in rows:
        for c in ("score", "near_edited", "near_next"):
            assert c not in columns or 0 <= r[c] <= 1
