"""The text operators' queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, neardup, quality, secrets, simhash, suffix, toxicity
from .common import fold, materialise

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", label)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _labelled(spark, sf_dir, "toxic").where(fold("doc_id", 5) != 0), "toxic")
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size", F.floor(F.log2(F.col("n_chars") + 1)))
    train = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs.select("doc_id", "text", "size"), "doc_id")
    model = quality.fit(train.where(fold("doc_id", 4) != 2), "quality", metadata=("size",))
    found = quality.score(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("missing", "block")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin_bytes", "rejected")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = materialise(simhash.fingerprints(docs), "simhash")
    near = simhash.within(found, radius=3)

    def likeness(high: str, low: str):
        return 1 - simhash.distance((F.col("high"), F.col("low")), (F.col(high), F.col(low))) / simhash.BITS

    cols = ["doc_id", "n_chars", "edited_sha256", simhash.hexed(F.col("high"), F.col("low")).alias("fingerprint"), simhash.hexed(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"), likeness("edited_high", "edited_low").alias("near_edited"), likeness("next_high", "next_low").alias("near_next")]
    return found.join(near, ["high", "low"], "left").select(*cols, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


QUERIES = {"op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_suffix": op3_suffix, "op4_licenses": op4_licenses, "op5_language": op5_language, "op6_simhash": op6_simhash, "op7_secrets": op7_secrets, "op8_jaccard": op8_jaccard, "op9_bpe": op9_bpe, "op10_decontaminate": op10_decontaminate}
#: Kinds, patterns and least lengths as the contract has them, apart from the operator's own.
_SQL_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=\-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]+)", 32),
    ("owned", r"([A-Za-z0-9+/_\-]+)", 24),
)
#: What one kind of secret matches: whole matches, values (group 1) and the pieces between.
_KIND = "SELECT doc_id, source, {no} AS kind_no, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', 1) AS v, string_split_regex(t, '{p}') AS g FROM d"
_SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(_KIND.format(no=no, kind=kind, least=least, p=pattern.replace("'", "''")) for no, (kind, pattern, least) in enumerate(_SQL_KINDS))}),
e AS (SELECT doc_id, source, kind_no, kind, least, unnest(w) AS w, unnest(v) AS v, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS i FROM k WHERE len(w) > 0),
p AS (SELECT *, CAST(sum(length(g) + length(w)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS BIGINT) AS z FROM e),
s AS (SELECT doc_id, source, kind_no, kind, v, z - length(w) AS a, z FROM p WHERE length(v) >= least AND (kind_no < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
f AS (SELECT * FROM s WHERE kind_no < 3 OR NOT EXISTS (SELECT 1 FROM s b WHERE b.kind_no < 3 AND b.doc_id = s.doc_id AND b.a < s.z AND s.a < b.z)),
many AS (SELECT least(100, greatest(2, (count(DISTINCT doc_id) + 99) // 100)) AS repositories, least(10, greatest(2, (count(DISTINCT coalesce(source, chr(1))) + 3) // 4)) AS owners FROM documents),
own AS (SELECT v, count(DISTINCT doc_id) AS repositories, count(DISTINCT coalesce(source, chr(1))) AS owners FROM f GROUP BY v),
j AS (SELECT f.*, own.repositories < many.repositories OR own.owners < many.owners AS live FROM f JOIN own USING (v), many),
r AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, kind_no) FILTER (kind_no < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, kind_no) FILTER (kind_no < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN r USING (doc_id)"""
_JACCARD = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\\x{80}-\\x{10ffff}]+') AS w FROM documents),
sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
rep AS MATERIALIZED (SELECT s, row_number() OVER () AS rep, count(*) AS n_copies FROM sh WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.x = b.x AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE n >= 0.8 * (na + nb - n)),
t(node, label) AS (SELECT a, a FROM l UNION SELECT l.b, t.label FROM t JOIN l ON t.node = l.a),
cls AS (SELECT node, least(node, min(label)) AS class FROM t GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
own AS (SELECT doc_id, coalesce(class, rep) AS cls, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies FROM sh LEFT JOIN rep ON sh.s = rep.s LEFT JOIN cls ON cls.node = rep.rep LEFT JOIN k ON k.a = rep.rep),
one AS (SELECT doc_id FROM own WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT coalesce(cls, 0)) = 1),
nm AS (SELECT cls, min(doc_id) AS class_id FROM own SEMI JOIN one USING (doc_id) GROUP BY cls)
SELECT doc_id, CASE WHEN own.cls IS NULL THEN doc_id ELSE class_id END AS class_id, n_links, n_copies FROM own LEFT JOIN nm ON own.cls = nm.cls"""
ORACLES: dict[str, str] = {"op7_secrets": _SECRETS, "op8_jaccard": _JACCARD}
