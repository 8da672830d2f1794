"""Where documents come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "document_id long, title string, text string, timestamp string"


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """title, text, timestamp of each line that has text; index lines (`_type` of `_doc`) and malformed lines are skipped."""
    rows = spark.read.schema("_type string, title string, text string, timestamp string").option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("text").isNotNull() & (F.coalesce("_type", F.lit("")) != "_doc")).select("title", "text", "timestamp")
    return rows if limit is None else rows.limit(limit)


#: Further fields of a news document and the elements that hold them. Fixed values of the public news format.
NEWS_FIELDS = {"byline": ".//byline[@class='print_byline']", "dateline": ".//dateline", "lead": ".//block[@class='lead_paragraph']", "abstract": ".//abstract", "descriptors": ".//classifier[@type='descriptor']", "general_descriptors": ".//classifier[@type='general_descriptor']", "taxonomic_classifiers": ".//classifier[@type='taxonomic_classifier']", "types_of_material": ".//classifier[@type='types_of_material']", "people": ".//person", "locations": ".//location", "organizations": ".//org", "titles": ".//object.title", "correction": ".//block[@class='correction_text']", "kicker": ".//kicker", "online_headline": ".//hl2"}
NEWS_META = ("publication_day_of_month", "publication_month", "publication_year", "publication_day_of_week", "dsk", "online_sections", "print_page_number", "print_section", "print_column", "feature_page", "series_name", "alternate_url", "slug", "banner")


def news_archives(spark: SparkSession, path: str, extras: bool = False) -> DataFrame:
    """file, place, title, text, timestamp of the XML entries of tar.gz archives; entries without title or body are left out.
    With `extras` also `fields`: all other known fields by name, each with its values. Entries stream out of an archive a few hundred at a time; an
    archive is one task's work, as compressed archives can't be split."""
    files = spark.read.format("binaryFile").load(path)
    columns = ["file", "place", "title", "text", "timestamp"] + ["fields"] * extras

    def run(batches):
        import io
        import tarfile
        import xml.etree.ElementTree as ET
        from datetime import datetime

        import pandas as pd

        def flat(e) -> str:
            return "".join(e.itertext()).strip() if e is not None else ""

        def fields(root) -> dict[str, list[str]]:
            out = {n: [v for e in root.findall(p) if (v := flat(e))] for n, p in NEWS_FIELDS.items()}
            out |= {m.get("name"): [m.get("content")] for m in root.findall(".//meta") if m.get("name") in NEWS_META and m.get("content")}
            return {n: v for n, v in out.items() if v}

        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for place, entry in enumerate(e for e in tar if e.isfile() and e.name.endswith(".xml")):
                        try:
                            root = ET.fromstring(tar.extractfile(entry).read())
                        except ET.ParseError:
                            continue
                        found, when = root.find(".//block[@class='full_text']"), root.find(".//pubdata")
                        title, text = flat(root.find(".//hedline/hl1")), "\n".join(flat(p) for p in (found if found is not None else []))
                        try:
                            stamp = datetime.strptime((when.get("date.publication") or "")[:15], "%Y%m%dT%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if when is not None else None
                        except ValueError:
                            stamp = None
                        if title and text.strip():
                            rows.append((name, place, title, text, stamp, *([fields(root)] * extras)))
                        if len(rows) >= 500:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "file string, place long, title string, text string, timestamp string" + ", fields map<string,array<string>>" * extras)


def per_year(rows: DataFrame, total: int, year: str = "year", order: list[str] | None = None) -> DataFrame:
    """At most `total` rows, the same number of each year; the first years take what is left over.

    Quotas come from the years present; ranks are kept only as far as a quota reaches, so a large year is cut in each task first."""
    years = sorted(r[0] for r in rows.select(year).where(F.col(year).isNotNull()).distinct().collect())
    if not years:
        return rows.limit(0)
    share, more = divmod(total, len(years))
    quota = F.create_map(*[x for k, y in enumerate(years) for x in (F.lit(y), F.lit(share + (k < more)))])
    line = Window.partitionBy(year).orderBy(*(order or [c for c in rows.columns if c != year]))
    return rows.withColumn("cw_rank", F.row_number().over(line)).where(F.col("cw_rank") <= share + 1).where(F.col("cw_rank") <= quota[F.col(year)]).drop("cw_rank")


def stopwords(path: str | None) -> frozenset[str]:
    """Words of a file, one a line, lower case; `#` starts a comment; a missing file has none."""
    try:
        with open(path, encoding="utf-8") as f:
            return frozenset(w for line in f if (w := line.strip().lower()) and not w.startswith("#"))
    except (OSError, TypeError):
        return frozenset()


def unannotated(documents: DataFrame, annotations: DataFrame, start: int | None = None, limit: int | None = None, force: bool = False) -> DataFrame:
    """Documents that still need annotation: all of them with `force`; from id `start` on, if given."""
    rest = documents if force else documents.join(annotations.select("document_id").distinct(), "document_id", "left_anti")
    if start is not None:
        rest = rest.where(F.col("document_id") >= start)
    return rest if limit is None else rest.orderBy("document_id").limit(limit)
