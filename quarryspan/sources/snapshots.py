"""Snapshots with a digest, gold sets, provider payloads and pages: readers and writers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: the number of rows and the sum of their hashes."""
    row = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def read_snapshot(spark: SparkSession, path: str, expected: str, columns: list[str]) -> DataFrame:
    """A snapshot with exactly these columns and this digest; anything else is an error."""
    df = spark.read.parquet(path)
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {sorted(df.columns)} instead of {sorted(columns)}")
    if digest(df) != expected:
        raise ValueError("the snapshot isn't the one that was sealed")
    return df


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write to a folder that must not exist yet."""
    df.write.mode("errorifexists").format(form).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append rows to an event table partitioned by kind of source."""
    df.write.mode("append").partitionBy("source_type").parquet(path)


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A gold set (queries with labelled candidates, JSON) as rows query_id, query, source_type, pos, label, text; lines: one object a line."""
    raw = spark.read.option("multiLine", not lines).json(path).select(F.explode("queries").alias("q"))
    rows = raw.select(F.col("q.id").alias("query_id"), F.col("q.query").alias("query"), F.col("q.source_type").alias("source_type"), F.posexplode("q.candidates").alias("pos", "c"))
    return rows.select("query_id", "query", "source_type", "pos", F.col("c.label").cast("int").alias("label"), F.trim(F.concat_ws("\n", "c.title", "c.text")).alias("text"))


PATENT_PAYLOAD = "results struct<cluster:array<struct<result:array<struct<patent:struct<publication_number:string,title:string,snippet:string,pdf:string,assignee:string,filing_date:string,grant_date:string>>>>>>"


def patent_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Patents of raw search payloads (JSON text), one row each; those without a publication number are left out."""
    parsed = raw.select(F.from_json(column, PATENT_PAYLOAD)["results"]["cluster"].alias("c")).select(F.explode("c").alias("c")).select(F.explode("c.result").alias("r")).select("r.patent.*")
    number = F.regexp_replace(F.upper(F.coalesce("publication_number", F.lit(""))), "[^A-Z0-9]", "")
    words = F.split(F.trim(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " ")), " ")
    return parsed.withColumn("publication_number", number).where("publication_number <> ''").withColumn("snippet", F.array_join(F.slice(words, 1, 60), " "))


def inverted_abstracts(raw: DataFrame, column: str = "inverted") -> DataFrame:
    """Texts rebuilt from inverted indexes (word to positions): rows keep their other columns, with text added."""
    entries = F.flatten(F.transform(F.map_entries(column), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return raw.withColumn("text", F.array_join(F.transform(F.array_sort(entries), lambda x: x["word"]), " "))


def scholarly_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Works of a scholarly payload: title, the year, first five authors, abstract without markup."""
    schema = "title array<string>, abstract string, DOI string, author array<struct<given:string,family:string>>, published struct<`date-parts`:array<array<int>>>"
    w = raw.select(F.from_json(column, schema).alias("w"))
    authors = F.array_join(F.slice(F.transform("w.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), 1, 5), ", ")
    return w.select(F.try_element_at("w.title", F.lit(1)).alias("title"), F.lower("w.DOI").alias("doi"), authors.alias("authors"), F.try_element_at(F.try_element_at(F.col("w.published")["date-parts"], F.lit(1)), F.lit(1)).alias("year"), F.trim(F.regexp_replace("w.abstract", "<[^>]+>", " ")).alias("abstract")).where("abstract <> ''")


class _Text(HTMLParser):
    SKIPPED = {"nav", "header", "footer", "aside", "script", "style", "form", "noscript"}
    VOID = {"br", "img", "meta", "link", "input", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.main_depth, self.all, self.main = 0, 0, [], []
        self.dates: dict[int, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        marks = dict(attrs)
        classes = (marks.get("class") or "").split()
        if not self.depth:
            kinds = [tag == "meta" and marks.get("property") == "article:published_time", tag == "meta" and marks.get("name") == "pubdate", tag == "time" and "datetime" in marks]
            for kind in (i for i, here in enumerate(kinds) if here):
                self.dates.setdefault(kind, (marks.get("content") or marks.get("datetime") or "").strip())
        if self.depth or tag in self.SKIPPED or "ads" in classes or "cookie-banner" in classes:
            self.depth += tag not in self.VOID
        elif self.main_depth or tag in {"main", "article"} or marks.get("role") == "main":
            self.main_depth += tag not in self.VOID

    def handle_endtag(self, tag: str) -> None:
        if self.depth:
            self.depth -= 1
        elif self.main_depth:
            self.main_depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.all.append(data)
            if self.main_depth:
                self.main.append(data)


_FURNITURE = re.compile(r"(?:menu|skip|cart|sign in|subscribe)\b", re.I)


def dated_text(html: str | None) -> tuple[str, str]:
    """(date, text) of a page: the best date it names, or Unknown, and the lines of six words or more of its main part, without navigation."""
    parser = _Text()
    parser.feed(html or "")
    lines = [" ".join(x.split()) for part in (parser.main or parser.all) for x in part.splitlines()]
    date = parser.dates[min(parser.dates)] if parser.dates else ""
    return date or "Unknown", "\n".join(x for x in lines if len(x.split()) >= 6 and not _FURNITURE.match(x))


def main_text(html: str | None) -> str:
    """The lines of six words or more of a page's main part, without navigation."""
    return dated_text(html)[1]


def page_texts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, date, text) of pages; a null page has an empty text and an unknown date."""
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [dated_text(x) for x in b.iloc[:, 1]]
            yield pd.DataFrame({"key": b.iloc[:, 0], "date": [d for d, _ in found], "text": [t for _, t in found]})

    return pages.select(F.col(key).cast("string"), F.col(html)).mapInPandas(parts, "key string, date string, text string")


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, abstract, doi and year from their meta tags, and the level of evidence that they give."""
    def meta(*names: str):
        found = [F.nullif(F.regexp_extract(html, rf"(?is)<meta[^>]+name=[\"']{n}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1), F.lit("")) for n in names]
        return F.coalesce(*found)

    df = pages.withColumn("title", F.coalesce(meta("citation_title", "dc.title"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))).withColumn("abstract", meta("citation_abstract", "dc.description", "description")).withColumn("doi", F.lower(meta("citation_doi", "dc.identifier"))).withColumn("year", F.nullif(F.regexp_extract(F.coalesce(meta("citation_publication_date", "citation_year"), F.lit("")), r"(\d{4})", 1), F.lit("")))
    words = F.size(F.split(F.trim(F.coalesce("abstract", F.lit(""))), r"\s+"))
    return df.withColumn("level", F.when(F.col("abstract").isNotNull() & (words >= 12), "abstract_verified").when(F.col("title").isNotNull(), "verified_metadata").otherwise("fetch_failed"))
