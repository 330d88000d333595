"""Queries s02_, s03_, s06_, s08_, s10_ to s12_, t24_: payloads of providers as they come, from files of this package, and addresses of the items' papers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.functions import ids as U
from quarryspan.functions import text as T
from quarryspan.plans import identity as Q
from quarryspan.plans import sql as S
from quarryspan.plans.views import items
from quarryspan.session import with_package
from quarryspan.sources import providers as P

#: A few answers of each kind of provider, in their own shapes, broken ones among them.
PAYLOADS = Path(__file__).resolve().parent.parent / "fixtures" / "payloads.jsonl"


def payloads(spark: SparkSession, kind: str) -> DataFrame:
    """(request, payload) of one kind of provider; the file is small and part of the package, so it is read here."""
    rows = [json.loads(line) for line in PAYLOADS.read_text(encoding="utf-8").splitlines()]
    return with_package(spark).createDataFrame([(r["request"], r["payload"]) for r in rows if r["kind"] == kind], "request string, payload string")


def s02_keyed_patents(spark: SparkSession, folder: str) -> DataFrame:
    return P.keyed_patents(payloads(spark, "keyed"))


def s03_table_patents(spark: SparkSession, folder: str) -> DataFrame:
    return P.table_patents(payloads(spark, "table"))


def s06_graph_papers(spark: SparkSession, folder: str) -> DataFrame:
    return P.graph_papers(payloads(spark, "graph"))


def s08_xml_records(spark: SparkSession, folder: str) -> DataFrame:
    return P.xml_papers(payloads(spark, "xml"))


def s10_archive_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return P.archive_blocks(payloads(spark, "archive"))


def s11_discovered_papers(spark: SparkSession, folder: str) -> DataFrame:
    return P.discovered_papers(payloads(spark, "discovery"))


def s12_pdf_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The address of the PDF of each publication among the items: told by its own address, or by the open-access answer for its DOI."""
    rows = items(spark, folder, "source_type", "url", "canonical_id").where("source_type = 'publication'")
    doi = F.regexp_extract(F.lower(F.coalesce("canonical_id", F.lit(""))), r"(10\.[0-9]+/\S+)", 1)
    return P.pdf_addresses(rows.select("id", "url", doi.alias("doi")), payloads(spark, "open"))


#: The order in which the providers' texts of an address are taken.
BACKENDS = ["patgrid", "scholarnet", "pagelens", "webscout", "crawlio", "netquery"]


def s13_fetch_chain(spark: SparkSession, folder: str) -> DataFrame:
    """For each address of the items the text of the first provider in a fixed order that has twelve words or more."""
    rows = items(spark, folder, "url", "provider", "summary").where("trim(url) <> ''")
    fetches = rows.select(U.canonical_url(F.col("url")).alias("key"), F.lower(F.trim("provider")).alias("backend"), T.squeezed(F.col("summary")).alias("text"))
    return P.first_texts(fetches, BACKENDS).select(F.col("key").alias("address"), "backend", F.sha2("text", 256).alias("text_hash"))


def t24_first_claim(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_claims(payloads(spark, "page"))


QUERIES = {f.__name__: f for f in (s02_keyed_patents, s03_table_patents, s06_graph_papers, s08_xml_records, s10_archive_blocks, s11_discovered_papers, s12_pdf_addresses, s13_fetch_chain, t24_first_claim)}
ORACLE = {
    "s13_fetch_chain": f"""
WITH c AS ({Q.ORACLE['u01_canonical_url']}), {S.ITEMS}, f AS (SELECT canonical_url AS address, lower(trim(provider)) AS backend, {S.squeezed('summary')} AS text FROM items JOIN c USING (id) WHERE trim(url) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY list_position([{S.quoted(BACKENDS)}], backend), text) AS r FROM f WHERE backend IN ({S.quoted(BACKENDS)}) AND len(string_split(text, ' ')) >= 12)
SELECT address, backend, sha256(text) AS text_hash FROM r WHERE r = 1""",
    "s12_pdf_addresses": rf"""
WITH {S.ITEMS}, p AS (SELECT id, coalesce(url, '') AS u, trim(regexp_extract(lower(coalesce(canonical_id, '')), '(10\.[0-9]+/\S+)', 1), '/') AS doi FROM items WHERE source_type = 'publication'),
a AS (SELECT *, regexp_extract(u, 'arxiv\.org/abs/([0-9]{{4}}\.[0-9]{{4,5}}(?:v\d+)?)', 1, 'i') AS n FROM p), o AS (SELECT * FROM (VALUES ('10.1000/abc', 'https://oa.example/abc.pdf')) t(doi, pdf))
SELECT id, CASE WHEN n <> '' THEN 'https://arxiv.org/pdf/' || n WHEN ends_with(lower(string_split(u, '?')[1]), '.pdf') THEN u ELSE coalesce(pdf, '') END AS pdf_url FROM a LEFT JOIN o USING (doi)""",
}
