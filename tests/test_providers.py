"""Payloads of providers in their own shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryspan.plans import providers as Q
from quarryspan.sources import providers as P


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_patents(spark, folder):
    got = rows(Q.s02_keyed_patents(spark, folder), "request", "pos", "number", "title", "snippet")
    assert got == [("q1", 0, "US10123456B2", "Smart door lock – US10123456B2", "A door lock with a wireless module."), ("q1", 2, "WO2019123456A1", "WO2019123456A1", "Application WO2019123456A1 describes a hinge."), ("q2", 0, "EP3456789", "Valve", "A valve."), ("q2", 1, "CN112233445", "Pump CN112233445", "First part second part")]
    table = rows(Q.s03_table_patents(spark, folder), "number", "title", "snippet")
    assert table == [("US20190301122", "FOLDABLE DRONE FRAME", "FOLDABLE DRONE FRAME 16123456 Skyfold Inc. the frame folds without any tools at all"), ("WO2020123456", "IRRIGATION VALVE WITH SELF-CLEANING SEAT", "1. WO/2020/123456 IRRIGATION VALVE WITH SELF-CLEANING SEAT")]


def test_table_snippets(spark):
    df = spark.createDataFrame([("3. 12345678 Sensor array for bridges Int.Class G01M recognising patterns computing Appl.No 5 Inventor Roe EP - 01.02.2020 senses strain in cables",), ("Int. Class G06F data",), (None,)], "row string")
    assert [r[0] for r in df.select(P.table_snippet(F.col("row"))).collect()] == ["Sensor array for bridges 5 Roe senses strain in cables", "", ""]


def test_papers(spark, folder):
    assert rows(Q.s06_graph_papers(spark, folder), "title", "year", "authors", "doi") == [("Anomaly detection in logs", "2021", "A. Novák, Unknown", "10.1000/abc"), ("Untitled", "Unknown", "Unknown", "")]
    assert rows(Q.s10_archive_blocks(spark, folder), "title", "year", "authors", "abstract", "url") == [("Wear of belts: a survey", "2020", "J. Doe, K. Roe", "We survey wear.", "http://arxiv.org/abs/2001.01234v2")]
    assert rows(Q.s11_discovered_papers(spark, folder), "title", "year", "authors", "url") == [("Flat", "2019", "Unknown", "https://a.example/2.pdf"), ("Heat loss at seams", "2022", "X. Y., Z. W.", "https://arxiv.org/abs/2205.00001"), ("Named", "Unknown", "Unknown", "https://a.example/1"), ("No address", "Unknown", "Lab", "")]
    assert rows(Q.s08_xml_records(spark, folder), "title", "year", "authors", "abstract", "doi") == [("Bare", "", "", "", ""), ("Knee joint prostheses & naïve gait", "2018", "Ján Šťastný, X Li", "AIMS: To measure α-angles. It worked.", "10.1000/knee")]


def test_pdf_addresses(spark):
    papers = spark.createDataFrame([(1, "http://arxiv.org/abs/2001.01234v2", None), (2, "https://x.example/a.PDF?x=1", "10.1000/abc"), (3, "https://x.example/a", "10.1000/abc/"), (4, None, "10.1000/closed"), (5, None, None), (6, "u", "10.1000/knee")], "id int, url string, doi string")
    got = {r["id"]: r["pdf_url"] for r in P.pdf_addresses(papers, Q.payloads(spark, "open")).collect()}
    assert got == {1: "https://arxiv.org/pdf/2001.01234v2", 2: "https://x.example/a.PDF?x=1", 3: "https://oa.example/abc.pdf", 4: "", 5: "", 6: ""}


def test_first_claims(spark, folder):
    got = {r["request"]: r["claim"] for r in Q.t24_first_claim(spark, folder).collect()}
    assert got["p1"].startswith("A door lock comprising a wireless module") and got["p2"].startswith("An irrigation valve") and got["p3"] == got["p4"] == ""
    assert P.first_claim(None) == "" and P.first_claim("<div class=claims><p>1. " + "word " * 500 + "</p></div>").endswith("word...")


def test_empty(spark):
    none = spark.createDataFrame([], "request string, payload string")
    for read in (P.keyed_patents, P.table_patents, P.graph_papers, P.archive_blocks, P.discovered_papers, P.xml_papers, P.open_pdfs, P.first_claims):
        assert read(none).count() == 0
