from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryspan.functions import ids as U
from quarryspan.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("logs", "log"), ("applications", "applicate"), ("application", "applicate"), ("glass", "glass"), ("batches", "batch"), ("bus", "bus"), ("studies", "study"), ("monitoring", "monitor"), ("controlled", "controll"), ("sensors", "sensor")])
def test_stem(spark, word, stem):
    assert value(spark, T.stem(F.lit(word))) == stem


def test_tokens_of_null_empty_and_long(spark):
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, T.tokens(F.lit(""))) == []
    assert sorted(value(spark, T.tokens(F.repeat(F.lit("sensors and the Größe "), F.lit(20_000))))) == ["gr", "sensor"]


def test_trim_words(spark):
    assert value(spark, T.trim_words(F.lit("  a  b\nc "), 2)) == "a b..."
    assert value(spark, T.trim_words(F.lit(None).cast("string"), 2)) == ""


def test_match_strength(spark):
    assert value(spark, T.match_strength(["locking", "log book"], F.lit("It locks the logbook."))) == "full"
    assert value(spark, T.match_strength(["locking", "sensor"], F.lit("It locks."))) == "partial"
    assert value(spark, T.match_strength([" "], F.lit("x"))) == "none"


def test_collapse_repeats(spark):
    assert value(spark, T.collapse_repeats(F.lit("Rootly | Rootly Product Product page"))) == "Rootly Product page"


def test_excerpts(spark):
    text = F.lit("One thing. A sensor reads heat. Nothing here. The sensor logs heat and heat.")
    assert value(spark, T.abstract_excerpt(text, T.tokens(F.lit("sensor heat")), 9)) == "One thing. A sensor reads heat. Nothing here."
    assert value(spark, T.compact_content(text, T.web_terms(F.lit("sensor heat")), 50, 1)) == "A sensor reads heat."


@pytest.mark.parametrize(("url", "identity"), [("HTTPS://WWW.Site.example/A/?utm_source=x&id=B#f", "site.example/A?id=B"), (None, ""), ("site.example/", "site.example"), ("http://a.example/p?tag=a&tag=b&gclid=1", "a.example/p?tag=a&tag=b")])
def test_identity_url(spark, url, identity):
    assert value(spark, U.identity_url(F.lit(url).cast("string"))) == identity


def test_publication_numbers(spark):
    assert value(spark, U.exact_number(F.lit("US 10,762,444 B2"))) == "US10762444B2"
    assert value(spark, U.family_number(F.lit("US-10762444-B2"))) == "US10762444"
    assert value(spark, U.patent_number(F.lit("see%20us10762444b2 here"))) == "US10762444B2"
    assert value(spark, U.patent_number(F.lit(None).cast("string"))) == "Unknown"


@pytest.mark.parametrize(("given", "query"), [
    ('{"limit": 3, "query": "Door lock", "keywords": ["lock", "DOOR LOCK", "alarm"], "filters": {"x": "no"}, "note": "with sensor"}', "Door lock lock alarm with sensor"),
    ('[{"input": {"question": "valve"}}, 7, null, "seat"]', "valve seat"), ('{"query": "broken, "limit": null, terms', "query broken terms"), ("Query:  plain   text", "plain text"), ('{"input": {"prompt": "a {b} c"}}', "a b c"), ("", ""), ("[]", ""),
])
def test_structured_input_as_query(given, query):
    from quarryspan.functions.structured import as_query

    assert " ".join(as_query(given).split()) == query


def test_date_and_lines_of_a_page():
    from quarryspan.sources.snapshots import dated_text

    page = "<html><head><meta name='pubdate' content='2024-05-01'></head><body><nav>Menu of a page that has six words</nav><p>Cartridge filters of this kind last a year.</p><p>Cart items are shown here for all.</p><time datetime='2020-01-01'>then</time></body></html>"
    assert dated_text(page) == ("2024-05-01", "Cartridge filters of this kind last a year.") and dated_text(None) == ("Unknown", "")
