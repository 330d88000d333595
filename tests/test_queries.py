"""Every query of the core against its SQL counterpart, over the smallest tables."""

from __future__ import annotations

import pytest

from oracle import compare
from quarryspan.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
QUICK = [n for n in QUERIES if n in SQL]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(name, spark, folder):
    compare(QUERIES[name], SQL[name], spark, folder)


#: Queries without SQL, and the tests that hold their results.
ELSEWHERE = {
    "test_whole.py": "t10_unescaped t11_collapse_repeats t14_abstract_excerpt t15_compact_content t16_page_texts d01_greedy_dedupe d02_publication_dedupe d09_publication_search st01_bounded_cache k07_canonical_json q20_envelope_hash q01_coerced q07_phrases q08_requirements q12_envelopes k01_repaired_payloads r01_patent_packs r02_publication_packs r03_web_packs r07_final_packs k03_merged_packs",
    "test_findings.py": "q02_normalized q03_query_hash d08_patent_search",
    "test_providers.py": "s02_keyed_patents s03_table_patents s06_graph_papers s08_xml_records s10_archive_blocks s11_discovered_papers t24_first_claim",
}


def test_every_query_without_sql_has_its_own_test():
    assert {n for names in ELSEWHERE.values() for n in names.split()} == {n for n in QUERIES if n not in SQL}


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
