"""Fragments of the SQL counterparts (DuckDB), written apart from the column expressions."""

from __future__ import annotations

from quarryspan import dims


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def suffixes(x: str, rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN right({x}, {len(s)}) = '{s}' AND length({x}) >= {len(s) + 3} THEN left({x}, length({x}) - {len(s)}) || '{r}'" for s, r in rules)
    return f"CASE {cases} ELSE {x} END"


def singular(x: str) -> str:
    return f"CASE WHEN length({x}) <= 3 OR right({x}, 2) = 'ss' THEN {x} ELSE {suffixes(x, dims.PLURALS)} END"


def derived(x: str) -> str:
    return f"CASE WHEN length({x}) <= 4 THEN {x} ELSE {suffixes(x, dims.DERIVATIONS)} END"


def requirement_stem(x: str) -> str:
    table = " ".join(f"WHEN {x} = '{word}' THEN '{to}'" for word, to in dims.REQUIREMENT_STEMS.items())
    return f"CASE {table} WHEN length({x}) <= 3 THEN {x} ELSE {suffixes(x, dims.REQUIREMENT_PLURALS)} END"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def tokens(x: str) -> str:
    kept = f"list_filter({raw_tokens(x)}, lambda t: length(t) >= 2 AND t NOT IN ({quoted(dims.STOPWORDS)}))"
    return f"list_distinct(list_transform(list_transform({kept}, lambda t: {singular('t')}), lambda t: {derived('t')}))"


def mechanism(t: str) -> str:
    """Whether a token is a generic mechanism or the stem of one."""
    words = f"[{quoted(dims.MECHANISM)}]"
    return f"(list_contains({words}, {t}) OR list_contains(list_transform(list_transform({words}, lambda m: {singular('m')}), lambda m: {derived('m')}), {t}))"


def discriminative(toks: str) -> str:
    return f"list_filter({toks}, lambda t: length(t) >= 3 AND t NOT IN ({quoted(dims.BROAD)}))"


def sorted_text(lst: str) -> str:
    return f"array_to_string(list_sort({lst}), ' ')"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"CASE WHEN {squeezed(x)} = '' THEN [] ELSE string_split({squeezed(x)}, ' ') END"


def trim_words(x: str, n: int) -> str:
    return f"CASE WHEN len({words(x)}) <= {n} THEN array_to_string({words(x)}, ' ') ELSE array_to_string(list_slice({words(x)}, 1, {n}), ' ') || '...' END"


def host(u: str) -> str:
    return f"lower(regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query_part(u: str) -> str:
    return rf"regexp_extract(coalesce({u}, ''), '^[^?#]*\?([^#]*)', 1)"


def level_weight(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.LEVEL_WEIGHT.items())
    return f"CAST(CASE lower(trim(coalesce({x}, ''))) {cases} ELSE {dims.UNKNOWN_LEVEL} END AS DOUBLE)"


def level_class(x: str) -> str:
    c = f"lower(trim(coalesce({x}, '')))"
    return f"CASE WHEN {c} IN ({quoted(dims.STRONG)}) THEN 'strong' WHEN {c} IN ({quoted(dims.MEDIUM)}) THEN 'medium' WHEN {c} IN ({quoted(dims.WEAK)}) THEN 'weak' WHEN {c} IN ({quoted(dims.FAILED)}) THEN 'failed' ELSE 'other' END"


def rounded(x: str, places: int = 2) -> str:
    return f"round_even({x}, {places})"


#: The items and sessions once each, and each item as a candidate for its session's query.
ITEMS = "items AS (SELECT DISTINCT * FROM raw_evidence_items)"
POOL = ITEMS + """, pool AS (
  SELECT i.session_id, i.source_type, i.id, i.title, i.summary, i.url, i.evidence_level, i.provider, s.original_query AS query,
    coalesce(i.title, '') || chr(10) || coalesce(i.summary, '') AS text
  FROM items i JOIN research_sessions s USING (session_id))"""


def keyed_hash(key: str, message: str) -> str:
    """HMAC-SHA-256 under a key in hexadecimal digits (of 64 bytes at most)."""
    padded = bytes.fromhex(key).ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ x:02x}" for b in padded) for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"
