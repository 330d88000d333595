"""Addresses, publication numbers and identities, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryspan import dims


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path of an address; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_part(url: Column) -> Column:
    """The part after the question mark."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """An address without its tracking parameters, fragment and closing punctuation."""
    u = F.rtrim(F.trim(F.coalesce(url, F.lit(""))), F.lit(".,;"))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query_part(u), "&"), lambda p: (p != "") & ~name(p).isin(*dims.URL_TRACKING) & ~F.startswith(name(p), F.lit("utm_")))
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def identity_url(url: Column) -> Column:
    """An address as an identity: no scheme, www., fragment, tracking or closing slash; the host in lower case."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(F.regexp_replace(u, r"(?i)^https?://", ""), r"(?i)^www\.", "")
    u = F.substring_index(u, "#", 1)
    base = F.substring_index(u, "?", 1)
    base = F.concat(F.lower(F.substring_index(base, "/", 1)), F.substring(base, F.length(F.substring_index(base, "/", 1)) + 1, F.length(base)))
    base = F.rtrim(base, F.lit("/"))
    query = F.when(F.contains(u, F.lit("?")), F.substring(u, F.instr(u, "?") + 1, F.length(u))).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*dims.IDENTITY_TRACKING))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def _under(h: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return out


def low_value(url: Column) -> Column:
    """Whether an address is a search page, or a market's page that is no product."""
    h, p = host(url), F.lower(path(url))
    names = F.transform(F.split(query_part(url), "&"), lambda x: F.lower(F.substring_index(x, "=", 1)))
    search = (h.isin(*dims.SEARCH_HOSTS) | F.endswith(h, F.lit("google.com"))) & F.startswith(p, F.lit("/search"))
    product = path(url).rlike(r"(?i)^/(?:dp/[a-z0-9]+(?:/|$)|gp/product/[a-z0-9]+(?:/|$)|itm/|listing/[0-9]+|ip/|product-detail/)")
    listing = F.endswith(F.rtrim(p, F.lit("/")), F.lit("/s")) & F.arrays_overlap(names, F.array(*map(F.lit, ("k", "q", "query", "search"))))
    return search | p.rlike(r"/(?:search|results)(?:/|$)") | F.when(_under(h, dims.MARKET_HOSTS), ~product).otherwise(listing)


def keep_web(url: Column, query: Column) -> Column:
    """The policy on addresses: none of little value, blocked hosts, or patents unless the query is about them."""
    h = host(url)
    blocked = F.lit(False)
    for d in dims.BLOCKED_HOSTS:
        blocked = blocked | F.endswith(h, F.lit(d))
    patents = h.isin(*dims.PATENT_HOSTS) & ~F.contains(F.lower(F.coalesce(query, F.lit(""))), F.lit("patent"))
    return (h != "") & ~low_value(url) & ~blocked & ~patents


def domain_rank(url: Column) -> Column:
    """0 for public bodies and universities, 1 for documentation, 2 for others, 3 for patent hosts."""
    h = host(url)
    docs = F.contains(h, F.lit("docs.")) | F.contains(h, F.lit("developer.")) | F.contains(h, F.lit("support.")) | F.contains(h, F.lit("github.io"))
    return F.when(h.isin(*dims.PATENT_HOSTS) | F.endswith(h, F.lit(".patents.google.com")), 3).when(F.endswith(h, F.lit(".gov")) | F.endswith(h, F.lit(".edu")), 0).when(docs, 1).otherwise(2)


def registrable(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def patent_number(text: Column) -> Column:
    """The first publication number of six offices in a text, or Unknown."""
    found = F.regexp_extract(F.upper(F.coalesce(F.try_url_decode(text), text, F.lit(""))), r"\b((?:US|EP|WO|CN|JP|KR)[0-9]{4,}[A-Z0-9]*)\b", 1)
    return F.when(found == "", "Unknown").otherwise(found)


def exact_number(value: Column) -> Column:
    """A publication number with its kind code, in one notation; empty if unknown."""
    raw = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(raw == "UNKNOWN", "").otherwise(raw)


def family_number(value: Column) -> Column:
    """A publication number without its kind code."""
    return F.regexp_replace(exact_number(value), r"([A-Z]{2}[0-9]{4,})[A-Z][0-9]?$", "$1")


def title_key(title: Column) -> Column:
    """A title as a key: letters and digits in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def level_weight(level: Column) -> Column:
    """The weight of a level of evidence."""
    clean = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    out = None
    for name, w in dims.LEVEL_WEIGHT.items():
        out = F.when(clean == name, w) if out is None else out.when(clean == name, w)
    return out.otherwise(dims.UNKNOWN_LEVEL).cast("double")


def level_class(level: Column) -> Column:
    """strong, medium, weak, failed or other."""
    clean = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    return F.when(clean.isin(*dims.STRONG), "strong").when(clean.isin(*dims.MEDIUM), "medium").when(clean.isin(*dims.WEAK), "weak").when(clean.isin(*dims.FAILED), "failed").otherwise("other")


def sha_prefix(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(value, 256), 1, digits)


def candidate_identity(canonical: Column, url: Column, title: Column, score_text: Column) -> Column:
    """The identifier if there is one, else the address as an identity, else a hash of the texts."""
    own = F.lower(F.trim(F.coalesce(canonical, F.lit(""))))
    address = identity_url(url)
    digest = sha_prefix(F.concat_ws("\x1f", F.coalesce(title, F.lit("")), F.coalesce(score_text, F.lit(""))), 32)
    return F.when(own != "", own).when(address != "", address).otherwise(digest)
