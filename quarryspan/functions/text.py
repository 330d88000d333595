"""Text functions: tokens, stems, matching, cleaning, truncation. All are native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarryspan import dims


def _among(t: Column, words: list[str]) -> Column:
    """Whether a word is one of a fixed list, as one constant in the plan."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), t)


def _first_suffix(x: Column, rules: list[tuple[str, str]]) -> Column:
    """The word with the first suffix replaced that it ends with and that leaves three letters."""
    out = None
    for suffix, to in rules:
        fits = F.endswith(x, F.lit(suffix)) & (F.length(x) >= len(suffix) + 3)
        done = F.concat(F.left(x, F.length(x) - len(suffix)), F.lit(to))
        out = F.when(fits, done) if out is None else out.when(fits, done)
    return out.otherwise(x)


def singular(x: Column) -> Column:
    """The plural rules, but not for short words and words in -ss."""
    return F.when((F.length(x) <= 3) | F.endswith(x, F.lit("ss")), x).otherwise(_first_suffix(x, dims.PLURALS))


def stem(x: Column) -> Column:
    """A light English stem: plural first, then one derivational suffix of longer words."""
    # by way of an array, so that the first step is evaluated once and not at each use
    return F.element_at(F.transform(F.transform(F.array(x), lambda t: singular(t)), lambda t: _derived(t)), 1)


def _derived(s: Column) -> Column:
    return F.when(F.length(s) <= 4, s).otherwise(_first_suffix(s, dims.DERIVATIONS))


def raw_tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits, in lower case; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """The distinct stems of a text's tokens, without stop words and single characters."""
    kept = F.filter(raw_tokens(text), lambda t: (F.length(t) >= 2) & ~_among(t, dims.STOPWORDS))
    return F.array_distinct(F.transform(F.transform(kept, singular), _derived))


def discriminative(tokens_: Column) -> Column:
    """Tokens that tell a subject: at least three letters, none of the broad words."""
    return F.filter(tokens_, lambda t: (F.length(t) >= 3) & ~_among(t, dims.BROAD))


@cache
def _evaluated(function: Callable[[Column], Column], words: tuple[str, ...]) -> tuple[str, ...]:
    """What a column function makes of a few constants, so that a plan holds the result instead of the expression."""
    (out,) = SparkSession.active().range(1).select(F.transform(F.split(F.lit(" ".join(words)), " "), function)).first()
    return tuple(out)


def subject_anchors(tokens_: Column) -> Column:
    """Tokens that are no generic mechanism (as written or as a stem); compounds count by their parts."""
    generic = sorted({*dims.MECHANISM, *_evaluated(stem, tuple(dims.MECHANISM))})

    def mechanism(t: Column) -> Column:
        parts = F.filter(F.split(t, "[-_/]+"), lambda p: p != "")
        all_forms = F.concat(parts, F.transform(parts, stem))
        compound = (F.size(parts) > 1) & F.forall(all_forms, lambda p: _among(p, generic) | (F.length(p) <= 2)) & F.exists(all_forms, lambda p: _among(p, generic))
        return _among(t, generic) | (t.rlike("[-_/]") & compound)

    return F.filter(tokens_, lambda t: ~mechanism(t))


def requirement_stem(x: Column) -> Column:
    """The other stem, of requirement matching: a table first, then plurals only."""
    out = reduce(lambda e, r: e.when(x == r[0], r[1]), dims.REQUIREMENT_STEMS.items(), F)
    return out.when(F.length(x) <= 3, x).otherwise(_first_suffix(x, dims.REQUIREMENT_PLURALS))


def blob_tokens(text: Column) -> Column:
    """A text's tokens and their requirement stems."""
    raw = F.array_distinct(raw_tokens(text))
    return F.array_union(raw, F.transform(raw, requirement_stem))


def compact(text: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def term_matches(term: str, blob: Column, joined_text: Column) -> Column:
    """Whether a term's parts are all in the blob, or, of several parts, together in the joined text."""
    parts = re.findall("[a-z0-9]+", term.lower())
    if not parts:
        return F.lit(False)
    each = reduce(lambda a, b: a & b, [F.arrays_overlap(blob, F.array(F.lit(p), requirement_stem(F.lit(p)))) for p in parts])
    return each | F.contains(joined_text, F.lit("".join(parts))) if len(parts) > 1 else each


def match_strength(terms: list[str], text: Column) -> Column:
    """full, partial or none: how many of the terms a text has."""
    kept = [t.lower().strip() for t in terms if t.strip()]
    if not kept:
        return F.lit("none")
    blob, joined = blob_tokens(text), compact(text)
    n = F.aggregate(F.array(*[term_matches(t, blob, joined).cast("int") for t in kept]), F.lit(0), lambda a, x: a + x)
    return F.when(n == len(kept), "full").when(n > 0, "partial").otherwise("none")


def coverage_tokens(text: Column, cap: int = 2500) -> Column:
    """The distinct tokens (hyphens kept) in the order of the text, joined by blanks."""
    return F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]{1,}"), F.lit(0))), 1, max(1, cap)), " ")


def squeezed(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s]+", " "))


def word_list(text: Column) -> Column:
    """The words of a text; none of a blank one."""
    s = squeezed(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def trim_words(text: Column, limit: int) -> Column:
    """The first words of a text, with three dots where it was longer."""
    w = word_list(text)
    return F.when(F.size(w) <= limit, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit("...")))


def trim_lines(text: Column, limit: int) -> Column:
    """A text of so many words at most: whole lines as long as they fit, then the first words of the next one with three dots."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)).alias("words")))
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(a: Column, x: Column) -> Column:
        n = F.size(x["words"])
        whole = F.struct(F.concat(a["kept"], F.array(x["line"])).alias("kept"), (a["used"] + n).alias("used"), F.lit(False).alias("full"))
        part = F.rtrim(F.array_join(F.slice(x["words"], 1, F.greatest(F.lit(limit) - a["used"], F.lit(0))), " "), F.lit(" .,;"))
        last = F.struct(F.when(part != "", F.concat(a["kept"], F.array(F.concat(part, F.lit("..."))))).otherwise(a["kept"]).alias("kept"), a["used"].alias("used"), F.lit(True).alias("full"))
        return F.when(a["full"], a).when(a["used"] + n <= limit, whole).otherwise(last)

    out = F.aggregate(counted, empty, add)["kept"]
    return F.rtrim(F.array_join(out, "\n"), F.lit(" \t\n\x0b\f\r"))


def without_json_tail(text: Column) -> Column:
    """A text up to the first marker of serialised JSON (in the order of the list) behind its beginning, without punctuation around it."""
    whole = F.coalesce(text, F.lit(""))
    parts = [F.when(F.instr(whole, m) > 1, F.substring(whole, F.lit(1), F.instr(whole, m) - 1)) for m in dims.JSON_TAIL]
    return squeezed(F.btrim(F.coalesce(*parts, whole), F.lit(" ,{}[]'\"\\")))


def collapse_repeats(text: Column) -> Column:
    """A phrase repeated across a bar, and a word repeated at once, only once."""
    bars = F.regexp_replace(F.coalesce(text, F.lit("")), dims.REPEATED_ACROSS_BAR, "$1")
    return squeezed(F.regexp_replace(bars, dims.REPEATED_WORD, "$1"))


def strip_boilerplate(text: Column) -> Column:
    """Without headings' marks, repository counters and calls to click, sign in and the like."""
    s = reduce(lambda x, pattern: F.regexp_replace(x, pattern, " "), dims.BOILERPLATE, F.coalesce(text, F.lit("")))
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" .,;:|-–—"))


def strip_leading_title(summary: Column, title: Column) -> Column:
    """A summary without its title (of eight characters or more) at the beginning."""
    body, head = squeezed(summary), squeezed(title)
    rest = F.ltrim(F.substring(body, F.length(head) + 1, F.length(body)), F.lit(" .,:;–—-|"))
    return F.when((F.length(head) >= 8) & F.startswith(F.lower(body), F.lower(head)), rest).otherwise(body)


def content_flags(text: Column) -> dict[str, Column]:
    """Whether a fetched text is an error page, has enough words, is blocked, or looks binary."""
    low = F.lower(squeezed(text))
    head = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    odd = F.regexp_count(head, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]"))
    return {
        "is_error": low.rlike(r"\b(?:403 forbidden|404 not found|target url returned error 40[34])\b"),
        "has_content": F.size(word_list(text)) >= 12,
        "is_limited": low.rlike(r"captcha|access denied|forbidden|temporarily blocked|automated queries"),
        "is_binary": (F.length(head) > 0) & (odd > F.length(head) * 0.02),
    }


def web_terms(query: Column) -> Column:
    """Words of a query of four letters or more (hyphens kept), without the web stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]{3,}"), F.lit(0)))
    return F.filter(found, lambda t: ~_among(t, dims.WEB_STOPWORDS))


def substring_coverage(terms: Column, text: Column) -> Column:
    """How many terms a text contains anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def sentences(text: Column) -> Column:
    """Parts between an end mark with white space after it."""
    return F.filter(F.split(squeezed(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def compact_content(text: Column, terms: Column, words: int, most: int) -> Column:
    """The sentences with the most terms, in the order of the text; the beginning where none has any."""
    parts = F.transform(sentences(text), lambda s, i: F.struct((-substring_coverage(terms, s)).alias("n"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(F.filter(parts, lambda p: p["n"] < 0)), 1, most)
    chosen = F.array_join(F.transform(F.array_sort(F.transform(best, lambda p: F.struct(p["i"].alias("i"), p["s"].alias("s")))), lambda p: p["s"]), " ")
    return F.when((F.size(terms) > 0) & (F.size(best) > 0), trim_words(chosen, words)).otherwise(trim_words(text, words))


def abstract_excerpt(text: Column, query_tokens: Column, words: int = 60) -> Column:
    """Sentences with the most shared tokens that fit the budget of words, in the order of the text; the best one always."""
    parts = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), query_tokens))).alias("n"), i.alias("i"), F.size(word_list(s)).alias("w"), s.alias("s")))
    empty = F.struct(F.array().cast("array<struct<i:int,s:string>>").alias("kept"), F.lit(0).alias("used"))
    taken = F.aggregate(F.array_sort(parts), empty, lambda a, p: F.when((F.size(a["kept"]) == 0) | (a["used"] + p["w"] <= words), F.struct(F.concat(a["kept"], F.array(F.struct(p["i"].alias("i"), p["s"].alias("s")))).alias("kept"), (a["used"] + p["w"]).alias("used"))).otherwise(a))
    return F.array_join(F.transform(F.array_sort(taken["kept"]), lambda p: p["s"]), " ")


def rounded(x: Column, places: int = 2) -> Column:
    """Half-even rounding that is the same in both engines."""
    return F.rint(x * 10**places) / 10**places
