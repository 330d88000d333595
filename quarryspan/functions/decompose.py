"""Queries taken apart into phrases, requirements and facets, in Arrow batches: each part depends on those before it in its query.

A query is a line of parts between separators (punctuation, connectives, relative pronouns before a verb). Parts
become phrases: a clause has a verb of its own, which an enumeration carries on, and a part that says too little joins a neighbour. Phrases become
requirements: a purpose is split off, several modifiers are given a noun each, and the form of its words tells a requirement's kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryspan import dims

_WORD = re.compile(r"[\w-]+")
_JOIN = "|".join(dims.CONNECTIVES)
_RELATIVE = re.compile(rf"\s+(?:{'|'.join(dims.RELATIVES)})\s+(?=\w{{3,}}(?:s|ing|ed)\b)", re.I)
_SEPARATOR = re.compile(rf"\s*[?!.;,](?:\s*(?:{_JOIN})\b)?\s*|\s+(?P<word>{_JOIN})\s+", re.I)
_CHECKS = "|".join(f"{verb}(?:{'|'.join(endings)})" for verb, endings in dims.PURPOSE_VERBS.items())
_PURPOSE = re.compile(rf"(?P<thing>.+?)\s+to\s+(?:{_CHECKS})\s+(?:whether|if|that)?\s*(?P<aim>.+)$", re.I)
_TERM = re.compile(r"\b[\w-]{3,}\b")
FILLER, GENERIC, MECHANISM = frozenset(dims.PHRASE_FILLER), frozenset(dims.GENERIC_NOUNS), frozenset(dims.MECHANISM)


@dataclass(frozen=True)
class Part:
    """A stretch of a query with the connectives around it (None for punctuation); clause: it has a verb of its own."""

    text: str
    before: str | None = None
    after: str | None = None
    clause: bool = False

    @property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.lower())

    @property
    def telling(self) -> list[str]:
        return [w for w in self.words if w not in FILLER]

    @property
    def thin(self) -> bool:
        """At most one word that informs, and none with a hyphen, a digit, or in capitals."""
        informing = [w for w in self.telling if len(w) >= 4 or "-" in w]
        special = (w for w in _WORD.findall(self.text) if w.lower() not in FILLER and ("-" in w or any(map(str.isdigit, w)) or (w.isupper() and 2 <= len(w) <= 6)))
        return len(informing) <= 1 and next(special, None) is None


def _joined(*parts: str | None) -> str:
    return " ".join(" ".join(filter(None, parts)).split())


def _parts(query: str) -> list[Part]:
    """The parts of three characters or more."""
    relative = [(m.start(), m.end(), None, True) for m in _RELATIVE.finditer(query)]
    edges = [0, *chain.from_iterable(r[:2] for r in relative), len(query)]
    marks = sorted([*relative, *((m.start(), m.end(), m["word"], False) for lo, hi in zip(edges[::2], edges[1::2]) for m in _SEPARATOR.finditer(query, lo, hi))])
    begins = [(0, None, False), *((end, word.lower() if word else None, clause) for _, end, word, clause in marks)]
    ends = [*((start, word) for start, _, word, _ in marks), (len(query), None)]
    out = [Part(_joined(query[b:e]), before, after, clause) for (b, before, clause), (e, after) in zip(begins, ends)]
    return [p for p in out if len(p.text) >= 3]


def _verb_like(word: str) -> bool:
    return len(word) >= 4 and word not in FILLER and "-" not in word and word.endswith(("s", "ing", "ed"))


def _clauses(parts: list[Part]) -> list[Part]:
    """The parts with their verbs: behind a clause a part that begins with a verb is one, too, and what `and` adds to a clause takes its verb over."""
    out: list[Part] = []
    for p in parts:
        if not p.clause and any(q.clause for q in out) and p.words and _verb_like(p.words[0]):
            p = replace(p, clause=True)
        if not p.clause and p.before == "and" and out and out[-1].clause and out[-1].telling:
            p = replace(p, text=f"{out[-1].telling[0]} {p.text}", clause=True)
        out.append(p)
    return out


def phrases(query: str | None) -> list[tuple[str, bool]]:
    """(phrase, whether it has a verb of its own) in the order of the query; none of a null or blank one."""
    parts = _clauses(_parts(query or ""))
    if len(parts) < 2:
        return [(p.text, p.clause) for p in parts]
    out: list[Part] = []
    open_: Part | None = None  # a thin part that waits for the next one
    for i, p in enumerate(parts):
        if open_ is not None:
            p, open_ = replace(p, text=_joined(open_.text, open_.after, p.text), clause=p.clause or open_.clause), None
        elif p.thin:
            if not out or (p.after and i + 1 < len(parts)):
                open_ = p
            else:
                out[-1] = replace(out[-1], text=_joined(out[-1].text, p.before, p.text))
            continue
        out.append(p)
    if open_ is not None:
        out = [*out[:-1], replace(out[-1], text=_joined(out[-1].text, open_.text))] if out else [open_]
    return [(p.text, p.clause) for p in out]


def _shown(text: str) -> dict[str, str]:
    """How words are shown: in lower case, but abbreviations as the text has them first."""
    out: dict[str, str] = {}
    for w in _WORD.findall(text):
        out.setdefault(w.lower(), w if w.isupper() and 2 <= len(w) <= 6 else w.lower())
    return out


def _label(text: str) -> str:
    """A phrase without filler around it and articles within."""
    words = _WORD.findall(text)
    inner = [i for i, w in enumerate(words) if w.lower() not in FILLER]
    shown = words[inner[0]:inner[-1] + 1] if inner else []
    return " ".join(w if w.isupper() and 2 <= len(w) <= 6 else w.lower() for w in shown if w.lower() not in dims.ARTICLES)


def _meaningful(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in FILLER and (len(w) >= 3 or "-" in w)]


def _action(word: str) -> bool:
    return len(word) >= 5 and word.endswith(tuple(dims.ACTION_ENDINGS))


def _loose(word: str) -> bool:
    return word.endswith(tuple(dims.LOOSE_ENDINGS))


def _chunks(text: str, clause: bool) -> list[str]:
    """The smaller requirements of a phrase: with two or more modifiers (compounds, loose ones) and nouns, each modifier takes a noun."""
    words, shown = _meaningful(text), _shown(text)
    if not words:
        return []
    while len(words) > 1 and not clause and not _action(words[0]) and words[-1] in MECHANISM:
        words.pop()  # a generic word at the end says nothing; where a verb leads, it may be its object
    kinds = ["compound" if "-" in w else "loose" if _loose(w) else "noun" for w in words]
    nouns = [i for i, k in enumerate(kinds) if k == "noun"]
    if len(words) - len(nouns) < 2 or len(nouns) < 2:
        return [" ".join(shown.get(w, w) for w in words)]
    groups: list[list[int]] = []
    taken: set[int] = set()
    for kind in ("compound", "loose"):
        for i in (i for i, k in enumerate(kinds) if k == kind):
            free = [n for n in nouns if n not in taken]
            if kind == "compound":  # the next word that is not taken, if that is a noun
                head = [n for n in range(i + 1, len(words)) if n not in taken][:1]
                own = [i, *(n for n in head if n in free)]
            elif free:  # the next noun, or else the first one
                own = [i, next((n for n in free if n > i), free[0])]
            else:
                continue
            groups.append(own)
            taken.update(own)
    rest = [i for i in range(len(words)) if i not in taken]
    groups += [rest] if rest else []
    return [" ".join(shown.get(words[i], words[i]) for i in g) for g in sorted(groups, key=lambda g: g[0])]


def _kind(words: list[str], clause: bool = False) -> str:
    """The kind of a requirement by the form of its words."""
    if clause or (words and _action(words[-1])):
        return "function"
    compound = any("-" in w for w in words)
    subjects = [w for w in words if "-" not in w and not _action(w) and not _loose(w)]
    if compound and len(subjects) <= 1:
        return "mechanism_or_principle"
    return "function" if not subjects and any(map(_action, words)) else "object_or_form_factor"


@dataclass
class Requirements:
    """Requirements in order, each label once, none that says too little."""

    found: list[dict] = field(default_factory=list)

    def add(self, kind: str, label: str, words: list[str]) -> bool:
        label, terms = _joined(label), list(dict.fromkeys(w for w in words if w))
        if not label or any(label.lower() == r["label"].lower() for r in self.found):
            return False
        if len(terms) == 1 and (terms[0] in GENERIC or not ("-" in terms[0] or len(terms[0]) >= dims.LEAST_LONE_TERM)):
            return False
        broad = sum(len(t) >= 4 or "-" in t for t in terms) > dims.MOST_TERMS
        self.found.append({"category": kind, "label": label, "terms": terms, "too_broad": broad})
        return True

    def specific(self) -> list[dict]:
        """Those whose terms are not a part of another's."""
        sets = [frozenset(r["terms"]) for r in self.found]
        return [r for r, s in zip(self.found, sets) if not s or not any(s < other for other in sets)]


def key_terms(query: str | None) -> list[str]:
    """The distinct words of three characters or more that are no stop words, in order."""
    found = (w.strip("_-") for w in _TERM.findall((query or "").lower()))
    return list(dict.fromkeys(w for w in found if w and w not in dims.ENVELOPE_STOPWORDS))


def requirements(query: str | None) -> list[dict]:
    """The requirements (category, label, terms, too_broad) of a query, from its phrases that have a key term."""
    terms, out = key_terms(query), Requirements()
    for text, clause in phrases(query):
        if not any(t in text.lower() for t in terms):
            continue
        purpose = None if clause else _PURPOSE.match(text)
        if purpose:
            for chunk in _chunks(purpose["thing"].strip(), False):
                words = _WORD.findall(chunk.lower())
                out.add(_kind(words), chunk, words)
            aim, shown = _meaningful(purpose["aim"].strip())[:4], _shown(text)
            if aim and out.add("constraint", " ".join(shown.get(w, w) for w in aim), aim):
                continue
        chunks = _chunks(text, clause)
        for chunk in chunks:
            words = _WORD.findall(chunk.lower())
            if words:
                out.add(_kind(words, clause), (_label(text) if len(chunks) == 1 else "") or chunk, words)
    return out.specific() or out.found


def exclusions(query: str | None) -> list[str]:
    """What a query excludes: up to four words behind each negation, by negation."""
    low = (query or "").lower()
    return list(dict.fromkeys(m.strip() for n in dims.NEGATIONS for m in re.findall(rf"\b{re.escape(n)}\s+(\w+(?:\s+\w+){{0,3}})", low)))


def _first_words(text: str, most: int) -> str:
    return " ".join(_WORD.findall(text)[:most])


def variants(query: str, terms: list[str], atoms: list[dict]) -> list[str]:
    """A query's variants for a search: itself, its requirements' labels, and its subject before the more specific ones."""
    labels = [_joined(a["label"]) for a in atoms if a["label"].strip()]
    if not labels:
        short = " ".join(terms[:12]) or query
        return [v for v in dict.fromkeys([query, short, " ".join(terms[2:12]) or short]) if v]
    objects = [a["label"].strip() for a in atoms if a["category"] == "object_or_form_factor"]
    core = (objects or labels)[0]
    others = sorted((a for a in atoms if a["label"].strip() != core), key=lambda a: a["category"] == "object_or_form_factor")
    tail = " ".join([core, *(_joined(a["label"]) for a in others)])
    return [v for v in dict.fromkeys([query, _first_words(" ".join(labels), 32), _first_words(tail, 24)]) if v]


def web_variants(base: list[str], core: str, atoms: list[dict]) -> list[str]:
    """Variants for a web search: the base, the subject with each of three specific requirements, and with a word of intent."""
    core = _joined(core) or next((a["label"].strip() for a in atoms if a["category"] == "object_or_form_factor" and a["label"]), "")
    if not core:
        return list(dict.fromkeys(v for v in base[:3] if v))
    specific = [_first_words(f"{core} {' '.join(a['terms'][:4])}", 12) for a in atoms if a["category"] != "object_or_form_factor" and a["terms"]][:3]
    return list(dict.fromkeys(v for v in [*base[:3], *specific, _first_words(f"{core} {dims.WEB_INTENT}", 10)] if v))[:7]


def understood(query: str) -> dict:
    """The parts of an envelope that come from the text of a query alone."""
    terms, atoms = key_terms(query), requirements(query)
    labels = [a["label"] for a in atoms if a["label"]]
    if not labels:
        spoken = (p for p, _ in phrases(query) if any(t in p.lower() for t in terms[:8]))
        labels = list({p.lower(): p for p in reversed(list(spoken))}.values())[::-1][:5]
    core = (atoms[0]["label"] if atoms and atoms[0]["category"] == "object_or_form_factor" else (terms or [""])[0]).strip()
    base = variants(query, terms, atoms)
    return {
        "key_terms": terms[:20], "core_subject": core, "function": sorted({t for t in terms if _action(t)}), "mechanism_or_principle": sorted({t for t in terms if "-" in t}),
        "critical_requirements": labels, "critical_requirements_atomic": atoms, "negative_requirements": exclusions(query),
        "base_variants": base, "web_variants": web_variants(base, core, atoms),
    }


ATOM = "struct<category:string,label:string,terms:array<string>,too_broad:boolean>"
PHRASES = "array<struct<phrase:string,clause:boolean>>"
UNDERSTOOD = f"struct<key_terms:array<string>,core_subject:string,function:array<string>,mechanism_or_principle:array<string>,critical_requirements:array<string>,critical_requirements_atomic:array<{ATOM}>,negative_requirements:array<string>,base_variants:array<string>,web_variants:array<string>>"


def phrases_column(query: Column) -> Column:
    @F.pandas_udf(PHRASES)
    def over(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda q: [{"phrase": p, "clause": c} for p, c in phrases(q)])

    return over(F.coalesce(query, F.lit("")))


def requirements_column(query: Column) -> Column:
    @F.pandas_udf(f"array<{ATOM}>")
    def over(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(requirements)

    return over(F.coalesce(query, F.lit("")))


def understood_column(query: Column) -> Column:
    @F.pandas_udf(UNDERSTOOD)
    def over(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [understood(q) for q in part]
            yield pd.DataFrame(rows, columns=list(understood("").keys()))

    return over(F.coalesce(query, F.lit("")))
