"""Sentence units of texts in any script, with their positions.

The rules are those of the standard sentence-break property (terminators STerm and ATerm of all
scripts, Close, Sp, Lower, Upper), with abbreviations suppressed in their own language, which the script and the
function words of the sentence tell, pairs of quotation marks and brackets kept whole, headings and list entries as units of their
own, and, for Thai, which has no terminators, blanks between clauses. A heading is a line that ended though the next
word had room in it, and that no sentence ends in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations by language. A name or a number follows those of the first two groups;
# those of the third may also end a sentence.
BEFORE_ANY = {
    "en": "dr prof mr mrs ms cf vs e.g i.e appl al rev viz",
    "de": "dr prof hr fr vgl bzw z.b d.h u.a s.o s.u sog inkl exkl ggf evtl bspw insb",
    "fr": "dr prof mme mlle cf p.ex c.-à-d c.à.d",
    "es": "dr dra sr sra srta d dña prof p.ej cf ud uds",
    "sk": "dr prof ing mgr bc mudr judr rndr doc napr tzv t.j t.z resp porov",
    "ru": "т.е т.к т.н напр см ср им проф д-р гр ул акад",
    "hi": "डॉ श्री श्रीमती प्रो मि मी मि.मी से.मी कि.मी उदा",
}
BEFORE_NUMBER = {
    "en": "no nos fig figs tab sec secs eq eqs ch chap vol pp p approx ref refs art para ver",
    "de": "nr nrn abb tab abschn kap bd s ca art abs ziff gl",
    "fr": "no nos fig figs tab chap sect env vol p pp art éq réf",
    "es": "núm núms fig figs tab cap aprox sec vol pág págs p pp art ec ref",
    "sk": "č čísl obr tab kap cca str s odst čl ods roč",
    "ru": "рис табл ок гл стр с разд п пп т вып ч № прим",
}
MAY_END = {
    "en": "etc a.m p.m inc ltd co corp jr u.s u.k",
    "de": "usw etc u.ä o.ä u.s.w gmbh",
    "fr": "etc",
    "es": "etc ee.uu",
    "sk": "atď atp pod i.n hod",
    "ru": "г гг т.д т.п др пр руб тыс млн",
}
MONTHS_AFTER_ORDINAL = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"


# Frequent words without a meaning of their own, by which the languages of one script are told apart.
FUNCTION_WORDS = {
    "en": "a the of and to in is that for with which while as on by at from are was be it this an or not whereas when its than has have can does if between under",
    "de": "der die das und ist nicht mit den von zu ein eine einer eines im für auf dem des sich als auch an bei wird werden nach während durch oder wenn dass zwischen unter am zum zur kein",
    "fr": "le la les des et est une du dans que pour qui sur au aux par avec pas ne se sont ou ce cette pendant lorsque entre sous à d l un sans alors selon si",
    "es": "el la los las y en que del para con por una un es se al no su como más mientras cuando entre bajo según si o lo sin esta este",
    "sk": "a v na je s sa z do že pri pre pod ako aj alebo nie od o za po podľa keď medzi ktorý ktorá ktoré bez kým ak zároveň počas so vo",
}


def _set(groups: dict[str, str]) -> frozenset[str]:
    return frozenset(w for words in groups.values() for w in words.split())


def _by_word(groups: dict[str, str]) -> dict[str, frozenset[str]]:
    """For each word the languages that have it."""
    return {w: frozenset(lang for lang, words in groups.items() if w in words.split()) for w in _set(groups)}


ANY, NUMBER, ENDING = _by_word(BEFORE_ANY), _by_word(BEFORE_NUMBER), _by_word(MAY_END)
_TELLS = {w: [lang for lang, words in FUNCTION_WORDS.items() if w in words.split()] for w in _set(FUNCTION_WORDS)}
MONTHS = frozenset(MONTHS_AFTER_ORDINAL.split())

_TERM = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+")
_SPACE = regex.compile(r"\s*")
_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.\-№']+$")
_LINE = regex.compile(r"[^\n\r\x85  ]+")
_BREAK = regex.compile(r"\r\n|[\n\r\x85  ]")
_BULLET = regex.compile(r"[-•*–—‣◦·▪]\s+\S")
_NUMBERED = regex.compile(r"(?:\p{N}{1,3}[.)]|\(\p{N}{1,3}\)|\p{L}\)|\(\p{L}\)|（\p{N}{1,3}）)\s+\S")
_ENDS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…:：;][\p{SB=Close}\s]*$")
#: A sentence begins with a capital, a number, a letter of a script without case, an opening mark, or a name like pH.
_START = regex.compile(r"[\p{Lu}\p{Lt}\p{Lo}\p{N}¿¡]|\p{Ll}{1,2}\p{Lu}|[\p{Ps}\p{Pi}\"„][\p{Lu}\p{Lo}\p{N}¿¡\"“«„]|[«“„(（\[「『]\s?\p{L}")
_GLUED = regex.compile(r"\p{Lu}(?:\p{Ll}|\s)|[¿¡]\p{Lu}|\p{Han}|\p{Hiragana}|\p{Katakana}")
_STRONG = frozenset("。！？｡．।॥")
_TERMS, _CLOSERS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}]+"), regex.compile(r"[”’»›)\]）」』]*")
_FINAL = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]")
_ORDINAL, _WORD = regex.compile(r"\p{N}{1,2}"), regex.compile(r"\p{L}+")
_INITIAL = regex.compile(r"\p{L}\.")
_SPACED_ABBREVIATION = regex.compile(r"(\p{L}\.)[\s\u00a0]?$")
#: In these scripts a full stop is no end of a sentence but of an abbreviation.
_NO_STOP = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Devanagari}\p{Bengali}]")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_CLAUSE = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{N}][)\]\"”’»])\s+(?=([\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])|[(\[“\"«]|\p{Lu}(?:\p{Ll}|\s)|\p{Ll}{1,2}\p{Lu})")
_MARK = regex.compile(r"[\"“”„«»‹›()\[\]（）「」『』【】]")
_PAIRS = {"”": "“", "»": "«", "›": "‹", ")": "(", "]": "[", "）": "（", "」": "「", "』": "『", "】": "【"}
_TERM_INSIDE = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…][\p{SB=Close}]*\s+[\p{Lu}\p{Lo}\p{N}\p{Ps}]|[。！？｡．]|[:;]\s+\p{Ll}")

_NEXT = regex.compile(r"[.!?](?=\s|\p{Lu}|$)")
_ASIDE = regex.compile(r"[(\[（［]\s?\p{Ll}")
_LETTERS = regex.compile(r"(?<![\p{L}\p{N}])\p{L}+(?![\p{L}\p{N}])")
_FIRST_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|\p{Thai}{1,8}|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")
#: The language of a sentence is told by its words before a place, at least so many telling ones, else by so many characters behind it, too.
TELLING, BEHIND = 2, 120


def _votes(text: str, votes: dict[str, int]) -> dict[str, int]:
    for w in _LETTERS.findall(text.lower()):
        for lang in _TELLS.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1
    return votes


def language_at(text: str, start: int, at: int) -> str | None:
    """The language of the sentence from start at a place in it, by its script and function words; None if these don't tell."""
    if at and "\u0400" <= text[at - 1] <= "\u052f":
        return "ru"
    if at and "\u0900" <= text[at - 1] <= "\u097f":
        return "hi"
    before = text[start:at]
    votes = _votes(before[:len(before) - len(before.rsplit(None, 1)[-1])] if before.strip() else "", {})  # without the word itself
    if max(votes.values(), default=0) < TELLING:
        behind = text[at + 1:at + BEHIND]
        end = _NEXT.search(behind)
        votes = _votes(behind[:end.start()] if end else behind, votes)
    best = [*sorted(votes.items(), key=lambda x: -x[1])[:2], ("", 0)]
    return best[0][0] if best[0][1] >= TELLING and best[0][1] > best[1][1] else None


def _suppressed(words: dict[str, frozenset[str]], forms: tuple[str, ...], text: str, start: int, at: int) -> bool:
    """Whether one of the forms is such an abbreviation in the language around it (in any, where that is unknown)."""
    langs = frozenset().union(*(words.get(f, ()) for f in forms))
    if not langs:
        return False
    own = language_at(text, start, at)
    return own is None or own in langs


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The outermost pairs of quotation marks and brackets; marks without a partner count for nothing."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, start, end):
        c, at = m[0], m.start()
        opener = _PAIRS.get(c)
        if c == '"':
            opener = '"' if any(o == '"' for o, _ in stack) else None
        elif c in "“”" and any(o == "„" for o, _ in stack):
            opener = "„"
        elif c == "“":
            opener = None
        elif c == "»" and not any(o == "«" for o, _ in stack):
            opener = None
        elif c == "«" and any(o == "»" for o, _ in stack):
            opener = "»"
        if opener is None:
            if c in _PAIRS and c != "»":
                continue
            stack.append((c, at))
            continue
        k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == opener), None)
        if k is not None:
            found.append((stack[k][1], at))
            del stack[k:]
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _ends_here(text: str, start: int, at: int, after: int, end: int) -> bool:
    """Whether the terminators at..after end the sentence that began at start."""
    nxt = _SPACE.match(text, after, end).end()
    if nxt >= end:
        return True
    mark = text[at:after]
    if mark[-1] in _STRONG:
        return True
    if nxt == after:  # no blank: only a new sentence that clearly begins
        if not _GLUED.match(text, nxt, end):
            return False
    elif not _START.match(text, nxt, end):
        return False
    if mark != ".":
        return True
    begin = max(start, at - 24)
    m = _BEFORE.search(text[begin:at])
    word = m[0] if m else ""
    if word and _NO_STOP.match(word[-1]):
        return False
    if nxt == after and (len(word) < 2 or "/" in text[max(start, at - 40):at].rsplit(" ", 1)[-1]):
        return False
    if word.isdigit() and not text[start:at - len(word)].strip():
        return False  # the number of a heading or an entry
    low = word.lower()
    # abbreviations written with a blank: z. B., p. ex., t. j.
    joined = low
    left = text[max(start, at - 12):m.start()] if m else ""
    two = regex.search(r"(\p{L}\.)[\s ]?$", left)
    if two:
        joined = two[1].lower() + low
    digit = text[nxt].isdigit()
    if _suppressed(ENDING, (low, joined), text, start, at):
        return True
    if _suppressed(ANY, (low, joined), text, start, at):
        return False
    if digit and _suppressed(NUMBER, (low,), text, start, at):
        return False
    if len(word) == 1 and word.isalpha() and (word.isupper() and text[nxt].isupper() or _INITIAL.match(text, nxt, end)):
        return False  # initials, and abbreviations written with blanks
    if _ORDINAL.fullmatch(word):
        following = _WORD.match(text, nxt, nxt + 12)
        if following and following[0] in MONTHS:
            return False
    return True


def _prose(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    pairs = _pairs(text, start, end)
    inside = iter(pairs)
    pair = next(inside, None)
    unit = start
    cuts: list[int] = []
    pos = start
    while (m := _TERM.search(text, pos, end)) is not None:
        at, after = m.start(), m.end()
        while pair and pair[1] < at:
            pair = next(inside, None)
        if pair and pair[0] < at:  # within a pair: only its end may end the sentence around it
            a, b = pair
            inner = text[a + 1:b].rstrip()
            pos = after = b + 1
            pair = next(inside, None)
            if not inner or not _FINAL.match(inner[-1]):
                continue
            if _TERMS.match(text, after, end):
                pos = b + 1
                continue
            nxt = _SPACE.match(text, after, end).end()
            alone = not text[unit:a].strip()
            if text[b] in "）)]】" and not alone and text[a] != '"':
                continue
            if nxt < end and text[b] in "」』）】" and nxt == after and not (alone and text[b] in "）】"):
                continue
            if nxt >= end or (nxt > after and _START.match(text, nxt, end)) or (nxt == after and (_GLUED.match(text, nxt, end) and (alone or text[b] not in "」』"))):
                cuts.append(after)
                unit = after
            continue
        close = _CLOSERS.match(text, after, end).end()
        pos = after
        if _ends_here(text, unit, at, after, end):
            cuts.append(close)
            unit = pos = close
    if _THAI.search(text, start, end):
        for m in _CLAUSE.finditer(text, start, end):
            if not any(a < m.start() < b for a, b in pairs) and text[m.start() - 1] not in "ๆฯ":
                cuts.append(m.start())
        cuts = sorted(set(cuts))
    prev = start
    for c in [*cuts, end]:
        _add(text, prev, c, out)
        prev = c


def _add(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    part = text[start:end]
    left = len(part) - len(part.lstrip())
    part = part.strip()
    if part:
        out.append((start + left, start + left + len(part)))


#: No text is wrapped at fewer columns.
LEAST_WRAP = 40


def _widths(lines: list[str]) -> list[int]:
    """For each line how long a line is there: the longest one without a blank line between, or, where those are
    but two, are short, or none ends a sentence, the longest one of the text."""
    out = [max(map(len, lines), default=0)] * len(lines)
    first = 0
    for k, line in enumerate([*lines, ""]):
        if not line:
            own = lines[first:k]
            if len(own) > 2 and max(map(len, own)) >= LEAST_WRAP and any(_ENDS.search(x[-8:]) for x in own):
                out[first:k] = [max(map(len, own))] * len(own)
            first = k + 1
    return out


def _room(line: str, following: str, width: int) -> bool:
    """Whether the first word of the next line would have fitted into this one: then it was not wrapped here, but ended."""
    word = _FIRST_WORD.match(following)
    last = line.rsplit(None, 1)[-1].lower()
    if last in _TELLS and not line[-1].isdigit():
        return False  # what a function word belongs to must follow
    if _ASIDE.match(following) or line.count("(") > line.count(")"):
        return False  # a remark within a sentence goes on, or is opened here
    return len(line) + 1 + len(word[0] if word else "") <= width


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in code points; none of a null or blank text."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    lines: list[tuple[int, int, str]] = []
    at = 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start(), text[at:m.start()].strip()))
        at = m.end()
    lines.append((at, len(text), text[at:].strip()))
    widths = _widths([line for *_, line in lines])
    region: int | None = None  # where the running prose began
    last = 0
    before = ""  # the line before, with what it was: blank, item, heading, prose
    was = "blank"
    for k, (a, b, line) in enumerate(lines):
        following = lines[k + 1][2] if k + 1 < len(lines) else ""
        fresh = was != "prose" or _ENDS.search(before[-8:]) is not None or _THAI.match(before[-1]) is not None
        if not line:
            kind = "blank"
        elif fresh and (_BULLET.match(line) or _NUMBERED.match(line)):
            kind = "item"
        elif fresh and not _ENDS.search(line[-8:]) and any(map(str.isalpha, line)) and (not following or (_START.match(following) or _BULLET.match(following)) and _room(line, following, widths[k])) and not _TERM_INSIDE.search(line) and not _CLAUSE.search(line):
            kind = "heading"
        elif was == "item" and len(before) >= 40 and not _ENDS.search(before[-8:]) and not _START.match(line):
            kind = "more"
        else:
            kind = "prose"
        if kind != "prose" and region is not None:
            _prose(text, region, last, out)
            region = None
        if kind == "prose":
            region = a if region is None else region
            last = b
        elif kind in ("item", "heading"):
            _add(text, a, b, out)
        elif kind == "more":
            s, _ = out.pop()
            _add(text, s, b, out)
            kind = "item"
        before, was = line, kind
    if region is not None:
        _prose(text, region, last, out)
    return out


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, starts, ends = [], [], []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = units(text)
            ids.extend([doc] * len(found))
            starts.extend(s for s, _ in found)
            ends.extend(e for _, e in found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start_pos, end_pos) of the sentence units of all texts, without any shuffle.

    Null and blank texts have none; a text of any length is read whole; repeated rows give repeated units.
    """
    rows = documents.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text")
    return rows.mapInArrow(_batches, "doc_id long, start_pos int, end_pos int")
