"""Texts that lost their end to a length limit or a broken transfer.

For each source, histograms of the lengths (in characters and in bytes) of texts without terminal
punctuation show a limit as a spike at the maximum: far more texts than at the lengths around it, and
hardly any beyond. Texts of such a length are cut. So are texts with a mark of cutting or a broken character at
their end. A text without all this is cut if it doesn't end as sentences of the corpus do: every two
neighbouring words are counted where they close a sentence and where they stand inside one, and an ending
that closes too small a share of its occurrences is none.

One pass over the texts, without a shuffle, gives both the texts without a proper end, as narrow rows without the text,
and the endings, summed by part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan.llm.sentences import ANY, NUMBER
from quarryspan.session import cut

#: A spike has at least so many texts, and so many times the mean of the lengths around it; within REACH.
LEAST, TIMES, REACH, NEAR = 6, 5.0, 12, 4
#: ... and so large a share of the source's highest one.
SHARE = 0.1
#: An ending has to close so large a share of all its occurrences, which doesn't change with the size of the corpus.
CLOSING = 0.15
#: So many repeated keys at most are sent to every executor (16 bytes each).
SENT = 1_000_000
#: Counts held by a task before they are passed on.
HELD = 200_000
CLOSERS = "\"”“»’)]）」』"
TERMINAL = frozenset(".!?。！？।॥؟｡")
_BROKEN_END = re.compile(r"(?:�|&[A-Za-z#0-9]{0,8}|[-–—,:;(\[{«„/])$")
_INNER = re.compile(r"[.!?]+[\"”“»)\]]*\s+(?=[^\W_]|[¿¡«„“\"(\[])|[。！？]")
_QUOTES = str.maketrans("", "", "\"”“„»«’()[]")
_DIGIT = re.compile(r"\d")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_ABBREVIATIONS = ANY.keys() | NUMBER.keys()


def source_of(provider: Column) -> Column:
    """A source's name apart from case and blanks; empty if it has none."""
    return F.coalesce(F.lower(F.trim(provider)), F.lit(""))


def _unspaced(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _silent(c: str) -> bool:
    """A letter of a script whose sentences have no end marks."""
    return "฀" <= c <= "໿" or "က" <= c <= "႟" or "ក" <= c <= "៿"


def ending_of(text: str) -> str:
    """The last two words, folded (in scripts without blanks the last three characters)."""
    if text and _unspaced(text[-1]):
        return text[-3:]
    words = text[-90:].translate(_QUOTES).lower().split()[-2:]
    return " ".join("#" if _DIGIT.search(w) else w for w in words)


def profile(text: str) -> tuple[bool, bool, bool, bool, str]:
    """(stop, marked, broken, open, ending) of a text that is not blank."""
    end = text.rstrip()
    bare = end.rstrip(CLOSERS + " ")
    last = bare[-1] if bare else end[-1]
    marked = bare.endswith(("..", "…", "[…"))
    broken = _BROKEN_END.search(end[-10:]) is not None
    stop = last in TERMINAL and not marked
    if stop and last == ".":
        word = bare[bare.rfind(" ") + 1:-1].lstrip("(\"[„«“").lower()
        stop = not (word in _ABBREVIATIONS or len(word) == 1 and word.isalpha())
    core = bare.rstrip("".join(TERMINAL)) if last in TERMINAL else bare
    listed = ";" in text and not any(c in TERMINAL and (i + 1 == len(text) or text[i + 1].isspace()) for i, c in enumerate(text) if c in TERMINAL)
    return stop, marked, broken, listed or bool(core) and _silent(core[-1]), ending_of(core)


def inner_endings(text: str) -> list[str]:
    """The endings of sentences that another sentence follows."""
    out = []
    for m in _INNER.finditer(text):
        mark = m[0][0]
        if mark in "。！？":
            if m.start() >= 3:
                out.append(text[m.start() - 3:m.start()])
            continue
        c = text[m.end()] if m.end() < len(text) else ""
        if c.isupper() or c.isdigit() or c in "¿¡«„“\"([":
            out.append(ending_of(text[max(0, m.start() - 90):m.start()]))
    return out


def _folded(text: str) -> list[str]:
    """The words of a text in lower case, without quotation marks and brackets; those with a digit are all the same."""
    if text.isascii():
        for c in "\"()[]":
            if c in text:
                text = text.replace(c, "")
    else:
        text = text.translate(_QUOTES)
    return [w if w.isalpha() or not _DIGIT.search(w) else "#" for w in text.lower().split()]


def inside_endings(text: str) -> list[str]:
    """What would be the ending of the text were it cut behind any of its words but the last, as far as no sentence ends there."""
    words = _folded(text)
    if text.isascii():
        return [f"{a} {b}" if b[-1] not in ",;:" else f"{a} {c}" for a, b in zip(words, words[1:-1]) if b[-1] not in ".!?" and (c := b.rstrip(",;:"))]
    out = [f"{a} {b}" for a, b in zip(words, [w.rstrip(",;:") for w in words[1:-1]]) if b and b[-1] not in TERMINAL and not _unspaced(b[-1])]
    if _UNSPACED.search(text):
        out += [text[i - 3:i] for i in range(3, len(text)) if _unspaced(text[i - 1]) and text[i] not in TERMINAL]
    return out


SCAN = "kind int, id long, source string, marked boolean, open boolean, ending string, chars int, bytes int, closes double, inside double"
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in SCAN.split(", ")]


def _scan(parts: Iterator[pa.RecordBatch], left_out: Callable[[list[str], list[str | None]], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Narrow rows of texts without a proper end (kind 0), and counts of endings summed by part (kind 1).

    Columns: id, source, text, title, and how often the id occurs: each occurrence has that share of the counts.
    """
    closes: Counter[str] = Counter()
    inside: Counter[str] = Counter()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)

    def counts() -> pa.RecordBatch:
        rows = [(1, None, None, None, None, e, None, None, float(closes[e]), float(inside[e])) for e in closes.keys() | inside.keys()]
        closes.clear()
        inside.clear()
        return batch(rows)

    for part in parts:
        rows: list[tuple] = []
        texts: list[str] = []
        titles: list[str | None] = []
        for i, s, t, h, n in zip(*(c.to_pylist() for c in part.columns)):
            if not t or t.isspace():
                continue
            stop, marked, broken, is_open, ending = profile(t)
            ends = inner_endings(t)
            if stop and not is_open:
                ends.append(ending)
            if n == 1:
                closes.update(ends)
                inside.update(inside_endings(t))
            else:
                for total, found in ((closes, ends), (inside, inside_endings(t))):
                    for e in found:
                        total[e] += 1.0 / n
            if not stop:
                rows.append((0, i, s, marked or broken, is_open, ending, len(t), len(t.encode("utf-8", "replace")), 0.0, 0.0))
                texts.append(t)
                titles.append(h)
        if rows and left_out is not None:
            out = left_out(texts, titles)
            rows = [r for r, o in zip(rows, out) if not o]
        yield batch(rows)
        if len(inside) > HELD:
            yield counts()
    yield counts()


def repeated(items: DataFrame, key: str = "id") -> DataFrame:
    """(id, times) of the keys that occur more than once: from the key alone, so no text is shuffled for it."""
    return cut(items.groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("times")).where("times > 1"))


def length_spikes(rows: DataFrame, least: int = LEAST, times: float = TIMES) -> DataFrame:
    """Rows (source, unit, size, texts): lengths where a source cuts, from texts without terminal punctuation."""
    sizes = rows.where("source <> ''").select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("u"))
    counts = sizes.groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("texts"))
    by = Window.partitionBy("source", "unit").orderBy("size")
    around = F.coalesce(F.sum("texts").over(by.rangeBetween(-REACH, -2)), F.lit(0)) + F.coalesce(F.sum("texts").over(by.rangeBetween(2, REACH)), F.lit(0))
    near, beyond = F.sum("texts").over(by.rangeBetween(-NEAR, NEAR)), F.coalesce(F.sum("texts").over(by.rangeBetween(NEAR + 1, Window.unboundedFollowing)), F.lit(0))
    peak = F.max("texts").over(by.rangeBetween(-NEAR, NEAR))
    # next to a spike lies a lesser one, of texts whose last blank was dropped: it needn't stand out from that
    usual = F.greatest(F.lit(1.0), (F.col("around") - F.when(F.col("peak") > F.col("texts"), F.col("peak")).otherwise(0)) / (2.0 * (REACH - 1)))
    highest = F.max("texts").over(Window.partitionBy("source"))
    found = counts.withColumn("around", around).withColumn("near", near).withColumn("beyond", beyond).withColumn("peak", peak).withColumn("highest", highest)
    return found.where((F.col("texts") >= least) & (F.col("texts") >= SHARE * F.col("highest")) & (F.col("texts") >= times * usual) & (F.col("beyond") <= 0.5 * F.col("near"))).select("source", "unit", "size", "texts")


def cut_texts(items: DataFrame, text: str = "summary", source: str = "provider", key: str = "id", title: str | None = None, left_out: Callable[[list[str], list[str | None]], np.ndarray] | None = None) -> DataFrame:
    """Rows (id, source, rule) of the items whose text was cut, each id once; rule: limit, mark or ending, the first that tells it.

    Null and blank texts are never cut. Lists of keywords, and scripts whose sentences have no end marks, are
    cut only by their length, a mark or a broken character. A source without a name has the spikes of all
    others. left_out tells of texts, with their titles, which are no cases; they are asked for in the same pass. Repeated rows count
    once everywhere. An empty table gives no rows.
    """
    rows = items.select(F.col(key).cast("long").alias("id"), source_of(F.col(source)).alias("source"), F.col(text).alias("text"), (F.lit(None) if title is None else F.col(title)).cast("string").alias("title"))
    again = repeated(items, key)
    # the texts stay where they are unless more keys are repeated than can be sent to every executor
    again = F.broadcast(again) if again.count() <= SENT else again
    rows = rows.join(again, "id", "left").select("id", "source", "text", "title", F.coalesce("times", F.lit(1)).alias("times"))
    scan = cut(rows.mapInArrow(lambda parts: _scan(parts, left_out), SCAN))
    ends = scan.where("kind = 1").groupBy("ending").agg(F.round(F.sum("closes"), 6).alias("closes"), F.round(F.sum("inside"), 6).alias("inside")).where((F.col("closes") > 0) & (F.col("closes") >= CLOSING * (F.col("closes") + F.col("inside")))).select("ending", F.lit(True).alias("ends"))
    rows = scan.where("kind = 0").dropDuplicates(["id"]).drop("kind", "closes", "inside")
    spikes = length_spikes(rows)

    # a few lengths for each source: one row a source, and one for sources without a name
    def sizes(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("size"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("size"))).alias("byte_limits"))

    limits = sizes(spikes, "source").unionByName(sizes(spikes).withColumn("source", F.lit("")))
    at_limit = F.coalesce(F.array_contains("char_limits", F.col("chars")) | F.array_contains("byte_limits", F.col("bytes")), F.lit(False))
    rows = rows.join(limits, "source", "left").withColumn("rule", F.when(at_limit, "limit").when(F.col("marked"), "mark"))
    told = rows.where("rule IS NOT NULL").select("id", "source", "rule")
    # what neither a limit nor a mark tells is asked for its ending
    rest = rows.where("rule IS NULL AND NOT open").join(ends, "ending", "left_anti").select("id", "source", F.lit("ending").alias("rule"))
    return told.unionByName(rest)
