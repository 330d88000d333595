"""Texts that look the same but differ in their characters.

A transducer over grapheme clusters (a base character with its combining marks) takes the longest
cluster at each place and puts its one consistent form: plain width, plain blank, plain hyphen,
no invisible characters, composed accents, and for look-alike letters of other scripts the Latin one.
Case, missing accents and raised or lowered digits stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryspan.session import cut

# Letters that look like Latin ones, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"))
OTHER = {"ꓮ": "A", "ꓐ": "B", "ꓓ": "D", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ı": "ı", "ɡ": "g", "ɑ": "a"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}
HYPHENS = "\u2010\u2011\ufe63\uff0d\u02d7\u2212"
BLANKS = "\t\n\x0b\x0c\r\x85\u2028\u2029"
#: Drawn as nothing, besides the characters of category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
MARKS = r"\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f\uff9e\uff9f"


def _width(c: str) -> str:
    """The character in plain width, where only its width is special."""
    kind = unicodedata.decomposition(c).split(" ")
    return "".join(chr(int(x, 16)) for x in kind[1:]) if kind[0] in ("<wide>", "<narrow>") else c


def rules() -> dict[str, str]:
    """Every character that has another form, with that form; a conflict of two rules is an error."""
    table: dict[str, str] = {}

    def put(c: str, to: str) -> None:
        if c != to and table.setdefault(c, to) != to:
            raise ValueError(f"two forms for {c!r}: {table[c]!r} and {to!r}")

    for c in HYPHENS:
        put(c, "-")
    for c in BLANKS:
        put(c, " ")
    for c in INVISIBLE:
        put(c, "")
    for letters in (CYRILLIC, GREEK, OTHER, LIGATURES):
        for c, to in letters.items():
            put(c, to)
    for i in (*range(0x80, 0x3400), *range(0xD7B0, 0xD800), *range(0xF900, 0x10000), *range(0xE0000, 0xE0200)):
        c, kind = chr(i), unicodedata.category(chr(i))
        if kind == "Cf" or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF:
            put(c, "")
        elif kind == "Zs":
            put(c, " ")
        elif c not in table and _width(c) != c:
            put(c, _width(c))
    for c, to in list(table.items()):  # a form is final: what it is made of has no other form
        while any(x in table for x in to):
            to = "".join(table.get(x, x) for x in to)
        table[c] = to
    return table


class Transducer:
    """The compiled rules; known clusters are looked up, a new one is derived once."""

    def __init__(self) -> None:
        self.table = rules()
        self.known: dict[str, str] = {}
        silent = "".join(re.escape(c) for c, to in self.table.items() if to == "")
        # invisible characters may stand between a letter and its marks
        self.cluster = re.compile(rf"[\t\n\x0b\x0c\r]|[^\x00-\x7f][{MARKS}{silent}]*|[\x00-\x7f][{MARKS}{silent}]+")

    def _derive(self, cluster: str) -> str:
        plain = "".join(self.table.get(c, c) for c in cluster)
        parts = "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", plain))
        return unicodedata.normalize("NFC", parts)

    def _form(self, m: re.Match) -> str:
        cluster = m[0]
        form = self.known.get(cluster)
        if form is None:
            if len(self.known) > 100_000:
                self.known.clear()
            form = self.known[cluster] = self._derive(cluster)
        return form

    def __call__(self, text: str | None) -> str | None:
        """The consistent form of a text, without blanks around it; null stays null."""
        if text is None:
            return None
        if text.isascii() and text.isprintable():
            return text.strip(" ")
        return self.cluster.sub(self._form, text).strip(" ")


_transducer: list[Transducer] = []


def transducer() -> Transducer:
    """The transducer of this process, compiled once."""
    if not _transducer:
        _transducer.append(Transducer())
    return _transducer[0]


@F.pandas_udf(T.StringType())
def _consistent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    form = transducer()
    for part in parts:
        yield part.map(form, na_action="ignore")


def consistent(text: Column) -> Column:
    """One consistent form of a text: equal for texts that look the same. Plain ASCII needs no Python."""
    return F.when(text.rlike(r"[^\x20-\x7e]"), _consistent(text)).otherwise(F.trim(text))


#: So many texts at most are sent to every executor by their hashes (8 bytes each); more take a shuffled join.
SENT = 2_000_000


def same_looking(df: DataFrame, scope: list[str], key: str, text: str) -> DataFrame:
    """Rows (scope.., k, form, t), each once, of the texts whose form belongs to several different texts of one scope.

    A narrow table of hashes tells which texts these are; only they are read as a whole again. Null and blank texts, and null scopes, are none.
    """
    rows = df.select(*scope, F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    for c in scope:
        rows = rows.where(F.col(c).isNotNull())
    own = F.xxhash64(*scope, "t")
    hashes = cut(rows.select(*scope, "t", consistent(F.col("t")).alias("form")).where("form <> ''").select(F.xxhash64(*scope, "form").alias("form"), own.alias("own")))
    several = hashes.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("form")
    # forms of several texts are few among all
    wanted = cut(hashes.join(several, "form", "left_semi").select("own").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    found = rows.withColumn("own", own).join(wanted, "own", "left_semi").select(*scope, "k", consistent(F.col("t")).alias("form"), "t")
    return cut(found.where("form <> ''").distinct())


def same_looking_pairs(df: DataFrame, scope: list[str], key: str, text: str) -> DataFrame:
    """Pairs (scope.., a, b; a < b) of rows of one scope whose texts look the same but differ.

    Repeated rows of one key count once. Null and blank texts are in no pair. Different texts are paired first, each once, and
    their rows are added to the pairs: the work grows with the rows and the result, however often one text recurs.
    """
    rows = same_looking(df, scope, key, text)
    by = [*scope, "form"]
    texts = rows.select(*by, "t").distinct()
    pairs = texts.join(texts.withColumnRenamed("t", "u"), by).where("t < u")
    left = pairs.join(rows.withColumnRenamed("k", "a"), [*by, "t"])
    both = left.join(rows.select(*by, F.col("t").alias("u"), F.col("k").alias("b")), [*by, "u"]).where("a <> b")
    return both.select(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def same_looking_classes(df: DataFrame, scope: list[str], key: str, text: str) -> DataFrame:
    """Rows (scope.., key, form, first_key, texts): the members of each class of texts that look the same but differ, a row for each key and text.

    first_key is the smallest key of the class, texts the number of its different texts: as large as the rows, where pairs can be many more.
    """
    rows = same_looking(df, scope, key, text)
    by = [*scope, "form"]
    classes = rows.groupBy(*by, "t").agg(F.min("k").alias("k")).groupBy(*by).agg(F.min("k").alias("first_key"), F.count("*").alias("texts")).where("texts > 1")
    return rows.join(classes, by).select(*scope, F.col("k").alias(key), "form", "first_key", "texts").distinct()
