"""Languages of texts and of the parts of mixed texts, by a byte convolutional network.

The network reads windows of a fixed number of bytes: an embedding of the bytes, filters of several widths, max
pooling over the window and softmax. It is trained here, in numpy, on labelled text. A text is brought to one form first
(look-alike letters, width, case, accents), so that such spellings don't matter. A window lies around every word;
the cheapest path through the languages of the words, with a price for each change, gives the segments.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspan.llm.lookalike import transducer

#: The languages that are told apart; labels of others are never right.
LANGUAGES = ("de", "en", "es", "fr", "hi", "ja", "ru", "sk", "th")
#: Labelled rows that are read for training at most, and windows of each language that are trained on.
SAMPLE_ROWS, WINDOWS = 6_000, 2_500
LENGTH, WIDTHS, FILTERS, EMBEDDING = 48, (2, 3, 4, 5), 32, 12
PAD = 256
#: A segment has so many words at least; a change of language costs so much log probability.
LEAST_WORDS, CHANGE = 4, 7.0
#: A segment beside another has at least so much confidence.
LEAST_CONFIDENCE = 0.92

# Names and codes by which labels call the languages.
NAMES = {
    "de": "deu ger german deutsch allemand alemán nemčina němčina немецкий ドイツ語",
    "en": "eng english englisch anglais inglés angličtina английский 英語",
    "es": "spa spanish español castellano castilian spanisch espagnol španielčina испанский スペイン語",
    "fr": "fra fre french français französisch francés francúzština французский フランス語",
    "hi": "hin hindi हिन्दी हिंदी",
    "ja": "jpn japanese 日本語 japanisch japonais japonés japončina японский",
    "ru": "rus russian русский russisch russe ruso ruština ロシア語",
    "sk": "slk slo slovak slovenčina slovenský slovensky slowakisch slovaque eslovaco словацкий スロバキア語",
    "th": "tha thai ไทย ภาษาไทย",
}
_CODES = {name: code for code, names in NAMES.items() for name in (code, *names.split())}
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]")
_PIECE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]{1,4}|[^\s\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]+")


def language_of(label: str | None) -> str | None:
    """The language that a label names, in any notation (name, region, case, three letters); None if no single known one."""
    if label is None:
        return None
    low = label.strip().lower()
    return _CODES.get(low) or _CODES.get(regex.split(r"[-_ (]", low, maxsplit=1)[0])


def plain(text: str) -> str:
    """A text without what doesn't show its language: case, accents, width, look-alike letters, invisible characters."""
    text = transducer()(text) or ""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c) or c in "゙゚" or "ऀ" <= c <= "ॿ")
    return low


def words_of(text: str) -> list[tuple[int, int]]:
    """Where the words of a plain text lie; texts without blanks are taken in pieces."""
    return [m.span() for m in _PIECE.finditer(text) if any(c.isalpha() for c in m[0])]


def window_starts(text: str, words: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text, padded behind its end, and where the window around the middle of each word begins."""
    raw = text.encode("utf-8", "replace")
    if len(raw) == len(text):
        middle = np.array([(a + b) // 2 for a, b in words], dtype=np.int64)
    else:
        offsets = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum([len(c.encode("utf-8", "replace")) for c in text], out=offsets[1:])
        middle = np.array([(offsets[a] + offsets[b]) // 2 for a, b in words], dtype=np.int64)
    data = np.full(len(raw) + LENGTH, PAD, dtype=np.int16)
    data[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    # windows stay within the text as far as it goes
    return data, np.clip(middle - LENGTH // 2, 0, max(0, len(raw) - LENGTH))


def windows(text: str, words: list[tuple[int, int]]) -> np.ndarray:
    """A window of bytes around the middle of each word, padded at the text's end."""
    data, start = window_starts(text, words)
    return data[start[:, None] + np.arange(LENGTH)]


@dataclass
class ByteNetwork:
    """Embedding, filters by width, and the softmax layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, classes: int, seed: int = 7) -> "ByteNetwork":
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.3, (PAD + 1, EMBEDDING))
        filters = [rng.normal(0, (2.0 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
        return cls(embedding, filters, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), np.zeros(classes))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled activations, and where each maximum lies."""
        parts, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            # a filter on embedded bytes is a table by byte for each place of the filter
            out = sum((self.embedding @ f[j]).astype(np.float32)[x[:, j:x.shape[1] - w + 1 + j]] for j in range(w)) + b.astype(np.float32)
            at = out.argmax(axis=1)
            parts.append(np.maximum(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :], 0))
            places.append(at)
        return np.concatenate(parts, axis=1), places

    def log_probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        out = []
        for i in range(0, len(x), batch):
            z = self._pooled(x[i:i + batch])[0] @ self.weights + self.bias
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)))

    def tables(self) -> list[np.ndarray]:
        """For each width, what each byte adds at each place of a filter."""
        return [np.stack([(self.embedding @ f[j]).astype(np.float32) for j in range(w)]) for w, f in zip(WIDTHS, self.filters)]

    def along(self, data: np.ndarray, starts: np.ndarray, tables: list[np.ndarray] | None = None, block: int = 1 << 14) -> np.ndarray:
        """Log probabilities of the windows of a long line of bytes that begin at these rising places.

        Windows overlap, so filters are applied once at each byte, in blocks of bounded size, and a running maximum over the
        length of a window pools them.
        """
        tables = tables or self.tables()
        pooled = np.zeros((len(starts), FILTERS * len(WIDTHS)), dtype=np.float32)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + block, block))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo == hi:
                continue
            x = data[k * block:(k + 1) * block + LENGTH]
            at = starts[lo:hi] - k * block
            for i, (w, table, b) in enumerate(zip(WIDTHS, tables, self.biases)):
                n = len(x) - w + 1
                most = table[0][x[:n]]
                for j in range(1, w):
                    most += table[j][x[j:n + j]]
                span, need = 1, LENGTH - w + 1
                while 2 * span <= need:  # the maximum over twice as many places, by two that adjoin
                    most = np.maximum(most[:-span], most[span:])
                    span *= 2
                best = np.maximum(most[at], most[at + need - span]) + b.astype(np.float32)
                pooled[lo:hi, i * FILTERS:(i + 1) * FILTERS] = np.maximum(best, 0)
        z = pooled @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the cross entropy on a batch."""
        hidden, places = self._pooled(x)
        z = hidden @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        gh = (p @ self.weights.T) * (hidden > 0)
        grads: list[np.ndarray] = []
        ge = np.zeros_like(self.embedding)
        biases = []
        for k, (w, f, at) in enumerate(zip(WIDTHS, self.filters, places)):
            g = gh[:, k * FILTERS:(k + 1) * FILTERS]
            gf = np.zeros_like(f)
            for j in range(w):
                byte = np.take_along_axis(x, at + j, axis=1)
                # the gradient of each place's table, from the bytes under the maxima
                flat = np.bincount((byte.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), weights=g.ravel(), minlength=(PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
                gf[j] = self.embedding.T @ flat
                ge += flat @ f[j].T
            grads.append(gf)
            biases.append(g.sum(axis=0))
        return [ge, *grads, *biases, hidden.T @ p, p.sum(axis=0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights, self.bias]


def train(x: np.ndarray, y: np.ndarray, texts: np.ndarray | None = None, classes: int = len(LANGUAGES), epochs: int = 6, batch: int = 128, seed: int = 7) -> ByteNetwork:
    """A network trained by Adam on labelled windows of texts (a number for each window; without, each is a text of its own).

    Labels are noisy, and the wrong ones of a frequent language can be many among the windows of a rare one; texts in two languages have one label. So
    twice, after a third and two thirds of the epochs, the windows of a text are judged together, and texts that the network takes for another language than
    their label says are left out of the following epochs, and so are single windows of the others.
    """
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(classes, seed)
    if not len(y):
        return net
    texts = np.arange(len(y)) if texts is None else texts
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    use, t = np.arange(len(y)), 0
    for epoch in range(epochs):
        if epoch and epoch in (epochs // 3, 2 * epochs // 3):
            logs = net.log_probabilities(x)
            sums = np.zeros((int(texts.max()) + 1, classes))
            np.add.at(sums, texts, logs)
            right = np.flatnonzero((sums.argmax(axis=1)[texts] == y) & (logs.argmax(axis=1) == y))
            use = right if len(right) else np.arange(len(y))
        rng.shuffle(use)
        for i in range(0, len(use), batch):
            at = use[i:i + batch]
            t += 1
            for p, g, a, b in zip(params, net.step(x[at], y[at]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def segments(net: ByteNetwork, text: str | None) -> list[tuple[int, int, str, float]]:
    """The segments of one text; see `segments_of`."""
    return segments_of(net, [text])[0]


def segments_of(net: ByteNetwork, texts: list[str | None], tables: list[np.ndarray] | None = None) -> list[list[tuple[int, int, str, float]]]:
    """For each text (first, last + 1, language, confidence) of its segments; none of a null or blank one.

    Positions are those of words. Without any letter, a text is one segment of the likeliest language. All texts go through the network at once.
    """
    datas, starts, sizes, at = [], [], [], 0
    for text in texts:
        if text is None or not text.strip():
            sizes.append(0)
            continue
        low = plain(text)
        words = words_of(low)
        if not words:
            low, words = low or " ", [(0, max(1, len(low)))]
        data, start = window_starts(low, words)
        datas.append(data)
        starts.append(start + at)
        sizes.append(len(words))
        at += len(data)
    logs = net.along(np.concatenate(datas), np.concatenate(starts), tables) if datas else np.zeros((0, len(LANGUAGES)))
    ends = np.cumsum(sizes)
    return [_segments(logs[e - n:e]) if n else [] for n, e in zip(sizes, ends.tolist())]


def _path(logs: np.ndarray) -> np.ndarray:
    """The cheapest path through the languages of the words, with a price for each change."""
    path = logs.argmax(axis=1)
    if (path == path[0]).all():  # no path can be cheaper
        return path
    n, c = logs.shape
    best = logs[0].copy()
    back = np.zeros((n, c), dtype=np.int64)
    every = np.arange(c)
    for i in range(1, n):
        other = int(best.argmax())
        change = best[other] - CHANGE
        stay = best >= change
        back[i] = np.where(stay, every, other)
        best = np.where(stay, best, change) + logs[i]
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def _segments(logs: np.ndarray) -> list[tuple[int, int, str, float]]:
    path = _path(logs)
    runs = _runs(path)
    while len(runs) > 1:  # too short or unsure for a segment: part of the neighbour that fits it better
        sizes = [b - a for a, b in runs]
        sure = [_confidence(logs[a:b], path[a]) for a, b in runs]
        k = int(np.argmin(sizes))
        if sizes[k] >= LEAST_WORDS:
            k = int(np.argmin(sure))
            if sure[k] >= LEAST_CONFIDENCE:
                break
        a, b = runs[k]
        sides = [path[runs[j][0]] for j in (k - 1, k + 1) if 0 <= j < len(runs)]
        path[a:b] = max(sides, key=lambda s: logs[a:b, s].sum())
        runs = _runs(path)
    return [(a, b, LANGUAGES[path[a]], _confidence(logs[a:b], path[a])) for a, b in runs]


def _confidence(logs: np.ndarray, language: int) -> float:
    """The share of a language in the mean of the windows' log probabilities."""
    mean = logs.mean(axis=0)
    return float(np.exp(mean[language]) / np.exp(mean).sum())


def _runs(path: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return list(zip(cuts, cuts[1:]))


def labelled_windows(texts: list[str], labels: list[str], per_language: int = WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of labelled texts, as many of each language as there are up to a number; their labels, and the text of each."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[int]] = {}
    for i, (text, label) in enumerate(zip(texts, labels)):
        if label in LANGUAGES and text and text.strip():
            by.setdefault(label, []).append(i)
    xs, ys, of = [np.zeros((0, LENGTH), dtype=np.int16)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for label in sorted(by):
        some = by[label]
        each = max(2, -(-per_language // len(some)))
        got, own = [], []
        for i in some:
            low = plain(texts[i])
            words = words_of(low)
            if words:
                pick = sorted(rng.choice(len(words), size=min(each, len(words)), replace=False).tolist())
                got.append(windows(low, [words[k] for k in pick]))
                own += [i] * len(pick)
        if got:
            some_of = rng.permutation(len(own))[:per_language]
            xs.append(np.concatenate(got)[some_of])
            ys.append(np.full(len(some_of), LANGUAGES.index(label)))
            of.append(np.array(own)[some_of])
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(of)


def labelled_sample(df: DataFrame, key: str, text: str, label: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most so many texts with a label that names a known language: those whose keys have the lowest hashes."""
    named = df.select(F.col(key).alias("k"), F.col(text).alias("t"), label.alias("l")).where("l IS NOT NULL AND trim(t) <> ''").withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1_000_000)))
    total = max(1, named.count())
    # somewhat more by a threshold, so that only few rows are ordered
    got = named.where(F.col("h") <= int(min(1.0, 1.2 * rows / total) * 1_000_000)).orderBy("h", "k").limit(rows).toArrow()
    return got["t"].to_pylist(), [language_of(x) or "" for x in got["l"].to_pylist()]


def held_out(texts: list[str]) -> np.ndarray:
    """Whether each text is kept from training: a fifth of the different texts, equal ones (in their plain form) alike."""
    return np.array([zlib.crc32(" ".join(plain(t).split()).encode("utf-8", "replace")) % 5 == 0 for t in texts], dtype=bool)


def validate(texts: list[str], labels: list[str]) -> list[tuple[str, str, int, int]]:
    """(measure, language, cases, right) on texts that were held out of training, by the language that most of their windows and labels agree on.

    windows: single windows; texts: whole texts, which must be one segment of their label; mixed: two texts of
    different languages in a row, which must be two segments of these languages.
    """
    out = held_out(texts)
    net = train(*labelled_windows([t for t, o in zip(texts, out) if not o], [x for x, o in zip(labels, out) if not o]))
    kept = [(t, x) for t, x, o in zip(texts, labels, out) if o and x in LANGUAGES and t and t.strip()]
    rows = []
    x, y, _ = labelled_windows([t for t, _ in kept], [x for _, x in kept])
    right = net.log_probabilities(x).argmax(axis=1) == y if len(y) else np.zeros(0, bool)
    rows += [("windows", lang, int((y == i).sum()), int(right[y == i].sum())) for i, lang in enumerate(LANGUAGES)]
    found = [[s[2] for s in own] for own in segments_of(net, [t for t, _ in kept])]
    rows += [("texts", lang, sum(x == lang for _, x in kept), sum(x == lang and f == [lang] for (_, x), f in zip(kept, found))) for lang in LANGUAGES]
    # texts whose label the network bears out, long enough for a segment, each joined to the next of another language
    sure = [(t, x) for (t, x), f in zip(kept, found) if f == [x] and LEAST_WORDS <= len(words_of(plain(t))) <= 60]
    pairs = [(a, b) for a, b in zip(sure, sure[1:]) if a[1] != b[1]]
    mixed = [[s[2] for s in own] for own in segments_of(net, [f"{a[0]} {b[0]}" for a, b in pairs])]
    rows += [("mixed", lang, sum(a[1] == lang for a, _ in pairs), sum(a[1] == lang and f == [a[1], b[1]] for (a, b), f in zip(pairs, mixed))) for lang in LANGUAGES]
    return rows


def text_segments(df: DataFrame, net: ByteNetwork, key: str, text: str, label: Column | None = None) -> DataFrame:
    """Rows (key, segment_no, segments, lang, confidence, labelled) of every segment of every text.

    labelled is the language that the row's label names, or null. Null and blank texts have no
    segments; a text of any length is read whole; repeated rows give repeated segments.
    """
    kind = dict(df.dtypes)[key]
    named = (label if label is not None else F.lit(None)).cast("string")

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for part in parts:
            at, no, of, lang, sure, labelled = [], [], [], [], [], []
            texts = part.column(1).to_pylist()
            each = [own for i in range(0, len(texts), 1000) for own in segments_of(net, texts[i:i + 1000], tables)]
            for i, (own, l) in enumerate(zip(each, part.column(2).to_pylist())):
                for k, (_, _, code, c) in enumerate(own, 1):
                    at.append(i)
                    no.append(k)
                    of.append(len(own))
                    lang.append(code)
                    sure.append(c)
                    labelled.append(language_of(l))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(labelled, pa.string())], ["key", "segment_no", "segments", "lang", "confidence", "labelled"])

    return df.select(F.col(key), F.col(text), named).mapInArrow(found, f"key {kind}, segment_no int, segments int, lang string, confidence double, labelled string")
