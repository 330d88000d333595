"""Template residue, filler, error pages and notices in place of content.

Two linear classifiers over hashed byte n-grams, trained here by regularised logistic regression: one reads
a text as a whole (with its length and title), the other its windows, for a placeholder within genuine
text. They learn from weak labels on a bounded sample of rows, and decide on every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspan.llm.weak_labels import LABELLER, Labeller

#: The sample: rows that are labelled at most, and unremarkable ones of them that are kept for training.
SAMPLE_ROWS, PLAIN_ROWS = 40_000, 6_000
BITS, ORDERS, WINDOW, STRIDE = 17, (3, 5), 24, 24
#: Texts without a label join the labelled ones above the first of these log-odds, and content below the second, so many times.
JOIN, CONTENT, REFITS = 1.5, -0.5, 2
#: The least and the highest threshold that is taken from the hosts that were kept from training.
LEAST, HIGHEST = 1.0, 3.0
LENGTHS = np.array([8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024], dtype=np.int64)
TITLES = 3  # no title; one that shares no word with the text; one that does
_PRIME, _PRIME2, _MIX = np.uint32(0x01000193), np.uint32(0x01000193**2 & 0xFFFFFFFF), np.uint32(0x9E3779B1)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
EDGE = "\x02"


class Batch:
    """Texts as one folded byte buffer with an edge mark around each, and the hashes of its n-grams."""

    def __init__(self, texts: list[str]) -> None:
        raw = np.frombuffer((EDGE + EDGE.join(texts) + EDGE).encode("utf-8", "replace"), dtype=np.uint8)
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)  # the edge mark before each text
        self.size = sizes + 2  # with both marks
        b = _FOLD[raw]
        two = b[:-1] * _PRIME + b[1:]  # unsigned numbers wrap around
        three = two[:-1] * _PRIME + b[2:]
        self.hashes = [(three * _MIX) >> np.uint32(32 - BITS)]
        if len(b) >= 5:
            five = three[:-2] * _PRIME2 + two[3:]
            self.hashes.append((five * _MIX) >> np.uint32(32 - BITS))
        else:
            self.hashes.append(np.zeros(0, dtype=np.uint32))
        self.bytes = len(b)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each order, running sums of the weights of the n-grams."""
        return [np.concatenate([[0.0], np.cumsum(w[h], dtype=np.float64)]) for w, h in zip(weights, self.hashes)]

    def spans(self, first: np.ndarray, size: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
        """The weight of all n-grams that lie within each span."""
        total = np.zeros(len(first))
        for n, s in zip(ORDERS, sums):
            end = np.minimum(np.maximum(first, first + size - n + 1), len(s) - 1)
            total += s[end] - s[np.minimum(first, len(s) - 1)]
        return total


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, size - 2)


@dataclass
class Model:
    """Weights of both classifiers."""

    whole: np.ndarray
    lengths: np.ndarray
    titles: np.ndarray
    windows: np.ndarray
    bias: float
    #: The log-odds from which a text is residue, chosen on hosts that the model has not seen.
    threshold: float = 0.0

    def whole_scores(self, b: Batch, titles: np.ndarray) -> np.ndarray:
        return b.spans(b.first, b.size, b.sums(self.whole)) / np.sqrt(b.size) + self.lengths[_length_class(b.size)] + self.titles[titles.astype(int)]

    def scores(self, texts: list[str], titles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text as a whole, and of its most suspicious window."""
        if not texts:
            return np.zeros(0), np.zeros(0)
        b = Batch(texts)
        whole = self.whole_scores(b, titles)
        sums = b.sums(self.windows)
        last = np.maximum(b.first, b.first + b.size - WINDOW)  # windows begin from the first byte to here
        every = np.zeros(b.bytes + 1)
        at = np.arange(b.bytes - max(ORDERS))
        if len(at):
            every[: len(at)] = b.spans(at, np.full(len(at), WINDOW), sums)
        bounds = np.empty(2 * len(texts), dtype=np.int64)
        bounds[0::2], bounds[1::2] = b.first, last + 1
        most = np.maximum.reduceat(every, bounds)[0::2]
        short = b.size <= WINDOW
        if short.any():
            most[short] = b.spans(b.first[short], b.size[short], sums)
        return whole, most / np.sqrt(WINDOW) + self.bias


def _fit(hashes: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, dense: list[np.ndarray], classes: list[int], y: np.ndarray, rounds: int, decay: float = 2e-5) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logistic regression with L2 decay by Adam on all examples; hashes: by order (hash, number of each example's), in the order of the examples."""
    dim = 1 << BITS
    w = np.zeros((len(ORDERS), dim))
    d = [np.zeros(c) for c in classes]
    m, v = [np.zeros_like(x) for x in (*w, *d)], [np.zeros_like(x) for x in (*w, *d)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y) / 2
    # examples without any n-gram of an order have no sum of it
    some = [np.flatnonzero(count) for _, count in hashes]
    first = [(np.cumsum(count) - count)[at] for (_, count), at in zip(hashes, some)]
    for t in range(1, rounds + 1):
        z = np.zeros(len(y))
        for k, (h, _) in enumerate(hashes):
            if len(h):
                z[some[k]] += np.add.reduceat(w[k][h], first[k])
        z *= scale
        for x, c in zip(d, dense):
            z += x[c]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grads = [np.bincount(h, weights=np.repeat(g * scale, count), minlength=dim) + decay * w[k] for k, (h, count) in enumerate(hashes)]
        grads += [np.bincount(c, weights=g, minlength=len(x)) + decay * x for x, c in zip(d, dense)]
        for x, q, a, b in zip((*w, *d), grads, m, v):
            a += 0.1 * (q - a)
            b += 0.01 * (q * q - b)
            x -= 0.15 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32), d


def _grams(b: Batch, first: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of each span's) of the n-grams in the spans, by order."""
    out = []
    for n, h in zip(ORDERS, b.hashes):
        count = np.maximum(0, np.minimum(size - n + 1, len(h) - first))
        start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        out.append((h[start + np.arange(count.sum())].astype(np.int32), count))
    return out


def _gram_windows(b: Batch, texts: list[str], labels: np.ndarray, labeller: Labeller) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of content (0) and of placeholders (1) begin."""
    first: list[int] = []
    held: list[int] = []
    for i, text in enumerate(texts):
        at, size = int(b.first[i]), int(b.size[i])
        if labels[i] == 0:
            first += range(at, max(at + 1, at + size - WINDOW + 1), STRIDE)
        elif labels[i] == 2:
            for s, e in labeller.spans(text):
                s, e = (at + 1 + len(text[:x].encode("utf-8", "replace")) for x in (s, e))
                # windows that hold the placeholder, or lie within a long one
                lo, hi = sorted((e - WINDOW, s))
                lo, hi = max(at, lo), min(max(at, at + size - WINDOW), hi)
                held += range(lo, hi + 1, 3)
    return np.array([*first, *held], dtype=np.int64), np.concatenate([np.zeros(len(first)), np.ones(len(held))])


def train(texts: list[str], titles: np.ndarray, labels: np.ndarray, rounds: int = 45, labeller: Labeller = LABELLER) -> Model:
    """A model from texts labelled 0 (no label: mostly content), 1 (no content as a whole) and 2 (with a placeholder).

    Few wordings of a message have a label. So the first fit tells the labelled texts from those only that are content for
    sure, as they share a word with their title; the next ones take in the texts that the fit before was sure of.
    """
    dim = (len(ORDERS), 1 << BITS)
    model = Model(np.zeros(dim, np.float32), np.full(len(LENGTHS) + 1, -1.0), np.zeros(TITLES), np.zeros(dim, np.float32), -1.0)
    b = Batch(texts)
    case, none = labels == 1, labels == 0
    content = none & (titles == 2) if (none & (titles == 2)).any() else none
    kinds = np.zeros_like(titles)  # the title is no feature of the first fit, as it chose the texts
    for again in range(REFITS + 1):
        use = np.flatnonzero(case | content)
        if not case.any() or not content.any():
            break
        model.whole, (model.lengths, model.titles) = _fit(_grams(b, b.first[use], b.size[use]), 1 / np.sqrt(b.size[use]), [_length_class(b.size[use]), kinds[use].astype(int)], [len(LENGTHS) + 1, TITLES], case[use].astype(float), rounds if again == REFITS else rounds // 2)
        z = model.whole_scores(b, kinds)
        case, content = (labels == 1) | (none & (z > JOIN)), none & (z < CONTENT)
        kinds = titles
    labels = np.where(case, 1, np.where(content | (labels == 2), labels, 3))
    windows, truth = _gram_windows(b, texts, labels, labeller)
    if 0 < truth.sum() < len(truth):
        for _ in range(2):  # the second time with the windows of content that the first took for placeholders
            (model.windows, (bias,)) = _fit(_grams(b, windows, np.full(len(windows), WINDOW)), np.full(len(windows), 1 / np.sqrt(WINDOW)), [np.zeros(len(windows), dtype=int)], [1], truth, rounds)
            model.bias = float(bias[0])
            at = np.concatenate([np.arange(b.first[i], max(b.first[i] + 1, b.first[i] + b.size[i] - WINDOW + 1)) for i in np.flatnonzero(labels == 0)])
            hard = at[b.spans(at, np.full(len(at), WINDOW), b.sums(model.windows)) / np.sqrt(WINDOW) + model.bias > -1.0]
            if not len(hard):
                break
            windows, truth = np.concatenate([windows, hard]), np.concatenate([truth, np.zeros(len(hard))])
    return model


#: Words of a text; where there are no blanks, what lies between the syllables of inflection.
_WORD = regex.compile(r"(?:(?!\p{Hiragana})[\p{L}\p{N}]){5,}|[\p{Han}\p{Katakana}ー]{2,}")


def title_class(title: str | None, text: str) -> int:
    """0 without a title, 1 if it shares no longer word with the text, 2 if it shares one."""
    if not title or title.isspace():
        return 0
    return 1 if set(_WORD.findall(title.lower())).isdisjoint(_WORD.findall(text.lower())) else 2


@dataclass
class Sample:
    texts: list[str]
    titles: np.ndarray
    labels: np.ndarray
    hosts: np.ndarray


def labelled_sample(items: DataFrame, rows: int = SAMPLE_ROWS, plain: int = PLAIN_ROWS, key: str = "id", labeller: Labeller = LABELLER) -> Sample:
    """At most `rows` items with a text, chosen by the hash of their key and weakly labelled; of the plain ones about `plain`."""
    total = max(1, items.count())
    pick = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    some = items.where(pick < int(min(1.0, 0.95 * rows / total) * 1_000_000)).where(F.trim("summary") != "").dropDuplicates([key])
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z]+://)?(?:www\.)?([^/?#]+)", 1))
    some = some.select(F.col(key).cast("long").alias("id"), "summary", "title", F.coalesce(F.nullif(host, F.lit("")), F.col(key).cast("string")).alias("host"))
    keep = int(1_000_000 * min(1.0, plain / min(total, rows)))

    def labels(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            y = np.fromiter(map(labeller, texts), dtype=np.int64, count=len(texts))
            # plain rows are thinned, but not those with words of the messages
            thin = (part.column(0).to_numpy() * 2654435761 >> 7) % 1_000_000 < keep
            hard = pc.match_substring_regex(part.column(1), r"(?i)script|cookie|browser|error|denied|placeholder|lorem|template|session|null|40\d|[{}<>$@#_\[\]]").to_numpy(zero_copy_only=False)
            brief = pc.utf8_length(part.column(1)).to_numpy(zero_copy_only=False) < 64
            at = pa.array(np.flatnonzero((y > 0) | thin | hard | brief))
            titles = pa.array([title_class(h, t) for h, t in zip(part.column(2).take(at).to_pylist(), part.column(1).take(at).to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), titles, part.column(3).take(at), pa.array(y).take(at)], ["id", "summary", "title", "host", "label"])

    got = some.mapInArrow(labels, "id long, summary string, title int, host string, label long").toArrow().sort_by("id")
    return Sample(got["summary"].to_pylist(), got["title"].to_numpy(), got["label"].to_numpy(), np.array(got["host"].to_pylist(), dtype=object))


def held_out(hosts: np.ndarray) -> np.ndarray:
    """Whether each host is kept from training: a fifth of them."""
    return np.array([zlib.crc32(h.encode()) % 5 == 0 for h in hosts], dtype=bool)


def _best_threshold(score: np.ndarray, case: np.ndarray) -> float:
    """The middle of the gap between two scores at which precision and recall together are highest."""
    if not case.any():
        return 0.0
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(case[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + case.sum())
    k = int(np.flatnonzero(f1 == f1.max())[-1])
    low = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 1.0
    return float((score[order[k]] + low) / 2)


def fitted(sample: Sample, labeller: Labeller = LABELLER) -> Model:
    """A model trained on most hosts, with its threshold from the others: it best divides the labelled texts there from
    those that are content for sure. These count without their title, which would make them too easy."""
    out = held_out(sample.hosts)
    model = train([t for t, o in zip(sample.texts, out) if not o], sample.titles[~out], sample.labels[~out], labeller=labeller)
    content = (sample.labels == 0) & (sample.titles == 2)
    known = out & ((sample.labels > 0) | (content if (content & out).any() else sample.labels == 0))
    whole, window = model.scores([t for t, o in zip(sample.texts, known) if o], np.minimum(sample.titles[known], 1))
    model.threshold = min(HIGHEST, max(LEAST, _best_threshold(np.maximum(whole, window), sample.labels[known] > 0)))
    return model


def validate(sample: Sample, labeller: Labeller = LABELLER, model: Model | None = None) -> dict[str, float]:
    """Precision and recall, against the weak labels, on hosts that the model has not seen; and the texts found there without a label."""
    out = held_out(sample.hosts)
    model = model or fitted(sample, labeller)
    whole, window = model.scores([t for t, o in zip(sample.texts, out) if o], sample.titles[out])
    said, true = np.maximum(whole, window) > model.threshold, sample.labels[out] > 0
    hit = float((said & true).sum())
    return {"rows": float(out.sum()), "labelled": float(true.sum()), "found": float(said.sum()), "found_without_label": float((said & ~true).sum()), "precision_by_labels": hit / max(1.0, float(said.sum())), "recall_by_labels": hit / max(1.0, float(true.sum())), "threshold": model.threshold}


def residue_flags(model: Model, texts: list[str], titles: list[str | None]) -> np.ndarray:
    """Whether each text, none of them null or blank, is residue or no content: the classifier alone decides.

    A title counts for little, so only texts that some title could bring above the threshold are compared with theirs.
    """
    base = Model(model.whole, model.lengths, np.full(TITLES, model.titles.max()), model.windows, model.bias)
    whole, window = base.scores(texts, np.zeros(len(texts), dtype=int))
    out = np.maximum(whole, window) > model.threshold
    for i in np.flatnonzero(out & (window <= model.threshold)):
        out[i] = whole[i] - model.titles.max() + model.titles[title_class(titles[i], texts[i])] > model.threshold
    return out


def find_residue(items: DataFrame, model: Model | None = None) -> DataFrame:
    """Ids of the items whose summary is residue of a template or no content; each id once.

    Without a model, one is trained on a sample of the items. Empty tables and tables without any case
    in the sample give no rows. Other columns than id, summary, title and url are not read.
    """
    model = model or fitted(labelled_sample(items))

    def flags(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.flatnonzero(residue_flags(model, part.column(1).to_pylist(), part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at))], ["id"])

    rows = items.where(F.trim("summary") != "").select(F.col("id").cast("long").alias("id"), "summary", "title")
    return rows.mapInArrow(flags, "id long").distinct()


def residue_of(model: Model) -> Callable[[list[str], list[str | None]], np.ndarray]:
    """The model's decision on texts with their titles, for use within another pass."""
    return lambda texts, titles: residue_flags(model, texts, titles)
