"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, word_spans
from .labelled import held_out, sample

#: Words of a window; words from one window to the next; compression level.
WINDOW, STRIDE, LEVEL = 4, 2, 3
_LETTERS = regex.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


@dataclass
class Distance:
    """The two dictionaries and the calibration of the windows' differences in compressed length.

    Both dictionaries begin with the same segments of ordinary text; the toxic one goes on with segments of toxic text.
    So an ordinary window compresses alike with both, and a window that toxic text is like compresses better with one.
    """

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self._tools = None

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.ordinary, self.toxic, self.weights = state
        self._tools = None

    def lengths(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Compressed length by the ordinary dictionary less that by the toxic one, for each window."""
        if self._tools is None:
            self._tools = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        segments = np.empty((len(starts), 2), "<u8")
        segments[:, 0], segments[:, 1] = starts, ends - starts
        both = []
        for tool in self._tools:
            got = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
            both.append(np.fromiter(map(len, got), np.int64, len(got)))
        return both[0] - both[1]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document the largest differences, the number of large ones and the number of windows.

        Windows are four words with the white space around them, in lower case (A to Z), from every second word on;
        they cover every word.
        """
        n_docs = len(offsets) - 1
        out = np.zeros((n_docs, 8))
        # a space before the first and after the last byte of each document, so that words look alike everywhere
        at = offsets + np.arange(n_docs + 1) * 2
        room = np.full(int(at[-1]), 32, np.uint8)
        where = np.arange(len(data)) + np.repeat(np.arange(n_docs) * 2 + 1, np.diff(offsets))
        room[where] = _LOWER[data]
        starts, ends, words = word_spans(room, at)
        n = np.where(words > WINDOW, (words - WINDOW + STRIDE - 1) // STRIDE + 1, words > 0).astype(np.int64)
        total = int(n.sum())
        if not total:
            return out
        doc = np.repeat(np.arange(n_docs), n)
        k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        first = np.cumsum(words) - words
        a = first[doc] + k * STRIDE
        b = np.minimum(a + WINDOW, first[doc] + words[doc]) - 1
        x = self.lengths(room.tobytes(), starts[a] - 1, ends[b] + 1)
        order = np.lexsort((-x, doc))
        x, rank = x[order], k  # within a document, ranks by falling difference
        for r in (0, 1, 2):
            mine = rank == r
            out[doc[mine], r] = np.clip(x[mine], -2, 12)
        for c, least in enumerate((3, 4, 5, 6)):
            out[:, 3 + c] = np.log1p(np.bincount(doc, x >= least, n_docs))
        out[:, 7] = np.log1p(n)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand(self.features(data, offsets)) @ self.weights, -30, 30)))


def _expand(f: np.ndarray) -> np.ndarray:
    large = np.stack([f[:, 0] >= t for t in (3, 4, 5, 6, 7)], 1)
    rate = f[:, 3:7] - 0.5 * f[:, 7:8]
    return np.concatenate([f, large, rate * (f[:, 3:7] > 0), np.ones((len(f), 1))], 1).astype(float)


def _spread(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies: a group of copies would make each of its words look like a mark of its label."""
    seen: set = set()
    out = []
    for t in texts:
        w = t.lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        marks = [(k, min(xxhash.xxh3_64_intdigest(g, seed=k) for g in grams)) for k in range(4)]
        if not any(m in seen for m in marks):
            out.append(t)
        seen.update(marks)
    return out


def _stems(text: bytes) -> set[bytes]:
    words = set(_LETTERS.findall(text.lower()))
    return {w[:k] for w in words for k in (4, 5, 6)} | {w + b" " for w in words}


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes], size: int = 110_000, toxic_size: int = 4096) -> tuple[bytes, bytes]:
    """The ordinary dictionary, trained on ordinary text by zstandard, and the toxic one.

    Toxic segments are the words of toxic texts that begin with a mark: a beginning that toxic texts hold so much more
    often than ordinary ones that chance would give one in 20,000 at most (Chernoff's bound). The commonest come last,
    where matches cost least.
    """
    share = len(toxic) / (len(toxic) + len(ordinary))
    in_toxic = Counter(s for t in toxic for s in _stems(t))
    in_toxic = {s: n for s, n in in_toxic.items() if n >= 4}
    in_ordinary = Counter(s for t in ordinary for s in _stems(t) if s in in_toxic)

    def marks_toxic(n: int, rest: int) -> bool:
        p = n / (n + rest)
        if p < 1 - (1 - share) / 8:
            return False
        bound = n * math.log(p / share) + (rest * math.log((1 - p) / (1 - share)) if rest else 0.0)
        return bound > math.log(2e4)

    marks = {s for s, n in in_toxic.items() if marks_toxic(n, in_ordinary[s])}
    words = Counter(w for t in toxic for w in set(_LETTERS.findall(t.lower())) if w + b" " in marks or any(w[:k] in marks for k in (4, 5, 6)))
    words.update({s: 1 for s in marks if len(s) > 4 and not s.endswith(b" ")})
    segments = b"".join(b" " + w + b" " for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0])))[-toxic_size:]
    samples = []
    for t in ordinary:
        w = t.lower().split()
        samples += [b" " + b" ".join(w[k : k + 3]) + b" " for k in range(0, len(w), 7)]
    order = np.random.default_rng(5).permutation(len(samples))[:100_000]
    try:
        content = zstandard.train_dictionary(size, [samples[i] for i in order]).as_bytes()[-(size - 160) :]
    except zstandard.ZstdError:  # too few samples to train on
        content = b"".join(samples)[-size:]
    return content, content + segments


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 2000, ordinary: int = 4000, most_chars: int = 30_000) -> Distance | None:
    """Learn from a bounded sample: dictionaries on two thirds of it, the calibration on the rest."""
    texts = sample(docs, labels, "toxic", {0: ordinary, 1: toxic}, most_chars)
    if len(texts[0]) < 3 or len(texts[1]) < 3:
        return None
    good, bad = [t.encode() for t in texts[0]], [t.encode() for t in texts[1]]
    model = Distance(*train_dictionaries(_spread(bad[len(bad) // 3 :]), _spread(good[len(good) // 3 :])))
    rest = bad[: len(bad) // 3] + good[: len(good) // 3]
    y = np.array([1] * (len(bad) // 3) + [0] * (len(good) // 3), float)
    x = _expand(np.concatenate([model.features(d, o) for _, _, d, o in text_chunks(pa.array(rest, pa.binary()))]))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # ridge-penalised logistic regression by Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted): how likely a document is toxic, from its whole text alone.

    Null, empty and blank texts have no windows and take the score of that. Long texts have as many windows as their
    words need. Equal texts score alike; repeated rows stay; a null doc_id is not held out. No rows give no rows;
    without labels of both kinds every score is 0. Neither labels, lang, source nor doc_id is an input, and other
    columns are not looked at.
    """
    model = fit(docs, labels, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                y = model.score(data, offsets) if model else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array(y), pa.array((y >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
