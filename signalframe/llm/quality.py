"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, released, span_hashes, text_chunks, word_spans
from .labelled import held_out, sample

#: Words of a passage.
PASSAGE = 32
#: Byte shares of a passage, then its word statistics.
WIDTH = 256 + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage of every document in the buffer, and each document's number of passages.

    A document is cut after every 32 words; one without words is one passage of whatever bytes it has.
    """
    released()
    starts, ends, words = word_spans(data, offsets)
    n = np.maximum(1, (words + PASSAGE - 1) // PASSAGE)
    first = np.cumsum(n) - n
    total = int(n.sum())
    doc_of_word = np.repeat(np.arange(len(n)), words)
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    of_word = first[doc_of_word] + rank // PASSAGE
    # bytes belong to the passage of the word that starts last before them
    jump = np.zeros(len(data) + 1, np.int64)
    heads = rank % PASSAGE == 0
    heads &= rank > 0
    jump[starts[heads]] = 1
    doc_of_byte = np.repeat(np.arange(len(n)), np.diff(offsets))
    step = np.cumsum(jump[:-1])
    base = np.concatenate([[0], step])[offsets[:-1]] if len(data) else np.zeros(len(n), np.int64)
    of_byte = first[doc_of_byte] + (step - base[doc_of_byte]) if len(data) else np.zeros(0, np.int64)
    out = np.zeros((total, WIDTH), np.float32)
    size = np.bincount(of_byte, minlength=total)
    out[:, :256] = np.sqrt(np.bincount(of_byte * 256 + data, minlength=total * 256).reshape(total, 256) / np.maximum(size, 1)[:, None])
    count = np.bincount(of_word, minlength=total)
    some = np.maximum(count, 1)
    if len(starts):
        value = span_hashes(data, starts, ends, BYTE_VALUE)
        again = np.zeros(len(starts), bool)
        again[1:] = (value[1:] == value[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
        order = np.lexsort((value, of_word))
        seen = np.zeros(len(starts), bool)
        seen[1:] = (value[order][1:] == value[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
        length = ends - starts
        upper = (data[starts] >= 65) & (data[starts] <= 90) & (data[ends - 1] <= 90)
        for k, x in enumerate((again, None, upper, np.log1p(length), length > 25)):
            out[:, 256 + k] = (np.bincount(of_word[order], seen, total) if x is None else np.bincount(of_word, x, total)) / some
    out[:, 261] = count / PASSAGE
    return out, n


@dataclass
class Attention:
    """Gated attention over encoded passages (Ilse, Tomczak and Welling 2018).

    h = tanh(x W), weight of a passage softmax(w (tanh(h V) * sigmoid(h U))), score sigmoid(c . sum(weight h) + d).
    """

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = (x - self.mean) / self.scale
        np.clip(x, -6, 6, out=x)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        first = np.cumsum(n) - n
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "first": first}

    @classmethod
    def fit(cls, x: np.ndarray, n: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 14, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"W": make(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "V": make(hidden, gate), "U": make(hidden, gate), "w": make(gate), "c": make(hidden), "d": np.zeros(1, np.float32)}
        mean = x.mean(0)
        spread = np.sqrt(sum(((part - mean) ** 2).sum(0) for part in np.array_split(x, max(1, len(x) // 4096))) / len(x))
        own = cls(mean, spread + 0.02, p)
        first = np.cumsum(n) - n
        m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(n))
            for s in range(0, len(n), batch):
                take = order[s : s + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in take])
                k = n[take]
                score, f = own.forward(x[rows], k)
                dz = (score - y[take]).astype(np.float32) / len(take)
                grad = {"c": f["z"].T @ dz, "d": np.array([dz.sum()], np.float32)}
                dh_doc = dz[:, None] * p["c"]
                per = np.repeat(dh_doc, k, axis=0)
                da = (per * f["h"]).sum(1)
                de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(k) - k), k))
                dtg = de[:, None] * p["w"]
                grad["w"] = (f["t"] * f["g"]).T @ de
                dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
                grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
                dpre = (f["a"][:, None] * per + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
                grad["W"], grad["b"] = f["x"].T @ dpre, dpre.sum(0)
                step += 1
                for q in p:
                    g = grad[q] + decay * p[q]
                    m[q] = 0.9 * m[q] + 0.1 * g
                    v[q] = 0.99 * v[q] + 0.01 * g * g
                    p[q] -= (rate * (1 - epoch / epochs) * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return own


def fit(docs: DataFrame, labels: DataFrame, good: int = 2000, bad: int = 1200, most_chars: int = 12_000) -> Attention | None:
    """Learn from a bounded sample; None where one of the classes has no labelled rows."""
    texts = sample(docs, labels, "quality", {0: bad, 1: good}, most_chars)
    if not texts[0] or not texts[1]:
        return None
    parts, y = [], []
    for label, rows in texts.items():
        y += [label] * len(rows)
        parts += [passages(d, o) for _, _, d, o in text_chunks(pa.array(rows, pa.string()))]
    return Attention.fit(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]), np.array(y, np.float32))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted): how likely a document's label is 1, from its whole text alone.

    Every passage of a document is encoded; learned gated attention weighs the passages, and the weighted sum is scored.
    Null, empty and blank texts are one empty passage. Very long texts are encoded in full. Equal texts score alike;
    repeated rows stay. A null doc_id is not held out. No rows give no rows; without labels of both kinds every score
    is 0.5. Neither labels, lang, source nor doc_id is an input, and other columns are not looked at.
    """
    model = fit(docs, labels, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                y = model.forward(*passages(data, offsets))[0] if model else np.full(j - i, 0.5)
                y = y.astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array(y), pa.array((y >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier does not reject, with their columns. Decided on each row's own text.

    A null text counts as empty; equal texts share their fate, so repeated rows stay or go together. Where the labels
    don't hold both kinds, nothing can be learnt and every document stays. No rows give no rows.
    """
    model = fit(docs, labels, **options)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(model.forward(*passages(data, offsets))[0] >= threshold))

    return docs.mapInArrow(keep, docs.schema)
