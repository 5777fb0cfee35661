"""Operator 4: quality classifier, a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it (they overlap
by at least a filter's width).  Bytes have learned embeddings; learned filters of ``WIDTH`` bytes
slide over a chunk ``STEP`` bytes at a time, so a filter meets every byte but begins at every
``STEP``-th one only; each filter's largest response in the chunk is kept.  The document's vector is the mean and the maximum of its chunks' vectors,
and a logistic unit turns it into one probability.

Only the text is an input.  The network is fitted on the driver on a bounded sample of labelled
documents: about ``SAMPLE`` of each label, chosen by a hash of doc_id, never more than four times
that many.  Fitting and scoring cover whole texts.

Defined results: null and empty texts have one chunk of padding; without labels, or with one label
only, the score is that label's share (0.5 without any); labels other than 0 and 1 are ignored, and
a repeated label of a document counts once; a null doc_id never joins a label; equal texts score
alike; an empty table gives no rows.  Chunks of a long text are taken from its bytes a few at a
time, and each leaves ``FILTERS`` numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import fields

CHUNK, WIDTH, STEP = 512, 8, 2
HOP = CHUNK - 32
EMBED, FILTERS = 8, 32
SAMPLE, STEPS, BATCH = 2000, 300, 32
#: Chunks that the filters slide over at a time.
GROUP = 16
#: Score from which a document counts as good.
CUTOFF = 0.7


def cut(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of documents begin and end, and the first chunk of each document."""
    size = np.diff(off)
    per = np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP))
    first = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(size)), per)
    starts = off[:-1][owner] + (np.arange(per.sum()) - first[owner]) * HOP
    return starts, np.minimum(starts + CHUNK, off[1:][owner]), first


def taken(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The bytes of chunks [chunks, CHUNK], 0 behind a document's end."""
    if not len(data):
        return np.zeros((len(starts), CHUNK), np.uint8)
    place = starts[:, None] + np.arange(CHUNK)
    return np.where(place < stops[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


class Network:
    """embed [256, E], filters [WIDTH * E, F], bias [F], out [2F], out_bias."""

    def __init__(self, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.embed = rng.randn(256, EMBED).astype(np.float32) * 0.5
        self.filters = rng.randn(WIDTH * EMBED, FILTERS).astype(np.float32) * (0.7 / np.sqrt(WIDTH * EMBED))
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.randn(2 * FILTERS).astype(np.float32) * 0.1
        self.out_bias = np.zeros(1, np.float32)
        self.constant: float | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def tables(self) -> list[np.ndarray]:
        """What a byte adds to each filter, for each place in the filter: WIDTH times [256, FILTERS]."""
        both = np.einsum("be,kef->kbf", self.embed, self.filters.reshape(WIDTH, EMBED, FILTERS))
        return [np.ascontiguousarray(t) for t in both]

    @staticmethod
    def responses(chunks: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Each filter at each place of each chunk [chunks, places, FILTERS], without bias."""
        last = (CHUNK - WIDTH) // STEP * STEP + 1
        total = np.take(tables[0], chunks[:, :last:STEP], axis=0)
        for k in range(1, WIDTH):
            total += np.take(tables[k], chunks[:, k : k + last : STEP], axis=0)
        return total

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and its place."""
        best, place = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        tables = self.tables()
        for a in range(0, len(chunks), GROUP):
            total = self.responses(chunks[a : a + GROUP], tables)
            place[a : a + GROUP] = at = total.argmax(1)
            best[a : a + GROUP] = np.take_along_axis(total, at[:, None], 1)[:, 0]
        return best + self.bias, place

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each document, its vector, and its chunks' vectors."""
        active = np.tanh(pooled)
        per = np.diff(np.append(first, len(active)))
        vector = np.concatenate([np.add.reduceat(active, first) / per[:, None], np.maximum.reduceat(active, first)], 1)
        return 1 / (1 + np.exp(-np.clip(vector @ self.out + self.out_bias[0], -30, 30))), vector, active

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        (starts, stops, first), tables = cut(off), self.tables()
        best = [self.responses(taken(data, starts[a : a + GROUP], stops[a : a + GROUP]), tables).max(1) for a in range(0, len(starts), GROUP)]
        return self.combine(np.concatenate(best) + self.bias, first)[0].astype(np.float64)

    def gradients(self, chunks: np.ndarray, first: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        pooled, place = self.pooled(chunks)
        score, vector, active = self.combine(pooled, first)
        d = ((score - target) / len(target)).astype(np.float32)
        per = np.diff(np.append(first, len(active)))
        owner = np.repeat(np.arange(len(first)), per)
        wide = d[:, None] * self.out
        top = active == vector[owner, FILTERS:]
        d_active = wide[owner, :FILTERS] / per[owner][:, None] + wide[owner, FILTERS:] * top
        d_pooled = d_active * (1 - active**2)
        # only the place of the largest response passes a gradient on
        codes = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] * STEP + np.arange(WIDTH)]
        seen = self.embed[codes].reshape(len(chunks), FILTERS, -1)
        d_filters = np.matmul(seen.transpose(1, 2, 0), d_pooled.T[:, :, None])[:, :, 0].T
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, codes.reshape(-1), (d_pooled[:, :, None] * self.filters.T).reshape(-1, EMBED))
        return [d_embed, d_filters, d_pooled.sum(0), d @ vector, np.array([d.sum()], np.float32)]


def fit(texts: list[str], targets: list[int], seed: int = 1) -> Network:
    """STEPS of Adam on cross entropy; the documents are gone through in an order fixed by the seed."""
    net = Network(seed)
    target = np.array(targets, np.float32)
    if len(set(targets)) < 2:
        net.constant = float(target.mean()) if len(target) else 0.5
        return net
    rng = np.random.RandomState(seed)
    docs = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        docs.append(taken(raw, *cut(np.array([0, len(raw)]))[:2]))
    m, v, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    order = np.concatenate([rng.permutation(len(docs)) for _ in range(STEPS * BATCH // len(docs) + 1)])
    while step < STEPS:
        own = order[step * BATCH : (step + 1) * BATCH]
        step += 1
        per = np.array([len(docs[i]) for i in own])
        grads = net.gradients(np.concatenate([docs[i] for i in own]), np.cumsum(per) - per, target[own])
        for p, g, a, b in zip(net.parameters(), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.02 * (1 - (step - 1) / STEPS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """Fit on about ``sample`` documents of each label, chosen by hash; at most four times ``sample`` reach the driver."""
    marks = labels.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    sizes = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("_label") == label) & (F.pmod(F.xxhash64("_id", F.lit("cnn")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / n))))
    few = marks.where(chosen).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(few), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_label").orderBy(F.xxhash64("_doc", "_text"), "_doc", "_text", "_label").limit(4 * sample).collect()
    net = fit([r["_text"] for r in rows], [r["_label"] for r in rows])
    if net.constant is None:  # the sample has other shares than all labels
        ones = sum(r["_label"] for r in rows)
        net.out_bias += np.log(sizes[1] / sizes[0]) - np.log(ones / (len(rows) - ones))
    return net


def quality_scores(docs: DataFrame, net: Network, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted`` of every whole text to the columns keep."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    read = list(dict.fromkeys([*keep, text_col]))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.zeros(batch.num_rows)
            for lo, hi, data, off in tx.chunks(batch.column(read.index(text_col))):
                score[lo:hi] = sent.value.score(data, off)
            yield tx.with_columns(batch, keep, score=pa.array(score), predicted=pa.array((score >= CUTOFF).astype(np.int32)))

    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, ", ".join(filter(None, [fields(docs, keep), "score double, predicted int"])))
