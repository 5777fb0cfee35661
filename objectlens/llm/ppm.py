"""Operator 5: language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted.  A symbol's
probability in a context is count / (total + distinct); what is left escapes to the context that
is one byte shorter, over the symbols not seen in the longer one, down to equal chances.  With
frozen counts a text's code length under a language is an exact sum over its bytes; the shortest
code wins, and its share of 2^-length is the score.

A-Z is lower-cased and ASCII that is no letter counts as one symbol.  Every byte met in training
has a symbol of its own; those never met share the one of a text's start.  The trees of all languages are compiled into one table [context, symbol, language], so
that a text is scored by lookups alone.

Fitting uses a bounded sample: about ``SAMPLE_BYTES`` of text for each language, whole texts chosen
by their hash, equal ones taken once; a text larger than that is scored but not learned from, and
a language is done with once twice as many bytes are there.  Defined results: null texts and texts
without a letter are ``und`` with score 0; without any labelled text all are ``und``; a tie goes to
the first language by name; ids play no part, so null and repeated ones are rows like others; an
empty table gives no rows.  Scoring takes about 100 bytes of memory for each byte of a chunk, and a
text longer than ``tx.CHUNK_BYTES`` is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import fields

ORDER, SAMPLE_BYTES = 4, 600_000


def _fold() -> np.ndarray:
    lut = np.arange(256)
    lut[65:91] += 32
    lut[:128][~np.isin(np.arange(128), np.r_[65:91, 97:123])] = 32
    return lut


FOLD = _fold()


class Trees:
    """Compiled context trees: ``root`` and ``deeper`` lead to a context's row, ``bits`` holds code lengths."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        raw = {k: [np.frombuffer(t.encode(), np.uint8) for t in v] for k, v in texts.items()}
        seen = np.zeros(256, np.int64)
        for parts in raw.values():
            for p in parts:
                seen += np.bincount(FOLD[p], minlength=256)
        met = np.flatnonzero(seen)
        lut = np.zeros(256, np.int64)
        lut[met] = np.arange(1, len(met) + 1)
        #: 0 stands for a text's start and for bytes that training didn't meet
        self.symbol = lut[FOLD]
        self.width = width = len(met) + 1
        grams = {k: self._grams(v) for k, v in raw.items()}
        # every context that any language has, shorter ones first; code = symbols read backwards in base width
        codes = [np.zeros(1, np.int64)] + [np.unique(np.concatenate([g[0][d] // width for g in grams.values()])) if grams else np.zeros(0, np.int64) for d in range(1, ORDER + 1)]
        rows, base = [], 0
        for c in codes:
            rows.append(base)
            base += len(c)
        bits = np.zeros((base, width, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            share = np.full((1, width), 1 / width)
            for d in range(ORDER + 1):
                count = np.zeros((len(codes[d]), width))
                keys, number = grams[lang][0][d], grams[lang][1][d]
                count[np.searchsorted(codes[d], keys // width), keys % width] = number
                if d:
                    share = share[np.searchsorted(codes[d - 1], codes[d] % width ** (d - 1))]
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                free = np.where(count > 0, 0, share)
                left = free.sum(1, keepdims=True)
                escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1) / np.maximum(left, 1e-300), 0)
                scale = np.where(left > 0, total + kinds, np.maximum(total, 1))
                share = np.where(total > 0, np.where(count > 0, count / np.maximum(scale, 1), free * escape), share)
                bits[rows[d] : rows[d] + len(codes[d]), :, j] = -np.log2(np.maximum(share, 1e-30))
        self.bits = bits.reshape(base * width, len(self.langs))
        # the longest known context: order 3 directly, each further symbol by one more lookup
        root = np.zeros(width**3, np.int64)
        for d in (1, 2, 3):
            size = width**d
            full = np.full(size, -1)
            full[codes[d]] = rows[d] + np.arange(len(codes[d]))
            each = full[np.arange(width**3) % size]
            root = np.where(each >= 0, each, root)
        self.root = root.astype(np.int32)
        deeper = np.repeat(np.arange(rows[4] + len(codes[4])), width).reshape(-1, width)
        oldest, younger = codes[4] // width**3, codes[4] % width**3
        deeper[self.root[younger], oldest] = rows[4] + np.arange(len(codes[4]))
        self.deeper = deeper[: rows[4]].reshape(-1).astype(np.int32)

    def _grams(self, parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Distinct (context, symbol) codes and their counts for each order."""
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        s, back = self._shifted(data, off)
        keys, numbers = [], []
        for d in range(ORDER + 1):
            code = np.zeros(len(s), np.int64)
            for k in range(d, 0, -1):
                code = code * self.width + back[k - 1]
            k, n = np.unique(code * self.width + s, return_counts=True)
            keys.append(k)
            numbers.append(n)
        return keys, numbers

    def _shifted(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Symbols, and for k = 1.. the symbol k before within the document (0 before its start)."""
        s = self.symbol[data]
        back = []
        for k in range(1, ORDER + 1):
            b = np.zeros(len(s), np.int64)
            b[k:] = s[:-k] if len(s) > k else s[:0]
            for j in range(k):
                at = off[:-1] + j
                b[at[at < off[1:]]] = 0
            back.append(b)
        return s, back

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each document under each language [documents, languages]."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(off) > 0)
        if len(full) and self.langs:
            w = self.width
            s, (b1, b2, b3, b4) = self._shifted(data, off)
            at = self.root[(b3 * w + b2) * w + b1].astype(np.int64)
            deep = at * w < len(self.deeper)
            at = np.where(deep, self.deeper[np.where(deep, at * w + b4, 0)], at)
            out[full] = np.add.reduceat(self.bits[at * w + s], off[:-1][full], dtype=np.float64)
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Count the trees on about sample_bytes of each language; at most twice that many of each reach the driver."""
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).where(F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.sum(F.octet_length("_text")).alias("n")).collect()}
    place, chosen = F.xxhash64("_text", F.lit("ppm")), F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("_lang") == lang) & (F.pmod(place, F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample_bytes / max(n, 1))) + 1))
    texts: dict[str, list[str]] = {lang: [] for lang in sizes}
    left = dict.fromkeys(sizes, 2 * sample_bytes)
    few = rows.where(chosen & (F.octet_length("_text") <= sample_bytes)).distinct().orderBy("_lang", place, "_text")
    for r in few.toLocalIterator():
        if left[r["_lang"]] > 0:
            texts[r["_lang"]].append(r["_text"])
            left[r["_lang"]] -= len(r["_text"].encode())
    return Trees(texts)


def identify(docs: DataFrame, trees: Trees, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``code_bits`` (of the winner) to the columns keep."""
    new = ["lang_pred", "score", "code_bits"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    read = list(dict.fromkeys([*keep, text_col]))
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        names = np.array([*sent.value.langs, "und"], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            pick, score, bits = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            letters = np.array(batch.column(len(read)).fill_null(False).to_pylist(), bool)
            if len(names) > 1:
                for lo, hi, data, off in tx.chunks(batch.column(read.index(text_col))):
                    length = sent.value.code_lengths(data, off)
                    best = length.argmin(1)
                    least = length[np.arange(hi - lo), best]
                    on = letters[lo:hi]
                    pick[lo:hi] = np.where(on, best, len(names) - 1)
                    score[lo:hi] = np.where(on, 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1), 0)
                    bits[lo:hi] = np.where(on, least, 0)
            yield tx.with_columns(batch, keep, lang_pred=pa.array(names[pick], pa.string()), score=pa.array(score), code_bits=pa.array(bits))

    rows = docs.select(*[f"`{c}`" for c in read], F.col(f"`{text_col}`").rlike(r"\p{L}").alias("_letters"))
    return rows.mapInArrow(run, ", ".join(filter(None, [fields(docs, keep), "lang_pred string, score double, code_bits double"])))
