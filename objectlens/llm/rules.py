"""Operator 10: quality rules with risk-controlled thresholds.

``text_counts`` measures every whole text.  ``calibrate`` chooses cutoffs in each stratum from
labelled holdouts: the learned rules together may reject good documents (label 1) that pass the
base with a rate of at most ``ALPHA``.  All rules go one joint path of ``LEVELS`` from lenient to
strict.  A level counts as certified if the exact binomial test rejects "the rate is higher" (the
one-sided Clopper-Pearson bound lies below the rate).  Within a stratum levels are tested from the
most lenient on and testing stops at the first that fails, which needs no correction; between the
strata, Bonferroni's correction holds the chance of any false guarantee below ``DELTA``.  As all
certified levels hold at once, the one that tells bad documents (label 0) from good ones best is
taken; a stratum without a certified level that helps rejects nothing.  To certify a level that
rejects no good document takes about 80 of them.

Only counts by stratum, label and level leave the executors: 3 x 2 x 42, whatever the input.

Defined results: a null or empty text has no words, so it fails the base; labels other than 0 and 1 and
documents without a label don't calibrate; without labels only the base rules reject; a document
with several labels counts once for each; a null doc_id never joins a label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import fields, frozen

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Words at which the strata begin.
STRATA = (0, 100, 400)
#: Each rule is a ratio of two counts; a document is rejected if it is above the cutoff.
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "shouts": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
}
#: Where each rule's path begins, and what all of them are multiplied by from level to level.
START = {"symbols": 2.0, "dup_lines": 2.0, "repeats": 2.0, "shouts": 2.0, "marks": 2.0, "digits": 2.0}
LEVELS, STEP = 41, 0.88
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _classes(chars: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[[ord(c) for c in chars]] = True
    return lut


SYMBOLS, UPPER, MARKS, DIGITS = _classes("#*$%&|<>"), _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _classes("!?"), _classes("0123456789")


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    n_docs = len(off) - 1
    h, starts, ends, counts = tx.words(data, off, tx.SPACES)
    mapped = tx.SPACES[data]
    out = {
        "n_words": counts,
        "word_chars": _per_doc((mapped != 0) & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_doc(SYMBOLS[data], off),
        "n_upper": _per_doc(UPPER[data], off),
        "n_marks": _per_doc(MARKS[data], off),
        "n_digits": _per_doc(DIGITS[data], off),
    }
    # lines that have a word, by document and content
    inner = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, off[:-1][np.diff(off) > 0]])).astype(np.int64)
    inner = inner[inner < len(data)]
    stop = np.append(inner[1:], len(data))
    stop = stop - ((stop > inner) & (data[np.maximum(stop - 1, 0)] == 10)) if len(inner) else stop[:0]
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, inner)
    inner, stop = inner[has], stop[has]
    owner = np.searchsorted(off, inner, "right") - 1
    out["n_lines"] = np.bincount(owner, minlength=n_docs).astype(np.int64)
    if len(inner):
        key = np.sort((owner.astype(tx.U64) << tx.U64(54)) | (tx.span_hash(tx.BYTE_VALUES[data], inner, stop) >> tx.U64(10)))
        again = key[1:][key[1:] == key[:-1]]
        out["n_dup_lines"] = np.bincount((again >> tx.U64(54)).astype(np.int64), minlength=n_docs).astype(np.int64)
    else:
        out["n_dup_lines"] = np.zeros(n_docs, np.int64)
    win, first, per = tx.windows(h, counts, REPEAT_WINDOW)
    cover = np.zeros(len(h) + 1, np.int64)
    if len(win):
        key = (np.repeat(np.arange(n_docs), per).astype(tx.U64) << tx.U64(54)) | (win >> tx.U64(10))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(win), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + REPEAT_WINDOW, -1)
    word_off = np.concatenate([[0], np.cumsum(counts)])
    out["n_repeat_words"] = _per_doc(np.cumsum(cover[:-1]) > 0, word_off)
    return out


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and the counts of COUNTS for every whole text."""
    keep = [c for c in keep if c not in COUNTS]
    read = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {c: np.zeros(batch.num_rows, np.int64) for c in COUNTS}
            for lo, hi, data, off in tx.chunks(batch.column(read.index(text_col))):
                for name, values in measure(data, off).items():
                    out[name][lo:hi] = values
            yield tx.with_columns(batch, keep, **{c: pa.array(v, pa.int64()) for c, v in out.items()})

    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, ", ".join(filter(None, [fields(docs, keep), *[f"{c} bigint" for c in COUNTS]])))


def stratum() -> Column:
    out = F.lit(0)
    for k, low in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= low, k).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, bottom = RATIOS[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at the rate p, exactly summed in logarithms."""
    i = np.arange(k + 1)
    steps = np.log((n - i[1:] + 1) / i[1:]) + math.log(p) - math.log1p(-p) if k else np.zeros(0)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def cutoffs(rule: str) -> list[float]:
    """The rule's cutoff at each level."""
    return [round(START[rule] * STEP**k, 6) for k in range(LEVELS)]


def _passed(rule: str) -> Column:
    """The cutoffs of the rule's path that a document is not above."""
    value = ratio(rule)
    return F.size(F.filter(F.array(*map(F.lit, cutoffs(rule))), lambda c: c >= value))


def first_level() -> Column:
    """The most lenient level that rejects a document; LEVELS if none does."""
    return F.least(*map(_passed, RATIOS))


def calibrate(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[int, int]:
    """The certified level of each stratum that has one."""
    marked = labels.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    held = counted.where(~base_failed()).select(F.col(f"`{id_col}`").alias("_doc"), stratum().alias("_s"), first_level().alias("_first"))
    found = held.join(marked, F.col("_doc") == F.col("_id")).groupBy("_s", "_label", "_first").agg(F.count(F.lit(1)).alias("_n")).collect()
    numbers = np.zeros((len(STRATA), 2, LEVELS + 1), np.int64)
    for s, label, first, n in found:
        numbers[s, label, first] = n
    chosen = {}
    for s in range(len(STRATA)):
        (m, n), (wrong, right) = numbers[s].sum(1).tolist(), numbers[s].cumsum(1)[::-1]
        best = 0.0
        for k in range(LEVELS):
            if binomial_tail(int(wrong[k]), n, alpha) > delta / len(STRATA):
                break
            gain = int(right[k]) / max(m, 1) - int(wrong[k]) / max(n, 1)
            if gain > best:
                best, chosen[s] = gain, k
    return chosen


def rejected_by(levels: dict[int, int]) -> Column:
    """True where a certified level rejects."""
    out = F.lit(False)
    for s, level in sorted(levels.items()):
        for rule in RATIOS:
            out = out | ((stratum() == s) & (ratio(rule) > cutoffs(rule)[level]))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The columns keep, the counts, base_failed and kept.

    Texts are read once: the counts are written to the shared folder, and calibration and
    verdicts both start from there.
    """
    counted = frozen(text_counts(docs, list(dict.fromkeys([*keep, id_col])), text_col), "rules")
    levels = calibrate(counted, labels, id_col, label_col, alpha, delta)
    judged = counted.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected_by(levels)))
    return judged.select(*[f"`{c}`" for c in keep if c not in COUNTS], *COUNTS, "base_failed", "kept")
