"""Operator 8: benchmark decontamination with suffix arrays of the training words.

Every shard of documents (a chunk of whole texts) gets a suffix array over its words.  Every
distinct window of the benchmark is binary-searched in every shard, which gives the places where
it occurs verbatim.  Around these places, training and benchmark suffixes are sorted together to
their full depth; the benchmark suffix next to a place's own has the longest match, and the words
of all longest matches are the hit ones.

A window is ``n`` consecutive words of an item; an item of fewer, but not none, is one window.
Windows are distinct, each with the items that hold it, so a place has one window of each size at
most, however often texts and items repeat themselves.  Words are numbered by the benchmark's
vocabulary.  A word outside it can start no match and ends every match, so only suffixes with
enough vocabulary words ahead enter the array; no match is lost by that.  Words are compared by
64-bit hashes.

The benchmark is cut into blocks of at most about ``BLOCK_WORDS`` words by the executors, which
write them to the shared folder.  A task holds one block at a time and goes through them batch by
batch, so a benchmark of any size takes the memory of one block; the driver holds their paths.

Defined results: a null or empty text has no words and no hit; an empty benchmark hits nothing;
a null item_id counts as the item "null"; repeated items count by their distinct ids; of equally
long matches of a place one is reported; null and repeated doc_ids are rows like others; an empty
table gives no rows.  A text longer than ``SHARD_BYTES`` is a shard of its own and takes some 50
bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import fields, open_fs, scratch, write_once

WINDOW = 10
BLOCK_WORDS = 500_000
SHARD_BYTES = 4 << 20


class Suffixes:
    """A block of the benchmark: its vocabulary, its suffixes, and their distinct windows."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        self.n, self.names = n, [name for name, _ in items]
        data, off = tx.buffers(pa.array([text for _, text in items], pa.string()))
        h, _, _, counts = tx.words(data, off, tx.ALNUM_LOWER)
        self.vocab = np.unique(h)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocab >> tx.U64(48)).astype(np.int64)] = True
        self.ids = (np.searchsorted(self.vocab, h) + 1).astype(np.int64)
        self.least = int(min(n, counts[counts > 0].min())) if (counts > 0).any() else n
        # one window at each suffix that has n words, or the whole of a shorter item
        per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(items)), per)
        self.at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.begin = (np.cumsum(counts) - counts)[self.item] + self.at
        size = np.minimum(counts, n)[self.item]
        take = self.begin[:, None] + np.arange(n)
        query = np.where(np.arange(n) < size[:, None], self.ids[np.minimum(take, max(len(h) - 1, 0))] if len(h) else 0, 0)
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        keys = self.pack(query)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)
        self.window = np.empty(len(order), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.query, self.size = query[order[new]], size[order[new]]
        held = np.unique(self.window * max(len(items), 1) + self.item)
        self.holder = held % max(len(items), 1)
        self.holders = np.searchsorted(held // max(len(items), 1), np.arange(len(self.size) + 1))

    def pack(self, columns: np.ndarray) -> np.ndarray:
        """Rows of word numbers as a few 64-bit keys each, in the same order: [keys, rows]."""
        per = 64 // self.bits
        keys = []
        for k in range(0, self.n, per):
            key = np.zeros(len(columns), tx.U64)
            for j in range(k, min(k + per, self.n)):
                key |= columns[:, j].astype(tx.U64) << tx.U64(64 - self.bits * (j - k + 1))
            keys.append(key)
        return np.array(keys)

    def found(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, windows): where each distinct window stands in the shard; and the shard's word numbers."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.item):
            return none
        ids = np.zeros(len(h) + self.n, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> tx.U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
        ids[maybe] = np.where(self.vocab[at] == h[maybe], at + 1, 0)
        # words up to the next foreign word or the document's end
        stop = np.unique(np.concatenate([np.flatnonzero(ids == 0), np.cumsum(counts)]))
        ahead = stop[np.searchsorted(stop, np.arange(len(h)), "right")] - np.arange(len(h))
        ahead[ids[: len(h)] == 0] = 0
        places = np.flatnonzero(ahead >= self.least)
        if not len(places):
            return none
        depth = np.minimum(ahead[places], self.n)
        columns = np.where(np.arange(self.n) < depth[:, None], ids[places[:, None] + np.arange(self.n)], 0)
        keys = self.pack(columns)
        array = np.lexsort(keys[::-1])
        keys, places = keys[:, array], places[array]
        low = self.pack(self.query)
        high = self.pack(np.where(np.arange(self.n) < self.size[:, None], self.query, (1 << self.bits) - 1))
        begin, end = self._search(keys, low, "left"), self._search(keys, high, "right")
        many = end - begin
        which = np.repeat(np.arange(len(many)), many)
        return places[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())], which, ids[: len(h)]

    @staticmethod
    def _search(keys: np.ndarray, query: np.ndarray, side: str) -> np.ndarray:
        """Binary search of many queries at once in rows sorted by several keys."""
        lo, hi = np.zeros(query.shape[1], np.int64), np.full(query.shape[1], keys.shape[1])
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, keys.shape[1] - 1)
            less, tied = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for key, q in zip(keys, query, strict=True):
                less |= tied & (key[at] < q)
                tied &= key[at] == q
            right = open_ & ((less | tied) if side == "right" else less)
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def longest(self, places: np.ndarray, which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches of a shard: (first word, words, item, first word in the item).

        A match that is another's rest, one word further on, is left out.  A window of a short item
        is a match of its own.
        """
        short = self.size[which] < self.n
        first, window = places[short], which[short]
        whole = first, self.size[window], self.holder[self.holders[window]], np.zeros(len(first), np.int64)
        if short.all():
            return whole
        here = np.sort(places[~short])
        present = np.zeros(len(self.size), bool)
        present[which[~short]] = True
        own = np.flatnonzero(present[self.window])  # the suffixes that have a window there
        bounds = np.cumsum(counts)
        left, left_at = _stretches(ids, here, np.searchsorted(bounds, here, "right"), self.n, -1)
        right, right_at = _stretches(self.ids, self.begin[own], self.item[own], self.n, -2)
        x = np.concatenate([left, right])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], x < 0])))
        levels = [np.append(np.unique(x, return_inverse=True)[1], -1)]
        while 1 << len(levels) <= runs.max(initial=1):
            last, step = levels[-1], 1 << (len(levels) - 1)
            ahead = np.append(last[step:], np.full(min(step, len(last)), -1))[: len(last)]
            level = np.unique(last * (len(last) + 1) + ahead + 1, return_inverse=True)[1]
            level[-1] = -1
            levels.append(level)
        array = np.argsort(levels[-1][:-1], kind="stable")
        test = np.full(len(x), -1)
        test[len(left) + right_at] = np.arange(len(own))
        is_test = test[array] >= 0
        spot = np.empty(len(x), np.int64)
        spot[array] = np.arange(len(x))
        index = np.arange(len(x))
        before = np.maximum.accumulate(np.where(is_test, index, -1))
        behind = np.minimum.accumulate(np.where(is_test, index, len(x))[::-1])[::-1]
        size, best = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        for near in (before[spot[left_at]], behind[spot[left_at]]):
            some = np.flatnonzero((near >= 0) & (near < len(x)))
            other = array[near[some]]
            length = self._common(levels, left_at[some], other)
            more = length > size[some]
            size[some[more]], best[some[more]] = length[more], test[other[more]]
        rest = np.zeros(len(here), bool)
        rest[1:] = (here[1:] == here[:-1] + 1) & (size[1:] == size[:-1] - 1)
        best = own[best[~rest]]
        return tuple(np.concatenate(pair) for pair in zip(whole, (here[~rest], size[~rest], self.item[best], self.at[best]), strict=True))

    @staticmethod
    def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Elements that the suffixes at a and b share from their beginning on."""
        length, last = np.zeros(len(a), np.int64), len(levels[0]) - 1
        for k in range(len(levels) - 1, -1, -1):
            one, two = np.minimum(a + length, last), np.minimum(b + length, last)
            length += np.where((one < last) & (two < last) & (levels[k][one] == levels[k][two]), 1 << k, 0)
        return length


def _stretches(ids: np.ndarray, places: np.ndarray, owner: np.ndarray, n: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The words in windows of n at ascending places, a mark behind each stretch, and the places therein."""
    apart = np.ones(len(places), bool)
    apart[1:] = (places[1:] > places[:-1] + n) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(places)) - 1
    size = places[last] + n - places[first]
    base = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), mark, np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(base, size) + inner] = ids[np.repeat(places[first], size) + inner]
    group = np.cumsum(apart) - 1
    return out, base[group] + places - places[first][group]


def _write_blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_words: int) -> list[str]:
    """The benchmark as files of blocks of at most about block_words words; their paths."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 2), F.lit(0))).head()[0]
    folder = scratch(benchmark.sparkSession, "benchmark")

    def run(batches):
        block, words, number = [], 0, 0

        def close():
            path = f"{folder}/{TaskContext.get().partitionId():06d}-{number:06d}"
            write_once(path, lambda out: out.write(pickle.dumps(Suffixes(block, n))))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                block.append((item, text))
                words += len(text) // 2 + 1
                if words >= block_words:
                    yield close()
                    block, words, number = [], 0, number + 1
        if block:
            yield close()

    return sorted(r["path"] for r in rows.coalesce(int(size // (2 * block_words)) + 1).mapInArrow(run, "path string").collect())


def _blocks(paths: list[str], held: dict[str, Suffixes]) -> Iterator[Suffixes]:
    """The blocks one by one; held keeps the last."""
    for path in paths:
        if path not in held:
            held.clear()
            fs, at = open_fs(path)
            with fs.open_input_stream(at) as stream:
                held[path] = pickle.loads(stream.readall())
        yield held[path]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", keep: list[str] | None = None, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Find every benchmark window in every whole text; remove affected documents with ``~contaminated``.

    Adds n_words, n_hit (words inside any match), n_items, items_sha256, contaminated and
    ``matches``: array of (word_start, n_words, item_id, item_word) of longest matches.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    read = list(dict.fromkeys([*keep, text_col]))
    paths = _write_blocks(benchmark, item_col, item_text_col, n, block_words)

    def run(batches):
        held: dict[str, Suffixes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.num_rows
            n_words, n_hit, n_items = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
            digest, found = [hashlib.sha256(b"").hexdigest()] * total, [[] for _ in range(total)]
            names: dict[int, set] = {}
            shards = []
            for lo, hi, data, off in tx.chunks(batch.column(read.index(text_col)), SHARD_BYTES):
                h, _, _, counts = tx.words(data, off, tx.ALNUM_LOWER)
                n_words[lo:hi] = counts
                shards.append((lo, h, counts, np.zeros(len(h) + 1, np.int32)))
            for side in _blocks(paths, held):
                for lo, h, counts, cover in shards:
                    places, which, ids = side.found(h, counts)
                    if not len(places):
                        continue
                    ends = np.cumsum(counts)
                    owner = np.searchsorted(ends, places, "right")
                    pair = np.unique(owner * len(side.size) + which)
                    window = pair % len(side.size)
                    many = side.holders[window + 1] - side.holders[window]
                    item = side.holder[np.repeat(side.holders[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    for own, k in np.unique(np.stack([np.repeat(pair // len(side.size), many), item], 1), axis=0).tolist():
                        names.setdefault(lo + own, set()).add(side.names[k])
                    first, size, item, at = side.longest(places, which, ids, counts)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + size, -1)
                    own = np.searchsorted(ends, first, "right")
                    for o, f, z, k, a in zip(own.tolist(), (first - (ends - counts)[own]).tolist(), size.tolist(), item.tolist(), at.tolist(), strict=True):
                        found[lo + o].append({"word_start": f, "n_words": z, "item_id": side.names[k], "item_word": a})
            for lo, h, counts, cover in shards:
                hit, ends = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)]), np.cumsum(counts)
                n_hit[lo : lo + len(counts)] = hit[ends] - hit[ends - counts]
            for row, items in names.items():
                n_items[row] = len(items)
                digest[row] = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            spans = pa.array([sorted(f, key=lambda m: (m["word_start"], m["item_id"], m["item_word"])) for f in found], pa.list_(pa.struct([("word_start", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])))
            yield tx.with_columns(batch, keep, n_words=pa.array(n_words), n_hit=pa.array(n_hit), n_items=pa.array(n_items), items_sha256=pa.array(digest), contaminated=pa.array(n_hit > 0), matches=spans)

    schema = ", ".join(filter(None, [fields(docs, keep), "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches array<struct<word_start: bigint, n_words: bigint, item_id: string, item_word: bigint>>"]))
    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)
