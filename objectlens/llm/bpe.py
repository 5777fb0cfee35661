"""Operator 1: BPE encoding and decoding with a contiguous rank array.

Each short word holds its part boundaries and the ranks of adjacent parts in one contiguous row.
The row is scanned for its minimum, the boundary there is deleted, and the two neighbouring ranks
are refreshed, until no pair has a rank.  Rows of equal length are worked on together: one matrix
holds the ranks of many words, and each round deletes one boundary in every word that has one.

The tokenizer file is a parameter; it is a BPE with word ends (byte-level alphabet, lower case,
white space dropped).  Defined results: a null or empty text has no ids and decodes to the empty
text; a special token's own string inside a text is that token, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from objectlens.llm import textops as tx
from objectlens.llm.common import fields

#: Words of more bytes than this are merged with a heap, since rescanning costs their length squared.
SHORT_WORD = 48
KNOWN_WORDS = 1_000_000
NO_RANK = 1 << 62
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The white space of the tokenizer's \s, and its contractions after an apostrophe.
WHITE = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer read from a file; encodes chunks of documents."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        alphabet = _byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int32)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a] << 17) | vocab[b], (rank, vocab[a + b]))
        self.pairs = pairs
        order = sorted(pairs)
        self.keys = np.array([*order, 1 << 62], np.int64)
        self.found = np.array([*((pairs[k][0] << 17) | pairs[k][1] for k in order), NO_RANK], np.int64)
        classes = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LN":
                classes[i] = LETTER if kind == "L" else NUMBER
        classes[WHITE] = SPACE
        self.classes = classes
        #: Words seen lately, by hash: their place in a pool of ids.  Only a memory of results, emptied when full.
        self.known = np.zeros(0, tx.U64)
        self.known_at = np.zeros((0, 2), np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        rng = np.random.RandomState(7)
        self.values = rng.randint(0, 1 << 62, 4096, dtype=np.int64).astype(tx.U64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of pairs in one number that sorts by rank; NO_RANK where the pair doesn't merge."""
        key = (left.astype(np.int64) << 17) | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0), self.found[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one length: parts [words, bytes] -> ids padded with -1, and the ids in each word."""
        n, width = parts.shape
        out, size = np.full((n, width), -1, np.int32), np.full(n, width)
        who, ranks = np.arange(n), self._find(parts[:, :-1], parts[:, 1:])
        while width > 1 and len(who):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(who)), at]
            over = least == NO_RANK
            if over.any():
                out[who[over], :width] = parts[over]
                size[who[over]] = width
                who, at, least, parts, ranks = who[~over], at[~over], least[~over], parts[~over], ranks[~over]
                if not len(who):
                    break
            # every word here loses one boundary, so all stay of one length
            rows, column = np.arange(len(who)), at[:, None]
            parts[rows, at] = least & 0x1FFFF
            parts = np.where(np.arange(width - 1) <= column, parts[:, :-1], parts[:, 1:])
            ranks = np.where(np.arange(width - 2) < column, ranks[:, :-1], ranks[:, 1:])
            width -= 1
            for near, ok in ((at - 1, at > 0), (at, at < width - 1)):  # refresh the neighbouring ranks
                r, c = rows[ok], near[ok]
                ranks[r, c] = self._find(parts[r, c], parts[r, c + 1])
        out[who, :width] = parts
        size[who] = width
        return out, size

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for one long word, with a heap of (rank, place)."""
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        parts, heap = list(parts), []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < len(parts) and (hit := self.pairs.get((parts[i] << 17) | parts[nxt[i]])):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[nxt[i]], hit[1]))

        for i in range(len(parts)):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if parts[i] != a or nxt[i] >= len(parts) or parts[nxt[i]] != b:
                continue
            gone = nxt[i]
            parts[i], parts[gone], nxt[i] = made, -1, nxt[gone]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
            push(prv[i])
            push(i)
        return [p for p in parts if p >= 0]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as spans of UTF-8 bytes: (ids, offsets by word)."""
        lengths = ends - starts
        sizes, found = np.zeros(len(starts), np.int64), []
        for width in np.unique(lengths):
            which = np.flatnonzero(lengths == width)
            if width > SHORT_WORD:
                for w in which:
                    piece = data[starts[w] : ends[w]]
                    ids = self.merge_long([*self.inner[piece[:-1]].tolist(), int(self.last[piece[-1]])])
                    sizes[w] = len(ids)
                    found.append((np.full(len(ids), w), np.array(ids, np.int32)))
                continue
            raw = data[starts[which][:, None] + np.arange(width)]
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            ids, size = self.merge_rows(parts)
            sizes[which] = size
            on = np.arange(width) < size[:, None]
            found.append((np.repeat(which, size), ids[on]))
        off = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(off[-1], np.int32)
        for owner, ids in found:
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            out[off[owner] + place] = ids
        return out, off

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _pieces(self, points: np.ndarray, doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokenizer's pieces, and the pieces in each document."""
        n = len(points)
        kind = self.classes[points]
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new[doc_off[doc_off < n]] = True
        quotes = np.flatnonzero((points == 39) & new)
        if len(quotes):
            limit = doc_off[np.searchsorted(doc_off, quotes, "right")]
            at = lambda k: np.where(quotes + k < limit, points[np.minimum(quotes + k, n - 1)], 0)
            one, two, length = at(1), at(2), np.zeros(len(quotes), np.int64)
            for c in CONTRACTIONS[::-1]:
                hit = (one == ord(c[0])) & ((two == ord(c[1])) if len(c) == 2 else True)
                length[hit] = len(c) + 1
            quotes, length = quotes[length > 0], length[length > 0]
            for k in (1, 2):  # a contraction is one piece, and the next piece starts behind it
                inside = quotes[length > k] + k
                new[inside] = False
            behind = quotes + length
            new[behind[behind < n]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        keep = kind[begin] != SPACE
        begin, end = begin[keep], end[keep]
        return begin, end, np.diff(np.searchsorted(begin, doc_off))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens inside: (ids, offsets by text)."""
        points = [np.frombuffer(self.normalise(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        doc_off = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin, end, per = self._pieces(flat, doc_off)
        value = tx.mix(self.values[flat & 4095] + flat)
        hashes, first, inverse = np.unique(tx.span_hash(value, begin, end), return_index=True, return_inverse=True)
        at = self._places(hashes, flat, begin[first], end[first])
        size = (at[:, 1] - at[:, 0])[inverse]
        place = np.repeat(at[:, 0][inverse] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])]
        return self.pool[place], ends

    def _places(self, hashes: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Start and end in the pool of the ids of distinct pieces; merges those that aren't known."""
        if len(self.known) + len(hashes) > KNOWN_WORDS:
            self.known, self.known_at, self.used = self.known[:0], self.known_at[:0], 0
        spot = np.searchsorted(self.known, hashes)
        there = np.zeros(len(hashes), bool)
        if len(self.known):
            there = self.known[np.minimum(spot, len(self.known) - 1)] == hashes
        new = np.flatnonzero(~there)
        ids, off = self._merge_points(flat, begin[new], end[new])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.zeros((len(hashes), 2), np.int64)
        at[there] = self.known_at[spot[there]]
        at[new] = np.stack([off[:-1], off[1:]], 1) + self.used
        self.used += len(ids)
        self.known = np.insert(self.known, spot[new], hashes[new])
        self.known_at = np.insert(self.known_at, spot[new], at[new], axis=0)
        return at

    def _merge_points(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as spans of code points: (ids, offsets by piece)."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lengths = end - begin
        chars = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        point = flat[chars]
        width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        data = np.frombuffer(point.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(lengths)])]
        return self.encode_words(data, edge[:-1], edge[1:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: (ids, offsets by text)."""
        parts, owners = [], []
        for i, text in enumerate(texts):
            rest = text or ""
            while hits := [(p, s) for s in self.special if (p := rest.find(s)) >= 0]:
                p, s = min(hits)
                parts += [rest[:p], s]
                owners += [i, i]
                rest = rest[p + len(s) :]
            parts.append(rest)
            owners.append(i)
        if len(parts) == len(texts):
            return self.encode_texts(parts)
        ids, off = self.encode_texts(["" if p in self.special else p for p in parts])
        runs = [[self.special[p]] if p in self.special else ids[off[k] : off[k + 1]] for k, p in enumerate(parts)]
        size = np.bincount(owners, [len(r) for r in runs], len(texts)).astype(np.int64)
        return np.concatenate(runs).astype(np.int32), np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, since the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if tokens[i]])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file, read once in a process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encoded(batch_text: pa.Array, tokenizer: WordBpe):
    """(first row, ids, offsets) of runs of whole texts of a column."""
    _, off = tx.buffers(batch_text)
    for lo, hi in tx.spans(off):
        ids, at = tokenizer.encode(batch_text.slice(lo, hi - lo).to_pylist())
        yield lo, ids, at


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Adds ``ids`` (array<int>) and ``decoded`` (string), or with ``digest`` the columns n_tokens,
    ids_sha256 and decoded_sha256 in their place, to the columns ``keep`` (all by default; ones
    of the same names are replaced).
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    schema = ", ".join(filter(None, [fields(docs, keep), "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"]))
    read = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        tok = load(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in new]
            for _, ids, off in encoded(batch.column(read.index(text_col)), tok):
                flat = ids.tolist()
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    own = flat[a:b]
                    decoded = tok.decode(own)
                    if digest:
                        number = tok.decimal
                        out[0].append(b - a)
                        out[1].append(hashlib.sha256(" ".join([number[i] for i in own]).encode()).hexdigest())
                        out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        out[0].append(own)
                        out[1].append(decoded)
            types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
            yield tx.with_columns(batch, keep, **{n: pa.array(v, t) for n, v, t in zip(new, out, types, strict=True)})

    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)
