"""Operator 7: language-model scores from a hierarchical Pitman-Yor model.

Each word has a restaurant of the words behind it (the end token's is of first words); the parent
of these is one word restaurant, whose customers are their tables.  Its base is a spelling model,
whose customers are the word restaurant's tables: restaurants of byte contexts of up to ``ORDER``
bytes, where each context's parent is the context without its oldest byte, up to one restaurant
over equal chances.  A customer of a restaurant is served a dish that is there already or opens a
table, and each table sends one customer to the parent.

Seating is sampled by Gibbs sweeps: in each sweep the customers of every dish leave and come back
one after another, each opening a table with the chance that the Chinese-restaurant process gives
under the parent's probabilities and the restaurant's tables of the sweep before.  The spelling
model is fitted to the tables of the first ``FITS`` sweeps.  In each sweep the word restaurant is
seated under several guesses of its tables and goes on from where guess and outcome agree (in the
second, twice as far, as tables and spelling pull each other on).  Once tables and customers of the
word restaurant change by less than ``SETTLED`` from one sweep to the next, ``SAMPLES`` seatings are
taken and probabilities are averaged over them.  In every seating the seats add up, so the chances
of all words behind a word, unseen ones included, add up to 1.  Discounts come from the numbers of
dishes met once and twice.

Words that training didn't meet count as one word, as they do in the base score: its base
probability is what the spelling model leaves outside the training vocabulary.

Where things are computed: documents are packed into blocks of whole texts; a block lists its
distinct words and word pairs with their training counts, which are sent in ranges of sorted keys,
summed over all blocks, and fetched back by each block for its own keys.  So every training token
and pair counts, and no table of words or pairs is broadcast or collected.  The first block that
trains on a key owns it.  A pair met once always has one table, so sweeps go over the owned pairs
met more often and the words they hold; tables by word and by context are summed the same way as
counts.  Only the spelling model is sent around: at most 64^4 cells over its alphabet of the 62
most frequent bytes, an end, and one symbol for all others, whose bytes share its chance equally.

Defined results: a null or empty text is its end token alone; without training rows N = V = 0 and
all tokens are one unseen word, whose base and score are 0; repeated rows, also of one id or a
null id, count each time; an empty table gives no rows; a text beyond ``tx.CHUNK_BYTES`` is read in
pieces cut between words.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import forget, frozen, give_back, scratch, small_batches, tidy

ORDER, SYMBOLS = 3, 64
BLOCK_BYTES = 5 << 20
#: Text whose words are found together, so that their numbers fit a processor's cache.
RUN_BYTES = 1 << 18
#: Tokens to a range of keys whose sums are taken together.
PART_TOKENS = 1 << 20
#: Seatings of the spelling model that are passed over and that count.
BURN_IN, SPELLINGS = 2, 3
#: Seatings of words that count; the change of tables at which earlier sweeps end, the most of these, and
#: those that fit the spelling model anew.
SAMPLES, SETTLED, MOST_SWEEPS, FITS = 2, 0.02, 12, 2
STRENGTH = 1.0
#: Dishes that are seated together.
SEATED = 1 << 14
END = 10


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each key's number."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return found[new], order[new], number


class Words:
    """Distinct words of a block, found run by run."""

    def __init__(self):
        self.hashes, self.letters, self.sizes, self.which = [], [], [], []

    def add(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Take in a run of texts; the words in each."""
        h, starts, ends, counts = tx.words(data, off, tx.SPACES_LOWER)
        found, first, which = distinct(h)
        letters, at = gather(tx.SPACES_LOWER[data], starts[first], ends[first])
        self._keep(found, letters, np.diff(at), which)
        return counts

    def _keep(self, found, letters, sizes, which) -> None:
        self.hashes.append(found)
        self.letters.append(letters)
        self.sizes.append(sizes)
        self.which.append(which)

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(letters of the distinct words sorted by hash, a space behind each; words by number; sizes; the end's number)."""
        ending = np.array([END], np.uint8)
        self._keep(tx.span_hash(tx.BYTE_VALUES[ending], np.zeros(1, np.int64), np.ones(1, np.int64)), ending, np.ones(1, np.int64), np.zeros(1, np.uint32))
        _, first, number = distinct(np.concatenate(self.hashes))
        size = np.concatenate(self.sizes)
        stop = np.cumsum(size)
        letters, at = gather(np.concatenate(self.letters), stop[first] - size[first], stop[first])
        size = np.diff(at)
        spaced = np.full(len(letters) + len(size), 32, np.uint8)
        spaced[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
        base = np.cumsum([0, *map(len, self.hashes)])
        which = [number[a + w] for a, w in zip(base, self.which, strict=False)]
        return spaced, np.concatenate(which[:-1]), size, int(which[-1][0])


def runs(data: np.ndarray, off: np.ndarray, limit: int = tx.CHUNK_BYTES):
    """(first text, bytes, offsets): runs of about limit bytes; a longer text goes in pieces cut between words."""
    for a, b in tx.spans(off, limit):
        lo, hi = int(off[a]), int(off[b])
        while b == a + 1 and hi - lo > limit:
            gaps = np.flatnonzero(tx.SPACES[data[lo + 1 : lo + limit]] == 0)
            if not len(gaps):
                break  # one word of this size
            cut = lo + 1 + int(gaps[-1])
            yield a, data[lo:cut], np.array([0, cut - lo])
            lo = cut
        yield a, data[lo:hi], np.maximum(off[a : b + 1], lo) - lo


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return data[np.repeat(starts - off[:-1], size) + np.arange(off[-1])], off


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles at u of binomials: summed up from 0 to a mean of 8, beyond by the normal limit."""
    turn = p > 0.5
    q, u = np.where(turn, 1 - p, p), np.where(turn, 1 - u, u)
    mean, out = n * q, np.zeros(len(n))
    many = np.flatnonzero(mean > 8)
    if len(many):
        a, x = 0.147, np.clip(2 * u[many] - 1, -1 + 1e-12, 1 - 1e-12)
        half = np.log(1 - x * x) / 2
        z = np.sign(x) * np.sqrt(2 * (np.sqrt((2 / (np.pi * a) + half) ** 2 - 2 * half / a) - 2 / (np.pi * a) - half))
        out[many] = np.clip(np.rint(mean[many] + z * np.sqrt(mean[many] * (1 - q[many]))), 0, n[many])
    few = np.flatnonzero(mean <= 8)
    size, odds, left = n[few], q[few] / (1 - q[few]), u[few]
    mass, got = (1 - q[few]) ** size, 0
    if 0 < len(few) <= 256:  # all masses that a draw can tell from 0 side by side, fewer calls than one number after another
        most = mean[few].max()
        steps = np.arange(int(most + 9 * np.sqrt(most)) + 12)
        table = np.cumprod(np.maximum(size[:, None] - steps, 0) / (steps + 1) * odds[:, None], axis=1)
        sums = np.cumsum(np.concatenate([mass[:, None], mass[:, None] * table], axis=1), axis=1)
        out[few] = np.minimum((sums < left[:, None]).sum(1), size)
        few = few[:0]
    while len(few):
        left = left - mass
        on = np.flatnonzero((left > 0) & (got < size))
        few, size, odds, left, mass = few[on], size[on], odds[on], left[on], mass[on]
        mass = mass * (size - got) / (got + 1) * odds
        got += 1
        out[few] = got
    return np.where(turn, n - out, out)


def seat(count: np.ndarray, fresh: np.ndarray, discount: float, draw) -> np.ndarray:
    """Tables of each dish after its customers came, run by run.

    fresh: (strength + discount * tables of the restaurant) * parent's probability of the dish;
    draw(step, who) gives uniform numbers.  A run is a sixth of those seated, one customer at
    least; its new tables are a binomial draw under the chance in its middle.

    Dishes go by falling count, so those with customers left stand first, in groups that fit a
    processor's cache.  A run opens none with a chance of 1 - many * chance at least, so only
    draws above that need a binomial's quantile.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    dishes = np.flatnonzero(count > 1)
    dishes = dishes[np.argsort((65535 - np.minimum(count[dishes], 65535)).astype(np.uint16), kind="stable")]
    top = int(np.searchsorted(-count[dishes], -65534))
    dishes[:top] = dishes[:top][np.argsort(-count[dishes[:top]], kind="stable")]
    for a in range(0, len(dishes), SEATED):
        who = dishes[a : a + SEATED]
        c, f, t, k, step, live = count[who], fresh[who], np.ones(len(who)), 1, 0, len(who)
        falling = -c
        while live:  # dishes with more than k customers
            run, fs, ts = max(1, k // 6), f[:live], t[:live]
            u = draw(step, who[:live])
            if run == 1:
                ts += u < fs / (fs + np.maximum(k - discount * ts, 1e-9))
            else:
                many = np.minimum(run, c[:live] - k)
                chance = fs / (fs + np.maximum(k + (many - 1) / 2 - discount * ts, 1e-9))
                some = np.flatnonzero(u >= 1 - many * chance)
                ts[some] += binomial(many[some], chance[some], u[some])
            k, step = k + run, step + 1
            live = int(np.searchsorted(falling, -k))
        tables[who] = t
    return tables


def discount_of(once: int, twice: int) -> float:
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95))


class Spelling:
    """Averaged predictive probabilities of symbols in byte contexts: ``logs`` [contexts, symbols] in log10."""

    def __init__(self, histogram: np.ndarray, cells: tuple[np.ndarray, np.ndarray], seed: int = 3):
        """cells: codes in ascending order, ((oldest * 64 + ..) * 64 + youngest) * 64 + symbol, 0 before a word; their counts."""
        self.symbol = symbols_of(histogram)
        rare = max(1, int((self.symbol == SYMBOLS - 1).sum()))
        self.rare_log = -np.log10(rare)
        codes, numbers = cells
        levels = []  # order 3 first: contexts, cell rows, symbols, counts
        for d in range(ORDER, -1, -1):
            own = codes % SYMBOLS ** (d + 1)
            levels.append([np.unique(own // SYMBOLS), *np.unique(own, return_inverse=True)])
        rng = np.random.RandomState(seed)
        width, total = SYMBOLS, None
        shares = [np.full((len(lv[0]), width), 1 / width) for lv in levels]
        tables_in = [np.zeros(len(lv[0])) for lv in levels]
        for sweep in range(BURN_IN + SPELLINGS):
            customers, below = numbers.astype(np.int64), codes
            stats = []
            for i, lv in enumerate(levels):  # customers climb from the longest contexts to the shortest
                d = ORDER - i
                own = below % SYMBOLS ** (d + 1)
                cell, at = np.unique(own, return_inverse=True)
                count = np.bincount(at, customers, len(cell)).astype(np.int64)
                row, sym = np.searchsorted(lv[0], cell // width), cell % width
                parent = shares[i + 1][np.searchsorted(levels[i + 1][0], lv[0][row] % SYMBOLS ** (d - 1)) if d else 0, sym] if d else np.full(len(cell), 1 / width)
                a = discount_of(int((count == 1).sum()), int((count == 2).sum()))
                t = seat(count, (STRENGTH + a * tables_in[i][row]) * parent, a, lambda step, who: rng.rand(len(who)))
                tables_in[i] = np.bincount(row, t, len(lv[0]))
                stats.append((row, sym, count, t, a))
                below, customers = cell, t.astype(np.int64)
            above = np.full((1, width), 1 / width)
            for i in range(ORDER, -1, -1):  # probabilities descend
                row, sym, count, t, a = stats[i]
                contexts = levels[i][0]
                d = ORDER - i
                parent = above[np.searchsorted(levels[i + 1][0], contexts % SYMBOLS ** (d - 1))] if d else above
                inside = np.bincount(row, count, len(contexts))[:, None]
                share = (STRENGTH + a * tables_in[i][:, None]) * parent
                np.add.at(share, (row, sym), count - a * t)
                share = share / (STRENGTH + inside) if len(contexts) else share
                shares[i] = above = share
            if sweep >= BURN_IN:
                total = [s.copy() for s in shares] if total is None else [x + s for x, s in zip(total, shares, strict=True)]
        rows = np.concatenate([x / SPELLINGS for x in total[::-1]]) if len(codes) else np.full((1, width), 1 / width)
        self.logs = np.log10(np.maximum(rows, 1e-30)).astype(np.float32)
        # the longest known context of any three symbols
        self.row = np.zeros(SYMBOLS**ORDER, np.int32)
        base = 0
        for d, lv in enumerate(levels[::-1]):
            full = np.full(SYMBOLS**d, -1)
            full[lv[0]] = base + np.arange(len(lv[0]))
            each = full[np.arange(SYMBOLS**ORDER) % SYMBOLS**d]
            self.row = np.where(each >= 0, each, self.row).astype(np.int32)
            base += len(lv[0])

    def log10(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each spelled token."""
        out = []
        for a, b in tx.spans(off, 1 << 17, len(off)):
            s, code, word = spelled(data[off[a] : off[b]], off[a : b + 1] - off[a], self.symbol)
            value = self.logs[self.row[code], s].astype(np.float64) + np.where(s == SYMBOLS - 1, self.rare_log, 0.0)
            out.append(np.bincount(word, value, b - a))
        return np.concatenate(out) if out else np.zeros(0)


def symbols_of(histogram: np.ndarray) -> np.ndarray:
    """Byte to symbol: 1..62 for the most frequent bytes, 63 for all others; 0 is the start and the end."""
    out = np.full(256, SYMBOLS - 1)
    top = [b for b in np.argsort(-histogram, kind="stable")[: SYMBOLS - 2] if histogram[b]]
    out[sorted(top)] = np.arange(1, len(top) + 1)
    return out


def spelled(data: np.ndarray, off: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of tokens, an end (0) behind each: (symbol, code of the three before, token)."""
    size = np.diff(off) + 1
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - begin[word]
    s = np.zeros(len(word), np.int64)
    s[np.arange(len(data)) + np.repeat(np.arange(len(size)), size - 1)] = symbol[data]
    code = np.zeros(len(word), np.int64)
    for k in range(ORDER, 0, -1):
        before = np.zeros(len(word), np.int64)
        before[k:] = s[:-k] if len(s) > k else s[:0]
        code = code * SYMBOLS + np.where(place >= k, before, 0)
    return s, code, word


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Values in bytes: how many of a value's lower bytes are kept (those above are 0 in all), then each of them for all values."""
    raw = np.ascontiguousarray(values, kind)
    width = raw.itemsize
    used = max(1, -(-int(raw.view(f"u{width}").max(initial=0)).bit_length() // 8))
    if width > 1:
        raw = np.ascontiguousarray(raw.reshape(-1).view("u1").reshape(-1, width)[:, :used].T)
    return bytes([used]) + _packer.compress(raw)


def _unpack(cell: pa.Scalar | bytes, kind: str) -> np.ndarray:
    cell = memoryview(cell if isinstance(cell, bytes) else cell.as_buffer())
    used, width, raw = cell[0], np.dtype(kind).itemsize, np.frombuffer(_unpacker.decompress(cell[1:]), "u1")
    if width == 1:
        return raw.view(kind)
    out = np.zeros((len(raw) // used, width), "u1")
    out[:, :used] = raw.reshape(used, -1).T
    return out.view(kind).reshape(-1)


def _listed(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(letters, offsets) of distinct words, which stand with a space behind each, sorted by hash."""
    letters = _unpack(cell, "u1")
    ends = np.flatnonzero(letters == 32)
    off = np.concatenate([[0], ends + 1 - np.arange(1, len(ends) + 1)])
    return letters[letters != 32], off


def _chosen(letters: np.ndarray, off: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The letters and spaces of some words of a list."""
    return letters[np.repeat(part, np.diff(off) + 1)]


def _hashes(letters: np.ndarray, off: np.ndarray) -> np.ndarray:
    return tx.span_hash(tx.BYTE_VALUES[letters], off[:-1], off[1:])


def _draws(keys: np.ndarray):
    """Uniform numbers for seat(), drawn from the dishes' keys: every block seats a dish alike."""

    def draw(step, who):
        x = keys.take(who)
        x += np.array([step], tx.U64) * tx.ODDS[30]
        x = tx.mix(x)
        x >>= tx.U64(11)
        out = x.astype(np.float64)
        out *= 2.0**-53
        return out

    return draw


def drawn_tables(keys: np.ndarray, count: np.ndarray, fresh: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of one sweep's seating; a dish met once has one."""
    return drawn_together(keys, [(count, fresh, sweep)], discount)[0]


def drawn_together(keys: np.ndarray, seatings: list[tuple], discount: float) -> list[np.ndarray]:
    """Tables of several seatings (count, fresh, sweep) of the same dishes, which take their steps together."""
    live = [np.flatnonzero(count > 1) for count, _, _ in seatings]
    own = np.concatenate([keys[x] + np.array([1 + sweep * 100_003], tx.U64) * tx.ODDS[30] for x, (_, _, sweep) in zip(live, seatings, strict=True)])
    count, fresh = (np.concatenate([each[i][x] for x, each in zip(live, seatings, strict=True)]) for i in (0, 1))
    seated, at, out = seat(count, fresh, discount, _draws(own)), 0, []
    for x, (count, _, _) in zip(live, seatings, strict=True):
        tables = np.minimum(count, 1).astype(np.float64)
        tables[x] = seated[at : at + len(x)]
        out.append(tables)
        at += len(x)
    return out


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as the steps between them."""
    return _pack(np.diff(keys, prepend=tx.U64(0)), "<u8")


def _words(cell: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(cell, "<u8"), dtype=np.uint64)


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of pairs of words, given their hashes."""
    return tx.mix(first * tx.ODDS[31] + second)


def _pairs(seq: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word before, word) of a block by key: (before, word, key, pair of each token).

    The word before a text's first is the end token, which stands last in a block.
    """
    before = np.concatenate([seq[-1:], seq[:-1]])
    key = (hashes * tx.ODDS[31])[before]
    key += hashes[seq]
    key, at, which = distinct(tx.mix(key))
    return before[at], seq[at], key, which


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of whole documents: key, ids, flags, token counts, tokens as places in the list of distinct words, and that list."""

    def run(batches):
        number = 0
        for batch in batches:
            data_all, off_all = tx.buffers(batch.column(2))
            for lo, hi in tx.spans(off_all, BLOCK_BYTES, len(off_all)):
                words, sizes = Words(), np.ones(hi - lo, np.int64)
                for a, data, off in runs(data_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo], RUN_BYTES):
                    sizes[a : a + len(off) - 1] += words.add(data, off)
                letters, flat, size, end = words.close()
                seq = np.full(sizes.sum(), end, np.uint32)
                seq[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = flat
                train = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                met = np.bincount(seq[np.repeat(train, sizes)], minlength=len(size)) > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                        "ids": pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                        "train": pa.array([train.tolist()], pa.list_(pa.bool_())),
                        "sizes": [_pack(sizes, "<i8")],
                        "seq": [_pack(seq, "<u4")],
                        "letters": [_pack(letters, "u1")],
                        "n": pa.array([len(seq)], pa.int64()),
                        "histogram": pa.array([np.bincount(letters[np.repeat(met, size + 1)], minlength=256).tolist()], pa.list_(pa.int64())),
                    }
                )
                del words, flat, seq, letters
                give_back()
                number += 1

    return rows.mapInArrow(run, "block bigint, ids array<bigint>, train array<boolean>, sizes binary, seq binary, letters binary, n bigint, histogram array<bigint>")


def _rows(batches):
    """Each row of the batches as a dictionary of scalars; what a batch, which ends with its first large row, needed is given back to the system before the next."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}
        give_back()


def _buckets(spark) -> int:
    """Half as many as shuffle partitions: what a block's rows need is little beside what a task costs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 1)


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """As frozen(), in buckets by block, so that joins by block move only sides that are not."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "objectlens_" + path.rsplit("-", 1)[1]
    df.write.option("path", path).bucketBy(_buckets(spark), "block").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return found


#: A sending of a block to one range of keys: kind (0 words, 1 pairs), sorted keys and rows of numbers.
SENDING = "kind int, part int, block bigint, keys binary, numbers binary"


def _sendings(block: int, kind: int, keys: np.ndarray, numbers: np.ndarray, bits: int):
    """Sorted keys of a block with their numbers [k, keys], cut at the ranges of their highest bits; all ranges in one batch."""
    edges = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << tx.U64(64 - bits)), len(keys))
    parts = np.flatnonzero(np.diff(edges))
    steps, cells = [], []
    for part in parts:
        a, b = edges[part], edges[part + 1]
        steps.append(_steps(keys[a:b]))
        cells.append(_pack(numbers[:, a:b], "<i4"))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(parts), kind), pa.int32()), pa.array(parts, pa.int32()), pa.array(np.full(len(parts), block), pa.int64()), pa.array(steps, pa.binary()), pa.array(cells, pa.binary())],
        names=["kind", "part", "block", "keys", "numbers"],
    )


def _summed(sent: DataFrame, name: str, wanted: int = 0) -> tuple[DataFrame, dict[int, tuple]]:
    """Sums of all blocks' numbers by key, back in the order of each block's keys.

    Returns a row for each block, with the parts' sums and whether the block owns a key (is the first whose
    first number isn't 0), and by kind the sum, keys above 0, at 1 and at 2 of the first number.  Blocks
    below wanted send numbers but get no row.
    """

    def settle(kind, part, pieces):
        keys = np.concatenate([k for _, k, _ in pieces])
        numbers = np.concatenate([x for _, _, x in pieces], axis=1)
        found, at = np.unique(keys, return_inverse=True)
        del keys
        sums = np.stack([np.bincount(at, x, len(found)) for x in numbers]).astype("<i8")
        some = np.flatnonzero(numbers[0])[::-1]
        first = np.full(len(found), -1)
        first[at[some]] = some
        owned = np.zeros(len(at), "u1")
        owned[first[first >= 0]] = 1
        stop = np.cumsum([len(k) for _, k, _ in pieces])
        spans = list(zip(stop - [len(k) for _, k, _ in pieces], stop, strict=True))
        stats = [int(sums[0].sum()), *[int(x.sum()) for x in (sums[0] > 0, sums[0] == 1, sums[0] == 2)]]
        kept = [i for i, (block, _, _) in enumerate(pieces) if block >= wanted]
        if not kept:
            return
        pieces, spans = [pieces[i] for i in kept], [spans[i] for i in kept]
        told = lambda value: pa.array([value] + [0] * (len(pieces) - 1), pa.int64())  # noqa: E731, stands in the first row
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([kind] * len(pieces), pa.int32()), "part": pa.array([part] * len(pieces), pa.int32()), "block": pa.array([block for block, _, _ in pieces], pa.int64()),
                "sums": pa.array([_pack(sums[:, at[a:b]], "<i8") for a, b in spans], pa.binary()), "owned": pa.array([_pack(owned[a:b], "u1") for a, b in spans], pa.binary()),
                **dict(zip(("total", "types", "once", "twice"), map(told, stats), strict=True)),
            }
        )

    def run(batches):
        now, pieces = None, []
        for r in _rows(batches):
            key = r["kind"].as_py(), r["part"].as_py()
            if key != now:
                if pieces:
                    yield from settle(*now, pieces)
                now, pieces = key, []
            keys = _words(r["keys"])
            pieces.append((r["block"].as_py(), keys, _unpack(r["numbers"], "<i4").reshape(-1, len(keys))))
        if pieces:
            yield from settle(*now, pieces)

    rows = sent.repartition("kind", "part").sortWithinPartitions("kind", "part", "block")
    back = rows.mapInArrow(run, "kind int, part int, block bigint, sums binary, owned binary, total bigint, types bigint, once bigint, twice bigint")
    told = [F.sum(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}{kind}") for kind in (0, 1) for c in ("total", "types", "once", "twice")]
    found = _bucketed(back.repartition(_buckets(sent.sparkSession), "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "sums", "owned"))).alias("back"), *told), name)
    told = found.agg(*[F.sum(c) for c in found.columns[2:]]).head()
    stats, found = {kind: tuple(told[4 * kind : 4 * kind + 4]) for kind in (0, 1) if told[4 * kind] is not None}, found.select("block", "back")
    tidy(sent.sparkSession)
    return found, stats


def _fetched(cell: pa.Scalar, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums [width, keys], owned) of a block from the parts of one kind."""
    parts = [x for x in cell if x["kind"].as_py() == kind] if cell.is_valid else []
    if not parts:
        return np.zeros((width, 0), np.int64), np.zeros(0, bool)
    return np.concatenate([_unpack(x["sums"], "<i8").reshape(width, -1) for x in parts], axis=1), np.concatenate([_unpack(x["owned"], "?") for x in parts])


def _cells(code: np.ndarray, s: np.ndarray, weight: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and their weights added up; symbols below ``used``, and the last, occur."""
    place, width = np.append(np.arange(used), np.full(SYMBOLS - used, used)), used + 1
    if width ** (ORDER + 1) > 4 << 20:
        found, at = np.unique((code * SYMBOLS + s).astype(np.int32), return_inverse=True)
        return found, np.bincount(at, weight, len(found))
    narrow, full = place[s], np.append(np.arange(used), SYMBOLS - 1)
    for k in range(ORDER):
        narrow = narrow + place[code // SYMBOLS**k % SYMBOLS] * width ** (k + 1)
    sums = np.bincount(narrow, weight)
    found = np.flatnonzero(sums)
    return sum(full[found // width**k % width] * SYMBOLS**k for k in range(ORDER + 1)), sums[found]


def agreed(guesses: np.ndarray, outcomes: np.ndarray) -> float:
    """Where outcomes, which grow less than their guesses, agree with these."""
    over = outcomes - guesses
    at = int(np.clip(np.flatnonzero(over >= 0).max(initial=0), 0, len(over) - 2))
    slope = (over[at + 1] - over[at]) / (guesses[at + 1] - guesses[at]) if guesses[at + 1] > guesses[at] else -1.0
    return float(guesses[at] - over[at] / slope) if slope < 0 else float(outcomes[-1])


class Seating:
    """The numbers of one state of the word restaurant: customers, tables before and now, discount."""

    def __init__(self, customers: int, before: float, tables: float, discount: float, sweep: int):
        self.customers, self.before, self.tables, self.discount, self.sweep = customers, before, tables, discount, sweep

    def fresh(self, base: np.ndarray, before: float | None = None) -> np.ndarray:
        return (STRENGTH + self.discount * (self.before if before is None else before)) * base

    def chances(self, served: np.ndarray, base: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Each word's probability in the word restaurant, given the tables drawn for it."""
        share = served - self.discount * tables + (STRENGTH + self.discount * self.tables) * base
        return (share / (STRENGTH + self.customers)).astype(np.float32)

    def novel(self, outside: float) -> np.float32:
        """The probability of the unseen word."""
        return np.float32((STRENGTH + self.discount * self.tables) * outside / (STRENGTH + self.customers))


class Drawn:
    """Tables of often served dishes that a task has drawn under one seating; the next of its blocks need the same."""

    def __init__(self, often: int = 12, most: int = 1 << 18):
        self.often, self.most, self.keys, self.held = often, most, np.zeros(0, np.uint64), np.zeros(0)

    def tables(self, keys: np.ndarray, served: np.ndarray, fresh: np.ndarray, now: Seating) -> np.ndarray:
        """keys: sorted."""
        t, often = np.zeros(len(keys)), np.flatnonzero(served > self.often)
        at = np.searchsorted(self.keys, keys[often])
        known = self.keys.take(at, mode="clip") == keys[often] if len(self.keys) else np.zeros(len(often), bool)
        t[often[known]] = self.held[at[known]]
        new = np.ones(len(keys), bool)
        new[often[known]] = False
        new, often = np.flatnonzero(new), often[~known][: self.most - len(self.keys)]
        t[new] = drawn_tables(keys[new], served[new], fresh[new], now.discount, now.sweep)
        place = np.searchsorted(self.keys, keys[often])
        self.keys, self.held = np.insert(self.keys, place, keys[often]), np.insert(self.held, place, t[often])
        return t


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", per_token: bool = False) -> DataFrame:
    """id_col, train, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text.

    train: boolean column, the rows to learn from; null learns nothing.  per_token adds
    ``token_scores``: the log10 probability of each token, the end's last.
    """
    with small_batches(docs.sparkSession, "4m"):
        return _scored(docs, train, id_col, text_col, per_token)


def _scored(docs: DataFrame, train: Column, id_col: str, text_col: str, per_token: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession, "16m"):
        blocks = _bucketed(_blocks(rows), "lm-blocks")
    bits = int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] // PART_TOKENS).bit_length()
    bits = max(4, bits - 3), max(4, bits)  # a block has some eight times as many pairs as words
    histogram = np.zeros(256, np.int64)
    for r in blocks.select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        histogram[r["pos"]] = r["n"]

    def count(batches):
        for r in _rows(batches):
            block, seq = r["block"].as_py(), _unpack(r["seq"], "<u4")
            words = _hashes(*_listed(r["letters"]))
            learnt = np.repeat(np.array(r["train"].as_py(), bool), _unpack(r["sizes"], "<i8"))
            yield from _sendings(block, 0, words, np.bincount(seq[learnt], minlength=len(words))[None], bits[0])
            _, _, keys, which = _pairs(seq, words)
            yield from _sendings(block, 1, keys, np.bincount(which[learnt], minlength=len(keys))[None], bits[1])

    totals, stats = _summed(blocks.select("block", "train", "sizes", "seq", "letters").mapInArrow(count, SENDING), "lm-sums")
    n, v = stats.get(0, (0, 0))[:2]
    pairs_n, pair_types, *met = stats.get(1, (0, 0, 0, 0))
    pair_discount = discount_of(*met)

    known = blocks.join(totals, "block")

    def owned(batches):
        """The pairs that a block owns: those met more than once, tables of all by word and by context, and their words."""
        for r in _rows(batches):
            letters, off = _listed(r["letters"])
            words = _hashes(letters, off)
            first, second, _, _ = _pairs(_unpack(r["seq"], "<u4"), words)
            total, own = _fetched(r["back"], 1, 1)
            mine = _fetched(r["back"], 0, 1)[1]
            opened = np.stack([np.bincount(x[own], minlength=len(mine)) for x in (second, first)])
            heavy = np.flatnonzero(own & (total[0] > 1))
            part = mine | (opened.sum(0) > 0)
            place = np.cumsum(part, dtype=np.int64) - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([r["block"].as_py()], pa.int64()),
                    "letters": [_pack(_chosen(_unpack(r["letters"], "u1"), off, part), "u1")],
                    "keys": [_steps(words[part])],
                    "mine": [_pack(mine[part], "u1")],
                    "least": [_pack(opened[:, part], "<i8")],
                    "first": [_pack(place[first[heavy]], "<u4")],
                    "second": [_pack(place[second[heavy]], "<u4")],
                    "count": [_pack(total[0][heavy], "<i8")],
                }
            )

    def opened(batches):
        """Tables by word and by context where every pair has one."""
        for r in _rows(batches):
            yield from _sendings(r["block"].as_py(), 0, _words(r["keys"]), _unpack(r["least"], "<i8").reshape(2, -1), bits[0])

    def narrowed(batches):
        """Only words that a block seats: its own ones and those in its pairs met more than once."""
        for r in _rows(batches):
            letters, off = _listed(r["letters"])
            first, second, mine = _unpack(r["first"], "<u4"), _unpack(r["second"], "<u4"), _unpack(r["mine"], "?")
            part = mine.copy()
            part[first] = part[second] = True
            place = np.cumsum(part, dtype=np.int64) - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([r["block"].as_py()], pa.int64()),
                    "letters": [_pack(_chosen(_unpack(r["letters"], "u1"), off, part), "u1")],
                    "keys": [_steps(_words(r["keys"])[part])],
                    "mine": [_pack(mine[part], "u1")],
                    "least": [_pack(_fetched(r["back"], 0, 2)[0][:, part], "<i8")],
                    "first": [_pack(place[first], "<u4")],
                    "second": [_pack(place[second], "<u4")],
                    "count": [r["count"].as_py()],
                }
            )

    seating = "block bigint, letters binary, keys binary, mine binary, least binary, first binary, second binary, count binary"
    held = _bucketed(known.select("block", "seq", "letters", "back").mapInArrow(owned, seating), "lm-owned")
    least, _ = _summed(held.select("block", "keys", "least").mapInArrow(opened, SENDING), "lm-least")
    seats = _bucketed(held.drop("least").join(least, "block").mapInArrow(narrowed, seating), "lm-seats")
    forget(held)
    forget(least)
    tidy(docs.sparkSession)
    context = docs.sparkSession.sparkContext

    def state(r, column: str = "back") -> np.ndarray:
        """Customers of each of a block's words in the word restaurant, and tables in its own: [2, words]."""
        least = _unpack(r["least"], "<i8").reshape(2, -1)
        return least + _fetched(r[column], 0, 2)[0] if r[column].is_valid else least

    def spelled_out(seated: DataFrame, spelling) -> DataFrame:
        """Blocks with the spelling model's chance of each of their words, written anew."""

        def run(batches):
            for r in _rows(batches):
                base = spelling.value.log10(*_listed(r["letters"]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"].as_py()], pa.int64()), "base": [_pack(np.power(10.0, np.maximum(base, -300)), "<f8")]})

        based = _bucketed(seated.select("block", "letters").mapInArrow(run, "block bigint, base binary"), "lm-base")
        spelling.destroy()
        return based

    def words_seated(seated: DataFrame, now: Seating, first: bool, cells: bool, guesses: list[float]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Byte cells of the word restaurant's tables; its tables, dishes met once and twice, base mass, and tables under guesses.

        first: each customer has a table.
        """
        tallies = 4 + len(guesses)

        def run(batches):
            symbol = symbols_of(histogram)
            used = int(symbol[symbol < SYMBOLS - 1].max(initial=0)) + 1
            for r in _rows(batches):
                mine = _unpack(r["mine"], "?")
                served = state(r)[0][mine]
                words = _words(r["keys"])[mine]
                base = np.zeros(len(words)) if first else _unpack(r["base"], "<f8")[mine]
                t, *others = [served] if first else drawn_together(words, [(served, now.fresh(base, x), now.sweep) for x in (None, *guesses)], now.discount)
                codes, numbers = [np.arange(-tallies, 0)], [[t.sum(), (served == 1).sum(), (served == 2).sum(), base.sum(), *[x.sum() for x in others]]]
                if cells:
                    letters, off = _listed(r["letters"])
                    letters, off = gather(letters, off[:-1][mine], off[1:][mine])
                for a, b in tx.spans(off, 1 << 20, len(off)) if cells else ():
                    s, code, word = spelled(letters[off[a] : off[b]], off[a : b + 1] - off[a], symbol)
                    found, count = _cells(code, s, t[a:b][word], used)
                    codes.append(found)
                    numbers.append(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).astype(np.int64)), pa.array(np.concatenate(numbers).astype(np.float64))], names=["code", "n"])

        rows = seated.select(*[c for c in seated.columns if c in ("block", "keys", "mine", "least", "base", "back", *["letters"] * cells)])
        found = rows.mapInArrow(run, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
        code, number = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
        tallied = dict(zip(code[code < 0].tolist(), number[code < 0].tolist(), strict=True))
        return code[code >= 0], number[code >= 0].round().astype(np.int64), [tallied.get(k, 0.0) for k in range(-tallies, 0)]

    def pairs_seated(seated: DataFrame, now: Seating) -> tuple[DataFrame, int]:
        """Tables beyond the first of all pairs, by word and by context, and their number."""

        def run(batches):
            drawn = Drawn()
            for r in _rows(batches):
                words = _words(r["keys"])
                served, inside = state(r)
                base = _unpack(r["base"], "<f8")
                first, second, total = _unpack(r["first"], "<u4"), _unpack(r["second"], "<u4"), _unpack(r["count"], "<i8")
                asked = np.bincount(second, minlength=len(words)) > 0
                t = np.zeros(len(words))
                t[asked] = drawn.tables(words[asked], served[asked], now.fresh(base[asked]), now)
                chances = now.chances(served, base, t).astype(np.float64)  # of the words asked for
                fresh = (STRENGTH + pair_discount * inside[first]) * chances[second]
                t = drawn_tables(_key(words[first], words[second]), total, fresh, pair_discount, now.sweep) - 1
                yield from _sendings(r["block"].as_py(), 0, words, np.stack([np.bincount(x, t, len(words)) for x in (second, first)]), bits[0])

        moved, told = _summed(seated.drop("letters", "mine").mapInArrow(run, SENDING), "lm-seats")
        return moved, told.get(0, (0,))[0]

    def with_state(based: DataFrame | None, moved: DataFrame | None) -> DataFrame:
        rows = seats.join(based, "block") if based is not None else seats
        return rows.join(moved, "block") if moved is not None else rows.withColumn("back", F.lit(None).cast(totals.schema["back"].dataType))

    def fitted(code: np.ndarray, number: np.ndarray, last: DataFrame | None) -> DataFrame:
        if last is not None:
            forget(last)
        return spelled_out(seats, context.broadcast(Spelling(histogram, (code, number))))

    # sweeps until the tables settle
    code, number, tallied = words_seated(with_state(None, None), Seating(pair_types, 0, 0, 0.5, 0), True, True, [])
    based = fitted(code, number, None)
    now, moved, sweep, states, settled = Seating(pair_types, tallied[0], tallied[0], discount_of(*map(int, tallied[1:3])), 0), None, 0, [], not v
    guesses = np.geomspace(max(v, 1), max(pair_types, v, 1), 5).tolist()
    while not settled and sweep < MOST_SWEEPS:
        sweep += 1
        code, number, tallied = words_seated(with_state(based, moved), now, False, sweep <= FITS, guesses)
        tables = agreed(np.array(guesses), np.array(tallied[4:]))
        settled = sweep > FITS and abs(tables - now.before) <= SETTLED * tables
        if sweep <= FITS:
            based = fitted(code, number, based)
        if sweep == 2:
            tables = float(np.clip(2 * tables - now.before, v, now.customers))
        now, last = Seating(now.customers, tables, tables, discount_of(*map(int, tallied[1:3])), sweep), moved
        moved, more = pairs_seated(with_state(based, moved), now)
        if last is not None:
            forget(last)
        settled = settled and abs(pair_types + more - now.customers) <= SETTLED * now.customers
        now = Seating(pair_types + more, tables, tables, now.discount, sweep + 1)
        guesses = [0.9 * tables, 1.1 * tables]
    # seatings that count, under one spelling model and one discount, each with its own sums
    outside, seatings = 1.0, []
    for sample in range(SAMPLES + 1 if v else 0):
        tallied = words_seated(with_state(based, moved), now, False, False, [])[2]
        outside = max(1 - tallied[3], 1e-12)
        now = Seating(now.customers, now.before, tallied[0], now.discount, now.sweep)
        seatings.append(now)
        states.append(moved)
        if sample < SAMPLES:
            moved, more = pairs_seated(with_state(based, moved), now)
            now = Seating(pair_types + more, now.tables, now.tables, now.discount, now.sweep + 1)

    def told(batches):
        """The chance and tables in every seating of the words that a block owns."""
        for r in _rows(batches):
            mine = _unpack(r["mine"], "?")
            words, base = _words(r["keys"])[mine], _unpack(r["base"], "<f8")[mine]
            found = [state(r, f"s{k}")[:, mine] for k in range(len(seatings))]
            drawn = drawn_together(words, [(served, each.fresh(base), each.sweep) for (served, _), each in zip(found, seatings, strict=True)], seatings[0].discount)
            numbers = [x for (served, inside), each, t in zip(found, seatings, drawn, strict=True) for x in (each.chances(served, base, t).view("<i4"), inside.astype("<i4"))]
            yield from _sendings(r["block"].as_py(), 0, words, np.stack(numbers), bits[0])

    def asked(batches):
        for r in _rows(batches):
            words = _hashes(*_listed(r["letters"]))
            yield from _sendings(r["block"].as_py() + (1 << 62), 0, words, np.zeros((2 * len(seatings), len(words)), "<i4"), bits[0])

    final = None
    if seatings:
        every = seats.select("block", "keys", "mine", "least").join(based, "block")
        for k, moved in enumerate(states):
            every = every.join(moved.withColumnRenamed("back", f"s{k}"), "block")
        sent = every.mapInArrow(told, SENDING).unionByName(blocks.select("block", "letters").mapInArrow(asked, SENDING))
        final, _ = _summed(sent, "lm-final", 1 << 62)
        final = final.withColumn("block", F.col("block") - (1 << 62)).withColumnRenamed("back", "final")

    def score(batches):
        drawn = [Drawn() for _ in seatings[:-1]]
        for r in _rows(batches):
            sizes, seq = _unpack(r["sizes"], "<i8"), _unpack(r["seq"], "<u4")
            words = _hashes(*_listed(r["letters"]))
            total = _fetched(r["back"], 0, 1)[0][0]
            first, second, keys, which = _pairs(seq, words)
            met = _fetched(r["back"], 1, 1)[0][0]
            share = np.zeros(len(keys))
            numbers = _fetched(r["final"], 0, 2 * len(seatings))[0] if seatings else None
            chances, insides = [], []
            for k, each in enumerate(seatings):
                chances.append(np.where(total > 0, np.ascontiguousarray(numbers[2 * k].astype("<i4")).view("<f4"), each.novel(outside)).astype(np.float64))
                insides.append(STRENGTH + pair_discount * numbers[2 * k + 1])
            if seatings:
                del numbers
                more = np.flatnonzero(met > 1)
                t = np.minimum(met, 1).astype(np.float64)
                for k in range(SAMPLES):
                    fresh = insides[k][first[more]] * chances[k][second[more]]
                    t[more] = drawn[k].tables(keys[more], met[more], fresh, Seating(0, 0, 0, pair_discount, seatings[k].sweep))
                    share += (met - pair_discount * t + insides[k + 1][first] * chances[k + 1][second]) / (STRENGTH + total[first])
                del t, fresh, more
            values = np.log10(share / SAMPLES) if seatings else np.zeros(len(keys))
            at = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, at) for x in ((total > 0).astype(np.int64)[seq], np.log10((total + 1) / (n + v + 1))[seq], values[which])]
            ids, flags = r["ids"].as_py(), r["train"].as_py()
            out = {"id": pa.array(ids, pa.int64()), "train": pa.array(flags), "n_tokens": pa.array(sizes), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]), "perplexity": pa.array(np.power(10, -sums[2] / sizes))}
            if per_token:
                out["token_scores"] = pa.ListArray.from_arrays(pa.array(np.append(at, sizes.sum()), pa.int32()), pa.array(values[which]))
            yield pa.RecordBatch.from_pydict(out)

    whole = known.select("block", "ids", "train", "sizes", "seq", "letters", "back")
    whole = whole.join(final, "block") if final is not None else whole
    schema = "id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double" + ", token_scores array<double>" * per_token
    found = frozen(whole.drop("block").mapInArrow(score, schema), "lm-scores").withColumnRenamed("id", id_col)
    for left in (blocks, totals, seats, based, *states, *([final] if final is not None else [])):
        forget(left)
    return found
