"""Operator 6: token-id files of bit-plane shuffled blocks.

File format (``.bpl``, little-endian)::

    "BPLN" u32 version | plane data ... | footer (zstd of JSON index) | u64 footer length | "NLPB"

Ids are cut into blocks of ``block`` ids whatever the documents' bounds.  A block is transposed
into its planes (``kind="bit"``: one plane for each bit that any id of the block uses;
``kind="byte"``: one for each byte), each plane is compressed with zstandard on its own, and the
footer's chunk index names offset and length of every plane, so that a reader can fetch any block
alone.  Document ids and lengths are columns of their own in the file.

Layout: documents go to shards by ranges of (doc_id, a hash of the text, place in the input), so that
rows of one doc_id, however many, can be dealt to several shards; they are sorted the same way inside
a shard, and shards are numbered in ascending order, so that all files together hold the ids in
ascending doc_id order.  The number of shards grows with the text.  Defined results: a null or empty
text has only the end id; a null doc_id sorts first; rows of the same doc_id follow the hash of their
texts; other columns are left alone whatever their names; an empty table gives no shard.  A very long
text is encoded as one row and waits whole for its blocks.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlens.llm import bpe
from objectlens.llm.common import open_fs, scratch, write_once

BLOCK_IDS = 1 << 16
#: Bytes of text that one shard is meant to hold.
SHARD_TEXT_BYTES = 48 << 20
MAGIC, END = b"BPLN", b"NLPB"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first; planes above the highest bit in use are left out."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((top.bit_length() + 7) // 8)]
    planes = []
    for k in range((top.bit_length() + 7) // 8):
        byte = np.ascontiguousarray(raw[:, k])
        planes += [np.packbits(byte & (1 << b)).tobytes() for b in range(min(8, top.bit_length() - 8 * k))]
    return planes


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if kind == "byte":
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(k % 8)
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard to a stream, block by block."""

    def __init__(self, out, kind: str = "bit", block: int = BLOCK_IDS, level: int = 1):
        self.out, self.kind, self.block = out, kind, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.docs, self.lengths = 0, [], [], []
        self.wait, self.waiting = [], 0
        self._put(MAGIC + struct.pack("<I", 1))

    def _put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 8 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block
        for a in range(0, whole, self.block):
            own = ids[a : min(a + self.block, whole)]
            self.chunks.append([len(own), [self._put(self.press.compress(p)) for p in to_planes(own, self.kind)]])
        self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        ids = self._put(self.press.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes()))
        lengths = self._put(self.press.compress(np.array(self.lengths, "<i8").tobytes()))
        index = {"kind": self.kind, "block": self.block, "docs": len(self.docs), "ids": sum(self.lengths), "doc_ids": ids, "null_docs": [i for i, d in enumerate(self.docs) if d is None], "lengths": lengths, "chunks": self.chunks}
        footer = self.press.compress(json.dumps(index).encode())
        self._put(footer + struct.pack("<Q", len(footer)) + END)


class ShardReader:
    """Random access to a shard: ``docs`` and ``lengths``, and the ids of any range."""

    def __init__(self, path: str):
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != END or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(zstandard.decompress(self.file.read_at(n, size - 12 - n)))
        self.docs: list[int | None] = np.frombuffer(self._get(self.index["doc_ids"]), "<i8").tolist()
        for i in self.index["null_docs"]:
            self.docs[i] = None
        self.lengths = np.frombuffer(self._get(self.index["lengths"]), "<i8")

    def _get(self, at: list[int]) -> bytes:
        return zstandard.decompress(self.file.read_at(at[1], at[0]))

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        for n, planes in self.index["chunks"][first:]:
            yield from_planes([self._get(p) for p in planes], n, self.index["kind"])

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop; only their blocks are fetched."""
        block = self.index["block"]
        found, at = [], start // block * block
        for ids in self.blocks(start // block):
            found.append(ids[max(0, start - at) : stop - at])
            at += len(ids)
            if at >= stop:
                break
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def by_document(self) -> Iterator[tuple[int | None, np.ndarray]]:
        blocks, rest = self.blocks(), np.zeros(0, np.uint32)
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(next(blocks))
                have += len(parts[-1])
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc, joined[:n]
            rest = joined[n:]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, kind: str = "bit", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_IDS, shard_text_bytes: int = SHARD_TEXT_BYTES) -> list[dict]:
    """Encode every whole text, append end_id, and write shards in ascending id order into folder.

    Returns the manifest, also stored as ``manifest.json``: shard, path, docs, ids, start.  The
    driver holds one entry for each shard, never one for each document.  Texts are dealt by range
    and each is encoded once, in the task that writes it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    place = [F.asc_nulls_first("doc_id"), F.asc("spread"), F.asc("place")]
    dealt = rows.withColumns({"spread": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(int(size // shard_text_bytes) + 1, *place).sortWithinPartitions(*place)

    def store(batches):
        shard, tok = TaskContext.get().partitionId(), bpe.load(tokenizer)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        told = {}

        def fill(out):
            writer = ShardWriter(out, kind, block)
            end = np.array([end_id], np.uint32)
            for batch in itertools.chain([first], batches):
                docs_of = iter(batch.column(0).to_pylist())
                for _, ids, off in bpe.encoded(batch.column(1), tok):
                    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                        writer.add(next(docs_of), np.append(ids[a:b].astype(np.uint32), end))
            writer.close()
            told.update(docs=len(writer.docs), ids=sum(writer.lengths))

        path = f"{folder}/shard-{shard:06d}.bpl"
        write_once(path, fill)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, **told}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    found = dealt.select("doc_id", "text").mapInArrow(store, "shard int, path string, docs bigint, ids bigint").collect()
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r["shard"]):
        manifest.append({"shard": r["shard"], "path": r["path"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    write_once(f"{folder}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per document, as the files hold it: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = [[], [], [], []]
                for doc, ids in ShardReader(path).by_document():
                    for column, value in zip(rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files and read them back."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, folder, **options))
