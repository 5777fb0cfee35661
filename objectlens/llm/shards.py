"""Operator 3: sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of numbered manifests.  ``append`` writes what
arrives as small shards and commits a manifest that names them beside the old ones.  ``compact``
sorts live shards into tiers by size and merges runs of one tier: enough shards for a file of the
target size make one, and ``FAN_IN`` shards of a tier that are less make one of a higher tier.  It
goes on until no tier has a run to merge, and commits after each round.  A manifest appears by one
rename that fails if its number is taken, so a reader sees a version as a whole or not at all, and
of two writers one has to start again.

Merging streams record batches of whole files in one task for each new file; nothing is shuffled
and no row leaves its run.  A task that is run again replaces its file with the same rows.

Defined results: rows, repeated ones included, and columns are kept as they are; an empty table
makes a version without shards, which reads as no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlens.llm.common import open_fs, write_once

TARGET_BYTES, FAN_IN = 32 << 20, 4
ARRIVAL_ROWS = 1500


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int


def tier(size: int, target: int, fan_in: int = FAN_IN) -> int:
    """0 for a file of the target size or nearly so, one more for each factor of fan_in below."""
    return 0 if size >= 0.75 * target else 1 + int(math.log(target / max(size, 1), fan_in))


def plan_round(shards: list[Shard], target: int, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """The runs that one round merges: shards of one tier, in order of their paths."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.path):
        if (t := tier(s.size, target, fan_in)) > 0:
            tiers.setdefault(t, []).append(s)
    runs = []
    for members in tiers.values():
        run, size = [], 0
        for s in members:
            if run and size + s.size > 1.25 * target:
                runs.append(run)
                run, size = [], 0
            run.append(s)
            size += s.size
        if len(run) >= fan_in or (len(run) > 1 and size >= 0.75 * target):
            runs.append(run)
    return [r for r in runs if len(r) > 1]


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.folder, self.target, self.fan_in = spark, folder.rstrip("/"), target_bytes, fan_in
        self.hadoop = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.hadoop.fs.Path(name)

    def _list(self, name: str) -> list[tuple[str, int]]:
        path = self._path(name)
        fs = path.getFileSystem(self.conf)
        if not fs.exists(path):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(path))

    def versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _ in self._list(f"{self.folder}/manifests")]
        return sorted(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, live shards, schema); version 0 is the empty store."""
        version = max([0, *self.versions()]) if version is None else version
        if version == 0:
            return 0, [], None
        fs, at = open_fs(f"{self.folder}/manifests/v{version:08d}.json")
        with fs.open_input_file(at) as f:
            told = json.loads(f.read())
        return version, [Shard(**s) for s in told["shards"]], told["schema"]

    def commit(self, version: int, shards: list[Shard], schema: str) -> int:
        """Publish a version; VersionTaken if it exists."""
        part, final = f"{self.folder}/manifests/.v{version:08d}-{self.spark._jvm.java.util.UUID.randomUUID()}", f"{self.folder}/manifests/v{version:08d}.json"
        write_once(part, lambda out: out.write(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        options = self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 0)
        try:
            self.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), self.conf).rename(self._path(part), self._path(final), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(f"version {version} is taken") from e
            raise
        return version

    def append(self, rows: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        """Write arrivals as small shards and commit them beside the live ones."""
        version, live, _ = self.manifest()
        folder = f"{self.folder}/data/arrival-{version + 1:08d}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        rows.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        sizes = {p.rsplit("/", 1)[1]: (p, n) for p, n in self._list(folder) if p.endswith(".parquet")}
        counts = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        new = sorted((Shard(*sizes[r["f"]], r["count"]) for r in counts), key=lambda s: s.path)
        return self.commit(version + 1, live + new, rows.schema.json())

    def compact(self) -> int:
        """Merge runs of similar shards until none is left; returns the version that is then live."""
        version, live, schema = self.manifest()
        while runs := plan_round(live, self.target, self.fan_in):
            merged = self._merge(runs, version + 1)
            gone = {s.path for run in runs for s in run}
            live = [s for s in live if s.path not in gone] + merged
            version = self.commit(version + 1, live, schema)
        return version

    def _merge(self, runs: list[list[Shard]], version: int) -> list[Shard]:
        stamp = self.spark._jvm.java.util.UUID.randomUUID()
        work = [(f"{self.folder}/data/merged-{version:08d}-{stamp}/shard-{k:06d}.parquet", [s.path for s in run]) for k, run in enumerate(runs)]

        def merge(batches):
            for batch in batches:
                for out, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    told = {"rows": 0}

                    def fill(stream, parts=parts, told=told):
                        writer = None
                        for part in parts:
                            fs, at = open_fs(part)
                            with fs.open_input_file(at) as f:
                                source = pq.ParquetFile(f)
                                for rows in source.iter_batches(4096):
                                    writer = writer or pq.ParquetWriter(stream, rows.schema, compression="snappy")
                                    writer.write_batch(rows, row_group_size=1 << 16)
                                    told["rows"] += rows.num_rows
                        writer.close()

                    write_once(out, fill)
                    fs, at = open_fs(out)
                    yield pa.RecordBatch.from_pydict({"path": [out], "size": pa.array([fs.get_file_info(at).size], pa.int64()), "rows": pa.array([told["rows"]], pa.int64())})

        tasks = self.spark.createDataFrame(work, "out string, parts array<string>").repartition(len(work))
        return sorted((Shard(r["path"], r["size"], r["rows"]) for r in tasks.mapInArrow(merge, "path string, size bigint, rows bigint").collect()), key=lambda s: s.path)

    def vacuum(self) -> None:
        """Delete data folders that the live version doesn't name; older versions can't be read afterwards."""
        _, live, _ = self.manifest()
        used = {s.path.rsplit("/", 2)[1] for s in live}
        for folder, _ in self._list(f"{self.folder}/data"):
            if folder.rsplit("/", 1)[1] not in used:
                path = self._path(folder)
                path.getFileSystem(self.conf).delete(path, True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``_shard``, the name of the file that holds each."""
        _, live, schema = self.manifest(version)
        fields = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        if not live:
            return self.spark.createDataFrame([], fields).withColumn("_shard", F.lit(""))
        return self.spark.read.schema(fields).parquet(*[s.path for s in live]).withColumn("_shard", F.regexp_extract("_metadata.file_path", r"([^/]*/[^/]*)$", 1))
