"""A store on any Hadoop file system: sorted Parquet runs and an atomically replaced
manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.log import TOMBSTONE, VERSION
from ..operators import read
from ..plans.layout import FLUSHES, PER_LEVEL

LAST = 4


class Store:
    """put, delete, get, scan, multi_get, multi_scan, flush, compact, close.

    Single writes gather in a small table of the driver, bounded by
    ``memtable_bytes`` (16 a key).  A bulk write is one run, in the level whose runs
    hold as many memtables as it does (level 3 at most), so runs of a level are of
    like size.  Readers trust the manifest alone: a run is written, then named in it;
    what it replaces is deleted with the commit after, so that readers of the version
    before still find it.  A version is made by creating its file, which fails for all
    but one writer.  Levels 0 to 3 are merged when they hold 3, 9, 27 and 81 runs; the
    last level keeps one run.  Deletions go when nothing older is left elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = 1 << 20):
        self.spark, self.path, self.budget = spark, path.rstrip("/"), memtable_bytes
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(self.path))
        self.memtable: dict[int, tuple[int | None, int]] = {}
        self.manifest = self._load()

    # -- manifest -------------------------------------------------------------
    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self) -> dict:
        """The newest version; one whose writer died in it can't be read and is passed over."""
        found = self._versions()
        for v in reversed(found):
            try:
                return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest-{v}.json", wholetext=True).collect())) | {"taken": found[-1]}
            except ValueError:
                continue
        return {"version": 0, "seq": 0, "next_run": 0, "batches": {}, "runs": [], "gone": [], "taken": max([0, *found])}

    def _commit(self, manifest: dict, drop: list[str] = ()) -> None:
        """Create the next version exclusively; then delete what the version before it
        had replaced.  ``manifest`` is this store's only once it is written."""
        v = max(manifest["version"], manifest["taken"]) + 1
        old, manifest = manifest["gone"], manifest | {"version": v, "gone": list(drop)}
        try:
            out = self._fs.create(self._p(f"{self.path}/manifest-{v}.json"), False)
        except Exception as e:
            raise RuntimeError(f"another writer made version {v}") from e
        try:
            out.write(bytearray(json.dumps({k: x for k, x in manifest.items() if k != "taken"}).encode()))
        finally:
            out.close()
        self.manifest = manifest | {"taken": v}
        for k in self._versions()[:-2]:
            self._fs.delete(self._p(f"{self.path}/manifest-{k}.json"), False)
        for name in old:
            self._fs.delete(self._p(f"{self.path}/{name}"), True)

    def runs(self, level: int | None = None) -> list[dict]:
        return [r for r in self.manifest["runs"] if level is None or r["level"] == level]

    # -- reads ----------------------------------------------------------------
    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], VERSION)
        return self.spark.read.schema(VERSION).parquet(*(f"{self.path}/{r['name']}" for r in runs))

    def log(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Versions of the runs that meet [low, high], and of the memtable."""
        met = [r for r in self.manifest["runs"] if (high is None or r["min_key"] <= high) and (low is None or r["max_key"] >= low)]
        log = self._read(met)
        if self.memtable:
            rows = [(k, v, v is None, s) for k, (v, s) in self.memtable.items()]
            log = log.unionByName(self.spark.createDataFrame(rows, VERSION))
        return log

    def get(self, key: int) -> int | None:
        if key in self.memtable:
            return self.memtable[key][0]
        row = read.get(self.log(key, key), key).first()
        return row["value"] if row["found"] else None

    def scan(self, low: int, high: int) -> DataFrame:
        return read.scan(self.log(low, high), low, high)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return read.multi_get(self.log(), keys)

    def multi_scan(self, ranges: DataFrame) -> DataFrame:
        return read.multi_scan(self.log(), ranges)

    # -- writes ---------------------------------------------------------------
    def _next(self) -> int:
        self.manifest["seq"] += 1
        return self.manifest["seq"]

    def put(self, key: int, value: int) -> None:
        self.memtable[key] = (None if value == TOMBSTONE else value, self._next())
        if 16 * len(self.memtable) >= self.budget:
            self.flush()

    def delete(self, key: int) -> None:
        self.put(key, TOMBSTONE)

    def put_all(self, df: DataFrame, order: str = "seq", batch: str | None = None) -> bool:
        """All of (key, value, order) as one run, in the given order; ties are settled by
        ``read.untied``, so a batch that is run again gives the same.  A named batch that
        was written before is passed over."""
        if batch is not None and batch in self.manifest["batches"]:
            return False
        self.flush()
        gone = F.col("value").isNull() | (F.col("value") == TOMBSTONE)
        rows = df.select(F.col("key").cast("long"), F.when(~gone, F.col("value").cast("long")).alias("value"), gone.alias("deleted"), F.col(order).cast("long").alias("seq"))
        self._add(read.untied(rows).withColumn("seq", F.lit(self._next())), None, batch=batch)
        self._settle()
        return True

    def delete_all(self, keys: DataFrame) -> None:
        self.put_all(keys.select("key", F.lit(None).cast("long").alias("value"), F.lit(0).alias("seq")))

    def flush(self) -> None:
        if self.memtable:
            rows = self.spark.createDataFrame([(k, v, v is None, s) for k, (v, s) in sorted(self.memtable.items())], VERSION)
            self._add(rows, 0)
            self.memtable = {}
            self._settle()

    def _level(self, pairs: int) -> int:
        """The level whose runs hold as many memtables as ``pairs`` fill."""
        flushes = max(1, -(-16 * pairs // self.budget))
        return max(k for k, n in enumerate(FLUSHES[:LAST]) if n <= flushes)

    def _add(self, df: DataFrame, level: int | None, replaces: list[dict] = (), batch: str | None = None) -> None:
        name, seen = f"run-{self.manifest['next_run']}-{uuid.uuid4().hex[:8]}", Observation()
        counts = (F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("pairs"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        rows = df.select(*VERSION.names).repartitionByRange("key").sortWithinPartitions("key")
        rows.observe(seen, *counts).write.parquet(f"{self.path}/{name}")
        row, manifest = seen.get, dict(self.manifest)
        gone = {r["name"] for r in replaces}
        manifest["runs"] = [r for r in manifest["runs"] if r["name"] not in gone]
        if row["pairs"]:  # an empty merge leaves no run
            size = self._fs.getContentSummary(self._p(f"{self.path}/{name}")).getLength()
            at = self._level(row["pairs"]) if level is None else level
            manifest["runs"] = [*manifest["runs"], {"name": name, "level": at, "run": manifest["next_run"], "pages": -(-row["pairs"] // 256), "bytes": size, **{k: row[k] for k in ("min_key", "max_key", "pairs", "min_seq", "max_seq")}}]
        manifest["next_run"] += 1
        if batch is not None:
            manifest["batches"] = {**manifest["batches"], batch: manifest["seq"]}
        self._commit(manifest, [*gone, *([] if row["pairs"] else [name])])

    def _settle(self) -> None:
        for level, most in enumerate(PER_LEVEL):
            if len(self.runs(level)) >= most:
                self.compact(level)
        if len(self.runs(LAST)) > 1:
            self.compact(LAST)

    def compact(self, level: int | None = None) -> None:
        """Merge a level into the next one; None merges everything.  Deletions go if
        every other run is newer than all that is merged."""
        runs = self.runs(level)
        if runs:
            to = LAST if level is None else min(level + 1, LAST)
            names = {r["name"] for r in runs}
            most = max(r["max_seq"] for r in runs)
            last = to == LAST and all(r["min_seq"] > most for r in self.runs() if r["name"] not in names)
            self._add(read.resolve(self._read(runs), last), to, runs)

    def close(self) -> None:
        self.flush()


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Versions in run files of 4 KiB pages (a root page of keys, inner pages, then
    pages of little-endian pairs): level and run are in the name ``btree<L>_<i>.bin``.
    Pairs end where the file ends.  How many pages stand before them follows from their
    number (a root page, and one for each 256 full leaves, at least one), not from what
    the root page holds, so that keys of 0 are like any other.  A file is read by one
    task, as one value (2 GB at most)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                level, n = name.rsplit("btree", 1)[1][:-4].split("_")
                words = np.frombuffer(data, "<i8")
                inner = next((k for k in range(1, len(words) // 512 + 1) if max(1, (len(words) - 512 * (1 + k)) // 2 // 256 // 256) == k), 1)
                pairs = words[512 * (1 + inner) :]
                pairs = pairs[: len(pairs) // 2 * 2].reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), int(level), "i4")), pa.array(np.full(len(pairs), int(n), "i8"))], names=["key", "value", "level", "run"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "btree*_*.bin").load(path).select("path", "content")
    pairs = files.mapInArrow(run, "key long, value long, level int, run long")
    gone = F.col("value") == TOMBSTONE
    return pairs.select("key", F.when(~gone, F.col("value")).alias("value"), gone.alias("deleted"), (F.col("run") - F.col("level").cast("long") * (1 << 40)).alias("seq"), "level", "run")
