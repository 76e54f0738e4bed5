"""The verdict cache as a folder of generations that grows by what is put in, not by what is there.

Entries are dealt to partitions by their key. A put writes one new generation with the new entries alone; a partition that
has gathered many generations, or as much new as old, is written anew as one. A manifest lists the folders that count, partition
by partition. It is written last, as a new version, and readers take the newest complete one, so a run that dies before
leaves everything as it was. What no manifest needs any more is deleted by `vacuum`.
"""

from uuid import uuid4

from pyspark.sql import functions as F

from rulelens.operators.cache import fresh_entries, latest_entries
from rulelens.plans.joins import semi_by_key
from rulelens.plans.storage import materialize
from rulelens.schemas import CACHE, CACHE_KEY, DEFAULT_TTL_HOURS

PARTITIONS = 64
# A partition is written anew beyond so many generations, or if the later ones have as many entries as the first.
MAX_GENERATIONS = 8
_MANIFEST = "part int, generation string, ordinal int, rows bigint, oldest timestamp, newest timestamp"


class CacheStore:
    """A cache below `root`, a folder all tasks reach. One writer at a time: a second one fails at the manifest."""

    def __init__(self, spark, root, partitions=PARTITIONS):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder):
        files = self._files()
        if not files.exists(self._path(folder)):
            return []
        return [status.getPath().getName() for status in files.listStatus(self._path(folder))]

    def version(self):
        """The newest complete manifest's number, 0 if there is none."""
        numbers = [int(name.partition("=")[2]) for name in self._names("manifest") if name.startswith("version=")]
        done = [n for n in numbers if self._files().exists(self._path(f"manifest/version={n}/_SUCCESS"))]
        return max(done, default=0)

    def manifest(self, version=None):
        """Rows of a manifest: one for each partition and generation that counts, so few."""
        version = self.version() if version is None else version
        if not version:
            return []
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()

    def _part(self):
        return F.pmod(F.xxhash64(*CACHE_KEY), F.lit(self.partitions)).cast("int")

    def _entries(self, listed):
        """All entries of the listed folders with their generation's `ordinal`."""
        found = self.spark.createDataFrame([], CACHE).select(*CACHE.fieldNames(), F.lit(0).alias("ordinal"))
        for generation, ordinal in sorted({(row["generation"], row["ordinal"]) for row in listed}):
            folders = [f"{self.root}/data/{generation}/part={row['part']}" for row in listed if row["generation"] == generation]
            rows = self.spark.read.schema(CACHE).parquet(*folders)
            found = found.unionByName(rows.withColumn("ordinal", F.lit(ordinal)))
        return found

    def read(self, keys=None):
        """The cache: of each key the entry that was put last. With `keys` only partitions they lie in are read, and only they come."""
        listed = self.manifest()
        if keys is not None:
            keys = materialize(keys.select(*CACHE_KEY).distinct(), "keys")
            parts = {row[0] for row in keys.select(self._part()).distinct().collect()}
            listed = [row for row in listed if row["part"] in parts]
        entries = self._entries(listed)
        if keys is not None:
            entries = semi_by_key(entries, keys, CACHE_KEY)
        return latest_entries(entries, ("ordinal", "created_at")).select(CACHE.fieldNames())

    def _write(self, entries):
        """Write entries as a generation; its manifest rows without the ordinal."""
        generation = uuid4().hex
        dealt = materialize(entries.select(*CACHE.fieldNames(), self._part().alias("part")), "dealt")
        dealt.repartition("part").sortWithinPartitions("part", *CACHE_KEY).write.partitionBy("part").parquet(f"{self.root}/data/{generation}")
        counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
        return [(row["part"], generation, row["rows"], row["oldest"], row["newest"]) for row in counts.collect()]

    def _commit(self, rows, version):
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/version={version}")

    def _rewritten(self, listed, parts, keep=None):
        """The manifest rows with the named partitions written anew as one generation each."""
        if not parts:
            return listed
        entries = latest_entries(self._entries([row for row in listed if row["part"] in parts]), ("ordinal", "created_at"))
        entries = entries.select(CACHE.fieldNames())
        rows = self._write(entries if keep is None else keep(entries))
        return [row for row in listed if row["part"] not in parts] + [_row(part, g, 0, *rest) for part, g, *rest in rows]

    def put(self, new):
        """Insert or replace by key. Writes the new entries, and now and then a partition that has gathered too much."""
        version = self.version()
        listed = [row.asDict() for row in self.manifest(version)]
        added = self._write(latest_entries(new.select(CACHE.fieldNames())))
        after = max((row["ordinal"] for row in listed), default=-1) + 1
        listed += [_row(part, g, after, *rest) for part, g, *rest in added]
        by_part = {}
        for row in listed:
            by_part.setdefault(row["part"], []).append(row)
        full = set()
        for part, rows in by_part.items():
            first = min(rows, key=lambda row: row["ordinal"])
            late = sum(row["rows"] for row in rows) - first["rows"]
            if len(rows) > 1 and (len(rows) > MAX_GENERATIONS or late >= first["rows"]):
                full.add(part)
        self._commit([tuple(row.values()) for row in self._rewritten(listed, full)], version + 1)

    def expire(self, as_of, ttl_hours=DEFAULT_TTL_HOURS):
        """Drop entries that are no longer fresh; partitions without any, by the manifest, are not read."""
        version = self.version()
        listed = [row.asDict() for row in self.manifest(version)]
        edge = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(ttl_hours)} hours")
        edge = self.spark.range(1).select(edge).first()[0]
        old = {row["part"] for row in listed if row["oldest"] <= edge}
        kept = self._rewritten(listed, old, lambda entries: fresh_entries(entries, as_of, ttl_hours))
        self._commit([tuple(row.values()) for row in kept], version + 1)

    def vacuum(self, keep_versions=1):
        """Delete manifests but the newest `keep_versions`, and generations that none of these lists. Not beside a writer."""
        newest, files = self.version(), self._files()
        kept = range(max(1, newest - keep_versions + 1), newest + 1)
        used = {row["generation"] for version in kept for row in self.manifest(version)}
        for name in self._names("data"):
            if name not in used:
                files.delete(self._path(f"data/{name}"), True)
        for name in self._names("manifest"):
            if name.startswith("version=") and int(name.partition("=")[2]) not in kept:
                files.delete(self._path(f"manifest/{name}"), True)


def _row(part, generation, ordinal, rows, oldest, newest):
    return {"part": part, "generation": generation, "ordinal": ordinal, "rows": rows, "oldest": oldest, "newest": newest}
