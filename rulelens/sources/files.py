"""Text files of a directory tree as rows.

Spark's own file readers hide names that start with `_`, such as `__init__.py`. The tree is therefore listed in rounds: the
directories of a level are rows, tasks list them, and the directories found are the next level. Only counts reach the driver,
however many files a directory holds. The listing is stored by bucket, and a data source reads each bucket's files.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rulelens.functions.patterns import glob_match
from rulelens.plans.storage import materialize, run_dir
from rulelens.schemas import CORPUS, IGNORED_DIRS

FORMAT = "text_tree"
_ENTRY = "path string, size bigint, is_dir boolean"
_CONTENT = "path string, content string"
# Files and bytes of a bucket.
BUCKET_FILES, BUCKET_BYTES = 10_000, 128 << 20
# Directories listed by a task, entries handed over at a time, and text read at a time.
DIRS_PER_TASK, ENTRIES, BATCH_BYTES = 100, 10_000, 32 << 20


def _lister(uri, ignored):
    """Tasks: directories in, their entries out; hidden and ignored names are left out."""

    def run(batches):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, _ = FileSystem.from_uri(uri)
        for batch in batches:
            for directory in batch["path"].to_pylist():
                found = [
                    (info.path, info.size, info.type == FileType.Directory)
                    for info in fs.get_file_info(FileSelector(directory))
                    if info.base_name not in ignored and not info.base_name.startswith(".")
                ]
                for at in range(0, len(found), ENTRIES):
                    columns = zip(*found[at : at + ENTRIES])
                    kinds = (pa.string(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "size", "is_dir"])

    return run


def list_tree(spark, uri, root):
    """Stored tables `(path, size, is_dir)`, one for each level below the root that has entries."""
    level, found = spark.createDataFrame([(root,)], "path string"), []
    dirs = 1
    while dirs:
        tasks = max(1, min(dirs, max(spark.sparkContext.defaultParallelism, dirs // DIRS_PER_TASK)))
        listed = level.repartition(tasks, "path").mapInArrow(_lister(uri, tuple(IGNORED_DIRS)), _ENTRY)
        found.append(materialize(listed, "level"))
        level = found[-1].filter("is_dir").select("path")
        dirs = level.count()
    return found


def _texts(fs, paths):
    """Record batches `(path, content)` of files; unreadable or undecodable ones are left out."""
    names, texts, size = [], [], 0
    for path in paths:
        try:
            with fs.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8")
        except (OSError, UnicodeDecodeError):
            continue
        names.append(path)
        texts.append(text.replace("\r\n", "\n").replace("\r", "\n"))
        size += len(text)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])
            names, texts, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])


class Bucket(InputPartition):
    pass


class TextTree(DataSource):
    """Data source `text_tree`: `(path, content)` of the files in a stored listing.

    Options: `path` (where the tree's file system is), `listing` (folder with a subfolder `bucket=<n>` of Parquet files for each
    bucket), `buckets`. A bucket is a partition; its task reads its own part of the listing.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return _CONTENT

    def reader(self, schema):
        return TextTreeReader(self.options)


class TextTreeReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.listing, self.buckets = options["path"], options["listing"], int(options["buckets"])

    def partitions(self):
        return [Bucket(i) for i in range(self.buckets)]

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector, FileSystem

        fs, _ = FileSystem.from_uri(self.uri)
        store, folder = FileSystem.from_uri(f"{self.listing}/bucket={partition.value}")
        for info in store.get_file_info(FileSelector(folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    for rows in pq.ParquetFile(file).iter_batches(columns=["path"]):
                        yield from _texts(fs, rows["path"].to_pylist())


def _uri(path):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return path if ":/" in path else "file://" + path


def read_text_files(spark, path, glob="*.py"):
    """`(path, content)` with paths relative to the root (a single file keeps its name).

    Line ends become LF. Hidden and ignored names, names that do not match, unreadable files and bad UTF-8 are left out.
    """
    from pyarrow.fs import FileSystem, FileType

    uri = _uri(path)
    fs, root = FileSystem.from_uri(uri)
    info = fs.get_file_info(root)
    if info.type == FileType.NotFound:
        return spark.createDataFrame([], _CONTENT)
    if info.type == FileType.File:
        files = spark.createDataFrame([(info.path, info.size)], "path string, size bigint")
        base = info.path.rpartition("/")[0]
    else:
        levels = list_tree(spark, uri, info.path)
        files = levels[0]
        for level in levels[1:]:
            files = files.unionByName(level)
        files = files.filter("not is_dir").filter(glob_match("substring_index(path, '/', -1)", glob)).select("path", "size")
        base = info.path.rstrip("/")
    many, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(min(spark.sparkContext.defaultParallelism, many), size // BUCKET_BYTES, many // BUCKET_FILES, 1)
    listing = run_dir(spark, "listing")
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket")
    files.select("path", bucket).repartition(min(buckets, 1000), "bucket").write.partitionBy("bucket").parquet(listing)
    # The process that plans the partitions need not know this package, so the source travels as code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TextTree)
    read = spark.read.format(FORMAT).option("listing", _uri(listing)).option("buckets", buckets).load(uri)
    return read.withColumn("path", F.substring(F.col("path"), len(base) + 2, 1 << 30))


def _writer(uri):
    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(uri)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                fs.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{path}") as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["files"])

    return run


def write_text_files(rows, path):
    """Write each row `(path, content)` as a file below a folder that all tasks reach; returns how many were written.

    A task that is tried again writes the same files again. Rows without a path or text are left out; of several rows of a path
    the one with the greatest text is written.
    """
    kept = rows.filter("path is not null and content is not null").groupBy("path").agg(F.max(F.col("content").cast("binary")).alias("content"))
    written = kept.mapInArrow(_writer(_uri(path)), "files bigint")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def with_corpus_defaults(df):
    """Add the optional corpus columns (`is_new` false, no hunks) where they are missing."""
    defaults = {"is_new": F.lit(False), "hunks": F.array().cast(CORPUS["hunks"].dataType)}
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(CORPUS.fieldNames())
