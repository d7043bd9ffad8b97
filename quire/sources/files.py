"""File listings with ``binaryFile`` (SRC6-SRC9).

Listings select ``path`` and ``length`` only, so the ``content`` column is
pruned and no file body is read; bytes are read only where a job needs them
(the UTF-8 probe), with the size limit pushed down to the scan.
``recursiveFileLookup`` turns partition discovery off, so folder names never
become columns by accident.

``binaryFile`` keeps an entry for every file in the driver.  So a tree in a store
that is mounted as a folder is listed by tasks, level by level, into a table, and
tasks read the files of that table; the files and names are those of ``binaryFile``.
Other stores and patterns get ``binaryFile``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import urls as U
from quire.operators.common import sized

LISTING_DDL = "path string, name string, size bigint, doc_type string"
#: names, and bytes of files, that a task sends at a time
NAMES_AT_ONCE, BYTES_AT_ONCE = 8192, 8 << 20


def local_path(c: F.Column) -> F.Column:
    """'file:/x' / 'file:///x' -> '/x' (other schemes unchanged)."""
    return F.regexp_replace(c, r"^file:(//)?(?=/)", "")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks see it; None in another store and for a pattern."""
    local = path.startswith("file:") or not re.match(r"\w+:", path) and (
        spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    folder = _shown_root(path).rstrip("/")
    return folder if local and not re.search(r"[\\{}\[\]*?]", path) and os.path.isabs(folder) and os.path.isdir(folder) else None


def _pattern(glob: str | None) -> str:
    """The regular expression of a pattern of names."""
    return ".*" if glob is None else re.sub(r"[.*?{},]|[^\w\[\]]", lambda m: {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}.get(m[0], re.escape(m[0])), glob)


def _tree(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """(path, length) of the files below a mounted folder that ``binaryFile`` would
    read: not empty, and neither they nor their folders hidden."""
    named = _pattern(glob)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.bool_())], ["path", "folder"])

        rows: list[tuple[str, bool]] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as found:
                    for e in found:
                        if e.name.startswith(".") or e.name.endswith("._COPYING_"):
                            continue
                        deep, special = e.is_dir(), e.name.startswith("_") and "=" not in e.name
                        if not special and (deep or re.fullmatch(named, e.name)) or deep and e.name.startswith(("_metadata", "_common_metadata")):
                            rows.append((e.path, deep))
                        if len(rows) >= NAMES_AT_ONCE:
                            yield send(rows)
                            rows = []
        yield send(rows)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append((path, os.stat(path).st_size))
                except FileNotFoundError:  # a link to nothing
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "length"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = sized(folders.mapInArrow(entries, "path string, folder boolean"), "names")
        own = level.where("not folder").select("path")
        files = own if files is None else files.unionByName(own)
        folders = level.where("folder").select("path").repartition(n)
        if level.where("folder").isEmpty():
            return sized(files.repartition(n).mapInArrow(sizes, "path string, length bigint").where("length > 0"), "listing")


def _scan(spark: SparkSession, path: str, glob: str | None, recursive: bool) -> DataFrame | None:
    folder = _mounted(spark, path) if recursive else None
    if folder is not None:
        return _tree(spark, folder, glob)
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    try:
        return r.load(path).select(local_path(F.col("path")).alias("path"), "length")
    except AnalysisException:
        return None


def _norm_root(root: str) -> str:
    return root.rstrip("/") if re.match(r"\w+:/", root) else os.path.abspath(root).rstrip("/")


def _shown_root(root: str) -> str:
    """The root as listed paths begin, see :func:`local_path`."""
    return re.sub(r"^file:(//)?(?=/)", "", root)


def corpus_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.txt`` below ``root`` in one listing: path, name, size, doc_type
    (SRC6) and ``top``, the doc_type whose files it belongs to (SRC7): the first
    folder below the root, or the stem of a file directly under it."""
    root = _norm_root(root)
    df = _scan(spark, root, "*.txt", recursive=True)
    if df is None:
        return spark.createDataFrame([], LISTING_DDL + ", top string")
    rel = F.expr(f"substring(path, {len(_shown_root(root)) + 2})")
    parts, stem = F.split(rel, "/"), U.file_stem(F.col("path"))
    alone = F.size(parts) == 1
    return df.select("path", U.file_name(F.col("path")).alias("name"), F.col("length").alias("size"),
                     F.when(alone, stem).otherwise(F.try_element_at(parts, F.lit(-2))).alias("doc_type"),
                     F.when(alone, stem).otherwise(F.get(parts, 0)).alias("top"))


def scan_corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC6: every ``*.txt`` below ``root``: path, name, size, doc_type.
    A file directly under root -> doc_type = its stem; deeper -> the name of
    its immediate parent folder.  Missing root -> empty."""
    return corpus_listing(spark, root).drop("top")


def scan_corpus_files_of_type(spark: SparkSession, root: str, doc_type: str) -> DataFrame:
    """SRC7/U1: ``<root>/<doc_type>/**/*.txt`` union ``<root>/<doc_type>.txt``;
    the reported doc_type is the requested one.  Two targeted scans, so a
    large corpus is not listed for one doc_type."""
    root = _norm_root(root)
    parts = []
    sub = _scan(spark, f"{root}/{doc_type}", "*.txt", recursive=True)
    if sub is not None:
        parts.append(sub)
    one = _scan(spark, f"{root}/{doc_type}.txt", None, recursive=False)
    if one is not None:
        parts.append(one)
    if not parts:
        return spark.createDataFrame([], LISTING_DDL)
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("path", U.file_name(F.col("path")).alias("name"), F.col("length").alias("size"),
                     F.lit(doc_type).alias("doc_type"))


def gather_upload_inputs(spark: SparkSession, root: str, doc_types: str | DataFrame) -> DataFrame:
    """SRC8: (doc_type, pos, file_path, error) for a store load; a doc_type
    without files yields one error row ("crawl first").  ``doc_types``: one, or
    rows with a column ``doc_type``, which are joined to one listing.  ``pos``
    rises with the path within a doc_type; it is not consecutive."""
    if isinstance(doc_types, str):
        requests = spark.createDataFrame([(doc_types,)], "doc_type string")
        files = scan_corpus_files_of_type(spark, root, doc_types).select("doc_type", "path")
    else:
        requests = doc_types.select("doc_type").distinct()
        files = corpus_listing(spark, root).select(F.col("top").alias("doc_type"), "path")
    found = requests.join(files, "doc_type", "left").orderBy("doc_type", "path")
    missing = F.concat(F.lit("No crawled files found for doc_type '"), F.col("doc_type"), F.lit("'. Crawl first."))
    return found.select("doc_type", F.when(F.col("path").isNotNull(), F.monotonically_increasing_id()).alias("pos"),
                        F.col("path").alias("file_path"), F.when(F.col("path").isNull(), missing).alias("error"))


def _folder(doc_type: str) -> str:
    """The folder of a partition value, named as Spark names it."""
    shown = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", doc_type)
    return "doc_type=" + (shown or "__HIVE_DEFAULT_PARTITION__")


def write_text_files(rows: DataFrame, path: str) -> None:
    """A file of one line for each of rows(doc_type, value), below
    ``doc_type=<doc_type>``.

    In a store that is mounted as a folder the tasks write the files themselves:
    Spark's own writer starts a process or two for each file's permissions
    there.  A file has its final name only when it is whole, and a task that is
    repeated gives the same names."""
    root = _shown_root(path)
    if re.match(r"\w+:", root):
        rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc_type").text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        task, n, made = TaskContext.get(), 0, set()
        for batch in batches:
            for doc_type, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = os.path.join(root, _folder(doc_type))
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                name = f"part-{task.partitionId():05d}-{n:07d}.txt"
                part = os.path.join(folder, f".{name}.{task.taskAttemptId()}")
                with open(part, "wb") as f:
                    f.write(value.as_py() + b"\n")
                os.replace(part, os.path.join(folder, name))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    os.makedirs(root, exist_ok=True)
    rows.select("doc_type", F.col("value").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _contents(files: DataFrame) -> DataFrame:
    """files(path, length) of a mounted folder -> (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size >= BYTES_AT_ONCE or len(rows) >= NAMES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n).mapInArrow(run, "path string, content binary")


def read_bodies(spark: SparkSession, path: str, max_bytes: int, glob: str | None = None, recursive: bool = False) -> DataFrame | None:
    """(path, content) of the files up to ``max_bytes``, a filter that the scan
    itself applies; None where there is no such folder."""
    folder = _mounted(spark, path) if recursive else None
    if folder is not None:
        return _contents(_tree(spark, folder, glob).where(F.col("length") <= F.lit(max_bytes)))
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    try:
        return r.load(path).where(F.col("length") <= F.lit(max_bytes)).select(local_path(F.col("path")).alias("path"), "content")
    except AnalysisException:
        return None


def _one_glob(folders: list[str]) -> str:
    """One pattern for all folders; those that are missing match nothing.  A
    character that means something in a pattern stands as any character; what
    matches besides is no requested file."""
    def plain(folder: str) -> str:
        return re.sub(r"[\\{}\[\]*,]", "?", folder)

    # the root stands before the braces, or the pattern would be a relative path
    root = os.path.commonprefix([f + "/" for f in folders])
    root = root[:root.rindex("/") + 1]
    return plain(root) + "{" + ",".join(plain((f + "/")[len(root):].rstrip("/")) for f in folders) + "}" if len(folders) > 1 else plain(folders[0])


def scan_local_files(spark: SparkSession, requests: DataFrame, path_col: str = "file_path",
                     max_bytes: int | None = None, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC9: listing ``(path, length)`` and UTF-8 probe ``(path, utf8_ok)`` of
    the requested files.

    With ``root`` everything below it is listed once and joined to the
    requests; nothing comes to the driver.  Without, the distinct parent folders
    are brought to the driver and named in one load (for requests from a bounded
    number of folders); a missing folder has no files.  The probe reads
    ``.txt``/``.md`` bodies of requested files only, with ``length <= max_bytes``
    pushed into the scan."""
    from quire.operators.files import MAX_FILE_BYTES, utf8_check

    limit = max_bytes or MAX_FILE_BYTES
    empty = (spark.createDataFrame([], "path string, length bigint"), spark.createDataFrame([], "path string, utf8_ok boolean"))
    wanted = requests.select(F.col(path_col).alias("path")).where("path is not null").distinct()
    if root is None:
        folders = sorted(r[0] for r in wanted.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().collect() if r[0])
        if not folders:
            return empty
        path = _one_glob(folders)
    else:
        path = _norm_root(root)
    listing = _scan(spark, path, None, recursive=root is not None)
    bodies = read_bodies(spark, path, limit, "*.{[tT][xX][tT],[mM][dD]}", recursive=root is not None)
    if listing is None or bodies is None:
        return empty
    return listing.join(wanted, "path", "left_semi"), utf8_check(bodies.join(wanted, "path", "left_semi"))
