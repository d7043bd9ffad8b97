"""File validation (F8, P21, P22) and store loading (SNK5-SNK7, A6, A7).

Validation is an ordered CASE over a *listing* of files -- (path, length)
from a ``binaryFile`` scan whose ``content`` column is pruned -- left-joined
from the requested paths: a NULL right side is "File not found".  Bytes are
read only for ``.txt``/``.md`` files that passed the cheaper checks (a
second, pushed-down scan joined on path), and the whole content is checked
for UTF-8, not a prefix.

Loading is per *batch* (one store per batch): invalid files are reported and
the valid ones continue; a batch with no loaded file registers nothing.
The store id is derived from the batch id, so a retried batch is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import urls as U

# --- fixed values ---------------------------------------------------------
SUPPORTED_EXTENSIONS = [".txt", ".md", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".webp"]
TEXT_EXTENSIONS = [".txt", ".md"]
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILE_LABEL = "50MB"
# --------------------------------------------------------------------------


def validate(requests: DataFrame, listing: DataFrame, utf8_ok: DataFrame | None = None,
             path_col: str = "file_path") -> DataFrame:
    """requests(..., file_path) x listing(path, length) [x utf8_ok(path, utf8_ok)]
    -> requests + (valid, error, size, extension).

    Order: path given (F9) -> exists -> extension -> size <= 50 MiB -> UTF-8 (text only); first
    failure wins.  size = 0 for the first two failures; extension = '' when
    the file does not exist.  ``utf8_ok`` missing for a text file counts as
    valid UTF-8 (caller did not ask for the byte check).
    """
    lst = listing.select(F.col("path").alias("_path"), F.col("length").alias("_len"))
    df = requests.join(lst, F.col(path_col) == F.col("_path"), "left")
    if utf8_ok is not None:
        df = df.join(utf8_ok.select(F.col("path").alias("_upath"), F.col("utf8_ok").alias("_utf8")),
                     F.col(path_col) == F.col("_upath"), "left").drop("_upath")
    else:
        df = df.withColumn("_utf8", F.lit(None).cast("boolean"))
    p = F.col(path_col)
    df = df.withColumn("_ext", U.file_ext(p))  # staged: read several times below
    ext = F.col("_ext")
    exists = F.col("_path").isNotNull()
    supported = ext.isin(*SUPPORTED_EXTENSIONS)
    small = F.col("_len") <= F.lit(MAX_FILE_BYTES)
    text_ok = ~ext.isin(*TEXT_EXTENSIONS) | F.coalesce(F.col("_utf8"), F.lit(True))
    error = (
        F.when(F.coalesce(p, F.lit("")) == "", F.lit("file_path is required"))
        .when(~exists, F.concat(F.lit("File not found: "), p))
        .when(~supported, F.concat(F.lit("Unsupported file extension: "), ext,
                                   F.lit(". Supported: " + ", ".join(SUPPORTED_EXTENSIONS))))
        .when(~small, F.format_string("File too large: %.2fMB. Maximum: " + MAX_FILE_LABEL,
                                      F.col("_len") / F.lit(1024.0) / F.lit(1024.0)))
        .when(~text_ok, F.concat(F.lit("Failed to read file encoding: "), p))
    )
    size = F.when(exists & supported, F.col("_len")).otherwise(F.lit(0)).cast("bigint")
    extension = F.when(exists, ext).otherwise(F.lit(""))
    df = df.withColumn("_error", error)
    return df.select(*requests.columns, F.col("_error").isNull().alias("valid"), F.col("_error").alias("error"),
                     size.alias("size"), extension.alias("extension"))


def utf8_check(contents: DataFrame, *extra: Column) -> DataFrame:
    """contents(path, content BINARY) -> (path, utf8_ok) over the whole bytes, and
    what else is wanted of them."""
    return contents.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8_ok"), *extra)


def store_id_of(batch_id: F.Column) -> F.Column:
    """Deterministic store id per batch (idempotent retries)."""
    return F.concat(F.lit("stores/"), F.substring(F.sha2(batch_id.cast("string"), 256), 1, 16))


def file_outcomes(validated: DataFrame, load_errors: DataFrame | None = None) -> DataFrame:
    """A6 per file: (batch_id, pos, file_path, outcome, error), outcome
    ``uploaded``, ``invalid`` or ``failed``."""
    v = _with_load_errors(validated, load_errors)
    outcome = (F.when(~F.col("valid"), F.lit("invalid")).when(F.col("_lerr").isNotNull(), F.lit("failed")).otherwise(F.lit("uploaded")))
    return v.select("batch_id", "pos", "file_path", outcome.alias("outcome"), F.coalesce(F.col("error"), F.col("_lerr")).alias("error"))


def store_documents(outcomes: DataFrame) -> DataFrame:
    """(store_id, batch_id, pos, file_path): a row per uploaded file."""
    return outcomes.where("outcome = 'uploaded'").select(store_id_of(F.col("batch_id")).alias("store_id"), "batch_id", "pos", "file_path")


def _with_load_errors(v: DataFrame, load_errors: DataFrame | None) -> DataFrame:
    if load_errors is None:
        return v.withColumn("_lerr", F.lit(None).cast("string"))
    le = load_errors.select("batch_id", F.col("file_path").alias("_lp"), F.col("error").alias("_lerr"))
    return v.join(le, (v["batch_id"] == le["batch_id"]) & (v["file_path"] == le["_lp"]), "left").drop(le["batch_id"]).drop("_lp")


def load_outcome(validated: DataFrame, load_errors: DataFrame | None = None) -> DataFrame:
    """SNK7 + A6 + A7 per batch.

    ``validated``: batch_id, pos, file_path, valid, error, size, extension (and
    optional requested ``doc_type`` / ``description``).  ``load_errors``:
    (batch_id, file_path, error) for files whose load failed.
    Output per batch: store_id, doc_type (given, else stem of the first valid
    file by pos), counts, success, error, description.
    """
    v = validated
    if "doc_type" not in v.columns:
        v = v.withColumn("doc_type", F.lit(None).cast("string"))
    if "description" not in v.columns:
        v = v.withColumn("description", F.lit(None).cast("string"))
    v = _with_load_errors(v, load_errors)
    loaded = F.col("valid") & F.col("_lerr").isNull()
    agg = v.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if(loaded).alias("n_loaded"),
        F.count_if(F.col("valid") & F.col("_lerr").isNotNull()).alias("n_load_failed"),
        F.coalesce(F.sum(F.when(loaded, F.col("size"))), F.lit(0)).cast("bigint").alias("loaded_bytes"),
        F.min(F.when(F.col("valid"), F.struct("pos", U.file_stem("file_path").alias("stem")))).alias("first_valid"),
        F.max("doc_type").alias("req_doc_type"),
        F.max(F.when(F.col("description") != "", F.col("description"))).alias("req_description"),
    )
    # All errors in input order; file_outcomes has them as rows
    def joined(which: F.Column, text: F.Column) -> F.Column:
        parts = F.array_sort(F.collect_list(F.when(which, F.struct("pos", text.alias("t")))))
        return F.array_join(F.transform(parts, lambda s: s["t"]), "\n")

    bad = v.where(~loaded).groupBy("batch_id").agg(
        joined(~F.col("valid"), F.col("error")).alias("invalid_errors"),
        joined(F.col("valid"), F.concat("file_path", F.lit(": "), "_lerr")).alias("load_errors"))
    out = agg.join(bad, "batch_id", "left")
    success = F.col("n_loaded") > 0
    error = (F.when(F.col("n_valid") == 0, F.concat(F.lit("No valid files to upload:\n"),
                                                      F.coalesce(F.col("invalid_errors"), F.lit(""))))
             .when(F.col("n_loaded") == 0, F.concat(F.lit("All file uploads failed:\n"), F.coalesce(F.col("load_errors"), F.lit("")))))
    doc_type = F.coalesce(F.col("req_doc_type"), F.col("first_valid.stem"))
    return out.select(
        "batch_id",
        F.when(success, store_id_of(F.col("batch_id"))).alias("store_id"),
        doc_type.alias("doc_type"),
        "n_files", "n_valid", "n_invalid", "n_loaded", "n_load_failed", "loaded_bytes",
        success.alias("success"), error.alias("error"),
        F.coalesce(F.col("req_description"),
                   F.concat(F.lit("Multiple files upload: "), F.col("n_loaded").cast("string"), F.lit(" files")))
        .alias("description"),
    )


def load_store(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """SNK5: all-or-nothing per batch.  Any missing file (or an empty batch)
    fails the whole batch before anything is loaded.  Output per batch:
    store_id, n_files, success, error, description (default
    "{doc_type} API Documentation")."""
    lst = listing.select(F.col("path").alias("_path")).distinct()
    j = requests.join(lst, requests["file_path"] == lst["_path"], "left")
    agg = j.groupBy("batch_id", "doc_type").agg(
        F.count("file_path").alias("n_files"),
        F.count_if(F.col("_path").isNull() & F.col("file_path").isNotNull()).alias("n_missing"),
        F.min(F.when(F.col("_path").isNull(), F.struct("pos", "file_path"))).alias("first_missing"),
    )
    ok = (F.col("n_files") > 0) & (F.col("n_missing") == 0)
    return agg.select(
        "batch_id", "doc_type",
        F.when(ok, store_id_of(F.col("batch_id"))).alias("store_id"),
        "n_files", ok.alias("success"),
        F.when(F.col("n_files") == 0, F.lit("file list is empty"))
        .when(~ok, F.concat(F.lit("File not found: "), F.col("first_missing.file_path"))).alias("error"),
        F.concat(F.col("doc_type"), F.lit(" API Documentation")).alias("description"),
    )


def load_file(validated: DataFrame) -> DataFrame:
    """SNK6: one file per request (``validated`` from :func:`validate`, with
    optional ``doc_type`` / ``description``).  A valid file gets a store:
    doc_type defaults to the file stem, description to "Direct upload:
    {name}"; an invalid one returns its validation error and no store."""
    v = validated
    if "doc_type" not in v.columns:
        v = v.withColumn("doc_type", F.lit(None).cast("string"))
    if "description" not in v.columns:
        v = v.withColumn("description", F.lit(None).cast("string"))
    ok = F.col("valid")
    key = F.concat_ws("|", F.col("batch_id").cast("string"), F.col("file_path"))
    return v.select(
        "batch_id", "file_path",
        F.when(ok, store_id_of(key)).alias("store_id"),
        F.when(ok, F.coalesce(F.nullif(F.col("doc_type"), F.lit("")), U.file_stem("file_path"))).alias("doc_type"),
        F.when(ok, F.coalesce(F.nullif(F.col("description"), F.lit("")),
                              F.concat(F.lit("Direct upload: "), U.file_name("file_path")))).alias("description"),
        "size", ok.alias("success"), "error")


def file_counts(listing: DataFrame, by: str | None = "doc_type") -> DataFrame:
    """A2: number of files and total bytes of a listing (per ``by`` column,
    or overall when ``by`` is None)."""
    aggs = [F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size")]
    return listing.groupBy(by).agg(*aggs) if by else listing.agg(*aggs)
