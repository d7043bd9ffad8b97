"""JSON registries (SRC1, SRC2, SRC3) and the registry export (SNK3).

Both registries are small configuration documents: a URL registry
``{"apis": {keyword: {name, url, description}}}`` and a store registry
``{"rags": {doc_type: [entry, ...] | entry}}`` (the bare-object form is the
legacy layout).  They are parsed with ``from_json`` into rows that keep the
document order (``pos``).  Validation looks at one parsed row on the driver;
that row is the whole config file, never data.

The store registry is *written* (SNK3) as JSON lines, one entry per line,
sorted by (doc_type, pos) -- the one-document layout would funnel every
entry through a single task; :func:`scan_store_registry_lines` reads it back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_REGISTRY_SCHEMA = "apis map<string, struct<name: string, url: string, description: string>>"
STORE_ENTRY_SCHEMA = "array<struct<rag_id: string, created_at: string, doc_type: string, description: string>>"
STORES_DDL = "doc_type string, pos bigint, rag_id string, created_at string, description string"
REGISTRY_DDL = "pos int, keyword string, name string, url string, description string"


class RegistryError(ValueError):
    pass


def _read_document(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None


def _json_kind(col: F.Column) -> F.Column:
    """'object' / 'array' / 'scalar' for valid JSON text, NULL when invalid."""
    v = F.try_parse_json(col)
    sch = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(sch.startswith("OBJECT"), F.lit("object"))
            .when(sch.startswith("ARRAY"), F.lit("array"))
            .otherwise(F.lit("scalar")))


def scan_url_registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: ``apis`` object -> rows (pos, keyword, name, url, description).

    Missing file, invalid JSON, or no ``apis`` key raise :class:`RegistryError`.
    """
    raw = _read_document(spark, path)
    if raw is None:
        raise RegistryError(f"URL config file not found: {path}")
    doc = raw.select(
        "value", _json_kind(F.col("value")).alias("kind"),
        _json_kind(F.get_json_object("value", "$.apis")).alias("apis_kind"))
    head = doc.select("kind", "apis_kind").first()
    if head is None or head["kind"] is None:
        raise RegistryError("Failed to parse URL config file: invalid JSON")
    if head["kind"] != "object" or head["apis_kind"] is None:
        raise RegistryError("Invalid URL config format: 'apis' key not found")
    parsed = doc.select(F.from_json("value", URL_REGISTRY_SCHEMA).alias("j"))
    return parsed.select(F.posexplode(F.map_entries("j.apis")).alias("pos", "e")).select(
        "pos", F.col("e.key").alias("keyword"), F.col("e.value.name").alias("name"),
        F.col("e.value.url").alias("url"), F.col("e.value.description").alias("description"))


def list_registry(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2: the entries in registry order and a one-row count."""
    return registry.orderBy("pos"), registry.agg(F.count(F.lit(1)).alias("count"))


def scan_store_registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: ``rags`` -> rows (doc_type, pos, rag_id, created_at, description).

    Missing file or no ``rags`` key -> empty; invalid JSON, a root that is not
    an object, or a ``rags`` that is not an object -> :class:`RegistryError`.
    A doc_type value may be one entry object (legacy) or an array of them.
    """
    raw = _read_document(spark, path)
    empty = spark.createDataFrame([], STORES_DDL)
    if raw is None:
        return empty
    doc = raw.select("value", _json_kind(F.col("value")).alias("kind"),
                     _json_kind(F.get_json_object("value", "$.rags")).alias("rags_kind"),
                     F.get_json_object("value", "$.rags").isNull().alias("no_rags"))
    head = doc.select("kind", "rags_kind", "no_rags").first()
    if head is None:
        return empty
    if head["kind"] is None:
        raise RegistryError("Failed to parse store registry: invalid JSON")
    if head["kind"] != "object":
        raise RegistryError("Invalid store registry: root must be an object")
    if head["no_rags"]:
        return empty
    if head["rags_kind"] != "object":
        raise RegistryError("Invalid store registry: 'rags' must be an object")
    per_type = doc.select(F.explode(F.from_json("value", "rags map<string, string>")["rags"]).alias("doc_type", "raw"))
    as_array = F.when(F.ltrim("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), "raw", F.lit("]")))
    return per_type.select("doc_type", F.posexplode(F.from_json(as_array, STORE_ENTRY_SCHEMA)).alias("pos", "e")) \
        .select("doc_type", F.col("pos").cast("bigint").alias("pos"), F.col("e.rag_id").alias("rag_id"),
                F.col("e.created_at").alias("created_at"), F.col("e.description").alias("description"))


def export_store_registry(stores: DataFrame, path: str) -> None:
    """SNK3: JSON lines, one entry per line, ordered by (doc_type, pos);
    overwrites ``path`` (write a new versioned path per export)."""
    stores.select("doc_type", "pos", "rag_id", "created_at", "description") \
        .orderBy("doc_type", "pos").write.mode("overwrite").json(path)


def scan_store_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read an SNK3 export back (explicit schema, no inference)."""
    return spark.read.schema(STORES_DDL).json(path)


def export_store_registry_document(stores: DataFrame, path: str) -> None:
    """SNK3 in the form of one document, ``{"rags": {doc_type: [entry, ...]}}``
    (A5), entries by pos; read back by :func:`scan_store_registry`.  One row
    holds it all, so it is for registries of a configuration's size."""
    entry = F.struct("rag_id", "created_at", "doc_type", "description")
    lists = stores.groupBy("doc_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda s: s["e"]).alias("entries"))
    document = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "entries")))).alias("rags"))
    document.select(F.to_json(F.struct("rags")).alias("value")).write.mode("overwrite").text(path)
