"""Sources and sinks: JSON lines, tool documents, caches, tables of text, logs and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import change_name, standardize

STRING_LIST = "array<struct<name:string,type:string,description:string,default:string>>"
#: A tool document: one JSON file a tool, in a folder named like its category.
TOOL_DOC = (
    "tool_name string, name string, tool_description string, pricing string, host string, home_url string, "
    "score struct<avgServiceLevel:double,avgLatency:double,avgSuccessRate:double,popularityScore:double>, "
    f"api_list array<struct<name:string,description:string,method:string,required_parameters:{STRING_LIST},optional_parameters:{STRING_LIST}>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that Spark reads has a file or folder of that name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False, bad_lines: str = "fail") -> DataFrame:
    """Rows of a file of JSON lines; blank lines are none.

    missing_ok: a missing file is an empty table instead of an error. bad_lines: "fail", "drop", or "keep" in the column
    `_corrupt_record`.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad_lines == "keep":
        kind = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], kind)
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines]
    return spark.read.schema(kind).option("mode", mode).json(path)


def read_tool_docs(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of files like tools/*/*.json: `category` is the folder, `file` the name without .json.

    Unreadable files, and those that are no object, go to errors with a reason.
    """
    raw = spark.read.option("wholetext", True).text(pattern).select("value", F.input_file_name().alias("path"))
    parts = F.split(F.col("path"), "/")
    raw = raw.select("path", F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), "\\.json$", "").alias("file"), "value", F.try_parse_json("value").alias("v"))
    reason = F.when(F.col("v").isNull(), "invalid_json").when(~F.ltrim("value").startswith("{"), "not_an_object").when(~F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.api_list", "variant")), F.lit("ARRAY")).startswith("ARRAY"), "api_list_not_a_list")
    marked = raw.withColumn("reason", reason)
    good = marked.where("reason is null").select("category", "file", F.from_json("value", TOOL_DOC).alias("d"))
    return good.select("category", "file", "d.*"), marked.where("reason is not null").select("path", "reason")


def catalog(docs: DataFrame) -> DataFrame:
    """One row an API of the tool documents, with a normalised api_id, upper-case method and pricing, and nested qos."""
    upper = lambda c: F.upper(F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("UNKNOWN")))
    tool = standardize(F.coalesce("tool_name", "name", "file"))
    rows = docs.select("*", tool.alias("tool"), F.explode("api_list").alias("a"))
    key = F.concat_ws("/", "category", "tool", change_name(standardize(F.col("a.name"))))
    qos = F.when(F.col("score").isNotNull(), F.col("score"))
    return rows.select(key.alias("api_id"), "category", F.concat_ws("/", "category", "tool").alias("tool_id"), F.col("tool_name"), "tool_description", F.col("a.name").alias("api_name"), F.col("a.description").alias("api_description"), upper(F.col("a.method")).alias("method"), upper(F.col("pricing")).alias("pricing"), F.col("a.required_parameters").alias("required_parameters"), F.col("a.optional_parameters").alias("optional_parameters"), qos.alias("qos"), "host", "home_url")


def candidate_reason(has_cache: Column) -> Column:
    """Why a catalog row is no candidate, by the first that holds; null if it is one."""
    complete = F.lit(True)
    for name in ("avgServiceLevel", "avgLatency", "avgSuccessRate", "popularityScore"):
        x = F.col("qos")[name]
        complete = complete & x.isNotNull() & ~F.isnan(x)
    blank = F.coalesce(F.trim("api_description"), F.lit("")) == ""
    return F.when(blank, "missing_api_description").when(~has_cache, "empty_cache").when(~F.coalesce(complete, F.lit(False)), "incomplete_qos")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A retrieval corpus of tab-separated docid and document_content."""
    return spark.read.option("sep", "\t").option("header", True).schema("docid string, document_content string").csv(path)


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, from whose first name a byte-order mark is taken."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with columns in the order of their names; a job that fails leaves what was there."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """One JSON file of a few rows, such as metadata of a run."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report's table; only for small aggregates, of which it shows `most` rows."""
    rows = [df.columns, *[[str(v) for v in r] for r in df.limit(most).collect()]]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(df.columns), *lines[1:]])


def setting(name: str, env: dict[str, str], config: dict, default: str | None = None) -> str | None:
    """A setting by its environment variable (NAME), else by the configuration (name), else the default; empty ones count as missing."""
    return env.get(name.upper()) or config.get(name) or default


def read_queries(spark: SparkSession, root: str) -> DataFrame:
    """(path, position, query) of every object in every JSON file below `root` that holds an array; other roots and elements are passed over.

    `query` is a variant, so its fields may be of any kind.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    parsed = files.select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("_v")).where(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY")))
    kinds = parsed.select("path", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("position", "query"))
    return kinds.where(F.startswith(F.schema_of_variant("query"), F.lit("OBJECT")))


def query_endpoints(queries: DataFrame) -> DataFrame:
    """(api_id, descriptor): every API that queries name, with its longest description as JSON; of equally long ones that of the first file."""
    from ..functions import ids
    from ..operators.catalog import largest

    apis = queries.select("path", "position", F.posexplode(F.try_variant_get("query", "$.api_list", "array<variant>")).alias("_k", "_a"))
    get = lambda name: F.try_variant_get("_a", f"$.{name}", "string")
    rows = apis.select(ids.api_id(get("category_name"), get("tool_name"), get("api_name")).alias("api_id"), F.to_json("_a").alias("descriptor"), F.xxhash64("path").alias("_p"), (F.col("position") * 100_000 + F.col("_k")).alias("seq"))
    return largest(rows.select("api_id", "descriptor", "seq"), "api_id", "descriptor", "seq").select("api_id", "descriptor")
