"""Crawled documents, saved texts, pages, manifests and imports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "title string, info_type string, url string, crawl_time string, text_blocks array<string>, tables array<array<array<string>>>, content string, _corrupt_record string"
MANIFEST = "digest_date string, generated_at string, items array<struct<id: bigint, title: string, sub_type: string, project_owner: string>>"
TOKEN = "^[a-f0-9]{32}$"


def json_documents(spark: SparkSession, *paths: str, skip: str = "汇总") -> DataFrame:
    """One row per JSON file of the paths and the folders under them: the raw fields, keyword and crawl_date (from the
    folders <date>/<keyword>/), file, ord (by path) and bad (the file is not readable as JSON).

    A path given twice is read once; files whose name contains `skip` are left out; missing keys are NULL.
    """
    d = spark.read.schema(RAW).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(list(dict.fromkeys(paths)))
    d = d.withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("file", "/")
    d = d.filter(~F.contains(F.col("_metadata.file_name"), F.lit(skip)))
    return d.select("*", F.try_url_decode(F.element_at(parts, -2)).alias("keyword"), F.element_at(parts, -3).alias("crawl_date"), F.col("_corrupt_record").isNotNull().alias("bad")).drop("_corrupt_record")


def unique_items(docs: DataFrame) -> DataFrame:
    """The first document (by file) of each title and url."""
    from pyspark.sql import Window as W

    w = W.partitionBy("title", "url").orderBy("file")
    return docs.filter(~F.col("bad")).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def saved_texts(spark: SparkSession, path: str) -> DataFrame:
    """title, type, source, crawled, body of saved text files: labelled lines, a rule of equal signs, the body."""
    d = spark.read.option("wholetext", True).text(path)
    return d.select(*parse_saved(F.col("value")))


def parse_saved(c: Column) -> list[Column]:
    t = F.regexp_replace(c, "\\r\\n", "\n")
    line = lambda label: F.nullif(F.trim(F.regexp_extract(t, f"(?m)^{label}[：:]([^\\n]*)$", 1)), F.lit(""))
    after_rule = F.regexp_extract(t, "(?s)\\n={10,}[^\\n]*\\n(.*)$", 1)
    after_blank = F.regexp_extract(t, "(?s)^.*?\\n\\s*\\n(.*)$", 1)
    body = F.coalesce(F.nullif(F.trim(after_rule), F.lit("")), F.nullif(F.trim(after_blank), F.lit("")), F.trim(t))
    return [line("标题").alias("title"), line("类型").alias("type"), line("来源").alias("source"), line("抓取时间").alias("crawled"), body.alias("body")]


def page_meta(c: Column) -> Column:
    """struct(title, n_pages, file_id, images) of an HTML page."""
    from gazette.functions.text import image_sources, squeeze

    return F.struct(
        squeeze(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(c, "(?i)(?:pageCount|totalPages?)[\"'\\s:=]+(\\d+)", 1).try_cast("int").alias("n_pages"),
        F.nullif(F.regexp_extract(c, "fdId=([A-Za-z0-9]+)", 1), F.lit("")).alias("file_id"),
        image_sources(c).alias("images"),
    )


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """token, digest_date, generated_at, items of the packs <root>/<token>/manifest.json whose token is well formed."""
    d = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    token = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return d.withColumn("token", token).filter(F.col("token").rlike(TOKEN))


# fixed values: headers of lead lists and the columns they mean
HEADERS = {"customer_name": ["customer_name", "客户名称", "客户"], "sales": ["sales", "销售", "销售人员"], "lead_row_id": ["lead_row_id", "线索id"], "sales_from_row_id": ["sales_from_row_id"], "register_date_latest": ["register_date_latest", "最新登记日期"], "register_date_sales": ["register_date_sales", "登记日期"]}


def lead_list(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A lead list with Chinese or English headers; blank rows left out, numbers and dates cast where they can be."""
    d = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    plain = {c: c.replace("﻿", "").strip().lower().replace(" ", "_") for c in d.columns}
    cols = []
    for name, ways in HEADERS.items():
        have = [c for c, p in plain.items() if p in ways]
        v = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in have]) if have else F.lit(None).cast("string")
        kind = T.LongType() if name.endswith("row_id") else T.DateType() if "date" in name else T.StringType()
        cols.append((v.try_cast(kind) if not isinstance(kind, T.StringType) else v).alias(name))
    return d.select(*cols).filter("customer_name is not null")


def has_columns(df: DataFrame, *names: str) -> list[str]:
    """Those of the names that df has: plans over tables of varying width are built from this."""
    return [n for n in names if n in df.columns]


def table_scan(spark: SparkSession, name: str | None = None, **jdbc: str) -> DataFrame:
    """A catalog table, or one over JDBC (url, dbtable, and for parallel reads partitionColumn, bounds, numPartitions)."""
    return spark.table(name) if name else spark.read.format("jdbc").options(**jdbc).load()


PENDING_SEND = "token string, digest_date string, title string, description string, card_url string, disclose_page_url string, generated_at string, pipeline_note string"


def pending_send(spark: SparkSession, path: str) -> DataFrame:
    """The document of what waits to be sent; no row if its token is not well formed."""
    return spark.read.schema(PENDING_SEND).option("multiLine", True).json(path).filter(F.col("token").rlike(TOKEN))


def tokens(spark: SparkSession, root: str) -> DataFrame:
    """The distinct tokens of the packs under a folder."""
    return manifests(spark, root).select("token").distinct()


def workbook(path: str):
    """A lead list in a workbook, as pandas reads it: only where a reader of workbooks is installed."""
    import pandas as pd

    return pd.read_excel(path, dtype=str)


def failed_by_url(docs: DataFrame, marks: list[str]) -> DataFrame:
    """url, files, keywords of documents whose content holds a mark of failure, one row per url."""
    from gazette.functions.rules import any_of

    d = docs.filter(any_of(F.col("content"), marks) & (F.trim(F.coalesce("url", F.lit(""))) != ""))
    return d.groupBy("url").agg(F.sort_array(F.collect_set("file")).alias("files"), F.sort_array(F.collect_set("keyword")).alias("keywords"))
