"""Writing documents, exports, snapshots and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import safe_file_name


def json_documents(df: DataFrame, path: str, date: str = "crawl_date", keyword: str = "keyword") -> None:
    df.write.mode("append").partitionBy(date, keyword).json(path)


def saved_text(title: str = "title", kind: str = "type", url: str = "url", crawled: str = "crawl_time", body: str = "content") -> Column:
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return F.concat(F.lit("标题："), c(title), F.lit("\n类型："), c(kind), F.lit("\n来源："), c(url), F.lit("\n抓取时间："), c(crawled), F.lit("\n" + "=" * 60 + "\n\n"), c(body))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_page(title: Column, html: Column, text: Column) -> Column:
    """A page with the escaped title and the HTML, or the text where there is no HTML."""
    body = F.coalesce(F.nullif(html, F.lit("")), F.concat(F.lit("<pre>"), escaped(F.coalesce(text, F.lit(""))), F.lit("</pre>")))
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escaped(F.coalesce(title, F.lit(""))), F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def text_files(df: DataFrame, text: Column, path: str) -> None:
    """One text per row, line ends kept by a separator no text holds."""
    df.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\u001e\n").text(path)


def table_file(df: DataFrame, path: str, kind: str = "csv") -> None:
    """csv with a byte order mark on its first header, tsv or json."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    first = df.columns[0]
    named = df.withColumnRenamed(first, "﻿" + first) if kind == "csv" else df
    named.write.mode("overwrite").option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)


def file_names(df: DataFrame, title: str) -> DataFrame:
    """df with `file_name`; of equal names all but the first get a number."""
    from pyspark.sql import Window as W

    base = safe_file_name(F.coalesce(F.col(title), F.lit("")))
    d = df.withColumn("__b", base)
    n = F.row_number().over(W.partitionBy("__b").orderBy(*df.columns[:1]))
    return d.withColumn("file_name", F.when(n == 1, F.col("__b")).otherwise(F.concat("__b", F.lit("_"), n.cast("string")))).drop("__b")


def pack(items: DataFrame, day: str, generated_at: str, token: str, root: str) -> None:
    """A digest pack as one JSON document under its token."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in items.columns])), asc=False)
    items.agg(rows.alias("items")).select(F.lit(day).alias("digest_date"), F.lit(generated_at).alias("generated_at"), "items").coalesce(1).write.mode("overwrite").json(f"{root}/{token}")


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with those of the rows whose key it doesn't have, missing columns NULL."""
    return base.unionByName(rows.dropDuplicates([key]).join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table as a whole, as an import of a confirmed list does."""
    df.write.mode("overwrite").parquet(path)


def repack(packs: DataFrame, root: str) -> None:
    """Write packs again under the tokens they have: one document each; other packs stay."""
    packs.select("digest_date", "generated_at", "items", "token").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("token").json(root)


def summary_page(df: DataFrame, title: str, columns: list[str], most: int = 1000) -> str:
    """A page with a table of the first rows of df; more than `most` rows are an error, as a page is read by people."""
    rows = df.select(*[escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one page")
    body = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><table><tr>{head}</tr>{body}</table></body></html>'


def trace(df: DataFrame, event: str, now: Column, path: str) -> None:
    """Append every row of df as a JSON event with its time."""
    df.select(F.lit(event).alias("event"), now.cast("string").alias("at"), F.to_json(F.struct(*df.columns)).alias("data")).write.mode("append").json(path)


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns (name: type) that it lacks, as NULL."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
