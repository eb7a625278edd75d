"""Digest packs: their list, their items with those in charge, edits, dispatch records, and reads by sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.listing import PENDING


def pack_list(packs: DataFrame, pending: DataFrame) -> DataFrame:
    """token, digest_date, generated_at, item_count, pinned: packs that wait to be sent first, then the newest."""
    w = pending.select("token", F.lit(1).alias("pinned")).distinct()
    d = packs.select("token", "digest_date", "generated_at", F.size("items").alias("item_count")).join(w, "token", "left")
    return d.withColumn("pinned", F.coalesce("pinned", F.lit(0))).orderBy(F.desc("pinned"), F.desc("generated_at"), "token")


def watched(items: DataFrame, routes: DataFrame, viewer: Column) -> DataFrame:
    """items (token, record_id) with names and customers (sorted lists) of those in charge, and `mine`: the viewer is one."""
    r = routes.groupBy("token", "record_id").agg(
        F.array_join(F.sort_array(F.collect_set("user_name")), ",").alias("names"), F.array_join(F.sort_array(F.collect_set("customer")), ",").alias("customers"), F.max(F.when(F.col("user_account") == viewer, 1).otherwise(0)).alias("mine")
    )
    return items.join(r, ["token", "record_id"], "left").withColumns({"names": F.coalesce("names", F.lit("")), "customers": F.coalesce("customers", F.lit("")), "mine": F.coalesce("mine", F.lit(0))})


def without_item(packs: DataFrame, token: Column, record_id: Column) -> DataFrame:
    """The packs, with the item taken out of the one of the token."""
    return packs.withColumn("items", F.when(F.col("token") == token, F.filter("items", lambda x: x["id"] != record_id)).otherwise(F.col("items")))


def set_status(df: DataFrame, ids: DataFrame, status: str = PENDING, now: Column | None = None) -> DataFrame:
    """df with audit_status, and updated_at if `now` is given, of the rows in ids (id) set."""
    hit = ids.select("id", F.lit(True).alias("__hit")).distinct()
    d = df.join(hit, "id", "left")
    d = d.withColumn("audit_status", F.when(F.col("__hit"), status).otherwise(F.col("audit_status")))
    d = d.withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))) if now is not None else d
    return d.select(*df.columns)


def dispatch_rows(per_user: DataFrame, token: Column, now: Column, failed: DataFrame | None = None) -> DataFrame:
    """One row of the dispatch log per receiver; failed: user_account, send_error of those that could not be reached."""
    d = per_user
    d = d.join(failed.select("user_account", "send_error"), "user_account", "left") if failed is not None else d.withColumn("send_error", F.lit(None).cast("string"))
    return d.select(F.md5(F.concat_ws("|", token, "user_account", now.cast("string"))).alias("dispatch_id"), token.alias("digest_token"), F.col("user_account").alias("receiver_userid"), F.col("owners").alias("receiver_customer"), "item_count", F.when(F.col("send_error").isNull(), "SENT").otherwise("FAILED").alias("send_status"), "send_error", F.lit(0).alias("read_count"), now.alias("created_at"))


def read_sheet(routes: DataFrame, state: DataFrame, titles: DataFrame, status: str = "all", reader: str | None = None, title: str | None = None, merged: bool = False, size: int = 50, number: int = 1) -> DataFrame:
    """A page of who is in charge of what and has read it: token, record_id, reader_userid, user_name, title, read_at, dwell.

    status: all, seen or unseen; reader: part of the account or name; title: part of the title; merged: a day's packs as
    one, reads counting whatever pack they came by.  Newest first, then by record downwards and reader.
    """
    keys = ["record_id", "reader_userid"] if merged else ["token", "record_id", "reader_userid"]
    r = routes.withColumnRenamed("user_account", "reader_userid")
    s = state.groupBy(*keys).agg(F.max("read_at").alias("read_at"), F.max("dwell").alias("dwell"))
    d = r.join(s, keys, "left").join(titles, "record_id", "left").withColumn("dwell", F.coalesce("dwell", F.lit(0)))
    if status != "all":
        d = d.filter(F.col("read_at").isNotNull() if status == "seen" else F.col("read_at").isNull())
    if reader:
        d = d.filter(F.col("reader_userid").like(f"%{reader}%") | F.coalesce("user_name", F.lit("")).like(f"%{reader}%"))
    if title:
        d = d.filter(F.col("title").like(f"%{title}%"))
    size, number = max(1, min(200, size)), max(1, number)
    d = d.select("token", "record_id", "reader_userid", "user_name", "title", "read_at", "dwell")
    return d.orderBy(F.desc_nulls_last("read_at"), F.desc("record_id"), "reader_userid", "token").offset((number - 1) * size).limit(size)


def gained(before: DataFrame, after: DataFrame, id_col: str = "id", field: str = "project_owner") -> DataFrame:
    """ok, fail, gained: rows that were processed again, were not, and have the field now and had it not."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    d = before.select(F.col(id_col).alias("k"), F.col(field).alias("a")).join(after.select(F.col(id_col).alias("k"), F.col(field).alias("b"), F.lit(1).alias("done")), "k", "left")
    return d.agg(F.count("done").alias("ok"), F.count_if(F.col("done").isNull()).alias("fail"), F.count_if(blank(F.col("a")) & ~blank(F.col("b"))).alias("gained"))
