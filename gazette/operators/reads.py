"""Who has been sent and has read what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp_dwell(c: str = "dwell_seconds") -> Column:
    return F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(86400))


def sent_reads(reads: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Reads of dispatches that were sent, with their token."""
    d = dispatch.filter("send_status = 'SENT'").select("dispatch_id", F.lower(F.trim("digest_token")).alias("token"), "receiver_userid")
    return reads.join(d, "dispatch_id")


def read_state(r: DataFrame, *keys: str) -> DataFrame:
    """Last read and longest dwell per key, the dwell of NULL being 0."""
    return r.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max("read_at").alias("read_at"), F.max(clamp_dwell()).alias("dwell"))


def best_read(r: DataFrame, *keys: str) -> DataFrame:
    """The read with the greatest dwell per key; of equal ones the first by id."""
    order = F.struct(clamp_dwell(), -F.col("id"))
    return r.groupBy(*keys).agg(F.max_by(F.struct("id", "read_at", clamp_dwell().alias("dwell")), order).alias("b")).select(*keys, "b.id", "b.read_at", "b.dwell")


def funnel(roster: DataFrame, state: DataFrame, by: str | None = None) -> DataFrame:
    """total, seen, unseen, pct (one decimal, 0 without any) of a roster (token, record_id, reader_userid), overall or per `by`."""
    k = ["token", "record_id", "reader_userid"]
    d = roster.join(state.select(*k, "read_at"), k, "left")
    g = d.groupBy(by) if by else d.groupBy()
    a = g.agg(F.count("*").alias("total"), F.count("read_at").alias("seen"))
    a = a.withColumn("unseen", F.col("total") - F.col("seen"))
    return a.withColumn("pct", F.when(F.col("total") > 0, F.round(F.col("seen") * 1000 / F.col("total")) / 10).otherwise(0.0))


def tokens_per_read(r: DataFrame) -> DataFrame:
    """record_id, reader_userid, tokens (distinct, in order), last read, dwell; only what was read."""
    return r.groupBy("record_id", "reader_userid").agg(F.array_join(F.sort_array(F.collect_set("token")), ",").alias("tokens"), F.max("read_at").alias("read_at"), F.max(clamp_dwell()).alias("dwell")).filter("read_at is not null and reader_userid is not null")


def outside(reads: DataFrame, dispatch: DataFrame, routes: DataFrame) -> DataFrame:
    """Reads by people who are on no route: without a token, or without a route for token, record and reader.

    routes: record_id, user.  A route of token, record and reader is one of record and reader whose reader is a receiver of the
    token, so both are looked up by themselves: the records of a user are never paired with the tokens of that user.
    """
    d = dispatch.select("dispatch_id", F.lower(F.trim("digest_token")).alias("token"), "receiver_userid")
    r = reads.join(d.select("dispatch_id", "token"), "dispatch_id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    sent = d.select("token", F.col("receiver_userid").alias("reader_userid"), F.lit(1).alias("sent")).distinct()
    on = routes.select("record_id", F.col("user").alias("reader_userid"), F.lit(1).alias("on")).distinct()
    r = r.join(sent, ["token", "reader_userid"], "left").join(on, ["record_id", "reader_userid"], "left")
    return r.filter("token = '' or sent is null or on is null").drop("sent", "on")


def top_readers(reads: DataFrame, n: int) -> DataFrame:
    return reads.filter("reader_userid is not null").groupBy("reader_userid").agg(F.count("*").alias("n_reads"), F.countDistinct("record_id").alias("n_records")).orderBy(F.desc("n_reads"), "reader_userid").limit(n)


def dispatch_report(dispatch: DataFrame, reads: DataFrame, items: int = 40) -> DataFrame:
    """Every dispatch with the number of its reads and its last `items` read records (newest first, then by record)."""
    w = W.partitionBy("dispatch_id").orderBy(F.desc("read_at"), "record_id", "id")
    last = reads.withColumn("rn", F.row_number().over(w))
    agg = last.groupBy("dispatch_id").agg(F.count("*").alias("n_reads"), F.sort_array(F.collect_list(F.when(F.col("rn") <= items, F.struct("rn", "record_id")))).alias("r"))
    r = agg.select("dispatch_id", "n_reads", F.array_join(F.transform("r", lambda x: x["record_id"].cast("string")), ",").alias("records"))
    return dispatch.select("dispatch_id", "send_status", "receiver_userid", "item_count", F.col("first_read_at").isNotNull().alias("opened")).join(r, "dispatch_id", "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))


def item_readers(reads: DataFrame, record_id: int, first: DataFrame, n: int = 200) -> DataFrame:
    """The last n reads of a record, then those by people in `first` (user) before the others."""
    top = reads.filter(F.col("record_id") == record_id).orderBy(F.desc("read_at"), F.desc("id")).limit(n)
    return top.join(first.select(F.col("user").alias("reader_userid"), F.lit(1).alias("own")).distinct(), "reader_userid", "left").select("id", "reader_userid", "read_at", F.coalesce("own", F.lit(0)).alias("own")).orderBy(F.desc("own"), F.desc("read_at"))


def capped_titles(d: DataFrame, key: str, title: str, order: Column, n: int) -> DataFrame:
    """key, n_all, titles: the first n titles per key, joined."""
    w = W.partitionBy(key).orderBy(order)
    x = d.withColumn("rn", F.row_number().over(w))
    return x.groupBy(key).agg(F.count("*").alias("n_all"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= n, F.struct("rn", F.coalesce(F.col(title), F.lit("")).alias("t"))))), lambda s: s["t"]), "|").alias("titles"))
