"""Items forwarded to single people: recipients, tickets, and reads by ticket beside reads by dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import split_multi
from gazette.operators.reads import clamp_dwell
from gazette.operators.routing import names_to_accounts

ACCOUNT = "^[A-Za-z0-9_.-]+$"


def account_guess(name: Column, readings: dict[str, str] | None = None) -> Column:
    """An account by the letters and figures of a name; readings: how characters are romanised, where a dictionary is at hand."""
    s = name
    for c, r in (readings or {}).items():
        s = F.replace(s, F.lit(c), F.lit(r))
    return F.nullif(F.lower(F.regexp_replace(s, "[^a-zA-Z0-9]", "")), F.lit(""))


def recipients(df: DataFrame, key: str, cell: str, org: DataFrame, readings: dict[str, str] | None = None) -> DataFrame:
    """key, name, account, how: whom a cell of names and accounts means (a slash separates nothing).

    Accounts are taken as they are, names by the directory, else by their letters; how: account, directory, letters, missing.
    """
    d = df.select(F.col(key).alias("key"), F.explode(split_multi(F.col(cell), slash=False)).alias("name"))
    d = d.join(names_to_accounts(org), d["name"] == F.col("user_name"), "left")
    own, guess = F.col("name").rlike(ACCOUNT), account_guess(F.col("name"), readings)
    account = F.when(own, F.col("name")).otherwise(F.coalesce("user_account", guess))
    how = F.when(own, "account").when(F.col("user_account").isNotNull(), "directory").when(guess.isNotNull(), "letters").otherwise("missing")
    return d.select("key", "name", account.alias("account"), how.alias("how"))


def tickets(items: DataFrame, to: DataFrame, token: Column, now: Column) -> DataFrame:
    """One ticket per item and account: ticket, record_id, to_userid, digest_token, created_at.  The same input gives the same tickets."""
    t = F.md5(F.concat_ws("|", F.col("record_id").cast("string"), "account", token, now.cast("string")))
    return items.join(to.filter("account is not null").select("key", "account").distinct(), "key").select(t.alias("ticket"), "record_id", F.col("account").alias("to_userid"), token.alias("digest_token"), now.alias("created_at"))


def all_reads(reads: DataFrame, dispatch: DataFrame, tickets: DataFrame) -> DataFrame:
    """id, record_id, reader_userid, read_at, dwell, source_type, token: reads of what was sent, and of what was forwarded."""
    cols = ["id", "record_id", "reader_userid", "read_at", clamp_dwell().alias("dwell")]
    sent = dispatch.filter("send_status = 'SENT'").select("dispatch_id", F.coalesce("digest_token", F.lit("")).alias("t"))
    a = reads.join(sent, "dispatch_id").select(*cols, F.lit("dispatch").alias("source_type"), F.lower(F.trim("t")).alias("token"))
    f = tickets.select(F.col("ticket").alias("dispatch_id"), "record_id", F.coalesce("digest_token", F.lit("")).alias("t"))
    b = reads.join(f, ["dispatch_id", "record_id"]).select(*cols, F.lit("forward").alias("source_type"), F.lower(F.trim("t")).alias("token"))
    return a.unionByName(b)


def state(r: DataFrame) -> DataFrame:
    """token, record_id, reader_userid, read_at, dwell of all reads; forwarded ones without a token are left out."""
    d = r.filter("source_type = 'dispatch' or token <> ''")
    return d.groupBy("token", "record_id", "reader_userid").agg(F.max("read_at").alias("read_at"), F.max("dwell").alias("dwell"))


def may_read(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """The events of people to whom the ticket was given (events may be a stream)."""
    return events.join(tickets.select(F.col("ticket").alias("dispatch_id"), "record_id", F.col("to_userid").alias("reader_userid")), ["dispatch_id", "record_id", "reader_userid"], "left_semi")
