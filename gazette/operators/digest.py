"""Dated digests: the latest day, the window of two days, counts, snapshots, search in a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.functions.rules import AWARD_GROUP, TENDER_GROUP
from gazette.operators.listing import approved

CAP = 8000


def latest_day(df: DataFrame) -> DataFrame:
    """day: the last day on which an approved row was created or updated."""
    return df.filter(approved()).agg(F.max(F.greatest(F.to_date("created_at"), F.to_date("updated_at"))).alias("day"))


def in_window(day: Column) -> Column:
    """Created or updated on the day or the next."""
    hit = lambda c: F.to_date(c).between(day, F.date_add(day, 1))
    return F.coalesce(hit("created_at"), F.lit(False)) | F.coalesce(hit("updated_at"), F.lit(False))


def days_of(df: DataFrame) -> DataFrame:
    """id, day for every digest a row belongs to (windows of two days, one a day, on two time columns)."""
    spans = F.array_distinct(F.flatten(F.array(*[F.when(F.col(c).isNotNull(), F.sequence(F.date_sub(F.to_date(c), 1), F.to_date(c))).otherwise(F.array().cast("array<date>")) for c in ("created_at", "updated_at")])))
    return df.filter(approved()).select("id", "sub_type", F.explode(spans).alias("day"))


def counts_by_day(df: DataFrame) -> DataFrame:
    """day, tenders, awards (groups of labels) and n of every digest."""
    s = F.trim("sub_type")
    return days_of(df).groupBy("day").agg(F.count_if(s.isin(*TENDER_GROUP)).alias("tenders"), F.count_if(s.isin(*AWARD_GROUP)).alias("awards"), F.count("*").alias("n"))


def snapshot(df: DataFrame, day: Column, cap: int = CAP) -> DataFrame:
    """The newest rows of a digest, at most `cap` (a digest's size is its feature)."""
    return df.filter(approved() & in_window(day)).select("id", "title", "sub_type", "project_owner", "winning_bidder", "created_at", "updated_at").orderBy(F.desc("id")).limit(cap)


def title_of(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" 招标信息摘要"))


def search(df: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Rows that contain every term in some field; a term can't span fields."""
    hay = F.lower(F.array_join(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]), "\u0001"))
    c = F.lit(True)
    for t in terms:
        c = c & F.contains(hay, F.lit(t.lstrip("@").lower()))
    return df.filter(c)


def display_rank(df: DataFrame, mine: Column, hits: Column) -> DataFrame:
    """df with `rank` per token: own rows first, then more hits, then the order of the snapshot (id downwards)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("token").orderBy(F.desc(mine), F.desc(hits), F.desc("id"))))
