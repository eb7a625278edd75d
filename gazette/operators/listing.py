"""Lists of announcements: filters, facets, pages, options."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.rules import AWARD_GROUP, TENDER_GROUP

APPROVED = "审核通过"
PENDING = "待审核"
SEARCHED = ["title", "project_owner", "winning_bidder", "project_no"]
LIST_COLUMNS = ["id", "keyword", "type", "sub_type", "title", "province", "city", "published_at", "project_no", "project_budget", "winning_amount", "bidding_method", "project_owner", "winning_bidder", "bid_deadline", "detail_url", "product_related", "created_at", "updated_at"]


def approved(c: Column | str = "audit_status") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(APPROVED)) == APPROVED


def enabled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(1)) == 1


def not_deleted(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) == 0


def not_blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


@dataclass
class ListFilter:
    """What a list is asked for; an unset part filters nothing.  Patterns in `keyword` and `product` stay LIKE patterns."""

    audit: str = "approved"  # approved, pending, all
    keyword: str | None = None
    sub_type: str | None = None  # 招标公告 and 中标结果 stand for their groups
    product: str | None = None
    created: tuple[date | None, date | None] = (None, None)
    published: tuple[date | None, date | None] = (None, None)
    searched: list[str] = field(default_factory=lambda: list(SEARCHED))

    def column(self, skip: tuple[str, ...] = ()) -> Column:
        """The filter without the parts named in skip."""
        c = {"approved": approved(), "pending": F.trim("audit_status") == PENDING, "all": F.lit(True)}[self.audit]
        if self.keyword and "keyword" not in skip:
            hit = F.lit(False)
            for f in self.searched:
                hit = hit | F.coalesce(F.col(f).like(f"%{self.keyword}%"), F.lit(False))
            c = c & hit
        if self.sub_type and "sub_type" not in skip:
            group = {"招标公告": TENDER_GROUP, "中标结果": AWARD_GROUP}.get(self.sub_type)
            c = c & (F.trim("sub_type").isin(*group) if group else F.trim("sub_type") == self.sub_type)
        if self.product and "product" not in skip:
            c = c & F.col("product_related").like(f"%{self.product}%")
        for name, col, (lo, hi) in (("created", "created_at", self.created), ("published", "published_at", self.published)):
            if name in skip:
                continue
            if lo:
                c = c & (F.to_date(col) >= F.lit(lo))
            if hi:
                c = c & (F.to_date(col) <= F.lit(hi))
        return c


def page(df: DataFrame, flt: ListFilter, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the list, newest first; number from 1, size 1 to 100."""
    size, number = max(1, min(100, size)), max(1, number)
    cols = [c for c in LIST_COLUMNS if c in df.columns]
    return df.filter(flt.column()).select(*cols, F.col("reserve2").alias("product_related_terms")).orderBy(F.desc("id")).offset((number - 1) * size).limit(size)


def total(df: DataFrame, flt: ListFilter) -> DataFrame:
    return df.filter(flt.column()).agg(F.count("*").alias("total"))


def facets(df: DataFrame, flt: ListFilter) -> DataFrame:
    """Counts beside a list, each without its own filter: kinds without kind and product, products without product and
    publication."""
    kinds, products = (F.coalesce(flt.column(skip), F.lit(False)) for skip in (("sub_type", "product"), ("product", "published")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sub = F.trim("sub_type")
    return df.filter(kinds | products).agg(
        n(kinds & sub.isin(*TENDER_GROUP)).alias("tenders"),
        n(kinds & sub.isin(*AWARD_GROUP)).alias("awards"),
        n(kinds).alias("all_kinds"),
        n(products & F.contains("product_related", F.lit("软件"))).alias("software"),
        n(products & F.contains("product_related", F.lit("硬件"))).alias("hardware"),
    )


def options(df: DataFrame, col: str) -> DataFrame:
    return df.filter(not_blank(col)).select(F.trim(col).alias(col)).distinct()


def distribution(df: DataFrame, col: str, empty: str = "(空)") -> DataFrame:
    """Counts per value, blanks as one bucket."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(empty)).alias(col)).agg(F.count("*").alias("cnt"))


def prioritised(df: DataFrame, words: str, size: int) -> DataFrame:
    """The first rows with the words in front, then by id downwards."""
    front = F.when(F.coalesce(F.contains("title", F.lit(words)), F.lit(False)), 0).otherwise(1)
    return df.select("id", "title", front.alias("front")).orderBy("front", F.desc("id")).limit(size)
