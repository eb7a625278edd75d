"""Bringing crawled rows into the table: gates, duplicates, upserts, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.functions.text import fit

# fixed values: widths of the columns
WIDTHS = {"keyword": 200, "type": 100, "sub_type": 100, "title": 500, "province": 100, "city": 100, "district": 100, "project_no": 100, "project_budget": 100, "winning_amount": 100, "bidding_method": 100, "project_owner": 255, "owner_contact": 100, "owner_phone": 50, "winning_bidder": 255, "winning_bidder_contact": 100, "winning_bidder_phone": 50, "bidding_agent": 255, "detail_url": 1000, "product_related": 500, "reserve1": 500, "reserve2": 500, "audit_status": 32, "detail": 65535}


def fitted(df: DataFrame) -> DataFrame:
    """Every text column stripped, cut to its width, '' as NULL."""
    return df.withColumns({c: fit(F.col(c), WIDTHS.get(c, 65535)) for c, t in df.dtypes if t == "string"})


def first_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows without the key stay as they are."""
    has = F.trim(F.coalesce(F.col(key), F.lit(""))) != ""
    first = df.filter(has).withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")
    return first.unionByName(df.filter(~has))


def settle(df: DataFrame, key: str, order: str, done: Column) -> DataFrame:
    """key, id: of the rows of each key, the first that is `done`, else the last: later rows replace only rows not done."""
    first = F.min_by(F.when(done, F.col("id")), F.when(done, F.col(order)))
    return df.filter(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).agg(F.coalesce(first, F.max_by("id", order)).alias("id"))


def outcomes(batch: DataFrame, known: DataFrame, done: Column) -> DataFrame:
    """id, outcome of each row of a batch against the table: skipped_type, updated, duplicate_url, duplicate_title, inserted."""
    k = known.filter(F.trim(F.coalesce("detail_url", F.lit(""))) != "").groupBy("detail_url").agg(F.max(F.when(done, 1).otherwise(0)).alias("__done"))
    t = known.filter((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("project_no", F.lit(""))) != "")).select("title", "project_no", F.lit(1).alias("__seen")).distinct()
    d = batch.join(k, "detail_url", "left").join(t, ["title", "project_no"], "left")
    skip = F.coalesce(F.col("type").isin("拍卖转让", "拍卖", "转让"), F.lit(False))
    out = F.when(skip, "skipped_type").when(F.col("__done") == 0, "updated").when(F.col("__done") == 1, "duplicate_url").when(F.col("__seen") == 1, "duplicate_title").otherwise("inserted")
    return d.select("id", out.alias("outcome"))


def upsert(base: DataFrame, new: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """base with the rows of new: values of new where the key exists, NULLs too, `keep` as it was, updated_at = now;
    rows of new without a counterpart are added."""
    cols = base.columns
    n = new.select(*[F.col(c).alias("__" + c) for c in cols if c in new.columns])
    j = base.join(n, F.col(key) == F.col("__" + key), "full_outer")
    hit = F.col("__" + key).isNotNull()

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(hit, now).otherwise(F.col(c)).alias(c)
        if c == key or "__" + c not in n.columns:
            return F.coalesce(F.col(c), F.col("__" + c)).alias(c) if "__" + c in n.columns else F.col(c).alias(c)
        if c in keep:
            return F.coalesce(F.col(c), F.col("__" + c)).alias(c)
        return F.when(hit, F.col("__" + c)).otherwise(F.col(c)).alias(c)

    return j.select(*[value(c) for c in cols])


def table_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, block, first_line, n_rows, n_cells of runs of lines that are rows of a table (two cells or more, set off by tabs)."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n", -1)).alias("pos", "line"))
    cells = F.size(F.filter(F.split("line", "\t"), lambda x: F.trim(x) != ""))
    d = lines.withColumn("cells", cells).filter("cells >= 2")
    w = W.partitionBy("id").orderBy("pos")
    d = d.withColumn("block", F.col("pos") - F.row_number().over(w))
    return d.groupBy("id", "block").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_rows"), F.sum("cells").alias("n_cells")).drop("block")


def zipped(df: DataFrame, id_col: str, left: str, right: str, missing: str = "—") -> DataFrame:
    """id, pos, left, right: two |-lists side by side, a missing partner as a dash."""
    a, b = (F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\\|"), lambda v: F.trim(v)) for c in (left, right))
    n = F.greatest(F.size(a), F.size(b))
    part = lambda x, i: F.coalesce(F.nullif(F.get(x, i), F.lit("")), F.lit(missing))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).alias("pos"), part(a, i).alias("left_value"), part(b, i).alias("right_value")))
    return df.filter(F.trim(F.coalesce(F.col(left), F.lit(""))) != "").select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.pos", "p.left_value", "p.right_value")


def update_known(base: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """`upsert` with those rows of new only whose key base has."""
    return upsert(base, new.join(base.select(key), key, "left_semi"), key, now)


def pending_of_day(df: DataFrame, day: Column) -> DataFrame:
    """Rows of a day that wait for their audit and have an address, the first of each address."""
    d = df.filter((F.trim("audit_status") == "待审核") & (F.to_date("created_at") == day) & (F.trim(F.coalesce("detail_url", F.lit(""))) != ""))
    return d.groupBy("detail_url").agg(F.min("id").alias("id"))
