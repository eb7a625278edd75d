"""From owner to customer to the people in charge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.functions.text import normal_owner, split_multi
from gazette.operators.listing import enabled, not_blank, not_deleted


def latest_sales(leads: DataFrame) -> DataFrame:
    """customer_name, sales, lead_row_id, sales_from_row_id: the last sales that is not blank, else the last row."""
    when = F.coalesce("updated_at", "created_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    order = F.struct(when, F.col("id"))
    filled = not_blank("sales")
    key = F.trim("customer_name").alias("customer_name")
    return leads.filter(not_blank("customer_name")).groupBy(key).agg(
        F.max_by("id", order).alias("lead_row_id"),
        F.max_by(F.when(filled, F.trim("sales")), F.when(filled, order)).alias("sales"),
        F.max_by(F.when(filled, F.col("id")), F.when(filled, order)).alias("sales_from_row_id"),
    )


def names_to_accounts(org: DataFrame) -> DataFrame:
    """user_name, user_account: one account per name that is not deleted, the smallest."""
    return org.filter(not_deleted("is_deleted") & not_blank("user_name") & not_blank("user_account")).groupBy(F.trim("user_name").alias("user_name")).agg(F.min(F.trim("user_account")).alias("user_account"))


def account_names(org: DataFrame) -> DataFrame:
    return org.filter(not_blank("user_account")).groupBy(F.trim("user_account").alias("user_account")).agg(F.min(F.trim("user_name")).alias("display_name"))


def first_lead(leads: DataFrame, key: Column) -> DataFrame:
    """key, lead_id, customer, sales of the first enabled lead with sales under each key."""
    k = leads.filter(enabled("enabled") & not_blank("customer_name") & not_blank("sales")).select(key.alias("key"), F.struct("id", F.trim("customer_name").alias("customer"), F.col("sales").alias("sales")).alias("lead")).filter("key <> ''")
    return k.groupBy("key").agg(F.min_by("lead", "lead.id").alias("lead")).select("key", F.col("lead.id").alias("lead_id"), F.col("lead.customer").alias("customer"), F.col("lead.sales").alias("sales"))


def resolve(owners: DataFrame, leads: DataFrame) -> DataFrame:
    """owner, lead_id, customer, sales, how: the exact lead, else the lead of the same normal name.

    Owners are made distinct first, so the names of a hot owner are resolved once.
    """
    o = owners.filter(not_blank("project_owner")).select(F.trim("project_owner").alias("owner")).distinct()
    exact = first_lead(leads, F.trim("customer_name"))
    near = first_lead(leads, normal_owner(F.col("customer_name")))
    a = o.join(exact, F.col("owner") == F.col("key"), "left").drop("key")
    b = a.withColumn("norm", normal_owner(F.col("owner"))).join(near.select(F.col("key"), F.col("lead_id").alias("l2"), F.col("customer").alias("c2"), F.col("sales").alias("s2")), F.col("norm") == F.col("key"), "left")
    how = F.when(F.col("lead_id").isNotNull(), "exact").when(F.col("l2").isNotNull(), "normal").otherwise("none")
    return b.select("owner", F.coalesce("lead_id", "l2").alias("lead_id"), F.coalesce("customer", "c2").alias("customer"), F.coalesce("sales", "s2").alias("sales"), how.alias("how"))


def fuzzy(owners: DataFrame, customers: DataFrame, least: int = 4, gram: int = 4) -> DataFrame:
    """owner, customer: names of which the shorter (at least `least` characters) is contained in the longer.

    Candidates come from an equi-join: a name that contains another contains the other's first `gram` characters, so
    the grams of each side are probed with the other's head; no pair without a common gram is ever formed.
    """
    def named(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.select(F.trim(col).alias(out)).distinct().withColumn(out + "_n", normal_owner(F.col(out))).filter(F.char_length(out + "_n") >= max(least, gram))

    a, b = named(owners, "project_owner", "owner"), named(customers, "customer_name", "customer")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - (gram - 1)), lambda i: F.substring(c, i, F.lit(gram)))))
    pair = lambda x, y, xn, yn: x.withColumn("g", grams(F.col(xn))).join(y.withColumn("g", F.substring(yn, 1, gram)), "g").filter(F.contains(xn, F.col(yn))).select("owner", "customer")
    return pair(a, b, "owner_n", "customer_n").unionByName(pair(b, a, "customer_n", "owner_n")).distinct()


def longest(links: DataFrame) -> DataFrame:
    """owner, customer: the longest customer name per owner, ties to the smaller name."""
    w = W.partitionBy("owner").orderBy(F.desc(F.char_length("customer")), "customer")
    return links.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def user_routes(items: DataFrame, resolved: DataFrame, org: DataFrame) -> DataFrame:
    """record_id, owner, user_account, user_name, customer: one row per item and person in charge."""
    r = resolved.filter("sales is not null").select("owner", "customer", F.explode(split_multi(F.col("sales"))).alias("user_name"))
    r = r.join(names_to_accounts(org), "user_name")
    i = items.filter(not_blank("project_owner")).select(F.col("id").alias("record_id"), F.trim("project_owner").alias("owner"))
    return i.join(r, "owner").select("record_id", "owner", "user_account", "user_name", "customer")


def per_user(routes: DataFrame) -> DataFrame:
    """user_account, item_count (rows), owners and names as sorted lists."""
    return routes.groupBy("user_account").agg(F.count("*").alias("item_count"), F.array_join(F.sort_array(F.collect_set("owner")), ",").alias("owners"), F.array_join(F.sort_array(F.collect_set("user_name")), ",").alias("names"))


def match_rate(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """total, with_owner, matched, customers, rate (text with two decimals)."""
    r = resolved.filter("how <> 'none'").select("owner", "customer")
    d = items.select(F.trim(F.coalesce("project_owner", F.lit(""))).alias("owner")).groupBy("owner").agg(F.count("*").alias("n")).join(r, "owner", "left")
    s = d.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("owner") != "", F.col("n")).otherwise(0)).alias("with_owner"), F.sum(F.when(F.col("customer").isNotNull(), F.col("n")).otherwise(0)).alias("matched"), F.countDistinct("customer").alias("customers"))
    return s.withColumn("rate", F.format_string("%.2f%%", F.when(F.col("with_owner") > 0, 100.0 * F.col("matched") / F.col("with_owner")).otherwise(0.0)))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, side: normal names in both sets, and in one only."""
    a = left.select(normal_owner(F.col("project_owner")).alias("name")).filter("name <> ''").distinct()
    b = right.select(normal_owner(F.col("customer_name")).alias("name")).filter("name <> ''").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("owners"))).unionByName(b.subtract(a).withColumn("side", F.lit("customers")))


def shortlist(names: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """name, candidate, shared: the `size` pool names with most distinct characters in common (more than one).

    Pairs meet on a shared character, counted, so that only pairs with something in common are formed; pool is a
    reference list.
    """
    chars = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))
    a = names.select("name", chars(F.col("name")).alias("ch"))
    b = pool.select("candidate", chars(F.col("candidate")).alias("ch"))
    n = a.join(b, "ch").groupBy("name", "candidate").agg(F.count("*").alias("shared")).filter("shared > 1")
    w = W.partitionBy("name").orderBy(F.desc("shared"), "candidate")
    return n.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= size).drop("rn")
