"""From an owner to the customer and the people in charge, by ways that are tried one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import normal_owner
from gazette.operators.listing import enabled, not_blank
from gazette.operators.routing import fuzzy, resolve

LEAST_FUZZY = 8


def canonical(owners: DataFrame, pool: DataFrame) -> DataFrame:
    """owner, canonical: the pool name of the same normal name, else the only one that contains it or is contained in it,
    else the owner's normal name; '' for a name of which nothing is left.  pool: customer_name."""
    o = owners.select(F.trim("project_owner").alias("owner")).filter("owner <> ''").distinct().withColumn("norm", normal_owner(F.col("owner")))
    p = pool.filter(not_blank("customer_name")).groupBy(normal_owner(F.col("customer_name")).alias("key")).agg(F.min(F.trim("customer_name")).alias("same")).filter("key <> ''")
    near = fuzzy(owners, pool).groupBy("owner").agg(F.min("customer").alias("low"), F.max("customer").alias("high"))
    only = near.filter(F.col("low") == F.col("high")).select("owner", F.col("low").alias("only"))
    d = o.join(p, o["norm"] == p["key"], "left").join(only, "owner", "left")
    return d.select("owner", F.when(F.col("norm") == "", "").otherwise(F.coalesce("same", "only", "norm")).alias("canonical"))


def _usable(leads: DataFrame) -> DataFrame:
    return leads.filter(enabled("enabled") & not_blank("customer_name") & not_blank("sales")).withColumn("customer_name", F.trim("customer_name"))


def longest_lead(owners: DataFrame, leads: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """owner, lead_id, customer, sales: of the leads whose name contains the owner's or is contained in it (the shorter of
    `least` characters at least), the one with the longest name, then the smallest id."""
    u = _usable(leads)
    pairs = fuzzy(owners, u, least=least).join(u.select(F.col("customer_name").alias("customer"), F.col("id").alias("lead_id"), "sales"), "customer")
    best = F.min_by(F.struct("lead_id", "customer", "sales"), F.struct(-F.char_length("customer"), F.col("lead_id")))
    return pairs.groupBy("owner").agg(best.alias("b")).select("owner", "b.*")


def newest_lead(owners: DataFrame, leads: DataFrame) -> DataFrame:
    """owner, lead_id, customer, sales: the newest lead with sales that has the owner's normal name, contains it or is
    contained in it, or has the same canonical name."""
    u = _usable(leads).withColumn("ts", F.coalesce("updated_at", "created_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    o = owners.select(F.trim("project_owner").alias("owner")).filter("owner <> ''").distinct()
    same = o.withColumn("k", normal_owner(F.col("owner"))).filter("k <> ''").join(u.select(normal_owner(F.col("customer_name")).alias("k"), F.col("customer_name").alias("customer")).distinct(), "k").select("owner", "customer")
    of_leads = canonical(u.select(F.col("customer_name").alias("project_owner")), leads).select(F.col("owner").alias("customer"), F.col("canonical").alias("k"))
    by_canonical = canonical(owners, leads).withColumnRenamed("canonical", "k").filter("k <> ''").join(of_leads, "k").select("owner", "customer")
    pairs = same.unionByName(fuzzy(owners, u)).unionByName(by_canonical).distinct()
    best = F.max_by(F.struct(F.col("id").alias("lead_id"), "customer", "sales"), F.struct("ts", "id"))
    return pairs.join(u.select(F.col("customer_name").alias("customer"), "id", "sales", "ts"), "customer").groupBy("owner").agg(best.alias("b")).select("owner", "b.*")


def route(items: DataFrame, leads: DataFrame, fixed: dict[str, str] | None = None, loose: bool = False, source: str = "confirm") -> DataFrame:
    """id, owner, customer, sales, how of every item: a fixed routing of its keyword, else the lead of its owner.

    source: confirm (exact name, normal name, and if `loose` the longest name in part) or newest.  Owners are resolved once.
    """
    i = items.select("id", F.trim(F.coalesce("keyword", F.lit(""))).alias("keyword"), F.trim(F.coalesce("project_owner", F.lit(""))).alias("owner"))
    owners = i.select(F.col("owner").alias("project_owner"))
    if source == "newest":
        found = newest_lead(owners, leads).select("owner", "customer", "sales", F.lit("newest").alias("how"))
    else:
        r = resolve(owners, leads)
        found = r.filter("how <> 'none'").select("owner", "customer", "sales", "how")
        if loose:
            rest = r.filter("how = 'none'").select(F.col("owner").alias("project_owner"))
            found = found.unionByName(longest_lead(rest, leads).select("owner", "customer", "sales", F.lit("part").alias("how")))
    d = i.join(found, "owner", "left")
    by_word = F.lit(None).cast("string")
    for k, v in (fixed or {}).items():
        by_word = F.when(F.col("keyword") == k, F.lit(v)).otherwise(by_word)
    d = d.withColumn("__fixed", by_word)
    set_ = F.col("__fixed").isNotNull()
    return d.select("id", "owner", F.when(set_, F.lit(None)).otherwise(F.col("customer")).alias("customer"), F.when(set_, F.col("__fixed")).otherwise(F.col("sales")).alias("sales"), F.when(set_, "keyword").otherwise(F.coalesce("how", F.lit("none"))).alias("how"))


def stored_routes(routed: DataFrame, token: Column, names: DataFrame, now: Column) -> DataFrame:
    """Rows of the route table: digest_token, record_id, presale_userid, presale_display_name, canonical_customer, updated_at.

    routed: id, users (array of accounts), labels (array of names, by place), customer; a name that is missing at its
    place comes from the directory (names: user_account, display_name).
    """
    d = routed.filter("id >= 1").select("id", "customer", "labels", F.posexplode("users").alias("pos", "presale_userid"))
    d = d.withColumn("label", F.nullif(F.trim(F.get("labels", F.col("pos"))), F.lit("")))
    d = d.join(names, d["presale_userid"] == names["user_account"], "left")
    return d.select(token.alias("digest_token"), F.col("id").alias("record_id"), "presale_userid", F.coalesce("label", "display_name").alias("presale_display_name"), F.nullif(F.trim("customer"), F.lit("")).alias("canonical_customer"), now.alias("updated_at"))
