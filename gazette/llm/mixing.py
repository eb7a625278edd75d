"""Mixing sources to target weights by Pareto order sampling (problem 9).

Sizes are tokens.  A source with target share w gets the quota w * total (total: by default the tokens of all sources
with a target), at most max_repeats times its own size.  Of the quota q of a source of size T every record gets
floor(q / T) certain whole copies; the rest is a sample without replacement: a record of t tokens has the inclusion
probability min(1, c * t), c such that the expected tokens of the sample are the rest, and the records are taken in the
order of (u / (1 - u)) / (p / (1 - p)), u uniform by hash of id and seed, until the rest is filled.  Records with p = 1
come first.

Nothing is sorted in one place: the order statistic is cut on a grid of 4096 cells, whose sums decide which cell the end
falls into; that cell is cut again, and only what is left is ordered.  A source that holds a third of all rows is as many
tasks as any other third.

Defined results: NULL, empty and blank texts without tokens get no copy; a source without a target is not used; a target
without records, or beyond max_repeats, is reported as not met; ties of the order go to the smaller id; a source listed
twice has the sum of its shares and the smallest max_repeats; repeated rows are separate records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.session import cut

GRID = 4096
SMALL = 200_000  # rows up to which a counted side is broadcast


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small; else the join is left to the planner."""
    return F.broadcast(df) if df.count() <= SMALL else df



def targets(mix: DataFrame) -> DataFrame:
    return mix.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.lit(0), F.min(F.coalesce("max_repeats", F.lit(1)))).alias("max_repeats"))


def quotas(sizes: DataFrame, mix: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, size, quota, copies (certain for every record), rest (tokens to sample)."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count_if(F.col("n_tokens") > 0).alias("n"))
    q = targets(mix).join(have, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    whole = F.lit(total) if total is not None else F.sum("size").over(W.partitionBy())
    q = q.withColumn("quota", F.least(F.floor(F.col("target_share") * whole), F.col("size") * F.col("max_repeats")))
    q = q.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("quota") / F.col("size"))).otherwise(0))
    return q.select("source", "target_share", "max_repeats", "size", "quota", F.col("copies").cast("int").alias("copies"), (F.col("quota") - F.col("copies") * F.col("size")).alias("rest"))


def scales(sizes: DataFrame, q: DataFrame) -> DataFrame:
    """source, c: sum of min(1, c * t) * t over a source is its rest.

    The sizes of a source are counted first: the windows run over distinct sizes, of which there are few, not over records.
    """
    h = sizes.filter("n_tokens > 0").groupBy("source", F.col("n_tokens").alias("t")).agg(F.count("*").alias("k")).join(small(q.select("source", "rest")), "source").filter("rest > 0")
    down = W.partitionBy("source").orderBy(F.desc("t"))
    h = h.withColumn("above", F.coalesce(F.sum(F.col("t") * F.col("k")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    h = h.withColumn("square", F.sum(F.col("t").cast("double") * F.col("t") * F.col("k")).over(down.rowsBetween(0, W.unboundedFollowing)))
    # the largest sizes are certain as long as c, fitted on the others, would make them so
    h = h.withColumn("c", (F.col("rest") - F.col("above")) / F.col("square")).filter("c > 0 and c * t < 1")
    return h.groupBy("source").agg(F.max_by("c", "t").alias("c"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def fill(d: DataFrame, limits: DataFrame, group: str, order: str, size: str, tie: str) -> DataFrame:
    """The rows of each group, in ascending `order` (in [0, 1)) and then `tie`, whose sizes fill its `limit`; the row
    that crosses the limit is taken if that comes nearer to it."""
    kept = d.columns
    d = d.join(small(limits), group).withColumn("__a", F.least(F.floor(F.col(order) * GRID), F.lit(GRID - 1)))
    d = cut(d.withColumn("__b", F.least(F.floor((F.col(order) * GRID - F.col("__a")) * GRID), F.lit(GRID - 1))), "order")

    def cells(x: DataFrame, cell: str, left: str) -> DataFrame:
        """group, cell, left: for each cell what is left of the limit before it; at most GRID cells a group."""
        h = x.groupBy(group, cell).agg(F.sum(size).alias("__s"), F.first(left).alias("__left"))
        before = F.coalesce(F.sum("__s").over(W.partitionBy(group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return cut(h.select(group, cell, (F.col("__left") - before).alias("__rem"), "__s").filter("__rem > 0"), "cells")

    d1 = d.join(small(cells(d, "__a", "limit")), [group, "__a"])
    sure1 = d1.filter("__s <= __rem")
    edge = cut(d1.filter("__s > __rem").drop("limit", "__s").withColumnRenamed("__rem", "__lim"), "edge")
    d2 = edge.join(small(cells(edge, "__b", "__lim")), [group, "__b"])
    sure2 = d2.filter("__s <= __rem")
    w = W.partitionBy(group).orderBy(order, tie)
    run = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = F.col("__run") + F.col(size) - F.col("__rem")
    last = d2.filter("__s > __rem").withColumn("__run", run).filter((F.col("__run") < F.col("__rem")) & ((over <= 0) | (over <= F.col("__rem") - F.col("__run"))))
    return sure1.select(*kept).unionByName(sure2.select(*kept)).unionByName(last.select(*kept))


def mixed(sizes: DataFrame, mix: DataFrame, total: int | None = None, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, n_tokens, copies of every record that is used."""
    sizes = sizes.select(id_col, "source", "n_tokens")  # further columns may have any name
    q = cut(quotas(sizes, mix, total), "quotas")
    c = cut(scales(sizes, q), "scales")
    p = F.least(F.lit(1.0), F.col("c") * F.col("n_tokens"))
    u = uniform(F.col(id_col), seed)
    # odds / (1 + odds) keeps the order of the odds and lies in [0, 1)
    odds = F.when(F.col("__p") >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (F.col("__p") / (1 - F.col("__p"))))
    d = sizes.filter("n_tokens > 0").join(small(c), "source").withColumn("__p", p).withColumn("__x", F.least(odds / (1 + odds), F.lit(1 - 1e-12))).drop("c")
    sample = fill(d, q.select("source", F.col("rest").alias("limit")), "source", "__x", "n_tokens", id_col).select(F.col(id_col), "source", "n_tokens", F.lit(1).alias("copies"))
    certain = sizes.filter("n_tokens > 0").join(small(q.filter("copies > 0").select("source", "copies")), "source").select(F.col(id_col), "source", "n_tokens", "copies")
    return certain.unionByName(sample).groupBy(id_col, "source", "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))


def shares(sizes: DataFrame, mix: DataFrame, used: DataFrame, total: int | None = None, near: float = 0.01) -> DataFrame:
    """source, target_share, reachable_share, actual_share, share_of_total, max_repeats, size, used, met: what the mix is made of.

    What a source cannot fill is not given to the others: they keep their quotas, so that their tokens do not depend on
    it, and their shares of the (smaller) mix are larger.  reachable_share: the quota's part of all quotas;
    actual_share: of the mix; share_of_total: of the asked total.  met: share_of_total is within `near` of the target,
    relatively.
    """
    q = quotas(sizes, mix, total)
    u = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"))
    r = q.join(u, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    every = W.partitionBy()
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    whole = F.lit(total) if total is not None else F.sum("size").over(every)
    r = r.withColumns({"reachable_share": part(F.col("quota"), F.sum("quota").over(every)), "actual_share": part(F.col("used"), F.sum("used").over(every)), "share_of_total": part(F.col("used"), whole)})
    met = F.abs(F.col("share_of_total") - F.col("target_share")) <= near * F.col("target_share")
    return r.select("source", "target_share", "reachable_share", "actual_share", "share_of_total", "max_repeats", "size", "used", met.alias("met"))
