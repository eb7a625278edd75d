"""Text cut off by field limits or in transfer (problem 5).

Lengths: per field, site and measure (characters, UTF-8 bytes) the discrete hazard of a length is the share of the values
at least that long which end there; window functions give each hazard and the pooled hazard of its neighbours (lengths of
the site, and the same length at the other sites, whichever is higher), an exact
(Chernoff) bound on the binomial tail gives a p-value, and a Benjamini-Hochberg step over all tests (ranked on a fixed
grid of log p) keeps the false discovery rate.  Endings: the hazard of a two-character context is the share of its
occurrences in values at which the value ends, backed off to one character.  The same test with the same control decides
which contexts end values more often than the others: the hazard pooled over what the test leaves, in `ROUNDS` rounds
from the mean of the field downwards, is the level at which values are cut.
A value is flagged if it ends in a mark of omission, in a context that has not come three quarters (`NEAR`) of the way
from the level of cuts to the mean of the field (by order of magnitude), or, at a significant length, in one below the mean.

Everything is DataFrame work: values are counted before their contexts are taken apart, and no group is gathered.  The
limits and the endings, small tables that several steps use, are written once to the shared folder.

Defined results: NULL and blank values are no case; values shorter than two characters are complete; short, abbreviated
or mistyped values end like others of their kind and are complete; repeated rows are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.session import cut

MARK = "(?:…|\\.{2,}|\\ufffd|～{2,}|-{3,})+$"
FDR = 0.01
REACH = 3  # neighbouring lengths on each side
RATIO = 2.0  # a limit is tested against so many times the neighbouring hazard: natural lengths are lumpy
ROUNDS = 4  # of the test of contexts
NEAR = 0.75  # how far from the level of cuts to the mean, by order of magnitude, an ending has to be to be complete
BACKOFF = 20.0
SMALL = 200_000


def _small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, to be broadcast if a count shows that it is small; else the join is left to the planner."""
    return F.broadcast(df) if df.count() <= limit else df


def values(df: DataFrame, id_col: str, fields: list[str], site: Column) -> DataFrame:
    """id, site, field, v (stripped), marked, body (without the mark): one row per value that is not blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_replace(F.col(f), "^[\\s\\u3000]+|[\\s\\u3000]+$", "").alias("v")) for f in fields])
    d = df.select(F.col(id_col).alias("id"), site.alias("site"), F.explode(F.filter(pairs, lambda p: p["v"] != "")).alias("p"))
    d = d.select("id", "site", F.col("p.field").alias("field"), F.col("p.v").alias("v"))
    return d.withColumn("marked", F.col("v").rlike(MARK))


def limits(v: DataFrame, q: float = FDR) -> DataFrame:
    """field, site, measure, length, n, hazard, neighbours, log_p of the lengths at which a site cuts a field."""
    h = v.groupBy("field", "site", F.char_length("v").alias("c"), F.octet_length("v").alias("b")).agg(F.count("*").alias("k"))
    sizes = F.array(F.struct(F.lit("chars").alias("measure"), F.col("c").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("b").alias("length")))
    h = h.select("field", "site", "k", F.explode(sizes).alias("s")).groupBy("field", "site", F.col("s.measure").alias("measure"), F.col("s.length").alias("length")).agg(F.sum("k").alias("n"))
    w = W.partitionBy("field", "site", "measure").orderBy("length")
    h = h.withColumn("risk", F.sum("n").over(w.rowsBetween(0, W.unboundedFollowing)))
    near = w.rangeBetween(-REACH, REACH)
    h = h.withColumn("n_near", F.sum("n").over(near) - F.col("n")).withColumn("risk_near", F.sum("risk").over(near) - F.col("risk"))
    h = h.withColumn("hazard", F.col("n") / F.col("risk")).withColumn("neighbours", (F.col("n_near") + 0.5) / (F.greatest("risk_near", "risk") + 1.0))
    # lengths that are frequent everywhere are no limit of one site: the other sites' hazard at a length counts as a neighbour
    every = W.partitionBy("field", "measure", "length")
    others = (F.sum("n").over(every) - F.col("n")) / F.greatest(F.sum("risk").over(every) - F.col("risk"), F.lit(1))
    h = h.withColumn("neighbours", F.greatest("neighbours", others))
    h = h.withColumn("log_p", _log_tail(F.col("hazard"), RATIO * F.col("neighbours"), F.col("risk")))
    return _discoveries(h, q).select("field", "site", "measure", "length", "n", "hazard", "neighbours", "log_p")


def _log_tail(share: Column, level: Column, n: Column) -> Column:
    """Chernoff bound on the log of the chance of a share this high in n trials at the level; 0 if it is not above it."""
    a, b = F.least(share, F.lit(1 - 1e-9)), F.least(level, F.lit(1 - 1e-9))
    kl = a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))
    return F.when(a > b, -n * kl).otherwise(0.0)


def _discoveries(h: DataFrame, q: float, *group: str) -> DataFrame:
    """The rows of h that a Benjamini-Hochberg step on `log_p` keeps, in each group.

    Ranked on a grid of log p: the ranking is of at most 20000 cells, whatever the number of tests.
    """
    cell = F.greatest(F.ceil(F.col("log_p") * 10), F.lit(-20_000)).cast("long")
    grid = h.groupBy(*group, cell.alias("cell")).agg(F.count("*").alias("m"))
    w = W.partitionBy(*group)
    grid = grid.withColumn("rank", F.sum("m").over(w.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("m").over(w))
    bar = grid.filter(F.col("cell") / 10 <= F.log(q * F.col("rank") / F.col("all"))).groupBy(*group).agg(F.max("cell").alias("bar"))
    h = h.withColumn("cell", cell)
    on = F.col("cell") <= F.col("bar")
    if group:  # one row per field
        return h.join(F.broadcast(bar), list(group)).filter(on).drop("bar", "cell")
    return h.join(F.broadcast(bar), on, "left_semi").drop("cell")


def _at_limit(v: DataFrame, lim: DataFrame) -> DataFrame:
    """v with the column `limited`: its length is one at which its site cuts."""
    sets = lim.groupBy("field", "site").agg(F.collect_set(F.when(F.col("measure") == "chars", F.col("length"))).alias("cs"), F.collect_set(F.when(F.col("measure") == "bytes", F.col("length"))).alias("bs"))
    d = v.join(_small(sets), ["field", "site"], "left")
    hit = F.array_contains("cs", F.char_length("v")) | F.array_contains("bs", F.octet_length("v"))
    return d.withColumn("limited", F.coalesce(hit, F.lit(False))).drop("cs", "bs")


def endings(v: DataFrame) -> DataFrame:
    """field, context, n_any, n_end, share: how often values end behind a context of two characters, of its occurrences.

    Only values that neither bear a mark nor stop at a limit count as endings.
    """
    once = v.filter(~F.col("marked")).groupBy("field", "v").agg(F.count("*").alias("k"), F.count_if(~F.col("limited")).alias("e"))
    n = F.char_length("v")
    spot = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring("v", i, F.lit(2)).alias("c"), (i == n - 1).alias("last")))
    grams = once.filter(n >= 2).select("field", "k", "e", F.explode(spot).alias("s"))
    g = grams.groupBy("field", F.col("s.c").alias("context")).agg(F.sum("k").alias("n_any"), F.sum(F.when(F.col("s.last"), F.col("e")).otherwise(0)).alias("n_end"))
    last = F.substring("context", 2, 1)
    one = g.groupBy("field", last.alias("c1")).agg((F.sum("n_end") / F.sum("n_any")).alias("share1"))
    g = g.withColumn("c1", last).join(one, ["field", "c1"])
    share = (F.col("n_end") + BACKOFF * F.col("share1")) / (F.col("n_any") + BACKOFF)
    return g.select("field", "context", "n_any", "n_end", share.alias("share"))


def levels(e: DataFrame, q: float = FDR, rounds: int = ROUNDS) -> DataFrame:
    """field, mean, level: the hazard pooled over all contexts of a field, and over those that are no complete endings.

    Contexts are tested against the hazard pooled over all of them first, then over those that the test before left.
    """
    pooled = lambda d, name: d.groupBy("field").agg(((F.sum("n_end") + 0.5) / (F.sum("n_any") + 1)).alias(name))
    mean = pooled(e, "level")
    level = mean
    for _ in range(rounds):
        t = e.join(F.broadcast(level), "field").withColumn("log_p", _log_tail(F.col("share"), F.col("level"), F.col("n_any") + BACKOFF))
        ends = _discoveries(t, q, "field").select("field", "context")
        level = cut(pooled(e.join(ends, ["field", "context"], "left_anti"), "level"), "level")
    return mean.withColumnRenamed("level", "mean").join(F.broadcast(level), "field", "left").withColumn("level", F.least("mean", F.coalesce("level", "mean")))


def judged(df: DataFrame, id_col: str, fields: list[str], site: Column) -> DataFrame:
    """id, field, site, how (mark, limit or transfer) of every value that lost its end."""
    v = cut(values(df, id_col, fields, site), "values")  # several steps read them
    v = _at_limit(v, cut(limits(v), "limits"))
    e = cut(endings(v), "endings")
    # the bar lies between the level of cuts and the mean, by order of magnitude
    lower = e.join(F.broadcast(levels(e)), "field").filter(F.col("share") < F.col("mean"))
    lower = lower.select("field", "context", (F.col("share") < F.pow("level", F.lit(1 - NEAR)) * F.pow("mean", F.lit(NEAR))).alias("cut"))
    d = v.withColumn("context", F.substring("v", -2, 2))
    marked = d.filter("marked").select("id", "field", "site", F.lit("mark").alias("how"))
    rest = d.filter(~F.col("marked") & (F.char_length("v") >= 2)).join(_small(lower), ["field", "context"])
    rest = rest.filter(F.col("cut") | F.col("limited"))
    return marked.unionByName(rest.select("id", "field", "site", F.when(F.col("limited"), F.lit("limit")).otherwise(F.lit("transfer")).alias("how")))


def report(df: DataFrame, id_col: str, fields: list[str], site: Column) -> DataFrame:
    """site, field, n_values, n_cut, share: how often each site truncates each field."""
    total = values(df, id_col, fields, site).groupBy("site", "field").agg(F.count("*").alias("n_values"))
    lost = judged(df, id_col, fields, site).groupBy("site", "field").agg(F.count("*").alias("n_cut"))
    return total.join(lost, ["site", "field"], "left").select("site", "field", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_values")).alias("share"))
