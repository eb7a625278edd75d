"""Checking new batches against everything accepted before (problem 7).

A notice has two identities: the page (site and path) and the project (number, stage, lot, round), each a set of tokens.
Two rows are the same notice if all tokens of an identity agree.  Titles that are nearly the same are found by the same
index over five-character shingles with a similarity of 0.8 (`title_notices`).

`NoticeIndex` is an inverted index in the shared folder: a table of postings, bucketed by token.  A notice is posted under
its rarest tokens only, by document frequency (`Rarity`): with a similarity of `share` that must be reached, the first
|x| - ceil(share |x|) + 1 tokens; with all tokens required, one.  A batch is collapsed to its distinct notices, its
prefixes are sent to the buckets and probe the index there, lengths are filtered, the overlap is verified, and the notices
that are new are appended as a part of their own.  The index is never shuffled or rewritten; a probe reads its token
column and the postings of the batch's tokens.  `compact` merges the parts.

Rows that agree by page with one row and by project with another make one group; groups are found by label propagation
over the (few) notices that more than one row has.

Building the result runs the batches one after the other, as each needs the index of those before it.

Defined results: NULL or blank page and number leave a row without that identity, without both it repeats nothing;
copies of a row are repeats of the first; an empty table gives an empty result; columns that aren't used may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.operators.units import let
from gazette.session import cut, exists, remove, shared_dir

SMALL = 200_000  # rows up to which a counted side is broadcast
HEAVY = 512  # a token that more than one in so many notices has is heavy
CELLS = 65_536  # counters in which document frequencies are counted first

# Kinds of notice, and full-width forms.
STAGES = ["招标公告", "采购公告", "竞争性磋商公告", "竞争性谈判公告", "询价公告", "资格预审公告", "变更公告", "更正公告", "流标公告", "废标公告", "终止公告", "中标结果公告", "成交结果公示", "评标结果公示", "中标公示", "合同公告"]
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　〔〕【】"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + " ()[]"
NUMERALS = "一二三四五六七八九"


def narrow(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), _WIDE, _ASCII)


def page_tokens(url: Column) -> Column:
    """Site, folder and name of a page, whatever the scheme, the mobile host, tracking parameters or a fragment; else NULL."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(narrow(url)), "\\s+", ""), "^[a-z]+:/+", "")

    def tokens(u: Column) -> Column:
        query = F.regexp_extract(u, "[?&]((?:[a-z]*id|no|code)=[^&#]+)", 1)
        return let(F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", ""), lambda x: parts(x, query))

    def parts(x: Column, query: Column) -> Column:
        host = F.regexp_replace(F.regexp_extract(x, "^([^/]+)", 1), "^(?:www|m|wap|mobile)\\.|:\\d+$", "")
        folder, name = F.regexp_extract(x, "^[^/]+(.*)/[^/]*$", 1), F.regexp_extract(x, "^[^/]+/(?:.*/)?([^/]*)$", 1)
        whole = lambda h: F.array(F.concat(F.lit("h:"), h), F.concat(F.lit("d:"), folder), F.concat(F.lit("p:"), h, F.lit("/"), name, F.lit("?"), query))
        return F.when(x.rlike("^[^/]+/."), let(host, whole))

    return let(plain, tokens)


def project_number(c: Column) -> Column:
    """A project number without separators, width and case; letters read for digits in its figures are put right."""
    shape = "^([A-Z]{2,8}?)([0-9OILSB]{6,})$"
    plain = F.regexp_replace(F.upper(narrow(c)), "[^0-9A-Z\\u4e00-\\u9fff]|[号第]", "")
    right = lambda s: F.when(s.rlike(shape), F.concat(F.regexp_extract(s, shape, 1), F.lit("-"), F.translate(F.regexp_extract(s, shape, 2), "OILSB", "01158"))).otherwise(s)
    return let(plain, right)


_BEGUN = {s[:n]: s for s in STAGES for n in range(2, len(s)) if sum(x.startswith(s[:n]) for x in STAGES) == 1}
_WHOLE_RE = "(" + "|".join(sorted(STAGES, key=len, reverse=True)) + ")"
_BEGUN_RE = "(" + "|".join(sorted(_BEGUN, key=len, reverse=True)) + ")(?:…|\\.{2,}|\\ufffd)*$"


def stage(sub_type: Column, title: Column, kind: Column) -> Column:
    """The kind of notice: as recorded, else as the title says (also where its end is lost), else from the broad type."""
    begun = F.create_map(*[F.lit(x) for kv in _BEGUN.items() for x in kv])
    broad = F.concat(F.lit("?"), F.coalesce(F.trim(kind), F.lit("")))
    cut_off = lambda t: F.coalesce(F.try_element_at(begun, F.regexp_extract(t, _BEGUN_RE, 1)), broad)
    by_title = lambda t: let(F.regexp_extract(t, _WHOLE_RE, 1), lambda said: F.when(said != "", said).otherwise(cut_off(t)))
    return let(F.trim(narrow(sub_type)), lambda sub: F.when(~sub.isin("", "其他"), sub).otherwise(by_title(title)))


def _number(c: Column) -> Column:
    return F.translate(c, NUMERALS, "123456789")


def project_tokens(number: Column, in_text: Column, sub_type: Column, title: Column, kind: Column) -> Column:
    """Number, stage, lot and round of a notice; NULL without a number.  in_text: the number its text gives."""
    either = let(project_number(number), lambda n: F.when(F.length(n) >= 6, n).otherwise(project_number(in_text)))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    lot = lambda t: first(F.regexp_extract(t, "第?([0-9一二三四五六七八九十]+)(?:标段|标包|包件|包)", 1), F.regexp_extract(t, "(?:标段|标包|包)([0-9一二三四五六七八九十A-Za-z]+)\\)?", 1))
    again = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, "\\(?第?([二三四五六七八九2-9])次(?!更正|变更)", 1), F.lit("")), F.when(F.contains(t, F.lit("重新招标")), F.lit("2")), F.lit("1"))
    tokens = lambda n, t: F.array(F.concat(F.lit("n:"), n), F.concat(F.lit("s:"), stage(sub_type, t, kind)), F.concat(F.lit("l:"), _number(lot(t))), F.concat(F.lit("r:"), _number(again(t))))
    title = F.regexp_replace(narrow(title), "[\\s-]+", "")
    return let(either, lambda n: F.when(F.length(n) >= 6, let(title, lambda t: tokens(n, t))))


def identities(df: DataFrame) -> DataFrame:
    """id, day, view, tokens: one row per identity of each row of scraping_infos."""
    said = F.when(~F.coalesce(F.col("project_no"), F.lit("")).rlike("\\S"), F.regexp_extract(F.coalesce("detail", F.lit("")), "编号[:：]\\s*([A-Za-zＡ-Ｚ]{2,8}[-/〔（(0-9０-９OlISB][^\\s，。；、]{5,30})", 1))
    views = F.array(F.struct(F.lit("page").alias("view"), page_tokens(F.col("detail_url")).alias("tokens")), F.struct(F.lit("project").alias("view"), project_tokens(F.col("project_no"), said, F.col("sub_type"), F.col("title"), F.col("type")).alias("tokens")))
    d = df.select("id", F.to_date("created_at").alias("day"), F.explode(views).alias("v")).filter(F.col("v.tokens").isNotNull())
    return d.select("id", "day", F.col("v.view").alias("view"), F.col("v.tokens").alias("tokens"))


class Rarity:
    """The global order of tokens: by tiers of document frequency, rare ones first, then by the token itself.

    Heavy are at most HEAVY times as many tokens as a notice has; their frequencies are counted exactly, all others are
    one tier.  The order is fixed when an index begins: any order is right, a good one is fast.
    """

    def __init__(self, tiers: list[list[str]] | None = None):
        self.tiers = tiers or []

    @classmethod
    def fit(cls, notices: DataFrame) -> "Rarity":
        """By the tokens of notices (tokens: an array): counters by hash of the token, then the tokens of full counters."""
        t = notices.select(F.explode("tokens").alias("t"))
        cell = F.pmod(F.xxhash64("t"), F.lit(CELLS))
        n = notices.count()
        least = max(2, n // HEAVY)
        full = [r["c"] for r in t.groupBy(cell.alias("c")).agg(F.count("*").alias("k")).filter(F.col("k") >= least).collect()]
        if not full:
            return cls()
        heavy = t.filter(cell.isin(full)).groupBy("t").agg(F.count("*").alias("k")).filter(F.col("k") >= least).collect()
        tiers: dict[int, list[str]] = {}
        for r in heavy:
            tiers.setdefault((r["k"] // least).bit_length(), []).append(r["t"])
        return cls([sorted(tiers[k]) for k in sorted(tiers)])

    def rank(self, t: Column) -> Column:
        c = F.lit(0)
        for k, tokens in enumerate(self.tiers):
            c = F.when(t.isin(tokens), F.lit(k + 1)).otherwise(c)
        return c


class Kinds(Rarity):
    """An order given by the kinds of tokens (their first letter), rarest kind first."""

    def __init__(self, kinds: list[str]):
        super().__init__()
        self.kinds = kinds

    def rank(self, t: Column) -> Column:
        c = F.lit(len(self.kinds))
        for k, kind in enumerate(self.kinds):
            c = F.when(F.substring(t, 1, len(kind)) == kind, F.lit(k)).otherwise(c)
        return c


class NoticeIndex:
    """Inverted index of rare-token prefixes of notices, growing by appended parts in the shared folder.

    share: the Jaccard similarity of token sets that makes two notices the same; 1: all tokens.  A path that exists is
    taken up again; `order` has to be that with which it was begun.
    """

    COLUMNS = ["token", "view", "first", "n", "tokens", "known", "part"]

    def __init__(self, spark: SparkSession, order: Rarity | list[str], path: str | None = None, share: float = 1.0, buckets: int | None = None):
        self.spark, self.share = spark, share
        self.order = order if isinstance(order, Rarity) else Kinds(order)
        self.path = path or f"{shared_dir(spark)}/notices-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"notices_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (token STRING, view STRING, first BIGINT, n BIGINT, tokens ARRAY<STRING>, known BIGINT, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (token) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if path and exists(spark, path):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")
        last = self.rows().agg(F.max("part")).first()[0]
        self.parts = 0 if last is None else last + 1

    def rows(self) -> DataFrame:
        """All notices that were probed or appended: token, view, first, n (rows), tokens, known (the row they repeat)."""
        return self.spark.table(self.name)

    def postings(self) -> DataFrame:
        """The notices that were new when they came, under their prefixes."""
        return self.rows().filter("known is null").select("token", "view", "first", "tokens")

    def prefixes(self, notices: DataFrame) -> DataFrame:
        """notices with `token` exploded: the tokens under which each is posted and probed."""
        key = lambda t: F.struct(self.order.rank(t).alias("r"), t.alias("t"))
        size = F.size("tokens")
        keep = (size - F.ceil(size * self.share) + 1).cast("int")
        if self.share >= 1:  # the least is enough, without sorting
            return notices.withColumn("token", F.array_min(F.transform("tokens", key))["t"])
        ordered = F.transform(F.array_sort(F.transform("tokens", key)), lambda x: x["t"])
        return notices.withColumn("token", F.explode(F.slice(ordered, F.lit(1), keep)))

    def _met(self, notices: DataFrame) -> DataFrame:
        """Prefixes of the notices, each with `known`: the first row of the same notice under its token, or NULL."""
        p = self.prefixes(notices)
        if not self.parts:
            return p.withColumn("known", F.lit(None).cast("bigint"))
        q = self.postings().select(F.col("token").alias("q_token"), F.col("view").alias("q_view"), F.col("first").alias("q_first"), F.col("tokens").alias("q_tokens"))
        a, b = F.size("tokens"), F.size("q_tokens")
        lengths = (b >= F.ceil(a * self.share)) & (a >= F.ceil(b * self.share))
        overlap = F.size(F.array_intersect("tokens", "q_tokens")) >= F.ceil((a + b) * (self.share / (1 + self.share)))
        on = (F.col("token") == F.col("q_token")) & (F.col("view") == F.col("q_view")) & lengths & overlap
        # the buckets of the token hold both sides: nothing is sent again to find the least
        return p.join(q, on, "left").groupBy("token", "view", "first").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("q_first").alias("known"))

    def probe(self, notices: DataFrame) -> DataFrame:
        """notices (view, tokens, first) with `known`: the first row of the same notice in the index, or NULL."""
        met = self._met(_counted(notices))
        if self.share < 1:
            met = met.groupBy("view", "first").agg(F.first("tokens").alias("tokens"), F.min("known").alias("known"))
        return met.select("view", "tokens", "first", "known")

    def append(self, notices: DataFrame) -> None:
        """Post the notices (view, tokens, first)."""
        self._write(self.prefixes(_counted(notices)).withColumn("known", F.lit(None).cast("bigint")).repartition(self.buckets, "token"))

    def absorb(self, notices: DataFrame) -> DataFrame:
        """Probe and append in one pass: view, tokens, first, n and known of the notices; those without `known` are posted."""
        if self.share < 1:
            new = cut(self.probe(notices), "probed")
            self.append(new.filter("known is null"))
            return new
        met = self._met(_counted(notices))
        self._write(met if self.parts else met.repartition(self.buckets, "token"))
        return self.rows().filter(F.col("part") == self.parts - 1).select("view", "tokens", "first", "n", "known")

    def _write(self, rows: DataFrame) -> None:
        rows.withColumn("part", F.lit(self.parts)).select(*self.COLUMNS).write.insertInto(self.name)
        self.parts += 1

    def compact(self, path: str | None = None) -> "NoticeIndex":
        """An index of the same postings as one part, for where daily parts have become many."""
        new = NoticeIndex(self.spark, self.order, path, self.share, self.buckets)
        new._write(self.rows().drop("part").repartition(self.buckets, "token"))
        return new


def _counted(notices: DataFrame) -> DataFrame:
    return notices if "n" in notices.columns else notices.withColumn("n", F.lit(1).cast("bigint"))


def collapse(ids: DataFrame) -> DataFrame:
    """view, tokens, first, n: the distinct notices of a batch, with their smallest id and the number of their rows."""
    return ids.groupBy("view", "tokens").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def rarity(ids: DataFrame) -> Rarity:
    return Rarity.fit(ids)


def blocks(ids: DataFrame, n: int) -> list[tuple]:
    """At most n consecutive spans of days with about as many rows each: (first day, last day)."""
    days = ids.groupBy("day").agg(F.count("*").alias("k")).orderBy(F.col("day").asc_nulls_first()).collect()
    total, done, out, start = sum(r["k"] for r in days), 0, [], None
    for r in days:
        start = start or r
        done += r["k"]
        if done >= total * (len(out) + 1) / n or r is days[-1]:
            out.append((start["day"], r["day"]))
            start = None
    return out


def within(a, b) -> Column:
    """The rows of a span of `blocks`; a span that begins at NULL holds the rows without a day too."""
    day = F.col("day")
    if b is None:
        return day.isNull()
    return (day.isNull() | (day <= F.lit(b))) if a is None else (day >= F.lit(a)) & (day <= F.lit(b))


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small; else the join is left to the planner."""
    return F.broadcast(df) if df.count() <= SMALL else df


def repeats(df: DataFrame, n_blocks: int = 8, index: NoticeIndex | None = None) -> DataFrame:
    """first_id, id of every row that publishes a notice again.

    The rows are taken in the order of their days in n_blocks batches; each batch is checked against the index of all
    batches before it and appended.
    """
    spark = df.sparkSession
    ids = cut(identities(df), "identities")
    spans = blocks(ids, n_blocks)
    if not spans:
        return spark.createDataFrame([], "first_id long, id long")
    begun = 0 if index is None else index.parts
    for a, b in spans:
        batch = ids.filter(within(a, b))
        index = index or NoticeIndex(spark, rarity(batch))
        index.absorb(collapse(batch))
    firsts = index.rows().filter(F.col("part") >= begun).select("view", "tokens", "first", "n", F.coalesce("known", "first").alias("key"))
    # notices of more than one row: rows of one batch are counted with it, those of several share the key
    many = cut(firsts.groupBy("view", "key").agg(F.sum("n").alias("rows"), F.min("first").alias("least")).filter("rows > 1").select("view", "key", "least"), "many")
    # from here on a notice is named by its smallest row, which need not be the one that came first
    shared = cut(firsts.join(_sized(many), ["view", "key"]).select("view", "tokens", F.col("least").alias("key")), "shared")
    rows = cut(ids.join(_sized(shared), ["view", "tokens"]).select("id", "view", "key"), "rows")
    # a row that has both identities ties a page to a project; equal ties count once
    both = rows.groupBy("id").agg(F.min(F.when(F.col("view") == "page", F.col("key"))).alias("page"), F.min(F.when(F.col("view") == "project", F.col("key"))).alias("project"))
    ties = both.filter("page is not null and project is not null").groupBy("page", "project").agg(F.min("id").alias("id"))
    ties = ties.select("id", F.explode(F.array(F.struct(F.lit("page").alias("view"), F.col("page").alias("key")), F.struct(F.lit("project").alias("view"), F.col("project").alias("key")))).alias("e")).select("id", "e.view", "e.key")
    ties = cut(ties, "ties")
    group = ties.join(components(ties), "id").groupBy("view", "key").agg(F.min("label").alias("label"))
    least = group.groupBy("label").agg(F.min("key").alias("first_id"))
    group = cut(group.join(least, "label").select("view", "key", "first_id"), "groups")
    found = rows.join(_sized(group), ["view", "key"], "left").groupBy("id").agg(F.min(F.coalesce("first_id", "key")).alias("first_id"))
    return found.filter("first_id < id").select("first_id", "id")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over shared keys (view, key); edges: id, view, key.

    Runs until no label changes, which comes since labels only fall.  Each round also takes the label of the label, so
    that long chains need few rounds; the table of a round is removed when the next one is written.
    """
    label = edges.groupBy("id").agg(F.min("id").alias("label"))
    old = None
    while True:
        by_key = edges.join(label, "id").groupBy("view", "key").agg(F.min("label").alias("low"))
        low = edges.join(by_key, ["view", "key"]).groupBy("id").agg(F.min("low").alias("near"))
        jump = label.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = cut(low.join(jump, "near").select("id", F.least("near", "far").alias("label")), "labels")
        changed = new.join(label.withColumnRenamed("label", "old"), "id").filter(F.col("label") < F.col("old")).limit(1).count()
        if old is not None:
            remove(old)
        old = label = new
        if not changed:
            return label


SHINGLE = 5


def title_tokens(title: Column) -> Column:
    """The distinct runs of five characters of a title in one notation; a shorter title is one token; NULL if it is blank."""
    t = F.regexp_replace(F.lower(narrow(title)), "[\\s\u3000]+", "")
    n = F.char_length(t)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(SHINGLE))))
    return F.when(n > 0, runs)


def title_notices(df: DataFrame) -> DataFrame:
    """id, day, view, tokens of every row with a title."""
    d = df.select("id", F.to_date("created_at").alias("day"), F.lit("title").alias("view"), title_tokens(F.col("title")).alias("tokens"))
    return d.filter(F.col("tokens").isNotNull())


def last_batch(ids: DataFrame, days: int = 30, share: float = 1.0) -> DataFrame:
    """id, first_id: the rows of the last `days` days against an index of all rows before them."""
    ids = cut(ids, "identities")
    last = ids.agg(F.max("day").alias("d")).first()["d"]
    if last is None:
        return ids.sparkSession.createDataFrame([], "id long, first_id long")
    new = F.col("day") > F.date_sub(F.lit(last), days)
    before, batch = ids.filter(~new | F.col("day").isNull()), ids.filter(new)
    index = NoticeIndex(ids.sparkSession, rarity(before), share=share)
    index.append(collapse(before))
    hit = cut(index.probe(collapse(batch)).filter("known is not null").select("view", "tokens", "known"), "hits")
    return batch.join(_sized(hit), ["view", "tokens"]).groupBy("id").agg(F.min("known").alias("first_id"))
