"""Amounts of money recorded in different units, brought to fen (0.01 yuan).

Grammar.  A field holds entries separated by `|`.  An entry is folded (full-width to ASCII, lower case, white space and
remarks in brackets dropped, variants of unit and capital numerals mapped) and then read as one of
  * a number with a scale:          12.5万元, 3.51million, 400万1914元, 1亿7400万元
  * Chinese numerals:               叁佰肆拾万肆仟元整, 一亿零二百一十三万元
  * either with its figure in brackets or after 小写, in which case the figure counts.
Entries in foreign currency, rates, discounts, prices per unit, ranges and words state no amount.

Units.  A number without any unit or currency is `bare`.  The record's text may declare a unit for its amounts.  A
mixture on the log scale, whose components are one base density shifted by log10 of the known conversion factors, gives
every bare number a posterior over units; its mixing weights are fitted per declaration class by EM over all bare
numbers, in which the declaration counts as `worth` numbers.  The declared unit (yuan where none is declared) is what the
data's owner defines as right, so it alone decides the amount (`stated`).  The mixture changes no amount: it judges them
(`amounts`), gives the unit it would take and its probability, and flags entries whose unit does not fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.session import cut

# fixed values: the units money is recorded in, and how many yuan each is
UNIT_YUAN = {"元": 1, "千元": 1_000, "万元": 10_000, "百万元": 1_000_000, "亿元": 100_000_000}
UNITS = list(UNIT_YUAN)

# fixed values: folding of variant characters
_WIDE = "０１２３４５６７８９．，％＄￥（）：／－～ＷｗＲＭＢＣＮＹ"
_ASCII = "0123456789.,%$¥():/-~wwrmbcny"
_VARIANT = "萬億圓圆仟佰拾壹贰貳叁參肆伍陆陸柒捌玖两兩〇："
_PLAIN = "万亿元元千百十一二二三三四五六六七八九二二零:"

FOREIGN = "美元|美金|欧元|港币|港元|日元|英镑|韩元|澳元|加元|法郎|卢布|usd|eur|hkd|jpy|gbp|aud|cad|chf|sgd|us\\$|[$€£]"
RATE = "%|‰|折|费率|下浮|上浮|优惠率|百分"
PER_UNIT = "单价|元/|/人|/月|/年|/天|/日|/台|/次|/套|/个|/小时|每人|每月|每台|每年|每次|每套"
NUM = "[0-9]+(?:\\.[0-9]+)?"
SCALE = {"亿": 100_000_000, "千万": 10_000_000, "百万": 1_000_000, "十万": 100_000, "万": 10_000, "千": 1_000, "百": 100}
DECLARED = "(?:单位(?:均为|均是|为|是|:)?|(?:金额|价格|报价|款项)[^,。;\\n]{0,6}以)(元|千元|万元|百万元|亿元)"


def fold(raw: Column) -> Column:
    """The entry in one notation; NULL stays NULL."""
    s = F.lower(F.translate(raw, _WIDE, _ASCII))
    s = F.translate(s, _VARIANT, _PLAIN)
    s = F.regexp_replace(s, "[\\s\\u3000\\u00a0]+", "")
    s = F.regexp_replace(s, "\\((?:含税|不含税|大小写一致|含增值税|税率[^)]*|人民币)\\)", "")
    s = F.regexp_replace(s, "wan", "万")
    s = F.regexp_replace(s, "(?<=[0-9])w", "万")
    s = F.regexp_replace(s, "billion|bn", "十亿")
    s = F.regexp_replace(s, "million|(?<=[0-9])m(?=n?$)", "百万")
    s = F.regexp_replace(s, "(?<=[0-9])k(?=$|元)", "千")
    return F.regexp_replace(s, "(?<=[0-9]),(?=[0-9])", "")


def _dec(c: Column) -> Column:
    """The figure, 0 for ''; NULL for one of more than 22 digits before the point, which is no amount."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).try_cast("decimal(30,8)")


def _digit(c: Column) -> Column:
    """One Chinese digit as a number; '' as 0."""
    return F.coalesce(F.nullif(F.translate(c, "零一二三四五六七八九", "0123456789"), F.lit("")), F.lit("0")).cast("long")


def _section(c: Column) -> Column:
    """A Chinese numeral below ten thousand (零 is only a filler)."""
    s = F.regexp_replace(c, "零", "")
    pat = "^(?:([一二三四五六七八九])千)?(?:([一二三四五六七八九])百)?(?:([一二三四五六七八九]?)(十))?([一二三四五六七八九])?$"
    g = lambda i: F.regexp_extract(s, pat, i)
    tens = F.when(g(4) == "", 0).when(g(3) == "", 1).otherwise(_digit(g(3)))
    return _digit(g(1)) * 1000 + _digit(g(2)) * 100 + tens * 10 + _digit(g(5))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a bound variable keeps long expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chinese_parts(s: Column) -> Column:
    """Sections of a folded Chinese numeral with 元; 千 and 百 before 亿 or 万 belong to that section."""
    d = "[零一二三四五六七八九十百千]"
    pat = f"^(?:({d}+)亿)?({d}*)(万)?({d}*)元(?:整|正)?(?:零?([一二三四五六七八九])角)?(?:零?([一二三四五六七八九])分)?(?:整|正)?$"
    return F.array(*[F.regexp_extract(s, pat, i) for i in range(1, 7)])


def chinese_fen(s: Column) -> Column:
    """Fen of a folded Chinese numeral with 元, else NULL."""
    sections = lambda g: F.transform(F.array(g[0], g[1], g[3]), _section)
    total = lambda g, v: (v[0] * 100_000_000 + v[1] * F.when(g[2] == "万", 10_000).otherwise(1) + v[2]) * 100 + _digit(g[4]) * 10 + _digit(g[5])
    fen = let(_chinese_parts(s), lambda g: let(sections(g), lambda v: total(g, v)))
    return F.nullif(fen, F.lit(0).cast("long")).cast("decimal(38,8)")


def _figure(core: Column) -> Column:
    """Fen of a folded figure with its scale, with 亿 and 万 parts, or of a Chinese numeral; NULL for anything else."""
    one = f"^({NUM})(亿|千万|百万|十万|万|千|百|十亿)?(元?)$"
    many = f"^(?:({NUM})亿)?(?:({NUM})万)?({NUM})?元?$"
    factor = F.create_map(F.lit(""), F.lit(1), *[x for k, v in {**SCALE, "十亿": 1_000_000_000}.items() for x in (F.lit(k), F.lit(v))])
    one_fen = F.try_multiply(_dec(F.regexp_extract(core, one, 1)), (F.element_at(factor, F.regexp_extract(core, one, 2)).cast("long") * F.lit(100)).cast("decimal(12,0)")).try_cast("decimal(38,8)")
    part = lambda i, f: F.try_multiply(_dec(F.regexp_extract(core, many, i)), F.lit(f).cast("decimal(12,0)")).try_cast("decimal(38,8)")
    many_fen = F.try_add(F.try_add(part(1, 10_000_000_000), part(2, 1_000_000)), part(3, 100)).try_cast("decimal(38,8)")
    words = F.when(core.rlike("[元角分]$"), core).otherwise(F.concat(core, F.lit("元")))
    return F.when(core.rlike(one), one_fen).when(core.rlike(many) & (core != ""), many_fen).otherwise(chinese_fen(words))


def _entry(s: Column) -> Column:
    inner = F.regexp_extract(s, f"\\((?:小写:?)?(?:rmb|cny|人民币|¥)*({NUM}(?:亿|千万|百万|万|千)?元?)\\)", 1)
    lead = "^(?:rmb|cny|人民币|¥|大写:?|小写:?|约|共计|合计|总价|不超过|不高于|最高|上限|计|为|:)+"
    plain = F.regexp_replace(F.regexp_replace(s, lead, ""), "(?:整|正|人民币)+$", "")
    bad = s.rlike(f"{FOREIGN}|{RATE}|{PER_UNIT}|{NUM}(?:万|亿|千|百万)?元?(?:-|~|至|到|—)+{NUM}")
    figure = lambda x: F.when(x != "", x).otherwise(plain)
    bare = s.rlike(f"^{NUM}$")
    none = F.lit(None)
    return (
        F.when(F.coalesce(bad, F.lit(True)), F.struct(none.cast("long").alias("fen"), none.cast("decimal(30,8)").alias("exact"), F.lit(False).alias("bare")))
        .when(bare, F.struct(none.cast("long").alias("fen"), _dec(s).alias("exact"), F.lit(True).alias("bare")))
        .otherwise(F.struct(F.round(let(figure(inner), _figure), 0).try_cast("long").alias("fen"), none.cast("decimal(30,8)").alias("exact"), F.lit(False).alias("bare")))
    )


def read_entry(raw: Column) -> Column:
    """struct(fen, exact, bare): what one entry states; NULL, NULL, false if it states no amount in renminbi.

    A bare number has `exact`, its figure, and no fen: it needs a unit first.
    """
    return let(fold(raw), _entry)


def declared_unit(detail: Column) -> Column:
    """The unit the record's text gives for its amounts; 元 where it gives none or the text is NULL."""
    u = F.regexp_extract(F.translate(F.coalesce(detail, F.lit("")), "：　", ": "), DECLARED, 1)
    return F.coalesce(F.nullif(u, F.lit("")), F.lit("元"))


def entries(df: DataFrame, id_col: str, fields: list[str], detail: str, sep: str = "\\|") -> DataFrame:
    """One row per entry: id, field, item_no (from 1, blank entries count), raw, fen, number, exact, bare, declared."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    d = df.select(F.col(id_col).alias("__id"), declared_unit(F.col(detail)).alias("__declared"), F.filter(pairs, lambda p: p["value"].rlike("[^\\s|]")).alias("__pairs"))
    d = d.filter(F.size("__pairs") > 0).select("__id", "__declared", F.explode("__pairs").alias("__p"))
    d = d.select("__id", "__declared", F.col("__p.field").alias("__field"), F.posexplode(F.split(F.col("__p.value"), sep)).alias("__pos", "__raw"))
    e = read_entry(F.col("__raw"))
    d = d.withColumn("__e", e)
    return d.select(F.col("__id").alias("id"), F.col("__field").alias("field"), (F.col("__pos") + 1).alias("item_no"), F.col("__raw").alias("raw"), F.col("__e.fen").alias("fen"), F.col("__e.exact").cast("double").alias("number"), F.col("__e.exact").alias("exact"), F.col("__e.bare").alias("bare"), F.col("__declared").alias("declared"))


class UnitMixture:
    """Log-scale mixture of unit components offset by the known factors.

    The base density (mean, deviation of log10 yuan) comes from the entries that state a unit; the weights per
    declaration class from EM over a histogram of all bare numbers.  Both reach the driver as counts per bin of
    `bin_width` decades: at most 5 classes x 40 decades / bin_width rows, whatever the size of the data.
    """

    def __init__(self, bin_width: float = 0.05, trust: float = 0.99, rounds: int = 50, worth: float = 10.0):
        self.bin_width, self.trust, self.rounds, self.worth = bin_width, trust, rounds, worth
        self.mean, self.dev, self.weights = 6.0, 1.0, {}

    def fit(self, ent: DataFrame) -> "UnitMixture":
        yuan = F.when(F.col("bare"), F.col("number")).otherwise(F.col("fen") / 100)
        h = ent.filter(yuan > 0).select("bare", "declared", F.floor(F.log10(yuan) / self.bin_width).alias("bin")).groupBy("bare", "declared", "bin").agg(F.count("*").alias("n")).collect()
        stated = [(r["bin"] * self.bin_width + self.bin_width / 2, r["n"]) for r in h if not r["bare"]]
        if stated:
            x, n = np.array([a for a, _ in stated]), np.array([b for _, b in stated], float)
            self.mean = float((x * n).sum() / n.sum())
            self.dev = max(0.1, math.sqrt(float((n * (x - self.mean) ** 2).sum() / n.sum())))
        shift = np.array([math.log10(UNIT_YUAN[u]) for u in UNITS])
        for k, d in enumerate(UNITS):
            prior = np.full(len(UNITS), (1 - self.trust) / (len(UNITS) - 1))
            prior[k] = self.trust
            rows = [(r["bin"] * self.bin_width + self.bin_width / 2, r["n"]) for r in h if r["bare"] and r["declared"] == d]
            w = prior.copy()
            if rows:
                x, n = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
                like = np.exp(-0.5 * ((x[:, None] + shift[None, :] - self.mean) / self.dev) ** 2)
                for _ in range(self.rounds):  # MAP-EM: the declaration counts as `worth` numbers do
                    post = like * w
                    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                    w = (n @ post + self.worth * prior) / (n.sum() + self.worth)
            self.weights[d] = w
        return self

    def posterior(self, declared: Column, number: Column) -> Column:
        """array<double>: the probability of each of UNITS, in that order."""
        weight = F.create_map(*[x for d, w in self.weights.items() for x in (F.lit(d), F.array(*[F.lit(math.log(max(float(v), 1e-300))) for v in w]))])
        shift = F.array(*[F.lit(math.log10(UNIT_YUAN[u]) - self.mean) for u in UNITS])
        density = lambda lg: F.zip_with(F.element_at(weight, declared), shift, lambda w, s: w - F.pow((lg + s) / self.dev, F.lit(2.0)) / 2)
        relative = lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
        scaled = lambda a: let(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), lambda t: F.transform(a, lambda x: x / t))
        return F.when(number > 0, let(let(let(F.log10(number), density), relative), scaled))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(d, u, float(w), self.mean, self.dev) for d, ws in self.weights.items() for u, w in zip(UNITS, ws)], "declared string, unit string, weight double, base_mean double, base_dev double")


def _fen(e: DataFrame) -> DataFrame:
    """The entries with unit (the declared one of bare numbers) and amount_fen; those without an amount are left out."""
    e = e.withColumn("unit", F.when(F.col("bare"), F.col("declared")))
    factor = F.element_at(F.create_map(*[x for u, y in UNIT_YUAN.items() for x in (F.lit(u), F.lit(y))]), F.coalesce(F.col("unit"), F.lit("元")))
    bare_fen = F.round(F.try_multiply(F.col("exact"), (factor.cast("long") * F.lit(100)).cast("decimal(12,0)")).try_cast("decimal(38,8)"), 0).try_cast("long")
    return e.withColumn("amount_fen", F.when(F.col("bare"), bare_fen).otherwise(F.col("fen"))).filter("amount_fen is not null")


def stated(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("project_budget", "winning_amount"), detail: str = "detail") -> DataFrame:
    """Every entry that states an amount: id, field, item_no, raw, unit, amount_fen, by grammar and declaration; no model is fitted."""
    e = entries(df, id_col, list(fields), detail).filter(F.col("fen").isNotNull() | F.col("bare"))
    return _fen(e).select("id", "field", F.col("item_no").cast("int").alias("item_no"), "raw", "unit", "amount_fen")


def amounts(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("project_budget", "winning_amount"), detail: str = "detail", certain: float = 0.9, model: UnitMixture | None = None) -> DataFrame:
    """What is `stated`, judged by the mixture: also fitted_unit, probability, uncertain, declared, bare.

    NULL, blank and unreadable entries, and amounts that no bigint of fen holds, give no row but keep their place in item_no.  A repeated row repeats its entries.
    `fitted_unit`: the unit with the greatest posterior.  `probability`: the posterior of the unit taken.  `uncertain`: it is below `certain`.
    """
    # read once: the mixture is fitted to the entries, and then they are judged
    e = cut(entries(df, id_col, list(fields), detail).filter(F.col("fen").isNotNull() | F.col("bare")), "entries")
    model = model or UnitMixture().fit(e)
    e = _fen(e).withColumn("__post", F.when(F.col("bare"), model.posterior(F.col("declared"), F.col("number"))))
    best = F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.greatest(F.lit(1), F.coalesce(F.array_position("__post", F.array_max("__post")), F.lit(1))).cast("int"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit")), F.lit(1)).cast("int")
    prob = F.when(F.col("bare"), F.try_element_at("__post", place)).otherwise(F.lit(1.0))
    return e.select("id", "field", F.col("item_no").cast("int").alias("item_no"), "raw", "unit", F.when(F.col("bare"), best).alias("fitted_unit"), "amount_fen", prob.alias("probability"), F.coalesce(prob < certain, F.lit(True)).alias("uncertain"), "declared", "bare")
