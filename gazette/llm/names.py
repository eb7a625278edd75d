"""Variant spellings of institution names, linked to a reference list (problem 4).

Trie join.  Every canonical name gives forms (full name, name without its corporate tail, customary abbreviations,
initials, romanised name); the forms of a shard of the reference list make a trie.  A typed value is folded and cut into
components; each component in turn is tried at the head, so the order of components (branch before or after, in brackets
or not) does not matter.  A Levenshtein automaton with transpositions is run over the trie: states are (node, place,
errors), only the edges that the next character or a remaining error permits are followed.  Where a form ends, the rest
of the component must be a corporate tail, a branch or unit, or a cut-off piece of one.  Of the forms reached the one
with fewest errors, then the longest, is taken; if two institutions tie, the value is linked to none.

Values are made distinct before anything else, so a name that a third of all rows carry is looked up once.

Defined results: NULL, blank and generic values are no case; a value equal to its canonical name is no case; institutions
outside the list are linked to nothing; repeated rows give one result per id.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_FORMS = 50_000
BLOCK_VALUES = 20_000  # values looked up in one shard by one task
# Kinds of institution, their customary abbreviations (after the name, after its first character) and English.
KINDS = {
    "农村商业银行": (["农村商业银", "农商银行", "农商行", "农商"], ["农商行", "农商"], "rural commercial bank"),
    "农村信用社联合社": (["农村信用联社", "农村信用社", "农信联社", "农信社", "农信"], ["农信社", "农信"], "rural credit union"),
    "村镇银行": (["村镇行", "村行", "村镇"], ["村行", "村镇", "村"], "village bank"),
    "人寿保险": (["寿险", "人寿"], ["人寿", "寿"], "life insurance"),
    "国际信托": (["信托"], ["信托", "信"], "trust"),
    "消费金融": (["消金"], ["消金", "消"], "consumer finance"),
    "金融租赁": (["金租"], ["金租", "租"], "financial leasing"),
    "证券": ([], ["券"], "securities"),
    "银行": ([], ["行"], "bank"),
}
TAILS = ("股份有限公司", "有限责任公司", "有限公司")
TRADITIONAL = str.maketrans("銀國際農險賃證費業聯總財產資務區廣東華灣橋澤濱營門團實電貿體濟鎮紀龍匯豐壽點縣對與號頁", "银国际农险赁证费业联总财产资务区广东华湾桥泽滨营门团实电贸体济镇纪龙汇丰寿点县对与号页")
# Readings of the characters that names of institutions here begin with.
READINGS = dict(
    x.split(":")
    for x in (
        "岚:lan 峤:qiao 昀:yun 昶:chang 晏:yan 晞:xi 暄:xuan 曜:yao 棠:tang 槿:jin 沄:yun 泠:ling 洵:xun 浔:xun 淙:cong 溯:su 漪:yi 潆:ying 澈:che 烨:ye 焱:yan 煜:yu 熠:yi 玥:yue 珞:luo 珣:xun 琥:hu 琰:yan 璟:jing "
        "砚:yan 筠:jun 绮:qi 缦:man 翎:ling 翡:fei 芷:zhi 茗:ming 蘅:heng 霁:ji 黛:dai 坞:wu 坪:ping 坳:ao 垣:yuan 埠:bu 堡:bao 塘:tang 塬:yuan 墟:xu 寨:zhai 屿:yu 岭:ling 岸:an 峪:yu 崖:ya 崮:gu 川:chuan 桥:qiao "
        "汀:ting 沚:zhi 泊:bo 泽:ze 津:jin 洲:zhou 浒:hu 浦:pu 涘:si 渚:zhu 渡:du 湄:mei 湾:wan 溪:xi 滩:tan 澳:ao 畴:chou 邑:yi 阡:qian 陂:bei 陌:mo 麓:lu"
    ).split()
)
ALSO = {"bao": "bu", "bei": "po"}  # second readings in use
LABEL = re.compile(r"^(?:业主单位|招标单位|采购单位|建设单位|招标人|采购人|甲方|客户|单位)[:：\s]*")
NOTE = re.compile(r"[,，;；。](?:联系人|详见|见公告|电话|地址).*$|[/、,，;；。.\s]+$")
BRANCH = r"(?:分行|支行|分公司|子公司|营业部|中心|科技部|分部|办事处|总行|总部|本级|本部)"
OTHER = re.compile("银行|证券|保险|信托|金融|租赁|信用社")
REST = re.compile(rf"^[股份有限责任公司]{{0,9}}(?:.{{0,8}}{BRANCH}?(?:科技部|本级|总部)?)?$")
HEAD = re.compile(rf"^(?:.{{2,8}}?(?:分行|支行|分公司|营业部|中心|科技部))+")
STOP = {"the", "co", "ltd", "limited", "company", "inc", "corp", "corporation", "plc", "of"}


def fold(value: str) -> str:
    v = unicodedata.normalize("NFKC", value).translate(TRADITIONAL)
    v = re.sub(r"[​-‏﻿·•・]", "", v).strip()
    return NOTE.sub("", LABEL.sub("", v)).strip()


def kind_of(name: str) -> tuple[str, str, str] | None:
    """(proper name, kind, corporate tail) of a Chinese institution."""
    tail = next((t for t in TAILS if name.endswith(t)), "")
    stem = name[: len(name) - len(tail)]
    kind = next((k for k in KINDS if stem.endswith(k)), None)
    return (stem[: -len(kind)], kind, tail) if kind and len(stem) > len(kind) else None


def latin_tokens(value: str) -> list[str]:
    v = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    tokens = [t.lower() for t in re.findall(r"[A-Za-z]+", v)]
    out = ["bank" if t in ("bk", "bnk") else t for t in tokens]
    return [t for t in out if t not in STOP and not (len(t) == 5 and sorted(t) == sorted("china"))]


def forms(name: str, aliases: list[str]) -> list[tuple[str, int]]:
    """(form, errors allowed in it) of a canonical name.  Latin forms are their tokens in alphabetical order."""
    out: dict[str, int] = {}

    def put(f: str, k: int) -> None:
        out[f] = max(k, out.get(f, 0))

    folded = fold(name)
    parts = kind_of(folded)
    if parts:
        core, kind, tail = parts
        after, initial, english = KINDS[kind]
        put(core + kind, 1)
        for a in after:
            put(core + a, 1 if len(core + a) >= 5 else 0)
        for a in initial:
            put(core[0] + a, 0)
        if all(c in READINGS for c in core):
            first, rest = READINGS[core[0]], [READINGS[c] for c in core[1:]]
            for r in {"".join(rest), "".join(ALSO.get(x, x) for x in rest)}:
                put(_latin([first + r, *english.split()]), 0)
    else:
        tokens = latin_tokens(name)
        if tokens and re.search("[A-Za-z]", name):
            put(_latin(tokens), 1)
        else:
            put(folded, 1 if len(folded) >= 6 else 0)
    for a in aliases:
        f = fold(a)
        if re.search(r"[.*\\\[\]^$+?|]", a) or len(f) < 2:
            continue
        t = latin_tokens(f)
        if re.search("[A-Za-z]{2}", f):
            put(_latin(t) if len(t) > 1 else "~" + f.lower(), 0)
        else:
            put(f, 0)
    return list(out.items())


def _latin(tokens: list[str]) -> str:
    """Tokens as a key that does not depend on their order."""
    kinds = [t for t in tokens if t in _ENGLISH]
    rest = sorted(t for t in tokens if t not in _ENGLISH)
    return "~" + " ".join(rest) + "|" + " ".join(sorted(kinds))


_ENGLISH = {w for _, _, e in KINDS.values() for w in e.split()}


class Node:
    __slots__ = ("kids", "ends")

    def __init__(self):
        self.kids: dict[str, Node] = {}
        self.ends: list[tuple[str, int]] = []


class Trie:
    def __init__(self, entries: list[tuple[str, str, int]]):
        """entries: (form, canonical, errors allowed)."""
        self.root = Node()
        for form, name, k in entries:
            node = self.root
            for c in form:
                node = node.kids.setdefault(c, Node())
            node.ends.append((name, k))

    def near(self, text: str, k: int) -> list[tuple[str, int, int, int]]:
        """(canonical, errors, length of the form, place in the text behind it) of all forms within k errors of a head."""
        got: dict[tuple[str, int], tuple[int, int]] = {}
        n, seen = len(text), set()
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, j, e, d = stack.pop()
            key = (id(node), j, e)
            if key in seen:
                continue
            seen.add(key)
            for name, allowed in node.ends:
                if e <= allowed and got.get((name, j), (9, 0)) > (e, -d):
                    got[(name, j)] = (e, -d)
            kid = node.kids.get(text[j]) if j < n else None
            if kid is not None:
                stack.append((kid, j + 1, e, d + 1))
            if e < k:
                if j < n:
                    stack.append((node, j + 1, e + 1, d))
                for c, kid in node.kids.items():
                    stack.append((kid, j, e + 1, d + 1))
                    if j < n and c != text[j]:
                        stack.append((kid, j + 1, e + 1, d + 1))
                if j + 1 < n and (kid := node.kids.get(text[j + 1])) and (grand := kid.kids.get(text[j])):
                    stack.append((grand, j + 2, e + 1, d + 2))
        return [(name, e, -d, j) for (name, j), (e, d) in got.items()]


def components(value: str) -> list[str]:
    """The value's components in every order that can put the institution at the head."""
    v = fold(value)
    whole = re.sub(r"\s", "", v)
    out = [re.sub(r"[()（）\[\]【】]", "", whole)]
    out.append(re.sub(r"[（(][^（）()]*[)）]", "", whole))
    inner = re.findall(r"[（(]([^（）()]+)[)）]", whole)
    out += inner
    out += [p for p in re.split(r"[-—–/|、,，（）()]", whole) if len(p) >= 2]
    out += [re.sub(r"\s", "", p) for p in re.split(r"\s+", v) if len(p) >= 2 and " " in v.strip()]
    for p in list(out):
        m = HEAD.match(p)
        if m and m.end() < len(p):
            out.append(p[m.end() :].lstrip("-—– ()（）"))
    return list(dict.fromkeys(x for x in out if x))


def best(value: str, trie: Trie) -> tuple[int, int, set[str]] | None:
    """(errors, minus the length of the form, all institutions at that rank) of the best forms in the value, or None."""
    v = fold(value)
    if len(v) < 2:
        return None
    hits: list[tuple[int, int, str]] = []
    if re.search("[A-Za-z]{3}", v) and len(re.findall("[A-Za-z]", v)) > 0.5 * len(v):
        tokens = latin_tokens(v)
        keys = {_latin(tokens), "~" + re.sub(r"\s", "", v).lower()}
        for k in (0, 1):
            for key in keys:
                hits += [(e, -d, name) for name, e, d, j in trie.near(key, k) if j == len(key)]
            if hits:
                break
    else:
        parts = components(value)
        for k in (0, 1):
            for p in parts:
                for name, e, d, j in trie.near(p, k):
                    rest = p[j:]
                    if d <= 3 and rest and not re.match(rf"^.{{0,8}}{BRANCH}", rest):
                        continue
                    if REST.match(rest) and not OTHER.search(rest):
                        hits.append((e, -d, name))
            if hits:
                break
    if not hits:
        return None
    top = min(h[:2] for h in hits)
    return (*top, {h[2] for h in hits if h[:2] == top})


def link(value: str, trie: Trie) -> tuple[str, int] | None:
    """(canonical, errors) the value means, or None; None too if two institutions tie."""
    b = best(value, trie)
    return (next(iter(b[2])), b[0]) if b and len(b[2]) == 1 else None


def heads(form: str) -> list[str]:
    """The characters by which a form is put into shards: with one error one of its first two is a head's first or second."""
    return list(dict.fromkeys(form.lstrip("~")[:2])) or [""]


def probes(value: str) -> list[str]:
    """The characters whose shards can hold a form of the value: the first two of each component."""
    v = fold(value)
    tokens = latin_tokens(v)
    keys = [_latin(tokens), re.sub(r"\s", "", v).lower()]
    return list(dict.fromkeys(c for part in [*components(value), *keys] for c in part.lstrip("~")[:2]))


def links(values: DataFrame, reference: DataFrame, shard_forms: int = SHARD_FORMS, block_values: int = BLOCK_VALUES) -> DataFrame:
    """value, canonical, errors: of every distinct value the canonical name it means.

    reference: canonical, aliases (array).  A list of one shard (the usual case) is sent with the tasks.  A longer one is
    cut into shards of about `shard_forms` forms by the heads of its forms; a value is looked up in the shards of its own
    heads only, in blocks of about `block_values` values.  Every shard returns all institutions at its best rank, and the
    best rank over the shards decides as it does in one trie.
    """
    v = values.filter(F.col("value").rlike("\\S")).groupBy("value").agg(F.lit(1).alias("one")).select("value")
    n = reference.count()
    shards = max(1, -(-n * 12 // shard_forms))
    if shards == 1:
        entries = [(f, r["canonical"], k) for r in reference.collect() for f, k in forms(r["canonical"], list(r["aliases"] or []))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trie = Trie(entries)
            for b in batches:
                got = [link(x, trie) for x in b["value"]]
                keep = [g is not None for g in got]
                yield pd.DataFrame({"value": b["value"][keep], "canonical": [g[0] for g in got if g], "errors": [g[1] for g in got if g]})

        return v.mapInPandas(run, "value string, canonical string, errors int")
    shards *= 2  # a form is in the shards of its first two characters
    shard = lambda c: zlib.crc32(c.encode()) % shards
    blocks = max(1, -(-v.count() * 4 // (shards * block_values)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, s, zlib.crc32(x.encode("utf-8", "replace")) % blocks) for x in b["value"] for s in sorted({shard(c) for c in probes(x)})]
            yield pd.DataFrame(rows, columns=["value", "shard", "block"])

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, c, k, s) for c, a in zip(b["canonical"], b["aliases"]) for f, k in forms(c, list(a) if a is not None else []) for s in sorted({shard(h) for h in heads(f)})]
            yield pd.DataFrame(rows, columns=["form", "canonical", "allowed", "shard"])

    q = v.mapInPandas(send, "value string, shard int, block int")
    r = reference.select("canonical", "aliases").mapInPandas(post, "form string, canonical string, allowed int, shard int").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(list(zip(right["form"], right["canonical"], right["allowed"])))
        got = [(x, g[0], g[1], sorted(g[2])) for x in left["value"] if (g := best(x, trie))]
        return pd.DataFrame(got, columns=["value", "errors", "rank", "names"])

    each = q.groupBy("shard", "block").cogroup(r.groupBy("shard", "block")).applyInPandas(pair, "value string, errors int, rank int, names array<string>")
    top = each.groupBy("value").agg(F.min(F.struct("errors", "rank")).alias("top"))
    at = each.join(top, "value").filter((F.col("errors") == F.col("top.errors")) & (F.col("rank") == F.col("top.rank")))
    names = at.select("value", "errors", F.explode("names").alias("name")).groupBy("value", "errors").agg(F.min("name").alias("canonical"), F.max("name").alias("other"))
    return names.filter(F.col("canonical") == F.col("other")).select("value", "canonical", "errors")


def reference_list(alias_map: DataFrame, canonical: str = "canonical_customer", pattern: str = "alias_pattern", match: str = "match_type") -> DataFrame:
    """canonical, aliases (the literal patterns) of the reference list."""
    literal = F.when(F.col(match).isin("exact", "contains"), F.col(pattern))
    return alias_map.filter(F.col(canonical).rlike("\\S")).groupBy(F.col(canonical).alias("canonical")).agg(F.collect_set(literal).alias("aliases"))


def linked(df: DataFrame, id_col: str, name_col: str, reference: DataFrame) -> DataFrame:
    """row_id, value, canonical of every row whose name means a listed institution but is written otherwise."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(name_col).alias("value")).filter(F.col("value").rlike("\\S"))
    # rows written canonically go before the join: they are the bulk, and often one name
    exact = reference.select(F.col("canonical").alias("value"))
    rest = rows.join(exact, "value", "left_anti")
    found = links(rest, reference)
    return rest.join(found, "value").filter(F.col("value") != F.col("canonical")).select("row_id", "value", "canonical")
