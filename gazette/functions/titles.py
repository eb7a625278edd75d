"""Titles, addresses, days and records put together from candidates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.functions.text import join_ocr_lines, squeeze

# fixed values: words that only a notice's heading has
NOTICE_WORDS = ["项目", "工程", "采购", "招标", "中标", "成交", "公告", "候选人", "磋商"]
TITLE_TAIL = "\\s*[-_|–—]\\s*[^-_|–—]{2,30}(?:网|平台|门户|中心|系统|官网)\\s*$"


def portal_heading(c: Column, portals: tuple[str, ...] = ("首页",)) -> Column:
    """Whether a heading is no notice's: shorter than four characters, or a portal's name; true for NULL and blank."""
    s = F.coalesce(F.trim(c), F.lit(""))
    return (F.char_length(s) < 4) | (~rules.any_of(s, NOTICE_WORDS) & rules.any_of(s, list(portals)))


def document_title(c: Column) -> Column:
    """A document's title without the portal's name behind it."""
    return squeeze(F.regexp_replace(c, TITLE_TAIL, ""))


def title_in_body(c: Column) -> Column:
    """The project's name that a body gives: behind its label, or in 就…进行…; blanks between Chinese characters dropped."""
    s = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in ("项\\s*目\\s*名\\s*称[：:]\\s*([^\\n。；]{4,120})", "就\\s*([^\\n，。]{6,100}?)\\s*(?:项目)?\\s*(?:进行|组织|面向)")])
    return F.regexp_replace(s, "(?<=[\\u4e00-\\u9fff])\\s+(?=[\\u4e00-\\u9fff])", "")


def embedded_title(c: Column, record: Column) -> Column:
    """The title that a page's embedded JSON holds near a record's id."""
    near = F.regexp_substr(c, F.concat(F.lit('[^{}]{0,400}"id"\\s*:\\s*"?'), record, F.lit('"?[^{}]{0,400}')))
    return F.nullif(F.regexp_extract(near, '"title"\\s*:\\s*"([^"]+)"', 1), F.lit(""))


def best_title(document: Column, candidates: list[Column], body: Column) -> Column:
    """The document's title if it is one, else the first candidate that is, else what the body says."""
    good = lambda c, n: F.when(~portal_heading(c) & (F.char_length(c) > n), c)
    return F.coalesce(good(document_title(document), 8), *[good(squeeze(c), 6) for c in candidates], title_in_body(body))


def best_content(candidates: list[Column], least: int = 80) -> Column:
    """The first of the texts (page, captured file, recognised pages, linked file) that is no shell; else the longest."""
    fit = [F.when(~rules.short_body(c, least) & ~rules.shell_body(c) & ~rules.pointer_body(c), c) for c in candidates]
    longest = reduce(lambda a, b: F.when(F.coalesce(F.char_length(b), F.lit(0)) > F.coalesce(F.char_length(a), F.lit(0)), b).otherwise(a), candidates)
    return F.coalesce(*fit, longest)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The address with the query parameter set: replaced where it is, else added; a fragment stays behind."""
    base, fragment = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1)
    has = base.rlike(f"[?&]{name}=")
    put = F.regexp_replace(base, F.lit(f"([?&]{name}=)[^&]*"), F.concat(F.lit("$1"), value))
    add = F.concat(base, F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(name + "="), value)
    return F.concat(F.when(has, put).otherwise(add), fragment)


# fixed values: words for days
DAY_WORDS = {"today": 0, "今天": 0, "今日": 0, "yesterday": 1, "昨天": 1, "昨日": 1, "t-1": 1, "before_yesterday": 2, "前天": 2}


def day_of(word: str, as_of: dt.date) -> dt.date | None:
    """The day that a word or an ISO date means; None for anything else."""
    w = (word or "").strip().lower()
    if w in DAY_WORDS:
        return as_of - dt.timedelta(days=DAY_WORDS[w])
    try:
        return dt.date.fromisoformat(w)
    except ValueError:
        return None


def shanghai_text(c: Column) -> Column:
    """A UTC instant as wall-clock text of Asia/Shanghai."""
    return F.date_format(F.from_utc_timestamp(c, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


def table_like(page: Column) -> Column:
    """How many elements of a page look like parts of a table: by tag, class or role."""
    return F.size(F.regexp_extract_all(page, F.lit("(?i)<(?:table|tr|td|th)\\b|class\\s*=\\s*[\"'][^\"']*\\b(?:table|grid|row|cell|tr|td|th)\\b|role\\s*=\\s*[\"'](?:table|grid|row|cell|gridcell)"), F.lit(0)))


def answer(c: Column, schema: str) -> Column:
    """The object, or the first object of the list, in a model's answer with or without a code fence; NULL if there is none."""
    inner = F.coalesce(F.nullif(F.regexp_extract(c, "(?s)```(?:json)?\\s*(.*?)```", 1), F.lit("")), c)
    many = F.filter(F.from_json(inner, f"array<struct<{schema}>>"), lambda x: x.isNotNull())
    return F.when(F.trim(inner).startswith("["), F.get(many, F.lit(0))).otherwise(F.from_json(inner, f"struct<{schema}>"))


# fixed values: labelled fields of scanned papers, patterns in order
PAPER_FIELDS = {
    "项目名称": ["项\\s*目\\s*名\\s*称[：:]\\s*(.+?)(?:[。\\n]|$)", "1\\s*[\\.、]\\s*项目名称[：:]\\s*(.+?)(?:[。\\n]|$)"],
    "招标编号": ["招标编号[：:]\\s*([A-Za-z0-9\\-]+)", "编\\s*号[：:]\\s*([A-Za-z0-9\\-]+)", "(GXTC-[A-Za-z]-\\d+)"],
    "发布日期": ["日\\s*期[：:]\\s*(\\d{4}\\s*年\\s*\\d{1,2}\\s*月\\s*\\d{1,2}\\s*[日且曰])", "发布[日时]期[：:]\\s*(.+?)(?:\\n|$)"],
    "项目预算": ["项目预算\\s*(\\d+[\\d\\.]*\\s*万元)", "预算[：:]\\s*(.+?万元)", "预算\\s*(\\d+[\\d\\.]*\\s*万元)"],
    "资金来源": ["资金来源[：:]\\s*(.+?)(?=[，。,])", "项目资金来源[：:]\\s*(.+?)(?=[，。,])"],
    "招标人": ["受(.+?)[（(]以", "招\\s*标\\s*人[（(].*?[）)]\\s*[：:]?\\s*(.+?)(?=[，。,\\n]|$)", "采\\s*购\\s*人[：:]\\s*(.+?)(?=[，。,\\n]|$)"],
    "代理机构": ["(.+?)[（(]招标代理机构[）)]", "代理机构[：:]\\s*(.+?)(?=[，。,\\n]|$)", "招标代理[：:]\\s*(.+?)(?=[，。,\\n]|$)"],
    "投标截止时间": ["投标截止[时日]间[：:]\\s*(.+?)(?:\\n|$)", "截止[时日][间期][：:]\\s*(.+?)(?:\\n|$)", "递交投标文件的截止时间[：:为]\\s*(.+?)(?:[。\\n]|$)", "截止时间[为：:]\\s*(.+?)(?=[。\\n，,]|$)"],
    "开标时间": ["开标时间[为：:]\\s*(.+?)(?=[。\\n，,]|$)"],
    "开标地点": ["开标地[点址][为：:]\\s*(.+?)(?=[。\\n，,]|$)"],
    "联系人": ["联\\s*系\\s*人[：:]\\s*(.+?)(?:\\n|$)", "项目联系人[：:]\\s*(.+?)(?:\\n|$)"],
    "联系电话": ["联系电话[：:]\\s*([\\d\\-]+)", "电\\s*话[：:]\\s*([\\d\\-]+)", "电话[为：:]\\s*([\\d\\-]+)"],
    "项目概述": ["项目概[述说][：:]\\s*(.+?)(?=[。\\n])", "3\\s*[\\.、]\\s*项目概[述说][：:]\\s*(.+?)(?=[。\\n])"],
}


def paper_record(c: Column) -> Column:
    """JSON of the labelled fields and the qualification section of a scanned paper; 且 and 曰 read for 日 in dates put right."""
    t = join_ocr_lines(c)
    fields = {k: squeeze(rules.first_match(t, ps)) for k, ps in PAPER_FIELDS.items()}
    for k in fields:
        if "日期" in k or "时间" in k:
            fields[k] = F.regexp_replace(fields[k], "(\\d{1,2})\\s*[且曰]", "$1日")
    section = F.substring(F.trim(F.regexp_extract(t, "(?:合格投标人的?资格要求|资格要求)[：:]?\\s*([\\s\\S]*?)(?=\\d+\\s*[\\.、]\\s*(?:投标|招标|其他)|$)", 1)), 1, 3000)
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], F.nullif(section, F.lit("")).alias("资格要求")))
