"""Template residue, filler text and site messages in place of content (problem 1).

Every text is cut into segments (lines, and columns two blanks apart).  Placeholders are found by one grammar per
delimiter.  A segment counts as unfilled if, after its label, nothing but placeholders and punctuation is left, or if it
is a sentence with a placeholder in a blank's place.  The density of unfilled entries among all entries, and the amount
of real prose around them, decide; code blocks, quotations and explanations of a notation (tutorials, forms to be filled
in by bidders) are discounted first.  Messages and filler are decided on what remains when site navigation and the
heading are taken away.

Defined results: NULL, empty and blank texts are no case, nor are texts without any residue.  Texts of any length are
read whole.  Repeated rows give one finding per id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One grammar per delimiter; each names one blank to be filled.
GRAMMARS = {
    "mustache": r"\{\{[^{}\n]{0,60}\}\}",
    "dollar": r"\$\{[^{}\n]{0,60}\}",
    "tag": r"\{%[^{}\n]{0,60}%\}",
    "asp": r"<%=?[^<>\n]{0,60}%>",
    "wiki": r"\[\[[^\[\]\n]{0,60}\]\]",
    "at": r"@@?[A-Za-z_][A-Za-z_0-9]{1,40}@@?",
    "hash": r"#[A-Z][A-Z_0-9]{1,40}#",
    "percent": r"%[A-Za-z_][A-Za-z_0-9]{1,40}%",
    "printf": r"%\(?[a-z_]{0,30}\)?[sd](?![A-Za-z0-9%])",
    "index": r"\{\d{1,2}\}",
    "brace": r"(?<!\$)\{[A-Za-z_][A-Za-z_0-9]{1,40}\}",
    "lenticular": r"【[^【】\n]{1,20}】",
    "remark": r"[（(](?:此处|请|待)填写?[^（）()\n]{0,20}[)）]",
    "rule": r"_{2,}|＿{2,}",
    "cross": r"[XＸ]{2,}|[xｘ×]{3,}|\*{3,}|[○〇]{2,}",
    "void": r"(?<![A-Za-z])(?:undefined|null|NaN|None)(?![A-Za-z])",
}
PLACEHOLDER = re.compile("|".join(GRAMMARS.values()))
# Wordings of filler, of site messages and of navigation.
FILLER = re.compile(r"占位|示例文字|样例|勿删|发布前请替换|待补充|测试数据|测试公告|请勿处理|内容建设中|敬请期待|模板(?:文字|内容|标题|正文|公告|项目|采购)|lorem|ipsum|(?:这里|此处)(?:是|为).{0,12}(?:文本|文字|数据|内容|XXX|替换|正文|标题|需求|概况)", re.I)
MESSAGE = re.compile(
    r"java\s?script|启用脚本|脚本(?:功能|执行|运行|被拦截|权限)?|noscript|scripts?\b|scripting|\bJS\b|cookie|"
    r"不存在|已(?:被)?删除|被删除|已下架|检查您的浏览器|走丢|找不到|已失效|已过期|登录(?:状态|后|超时)|请(?:先|重新)?登录|重新登录|权限|会员|验证码|完成验证|安全验证|访问过于频繁|访问频率|访问受限|拒绝访问|禁止访问|仅限|"
    r"系统繁忙|繁忙|超时|数据库连接|网关(?:无响应|超时|错误|异常)|无响应|服务器(?:开小差|错误|内部|异常|繁忙)|开小差|抢修|接口返回|加载失败|加载中|错误代码|稍后再试|稍后重试|返回首页|系统(?:维护|升级)中|维护中|请求(?:失败|错误)|"
    r"HTTP Status|Bad Gateway|Gateway Time|Service Unavailable|Internal Server Error|Not Found|Access Denied|Forbidden|Exception|\bat [a-z]+\.[A-Za-z.]+\(|Error \d|ERR[-_]|Fatal error|Warning: |Traceback|\b[A-Z]\w*(?:Error|Exception)\b|File \"[^\"]+\", line|timed out|retry later|establishing a database|\"(?:code|msg|error|trace)\":|"
    r"Checking your browser|reload the page|browser settings|Please enable|session (?:has )?expired|log ?in|sign in|permission|too many requests|captcha",
    re.I,
)
NAVIGATION = re.compile(r"^(?:首页\s*[>›»].*|版权所有.*|关闭窗口.*|打印本页.*|【字体.*|当前位置.*|返回首页|网站地图.*|技术支持.*|上一篇.*|下一篇.*|(?:流水号|节点|request id|Reference|Ray)\b.*)$", re.I)
HEADING = re.compile(r"(?:项目|公告|公示|通知|采购|招标)$")
DISCOUNT = re.compile(r"```.*?```|<code>.*?</code>|<pre>.*?</pre>|[“\"「『][^”\"」』\n]{0,80}[”\"」』]", re.S)
TUTORIAL = re.compile(r"格式|填写|示例[:：]|变量|标注|语法|教程|写作|表示|替换为|投标函|报名表|授权书|样表|附表|附[:：件]|加盖公章")
ENTRY = re.compile(r"^\s*[\w（）()/ ]{1,16}[:：]\s*(.*)$")
# what only stands in a notice: messages beside it are spoken of, not shown
NOTICE = re.compile(r"(?:采购|招标|项目)编号|联系人[:：]|特此公告|开标时间|(?:投标人|供应商)(?:应|须|需|可)|预算(?:金额)?[:：]|采购人[:：]")
WORDS = re.compile(r"[a-z]{3,}", re.I)
ENGLISH = re.compile(r"\b(?:the|of|and|to|is|for|in|on|with|by|be|shall|this|that|your|you|page|from|are|at|or)\b", re.I)
# One sentence over and over with REPEAT_MARKS or more sentence ends counts only beside one of these signs.
REPEAT_SIGNS = ("占位", "示例", "样例", "勿删", "请勿处理", "建设中", "测试测试", "asdf", "orem", "psum", "{{", "${", "<%", "@@")
REPEAT_MARKS = 4
JUNK = {"test", "demo", "asdf", "aaa", "xxx", "abc", "qwe", "123", "111", "测试", "正文", "内容", "文本", "标题"}


def _segments(text: str) -> list[str]:
    return [s.strip() for line in text.splitlines() for s in re.split(r"[ 　\t]{2,}", line) if s.strip()]


def _unfilled(value: str) -> bool:
    """A value of nothing but placeholders, punctuation and brackets."""
    if not PLACEHOLDER.search(value):
        return False
    return not re.sub(r"[\W_]|年|月|日|时|分|元|万", "", PLACEHOLDER.sub("", value))


def _repeats(text: str, whole: str) -> bool:
    """One short sentence over and over, or a handful of tokens shuffled; whole: the text with its heading."""
    parts = [p for p in re.split(r"[。！!.\n]", text) if p.strip()]
    if len(parts) >= 2 and len({p.strip() for p in parts}) == 1 and (text.count("。") + text.count("；") < REPEAT_MARKS or any(x in whole for x in REPEAT_SIGNS)):
        return True
    tokens = text.split()
    return len(tokens) >= 3 and sum(t.lower() in JUNK for t in tokens) >= 0.8 * len(tokens)


def _pseudo_latin(text: str) -> bool:
    """Prose-like Latin letters without one function word of English."""
    w = WORDS.findall(text)
    letters = sum(map(len, w))
    return len(w) >= 5 and letters > 0.7 * len(re.sub(r"\s", "", text)) and not ENGLISH.search(text) and not re.search(r"\d|[A-Z]{2}|Co\.|Ltd|Bank", text)


def classify(text: str | None) -> str | None:
    """'template', 'filler' or 'message' if that stands where content belongs, else None."""
    if text is None or not text.strip():
        return None
    segs = [s for s in _segments(text) if not NAVIGATION.match(s)]
    if not segs:
        return None
    bare = DISCOUNT.sub("", text)
    unfilled = filled = prose = 0
    tutorial = bool(TUTORIAL.search(bare))
    blanks = sentence_blanks = 0
    for s in segs:
        m = ENTRY.match(s)
        hits = PLACEHOLDER.findall(s)
        if m and _unfilled(m.group(1)):
            unfilled += 1
        elif hits and not m and len(hits) >= 2 and len(s) < 80:
            sentence_blanks += 1
        elif m and m.group(1):
            filled += 1
            prose += len(s) if len(m.group(1)) > 40 else 0
        elif not HEADING.search(s) or len(s) > 60:
            prose += len(s)
        blanks += len(hits)
    if unfilled + sentence_blanks >= 1 and unfilled + sentence_blanks > (filled + unfilled) / 2 and prose < (40 if tutorial else 80):
        if unfilled >= 2 or sentence_blanks or (unfilled and filled == 0 and prose == 0):
            return "template"
    body = [s for s in segs if not (HEADING.search(s) and len(s) < 60 and len(segs) > 1 and not FILLER.search(s) and not MESSAGE.search(s))] or segs
    rest = "\n".join(body)
    chars = sum(len(s) for s in body if FILLER.search(s))
    if chars >= 0.5 * sum(map(len, body)) or _fills(rest):
        return "filler"
    if _repeats(rest, text) or _pseudo_latin(rest):
        return "filler"
    parts = [p for s in body for p in re.split(r"(?<=[。；！])", s) if p]
    said = sum(len(p) for p in parts if MESSAGE.search(p))
    if said >= 0.5 * sum(map(len, parts)) and not NOTICE.search(rest):
        return "message"
    return None


def _fills(text: str) -> bool:
    """Most sentences of the text are filler."""
    parts = [p for p in re.split(r"[。；;\s]", text) if p]
    return bool(parts) and sum(bool(FILLER.search(p)) for p in parts) > 0.6 * len(parts)


def classify_short(value: str | None) -> str | None:
    """The same for a field of one word: it is residue if nothing but a placeholder or filler is there."""
    if value is None or not value.strip():
        return None
    v = value.strip()
    if _unfilled(v):
        return "template"
    if re.fullmatch(r"[XＸx×]{2,}\S{0,6}", v):
        return "template"
    if FILLER.search(v) or re.search(r"占位|示例", v):
        return "filler"
    return "message" if MESSAGE.search(v) else None


def residue(df: DataFrame, id_col: str = "id", long_fields: tuple[str, ...] = ("detail",), short_fields: tuple[str, ...] = ("audit_status",)) -> DataFrame:
    """id, field, kind of every field value that holds residue instead of content.

    Short fields are decided on their distinct values, which are joined back; of long ones every text is read.
    """
    out = None
    for f in long_fields:
        d = df.filter(F.col(f).rlike("\\S")).select(F.col(id_col).alias("id"), F.col(f).alias("text"))

        def run(batches: Iterator[pd.DataFrame], f=f) -> Iterator[pd.DataFrame]:
            for b in batches:
                kinds = [classify(t) for t in b["text"]]
                yield pd.DataFrame({"id": b["id"], "field": f, "kind": kinds})[[k is not None for k in kinds]]

        part = d.mapInPandas(run, "id long, field string, kind string")
        out = part if out is None else out.unionByName(part)
    for f in short_fields:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                kinds = [classify_short(t) for t in b["value"]]
                yield pd.DataFrame({"value": b["value"], "kind": kinds})[[k is not None for k in kinds]]

        values = df.filter(F.col(f).isNotNull()).groupBy(F.col(f).alias("value")).count().select("value")
        bad = values.mapInPandas(run, "value string, kind string")
        part = df.select(F.col(id_col).alias("id"), F.col(f).alias("value")).join(bad, "value").select("id", F.lit(f).alias("field"), "kind")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def without_residue(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of df none of whose fields holds residue; extra columns stay as they are."""
    bad = residue(df, id_col).select(F.col("id").alias("__bad")).distinct()
    return df.join(bad, df[id_col] == bad["__bad"], "left_anti")
