"""HTML with tables inside tables, and tables that lost their markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)


def outer_tables(page: str) -> list[tuple[int, int]]:
    """Places of the tables that are in no other table."""
    out, depth, start = [], 0, 0
    for m in _TAG.finditer(page):
        if m.group(1):
            depth = max(0, depth - 1)
            if depth == 0 and start is not None:
                out.append((start, m.end()))
                start = None
        else:
            if depth == 0:
                start = m.start()
            depth += 1
    return out


def cell_text(fragment: str) -> str:
    s = re.sub(r"(?i)<br\s*/?>", "\n", fragment)
    s = html.unescape(re.sub(r"<[^>]+>", " ", s)).replace("\xa0", " ")
    return re.sub(r"[ \t]+", " ", s).strip()


def rows_of(table: str) -> list[list[str]]:
    """Rows padded to the widest; header cells come before data cells."""
    rows = []
    for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", table):
        cells = [cell_text(c) for k in ("th", "td") for c in re.findall(rf"(?is)<{k}[^>]*>(.*?)</{k}>", r)]
        if cells:
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("\n", " ") for c in r) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * len(rows[0])) + " |", *map(line, rows[1:])])


def blocks(page: str) -> tuple[list[str], list[list[list[str]]], str]:
    """(text blocks, tables, the text with tables as markdown) of a page."""
    page = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", page)
    texts, tables, whole, at = [], [], [], 0

    def put(fragment: str) -> None:
        t = re.sub(r"(?i)</(?:p|div|li|h\d)>", "\n\n", fragment)
        for b in re.split(r"\n\s*\n", cell_text(t)):
            if b.strip():
                texts.append(b.strip())
                whole.append(b.strip())

    for a, b in outer_tables(page):
        put(page[at:a])
        rows = rows_of(page[a:b])
        if rows:
            tables.append(rows)
            whole.append(markdown(rows))
        at = b
    put(page[at:])
    return texts, tables, "\n\n".join(whole)


def structured(c: Column) -> Column:
    """struct(text_blocks, tables, text) of a page; NULL for NULL."""

    @F.pandas_udf("text_blocks array<string>, tables array<array<array<string>>>, text string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            r = [blocks(x) if x is not None else (None, None, None) for x in s]
            yield pd.DataFrame({"text_blocks": [x[0] for x in r], "tables": [x[1] for x in r], "text": [x[2] for x in r]})

    return run(c)


def vertical_table(lines: list[str], heading: str, header: list[str], stop: str) -> tuple[list[str], list[list[str]]]:
    """A table that came as one cell per line, put back: under a line that matches `heading`, the header's labels one per
    line, then cells until a line that matches `stop`; whole rows only.  (lines with the rows as markdown, rows)."""
    n = len(header)
    for i, ln in enumerate(lines):
        if not re.search(heading, ln):
            continue
        body = [(j, x.strip()) for j, x in enumerate(lines[i + 1 :], i + 1) if x.strip()]
        if [x for _, x in body[:n]] != header:
            continue
        cells, end = [], len(lines)
        for j, x in body[n:]:
            if re.search(stop, x):
                end = j
                break
            cells.append(x)
        if not cells or len(cells) % n:
            continue
        rows = [header] + [cells[k : k + n] for k in range(0, len(cells), n)]
        return lines[: i + 1] + markdown(rows).split("\n") + lines[end:], rows
    return lines, []


# fixed values: tables that came as one cell per line: what stands above them, their headers, what ends them
LAYOUTS = [
    ("二、\\s*采购内容", ["标段名称", "分类", "报价项名称", "规格参数", "计量单位", "数量"], "^[三四五六七八九十]+、"),
    ("[一二三四五六七八九十]+、\\s*中标结果", ["序号", "中标供应商名称"], "^[一二三四五六七八九十]+、"),
    ("[一二三四五六七八九十]+、\\s*成交内容", ["序号", "采购内容", "数量", "成交供应商"], "^[一二三四五六七八九十]+、"),
    ("成交[：:]\\s*$", ["序号", "寻源单名称", "供应商名称"], "^[一二三四五六七八九十]+、|[：:]$"),
]
REVIEW_HEADING = "四、\\s*评审结果"
REVIEW_ROW = re.compile("^(\\d{1,3})\\s+(\\S.*?)\\s+([\\d,]+(?:\\.\\d+)?)$")
REVIEW_HEADER = ["序号", "中标单位名称", "投标报价（人民币元，含税）"]


def review_table(lines: list[str]) -> tuple[list[str], list[list[str]]]:
    """Rows of number, bidder and price below the heading of a review, whose header was broken over lines."""
    for i, ln in enumerate(lines):
        if re.search(REVIEW_HEADING, ln):
            at = [j for j in range(i + 1, len(lines)) if REVIEW_ROW.match(lines[j].strip())]
            at = [j for k, j in enumerate(at) if j == at[0] + k]
            if at and any("中标单位" in x for x in lines[i + 1 : at[0]]):
                rows = [REVIEW_HEADER] + [list(REVIEW_ROW.match(lines[j].strip()).groups()) for j in at]
                return lines[: i + 1] + markdown(rows).split("\n") + lines[at[-1] + 1 :], rows
    return lines, []


def repair_tables(text: str, known: list[list[list[str]]] | None = None, passes: int = 5) -> tuple[str, list[list[list[str]]]]:
    """(text, tables put back) by every layout, each at most `passes` times; a layout whose header `known` has is left out."""
    lines, found = text.split("\n"), []
    heads = [tuple(c.strip() for c in t[0]) for t in known or [] if t]
    for heading, header, stop in LAYOUTS:
        if any(h[: len(header)] == tuple(header) for h in heads):
            continue
        for _ in range(passes):
            lines, rows = vertical_table(lines, heading, header, stop)
            if not rows:
                break
            found.append(rows)
    if not any(len(h) > 1 and h[0] == "序号" and "中标" in h[1] for h in heads):
        lines, rows = review_table(lines)
        found += [rows] if rows else []
    return "\n".join(lines), found


def repaired_tables(c: Column) -> Column:
    """struct(text, tables) of a text with its tables put back; NULL for NULL."""

    @F.pandas_udf("text string, tables array<array<array<string>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        r = [repair_tables(x) if x is not None else (None, None) for x in s]
        return pd.DataFrame({"text": [x[0] for x in r], "tables": [x[1] for x in r]})

    return run(c)


def body_column(c: Column) -> Column:
    """`body_below` of a text; NULL for NULL."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: body_below(x) if x is not None else None)

    return run(c)


def body_below(text: str, anchors: tuple[str, ...] = ("详情正文", "公告正文"), chrome: tuple[str, ...] = ("收藏", "打印", "分享", "返回", "关注", "字体"), ends: tuple[str, ...] = ("招标进展", "相关推荐")) -> str:
    """The text below the first anchor there is, without short interface lines before and after it, up to an end."""
    for a in anchors:
        if a in text:
            text = text.split(a, 1)[1]
            break
    for e in ends:
        text = text.split(e, 1)[0]
    lines = [x.strip() for x in text.split("\n")]
    while lines and (not lines[0] or (len(lines[0]) <= 15 and any(c in lines[0] for c in chrome))):
        lines.pop(0)
    while lines and (not lines[-1] or (len(lines[-1]) <= 15 and any(c in lines[-1] for c in chrome))):
        lines.pop()
    return "\n".join(lines)
