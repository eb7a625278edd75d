"""Text functions as columns: cleaning, HTML, dates, names, lists.  NULL in, NULL out, unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Strips all white space of Unicode; SQL's trim only strips blanks."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def has_han(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def drop_prefix_tag(c: Column) -> Column:
    """A title without a leading [tag] of up to 20 characters; the title itself if nothing else is in it."""
    bare = F.trim(F.regexp_replace(c, "^\\[[^\\[\\]]{1,20}\\]", ""))
    return F.when(bare == "", F.trim(c)).otherwise(bare)


def fold_doubled(c: Column, least: int = 8) -> Column:
    """Lines in which every glyph is doubled (at least `least` long, of even length) with each glyph once."""
    line = lambda x: F.when((F.char_length(F.trim(x)) >= least) & x.rlike("^\\s*(?:(\\S)\\1)+\\s*$"), F.regexp_replace(x, "(\\S)\\1", "$1")).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def safe_file_name(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, '[\\\\/:*?"<>|\\r\\n\\t]', "_")), 1, 120)


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment: line breaks kept, tags dropped, blanks collapsed."""
    s = F.regexp_replace(c, "(?i)<br\\s*/?>", "\n")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)&nbsp;", " "), "[ \\t]+", " ")
    return F.trim(s)


def table_cells(row_html: Column) -> Column:
    """Cells of a table row; header cells come before data cells."""
    head = F.regexp_extract_all(row_html, F.lit("(?is)<th[^>]*>(.*?)</th>"), F.lit(1))
    data = F.regexp_extract_all(row_html, F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(F.concat(head, data), strip_html)


def html_table(table_html: Column) -> Column:
    """array<array<string>>: rows of a table without tables inside, padded to the widest row."""
    rows = F.transform(F.regexp_extract_all(table_html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), table_cells)
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def table_markdown(rows: Column) -> Column:
    """Markdown of a table given as rows; a rule under the first row; '' without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(rows[0])), " | "), F.lit(" |"))
    lines = F.concat(F.slice(F.transform(rows, line), 1, 1), F.array(rule), F.slice(F.transform(rows, line), 2, 1_000_000))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def text_blocks(c: Column) -> Column:
    """Blocks of a text between blank lines; the text itself if there is no other."""
    parts = F.filter(F.transform(F.split(c, "\n\n"), lambda v: F.trim(v)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(c)))


def cut_at_markers(c: Column, markers: list[str]) -> Column:
    """HTML before the earliest of the markers, back to the last closing bracket."""
    at = F.least(*[F.when(F.instr(c, m) > 0, F.instr(c, m)) for m in markers], F.lit(2_000_000_000))
    head = F.when(at < 2_000_000_000, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    return F.when(at < 2_000_000_000, F.coalesce(F.nullif(F.regexp_extract(head, "(?s)^(.*>)", 1), F.lit("")), head)).otherwise(head)


def fix_url(c: Column) -> Column:
    s = F.trim(c)
    return F.when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s)).otherwise(s)


def viewer_target(c: Column) -> Column:
    """The file behind a PDF viewer's address, else the address."""
    file = F.try_parse_url(c, F.lit("QUERY"), F.lit("file"))
    return F.coalesce(F.try_url_decode(file), c)


def image_sources(c: Column) -> Column:
    """Sources of the images of a page, in order, once each; inline data and beacons left out."""
    src = F.regexp_extract_all(c, F.lit("(?i)<img[^>]*?(?:data-original|data-src|data-lazy|src)\\s*=\\s*[\"']([^\"']+)"), F.lit(1))
    return F.array_distinct(F.filter(src, lambda x: ~x.startswith("data:") & ~x.rlike("(?i)beacon|1x1|pixel")))


def datetime_text(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of a date or date and time in loose notation; NULL for anything else."""
    p = "^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})(?:\\s+(\\d{1,2})[：:](\\d{1,2})(?:[：:](\\d{1,2}))?)?"
    s = py_strip(c)
    g = lambda i: F.lpad(F.regexp_extract(s, p, i), 2, "0")
    date = F.concat_ws("-", F.regexp_extract(s, p, 1), g(2), g(3))
    time = F.when(F.regexp_extract(s, p, 5) != "", F.concat_ws(":", g(4), g(5), g(6))).otherwise(F.lit("00:00:00"))
    return F.when(s.rlike(p), F.concat(date, F.lit(" "), time))


def date_text(c: Column) -> Column:
    return F.substring(datetime_text(c), 1, 10)


def published_date(date: Column, text: Column, as_of: Column, days: int = 180) -> Column:
    """date (yyyy-MM-dd) unless its digits stand in a longer figure of the text, or it is `days` days or more before as_of."""
    d = F.try_to_date(date, "yyyy-MM-dd")
    compact = F.replace(date, F.lit("-"), F.lit(""))
    inside = F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit("\\d"), compact, F.lit("\\d")))
    return F.when(d.isNotNull() & ~inside & (d > F.date_sub(as_of, days)), date)


def dotted(d: Column) -> Column:
    return F.date_format(d, "yyyy.MM.dd")


def month_day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MM/dd"), F.lit("-"))


def split_multi(c: Column, slash: bool = True) -> Column:
    """Parts of a cell with several values, once each, in order; an empty array for NULL."""
    parts = F.split(F.coalesce(c, F.lit("")), "[|,，;；/\\s]+" if slash else "[|,，;；\\s]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


# fixed values: the tokens that are dropped from names of organisations, in this order
ORG_TOKENS = ["股份有限公司", "有限责任公司", "有限公司", "分公司", "子公司", "营业部", "支行", "分行", "中心"]


def normal_owner(c: Column) -> Column:
    """A name of an organisation without brackets, punctuation, corporate tokens and a region word at its end; '' for NULL."""
    s = F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), "[（(].*?[）)]", "")
    s = F.regexp_replace(s, "[\\s,，。、“”\"'`·\\-_/\\\\]+", "")
    for t in ORG_TOKENS:
        s = F.replace(s, F.lit(t), F.lit(""))
    return F.regexp_replace(s, "(省|市|自治区|特别行政区)$", "")


def card_amount(budget: Column, amount: Column) -> Column:
    """The first entry of what a card shows of the two amounts, '-' without any."""
    both = F.concat_ws(" / ", F.nullif(budget, F.lit("")), F.nullif(amount, F.lit("")))
    return F.coalesce(F.nullif(F.trim(F.split_part(F.split_part(both, F.lit("|"), F.lit(1)), F.lit("/"), F.lit(1))), F.lit("")), F.lit("-"))


def more_tag(c: Column) -> Column:
    """struct(first, more): the first of several candidates and how many more there are."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\\|"), lambda v: F.trim(v)), lambda x: x != "")
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.greatest(F.size(parts) - 1, F.lit(0)).alias("more"))


def fit(c: Column, n: int) -> Column:
    """Stripped and cut to n characters; '' as NULL."""
    return F.nullif(F.substring(py_strip(c), 1, n), F.lit(""))


def join_ocr_lines(c: Column) -> Column:
    """Line ends between Chinese characters dropped, but before a rule of equal signs."""
    return F.regexp_replace(c, "(?<=[\\u4e00-\\u9fff，。、；：）》】”’])\\n(?=[\\u4e00-\\u9fff（《【“‘(])", "")


def undo_mojibake(c: Column) -> Column:
    """The first of three re-decodings that yields Chinese, else the text."""

    def one(x):
        if x is None:
            return None
        for enc, real in (("gbk", "utf-8"), ("utf-8", "gbk"), ("latin-1", "utf-8")):
            try:
                y = x.encode(enc).decode(real)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if any("一" <= ch <= "鿿" for ch in y):
                return y
        return x

    @F.pandas_udf("string")
    def undo(s: pd.Series) -> pd.Series:
        return s.map(one)

    return undo(c)


def chunks(c: Column, limit: int = 2048, most: int = 20) -> Column:
    """array<string>: pieces of at most `limit` UTF-8 bytes, cut between characters, at most `most`; the last one then ends in …"""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out, cur, size = [], [], 0
            for ch in x:
                n = len(ch.encode("utf-8", "surrogatepass"))
                if size + n > limit and cur:
                    out.append("".join(cur))
                    cur, size = [], 0
                cur.append(ch)
                size += n
            if cur:
                out.append("".join(cur))
            if len(out) > most:
                last = out[most - 1].encode("utf-8")[: limit - 3].decode("utf-8", "ignore")
                out = [*out[: most - 1], last + "…"]
            return out

        return s.map(one)

    return cut(c)
