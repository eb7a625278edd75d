"""Queries over announcements, leads, dispatches and reads, with the SQL each is compared with."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gazette.functions import rules, text
from gazette.operators import digest, ingest, listing, reads, routing
from gazette.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def infos(spark, sf, *cols):
    return table(spark, sf, "scraping_infos", list(cols) or None)


def q(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def has_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


APPROVED = "coalesce(nullif(trim(audit_status), ''), '审核通过') = '审核通过'"
TENDERS, AWARDS = q(rules.TENDER_GROUP), q(rules.AWARD_GROUP)
FLT = listing.ListFilter(keyword="银行", created=(date(2025, 3, 1), date(2025, 12, 31)))
_LIKE = "(" + " OR ".join(f"coalesce({c} LIKE '%银行%', false)" for c in listing.SEARCHED) + ")"
_WHERE = f"{APPROVED} AND {_LIKE} AND CAST(created_at AS DATE) BETWEEN DATE '2025-03-01' AND DATE '2025-12-31'"
BOTH_GROUPS = listing.ListFilter(sub_type="招标公告", product="软件", published=(date(2025, 1, 1), None))

# ---------------------------------------------------------------- lists


@query("list_page", f"SELECT {', '.join(listing.LIST_COLUMNS)}, reserve2 AS product_related_terms FROM scraping_infos WHERE {_WHERE} ORDER BY id DESC LIMIT 50 OFFSET 50")
def list_page(spark, sf):
    return listing.page(infos(spark, sf), FLT, number=2)


@query("list_total", f"SELECT count(*) AS total FROM scraping_infos WHERE {_WHERE}")
def list_total(spark, sf):
    return listing.total(infos(spark, sf), FLT)


@query(
    "list_facets",
    f"""SELECT k.*, p.* FROM (SELECT count_if(trim(sub_type) IN {TENDERS}) AS tenders, count_if(trim(sub_type) IN {AWARDS}) AS awards, count(*) AS all_kinds
  FROM scraping_infos WHERE {APPROVED} AND CAST(published_at AS DATE) >= DATE '2025-01-01') k,
 (SELECT count_if(contains(product_related, '软件')) AS software, count_if(contains(product_related, '硬件')) AS hardware FROM scraping_infos WHERE {APPROVED} AND trim(sub_type) IN {TENDERS}) p""",
)
def list_facets(spark, sf):
    return listing.facets(infos(spark, sf), BOTH_GROUPS)


@query("list_group_filter", f"SELECT id, sub_type FROM scraping_infos WHERE {APPROVED} AND trim(sub_type) IN {TENDERS} AND product_related LIKE '%软件%' AND CAST(published_at AS DATE) >= DATE '2025-01-01'")
def list_group_filter(spark, sf):
    return infos(spark, sf).filter(BOTH_GROUPS.column()).select("id", "sub_type")


@query("list_pending", "SELECT id, title, detail_url FROM scraping_infos WHERE trim(audit_status) = '待审核' AND trim(coalesce(detail_url, '')) <> ''")
def list_pending(spark, sf):
    return infos(spark, sf).filter(listing.ListFilter(audit="pending").column() & listing.not_blank("detail_url")).select("id", "title", "detail_url")


@query("list_options", "SELECT DISTINCT trim(sub_type) AS sub_type FROM scraping_infos WHERE trim(coalesce(sub_type, '')) <> ''")
def list_options(spark, sf):
    return listing.options(infos(spark, sf), "sub_type")


@query("list_distribution", "SELECT coalesce(nullif(trim(sub_type), ''), '(空)') AS sub_type, count(*) AS cnt FROM scraping_infos GROUP BY 1")
def list_distribution(spark, sf):
    return listing.distribution(infos(spark, sf), "sub_type")


@query("list_priority", "SELECT id, title, CASE WHEN coalesce(contains(title, '监管报送'), false) THEN 0 ELSE 1 END AS front FROM scraping_infos ORDER BY front, id DESC LIMIT 100")
def list_priority(spark, sf):
    return listing.prioritised(infos(spark, sf), "监管报送", 100)


@query("list_newest_crawl", "SELECT id, reserve1 FROM scraping_infos ORDER BY nullif(trim(reserve1), '') DESC NULLS FIRST, id LIMIT 200")
def list_newest_crawl(spark, sf):
    """Newest crawl first, rows without a crawl time in front."""
    return infos(spark, sf, "id", "reserve1").orderBy(F.nullif(F.trim("reserve1"), F.lit("")).desc_nulls_first(), "id").limit(200)


@query("list_dates_as_text", "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, coalesce(strftime(published_at, '%m/%d'), '-') AS month_day FROM scraping_infos")
def list_dates_as_text(spark, sf):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return infos(spark, sf).select("id", F.date_format("created_at", fmt).alias("created"), F.date_format("published_at", fmt).alias("published"), text.month_day(F.col("published_at")).alias("month_day"))


@query("list_defaults", "SELECT id, coalesce(nullif(trim(keyword), ''), '银行') AS keyword, coalesce(nullif(trim(sub_type), ''), '采招信息') AS sub_type FROM scraping_infos")
def list_defaults(spark, sf):
    return infos(spark, sf).select("id", rules.default_to(F.col("keyword"), "银行").alias("keyword"), rules.default_to(F.col("sub_type"), "采招信息").alias("sub_type"))


# ---------------------------------------------------------------- digests


@query("digest_latest_day", f"SELECT CAST(max(d) AS VARCHAR) AS day FROM (SELECT CAST(created_at AS DATE) AS d FROM scraping_infos WHERE {APPROVED} UNION ALL SELECT CAST(updated_at AS DATE) FROM scraping_infos WHERE {APPROVED})")
def digest_latest_day(spark, sf):
    return digest.latest_day(infos(spark, sf, "audit_status", "created_at", "updated_at")).select(F.col("day").cast("string").alias("day"))


_DAYS = f"SELECT DISTINCT id, sub_type, day FROM (SELECT id, sub_type, CAST(c - INTERVAL (k) DAY AS DATE) AS day FROM (SELECT id, sub_type, unnest([CAST(created_at AS DATE), CAST(updated_at AS DATE)]) AS c FROM scraping_infos WHERE {APPROVED}), (SELECT unnest([0, 1]) AS k) WHERE c IS NOT NULL)"


@query("digest_counts_by_day", f"SELECT CAST(day AS VARCHAR) AS day, count_if(trim(sub_type) IN {TENDERS}) AS tenders, count_if(trim(sub_type) IN {AWARDS}) AS awards, count(*) AS n FROM ({_DAYS}) GROUP BY day")
def digest_counts_by_day(spark, sf):
    return digest.counts_by_day(infos(spark, sf, "id", "sub_type", "audit_status", "created_at", "updated_at")).withColumn("day", F.col("day").cast("string"))


@query("digest_days", f"SELECT id, CAST(day AS VARCHAR) AS day FROM ({_DAYS})")
def digest_days(spark, sf):
    return digest.days_of(infos(spark, sf, "id", "sub_type", "audit_status", "created_at", "updated_at")).select("id", F.col("day").cast("string").alias("day"))


_WIN = "(coalesce(CAST(created_at AS DATE) BETWEEN DATE '2025-06-10' AND DATE '2025-06-11', false) OR coalesce(CAST(updated_at AS DATE) BETWEEN DATE '2025-06-10' AND DATE '2025-06-11', false))"


@query("digest_snapshot", f"SELECT id, title, sub_type, project_owner, winning_bidder, created_at, updated_at FROM scraping_infos WHERE {APPROVED} AND {_WIN} ORDER BY id DESC LIMIT 8000")
def digest_snapshot(spark, sf):
    return digest.snapshot(infos(spark, sf), F.lit(date(2025, 6, 10)))


@query("digest_two_labels", f"SELECT sub_type, count(*) AS n FROM scraping_infos WHERE {APPROVED} AND {_WIN} AND sub_type IN ('招标公告', '中标结果公告') GROUP BY sub_type")
def digest_two_labels(spark, sf):
    return infos(spark, sf).filter(listing.approved() & digest.in_window(F.lit(date(2025, 6, 10))) & F.col("sub_type").isin("招标公告", "中标结果公告")).groupBy("sub_type").agg(F.count("*").alias("n"))


@query("digest_search", f"SELECT id FROM scraping_infos WHERE {APPROVED} AND contains(lower(concat_ws(chr(1), coalesce(title, ''), coalesce(project_owner, ''), coalesce(winning_bidder, ''))), '银行') AND contains(lower(concat_ws(chr(1), coalesce(title, ''), coalesce(project_owner, ''), coalesce(winning_bidder, ''))), 'api')")
def digest_search(spark, sf):
    return digest.search(infos(spark, sf).filter(listing.approved()), ["@银行", "API"], ["title", "project_owner", "winning_bidder"]).select("id")


@query(
    "digest_rank",
    f"SELECT d.id, CAST(d.day AS VARCHAR) AS token, row_number() OVER (PARTITION BY d.day ORDER BY CASE WHEN contains(coalesce(s.project_owner, ''), '银行') THEN 1 ELSE 0 END DESC, length(coalesce(s.title, '')) - length(replace(coalesce(s.title, ''), '系统', '')) DESC, d.id DESC) AS rank FROM ({_DAYS}) d JOIN scraping_infos s USING (id)",
)
def digest_rank(spark, sf):
    a = infos(spark, sf, "id", "sub_type", "audit_status", "created_at", "updated_at", "title", "project_owner")
    d = digest.days_of(a).select("id", F.col("day").cast("string").alias("token")).join(a.select("id", "title", "project_owner"), "id")
    t = F.coalesce("title", F.lit(""))
    return digest.display_rank(d, F.when(F.contains(F.coalesce("project_owner", F.lit("")), F.lit("银行")), 1).otherwise(0), F.char_length(t) - F.char_length(F.replace(t, F.lit("系统"), F.lit("")))).select("id", "token", "rank")


# ---------------------------------------------------------------- classification and extraction


def case_chain(col: str, rows, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '{k}') THEN '{v}'" for k, v in rows) + f" ELSE '{default}' END"


@query("class_kind", f"SELECT id, CASE WHEN coalesce(title, '') = '' THEN '' ELSE {case_chain('title', rules.KIND_BY_TITLE, '其他')} END AS kind FROM scraping_infos")
def class_kind(spark, sf):
    return infos(spark, sf, "id", "title").select("id", rules.kind_of_title(F.col("title")).alias("kind"))


_CLEAN = "(CASE WHEN trim(regexp_replace(title, '^\\[[^\\[\\]]{1,20}\\]', '')) = '' THEN trim(title) ELSE trim(regexp_replace(title, '^\\[[^\\[\\]]{1,20}\\]', '')) END)"


@query("class_label", f"SELECT id, {_CLEAN} AS clean, {case_chain(_CLEAN, rules.LABEL_BY_TITLE, '采招信息')} AS label FROM scraping_infos")
def class_label(spark, sf):
    return infos(spark, sf, "id", "title").select("id", rules.label_of_title(F.col("title")).alias("x")).select("id", "x.clean", "x.label")


@query("class_normal_type", f"SELECT id, CASE WHEN type IN {q(rules.TENDER_LABELS)} THEN '招标公告' ELSE type END AS type, CASE WHEN trim(sub_type) IN {TENDERS} THEN '招标公告' WHEN trim(sub_type) IN {AWARDS} THEN '中标结果' END AS type_group FROM scraping_infos")
def class_normal_type(spark, sf):
    return infos(spark, sf, "id", "type", "sub_type").select("id", rules.normal_kind(F.col("type")).alias("type"), rules.type_group(F.col("sub_type")).alias("type_group"))


_T = "coalesce(trim(title), '')"
_MAINT = "(" + " OR ".join(f"(strpos({_T}, '{w}') > 0 AND strpos({_T}, '{w}') < strpos({_T}, '维保'))" for w in rules.MAINTAINED) + ")"


@query(
    "class_product",
    f"SELECT id, CASE WHEN {has_any(_T, rules.HARDWARE_FIRST)} THEN '硬件相关' WHEN strpos({_T}, '维保') > 0 AND {_MAINT} THEN '软件相关' WHEN {has_any(_T, rules.SOFTWARE_WORDS)} THEN '软件相关' WHEN {has_any(_T, rules.HARDWARE_WORDS)} THEN '硬件相关' WHEN {has_any('detail', rules.SOFTWARE_WORDS)} THEN '软件相关' WHEN {has_any('detail', rules.HARDWARE_WORDS)} THEN '硬件相关' ELSE '' END AS product FROM scraping_infos",
)
def class_product(spark, sf):
    return infos(spark, sf, "id", "title", "detail").select("id", rules.product_class(F.col("title"), F.col("detail")).alias("product"))


_OWN = "regexp_extract(coalesce(detail, ''), '" + rules.OWNER_PATTERN.replace("\\\\", "\\") + "', 1)"


@query("class_financial_owner", f"SELECT id, CASE WHEN {_OWN} <> '' THEN {has_any(_OWN, rules.FINANCIAL_WORDS)} ELSE coalesce({has_any('title', rules.FINANCIAL_WORDS)}, false) END AS financial FROM scraping_infos")
def class_financial_owner(spark, sf):
    return infos(spark, sf, "id", "title", "detail").select("id", rules.financial_owner(F.col("detail"), F.col("title")).alias("financial"))


def _first_sql(ps) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(detail, '{p}', 1)), '')" for p in ps) + ")"


_FIELDS = ["project_no", "project_budget", "winning_bidder", "bidding_agent", "owner_contact", "owner_phone"]


@query("extract_fields", "SELECT id, " + ", ".join(f"{_first_sql(rules.FIELDS[f])} AS {f}" for f in _FIELDS) + ", CASE " + " ".join(f"WHEN contains(detail, '{m}') THEN '{m}'" for m in rules.METHODS) + " END AS bidding_method FROM scraping_infos")
def extract_fields(spark, sf):
    f = rules.labelled_fields(F.col("detail"))
    return infos(spark, sf, "id", "detail").select("id", *[f[k].alias(k) for k in [*_FIELDS, "bidding_method"]])


@query("extract_award_in_brackets", "SELECT id, nullif(regexp_extract(detail, '(?:中标金额|中标价|成交金额|成交价格)[：:][^（(\\n]*[（(]\\s*[￥¥]\\s*([\\d,]+\\.?\\d*)\\s*[）)]', 1), '') || '元' AS amount FROM scraping_infos")
def extract_award_in_brackets(spark, sf):
    m = F.regexp_extract("detail", "(?:中标金额|中标价|成交金额|成交价格)[：:][^（(\\n]*[（(]\\s*[￥¥]\\s*([\\d,]+\\.?\\d*)\\s*[）)]", 1)
    return infos(spark, sf, "id", "detail").select("id", F.concat(F.nullif(m, F.lit("")), F.lit("元")).alias("amount"))


@query("extract_method", "SELECT id, CASE WHEN coalesce(trim(bidding_method), '') IN ('', '其他', '其它') OR starts_with(trim(bidding_method), '资格预审') THEN '公开招标' WHEN starts_with(trim(bidding_method), '单一来源') THEN '单一来源' ELSE trim(bidding_method) END AS method FROM scraping_infos")
def extract_method(spark, sf):
    return infos(spark, sf, "id", "bidding_method").select("id", rules.normal_method(F.col("bidding_method")).alias("method"))


_C = "regexp_replace(coalesce(detail, ''), '\\s+', '', 'g')"
_HITS = " + ".join(f"CASE WHEN contains({_C}, '{h}') THEN 1 ELSE 0 END" for h in rules.SHELL_HITS)
_STARTS = "(" + " OR ".join(f"starts_with({_C}, '{s}')" for s in rules.SHELL_STARTS) + ")"


@query(
    "body_shells",
    f"""SELECT id, length(regexp_replace(coalesce(detail, ''), '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g')) < 80 AS short,
 length({_C}) > 0 AND length({_C}) <= 900 AND NOT (length({_C}) >= 120 AND {has_any(_C, rules.AWARD_MARKS)}) AND {has_any(_C, rules.PLATFORM)} AND ({has_any(_C, rules.JUMP)} OR {has_any(_C, rules.SOURCE)}) AS pointer,
 {_STARTS} AND ({_HITS}) >= 1 AND (length({_C}) <= 200 OR (length({_C}) <= 400 AND contains({_C}, '招标进展') AND ({_HITS}) >= 2)) AS shell FROM scraping_infos""",
)
def body_shells(spark, sf):
    d = F.col("detail")
    return infos(spark, sf, "id", "detail").select("id", rules.short_body(d).alias("short"), rules.pointer_body(d).alias("pointer"), rules.shell_body(d).alias("shell"))


# ---------------------------------------------------------------- text functions


@query("text_crawl_time", "SELECT id, CASE WHEN regexp_matches(trim(reserve1), '^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}') THEN regexp_extract(trim(reserve1), '^(\\d{4})', 1) || '-' || lpad(regexp_extract(trim(reserve1), '^\\d{4}[-/](\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(trim(reserve1), '^\\d{4}[-/]\\d{1,2}[-/](\\d{1,2})', 1), 2, '0') END AS crawl_date FROM scraping_infos")
def text_crawl_time(spark, sf):
    return infos(spark, sf, "id", "reserve1").select("id", text.date_text(F.col("reserve1")).alias("crawl_date"))


def _norm_sql(c: str) -> str:
    s = f"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g'), '[（(].*?[）)]', '', 'g')"
    s = f"regexp_replace({s}, '[\\s,，。、“”\"''`·\\-_/\\\\]+', '', 'g')"
    for t in text.ORG_TOKENS:
        s = f"replace({s}, '{t}', '')"
    return f"regexp_replace({s}, '(省|市|自治区|特别行政区)$', '')"


@query("text_normal_owner", f"SELECT DISTINCT project_owner, {_norm_sql('project_owner')} AS norm FROM scraping_infos")
def text_normal_owner(spark, sf):
    return infos(spark, sf, "project_owner").distinct().select("project_owner", text.normal_owner(F.col("project_owner")).alias("norm"))


@query("text_card", "SELECT id, coalesce(nullif(trim(split_part(split_part(concat_ws(' / ', nullif(project_budget, ''), nullif(winning_amount, '')), '|', 1), '/', 1)), ''), '-') AS amount, list_filter(list_transform(string_split(coalesce(winning_bidder, ''), '|'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_bidder, greatest(len(list_filter(list_transform(string_split(coalesce(winning_bidder, ''), '|'), lambda x: trim(x)), lambda x: x <> '')) - 1, 0) AS more FROM scraping_infos")
def text_card(spark, sf):
    m = text.more_tag(F.col("winning_bidder"))
    return infos(spark, sf, "id", "project_budget", "winning_amount", "winning_bidder").select("id", text.card_amount(F.col("project_budget"), F.col("winning_amount")).alias("amount"), m["first"].alias("first_bidder"), m["more"].alias("more"))


@query("text_sales_names", "SELECT id, array_to_string(list_filter(regexp_split_to_array(coalesce(sales, ''), '[|,，;；/\\s]+'), lambda x: x <> ''), ',') AS names FROM sales_lead_confirm")
def text_sales_names(spark, sf):
    d = table(spark, sf, "sales_lead_confirm", ["id", "sales"])
    parts = F.filter(F.split(F.coalesce("sales", F.lit("")), "[|,，;；/\\s]+"), lambda x: x != "")
    return d.select("id", F.array_join(parts, ",").alias("names"))


@query("text_blocks", "SELECT id, len(list_filter(list_transform(string_split(coalesce(detail, ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n_blocks FROM scraping_infos")
def text_blocks(spark, sf):
    b = F.filter(F.transform(F.split(F.coalesce("detail", F.lit("")), "\n\n"), lambda v: F.trim(v)), lambda x: x != "")
    return infos(spark, sf, "id", "detail").select("id", F.size(b).alias("n_blocks"))


@query("text_squeeze", "SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, regexp_matches(coalesce(title, ''), '[一-鿿]') AS han FROM scraping_infos")
def text_squeeze(spark, sf):
    return infos(spark, sf, "id", "title").select("id", text.squeeze(F.col("title")).alias("title"), text.has_han(F.coalesce("title", F.lit(""))).alias("han"))


@query("text_fitted", "SELECT id, nullif(substr(regexp_replace(title, '^[\\s\\x{3000}\\x{a0}]+|[\\s\\x{3000}\\x{a0}]+$', '', 'g'), 1, 20), '') AS title, nullif(substr(regexp_replace(detail, '^[\\s\\x{3000}\\x{a0}]+|[\\s\\x{3000}\\x{a0}]+$', '', 'g'), 1, 200), '') AS detail FROM scraping_infos")
def text_fitted(spark, sf):
    return infos(spark, sf, "id", "title", "detail").select("id", text.fit(F.col("title"), 20).alias("title"), text.fit(F.col("detail"), 200).alias("detail"))


@query("text_published_check", "SELECT id, CASE WHEN CAST(published_at AS DATE) > CAST(created_at AS DATE) - 180 AND NOT regexp_matches(coalesce(detail, ''), '\\d' || strftime(published_at, '%Y%m%d') || '\\d') THEN strftime(published_at, '%Y-%m-%d') END AS published FROM scraping_infos WHERE created_at IS NOT NULL")
def text_published_check(spark, sf):
    d = infos(spark, sf, "id", "published_at", "created_at", "detail").filter("created_at is not null")
    return d.select("id", text.published_date(F.date_format("published_at", "yyyy-MM-dd"), F.col("detail"), F.to_date("created_at")).alias("published"))


@query("text_table_rows", None)
def text_table_rows(spark, sf):
    return ingest.table_rows(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")


SQL["text_table_rows"] = r"""
WITH l AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
c AS (SELECT doc_id, pos, len(list_filter(string_split(line, chr(9)), lambda y: trim(y) <> '')) AS cells FROM x),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM c WHERE cells >= 2)
SELECT doc_id AS id, min(pos) AS first_line, count(*) AS n_rows, CAST(sum(cells) AS BIGINT) AS n_cells FROM g GROUP BY doc_id, block"""


@query("text_zip", None)
def text_zip(spark, sf):
    return ingest.zipped(infos(spark, sf, "id", "winning_bidder", "winning_amount"), "id", "winning_bidder", "winning_amount")


SQL["text_zip"] = """
WITH s AS (SELECT id, list_transform(string_split(winning_bidder, '|'), lambda x: trim(x)) AS a, list_transform(string_split(coalesce(winning_amount, ''), '|'), lambda x: trim(x)) AS b
  FROM scraping_infos WHERE trim(coalesce(winning_bidder, '')) <> ''), n AS (SELECT *, unnest(generate_series(1, greatest(len(a), len(b)))) AS pos FROM s)
SELECT id, CAST(pos AS INTEGER) AS pos, coalesce(nullif(a[pos], ''), '—') AS left_value, coalesce(nullif(b[pos], ''), '—') AS right_value FROM n"""

# ---------------------------------------------------------------- routing

_LEADS = "(SELECT *, coalesce(updated_at, created_at, TIMESTAMP '0001-01-01') AS ts FROM sales_lead_confirm WHERE trim(coalesce(customer_name, '')) <> '')"


@query(
    "route_latest_sales",
    f"SELECT trim(customer_name) AS customer_name, arg_max(id, (ts, id)) AS lead_row_id, arg_max(trim(sales), (ts, id)) FILTER (WHERE trim(coalesce(sales, '')) <> '') AS sales, arg_max(id, (ts, id)) FILTER (WHERE trim(coalesce(sales, '')) <> '') AS sales_from_row_id FROM {_LEADS} GROUP BY 1",
)
def route_latest_sales(spark, sf):
    return routing.latest_sales(table(spark, sf, "sales_lead_confirm"))


@query("route_accounts", "SELECT trim(user_name) AS user_name, min(trim(user_account)) AS user_account FROM org_user WHERE coalesce(is_deleted, 0) = 0 AND trim(coalesce(user_name, '')) <> '' AND trim(coalesce(user_account, '')) <> '' GROUP BY 1")
def route_accounts(spark, sf):
    return routing.names_to_accounts(table(spark, sf, "org_user"))


_ENABLED = "SELECT id, trim(customer_name) AS customer, sales, customer_name FROM sales_lead_confirm WHERE coalesce(enabled, 1) = 1 AND trim(coalesce(customer_name, '')) <> '' AND trim(coalesce(sales, '')) <> ''"
_RESOLVED = f"""WITH o AS (SELECT DISTINCT trim(project_owner) AS owner FROM scraping_infos WHERE trim(coalesce(project_owner, '')) <> ''), l AS ({_ENABLED}),
 e AS (SELECT customer AS key, min(id) AS id FROM l GROUP BY 1), m AS (SELECT {_norm_sql('customer_name')} AS key, min(id) AS id FROM l GROUP BY 1),
 r AS (SELECT o.owner, coalesce(e.id, m.id) AS lead_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'normal' ELSE 'none' END AS how
  FROM o LEFT JOIN e ON o.owner = e.key LEFT JOIN m ON {_norm_sql('o.owner')} = m.key AND m.key <> ''),
 resolved AS (SELECT r.owner, r.lead_id, l.customer, l.sales, r.how FROM r LEFT JOIN l ON l.id = r.lead_id)"""


def _resolved(spark, sf):
    return routing.resolve(infos(spark, sf, "project_owner"), table(spark, sf, "sales_lead_confirm"))


@query("route_resolve", f"{_RESOLVED} SELECT * FROM resolved")
def route_resolve(spark, sf):
    return _resolved(spark, sf)


_ROUTES = f"""{_RESOLVED}, acc AS (SELECT trim(user_name) AS user_name, min(trim(user_account)) AS user_account FROM org_user WHERE coalesce(is_deleted, 0) = 0 AND trim(coalesce(user_name, '')) <> '' AND trim(coalesce(user_account, '')) <> '' GROUP BY 1),
 n AS (SELECT DISTINCT owner, customer, unnest(list_filter(regexp_split_to_array(sales, '[|,，;；/\\s]+'), lambda x: x <> '')) AS user_name FROM resolved WHERE sales IS NOT NULL),
 routes AS (SELECT s.id AS record_id, n.owner, acc.user_account, n.user_name, n.customer FROM scraping_infos s JOIN n ON trim(s.project_owner) = n.owner JOIN acc USING (user_name))"""


@query("route_items", f"{_ROUTES} SELECT * FROM routes")
def route_items(spark, sf):
    return routing.user_routes(infos(spark, sf, "id", "project_owner"), _resolved(spark, sf), table(spark, sf, "org_user"))


@query("route_per_user", f"{_ROUTES} SELECT user_account, count(*) AS item_count, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners, string_agg(DISTINCT user_name, ',' ORDER BY user_name) AS names FROM routes GROUP BY 1")
def route_per_user(spark, sf):
    return routing.per_user(route_items(spark, sf))


@query("route_match_rate", f"{_RESOLVED} SELECT count(*) AS total, count_if(trim(coalesce(s.project_owner, '')) <> '') AS with_owner, count(r.customer) AS matched, count(DISTINCT r.customer) AS customers, printf('%.2f%%', 100.0 * count(r.customer) / count_if(trim(coalesce(s.project_owner, '')) <> '')) AS rate FROM scraping_infos s LEFT JOIN resolved r ON trim(s.project_owner) = r.owner AND r.how <> 'none'")
def route_match_rate(spark, sf):
    return routing.match_rate(infos(spark, sf, "project_owner"), _resolved(spark, sf))


_A = f"(SELECT DISTINCT {_norm_sql('project_owner')} AS name FROM scraping_infos WHERE {_norm_sql('project_owner')} <> '')"
_B = f"(SELECT DISTINCT {_norm_sql('customer_name')} AS name FROM sales_lead_confirm WHERE {_norm_sql('customer_name')} <> '')"


@query("route_overlap", f"SELECT name, 'both' AS side FROM ({_A} INTERSECT {_B}) UNION ALL SELECT name, 'owners' FROM ({_A} EXCEPT {_B}) UNION ALL SELECT name, 'customers' FROM ({_B} EXCEPT {_A})")
def route_overlap(spark, sf):
    return routing.overlap(infos(spark, sf, "project_owner"), table(spark, sf, "sales_lead_confirm"))


_FUZZY = f"""WITH a AS (SELECT DISTINCT trim(project_owner) AS owner, {_norm_sql('project_owner')} AS n FROM scraping_infos), b AS (SELECT DISTINCT trim(canonical_customer) AS customer, {_norm_sql('canonical_customer')} AS n FROM customer_alias_map)
SELECT DISTINCT a.owner, b.customer FROM a JOIN b ON length(a.n) >= 4 AND length(b.n) >= 4 AND (contains(a.n, b.n) OR contains(b.n, a.n))"""


def _fuzzy(spark, sf):
    return routing.fuzzy(infos(spark, sf, "project_owner"), table(spark, sf, "customer_alias_map").select(F.col("canonical_customer").alias("customer_name")))


@query("route_fuzzy", _FUZZY)
def route_fuzzy(spark, sf):
    return _fuzzy(spark, sf)


@query("route_longest", f"SELECT owner, customer FROM (SELECT owner, customer, row_number() OVER (PARTITION BY owner ORDER BY length(customer) DESC, customer) AS rn FROM ({_FUZZY})) WHERE rn = 1")
def route_longest(spark, sf):
    return routing.longest(_fuzzy(spark, sf))


@query(
    "route_shortlist",
    """WITH a AS (SELECT DISTINCT trim(customer_name) AS name FROM sales_lead_confirm WHERE trim(coalesce(customer_name, '')) <> ''), b AS (SELECT DISTINCT canonical_customer AS candidate FROM customer_alias_map),
 ac AS (SELECT DISTINCT name, unnest(string_split(name, '')) AS ch FROM a), bc AS (SELECT DISTINCT candidate, unnest(string_split(candidate, '')) AS ch FROM b),
 n AS (SELECT name, candidate, count(*) AS shared FROM ac JOIN bc USING (ch) WHERE ch <> '' GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT name, candidate, shared FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared DESC, candidate) AS rn FROM n) WHERE rn <= 5""",
)
def route_shortlist(spark, sf):
    names = table(spark, sf, "sales_lead_confirm").filter(listing.not_blank("customer_name")).select(F.trim("customer_name").alias("name")).distinct()
    pool = table(spark, sf, "customer_alias_map").select(F.col("canonical_customer").alias("candidate")).distinct()
    return routing.shortlist(names, pool, 5)


@query("route_aliases", "SELECT canonical_customer, string_agg(DISTINCT alias_pattern, ',' ORDER BY alias_pattern) AS patterns FROM customer_alias_map WHERE coalesce(enabled, 1) = 1 GROUP BY 1")
def route_aliases(spark, sf):
    return table(spark, sf, "customer_alias_map").filter(listing.enabled("enabled")).groupBy("canonical_customer").agg(F.array_join(F.sort_array(F.collect_set("alias_pattern")), ",").alias("patterns"))


# ---------------------------------------------------------------- dispatches and reads

_DW = "least(greatest(coalesce(dwell_seconds, 0), 0), 86400)"
_SENT = "SELECT r.*, lower(trim(d.digest_token)) AS token, d.receiver_userid FROM item_read_log r JOIN dispatch_log d ON r.dispatch_id = d.dispatch_id AND d.send_status = 'SENT'"
_STATE = f"SELECT token, record_id, reader_userid, max(read_at) AS read_at, max({_DW}) AS dwell FROM ({_SENT}) WHERE reader_userid IS NOT NULL AND record_id IS NOT NULL AND token IS NOT NULL GROUP BY 1, 2, 3"


def _log(spark, sf):
    return table(spark, sf, "item_read_log"), table(spark, sf, "dispatch_log")


def _sent(spark, sf):
    return reads.sent_reads(*_log(spark, sf))


@query("read_sent", f"SELECT id, token, record_id, reader_userid FROM ({_SENT})")
def read_sent(spark, sf):
    return _sent(spark, sf).select("id", "token", "record_id", "reader_userid")


@query("read_state", _STATE)
def read_state(spark, sf):
    return reads.read_state(_sent(spark, sf), "token", "record_id", "reader_userid")


@query("read_state_by_record", f"SELECT record_id, reader_userid, max(read_at) AS read_at, max({_DW}) AS dwell FROM item_read_log WHERE reader_userid IS NOT NULL AND record_id IS NOT NULL GROUP BY 1, 2")
def read_state_by_record(spark, sf):
    return reads.read_state(table(spark, sf, "item_read_log"), "record_id", "reader_userid")


@query("read_best", f"SELECT record_id, reader_userid, arg_max(id, ({_DW}, -id)) AS id, arg_max(read_at, ({_DW}, -id)) AS read_at, max({_DW}) AS dwell FROM item_read_log GROUP BY 1, 2")
def read_best(spark, sf):
    return reads.best_read(table(spark, sf, "item_read_log"), "record_id", "reader_userid")


_ROSTER = f"SELECT DISTINCT s.token, s.record_id, u.user_account AS reader_userid FROM ({_SENT}) s JOIN (SELECT DISTINCT trim(user_account) AS user_account FROM org_user WHERE coalesce(is_deleted, 0) = 0 AND trim(coalesce(user_account, '')) <> '') u ON true"


def _roster(spark, sf):
    """Receivers of a dispatch by the records read under its token: who should have read what."""
    r = _sent(spark, sf)
    return r.select("token", "record_id").distinct().join(r.select("token", F.col("receiver_userid").alias("reader_userid")).distinct(), "token")


_ROSTER = f"SELECT DISTINCT a.token, a.record_id, b.receiver_userid AS reader_userid FROM ({_SENT}) a JOIN ({_SENT}) b USING (token)"
_SEEN = f"SELECT r.token, r.record_id, r.reader_userid, s.read_at FROM ({_ROSTER}) r LEFT JOIN ({_STATE}) s ON r.token = s.token AND r.record_id = s.record_id AND r.reader_userid = s.reader_userid"
_PCT = "count(*) AS total, count(read_at) AS seen, count(*) - count(read_at) AS unseen, CASE WHEN count(*) > 0 THEN round(count(read_at) * 1000 / count(*)) / 10 ELSE 0.0 END AS pct"


@query("read_roster", _SEEN)
def read_roster(spark, sf):
    k = ["token", "record_id", "reader_userid"]
    return _roster(spark, sf).join(reads.read_state(_sent(spark, sf), *k).select(*k, "read_at"), k, "left")


@query("read_funnel", f"SELECT {_PCT} FROM ({_SEEN})")
def read_funnel(spark, sf):
    return reads.funnel(_roster(spark, sf), reads.read_state(_sent(spark, sf), "token", "record_id", "reader_userid"))


@query("read_funnel_by_reader", f"SELECT reader_userid, {_PCT} FROM ({_SEEN}) GROUP BY reader_userid ORDER BY unseen DESC, total DESC, reader_userid LIMIT 80")
def read_funnel_by_reader(spark, sf):
    f = reads.funnel(_roster(spark, sf), reads.read_state(_sent(spark, sf), "token", "record_id", "reader_userid"), "reader_userid")
    return f.orderBy(F.desc("unseen"), F.desc("total"), "reader_userid").limit(80)


@query("read_tokens", f"SELECT record_id, reader_userid, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens, max(read_at) AS read_at, max({_DW}) AS dwell FROM ({_SENT}) WHERE reader_userid IS NOT NULL GROUP BY 1, 2 HAVING max(read_at) IS NOT NULL")
def read_tokens(spark, sf):
    return reads.tokens_per_read(_sent(spark, sf))


@query("read_group_count", f"SELECT count(*) AS n FROM (SELECT record_id, reader_userid FROM ({_SENT}) WHERE reader_userid IS NOT NULL GROUP BY 1, 2 HAVING max(read_at) IS NOT NULL)")
def read_group_count(spark, sf):
    return reads.tokens_per_read(_sent(spark, sf)).agg(F.count("*").alias("n"))


@query(
    "read_outside",
    f"""{_ROUTES}, tr AS (SELECT DISTINCT d.token, r.record_id, r.user_account FROM routes r JOIN (SELECT DISTINCT lower(trim(digest_token)) AS token, receiver_userid FROM dispatch_log) d ON d.receiver_userid = r.user_account),
 lg AS (SELECT r.id, r.record_id, r.reader_userid, coalesce(lower(trim(d.digest_token)), '') AS token FROM item_read_log r LEFT JOIN dispatch_log d USING (dispatch_id))
 SELECT id, record_id, reader_userid, token FROM lg WHERE token = '' OR NOT EXISTS (SELECT 1 FROM tr WHERE tr.token = lg.token AND tr.record_id = lg.record_id AND tr.user_account = lg.reader_userid)""",
)
def read_outside(spark, sf):
    log, dispatch = _log(spark, sf)
    routes = route_items(spark, sf).select("record_id", F.col("user_account").alias("user"))
    return reads.outside(log, dispatch, routes).select("id", "record_id", "reader_userid", "token")


@query("read_top", "SELECT reader_userid, count(*) AS n_reads, count(DISTINCT record_id) AS n_records FROM item_read_log WHERE reader_userid IS NOT NULL GROUP BY 1 ORDER BY n_reads DESC, reader_userid LIMIT 40")
def read_top(spark, sf):
    return reads.top_readers(table(spark, sf, "item_read_log"), 40)


@query("read_totals", "SELECT count(*) AS n_reads, count(DISTINCT reader_userid) AS n_readers, count(DISTINCT dispatch_id) AS n_dispatches FROM item_read_log")
def read_totals(spark, sf):
    return table(spark, sf, "item_read_log").agg(F.count("*").alias("n_reads"), F.countDistinct("reader_userid").alias("n_readers"), F.countDistinct("dispatch_id").alias("n_dispatches"))


@query(
    "read_report",
    """WITH l AS (SELECT dispatch_id, record_id, row_number() OVER (PARTITION BY dispatch_id ORDER BY read_at DESC, record_id, id) AS rn FROM item_read_log),
 g AS (SELECT dispatch_id, count(*) AS n_reads, string_agg(CASE WHEN rn <= 40 THEN CAST(record_id AS VARCHAR) END, ',' ORDER BY rn) AS records FROM l GROUP BY 1)
 SELECT d.dispatch_id, send_status, receiver_userid, item_count, first_read_at IS NOT NULL AS opened, coalesce(n_reads, 0) AS n_reads, records FROM dispatch_log d LEFT JOIN g USING (dispatch_id)""",
)
def read_report(spark, sf):
    log, dispatch = _log(spark, sf)
    return reads.dispatch_report(dispatch, log)


@query(
    "read_item_readers",
    """WITH h AS (SELECT record_id FROM item_read_log WHERE record_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, record_id LIMIT 1),
 t AS (SELECT l.id, l.reader_userid, l.read_at FROM item_read_log l JOIN h USING (record_id) ORDER BY l.read_at DESC, l.id DESC LIMIT 200)
 SELECT id, t.reader_userid, read_at, CASE WHEN o.user_account IS NULL THEN 0 ELSE 1 END AS own FROM t LEFT JOIN (SELECT DISTINCT trim(user_account) AS user_account FROM org_user WHERE user_account IS NOT NULL) o ON o.user_account = t.reader_userid""",
)
def read_item_readers(spark, sf):
    log = table(spark, sf, "item_read_log")
    hot = log.filter("record_id is not null").groupBy("record_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "record_id").first()
    own = table(spark, sf, "org_user").filter("user_account is not null").select(F.trim("user_account").alias("user"))
    return reads.item_readers(log, hot["record_id"] if hot else -1, own)


@query(
    "read_titles",
    """WITH x AS (SELECT r.reader_userid, s.title, row_number() OVER (PARTITION BY r.reader_userid ORDER BY r.id) AS rn FROM item_read_log r LEFT JOIN scraping_infos s ON s.id = r.record_id WHERE r.reader_userid IS NOT NULL)
 SELECT reader_userid, count(*) AS n_all, string_agg(CASE WHEN rn <= 3 THEN coalesce(title, '') END, '|' ORDER BY rn) AS titles FROM x GROUP BY 1""",
)
def read_titles(spark, sf):
    log = table(spark, sf, "item_read_log").filter("reader_userid is not null").withColumnRenamed("id", "read_id")
    d = log.join(infos(spark, sf, "id", "title").withColumnRenamed("id", "record_id"), "record_id", "left")
    return reads.capped_titles(d, "reader_userid", "title", F.col("read_id"), 3)


@query("dispatch_duplicate_days", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT digest_token) AS tokens FROM dispatch_log GROUP BY 1 HAVING count(*) > 1")
def dispatch_duplicate_days(spark, sf):
    return table(spark, sf, "dispatch_log").groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("digest_token").alias("tokens")).filter("n > 1")


@query("dispatch_tokens", "SELECT lower(trim(digest_token)) AS token, sum(item_count)::BIGINT AS items, count_if(send_status = 'FAILED') AS failed, array_to_string(list_sort(list_distinct(flatten(list(list_filter(list_transform(string_split(coalesce(receiver_customer, ''), ','), lambda x: trim(x)), lambda x: x <> ''))))), ',') AS customers FROM dispatch_log WHERE regexp_matches(digest_token, '^[a-f0-9]{32}$') GROUP BY 1")
def dispatch_tokens(spark, sf):
    d = table(spark, sf, "dispatch_log").filter(F.col("digest_token").rlike("^[a-f0-9]{32}$"))
    c = F.filter(F.transform(F.split(F.coalesce("receiver_customer", F.lit("")), ","), lambda v: F.trim(v)), lambda x: x != "")
    return d.groupBy(F.lower(F.trim("digest_token")).alias("token")).agg(F.sum("item_count").alias("items"), F.count_if(F.col("send_status") == "FAILED").alias("failed"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias("customers"))


# ---------------------------------------------------------------- ingest

_FRESH = "CAST(created_at AS DATE) >= DATE '2025-10-01'"


def _batch(spark, sf):
    a = infos(spark, sf)
    fresh = F.to_date("created_at") >= F.lit(date(2025, 10, 1))
    return a.filter(fresh), a.filter(~fresh)


@query(
    "ingest_outcomes",
    f"""WITH k AS (SELECT detail_url, max(CASE WHEN {APPROVED} THEN 1 ELSE 0 END) AS done FROM scraping_infos WHERE NOT {_FRESH} AND trim(coalesce(detail_url, '')) <> '' GROUP BY 1),
 t AS (SELECT DISTINCT title, project_no FROM scraping_infos WHERE NOT {_FRESH} AND trim(coalesce(title, '')) <> '' AND trim(coalesce(project_no, '')) <> ''),
 b AS (SELECT * FROM scraping_infos WHERE {_FRESH})
 SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN coalesce(b.type IN ('拍卖转让', '拍卖', '转让'), false) THEN 'skipped_type' WHEN k.done = 0 THEN 'updated' WHEN k.done = 1 THEN 'duplicate_url' WHEN t.title IS NOT NULL THEN 'duplicate_title' ELSE 'inserted' END AS outcome
 FROM b LEFT JOIN k ON b.detail_url = k.detail_url LEFT JOIN t ON b.title = t.title AND b.project_no = t.project_no) GROUP BY 1""",
)
def ingest_outcomes(spark, sf):
    new, old = _batch(spark, sf)
    return ingest.outcomes(new, old, listing.approved()).groupBy("outcome").agg(F.count("*").alias("n"))


@query("ingest_settle", f"SELECT detail_url, coalesce(arg_min(id, id) FILTER (WHERE {APPROVED}), max(id)) AS id FROM scraping_infos WHERE trim(coalesce(detail_url, '')) <> '' GROUP BY 1")
def ingest_settle(spark, sf):
    return ingest.settle(infos(spark, sf), "detail_url", "id", listing.approved())


@query("ingest_first_seen", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM scraping_infos WHERE trim(coalesce(title, '')) <> '') WHERE rn = 1 UNION ALL SELECT id FROM scraping_infos WHERE trim(coalesce(title, '')) = ''")
def ingest_first_seen(spark, sf):
    return ingest.first_per(infos(spark, sf, "id", "title"), "title", F.col("id")).select("id")


@query("ingest_distinct_documents", "SELECT count(*) AS n, count(DISTINCT text) AS n_texts FROM documents")
def ingest_distinct_documents(spark, sf):
    return table(spark, sf, "documents", ["text"]).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query(
    "ingest_upsert",
    """WITH n AS (SELECT o_orderkey, 'X' AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0)
 SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice FROM orders o LEFT JOIN n USING (o_orderkey)""",
)
def ingest_upsert(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    new = o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return ingest.upsert(o, new, "o_orderkey", F.current_timestamp(), keep=())
