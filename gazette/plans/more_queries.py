"""Queries over rules of titles and bodies, forwarded items, the cascade from owner to lead, packs and re-audits, with their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.operators import cascade, forward, ingest, listing, review, routing
from gazette.plans.domain_queries import _DAYS, _DW, _ENABLED, _MAINT, _OWN, _ROUTES, _T, APPROVED, _log, _norm_sql, _resolved, has_any, infos
from gazette.plans.domain_queries import route_items as routes_of
from gazette.plans.text_queries import _events
from gazette.operators import digest
from gazette.session import shared_dir, table
from gazette.streaming import reads as streams

QUERIES, SQL = {}, {}
NOW = datetime(2026, 1, 5, 8, 0, 0)
_NOW = "TIMESTAMP '2026-01-05 08:00:00'"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------- rules of titles and bodies

_BOTH = "trim(coalesce(title, '') || chr(10) || coalesce(detail, ''))"
_TECH = f"(NOT {has_any(_T, rules.TITLE_EXCLUDE)} AND {has_any(_T, rules.SOFTWARE_WORDS + rules.HARDWARE_WORDS)})"
_FINANCIAL = f"CASE WHEN {_OWN} <> '' THEN {has_any(_OWN, rules.FINANCIAL_WORDS)} ELSE coalesce({has_any('title', rules.FINANCIAL_WORDS)}, false) END"
_HIT = "CASE " + " ".join(f"WHEN contains({_T}, '{w}') THEN '{'hard' if w in rules.HARD_EXCLUDE else 'soft'}'" for w in rules.TITLE_EXCLUDE) + " ELSE 'none' END"
_SCANNED = " ".join(f"WHEN {has_any(x, rules.SOFTWARE_WORDS)} THEN '软件相关' WHEN {has_any(x, rules.HARDWARE_WORDS)} THEN '硬件相关'" for x in (_T, "detail"))
_PRODUCT = f"""CASE WHEN {has_any(_BOTH, rules.SURVEY_MARKS + rules.RENTED_LINES)} THEN ''
 WHEN contains({_BOTH}, '算力设备') OR (contains({_BOTH}, '设备扩容') AND (contains({_BOTH}, '大模型') OR contains({_BOTH}, '算力'))) OR regexp_matches({_BOTH}, '{rules.SERVER_PARTS}') THEN '硬件相关'
 WHEN {_HIT} = 'hard' OR ({_HIT} = 'soft' AND NOT ({_FINANCIAL})) THEN '' WHEN {has_any(_T, rules.HARDWARE_FIRST)} THEN '硬件相关' WHEN strpos({_T}, '维保') > 0 AND {_MAINT} THEN '软件相关' {_SCANNED} ELSE '' END"""


@query("class_tech_title", f"SELECT id, {_TECH} AS tech FROM scraping_infos")
def class_tech_title(spark, sf):
    return infos(spark, sf, "id", "title").select("id", rules.tech_title(F.col("title")).alias("tech"))


@query("class_product_full", f"SELECT id, {_PRODUCT} AS product FROM scraping_infos")
def class_product_full(spark, sf):
    """The product class with what overrides and what excludes it."""
    return infos(spark, sf, "id", "title", "detail").select("id", rules.product_related(F.col("title"), F.col("detail")).alias("product"))


@query("class_accepted", f"SELECT id, CASE WHEN trim(product_related) IN ('软件相关', '硬件相关') THEN trim(product_related) ELSE {_PRODUCT} END AS product FROM scraping_infos")
def class_accepted(spark, sf):
    return infos(spark, sf, "id", "title", "detail", "product_related").select("id", rules.accepted_class(F.col("product_related"), F.col("title"), F.col("detail")).alias("product"))


@query("class_title_gate", f"SELECT gate, count(*) AS n FROM (SELECT CASE WHEN NOT {_TECH} THEN 'not_tech' WHEN contains(coalesce(title, ''), '终止') OR contains(coalesce(title, ''), '流标') THEN 'excluded' WHEN NOT contains(coalesce(title, ''), coalesce(keyword, '')) THEN 'no_keyword' ELSE 'open' END AS gate FROM scraping_infos) GROUP BY 1")
def class_title_gate(spark, sf):
    g = rules.title_gate(F.col("title"), ["终止", "流标"], F.col("keyword"))
    return infos(spark, sf, "title", "keyword").groupBy(g.alias("gate")).agg(F.count("*").alias("n"))


_S = "regexp_replace(coalesce(detail, ''), '^[\\s\\x{3000}\\x{a0}]+|[\\s\\x{3000}\\x{a0}]+$', '', 'g')"


@query("class_bodies", f"SELECT id, starts_with({_S}, '{rules.SCAN_BODY}') AS scan, length({_S}) < 80 OR ({has_any(_S, rules.ATTACHMENT_HINTS)} AND (length({_S}) < 1200 OR contains({_S}, '招标进展'))) AS attachment FROM scraping_infos")
def class_bodies(spark, sf):
    return infos(spark, sf, "id", "detail").select("id", rules.scan_body(F.col("detail")).alias("scan"), rules.wants_attachment(F.col("detail")).alias("attachment"))


@query("class_kept_status", "SELECT id, coalesce(nullif(trim(audit_status), ''), '待审核') AS status FROM scraping_infos")
def class_kept_status(spark, sf):
    return infos(spark, sf, "id", "audit_status").select("id", rules.kept_status(F.col("audit_status"), F.lit("待审核")).alias("status"))


# ---------------------------------------------------------------- forwarded items

# what was read under a dispatch that was not sent counts as forwarded: the tables hold no tickets of their own
_TICKETS = "SELECT DISTINCT d.dispatch_id AS ticket, r.record_id, d.digest_token, d.receiver_userid AS to_userid FROM dispatch_log d JOIN item_read_log r USING (dispatch_id) WHERE d.send_status IS DISTINCT FROM 'SENT' AND r.record_id IS NOT NULL"
_ALL = f"""SELECT r.id, r.record_id, r.reader_userid, r.read_at, {_DW} AS dwell, 'dispatch' AS source_type, lower(trim(coalesce(d.digest_token, ''))) AS token FROM item_read_log r JOIN dispatch_log d ON r.dispatch_id = d.dispatch_id AND d.send_status = 'SENT'
 UNION ALL SELECT r.id, r.record_id, r.reader_userid, r.read_at, {_DW}, 'forward', lower(trim(coalesce(f.digest_token, ''))) FROM item_read_log r JOIN ({_TICKETS}) f ON f.ticket = r.dispatch_id AND f.record_id = r.record_id"""


def _tickets(log, dispatch):
    d = dispatch.filter(~F.coalesce(F.col("send_status") == "SENT", F.lit(False))).select("dispatch_id", "digest_token", F.col("receiver_userid").alias("to_userid"))
    return log.filter("record_id is not null").join(d, "dispatch_id").select(F.col("dispatch_id").alias("ticket"), "record_id", "digest_token", "to_userid").distinct()


def _all_reads(spark, sf):
    log, dispatch = _log(spark, sf)
    return forward.all_reads(log, dispatch, _tickets(log, dispatch))


@query("read_all_sources", _ALL)
def read_all_sources(spark, sf):
    return _all_reads(spark, sf)


_STATE_ALL = f"SELECT token, record_id, reader_userid, max(read_at) AS read_at, max(dwell) AS dwell FROM ({_ALL}) WHERE source_type = 'dispatch' OR token <> '' GROUP BY 1, 2, 3"


@query("read_state_all", _STATE_ALL)
def read_state_all(spark, sf):
    return forward.state(_all_reads(spark, sf))


@query("read_allowed", f"SELECT r.id FROM item_read_log r WHERE EXISTS (SELECT 1 FROM ({_TICKETS}) f WHERE f.ticket = r.dispatch_id AND f.record_id = r.record_id AND f.to_userid = r.reader_userid)")
def read_allowed(spark, sf):
    log, dispatch = _log(spark, sf)
    return forward.may_read(log, _tickets(log, dispatch)).select("id")


_ACC = "(SELECT trim(user_name) AS user_name, min(trim(user_account)) AS user_account FROM org_user WHERE coalesce(is_deleted, 0) = 0 AND trim(coalesce(user_name, '')) <> '' AND trim(coalesce(user_account, '')) <> '' GROUP BY 1)"


@query(
    "forward_recipients",
    f"""WITH x AS (SELECT id AS key, unnest(list_distinct(list_filter(regexp_split_to_array(coalesce(sales, ''), '[|,，;；\\s]+'), lambda x: x <> ''))) AS name FROM sales_lead_confirm)
 SELECT key, name, CASE WHEN regexp_matches(name, '{forward.ACCOUNT}') THEN name ELSE coalesce(a.user_account, nullif(lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')), '')) END AS account,
  CASE WHEN regexp_matches(name, '{forward.ACCOUNT}') THEN 'account' WHEN a.user_account IS NOT NULL THEN 'directory' WHEN nullif(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g'), '') IS NOT NULL THEN 'letters' ELSE 'missing' END AS how
 FROM x LEFT JOIN {_ACC} a ON a.user_name = x.name""",
)
def forward_recipients(spark, sf):
    return forward.recipients(table(spark, sf, "sales_lead_confirm", ["id", "sales"]), "id", "sales", table(spark, sf, "org_user"))


# ---------------------------------------------------------------- the cascade

_O = f"SELECT DISTINCT trim(project_owner) AS owner, {_norm_sql('project_owner')} AS n FROM scraping_infos WHERE trim(coalesce(project_owner, '')) <> ''"
_P = f"SELECT DISTINCT trim(canonical_customer) AS customer, {_norm_sql('canonical_customer')} AS n FROM customer_alias_map WHERE trim(coalesce(canonical_customer, '')) <> ''"
_NEAR = "length(o.n) >= 4 AND length(p.n) >= 4 AND (contains(o.n, p.n) OR contains(p.n, o.n))"


def _pool(spark, sf):
    return table(spark, sf, "customer_alias_map").select(F.col("canonical_customer").alias("customer_name"))


@query(
    "route_canonical",
    f"""WITH o AS ({_O}), p AS ({_P}), same AS (SELECT n, min(customer) AS same FROM p WHERE n <> '' GROUP BY 1),
 near AS (SELECT o.owner, CASE WHEN count(DISTINCT p.customer) = 1 THEN min(p.customer) END AS one FROM o JOIN p ON {_NEAR} GROUP BY 1)
 SELECT o.owner, CASE WHEN o.n = '' THEN '' ELSE coalesce(same.same, near.one, o.n) END AS canonical FROM o LEFT JOIN same ON o.n = same.n LEFT JOIN near ON near.owner = o.owner""",
)
def route_canonical(spark, sf):
    return cascade.canonical(infos(spark, sf, "project_owner"), _pool(spark, sf))


_PART = f"""SELECT owner, arg_min(id, (-length(customer), id)) AS lead_id, arg_min(customer, (-length(customer), id)) AS customer, arg_min(sales, (-length(customer), id)) AS sales
 FROM (SELECT o.owner, l.id, l.customer, l.sales FROM (OWNERS) o JOIN (SELECT *, {_norm_sql('customer')} AS n FROM ({_ENABLED})) l ON length(o.n) >= 8 AND length(l.n) >= 8 AND (contains(o.n, l.n) OR contains(l.n, o.n))) GROUP BY 1"""


@query("route_longest_lead", _PART.replace("OWNERS", _O))
def route_longest_lead(spark, sf):
    return cascade.longest_lead(infos(spark, sf, "project_owner"), table(spark, sf, "sales_lead_confirm"))


_RES = "SELECT DISTINCT trim(project_owner) AS owner FROM scraping_infos WHERE trim(coalesce(project_owner, '')) <> ''"
_FIRST = f"""o AS ({_O}), l AS ({_ENABLED}), e AS (SELECT customer AS key, min(id) AS id FROM l GROUP BY 1), m AS (SELECT {_norm_sql('customer_name')} AS key, min(id) AS id FROM l GROUP BY 1),
 r AS (SELECT o.owner, o.n, coalesce(e.id, m.id) AS lead_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'normal' ELSE 'none' END AS how FROM o LEFT JOIN e ON o.owner = e.key LEFT JOIN m ON o.n = m.key AND m.key <> ''),
 part AS ({_PART.replace("OWNERS", "SELECT owner, n FROM r WHERE how = 'none'")})"""


@query(
    "route_cascade",
    f"""WITH {_FIRST}, f AS (SELECT r.owner, l.customer, l.sales, r.how FROM r JOIN l ON l.id = r.lead_id UNION ALL SELECT owner, customer, sales, 'part' FROM part)
 SELECT s.id, trim(coalesce(s.project_owner, '')) AS owner, CASE WHEN trim(s.keyword) = '银行' THEN NULL ELSE f.customer END AS customer, CASE WHEN trim(s.keyword) = '银行' THEN '值班' ELSE f.sales END AS sales,
  CASE WHEN trim(s.keyword) = '银行' THEN 'keyword' ELSE coalesce(f.how, 'none') END AS how FROM scraping_infos s LEFT JOIN f ON f.owner = trim(s.project_owner)""",
)
def route_cascade(spark, sf):
    return cascade.route(infos(spark, sf, "id", "keyword", "project_owner"), table(spark, sf, "sales_lead_confirm"), {"银行": "值班"}, loose=True)


def _canon_sql(names: str, pool: str) -> str:
    return f"""(SELECT o.owner, CASE WHEN o.n = '' THEN '' ELSE coalesce(s.same, x.one, o.n) END AS canonical FROM ({names}) o LEFT JOIN (SELECT n, min(customer) AS same FROM ({pool}) WHERE n <> '' GROUP BY 1) s ON o.n = s.n
 LEFT JOIN (SELECT o.owner, CASE WHEN count(DISTINCT p.customer) = 1 THEN min(p.customer) END AS one FROM ({names}) o JOIN ({pool}) p ON {_NEAR} GROUP BY 1) x ON x.owner = o.owner)"""


_LEADS = f"SELECT id, trim(customer_name) AS customer, sales, {_norm_sql('customer_name')} AS n, coalesce(updated_at, created_at, TIMESTAMP '0001-01-01') AS ts FROM sales_lead_confirm WHERE coalesce(enabled, 1) = 1 AND trim(coalesce(customer_name, '')) <> '' AND trim(coalesce(sales, '')) <> ''"
_LPOOL = f"SELECT DISTINCT trim(customer_name) AS customer, {_norm_sql('customer_name')} AS n FROM sales_lead_confirm WHERE trim(coalesce(customer_name, '')) <> ''"


@query(
    "route_newest_lead",
    f"""WITH o AS ({_O}), l AS ({_LEADS}), ln AS (SELECT DISTINCT customer AS owner, n FROM l), oc AS {_canon_sql(_O, _LPOOL)}, lc AS {_canon_sql(f"SELECT DISTINCT customer AS owner, n FROM ({_LEADS})", _LPOOL)},
 p AS (SELECT o.owner, ln.owner AS customer FROM o JOIN ln ON o.n = ln.n AND o.n <> '' UNION SELECT o.owner, p.owner FROM o JOIN ln p ON {_NEAR} UNION SELECT oc.owner, lc.owner FROM oc JOIN lc ON oc.canonical = lc.canonical AND oc.canonical <> '')
 SELECT p.owner, arg_max(l.id, (l.ts, l.id)) AS lead_id, arg_max(l.customer, (l.ts, l.id)) AS customer, arg_max(l.sales, (l.ts, l.id)) AS sales FROM p JOIN l ON l.customer = p.customer GROUP BY 1""",
)
def route_newest_lead(spark, sf):
    return cascade.newest_lead(infos(spark, sf, "project_owner"), table(spark, sf, "sales_lead_confirm"))


@query(
    "route_stored",
    f"""{_ROUTES}, g AS (SELECT record_id, any_value(customer) AS customer, list(user_account ORDER BY user_account) AS users, list(user_name ORDER BY user_account) AS labels FROM (SELECT DISTINCT record_id, customer, user_account, user_name FROM routes) GROUP BY 1),
 x AS (SELECT record_id, customer, unnest(users) AS presale_userid, unnest(labels) AS label FROM g)
 SELECT repeat('a', 32) AS digest_token, record_id, presale_userid, label AS presale_display_name, customer AS canonical_customer, {_NOW} AS updated_at FROM x""",
)
def route_stored(spark, sf):
    """The rows of the route table, names paired with accounts by place."""
    r = routes_of(spark, sf).select("record_id", "customer", "user_account", "user_name").distinct()
    g = r.groupBy(F.col("record_id").alias("id")).agg(F.min("customer").alias("customer"), F.sort_array(F.collect_list(F.struct("user_account", "user_name"))).alias("u"))
    g = g.select("id", "customer", F.transform("u", lambda x: x["user_account"]).alias("users"), F.transform("u", lambda x: x["user_name"]).alias("labels"))
    return cascade.stored_routes(g, F.lit("a" * 32), routing.account_names(table(spark, sf, "org_user")), now())


# ---------------------------------------------------------------- packs and sheets

_DAY = "DATE '2025-06-10'"
_VIEWER = "(SELECT min(user_account) FROM routes)"


def _day_routes(spark, sf, day=date(2025, 6, 10)):
    days = digest.days_of(infos(spark, sf, "id", "sub_type", "audit_status", "created_at", "updated_at")).filter(F.col("day") == F.lit(day)).select(F.col("id").alias("record_id"), F.col("day").cast("string").alias("token"))
    return days, routes_of(spark, sf).join(days, "record_id").select("token", "record_id", "user_account", "user_name", "customer")


_DR = f"{_ROUTES}, days AS (SELECT id AS record_id, CAST(day AS VARCHAR) AS token FROM ({_DAYS}) WHERE day = {_DAY}), dr AS (SELECT d.token, r.record_id, r.user_account, r.user_name, r.customer FROM routes r JOIN days d USING (record_id))"


@query(
    "digest_watched",
    f"""{_DR}, g AS (SELECT token, record_id, string_agg(DISTINCT user_name, ',' ORDER BY user_name) AS names, string_agg(DISTINCT customer, ',' ORDER BY customer) AS customers, max(CASE WHEN user_account = 'user001' THEN 1 ELSE 0 END) AS mine FROM dr GROUP BY 1, 2)
 SELECT d.token, d.record_id, coalesce(g.names, '') AS names, coalesce(g.customers, '') AS customers, coalesce(g.mine, 0) AS mine FROM days d LEFT JOIN g ON d.token = g.token AND d.record_id = g.record_id""",
)
def digest_watched(spark, sf):
    days, r = _day_routes(spark, sf)
    return review.watched(days, r, F.lit("user001"))


def _sheet_sql(keys: str, where: str) -> str:
    return f"""{_ROUTES}, days AS (SELECT id AS record_id, CAST(day AS VARCHAR) AS token FROM ({_DAYS})), dr AS (SELECT d.token, r.record_id, r.user_account, r.user_name FROM routes r JOIN days d USING (record_id)),
 s AS (SELECT {keys}, max(read_at) AS read_at, max(dwell) AS dwell FROM ({_STATE_ALL}) GROUP BY {keys})
 SELECT dr.token, dr.record_id, dr.user_account AS reader_userid, dr.user_name, i.title, s.read_at, coalesce(s.dwell, 0) AS dwell FROM dr LEFT JOIN s ON s.record_id = dr.record_id AND s.reader_userid = dr.user_account LEFT JOIN scraping_infos i ON i.id = dr.record_id
 WHERE {where} ORDER BY s.read_at DESC NULLS LAST, dr.record_id DESC, dr.user_account, dr.token LIMIT 200"""


def _sheet(spark, sf, **kw):
    days = digest.days_of(infos(spark, sf, "id", "sub_type", "audit_status", "created_at", "updated_at")).select(F.col("id").alias("record_id"), F.col("day").cast("string").alias("token"))
    r = routes_of(spark, sf).join(days, "record_id").select("token", "record_id", "user_account", "user_name")
    titles = infos(spark, sf, "id", "title").withColumnRenamed("id", "record_id")
    return review.read_sheet(r, forward.state(_all_reads(spark, sf)), titles, size=200, **kw)


@query("read_sheet_merged", _sheet_sql("record_id, reader_userid", "i.title LIKE '%系统%'"))
def read_sheet_merged(spark, sf):
    return _sheet(spark, sf, merged=True, title="系统")


@query("read_sheet_unseen", _sheet_sql("record_id, reader_userid", "s.read_at IS NULL AND (dr.user_account LIKE '%1%' OR dr.user_name LIKE '%1%')"))
def read_sheet_unseen(spark, sf):
    return _sheet(spark, sf, merged=True, status="unseen", reader="1")


# ---------------------------------------------------------------- re-audits

_FRESH = "CAST(created_at AS DATE) >= DATE '2025-10-01'"
_PENDING = "trim(audit_status) = '待审核'"


@query(
    "ingest_reaudit",
    f"""WITH base AS (SELECT id, title, audit_status, project_budget, created_at, updated_at FROM scraping_infos WHERE NOT coalesce({_FRESH}, false)),
 new AS (SELECT id, title, CASE WHEN {_PENDING} THEN '审核通过' ELSE audit_status END AS audit_status, CASE WHEN {_PENDING} THEN NULL ELSE project_budget END AS project_budget, {_NOW} AS created_at FROM scraping_infos WHERE coalesce({_FRESH}, false) OR {_PENDING})
 SELECT coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE b.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.audit_status ELSE b.audit_status END AS audit_status,
  CASE WHEN n.id IS NOT NULL THEN n.project_budget ELSE b.project_budget END AS project_budget, coalesce(b.created_at, n.created_at) AS created_at, CASE WHEN n.id IS NOT NULL THEN {_NOW} ELSE b.updated_at END AS updated_at FROM base b FULL JOIN new n ON b.id = n.id""",
)
def ingest_reaudit(spark, sf):
    """Rows audited again replace what is there, NULLs too, but for the day they came; new rows are added."""
    a = infos(spark, sf, "id", "title", "audit_status", "project_budget", "created_at", "updated_at")
    fresh = F.coalesce(F.to_date("created_at") >= F.lit(date(2025, 10, 1)), F.lit(False))
    waits = F.coalesce(F.trim("audit_status") == listing.PENDING, F.lit(False))
    new = a.filter(fresh | waits).select("id", "title", F.when(waits, listing.APPROVED).otherwise(F.col("audit_status")).alias("audit_status"), F.when(~waits, F.col("project_budget")).alias("project_budget"), now().alias("created_at"))
    return ingest.upsert(a.filter(~fresh), new, "id", now())


@query("ingest_pending_of_day", f"SELECT detail_url, min(id) AS id FROM scraping_infos WHERE {_PENDING} AND CAST(created_at AS DATE) = DATE '2025-06-10' AND trim(coalesce(detail_url, '')) <> '' GROUP BY 1")
def ingest_pending_of_day(spark, sf):
    return ingest.pending_of_day(infos(spark, sf, "id", "detail_url", "audit_status", "created_at"), F.lit(date(2025, 6, 10)))


_OWNER = "nullif(trim(regexp_extract(coalesce(detail, ''), '" + rules.FIELDS["project_owner"][0].replace("\\\\", "\\") + "', 1)), '')"


@query("ingest_gained", f"SELECT count_if(detail IS NOT NULL) AS ok, count_if(detail IS NULL) AS fail, count_if(trim(coalesce(project_owner, '')) = '' AND detail IS NOT NULL AND {_OWNER} IS NOT NULL) AS gained FROM scraping_infos")
def ingest_gained(spark, sf):
    """What reading the owners of all texts again would gain."""
    a = infos(spark, sf, "id", "project_owner", "detail")
    after = a.filter("detail is not null").select("id", rules.first_match(F.col("detail"), rules.FIELDS["project_owner"]).alias("project_owner"))
    return review.gained(a, after)


@query("stream_dwell_live", "SELECT dispatch_id, record_id, reader_userid, max(read_at) AS read_at, CAST(max(least(greatest(coalesce(dwell_seconds, 0), 0), 86400)) AS BIGINT) AS dwell FROM item_read_log WHERE dispatch_id IS NOT NULL AND record_id IS NOT NULL AND reader_userid IS NOT NULL AND read_at IS NOT NULL GROUP BY 1, 2, 3")
def stream_dwell_live(spark, sf):
    """The longest dwell after the first mark, kept by a stream with state of its own."""
    import uuid

    at, path = f"{shared_dir(spark)}/dwell-{uuid.uuid4().hex}", f"{sf}/item_read_log.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/item_read_log.parque[t]").filter("read_at is not null")
    e = _events(stream)
    both = streams.dwell_stream(e.unionByName(e.withColumn("event_type", F.lit("dwell"))))
    spark.createDataFrame([], both.schema).withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{at}/out")
    streams.run_available(both, lambda b, n: b.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint")
    d = spark.read.parquet(f"{at}/out").groupBy(*streams.KEYS).agg(F.max(F.struct("batch", "read_at", "dwell")).alias("x"))
    return d.select(*streams.KEYS, F.col("x.read_at").cast("timestamp_ntz").alias("read_at"), F.col("x.dwell").cast("long").alias("dwell"))
