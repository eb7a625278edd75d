"""Queries over page text, names of files, reviews and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import rules, text
from gazette.operators import digest, listing
from gazette.plans.domain_queries import APPROVED, AWARDS, TENDERS, case_chain, has_any
from gazette.session import shared_dir, table
from gazette.streaming import reads as streams

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("doc_strip_html", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS plain FROM documents")
def doc_strip_html(spark, sf):
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", text.strip_html(F.col("text")).alias("plain"))


@query("doc_links", r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']+)', 1)) AS n_links, len(regexp_extract_all(text, '(?i)<[a-z]+[ >]')) AS n_tags FROM documents WHERE text IS NOT NULL""")
def doc_links(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "text"]).filter("text is not null")
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?i)<a\\s[^>]*href\\s*=\\s*[\"']([^\"']+)"), F.lit(1))).alias("n_links"), F.size(F.regexp_extract_all("text", F.lit("(?i)<[a-z]+[ >]"), F.lit(0))).alias("n_tags"))


@query("doc_blocks", "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS n_blocks FROM documents WHERE text IS NOT NULL")
def doc_blocks(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "text"]).filter("text is not null")
    return d.select("doc_id", F.size(F.filter(F.transform(F.split("text", "\n\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("n_blocks"))


@query("doc_byte_sizes", "SELECT doc_id, strlen(text) AS n_bytes, CAST(ceil(strlen(text) / 2048.0) AS BIGINT) AS least_pieces FROM documents WHERE text IS NOT NULL")
def doc_byte_sizes(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "text"]).filter("text is not null")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.ceil(F.octet_length("text") / 2048).alias("least_pieces"))


@query("doc_pieces")
def doc_pieces(spark, sf):
    """Pieces of at most 2048 bytes of every text."""
    d = table(spark, sf, "documents", ["doc_id", "text"]).filter("text is not null")
    return d.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("pos", "piece")).select("doc_id", "pos", F.octet_length("piece").alias("n_bytes"))


@query("doc_unfolded")
def doc_unfolded(spark, sf):
    """Texts with doubled glyphs folded and line ends inside Chinese sentences dropped."""
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", text.join_ocr_lines(text.fold_doubled(F.col("text"))).alias("text"))


@query("text_file_name", r"""SELECT id, substr(trim(regexp_replace(title, '[\\/:*?"<>|\r\n\t]', '_', 'g')), 1, 120) AS file_name FROM scraping_infos""")
def text_file_name(spark, sf):
    return table(spark, sf, "scraping_infos", ["id", "title"]).select("id", text.safe_file_name(F.col("title")).alias("file_name"))


@query("text_url", "SELECT id, CASE WHEN starts_with(trim(detail_url), '//') THEN 'https:' || trim(detail_url) ELSE trim(detail_url) END AS url, regexp_extract(lower(trim(detail_url)), '^[a-z]+://([^/:?#]+)', 1) AS host FROM scraping_infos")
def text_url(spark, sf):
    return table(spark, sf, "scraping_infos", ["id", "detail_url"]).select("id", text.fix_url(F.col("detail_url")).alias("url"), F.regexp_extract(F.lower(F.trim("detail_url")), "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query("text_dotted_day", "SELECT id, strftime(created_at, '%Y.%m.%d') AS day, strftime(created_at, '%Y.%m.%d') || ' 招标信息摘要' AS title FROM scraping_infos")
def text_dotted_day(spark, sf):
    return table(spark, sf, "scraping_infos", ["id", "created_at"]).select("id", text.dotted(F.col("created_at")).alias("day"), digest.title_of(F.col("created_at")).alias("title"))


@query("list_review_filter", "SELECT id, title FROM scraping_infos WHERE id = 77 OR contains(lower(title), '77')")
def list_review_filter(spark, sf):
    """A number in a review's search means the id, or part of the title."""
    return table(spark, sf, "scraping_infos", ["id", "title"]).filter((F.col("id") == 77) | F.contains(F.lower("title"), F.lit("77")))


@query("list_brief_by_day", f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, coalesce(nullif(trim(sub_type), ''), '(空)') AS sub_type, count(*) AS cnt FROM scraping_infos WHERE {APPROVED} AND created_at IS NOT NULL GROUP BY 1, 2")
def list_brief_by_day(spark, sf):
    d = table(spark, sf, "scraping_infos", ["sub_type", "audit_status", "created_at"]).filter(listing.approved() & F.col("created_at").isNotNull())
    return d.groupBy(F.to_date("created_at").cast("string").alias("day"), F.coalesce(F.nullif(F.trim("sub_type"), F.lit("")), F.lit("(空)")).alias("sub_type")).agg(F.count("*").alias("cnt"))


@query("list_unclassified", "SELECT id, title FROM scraping_infos WHERE trim(coalesce(product_related, '')) = ''")
def list_unclassified(spark, sf):
    return table(spark, sf, "scraping_infos", ["id", "title", "product_related"]).filter(~listing.not_blank("product_related")).select("id", "title")


_CLEAN = "(CASE WHEN trim(regexp_replace(title, '^\\[[^\\[\\]]{1,20}\\]', '')) = '' THEN trim(title) ELSE trim(regexp_replace(title, '^\\[[^\\[\\]]{1,20}\\]', '')) END)"


@query("class_changes", f"SELECT id, sub_type, label FROM (SELECT id, sub_type, {case_chain(_CLEAN, rules.LABEL_BY_TITLE, '其他')} AS label FROM scraping_infos) WHERE sub_type IS DISTINCT FROM label AND label <> '其他'")
def class_changes(spark, sf):
    """Rows whose label by title differs from the recorded one."""
    label = rules.first_hit(text.drop_prefix_tag(F.col("title")), rules.LABEL_BY_TITLE, "其他")
    return table(spark, sf, "scraping_infos", ["id", "sub_type", "title"]).select("id", "sub_type", label.alias("label")).filter(~F.col("sub_type").eqNullSafe(F.col("label")) & (F.col("label") != "其他"))


@query("class_card_kind", f"SELECT id, CASE WHEN trim(sub_type) IN {AWARDS} OR contains(title, '中标') OR contains(title, '成交') THEN 'award' WHEN trim(sub_type) IN {TENDERS} OR contains(title, '招标') OR contains(title, '采购') THEN 'tender' ELSE 'other' END AS kind FROM scraping_infos")
def class_card_kind(spark, sf):
    s, t = F.trim("sub_type"), F.col("title")
    kind = F.when(s.isin(*rules.AWARD_GROUP) | rules.any_of(t, ["中标", "成交"]), "award").when(s.isin(*rules.TENDER_GROUP) | rules.any_of(t, ["招标", "采购"]), "tender").otherwise("other")
    return table(spark, sf, "scraping_infos", ["id", "sub_type", "title"]).select("id", kind.alias("kind"))


@query("class_failure_marks", f"SELECT id FROM scraping_infos WHERE {has_any('detail', ['正文无法', '请稍后', '未能抽取', '抽取失败', '无法显示'])}")
def class_failure_marks(spark, sf):
    return table(spark, sf, "scraping_infos", ["id", "detail"]).filter(rules.any_of(F.col("detail"), ["正文无法", "请稍后", "未能抽取", "抽取失败", "无法显示"])).select("id")


@query("read_unseen", "SELECT l.dispatch_id, l.receiver_userid FROM dispatch_log l WHERE l.send_status = 'SENT' AND NOT EXISTS (SELECT 1 FROM item_read_log r WHERE r.dispatch_id = l.dispatch_id AND r.reader_userid = l.receiver_userid)")
def read_unseen(spark, sf):
    """Dispatches that were sent and whose receiver has read nothing of them."""
    r = table(spark, sf, "item_read_log", ["dispatch_id", "reader_userid"]).distinct()
    d = table(spark, sf, "dispatch_log").filter("send_status = 'SENT'").select("dispatch_id", "receiver_userid")
    return d.join(r, (d["dispatch_id"] == r["dispatch_id"]) & (d["receiver_userid"] == r["reader_userid"]), "left_anti")


@query("read_display_names", "SELECT l.id, l.reader_userid, coalesce(o.display_name, l.reader_userid) AS display_name FROM item_read_log l LEFT JOIN (SELECT trim(user_account) AS user_account, min(trim(user_name)) AS display_name FROM org_user WHERE trim(coalesce(user_account, '')) <> '' GROUP BY 1) o ON o.user_account = l.reader_userid")
def read_display_names(spark, sf):
    from gazette.operators.routing import account_names

    o = account_names(table(spark, sf, "org_user"))
    l = table(spark, sf, "item_read_log", ["id", "reader_userid"])
    return l.join(o, l["reader_userid"] == o["user_account"], "left").select("id", "reader_userid", F.coalesce("display_name", "reader_userid").alias("display_name"))


@query("read_sources", "SELECT 'dispatch' AS source, id, dispatch_id, read_at FROM item_read_log WHERE dispatch_id IN (SELECT dispatch_id FROM dispatch_log WHERE send_status = 'SENT') UNION ALL SELECT 'other', id, dispatch_id, read_at FROM item_read_log WHERE dispatch_id IS NULL OR dispatch_id NOT IN (SELECT dispatch_id FROM dispatch_log WHERE send_status = 'SENT' AND dispatch_id IS NOT NULL)")
def read_sources(spark, sf):
    r = table(spark, sf, "item_read_log", ["id", "dispatch_id", "read_at"])
    sent = table(spark, sf, "dispatch_log").filter("send_status = 'SENT'").select("dispatch_id").distinct()
    a, b = r.join(sent, "dispatch_id", "left_semi"), r.join(sent, "dispatch_id", "left_anti")
    return a.select(F.lit("dispatch").alias("source"), "id", "dispatch_id", "read_at").unionByName(b.select(F.lit("other").alias("source"), "id", "dispatch_id", "read_at"))


def _events(df):
    """Reads as events: each a mark, and the dwell with it."""
    return df.filter("dispatch_id is not null and record_id is not null and reader_userid is not null").select(F.lit("mark").alias("event_type"), "dispatch_id", "record_id", "reader_userid", F.col("read_at").alias("ts"), "dwell_seconds")


@query("stream_marks", "SELECT dispatch_id, record_id, reader_userid, max(read_at) AS read_at FROM item_read_log WHERE dispatch_id IS NOT NULL AND record_id IS NOT NULL AND reader_userid IS NOT NULL GROUP BY 1, 2, 3")
def stream_marks(spark, sf):
    """The read marks, kept by a stream over the log (update mode, every batch overwrites the state it changed)."""
    import uuid

    at = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"
    path = f"{sf}/item_read_log.parquet"
    # a pattern, as a stream takes folders or patterns, and a table may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/item_read_log.parque[t]")
    marks = streams.marks(_events(stream))
    spark.createDataFrame([], marks.schema).withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{at}/out")  # so that there is a table without any read
    streams.run_available(marks, lambda b, n: b.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").groupBy(*streams.KEYS).agg(F.max_by("read_at", "batch").alias("read_at"))


@query("stream_dwell", "SELECT dispatch_id, record_id, reader_userid, max(read_at) AS read_at, CAST(max(least(greatest(coalesce(dwell_seconds, 0), 0), 86400)) AS BIGINT) AS dwell FROM item_read_log WHERE dispatch_id IS NOT NULL AND record_id IS NOT NULL AND reader_userid IS NOT NULL GROUP BY 1, 2, 3")
def stream_dwell(spark, sf):
    e = _events(table(spark, sf, "item_read_log"))
    both = e.unionByName(e.withColumn("event_type", F.lit("dwell")))
    return streams.dwell_batch(both).withColumn("dwell", F.col("dwell").cast("long"))


@query("read_latest_batch", "SELECT day, n_reads, n_readers FROM (SELECT CAST(CAST(read_at AS DATE) AS VARCHAR) AS day, count(*) AS n_reads, count(DISTINCT reader_userid) AS n_readers FROM item_read_log WHERE read_at IS NOT NULL GROUP BY 1)")
def read_latest_batch(spark, sf):
    d = table(spark, sf, "item_read_log").filter("read_at is not null")
    return d.groupBy(F.to_date("read_at").cast("string").alias("day")).agg(F.count("*").alias("n_reads"), F.countDistinct("reader_userid").alias("n_readers"))
