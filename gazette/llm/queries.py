"""The queries of the llm subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.llm import encoding, history, mixing, names, quality, residue, scan, tokens, truncation
from gazette.session import spread, table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# ---- problem 1: template residue and error pages


@query("p1_found")
def p1_found(spark, sf_dir):
    return residue.residue(spread(table(spark, sf_dir, "scraping_infos", ["id", "detail", "audit_status"]))).select("id", "field").distinct()


@query("p1_kinds")
def p1_kinds(spark, sf_dir):
    """How many values of each field hold which kind of residue."""
    r = residue.residue(spread(table(spark, sf_dir, "scraping_infos", ["id", "detail", "audit_status"])))
    return r.groupBy("field", "kind").agg(F.count("*").alias("n"))


@query("p1_kept")
def p1_kept(spark, sf_dir):
    """The announcements without residue."""
    return residue.without_residue(table(spark, sf_dir, "scraping_infos", ["id", "detail", "audit_status"])).select("id", "audit_status")


# ---- problem 2: noise in text from scanned pages


@query("p2_found")
def p2_found(spark, sf_dir):
    return scan.damage(spread(table(spark, sf_dir, "scraping_infos", ["id", "detail"])))


@query("p2_repaired")
def p2_repaired(spark, sf_dir):
    """The text of every damaged announcement in continuous paragraphs."""
    r = scan.repaired(spread(table(spark, sf_dir, "scraping_infos", ["id", "detail"])))
    return r.filter(F.size("kinds") > 0).select("id", "text")


# ---- problem 6: garbled text from wrong character encoding



def host(url: str = "detail_url"):
    """The site of a page: its host without www and m, lower case; '' without a page."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(url))), "^[a-z]+://(?:www\\.|m\\.)?([^/:?#]+)", 1), F.lit(""))



@query("p6_found")
def p6_found(spark, sf_dir):
    return encoding.found(spread(table(spark, sf_dir, "scraping_infos", ["id", "keyword", "detail", "detail_url"])), "id", ["detail", "keyword"], host())


@query("p6_restored")
def p6_restored(spark, sf_dir):
    """The original text of every garbled value, and whether all of it could be recovered."""
    return encoding.restored(spread(table(spark, sf_dir, "scraping_infos", ["id", "keyword", "detail", "detail_url"])), "id", ["detail", "keyword"], host())


# ---- problem 4: variant spellings of names typed by people


def _p4(spark, sf_dir):
    ref = names.reference_list(table(spark, sf_dir, "customer_alias_map", ["alias_pattern", "canonical_customer", "match_type"]))
    a = table(spark, sf_dir, "scraping_infos", ["id", "project_owner"]).select(F.lit("scraping_infos").alias("t"), "id", F.col("project_owner").alias("name"))
    b = table(spark, sf_dir, "sales_lead_confirm", ["id", "customer_name"]).select(F.lit("sales_lead_confirm").alias("t"), "id", F.col("customer_name").alias("name"))
    both = a.unionByName(b).select(F.struct("t", "id").alias("key"), "name")
    return names.linked(both, "key", "name", ref)


@query("p4_found")
def p4_found(spark, sf_dir):
    return _p4(spark, sf_dir).select(F.col("row_id.t").alias("table_name"), F.col("row_id.id").alias("row_id"), F.col("canonical").alias("canonical_customer")).distinct()


@query("p4_variants")
def p4_variants(spark, sf_dir):
    """How many rows write each listed institution in how many other ways."""
    return _p4(spark, sf_dir).groupBy("canonical").agg(F.countDistinct("value").alias("n_spellings"), F.count("*").alias("n_rows"))


# ---- problem 5: text cut off by field limits

P5_FIELDS = ["title", "project_owner", "winning_bidder"]


@query("p5_found")
def p5_found(spark, sf_dir):
    d = spread(table(spark, sf_dir, "scraping_infos", ["id", *P5_FIELDS, "detail_url"]))
    return truncation.judged(d, "id", P5_FIELDS, host()).select("id", "field").distinct()


@query("p5_sites")
def p5_sites(spark, sf_dir):
    """How often each site truncates each field."""
    return truncation.report(table(spark, sf_dir, "scraping_infos", ["id", *P5_FIELDS, "detail_url"]), "id", P5_FIELDS, host())


@query("p5_limits")
def p5_limits(spark, sf_dir):
    """The lengths at which sites cut."""
    v = truncation.values(table(spark, sf_dir, "scraping_infos", ["id", *P5_FIELDS, "detail_url"]), "id", P5_FIELDS, host())
    return truncation.limits(v)


# ---- problem 7: new batches against all history

P7_COLS = ["id", "type", "sub_type", "title", "project_no", "detail_url", "detail", "created_at"]


@query("p7_found")
def p7_found(spark, sf_dir):
    return history.repeats(table(spark, sf_dir, "scraping_infos", P7_COLS)).select("first_id", "id")


@query("p7_last_batch")
def p7_last_batch(spark, sf_dir):
    """The rows of the last thirty days against an index of all rows before them."""
    return history.last_batch(history.identities(table(spark, sf_dir, "scraping_infos", P7_COLS)))


@query("p7_last_titles")
def p7_last_titles(spark, sf_dir):
    """The rows of the last thirty days whose title is nearly that of an earlier row."""
    return history.last_batch(history.title_notices(table(spark, sf_dir, "scraping_infos", ["id", "title", "created_at"])), share=0.8)


# ---- problem 8: encoding with a public tokenizer


@query("p8_ids")
def p8_ids(spark, sf_dir):
    return tokens.encoded(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])))


# ---- problem 9: mixing sources to target weights


def _p9(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    mix = table(spark, sf_dir, "mix_targets")
    # the sizes are used several times: written once, so that no text is encoded again
    return history.cut(tokens.counted(docs.join(mixing.small(mix.select("source").distinct()), "source", "left_semi")), "sizes"), mix


@query("p9_mix")
def p9_mix(spark, sf_dir):
    sizes, mix = _p9(spark, sf_dir)
    return mixing.mixed(sizes, mix)


@query("p9_shares")
def p9_shares(spark, sf_dir):
    """Target and actual share of each source."""
    sizes, mix = _p9(spark, sf_dir)
    return mixing.shares(sizes, mix, mixing.mixed(sizes, mix))


# ---- problem 10: per-document text quality statistics


@query("p10_found")
def p10_found(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return quality.judged(docs, table(spark, sf_dir, "common_words")).filter("kind is not null").select("doc_id", "kind").distinct()


@query("p10_statistics", quality.STATISTICS_SQL)
def p10_statistics(spark, sf_dir):
    return quality.statistics(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "common_words"))


@query("p10_profiles")
def p10_profiles(spark, sf_dir):
    """How many documents are nearest to which profile, and how far from prose they are."""
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    j = quality.judged(docs, table(spark, sf_dir, "common_words"))
    return j.groupBy("profile").agg(F.count("*").alias("n"), F.avg("divergence").alias("divergence"))
