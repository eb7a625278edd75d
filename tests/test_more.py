import datetime as dt
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gazette.functions import html, rules, titles
from gazette.operators import cascade, forward, reads, review, routing
from gazette.session import cut, remove
from gazette.sources import documents, sinks

PRODUCTS = [
    ("某行餐饮平台采购", "采购人：某银行", ""), ("某行培训平台采购", "采购人：某银行", "软件相关"), ("某学院培训平台采购", "采购人：某学院", ""), ("某银行培训平台采购项目", "正文", "软件相关"), ("平台相关设备采购", None, "硬件相关"), ("核心系统维保", None, "软件相关"),
    ("硬件设备维保-系统第三方", None, "硬件相关"), ("机房搬迁", "含系统迁移", "硬件相关"), ("多测合一系统", None, ""), ("项目", "互联网专线租用", ""), ("大模型设备扩容", None, "硬件相关"), ("软件服务器及配件采购", None, "硬件相关"), ("", "", ""), (None, None, ""), ("无关", "采购数据库一套", "软件相关"),
]


def test_product_rules(spark):
    d = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(PRODUCTS)], "i int, t string, x string")
    got = {r["i"]: r["p"] for r in d.select("i", rules.product_related(F.col("t"), F.col("x")).alias("p")).collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(PRODUCTS)}


def test_gates_and_bodies(spark):
    d = spark.createDataFrame([("核心系统招标", "系统"), ("核心系统终止", "系统"), ("核心系统招标", "银行"), ("食堂承包", "食堂"), (None, None)], "t string, k string")
    assert [r["g"] for r in d.select(rules.title_gate(F.col("t"), ["终止"], F.col("k")).alias("g")).collect()] == ["open", "excluded", "no_keyword", "not_tech", "not_tech"]
    b = spark.createDataFrame([(rules.SCAN_BODY + " x",), ("x" * 90,), ("点击下载" + "x" * 90,), ("点击下载" + "x" * 1300,), ("点击下载招标进展" + "x" * 1300,), (None,)], "x string")
    got = [(r["a"], r["b"]) for r in b.select(rules.scan_body(F.col("x")).alias("a"), rules.wants_attachment(F.col("x")).alias("b")).collect()]
    assert got == [(True, True), (False, False), (False, True), (False, False), (False, True), (False, True)]


def test_tables_are_put_back(spark):
    six = html.LAYOUTS[0][1]
    text = "一、概况\n二、采购内容\n" + "\n\n".join(six) + "\n1包\n货物\n服务器\n2U\n台\n3\n三、其他\n" + "七、中标结果\n序号\n中标供应商名称\n1\n甲公司\n2\n乙公司\n八、完\n四、评审结果\n投标报价\n序号 中标单位名称\n（人民币元，含税）\n1 丙公司 1,200.00\n2 丁公司 900\n五、完"
    fixed, tables = html.repair_tables(text)
    assert [t[0] for t in tables] == [six, ["序号", "中标供应商名称"], html.REVIEW_HEADER] and tables[0][1] == ["1包", "货物", "服务器", "2U", "台", "3"] and tables[1][2] == ["2", "乙公司"] and tables[2][2] == ["2", "丁公司", "900"]
    assert "| 1 | 甲公司 |" in fixed and "八、完" in fixed and "五、完" in fixed
    assert html.repair_tables(text, known=tables)[1] == [] and html.repair_tables("四、成交内容\n序号\n采购内容\n数量\n成交供应商\n1\n缺")[1] == []
    twice = "三、中标结果\n序号\n说明\n七、中标结果\n序号\n中标供应商名称\n1\n甲公司"
    assert html.repair_tables(twice)[1] == [[["序号", "中标供应商名称"], ["1", "甲公司"]]]
    d = spark.createDataFrame([(text,), (None,), ("",)], "x string")
    assert len(d.select(html.repaired_tables(F.col("x")).alias("y")).first()["y"]["tables"]) == 3 and d.select(html.repaired_tables(F.col("x"))).count() == 3
    assert [r["y"] for r in spark.createDataFrame([("公告正文\n收藏\n内容一二三四五六七八九十一二三四五六\n返回",), (None,)], "x string").select(html.body_column(F.col("x")).alias("y")).collect()] == ["内容一二三四五六七八九十一二三四五六", None]


def test_recipients_and_tickets(spark):
    org = spark.createDataFrame([("甲", "a.one", 0), ("乙", "b", 1)], "user_name string, user_account string, is_deleted int")
    d = spark.createDataFrame([(1, "甲，zhang_san|乙；丙x/丁"), (2, None), (3, " ")], "id long, c string")
    got = {(r["key"], r["name"], r["account"], r["how"]) for r in forward.recipients(d, "id", "c", org).collect()}
    assert got == {(1, "甲", "a.one", "directory"), (1, "zhang_san", "zhang_san", "account"), (1, "乙", None, "missing"), (1, "丙x/丁", "x", "letters")}
    items = spark.createDataFrame([(1, 70)], "key long, record_id long")
    to = forward.recipients(d, "id", "c", org, {"乙": "yi"})
    t = forward.tickets(items, to, F.lit("t"), F.lit(dt.datetime(2025, 1, 1)))
    assert {r["to_userid"] for r in t.collect()} == {"a.one", "zhang_san", "yi", "x"} and t.select("ticket").distinct().count() == 4


def test_cascade(spark):
    leads = spark.createDataFrame(
        [(1, "某某商业银行股份有限公司", "甲", 1, None), (2, "某某商业银行", "乙", 0, None), (3, "大地国际信托投资公司总部", "丙", None, dt.datetime(2025, 1, 1)), (4, "大地国际信托投资公司", " ", 1, None), (5, "大地国际信托投资公司总", "丁", 1, dt.datetime(2025, 2, 1))],
        "id long, customer_name string, sales string, enabled int, updated_at timestamp_ntz",
    ).withColumn("created_at", F.col("updated_at"))
    items = spark.createDataFrame([(1, "银行", "谁"), (2, "x", "某某商业银行股份有限公司"), (3, "x", "某某商业银行"), (4, None, "大地国际信托投资公司"), (5, "x", None), (6, "x", "无")], "id long, keyword string, project_owner string")
    got = {r["id"]: (r["sales"], r["how"]) for r in cascade.route(items, leads, {"银行": "值班"}, loose=True).collect()}
    assert got == {1: ("值班", "keyword"), 2: ("甲", "exact"), 3: ("甲", "normal"), 4: ("丙", "part"), 5: (None, "none"), 6: (None, "none")}
    newest = {r["id"]: r["sales"] for r in cascade.route(items, leads, source="newest").collect()}
    assert newest[4] == "丁" and newest[3] == "甲" and newest[6] is None
    stored = cascade.stored_routes(spark.createDataFrame([(7, ["u1", "u2"], ["甲"], " "), (0, ["u1"], [], "c")], "id long, users array<string>, labels array<string>, customer string"), F.lit("t"), spark.createDataFrame([("u2", "乙")], "user_account string, display_name string"), F.lit(1))
    assert {(r["record_id"], r["presale_userid"], r["presale_display_name"], r["canonical_customer"]) for r in stored.collect()} == {(7, "u1", "甲", None), (7, "u2", "乙", None)}


def test_packs(spark, tmp_path):
    packs = spark.createDataFrame([("a" * 32, "2025-01-01", "1", [(1, "x", "s", "o"), (2, "y", "s", "o")]), ("b" * 32, "2025-01-02", "2", [])], "token string, digest_date string, generated_at string, items array<struct<id: bigint, title: string, sub_type: string, project_owner: string>>")
    wait = packs.filter(F.col("token").startswith("a")).select("token")
    assert [(r["token"][0], r["item_count"], r["pinned"]) for r in review.pack_list(packs, wait).collect()] == [("a", 2, 1), ("b", 0, 0)]
    assert [len(r["items"]) for r in review.without_item(packs, F.lit("a" * 32), F.lit(1)).orderBy("token").collect()] == [1, 0]
    sinks.repack(packs, f"{tmp_path}/packs")
    d = spark.createDataFrame([(1, "审核通过", None), (2, None, None)], "id long, audit_status string, updated_at string")
    assert {(r["id"], r["audit_status"], r["updated_at"]) for r in review.set_status(d, spark.createDataFrame([(2,)], "id long"), "待审核", F.lit("now")).collect()} == {(1, "审核通过", None), (2, "待审核", "now")}
    users = spark.createDataFrame([("u1", "甲,乙", 3), ("u2", "丙", 1)], "user_account string, owners string, item_count long")
    sent = review.dispatch_rows(users, F.lit("t"), F.lit("n"), spark.createDataFrame([("u2", "down")], "user_account string, send_error string"))
    assert {(r["receiver_userid"], r["send_status"], r["send_error"]) for r in sent.collect()} == {("u1", "SENT", None), ("u2", "FAILED", "down")}
    page = sinks.summary_page(users, "t", ["user_account", "owners"])
    assert page.count("<tr>") == 3
    with pytest.raises(ValueError):
        sinks.summary_page(users, "t", ["owners"], most=1)
    sinks.trace(users, "sent", F.lit("now"), f"{tmp_path}/trace")
    assert spark.read.json(f"{tmp_path}/trace").count() == 2 and sinks.migrated(d, {"id": "long", "n": "int"}).columns[-1] == "n"


def test_paper_fields(spark):
    t = "受某银行（以下简称）委托，某代理（招标代理机构）发布。\n项目名称：核心系统。\n编号：GXTC-A-123\n资金来源：自筹，已落实\n发布日期：2025年3月5且\n项目概述：建设一套。\n电话：0571-1"
    import json

    got = json.loads(spark.createDataFrame([(t,)], "x string").select(titles.paper_record(F.col("x")).alias("y")).first()["y"])
    assert got["招标人"] == "某银行" and got["资金来源"] == "自筹" and got["项目概述"] == "建设一套" and got["招标编号"] == "GXTC-A-123" and got["发布日期"].endswith("5日") and got["联系电话"] == "0571-1"


def test_cut_and_remove(spark):
    d = cut(spark.range(3))
    assert d.count() == 3
    remove(d)
    remove(spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(d._cut_at).count()


def test_a_broken_subpackage_is_an_error(tmp_path):
    """Only a subpackage that is not there is passed over."""
    code = """import importlib, sys
sys.path.insert(0, ".")
real = importlib.import_module
def fake(n, *a):
    if n == "gazette.llm.queries":
        raise ModuleNotFoundError("x", name=NAME)
    return real(n, *a)
importlib.import_module = fake
import __spark_entry__ as e
print(len(e.queries()) > 90)
"""
    run = lambda name: subprocess.run([sys.executable, "-c", code.replace("NAME", repr(name))], capture_output=True, text=True)
    assert run("gazette.llm").stdout.strip() == "True" and "ModuleNotFoundError" in run("regex").stderr


def test_outside_pairs_no_records_with_tokens(spark):
    """A receiver of many tokens with many routes: the reads alone are looked up, and the rows are those of the triples."""
    n, logs = 20_000, "id long, dispatch_id string, record_id long, reader_userid string"
    disp = spark.range(n).select(F.concat(F.lit("D"), "id").alias("dispatch_id"), F.concat(F.lit(" T"), "id").alias("digest_token"), F.lit("u1").alias("receiver_userid"))
    routes = spark.range(n).select(F.col("id").alias("record_id"), F.lit("u1").alias("user"))
    rows = [(1, "D1", 5, "u1"), (2, "D1", 5, "u2"), (3, "D1", n, "u1"), (4, "D9999999", 5, "u1"), (5, None, 5, "u1"), (6, "D2", None, "u1"), (7, "D2", 5, None), (1, "D1", 5, "u1"), (8, f"D{n - 1}", n - 1, "u1")]
    out = reads.outside(spark.createDataFrame(rows, logs), disp, routes)
    assert {(r["id"], r["token"]) for r in out.collect()} == {(2, "t1"), (3, "t1"), (4, ""), (5, ""), (6, "t2"), (7, "t2")}
    small = disp.filter("dispatch_id in ('D1', 'D2', 'D3')").unionByName(disp.filter("dispatch_id = 'D1'").withColumns({"dispatch_id": F.lit("X1"), "receiver_userid": F.lit("u2")}))
    r2 = spark.createDataFrame([(5, "u1"), (5, "u2"), (6, "u1"), (6, "u1")], "record_id long, user string")
    got = sorted(r["id"] for r in reads.outside(spark.createDataFrame([(1, "D1", 5, "u1"), (2, "D1", 5, "u2"), (3, "D2", 5, "u2"), (4, "D3", 6, "u1"), (5, "X1", 6, "u2")], logs), small, r2).collect())
    assert got == [3, 5]
