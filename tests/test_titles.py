import datetime as dt
import json

from pyspark.sql import functions as F

from gazette.functions import titles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_titles(spark):
    assert one(spark, "某项目招标公告 - 某某采购与招标网", titles.document_title) == "某项目招标公告"
    assert one(spark, "首页", titles.portal_heading) and one(spark, None, titles.portal_heading) and not one(spark, "某某项目招标公告", titles.portal_heading)
    assert one(spark, "项 目 名 称：数据 中台建设项目\n其他", titles.title_in_body) == "数据中台建设项目"
    assert one(spark, "首页", lambda c: titles.best_title(c, [F.lit("详情"), F.lit("某银行核心系统采购公告")], F.lit(""))) == "某银行核心系统采购公告"
    assert one(spark, '{"id":"77","title":"甲项目"}', lambda c: titles.embedded_title(c, F.lit("77"))) == "甲项目"


def test_records(spark):
    assert one(spark, "http://a/x?a=1&b=2#f", lambda c: titles.with_parameter(c, "a", F.lit("9"))) == "http://a/x?a=9&b=2#f"
    assert one(spark, "http://a/x", lambda c: titles.with_parameter(c, "a", F.lit("9"))) == "http://a/x?a=9"
    assert one(spark, '```json\n[{"a": "x"}, {"a": "y"}]\n```', lambda c: titles.answer(c, "a: string"))["a"] == "x"
    assert one(spark, '{"a": "z"}', lambda c: titles.answer(c, "a: string"))["a"] == "z" and one(spark, None, lambda c: titles.answer(c, "a: string")) is None
    assert one(spark, "<table><tr><td class='cell x'>", titles.table_like) == 4
    r = json.loads(one(spark, "项目名称：甲\n乙项目。\n日期：2025年1月3且\n联系电话：010-1", titles.paper_record))
    assert r["项目名称"] == "甲乙项目" and r["发布日期"] == "2025年1月3日" and r["联系电话"] == "010-1"
    assert one(spark, "内容详见附件\n附件下载", lambda c: titles.best_content([c, F.lit("长" * 90)])) == "长" * 90


def test_days(spark):
    d = dt.date(2025, 3, 1)
    assert titles.day_of("昨天", d) == dt.date(2025, 2, 28) and titles.day_of("2025-01-02", d) == dt.date(2025, 1, 2) and titles.day_of("soon", d) is None
    got = spark.createDataFrame([(dt.datetime(2025, 1, 1, 20),)], "t timestamp").select(titles.shanghai_text(F.col("t")).alias("s")).first()["s"]
    assert got == "2025-01-02 04:00:00"
