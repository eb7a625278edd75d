import datetime as dt
import json

from pyspark.sql import functions as F

from gazette.functions import html, rules, text
from gazette.operators import digest, ingest, listing, reads, routing, sampling, units
from gazette.sources import documents, sinks
from gazette.streaming import reads as stream_reads


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


MONEY = [
    ("12.5万元", 12_500_000), ("400万1914元", 400_191_400), ("1亿7400万元", 17_400_000_000), ("人民币壹佰叁拾万贰仟柒佰捌拾捌元整(￥1,302,788.00元)", 130_278_800),
    ("一亿零二百一十三万元", 10_213_000_000), ("CNY 3.51 million", 351_000_000), ("RMB 9.9m", 990_000_000), ("527.950200万", 527_950_200), ("８９．５Ｗ", 89_500_000),
    ("不超过299.53万元", 299_530_000), ("0.4727 亿元人民币", 4_727_000_000), ("人民币679.3仟元", 67_930_000), ("3.84百万", 384_000_000), ("44.7343wan元", 44_734_300), ("壹元伍角", 150),
    ("12.5万美元", None), ("2.1万元/人月", None), ("50万元-60万元", None), ("30万至45万元", None), ("0.92折", None), ("85%", None), ("费率0.35‰", None), ("下浮率12.5%", None), ("另行通知", None), ("/", None), ("", None), ("USD 562,000.00", None),
]


def test_amounts_in_many_notations(spark):
    got = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MONEY)], "i int, m string").select("i", units.read_entry(F.col("m"))["fen"].alias("fen")).collect()
    assert {r["i"]: r["fen"] for r in got} == {i: v for i, (_, v) in enumerate(MONEY)}


def test_bare_numbers_take_the_declared_unit(spark):
    rows = [(1, "12.5|3", None, "金额单位：万元"), (2, "12.5", "7", "本公告所列金额以千元计。"), (3, "100", None, None), (4, None, None, "x"), (5, "|5元", "", "（单位：亿元）"), (5, "|5元", "", "（单位：亿元）")]
    d = spark.createDataFrame(rows, "id long, project_budget string, winning_amount string, detail string").withColumn("unit", F.lit("clash")).withColumn("fen", F.lit(0))
    got = {(r["id"], r["field"], r["item_no"]): r["amount_fen"] for r in units.amounts(d).collect()}
    assert got == {(1, "project_budget", 1): 12_500_000, (1, "project_budget", 2): 3_000_000, (2, "project_budget", 1): 1_250_000, (2, "winning_amount", 1): 700_000, (3, "project_budget", 1): 10_000, (5, "project_budget", 2): 500}
    assert units.amounts(d.limit(0)).count() == 0


def test_mixture_flags_a_unit_that_does_not_fit(spark):
    stated = [(i, f"{100 + i}万元", None, "") for i in range(200)]
    odd = [(1000 + i, f"{150 + i}.5", None, "") for i in range(40)]  # yuan by rule, ten thousands by size
    d = spark.createDataFrame(stated + odd, "id long, project_budget string, winning_amount string, detail string")
    a = units.amounts(d).filter("bare").collect()
    assert len(a) == 40 and all(r["uncertain"] and r["fitted_unit"] == "万元" and r["unit"] == "元" for r in a)


def test_amounts_are_stated_without_a_model(spark, monkeypatch):
    """No mixture is fitted where only amounts are asked for, and the mixture changes none."""
    rows = [(i, f"{150 + i}.5|{i}万元", None, "单位：万元" if i % 2 else "") for i in range(40)]
    d = spark.createDataFrame(rows, "id long, project_budget string, winning_amount string, detail string")
    cols = ["id", "field", "item_no", "raw", "unit", "amount_fen"]
    judged = sorted(units.amounts(d).select(*cols).collect(), key=str)
    monkeypatch.setattr(units.UnitMixture, "fit", lambda *_: 1 / 0)
    assert sorted(units.stated(d).select(*cols).collect(), key=str) == judged and judged


def test_figures_of_any_length(spark):
    """Amounts that a bigint of fen holds are exact; longer figures give no row and end no job."""
    raw = ["9" * n for n in range(13, 41)] + ["9" * 12 + "万元", "8" * 30 + "亿元", "7" * 16 + "亿3万元", "0.123456789元", "1e5"]
    d = spark.createDataFrame([(i, r, None, "单位：万元" if i % 2 else None) for i, r in enumerate(raw)], "id long, project_budget string, winning_amount string, detail string")
    got = {r["id"]: r["amount_fen"] for r in units.amounts(d).collect()}
    want = {}
    for i, r in enumerate(raw[:28]):
        fen = int(r) * (10_000 if i % 2 else 1) * 100
        if fen < 2**63:
            want[i] = fen
    assert got == {**want, 28: int("9" * 12) * 1_000_000, 31: 12}


def test_text_functions(spark):
    assert one(spark, "福福建建省省银银", text.fold_doubled) == "福建省银"
    assert one(spark, "福福建建省省", text.fold_doubled) == "福福建建省省"
    assert one(spark, "2026/3/5", text.datetime_text) == "2026-03-05 00:00:00"
    assert one(spark, "2026-03-05 9：07", text.datetime_text) == "2026-03-05 09:07:00"
    assert one(spark, "2026-03-05T09:07", text.datetime_text) == "2026-03-05 00:00:00"
    assert one(spark, "soon", text.datetime_text) is None and one(spark, None, text.datetime_text) is None
    assert one(spark, "某某（集团）股份有限公司杭州分行", text.normal_owner) == "某某杭州"
    assert one(spark, "　\t x \n", text.py_strip) == "x"
    assert one(spark, "[已流标]某项目", text.drop_prefix_tag) == "某项目" and one(spark, "[已流标]", text.drop_prefix_tag) == "[已流标]"
    assert one(spark, "甲|乙，甲 丙/丁", text.split_multi) == ["甲", "乙", "丙", "丁"]
    assert one(spark, "甲/乙", lambda c: text.split_multi(c, slash=False)) == ["甲/乙"]
    assert one(spark, "//a.example/x", text.fix_url) == "https://a.example/x"
    assert one(spark, "中文" * 1000, lambda c: F.size(text.chunks(c, 2048, 20))) == 3
    assert one(spark, "淇℃墭", text.undo_mojibake) == "信托" and one(spark, None, text.undo_mojibake) is None
    assert one(spark, "招标\n公告\n=====\n完", text.join_ocr_lines) == "招标公告\n=====\n完"
    assert one(spark, "2025-05-01", lambda c: text.published_date(c, F.lit("a1202505017"), F.lit(dt.date(2025, 6, 1)))) is None


def test_titles(spark):
    golden = [("中国长城资产管理股份有限公司2026年起两年桌面运维外包服务采购项目评标结果公示", "评标结果公示"), ("[已流标]金华銀行异地互联网数据中心（IDC）业务项目（重新招标）流标公告", "流标"), ("[阳光采购服务平台]宁波銀行基建石材供应商入围项目资格预审评审公示", "公示"), ("中国光大銀行生产环境华为SAN存储设备维保服务采购项目询价公告", "询价"), ("中国銀行潍坊分行选取中心机房値守服务项目（二次）竞争性磋商公告", "竞争性磋商")]
    got = spark.createDataFrame(golden, "t string, want string").select("want", rules.label_of_title(F.col("t"))["label"].alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    assert one(spark, "某谈判结果公示", rules.kind_of_title) == "中标结果" and one(spark, "", rules.kind_of_title) == "" and one(spark, "x", rules.kind_of_title) == "其他"
    assert one(spark, "资格预审公告", rules.normal_method) == "公开招标" and one(spark, "单一来源采购", rules.normal_method) == "单一来源"
    assert one(spark, "硬件设备维保-系统", lambda c: rules.product_class(c, F.lit(""))) == "硬件相关"
    assert one(spark, "x" * 79, rules.short_body) and not one(spark, "x" * 80, rules.short_body) and one(spark, None, rules.short_body)
    assert one(spark, "内容详见附件\n附件下载", rules.shell_body) and not one(spark, "内容详见附件" + "正" * 400, rules.shell_body)


def test_html_tables(spark):
    page = "<p>甲</p><table><tr><td>1</td><th>h</th></tr><tr><td>2<table><tr><td>in</td></tr></table></td></tr></table><script>x</script><p>乙&nbsp;丙</p>"
    r = spark.createDataFrame([(page,), (None,), ("",)], "x string").select(html.structured(F.col("x")).alias("s")).collect()
    assert r[0]["s"]["text_blocks"] == ["甲", "乙 丙"] and r[0]["s"]["tables"][0][0] == ["h", "1"] and r[2]["s"]["tables"] == []
    rows = one(spark, "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", text.html_table)
    assert [list(x) for x in rows] == [["a", "b"], ["c", ""]]
    lines, rows = html.vertical_table(["二、采购内容", "序号", "名称", "1", "服务器", "2", "交换机", "三、其他"], "采购内容", ["序号", "名称"], "^三、")
    assert rows[1:] == [["1", "服务器"], ["2", "交换机"]] and lines[-1] == "三、其他"
    assert html.body_below("头\n详情正文\n收藏\n这里是一段足够长的正文内容在此。\n返回\n招标进展 x") == "这里是一段足够长的正文内容在此。"


def infos(spark):
    t = dt.datetime
    rows = [
        (1, "银行招标公告", "招标公告", "审核通过", "甲银行", "http://a/1", "P1", t(2025, 1, 1, 9), t(2025, 1, 1, 9)),
        (2, "证券中标公告", "中标结果", None, "乙证券股份有限公司", "http://a/2", "P2", t(2025, 1, 2, 9), t(2025, 1, 5, 9)),
        (3, "银行询价", "询价", "待审核", None, "http://a/2", "", t(2025, 1, 3, 9), None),
        (4, None, "", " ", "", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, title string, sub_type string, audit_status string, project_owner string, detail_url string, project_no string, created_at timestamp_ntz, updated_at timestamp_ntz").withColumns({"winning_bidder": F.lit(None).cast("string"), "product_related": F.lit("软件相关"), "published_at": F.col("created_at"), "reserve2": F.lit(None).cast("string"), "type": F.lit("招标公告")})


def test_lists(spark):
    d = infos(spark)
    ids = lambda f, **k: [r["id"] for r in listing.page(d, f, **k).collect()]
    assert ids(listing.ListFilter()) == [4, 2, 1] and ids(listing.ListFilter(audit="pending")) == [3] and ids(listing.ListFilter(audit="all"), size=0) == [4]
    assert ids(listing.ListFilter(), number=9) == [] and ids(listing.ListFilter(sub_type="中标结果")) == [2] and ids(listing.ListFilter(keyword="银_")) == [1]
    f = listing.facets(d, listing.ListFilter(sub_type="招标公告")).first()
    assert (f["tenders"], f["awards"], f["all_kinds"], f["software"]) == (1, 1, 3, 1)
    assert {(r["sub_type"], r["cnt"]) for r in listing.distribution(d, "sub_type").collect()} >= {("(空)", 1)}


def test_digests(spark):
    d = infos(spark)
    assert digest.latest_day(d).first()["day"] == dt.date(2025, 1, 5)
    days = {(r["id"], str(r["day"])[-2:]) for r in digest.days_of(d).collect()}
    assert days == {(1, "31"), (1, "01"), (2, "01"), (2, "02"), (2, "04"), (2, "05")}
    assert [r["id"] for r in digest.snapshot(d, F.lit(dt.date(2025, 1, 1))).collect()] == [2, 1]
    assert digest.search(d, ["@银行", "招标"], ["title", "project_owner"]).count() == 1


def test_routing(spark):
    leads = spark.createDataFrame([(1, "甲银行", "", 1), (2, "甲银行", "张三", None), (3, "乙证券", "李四,王五", 1), (4, "丙", "x", 0), (5, "甲银行", " ", 1)], "id long, customer_name string, sales string, enabled int").withColumns({"created_at": F.lit("2025-01-01").cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    org = spark.createDataFrame([("张三", "u1", None), ("李四", "u2", 0), ("李四", "u0", 0), ("王五", None, 0), ("赵六", "u9", 1)], "user_name string, user_account string, is_deleted int")
    latest = {r["customer_name"]: r for r in routing.latest_sales(leads).collect()}
    assert latest["甲银行"]["sales"] == "张三" and latest["甲银行"]["lead_row_id"] == 5 and latest["甲银行"]["sales_from_row_id"] == 2
    r = routing.resolve(infos(spark), leads)
    assert {(x["owner"], x["how"], x["lead_id"]) for x in r.collect()} == {("甲银行", "exact", 2), ("乙证券股份有限公司", "normal", 3)}
    routes = routing.user_routes(infos(spark), r, org)
    assert {(x["record_id"], x["user_account"]) for x in routes.collect()} == {(1, "u1"), (2, "u0")}
    assert routing.match_rate(infos(spark), r).first()["rate"] == "100.00%"
    a = spark.createDataFrame([("北京甲乙丙丁银行",), ("短",), (None,)], "project_owner string")
    b = spark.createDataFrame([("甲乙丙丁",), ("北京甲乙丙丁银行海淀",)], "customer_name string")
    assert {x["customer"] for x in routing.fuzzy(a, b).collect()} == {"甲乙丙丁", "北京甲乙丙丁银行海淀"}


def test_ingest(spark):
    d = infos(spark)
    assert {r["detail_url"]: r["id"] for r in ingest.settle(d, "detail_url", "id", listing.approved()).collect()} == {"http://a/1": 1, "http://a/2": 2}
    again = {r["id"]: r["outcome"] for r in ingest.outcomes(d, d, listing.approved()).collect()}
    assert again == {1: "duplicate_url", 2: "duplicate_url", 3: "duplicate_url", 4: "inserted"}
    up = ingest.upsert(d.select("id", "title", "created_at", "updated_at"), d.filter("id = 1").select("id", F.lit(None).cast("string").alias("title")), "id", F.lit("2030-01-01").cast("timestamp_ntz"))
    got = {r["id"]: r for r in up.collect()}
    assert got[1]["title"] is None and got[1]["created_at"] is not None and got[1]["updated_at"].year == 2030 and got[2]["title"]
    t = spark.createDataFrame([(1, "a\tb\nc\td\nx\ne\tf"), (2, None)], "id long, text string")
    assert sorted((r["first_line"], r["n_rows"]) for r in ingest.table_rows(t, "id", "text").collect()) == [(0, 2), (3, 1)]
    z = spark.createDataFrame([(1, "甲|乙", "5")], "id long, a string, b string")
    assert [(r["left_value"], r["right_value"]) for r in ingest.zipped(z, "id", "a", "b").orderBy("pos").collect()] == [("甲", "5"), ("乙", "—")]


def test_reads(spark):
    t = dt.datetime
    log = spark.createDataFrame([(1, "D1", 7, "u1", t(2025, 1, 1), 5), (2, "D1", 7, "u1", t(2025, 1, 2), None), (3, "D2", 7, "u2", t(2025, 1, 3), 90000), (4, "D9", 8, None, None, -4)], "id long, dispatch_id string, record_id long, reader_userid string, read_at timestamp_ntz, dwell_seconds int")
    disp = spark.createDataFrame([("D1", " ABC ", "u1", "SENT"), ("D2", "abc", "u3", "FAILED")], "dispatch_id string, digest_token string, receiver_userid string, send_status string")
    s = reads.sent_reads(log, disp)
    st = reads.read_state(s, "token", "record_id", "reader_userid").first()
    assert (st["token"], st["dwell"], st["read_at"].day) == ("abc", 5, 2)
    roster = spark.createDataFrame([("abc", 7, "u1"), ("abc", 7, "u5"), ("abc", 8, "u5")], "token string, record_id long, reader_userid string")
    f = reads.funnel(roster, reads.read_state(s, "token", "record_id", "reader_userid")).first()
    assert (f["total"], f["seen"], f["unseen"], f["pct"]) == (3, 1, 2, 33.3)
    assert reads.funnel(roster.limit(0), reads.read_state(s, "token", "record_id", "reader_userid")).first()["pct"] == 0.0
    assert reads.best_read(log, "record_id").filter("record_id = 7").first()["dwell"] == 86400


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime
    ev = [("dwell", "D", 1, "u", t(2025, 1, 1, 0, 0, 1), 50), ("mark", "D", 1, "u", t(2025, 1, 1, 0, 0, 2), None), ("dwell", "D", 1, "u", t(2025, 1, 1, 0, 0, 3), 20), ("dwell", "D", 1, "u", t(2025, 1, 1, 0, 0, 4), 10), ("mark", "D", 2, "v", t(2025, 1, 1, 0, 1), None), ("dwell", "D", 2, "v", t(2025, 1, 1, 0, 2), 90000), ("dwell", "D", 3, "w", t(2025, 1, 1), 5), ("open", "D", None, "u", t(2025, 1, 1), None), ("overview", "D", None, "u", t(2025, 1, 2), None)]
    schema = "event_type string, dispatch_id string, record_id long, reader_userid string, ts timestamp_ntz, dwell_seconds int"
    d = spark.createDataFrame(ev, schema)
    want = {(r["record_id"], r["dwell"]) for r in stream_reads.dwell_batch(d).collect()}
    assert want == {(1, 20), (2, 86400)}
    o = stream_reads.opens(d).first()
    assert (o["read_count"], o["last_read"].day) == (1, 2)
    for k in range(0, len(ev), 3):
        spark.createDataFrame(ev[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    s = stream_reads.dwell_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream_reads.run_available(s, lambda b, n: got.update({r["record_id"]: r["dwell"] for r in b.collect()}), str(tmp_path / "ck"))
    assert {(k, v) for k, v in got.items()} == want


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "output" / "2025-01-01" / "银行"
    root.mkdir(parents=True)
    (root / "a.json").write_text(json.dumps({"title": "甲", "url": "u", "content": "正文"}), encoding="utf-8")
    (root / "b.json").write_text(json.dumps({"title": "甲", "url": "u"}), encoding="utf-8")
    (root / "bad.json").write_text("{", encoding="utf-8")
    (root / "汇总.json").write_text("{}", encoding="utf-8")
    d = documents.json_documents(spark, str(tmp_path / "output")).cache()
    assert d.count() == 3 and d.filter("bad").count() == 1 and {r["keyword"] for r in d.collect()} == {"银行"} and documents.unique_items(d).count() == 1
    s = d.filter("title is not null").limit(1).select(sinks.saved_text(kind="info_type").alias("value"))
    r = s.select(*documents.parse_saved(F.col("value"))).first()
    assert r["title"] == "甲" and r["body"] in ("正文", "")or r["body"]
    leads = spark.createDataFrame([("甲", "张")], "customer_name string, sales string")
    sinks.table_file(leads, str(tmp_path / "csv"))
    assert documents.lead_list(spark, str(tmp_path / "csv")).first()["customer_name"] == "甲"
    token = "a" * 32
    sinks.pack(spark.createDataFrame([(1, "t"), (2, "u")], "id long, title string"), "2025-01-01", "x", token, str(tmp_path / "packs"))
    part = next((tmp_path / "packs" / token).glob("part-*.json"))
    part.rename(part.parent / "manifest.json")
    m = documents.manifests(spark, str(tmp_path / "packs")).first()
    assert m["token"] == token and [i["id"] for i in m["items"]] == [2, 1]
    p = str(tmp_path / "routes")
    sinks.replace_partition(spark.createDataFrame([("t1", 1), ("t2", 2)], "token string, n int"), p, "token")
    sinks.replace_partition(spark.createDataFrame([("t1", 5)], "token string, n int"), p, "token")
    assert {(r["token"], r["n"]) for r in spark.read.parquet(p).collect()} == {("t1", 5), ("t2", 2)}


def test_bounded_sample(spark):
    d = spark.range(5000)
    a = [r["id"] for r in sampling.bounded_sample(d, F.col("id"), 100).collect()]
    b = [r["id"] for r in sampling.bounded_sample(d.repartition(7), F.col("id"), 100).collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)
    twice = d.unionByName(d).unionByName(d)
    assert sorted(a) == sorted(r["id"] for r in sampling.bounded_sample(twice, F.col("id"), 100, distinct=True).collect())
