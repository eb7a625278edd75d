import base64
import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import encoding, history, mixing, names, quality, residue, scan, tokens, truncation
from gazette.session import cut

TOKENIZERS = tokens.FOLDER


# ---------------------------------------------------------------- problem 1

CASES = [
    ("项目名称：____\n项目编号：____\n采购人:____\n预算金额:____", "template"),
    ("首页 > 招标公告 > 正文\n2025年机房（一期）测试服务项目\n数据库连接失败，请返回首页重试\n流水号 20c5241c", "message"),
    ("采购人：@@buyer@@  开标时间：@@openTime@@  联系人：@@contact@@", "template"),
    ("正文 xxx 正文 demo test aaa 正文 test 123", "filler"),
    ("（样例）标题文字占位文本\n模板标题文字示例文字", "filler"),
    ("You need to enable JavaScript to run this app.", "message"),
    ("java.lang.IllegalStateException: no content\n\tat app.Detail.load(Detail.java:838)", "message"),
    ("Fintor sedulo abrevit tolvere lorem tolvere umbrio tolvere abrevit palude lorem fintor ipsum.", "filler"),
    ("本项目有效投标人不足三家，流标。", None), ("内容详见附件\n附件下载", None), ("因故终止，特此公告。", None), (None, None), ("  \n ", None), ("", None),
    ("某银行就2025年度项目组织采购，欢迎符合条件的供应商参加。\n项目编号：A1\n附：投标函格式\n致：____（采购人名称）\n我方愿以人民币（大写）____元的总报价承担本项目，工期____日历天。\n供应商须设有常驻服务机构。", None),
    ("评审工作已经结束，现将结果予以公示。\n项目编号：A1\n前端须兼容未启用脚本的浏览器，并给出“请启用JavaScript”提示。\n投标人应具备同类项目实施案例不少于3个，并提供合同关键页复印件。", None),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_residue_kinds(text, kind):
    assert residue.classify(text) == kind


def test_residue_rows(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate([(CASES[0][0], "审核通过"), (None, "{{audit_status}}"), ("好的公告。" * 9, "XX状态"), ("好的公告。" * 9, None), (CASES[0][0], "")])]
    d = spark.createDataFrame(rows, "id long, detail string, audit_status string").withColumn("kind", F.lit("clash")).withColumn("field", F.lit(1))
    assert {(r["id"], r["field"]) for r in residue.residue(d).collect()} == {(0, "detail"), (1, "audit_status"), (2, "audit_status"), (4, "detail")}
    assert [r["id"] for r in residue.without_residue(d).collect()] == [3] and residue.residue(d.limit(0)).count() == 0


def test_residue_reads_texts_of_many_sentences(spark):
    texts = ["这里是正文内容测试数据。" * 5, "敬请期待。" * 6, "待补充；" * 6, "采购人：____；\n编号：____；\n预算：____；\n日期：____；", "好的公告。" * 9, "项目结果公示如下；供应商应提供服务；交付物包括源代码；本项目不接受联合体投标。"]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, detail string, audit_status string")
    want = {i for i, t in enumerate(texts) if residue.classify(t)}
    assert {0, 1, 2, 3} <= want and 5 not in want
    assert {r["id"] for r in residue.residue(d).collect()} == want
    assert {r["id"] for r in residue.without_residue(d).select("id").collect()} == set(range(len(texts))) - want


# ---------------------------------------------------------------- problem 2

SENTENCES = ["系统应提供gateway、middleware以及配套的gateway服务，并支持middleware场景下的自动切换。", "供应商每年应开展3次recovery演练，演练报告须附encryption日志与整改建议。", "投标人应具备同类项目实施案例不少于5个，并提供合同关键页复印件。", "近三年内无重大违法记录，且未被列入失信被执行人名单。", "本项目不接受联合体投标，不允许转包和分包。", "交付物包括源代码、部署手册、deployment测试报告等。"]


def clean_texts(n=400, seed=1):
    rnd = random.Random(seed)
    return ["某银行就2025年度项目组织采购，欢迎符合条件的供应商参加。\n项目编号：AB2025%06d\n" % rnd.randrange(10**6) + "".join(rnd.choices(SENTENCES, k=5)) + "\n联系人：甲先生\n联系电话：0999-555%04d" % rnd.randrange(10**4) for _ in range(n)]


@pytest.fixture(scope="module")
def scan_model():
    return scan.ScanModel(clean_texts())


def test_scan_round_trip(scan_model):
    texts = clean_texts(60, seed=9)
    rnd = random.Random(3)
    damaged = ["\n".join(scan._wrap(t, rnd)[0]) for t in texts]
    fixed = scan_model.repair(damaged)
    squash = lambda t: "".join(t.split())
    assert sum(squash(f) == squash(t) for (f, _), t in zip(fixed, texts)) >= 57
    assert all("hyphen" in k for (_, k), d in zip(fixed, damaged) if "-\n" in d and any(len(x) > 1 and x[-1] == "-" and x[-2].isalpha() for x in d.split("\n")))


def test_scan_characters(scan_model):
    texts = clean_texts(80, seed=11)
    bad = [t.replace("供应商每年应", "洪应商每年庄", 1).replace("本项目", "夲项目", 1) for t in texts]
    hit = [i for i, (a, b) in enumerate(zip(texts, bad)) if a != b]
    out = scan_model.repair(bad)
    assert sum(out[i][0] == texts[i] and out[i][1] == ["ocr"] for i in hit) >= 0.95 * len(hit)
    assert not any(k for _, k in scan_model.repair(texts))


def test_scan_furniture(scan_model):
    page = ["招标文件（正式版）", "系统应提供gateway、middleware以及配套的", "gateway服务，并支持middleware场景下", "招标文件（正式版）", "第 2 页 共 9 页", "的自动切换。供应商每年应开展3次演练，演练报", "告须附encryption日志与整改建议，近三年内无重", "招标文件（正式版）", "第 3 页 共 9 页", "大违法记录。"]
    (text, kinds), (same, none) = scan_model.repair(["\n".join(page), "设备数量如下：\n服务器\n12\n交换机\n8\n本公告以最新版本为准。"])
    assert set(kinds) == {"header", "page"} and "招标文件" not in text and "页" not in text and not none
    assert scan_model.repair([None, "", "  ", "x"]) == [(None, []), ("", []), ("  ", []), ("x", [])]


def test_scan_furniture_of_all_forms():
    """Every form the detection knows reaches it: counted running lines, numbers in brackets, texts of few lines."""
    body = ["系统应提供gateway、middleware以及配套的gateway服务", "并支持middleware场景下的自动切换，供应商每年应开展", "三次演练，演练报告须附encryption日志与整改建议，近", "年内无重大违法记录，且未被列入失信被执行人名单，投", "标人应具备同类项目实施案例，并提供合同关键页复印件", "，本项目不接受联合体投标，也不允许转包和分包。"]
    title = "某行人脸识别终端运维外包服务项目    %d"
    kept, header, page = scan.furniture("\n".join([title % 4, *body[:3], title % 5, *body[3:], title % 6]))
    assert kept == body and header and page
    for mark in ("[3]", "（ 3 ）", "共 9 页 第 3 页", "第 3 页"):
        assert scan.furniture("\n".join([*body[:3], mark, *body[3:]])) == (body, False, True)
        assert scan.furniture("\n".join([body[0], mark, body[1]])) == (body[:2], False, True)
    assert scan.furniture("\n".join(body)) == (body, False, False) and scan.furniture(title % 4) == ([title % 4], False, False)


def test_scan_rn_for_m_anywhere_in_a_word():
    reader = scan.Reader()
    reader.words = {"platform", "middleware", "modern"}
    assert reader.unsplit("系统应提供platforrn、rniddleware与modern服务。") == "系统应提供platform、middleware与modern服务。"


def test_scan_rows(spark):
    rows = [(i, t) for i, t in enumerate(clean_texts(150))] + [(900, None), (901, ""), (902, clean_texts(1)[0].replace("投标人", "役标人")), (903, "长" * 60000)]
    d = spark.createDataFrame(rows, "id long, detail string").withColumn("kind", F.lit(0))
    got = {(r["id"], r["kind"]) for r in scan.damage(d).collect()}
    assert got <= {(902, "ocr")} and scan.repaired(d).count() == len(rows) and scan.damage(d.limit(0)).count() == 0


def wrapped_token_by_token(text, rnd):
    """What `scan._wrap` does, the slow way."""
    width, hyphens = rnd.choice([36, 40, 44, 48, 52, 56, 60, 64, 72]), rnd.random() < 0.5
    lines, todo = [], []
    for para in text.split("\n"):
        if not para.strip():
            continue
        cur, n = "", 0
        for tok in re.findall(r"[A-Za-z]+|\s|.", para):
            k = scan._width(tok)
            if n + k > width and cur:
                if hyphens and len(tok) > 5 and tok.isalpha() and tok.isascii() and width - n > 3:
                    cut = max(2, width - n - 1)
                    lines.append(cur + tok[:cut] + "-")
                    todo.append(scan.DROP)
                    cur, n = tok[cut:], len(tok) - cut
                    continue
                lines.append(cur.rstrip())
                todo.append(scan.SPACE if cur.endswith(" ") or tok == " " else scan.JOIN)
                cur, n = ("", 0) if tok == " " else (tok, k)
                continue
            cur, n = cur + tok, n + k
        lines.append(cur)
        todo.append(scan.KEEP)
    return lines, todo


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["中文", "，", "。", "word", "internationalization", "x" * 90, " ", "  ", "\u3000", "\t", "\n", "ŝ", "😀", "-", "12"]), max_size=120), st.integers(0, 50))
def test_scan_wraps_as_token_by_token(parts, seed):
    text = "".join(parts)
    assert scan._wrap(text, random.Random(seed)) == wrapped_token_by_token(text, random.Random(seed))


def test_scan_judges_clean_texts_once(spark, monkeypatch):
    """The costly patterns of `_clean` are not run again for the words and for the evidence, but once, for a table that both read."""
    plans = {}
    monkeypatch.setattr(scan, "cut", lambda d, name="step": plans.setdefault(name, d) and cut(d, name))
    d = spark.createDataFrame(list(enumerate(clean_texts(60))), "id long, detail string")
    scan.train(d)
    judged = {k: "{10,}" in x._jdf.queryExecution().optimizedPlan().toString() for k, x in plans.items()}
    assert judged == {"clean": True, "words": False, "evidence": False}


def test_scan_learns_from_all_rows(spark):
    """Words, characters and contexts are counted over all clean texts, whatever the shards."""
    texts = clean_texts(1500, seed=1) + [t.replace("middleware", "orchestrator") for t in clean_texts(6000, seed=2)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, detail string")
    model, same = scan.train(d), scan.ScanModel(texts)
    assert model.reader.words == same.reader.words and model.joiner.words == same.joiner.words and model.joiner.w == same.joiner.w
    assert (model.reader.chars == same.reader.chars).all() and (model.reader.seen == same.reader.seen).all() and np.allclose(model.reader.w, same.reader.w)
    # one shard or many: the same repairs
    bad = [t.replace("供应商每年应", "洪应商每年庄", 1).replace("本项目", "夲项目", 1) for t in clean_texts(40, seed=5)]
    assert model.repair(bad) == scan.train(d, shard=60).repair(bad) and all(k == ["ocr"] for t, (_, k) in zip(bad, model.repair(bad)) if "夲" in t or "洪" in t)
    got = scan.evidence(texts, model.joiner)
    assert sum(got["char"].values()) >= sum(map(len, texts)) and len({r["key"] for r in spark.createDataFrame([(k,) for k in got["place"]], "key string").collect()}) == len(got["place"])


# ---------------------------------------------------------------- problem 4

REFERENCE = [("翡澳银行", ["翡行"]), ("砚崖农村信用社联合社", []), ("珞屿银行股份有限公司", ["珞屿银行"]), ("芷洲证券", []), ("焱坳金融租赁", []), ("Hadrelle Bank (China)", ["HadreB"])]


def brute_near(text, form, k):
    """Smallest distance (with transpositions) of form to a head of text, and the head's length, by full dynamic programming."""
    n, m = len(text), len(form)
    d = np.zeros((m + 1, n + 1), int)
    d[:, 0], d[0, :] = np.arange(m + 1), np.arange(n + 1)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (form[i - 1] != text[j - 1]))
            if i > 1 and j > 1 and form[i - 1] == text[j - 2] and form[i - 2] == text[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return {(j, int(d[m, j])) for j in range(n + 1) if d[m, j] <= k}


@given(st.text(alphabet="甲乙丙银行", min_size=0, max_size=7), st.lists(st.text(alphabet="甲乙丙银行", min_size=2, max_size=5), min_size=1, max_size=6, unique=True))
@settings(max_examples=150, deadline=None)
def test_trie_equals_brute_force(text, forms):
    trie = names.Trie([(f, f, 1) for f in forms])
    got = {(name, j, e) for name, e, _, j in trie.near(text, 1)}
    assert got == {(f, j, e) for f in forms for j, e in brute_near(text, f, 1)}


@pytest.mark.parametrize(
    "value,want",
    [("翡澳銀行", "翡澳银行"), ("斐澳银行霜林分行", "翡澳银行"), ("翡 澳 银 行", "翡澳银行"), ("翡行", "翡澳银行"), ("澳翡银行", "翡澳银行"), ("松涛分行-珞屿银行", "珞屿银行股份有限公司"), ("（科技部）砚崖农信社", "砚崖农村信用社联合社"), ("砚崖农村信用联社合社", "砚崖农村信用社联合社"), ("珞屿银行股份限有公司月牙", "珞屿银行股份有限公司"), ("止洲证券", "芷洲证券"), ("The Hadrlele Bank, China", "Hadrelle Bank (China)"), ("HADRELLE BANK (CHINA) LIMITED", "Hadrelle Bank (China)"), ("Feiao Bank Co., Ltd.", "翡澳银行"), ("Yanya Rural Credit Union", "砚崖农村信用社联合社"), ("焱坳证券", None), ("翡塘证券", None), ("某金融机构", None), ("/", None), ("见公告", None), ("淙桥村镇银行", None)],
)
def test_names(value, want):
    trie = names.Trie([(f, c, k) for c, a in REFERENCE for f, k in names.forms(c, a)])
    got = names.link(value, trie)
    assert (got[0] if got else None) == want


def test_names_rows_and_shards(spark):
    ref = spark.createDataFrame(REFERENCE, "canonical string, aliases array<string>")
    vals = [(1, "斐澳银行"), (2, "翡澳银行"), (3, None), (4, " "), (5, "斐澳银行"), (6, "淙桥村镇银行"), (7, "Bank Hadrelle (China)")]
    d = spark.createDataFrame(vals, "id long, name string").withColumn("canonical", F.lit("clash"))
    want = {(1, "翡澳银行"), (5, "翡澳银行"), (7, "Hadrelle Bank (China)")}
    assert {(r["row_id"], r["canonical"]) for r in names.linked(d, "id", "name", ref).collect()} == want
    v = d.select(F.col("name").alias("value"))
    whole, cut = ({(r["value"], r["canonical"]) for r in names.links(v, ref, n).collect()} for n in (50_000, 20))
    assert whole == cut and names.linked(d.limit(0), "id", "name", ref).count() == 0


def test_names_do_not_depend_on_shards(spark):
    """Ties of errors, of lengths, and forms of which one is longer, in one trie, in two shards and in many."""
    listed = [("蓝海银行股份有限公司", ["蓝海银行"]), ("蓝海银行上海分行", []), ("翡澳银行", ["翡行"]), ("翡岭银行", ["翡行"]), *REFERENCE[1:]]
    ref = spark.createDataFrame(listed, "canonical string, aliases array<string>")
    vals = ["蓝海银行上海分行科技部", "蓝海银行", "监海银行", "海蓝银行股份有限公司", "翡行", "翡澳银行", "斐澳银行", "澳银行", "松涛分行-珞屿银行", "Bank Hadrelle (China)", "HadreB", "Yanya Rural Credit Union", "淙桥村镇银行", "止洲证券", "（科技部）砚崖农信社", "x", None]
    v = spark.createDataFrame([(x,) for x in vals], "value string")
    one, two, many = ({(r["value"], r["canonical"], r["errors"]) for r in names.links(v, ref, n, b).collect()} for n, b in ((50_000, 10), (60, 1000), (2, 3)))
    assert one == two == many and ("蓝海银行上海分行科技部", "蓝海银行上海分行", 0) in one and len(one) >= 10
    assert not any(x == "翡行" for x, _, _ in one)


# ---------------------------------------------------------------- problem 5


def test_truncation(spark):
    rnd = random.Random(5)
    full = lambda: "某某银行" + "股份有限公司" * rnd.randrange(2) + "2025年" + "".join(rnd.choice(["数据中台", "机房空调", "核心系统", "网关", "存储阵列"]) for _ in range(rnd.randrange(1, 5))) + "建设项目" + rnd.choice(["招标公告", "中标结果公告", "询价公告"])
    rows, cut = [], set()
    for i in range(4000):
        site, t = ("a", "b")[i % 2], full()
        if site == "a" and len(t) > 24:
            t = t[:24]
            if t[-2:] not in ("公告",):
                cut.add(i)
        elif i % 97 == 0:
            t, _ = t[: len(t) // 2 + 3], cut.add(i)
        elif i % 101 == 0:
            t, _ = t[:-5] + "…", cut.add(i)
        rows.append((i, t, site))
    rows += [(9001, None, "a"), (9002, "  ", "b"), (9003, "短", "b")]
    d = spark.createDataFrame(rows, "id long, title string, site string").withColumn("v", F.lit("clash"))
    lim = {(r["site"], r["measure"], r["length"]) for r in truncation.limits(truncation.values(d, "id", ["title"], F.col("site"))).collect()}
    assert ("a", "chars", 24) in lim and not any(s == "b" and m == "chars" for s, m, _ in lim)
    got = {r["id"] for r in truncation.judged(d, "id", ["title"], F.col("site")).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(got)
    rep = {r["site"]: r for r in truncation.report(d, "id", ["title"], F.col("site")).collect()}
    assert rep["a"]["n_cut"] > rep["b"]["n_cut"] > 0
    assert truncation.judged(d.limit(0), "id", ["title"], F.col("site")).count() == 0


# ---------------------------------------------------------------- problem 6


def garble(t, chain):
    for enc, real in reversed(encoding.CHAINS[chain]):
        raw = t.encode(real)
        t = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in raw) if enc == "cp1252" else raw.decode(enc, "replace")
    return t


def test_encoding_round_trip():
    model = encoding.purified(clean_texts(300))
    for chain in encoding.CHAINS:
        if chain == "big5_as_gbk":
            continue
        for line in ["供应商每年应开展演练，演练报告须附日志与整改建议。", "投标人应具备同类项目实施案例不少于5个，并提供合同关键页复印件。"]:
            bad = garble(line, chain)
            ll = encoding.likelihoods(bad, model)
            best = encoding.NAMES[int(np.argmax(ll))]
            assert best != "clean", (chain, bad)
            if encoding.LOST_MARK not in bad:
                assert encoding.undo(bad, best) == line, (chain, best)
    for fine in ["本项目另有境外合作方 Crédit Norvalé 与 Société Brühl 参与方案论证。", "费用按 £、€、¥ 三种币种分别列示 §4.2 所述科目。", "温度误差 ±0.5℃，线缆直径 Ø25mm。"]:
        assert encoding.NAMES[int(np.argmax(encoding.likelihoods(fine, model)))] == "clean"


def test_encoding_reads_words_of_rare_characters(spark):
    """Words of two characters drawn from all of GB2312, garbled by every chain: nearly all are read and have a stretch."""
    model, rnd = encoding.purified(clean_texts(300)), random.Random(1)
    rows = []
    while len(rows) < 2000:
        try:
            word = bytes([rnd.randrange(0xB0, 0xF8), rnd.randrange(0xA1, 0xFF), rnd.randrange(0xB0, 0xF8), rnd.randrange(0xA1, 0xFF)]).decode("gb2312")
            bad = garble(word, rnd.choice(list(encoding.CHAINS)))
        except UnicodeError:
            continue
        if bad != word:
            rows.append((len(rows), bad))
    d = spark.createDataFrame(rows, "id long, keyword string")
    read = {r["id"] for r in encoding.suspicious(d, "id", ["keyword"], F.lit("s"), model).select("id").distinct().collect()}
    assert len(read) >= 0.99 * len(rows)


def test_encoding_learns_from_all_rows(spark):
    """The model is that of all values, as many and as long as they are."""
    texts = [f"{t}附注{chr(0x4E00 + i)}。" for i, t in enumerate(clean_texts(4100))] + ["很长的公告，" * 900 + "鱷魚。", garble("一行乱码的公告文字", "gbk_as_big5") + "\n另一行。"]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, detail string, keyword string").repartition(3)
    model, whole = encoding.train(d, ["detail", "keyword"]), encoding.purified(texts)
    assert model.bi == whole.bi and model.one == whole.one and model.common == whole.common
    assert all(("注", chr(0x4E00 + i)) in model.bi for i in range(4100)) and ("鱷", "魚") in model.bi


def test_encoding_rows(spark):
    rows = [(i, t, "银行", "s1") for i, t in enumerate(clean_texts(200))]
    rows += [(500, garble(clean_texts(1)[0], "utf8_as_latin1"), "银行", "s1"), (501, clean_texts(1)[0], garble("银行", "utf8_as_cp1252"), None), (502, None, None, "s2"), (503, "", " ", "s2"), (504, clean_texts(1)[0].replace("联系人：甲先生", garble("联系人：甲先生", "utf8_as_gbk")), "naïve 系统", "s2")]
    d = spark.createDataFrame(rows, "id long, detail string, keyword string, site string").withColumn("source", F.lit("clash")).withColumn("text", F.lit(1))
    got = {(r["id"], r["field"]) for r in encoding.found(d, "id", ["detail", "keyword"], F.col("site")).collect()}
    assert got == {(500, "detail"), (501, "keyword"), (504, "detail")}
    fixed = {(r["id"], r["field"]): r["text"] for r in encoding.restored(d, "id", ["detail", "keyword"], F.col("site")).collect()}
    assert fixed[(500, "detail")] == clean_texts(1)[0] and fixed[(501, "keyword")] == "银行"
    assert encoding.found(d.limit(0), "id", ["detail", "keyword"], F.col("site")).count() == 0


# ---------------------------------------------------------------- problem 7


def test_history(spark):
    t = dt.datetime
    rows = [
        (1, "招标公告", "招标公告", "甲项目招标公告", "CGXM-2025-00000001", "http://www.a.example/x/1.htm", None, t(2025, 1, 1)),
        (2, "招标公告", "招标公告", "乙", None, "https://m.a.example/x/1.htm?spm=1#c", None, t(2025, 1, 2)),  # page of 1
        (3, "招标公告", "招标公告", "甲项目招标公告", "ＣＧＸＭ〔２０２５〕０OO００００1号", None, None, t(2025, 1, 2)),  # number of 1
        (4, "中标结果", "中标结果公告", "甲项目中标结果公告", "CGXM202500000001", "http://b.example/2", None, t(2025, 1, 3)),  # another stage
        (5, "招标公告", "招标公告", "甲项目（第2标段）招标公告", "CGXM202500000001", "http://b.example/3", None, t(2025, 1, 3)),  # another lot
        (6, None, None, "甲项目中标结…", "CGXM/2025/00000001", "http://c.example/9", None, t(2025, 1, 4)),  # stage from a cut title: as 4
        (7, "招标公告", "招标公告", "x", None, "http://c.example/8", "项目编号：CGXM-2025-00000001\n", t(2025, 1, 5)),  # number in the text: as 1
        (8, "招标公告", "招标公告", "甲项目招标公告", None, None, None, t(2025, 1, 5)),  # no identity
        (9, "招标公告", "招标公告", "甲项目招标公告（二次）", "CGXM202500000001", " ", None, None),  # another round, no day
        (10, "招标公告", "招标公告", "z", "CGXM202500000001", "http://b.example/3/", None, t(2025, 1, 6)),  # page of 5, number of 1: one group
    ]
    d = spark.createDataFrame(rows, "id long, type string, sub_type string, title string, project_no string, detail_url string, detail string, created_at timestamp_ntz").withColumn("first", F.lit("clash")).withColumn("token", F.lit(0))
    want = {(1, 2), (1, 3), (4, 6), (1, 7), (1, 5), (1, 10)}
    for n in (1, 3, 6):
        assert {(r["first_id"], r["id"]) for r in history.repeats(d, n).collect()} == want
    assert history.repeats(d.limit(0)).count() == 0


def test_history_without_days(spark):
    t = dt.datetime
    rows = [(1, "http://a.example/1.htm", None), (2, "http://a.example/2.htm", t(2025, 1, 1)), (3, "http://m.a.example/1.htm", None), (4, "http://a.example/2.htm", t(2025, 1, 2)), (5, "http://a.example/5.htm", t(2025, 1, 3)), (6, "http://a.example/5.htm", None)]
    full = [(i, None, None, None, None, u, None, c) for i, u, c in rows]
    d = spark.createDataFrame(full, "id long, type string, sub_type string, title string, project_no string, detail_url string, detail string, created_at timestamp_ntz")
    for n in (1, 3):
        assert {(r["first_id"], r["id"]) for r in history.repeats(d, n).collect()} == {(1, 3), (2, 4), (5, 6)}
    assert {(r["first_id"], r["id"]) for r in history.repeats(d.filter("created_at is null")).collect()} == {(1, 3)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, "v", k) for i in range(120) for k in (i, i + 1)], "id long, view string, key long")
    assert {r["label"] for r in history.components(edges).collect()} == {0}


def test_index_grows(spark):
    notice = lambda *ts: [("v", list(t), i) for i, t in ts]
    ix = history.NoticeIndex(spark, ["n", "s"], share=1.0, buckets=3)
    mk = lambda rows: spark.createDataFrame(rows, "view string, tokens array<string>, first long")
    a = mk(notice((1, ("n:1", "s:a")), (2, ("n:2", "s:a"))))
    assert ix.probe(a).filter("known is not null").count() == 0
    ix.append(a)
    ix.append(mk(notice((5, ("n:5", "s:b")))))
    got = {(r["first"], r["known"]) for r in ix.probe(mk(notice((7, ("n:1", "s:a")), (8, ("n:1", "s:b")), (9, ("n:5", "s:b"))))).collect()}
    assert got == {(7, 1), (8, None), (9, 5)}


def test_index_is_taken_up_again_and_compacted(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "view string, tokens array<string>, first long")
    ix = history.NoticeIndex(spark, history.Rarity([["s:a"]]), f"file://{tmp_path}/index", buckets=3)
    ix.absorb(mk([("v", ["n:1", "s:a"], 1), ("v", ["n:2", "s:a"], 2)]))
    ix.absorb(mk([("v", ["n:2", "s:a"], 3), ("v", ["n:3", "s:a"], 4), ("w", ["n:1", "s:a"], 5)]))
    again = history.NoticeIndex(spark, history.Rarity([["s:a"]]), f"file://{tmp_path}/index", buckets=3)
    for index in (ix, again, again.compact()):
        assert {(r["first"], r["known"]) for r in index.rows().collect()} == {(1, None), (2, None), (3, 2), (4, None), (5, None)}
        assert [r["known"] for r in index.probe(mk([("v", ["n:3", "s:a"], 9)])).collect()] == [4] and {r["token"] for r in index.postings().collect()} == {"n:1", "n:2", "n:3"}
    assert again.parts == 2 and "Exchange" not in ix.postings().groupBy("token").count()._jdf.queryExecution().executedPlan().toString()


def test_titles_that_are_nearly_the_same(spark):
    """The index with a similarity of 0.8 against all pairs."""
    rnd = random.Random(8)
    words = ["核心系统", "数据中台", "机房空调", "存储阵列", "采购项目", "建设工程", "招标公告", "中标结果", "2025年度", "某某银行"]
    titles = ["".join(rnd.choices(words, k=6)) for _ in range(60)]
    for k in range(60):
        t = rnd.choice(titles[:60])
        i = rnd.randrange(len(t))
        titles.append(t[:i] + rnd.choice(["", "甲", "（一）"]) + t[i + rnd.randrange(2) :])
    rows = [(i, t, dt.datetime(2025, 1, 1) + dt.timedelta(days=i)) for i, t in enumerate(titles + ["短", "短", None, " "])]
    d = spark.createDataFrame(rows, "id long, title string, created_at timestamp_ntz")
    tok = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for i, t, _ in rows if t and t.strip()}
    last = len(rows) - 1
    want = {}
    for i in tok:
        near = [j for j in tok if last - 30 - 2 >= j and len(tok[i] & tok[j]) >= 0.8 * len(tok[i] | tok[j]) - 1e-9]
        if i > last - 30 - 2 and near:
            want[i] = min(near)
    got = {r["id"]: r["first_id"] for r in history.last_batch(history.title_notices(d), days=30, share=0.8).collect()}
    assert got == want and len(want) >= 5
    assert history.last_batch(history.title_notices(d.limit(0))).count() == 0


# ---------------------------------------------------------------- problem 8


def slow_bpe(bpe, piece):
    ids = [int(bpe.byte[b]) for b in piece]
    while len(ids) > 1:
        rank, merged = bpe._pair(np.array(ids[:-1]), np.array(ids[1:]))
        ok = [(r, i) for i, r in enumerate(rank) if r >= 0]
        if not ok:
            break
        _, i = min(ok)
        ids[i : i + 2] = [int(merged[i])]
    return ids


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files")
def test_bpe():
    bpe = tokens.ByteBPE()
    texts = ["招标公告：2025年UPS不间断电源（二期）采购项目。", "", None, "The supplier shall provide storage services.\r\n\t x", "  ", "a" * 700, "<|endoftext|>", "é😀�" * 9, "'s I'll 12,345.00"]
    rnd = random.Random(2)
    texts += ["".join(rnd.choice("ab 中文\n　12é'.") for _ in range(80)) for _ in range(150)]
    got = bpe.encode(texts)
    assert [list(x) for x in got] == [[i for p in bpe.split.findall(t or "") for i in slow_bpe(bpe, p.encode())] for t in texts]
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [list(x) for x in got] == [ref.encode_ordinary(t or "") for t in texts] and all(ref.decode(list(x)) == (t or "") for x, t in zip(got, texts))


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files")
def test_encoded_rows(spark):
    d = spark.createDataFrame([(1, "公告 a"), (2, None), (3, ""), (3, ""), (4, "x" * 50000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], len(r["ids"])) for r in tokens.encoded(d).collect())
    assert [g for g in got if g[0] in (2, 3)] == [(2, 0), (3, 0), (3, 0)] and len(got) == 5
    assert tokens.encoded(d.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in tokens.counted(d.withColumn("n_tokens", F.lit("clash"))).collect())[:3] == [0, 0, 0]


# ---------------------------------------------------------------- problem 9


def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(i, "big", rnd.randrange(1, 400)) for i in range(4000)] + [(10_000 + i, "small", rnd.randrange(1, 400)) for i in range(200)] + [(20_000, "tiny", 7), (20_001, "none", 5), (20_002, None, 5), (20_003, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    mix = spark.createDataFrame([("big", 0.6, 1), ("small", 0.1, 4), ("tiny", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    used = mixing.mixed(sizes, mix)
    u = [r.asDict() for r in used.collect()]
    by = {}
    for r in u:
        by.setdefault(r["source"], []).append(r)
    size = sum(n for _, s, n in rows if s in ("big", "small", "tiny"))
    tok = {s: sum(r["copies"] * r["n_tokens"] for r in v) for s, v in by.items()}
    assert abs(tok["big"] - int(0.6 * size)) <= 200 and abs(tok["small"] - int(0.1 * size)) <= 200 and tok["tiny"] == 21
    assert set(by) == {"big", "small", "tiny"} and max(r["copies"] for r in by["small"]) <= 4 and all(r["n_tokens"] > 0 for r in u)
    assert len({r["doc_id"] for r in u}) == len(u) and sorted(map(str, u)) == sorted(str(r.asDict()) for r in mixing.mixed(sizes.repartition(7), mix).collect())
    s = {r["source"]: r for r in mixing.shares(sizes, mix, used).collect()}
    assert s["big"]["met"] and not s["tiny"]["met"] and not s["absent"]["met"] and abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    clash = sizes.withColumns({"c": F.lit(1), "copies": F.lit("x"), "limit": F.lit(2), "rest": F.lit(3)})
    assert mixing.mixed(clash, mix).count() == len(u)
    assert mixing.mixed(sizes.limit(0), mix).count() == 0


def test_mixing_prefers_by_size(spark):
    sizes = spark.createDataFrame([(i, "a", 10 if i % 2 else 100) for i in range(6000)], "doc_id long, source string, n_tokens long")
    mix = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = {r["n_tokens"]: r["k"] for r in mixing.mixed(sizes, mix, total=60_000).groupBy("n_tokens").agg(F.count("*").alias("k")).collect()}
    assert abs(n[100] / n[10] - 10) < 4  # inclusion in proportion to size


# ---------------------------------------------------------------- problem 10


@pytest.fixture(scope="module")
def words():
    return quality.Words(["的", "和", "应", "并", "不", "须", "且", "项目", "供应商", "提供", "投标"], ["the", "of", "and", "shall", "to", "in", "is", "for", "must", "each"])


def corpus(seed=1):
    rnd = random.Random(seed)
    items = ["服务器 2 台", "营业执照副本", "审计报告", "社保证明", "交换机", "培训计划", "Spare parts", "Tax certificate"]
    out = [("".join(rnd.choices(SENTENCES, k=6)), None) for _ in range(60)]
    out += [("The supplier shall provide storage services for the gateway. " * 2 + "Each of the bidders must reply to the notice in time.", None) for _ in range(8)]
    for _ in range(40):
        out.append(("递交材料清单\n" + "\n".join(f"{m} {rnd.choice(items)}" for m in ["-"] * rnd.randrange(5, 15)), "list"))
        out.append(("序号|品名|数量\n" + "\n".join(f"{k}|{rnd.choice(items)}|{rnd.randrange(60)}" for k in range(1, rnd.randrange(6, 14))), "table"))
    for _ in range(15):
        out.append((rnd.choice([" | ", "\n", "  "]).join(rnd.choices(["首页", "登录", "注册", "网站地图", "Home", "Next", "返回顶部"], k=20)), "junk"))
        out.append(("".join(rnd.choice("0123456789abcdef") for _ in range(200)), "junk"))
        out.append((rnd.choice(["测试", "-", "test ", "?"]) * 80, "junk"))
        out.append(("".join(f"<div class='c{k}'><a href='/p/{k}'></a></div>" for k in range(12)), "junk"))
        out.append((SENTENCES[0].encode().decode("latin1") * 3, "junk"))
    return out


def test_quality_kinds(words):
    train, test = corpus(1), corpus(2)
    model = quality.Profiles([t for t, _ in train], words)
    right = sum(model.judge(t)[0] == k for t, k in test)
    assert right >= 0.97 * len(test)
    mixed = "".join(SENTENCES) + "\n序号 | 名称 | 数量\n1 | 服务器 | 8"
    assert model.judge(mixed)[0] is None and [model.judge(x)[0] for x in (None, "", " \n ")] == [None] * 3


def test_quality_learns_from_all_rows(spark, words):
    """The profiles are those of all different texts, as many and as long as they are."""
    texts = [f"{t}\n{chr(0x4E00 + i)}号文件。" for i, (t, _) in enumerate(corpus(4) * 20)] + ["".join(SENTENCES) * 200, *("<b class='k'></b><i class='%d'></i>" % i for i in range(3))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:500])], "doc_id long, text string").repartition(3)
    cw = spark.createDataFrame([(w, "zh") for w in words.zh] + [(w, "en") for w in words.en], "word string, lang string")
    model, whole = quality.train(d, cw), quality.Profiles(texts, words)
    assert len(texts) > 4000 and len(texts[-4]) > 8000 and model.kinds == whole.kinds
    assert all((model.p[k] == whole.p[k]).all() for k in whole.p) and (model.table == whole.table).all()


def test_quality_rows(spark, words):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(3))] + [(900, None), (901, ""), (902, "x" * 70_000), (903, "a\r\nb.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1))
    cw = spark.createDataFrame([("的", "zh"), ("应", "zh"), ("the", "en"), (None, "en")], "word string, lang string")
    assert quality.judged(d, cw).count() == len(rows)
    s = {r["doc_id"]: r for r in quality.statistics(d, cw).collect()}
    assert (s[900]["n_chars"], s[900]["common_share"], s[901]["n_lines"], s[903]["n_lines"], s[903]["line_end_share"]) == (0, 0.0, 0, 2, 0.5)
    assert quality.statistics(d.limit(0), cw).count() == 0 and quality.judged(d.limit(0), cw).count() == 0
