"""Ordered keyword and pattern rules compiled to columns.

A rule table is a list; the first entry that hits wins.  Every table below is data, in the order in which it applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import blank_to_null, drop_prefix_tag, py_strip

# fixed values: kind of notice by keyword of its title
KIND_BY_TITLE = [("中标结果", "中标结果"), ("成交结果", "成交结果"), ("中标候选人公示", "中标候选人公示"), ("候选人公示", "中标候选人公示"), ("谈判结果", "中标结果"), ("询价结果", "中标结果"), ("磋商结果", "中标结果"), ("邀请结果", "中标结果"), ("结果公示", "中标结果"), ("结果公告", "中标结果"), ("中标公告", "中标结果"), ("中标", "中标结果"), ("流标", "流标"), ("废标", "流标"), ("公示", "公示"), ("征集", "征集"), ("磋商", "磋商"), ("谈判", "谈判"), ("询价", "询价"), ("招标", "招标"), ("邀请", "邀请"), ("采购", "采购")]
# fixed values: label of a listing by keyword of its title
LABEL_BY_TITLE = [("流标", "流标"), ("成交结果", "成交结果"), ("中标候选人公示", "中标候选人公示"), ("候选人公示", "中标候选人公示"), ("中标公示", "中标公示"), ("评标结果公示", "评标结果公示"), ("中标结果公示", "中标结果公示"), ("中标结果", "中标结果"), ("中标公告", "中标公告"), ("中标", "中标"), ("竞争性磋商", "竞争性磋商"), ("磋商", "磋商"), ("竞争性谈判", "竞争性谈判"), ("谈判", "谈判"), ("询价", "询价"), ("邀请招标", "邀请招标"), ("招标公告", "招标公告"), ("招标", "招标"), ("公示", "公示"), ("征集", "征集"), ("邀请", "邀请"), ("采购公告", "采购公告"), ("采购", "采购")]
# fixed values: platform labels that mean a tender notice
TENDER_LABELS = ["招标变更", "招标预告", "审批公示", "采购信息"]
# fixed values: labels of the two groups of a list
TENDER_GROUP = ["招标公告", "招标预告", "招标变更", "采购信息", "审批公示"]
AWARD_GROUP = ["中标结果", "中标公示", "中标公告", "中标结果公示", "中标候选人公示", "中标"]
# fixed values: words of software and hardware titles
SOFTWARE_WORDS = ["软件", "系统开发", "系统建设", "系统升级", "系统改造", "系统迁移", "系统集成", "信息系统", "应用系统", "业务系统", "核心系统", "中台", "平台建设", "平台开发", "数据平台", "信息平台", "业务平台", "平台", "系统维保", "平台维保", "数据库维保", "软件维保", "数据库", "大模型", "算力平台", "算力服务", "软件开发", "开发项目", "运维", "信息化", "数字化", "电子化", "监管报送", "报送系统", "监管报表", "监管数据", "数据治理", "数据仓库", "数据安全", "网络安全", "安全运营"]
HARDWARE_WORDS = ["服务器", "算力设备", "存储设备", "存储系统", "工作站", "计算节点", "交换机", "路由器", "防火墙", "负载均衡", "网络设备", "安全设备", "机房", "数据中心", "UPS", "基础硬件", "硬件设备", "PC机", "电脑采购", "打印机", "终端设备", "网络改造", "机房改造"]
HARDWARE_FIRST = ["设备采购", "硬件采购", "设备购置", "硬件购置", "设备维保", "硬件维保"]
MAINTAINED = ["系统", "平台", "软件", "数据库", "应用", "模块"]
# fixed values: words of titles that are no purchase of technology, in the order in which they are looked for
TITLE_EXCLUDE = [
    "联名卡", "信用卡场景", "获客活客", "场景获客", "生日祝福", "权益兑换", "物资供应商", "物资采购", "物资供应", "盒抽", "办公用品", "礼品", "服装", "招租", "公开招租", "场地租赁", "停车位", "绿植", "物业管理", "保洁",
    "食堂食材", "餐厅食材", "食材采购", "食材供应", "食材框架", "食堂承包", "客户经理外包", "营销团队外包", "驻点服务外包", "补充医疗保险", "医疗保险", "保险采购", "医疗采购", "健康险", "保险代理", "品牌广告", "广告采购",
    "公用媒体库", "影院广告", "媒体库采购", "广告媒体", "监理", "设计供应商入围", "税务咨询", "档案整理", "档案数字化", "档案扫描", "呼叫中心", "客服外包", "催收", "不良资产", "审计", "评估", "法律咨询", "基金代销", "理财销售",
    "培训", "团建", "会议服务", "押运", "物料", "用车", "车辆租赁", "维修", "印刷品", "宣传品", "安防工程", "安防系统建设", "监控设备", "消防工程", "基建工程", "电梯", "空调", "发电机", "柜员机", "ATM", "清分机", "点钞机",
    "现金清分", "现金押运", "后勤与保障", "绿化养护", "续租", "装修", "驾驶员", "施工总承包", "施工承包", "（施工）", "(施工)", "园区项目", "二期工程", "一期工程", "工程施工", "科技大厦", "科技园", "科技楼", "大厦", "资产转让", "拍卖",
    "大堂引导", "引导分流", "分流设备", "叫号", "排队机", "小学", "中学", "幼儿园", "学校资产", "行政事业资产", "职业技术学院", "职业学院", "学院", "金融业务合作", "银行合作", "业务合作服务", "合作服务项目", "暂停公告", "餐饮", "立减", "云闪付",
]
# fixed values: those of them that hold whoever the owner is
HARD_EXCLUDE = ["餐饮", "立减", "云闪付", "食材", "食堂", "物资", "礼品", "服装", "绿植", "保洁", "广告", "印刷品", "（施工）", "(施工)", "安防系统建设"]
# fixed values: marks of surveys and of rented lines, and the pattern of servers with parts
SURVEY_MARKS = ["多测合一", "规划监督测量", "验测高程", "验测平面位置", "不动产测绘", "规划核实测量", "人防核实测量", "竣工指标数据库转换", "地下管线探测", "环境竣工测量"]
RENTED_LINES = ["线路租用", "专线租用", "互联网线路租用", "网络线路租用", "数据专线租用", "光纤线路租用"]
SERVER_PARTS = "服务器.{0,20}(?:及配件|配件采购|及配件采购)"
# fixed values: the body of a scanned paper without text, and hints at an attachment
SCAN_BODY = "[PDF 无可提取文本，可能是扫描版图片]"
ATTACHMENT_HINTS = ["点击查看或下载公告文件", "下载公告文件", "查看公告文件", "点击下载", "附件信息可下载", "下载附件", "附件下载", "点击查看>>", "点击查看", "内容详见附件", "详情请见附件", "详情见附件", "详见附件", "详情请点击查看", "点击查看附件", "请点击查看", "点击查看内容"]
# fixed values: words of financial institutions
FINANCIAL_WORDS = ["银行", "信托", "证券", "基金", "保险", "金融", "理财", "资产管理", "财务公司", "期货", "租赁", "农商", "农信", "农村信用", "消费金融", "汽车金融", "金融控股", "金融租赁", "信用社", "联合社"]
OWNER_PATTERN = "(?:招标人|采购人|委托单位|项目业主|建设单位)[：:]\\s*([^\\n]{2,40})"
# fixed values: bodies that only point elsewhere
JUMP = ["点击查看", "点击查阅", "点击打开", "请点击", "查看详情>>", "查阅详情"]
SOURCE = ["信息来自中国招标投标", "信息来自全国招标投标", "全国公共资源交易平台"]
PLATFORM = ["服务平台", "公共服务平台", "招标投标网", "公共资源交易"]
AWARD_MARKS = ["中标人名称", "中标人：", "评标委员会", "评审日期", "评审地点", "中标金额", "公示期限", "成交结果"]
SHELL_STARTS = ["内容详见附件", "详情请见附件", "详情见附件", "详见附件"]
SHELL_HITS = ["附件下载", "点击下载", "条附件信息可下载", "附件信息可下载"]
# fixed values: patterns of labelled fields, tried in order
FIELDS = {
    "project_no": ["项目编号[：:]\\s*([^\\s]+)", "招标编号[：:]\\s*([^\\s]+)"],
    "project_budget": [x + "[：:]\\s*([^\\n]+)" for x in ("项目预算", "预算金额", "采购预算", "控制价", "最高限价", "预算")],
    "project_owner": ["(?:委托单位|采购人|项目业主)[：:]\\s*([^\\n]+)"],
    "winning_bidder": ["中标人(?:名称)?[：:]\\s*([^\\n]+)"],
    "bidding_agent": ["(?:代理机构|招标代理)[：:]\\s*([^\\n]+)"],
    "owner_contact": ["(?:项目联系人|联系人)[：:]\\s*([^\\n]+)"],
    "owner_phone": ["联系电话[：:]\\s*([^\\n]+)"],
    "winning_amount": ["(?:中标金额|中标价|成交金额|成交价格)[：:]\\s*[￥¥]\\s*([\\d,\\.]+)", "中标金额[：:]\\s*[￥¥]?\\s*([\\d,\\.]+)", "中标价[：:]\\s*[￥¥]?\\s*([\\d,\\.]+)"],
}
BRACKET_AMOUNT = "(?:中标金额|中标价|成交金额|成交价格)[：:][\\s\\S]{0,800}?[（(]\\s*[￥¥]\\s*([\\d,]+\\.?\\d*)\\s*[）)]"
METHODS = ["公开招标", "竞争性磋商", "竞争性谈判", "询价", "邀请招标"]


def first_hit(text: Column, table: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first keyword that text contains, else `default`."""
    c = F.when(F.contains(text, F.lit(table[0][0])), F.lit(table[0][1]))
    for k, v in table[1:]:
        c = c.when(F.contains(text, F.lit(k)), F.lit(v))
    return c.otherwise(F.lit(default)) if default is not None else c


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text contains one of the words; false for NULL.  One pass of one pattern."""
    import re

    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches; NULL if none does."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def kind_of_title(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).otherwise(first_hit(title, KIND_BY_TITLE, "其他"))


def label_of_title(title: Column) -> Column:
    """struct(label, clean)."""
    clean = drop_prefix_tag(title)
    return F.struct(first_hit(clean, LABEL_BY_TITLE, "采招信息").alias("label"), clean.alias("clean"))


def normal_kind(kind: Column) -> Column:
    return F.when(kind.isin(*TENDER_LABELS), F.lit("招标公告")).otherwise(kind)


def type_group(sub_type: Column) -> Column:
    s = F.trim(sub_type)
    return F.when(s.isin(*TENDER_GROUP), F.lit("招标公告")).when(s.isin(*AWARD_GROUP), F.lit("中标结果"))


def financial_owner(text: Column, title: Column) -> Column:
    """Whether the owner named in the text, else the title, names a financial institution."""
    owner = F.regexp_extract(F.coalesce(text, F.lit("")), OWNER_PATTERN, 1)
    return F.when(owner != "", any_of(owner, FINANCIAL_WORDS)).otherwise(any_of(title, FINANCIAL_WORDS))


def product_class(title: Column, text: Column) -> Column:
    """软件相关, 硬件相关 or '': hardware titles, maintained software, then words of the title, then of the text."""
    t = F.coalesce(F.trim(title), F.lit(""))
    at = F.instr(t, "维保")
    maintained = F.lit(False)
    for w in MAINTAINED:
        maintained = maintained | ((F.instr(t, w) > 0) & (F.instr(t, w) < at))
    c = F.when(any_of(t, HARDWARE_FIRST), "硬件相关").when((at > 0) & maintained, "软件相关")
    for x in (t, text):
        c = c.when(any_of(x, SOFTWARE_WORDS), "软件相关").when(any_of(x, HARDWARE_WORDS), "硬件相关")
    return c.otherwise("")


def tech_title(title: Column) -> Column:
    """Whether a title is of technology: none of the excluded words, one of the others; false for NULL and blank."""
    t = F.coalesce(F.trim(title), F.lit(""))
    return ~any_of(t, TITLE_EXCLUDE) & any_of(t, SOFTWARE_WORDS + HARDWARE_WORDS)


def forced_product(title: Column, text: Column) -> Column:
    """What strong marks of title and text decide: '' (surveys, rented lines), 硬件相关, or NULL."""
    both = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    has = lambda w: F.contains(both, F.lit(w))
    hardware = has("算力设备") | (has("设备扩容") & (has("大模型") | has("算力"))) | both.rlike(SERVER_PARTS)
    return F.when(any_of(both, SURVEY_MARKS + RENTED_LINES), "").when(hardware, "硬件相关")


def excluded_title(title: Column, text: Column) -> Column:
    """Whether the first excluded word of the title holds: always if it is a hard one, else unless the owner is financial."""
    t = F.coalesce(F.trim(title), F.lit(""))
    hit = first_hit(t, [(w, "hard" if w in HARD_EXCLUDE else "soft") for w in TITLE_EXCLUDE], "none")
    return (hit == "hard") | ((hit == "soft") & ~financial_owner(text, title))


def product_related(title: Column, text: Column) -> Column:
    """The product class with what overrides it and what excludes it."""
    return F.coalesce(forced_product(title, text), F.when(excluded_title(title, text), "").otherwise(product_class(title, text)))


def accepted_class(given: Column, title: Column, text: Column) -> Column:
    """A given class if it is one of the two, else the one by rules."""
    g = F.trim(F.coalesce(given, F.lit("")))
    return F.when(g.isin("软件相关", "硬件相关"), g).otherwise(product_related(title, text))


def title_gate(title: Column, words: list[str], keyword: Column) -> Column:
    """The first gate that keeps a title from being opened: not_tech, excluded, no_keyword; else open."""
    t = F.coalesce(title, F.lit(""))
    out = F.when(~tech_title(title), "not_tech")
    if words:
        out = out.when(any_of(t, words), "excluded")
    return out.when(~F.contains(t, F.coalesce(keyword, F.lit(""))), "no_keyword").otherwise("open")


def scan_body(text: Column) -> Column:
    """A body that only says that its paper is a scan without text."""
    return F.startswith(py_strip(F.coalesce(text, F.lit(""))), F.lit(SCAN_BODY))


def wants_attachment(text: Column) -> Column:
    """Whether the content has to be looked for in attachments: too short, or a hint in a short or padded body."""
    s = py_strip(F.coalesce(text, F.lit("")))
    return (F.char_length(s) < 80) | (any_of(s, ATTACHMENT_HINTS) & ((F.char_length(s) < 1200) | F.contains(s, F.lit("招标进展"))))


def kept_status(old: Column, new: Column) -> Column:
    return F.coalesce(blank_to_null(old), new)


def labelled_fields(text: Column) -> dict[str, Column]:
    """The labelled fields of a text, NULL where there is none."""
    out = {k: first_match(text, ps) for k, ps in FIELDS.items()}
    paren = F.nullif(F.regexp_extract(text, BRACKET_AMOUNT, 1), F.lit(""))
    out["winning_amount"] = F.concat(F.coalesce(paren, out["winning_amount"]), F.lit("元"))
    out["bidding_method"] = first_hit(text, [(m, m) for m in METHODS], None)
    return out


def normal_method(c: Column) -> Column:
    s = F.coalesce(py_strip(c), F.lit(""))
    return F.when(s.isin("", "其他", "其它") | F.startswith(s, F.lit("资格预审")), "公开招标").when(F.startswith(s, F.lit("单一来源")), "单一来源").otherwise(s)


def short_body(text: Column, least: int = 80) -> Column:
    return F.char_length(py_strip(F.coalesce(text, F.lit("")))) < least


def pointer_body(text: Column) -> Column:
    """A body that only sends the reader to a platform."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")
    n = F.char_length(c)
    return (n > 0) & (n <= 900) & ~((n >= 120) & any_of(c, AWARD_MARKS)) & any_of(c, PLATFORM) & (any_of(c, JUMP) | any_of(c, SOURCE))


def shell_body(text: Column) -> Column:
    """A body that is only the entrance to attachments."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")
    n = F.char_length(c)
    start = F.lit(False)
    for s in SHELL_STARTS:
        start = start | F.startswith(c, F.lit(s))
    hits = sum((F.contains(c, F.lit(h)).cast("int") for h in SHELL_HITS[1:]), F.contains(c, F.lit(SHELL_HITS[0])).cast("int"))
    return start & (hits >= 1) & ((n <= 200) | ((n <= 400) & F.contains(c, F.lit("招标进展")) & (hits >= 2)))


def loose_bool(c: Column) -> Column:
    """true, yes, 1, 是 and their opposites in loose notation; NULL for anything else."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "yes", "1", "是", "y"), True).when(s.isin("false", "no", "0", "否", "n"), False)


def default_to(c: Column, value: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(value))
