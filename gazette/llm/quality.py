"""Per-document text statistics and structural kind (problem 10).

Counts (words, word length, symbols, line ends, common words) are plain column expressions.  The structure is judged on
units: paragraphs (lines joined where they were only wrapped, enumerations in one line cut into their items).  Every unit
is described by distributions: its character classes, its function words (common Chinese words, common English words,
navigation words, the rest), and its basic counts (`COUNTS`: sentence ends, item mark and length, columns, repetition,
random tokens, symbols, markup, units in the text), each of which is a distribution over a few bins.  The unit gets the
nearest of the structural profiles: the least sum of Jensen-Shannon divergences, every distribution counted once and none
weighted by hand.  Profiles are the mean distributions of prose, lists, tables and kinds of junk over all texts of the
table (equal texts count once), where unmistakable units (by their form) stand for their kind; Spark sums them up.  A
document has the kind that most of its characters have.

All units of a batch are described at once: code points in one array, classes by table, histograms by one bincount,
words by one pass of a pattern over the batch, divergences as one matrix.

Defined results: NULL, empty and blank texts have no kind and counts of 0; shares of nothing are 0; texts are read whole;
repeated rows have equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.session import cut, remove

STEP = 2000  # texts that are described at once in training
POINT = 1 << 30  # shares are summed as whole numbers of this fraction: the same sum in any order
CACHE = 100_000  # units kept per task
CACHED = 80  # characters: longer units hardly recur
MOST_WORDS = 100_000
CLASSES = ["han", "rare", "latin", "digit", "stop", "clause", "column", "mark", "markup", "garble", "space"]
KINDS = ["prose_zh", "prose_en", "list", "table", "junk_navigation", "junk_markup", "junk_random", "junk_symbols", "junk_repeated", "junk_garbled"]
STOP = "。！？!?…"
ENDS = "。！？；：.!?;:…”\"）)」』"
# Words of site navigation, marks and numbers before items.
NAVIGATION = ["首页", "上一篇", "下一篇", "上一页", "下一页", "返回顶部", "返回首页", "返回列表", "网站地图", "登录", "注册", "收藏", "打印", "分享到", "关闭窗口", "更多", "版权所有", "技术支持", "联系我们", "Home", "Login", "Register", "Next", "Previous", "Prev", "RSS", "Sitemap", "Share", "Print", "Contact", "Search", "Menu", "Top", "Back"]
ITEM = re.compile(r"^\s*(?:[-*•·●○□■◆▪‣➢√☐☑]\s*\S|[(（\[【]?\d{1,3}[)）\]】.、．:：]\s*\S|\d{1,3}\s*[)）.、．]\s*\S|[一二三四五六七八九十]{1,3}[、.．]\s*\S|[a-zA-Z][).]\s+\S)")
INLINE = re.compile(r"[;；]\s*(?=[-*•·●○□■◆▪]\s*\S|[(（\[【]\d{1,3}[)）\]】]|\d{1,3}[.、．)）])")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|&[a-z]{2,6};|\{[^{}]{0,80}:[^{}]{0,80};\}|function\s*\(|var \w+\s*=")
SYMBOL = re.compile(r"[^\w\s]|_")
#: basic counts of a unit and the upper ends of their bins
COUNTS = {"stops": (0, 1, 2), "closed": (0,), "item": (0, 1, 2, 3, 4, 5), "columns": (0, 2, 3), "repetition": (0.0, 0.15, 0.3), "random": (0.0, 0.3, 0.6), "symbols": (0.15, 0.3, 0.4), "markup": (0.0, 0.3), "units": (1, 2, 4)}


class Words:
    def __init__(self, zh: list[str], en: list[str]):
        self.zh = sorted({w for w in zh if w})
        self.en = sorted({w.lower() for w in en if w})


class Lexicon:
    """Marks the places of literal words in an array of code points."""

    def __init__(self, words: list[str]):
        self.words = [np.array([ord(c) for c in w], np.uint32) for w in words]
        self.first = np.array(sorted({int(w[0]) for w in self.words}), np.uint32)

    def covered(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        pos = np.nonzero(np.isin(codes, self.first))[0]
        head = codes[pos]
        for w in self.words:
            at = pos[head == w[0]]
            at = at[at <= len(codes) - len(w)]
            for k in range(1, len(w)):
                at = at[codes[at + k] == w[k]]
            for k in range(len(w)):
                out[at + k] = True
        return out


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, places behind) of the runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def _word_keys(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, longest: int) -> np.ndarray:
    """A 64-bit key of each Latin word without regard to case; 0 for longer ones."""
    n = stop - start
    key = n.astype(np.uint64)
    for k in range(longest):
        c = codes[np.minimum(start + k, len(codes) - 1)].astype(np.uint64) | np.uint64(32)
        key = np.where(k < n, (key ^ c) * np.uint64(0x9E3779B97F4A7C15), key)
    return np.where(n <= longest, key, 0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _columns(u: str) -> int:
    """The number of columns the unit has, if it is a row of columns."""
    for sep in ("\t", "|"):
        if u.count(sep) >= 2:
            return u.count(sep) + 1
    if "   " in u and len(re.findall(r"\S {3,}\S", u)) >= 2:
        return len(re.findall(r" {3,}", u.strip())) + 1
    for sep in (",", ";", "，", "；"):
        k = u.count(sep)
        if k >= 2 and len(u) / (k + 1) < 16 and sep + " " not in u and not re.search("[。！？]", u):
            return k + 1
    return 0


_IN_KEYS = np.array([ord(c) for c in "+/="], np.uint32)
_IN_TAGS = np.array([ord(c) for c in "<&{(="], np.uint32)
_AFTER_STOP = np.array(sorted(map(ord, STOP + ":：")), np.uint32)
_GOES_ON = np.array(sorted(map(ord, STOP + "，、；")), np.uint32)


def units(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(paragraphs of all texts, place of the text of each): wrapped lines joined, enumerations in a line cut."""
    lines: list[str] = []
    of: list[int] = []
    for d, t in enumerate(texts):
        t = t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t
        own = [y for x in t.split("\n") if (y := x.strip(" \n") if "\t" in x else x.strip(" 　\t\x0c"))]
        lines += own
        of += [d] * len(own)
    if not lines:
        return [], np.zeros(0, np.int64)
    doc, n = np.array(of), np.array([len(x) for x in lines])
    # the width of each text: the length of two fifths of its lines, else its longest line, or of five and more the one at nine tenths
    begin = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])
    size = np.diff(np.concatenate([begin, [len(doc)]]))
    by_length = n[np.lexsort((n, doc))]
    top = np.repeat(by_length[begin + np.where(size < 5, size - 1, (size * 0.9).astype(np.int64))], size)
    same_length, k = np.unique(doc * (1 << 32) + n, return_counts=True)
    length, owner = same_length & 0xFFFFFFFF, same_length >> 32
    even = (k >= 3) & (k >= 0.4 * size[np.searchsorted(doc[begin], owner)]) & (length >= 20)
    width = np.zeros(len(texts), np.int64)
    np.maximum.at(width, owner[even], length[even])
    top = np.where(width[doc] > 0, width[doc], top)
    head = np.array([ord(x[0]) for x in lines], np.uint32)
    tail = np.array([ord(x[-1]) for x in lines], np.uint32)
    same = np.concatenate([[False], doc[1:] == doc[:-1]]) & (top >= 20)
    last, a = np.roll(n, 1), np.roll(tail, 1)
    # a line as wide as the rest, that breaks off inside a sentence, goes on in the next
    open_ = same & (last >= 0.8 * top) & (last <= 1.25 * top) & ~np.isin(a, _AFTER_STOP)
    for i in np.nonzero(open_)[0]:
        x = lines[i]
        open_[i] = not (a[i] == 46 and x[0].isupper()) and not ITEM.match(x) and not _columns(x)
    join = open_ | (same & np.isin(head, _GOES_ON) & (n < 0.8 * top))
    out: list[str] = []
    place: list[int] = []
    for i, x in enumerate(lines):
        if join[i]:
            c = chr(a[i])
            out[-1] += (" " if open_[i] and c.isascii() and c.isalpha() and x[0].isascii() else "") + x
        else:
            out.append(x)
            place.append(of[i])
    cut: list[str] = []
    at: list[int] = []
    for u, d in zip(out, place):
        if "；" in u or ";" in u:
            parts = INLINE.split(u)
            if len(parts) < 3 and u.count("；") >= 4 and not re.search("[。！？]", u):
                short = u.split("；")  # an enumeration without marks
                parts = short if len(u) < 18 * len(short) else parts
            if len(parts) >= 3:
                parts = [p for p in parts if p.strip()]
                cut += parts
                at += [d] * len(parts)
                continue
        cut.append(u)
        at.append(d)
    return cut, np.array(at, np.int64)


_MARKS = set("-*•·●○□■◆▪‣➢√☐☑#~=_+—…^$@%&\\")


def _class(c: str, common: set[str]) -> int:
    if "一" <= c <= "鿿":
        return 0 if c in common else 1
    if c.isascii():
        if c.isalpha():
            return 2
        if c.isdigit():
            return 3
        if c in "!?.":
            return 4
        if c in ",;:'\"()":
            return 5
        if c in "|\t":
            return 6
        if c in "<>/={}&[]":
            return 8
        if c.isspace():
            return 10
        return 7
    if c in STOP:
        return 4
    if c in "，、；：“”‘’（）《》〈〉「」":
        return 5
    if c in "　 ":
        return 10
    if c in _MARKS or c in "【】〔〕℃×Ø±§€£¥‰→":
        return 7
    if "㐀" <= c <= "䶿" or "０" <= c <= "ｚ":
        return 0
    return 9


def _distinct_fours(codes: np.ndarray, unit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many different runs of four characters each unit of 24 and more has (by hash)."""
    if len(codes) < 4:
        return np.zeros(len(n), np.int64)
    at = np.nonzero((unit[:-3] == unit[3:]) & (n[unit[:-3]] >= 24))[0]
    who = unit[at].astype(np.uint64)
    h = who
    for k in range(4):
        h = (h ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    key = np.sort((who << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(n))


class Profiles:
    def __init__(self, texts: list[str] | None, words: Words):
        self.words = words
        self.zh, self.nav = Lexicon(words.zh), Lexicon(NAVIGATION)
        self.longest = max(map(len, words.en), default=0)
        own = [_codes(w) for w in words.en]
        self.en = np.array([_word_keys(c, np.array([0]), np.array([len(c)]), self.longest)[0] for c in own], np.uint64)
        self.symbol = np.array([bool(SYMBOL.match(chr(c))) for c in range(0x10000)])
        self.cache: dict[str, np.ndarray] = {}
        self.kinds: list[str] = []
        self.p: dict[str, np.ndarray] = {}
        if texts is not None:  # texts at hand; `train` learns from a table
            self.know(self.han(texts), len(texts)).learn(self.sums(texts))

    def han(self, texts: list[str]) -> Counter[str]:
        """In how many Chinese texts with sentences each Chinese character stands."""
        some = [t for t in texts if any(s in t for s in "。！？")]
        out: Counter[str] = Counter()
        if some:
            n = np.array([len(t) for t in some])
            words = np.add.reduceat(self.zh.covered(_codes("\n".join([*some, ""]))), np.concatenate([[0], np.cumsum(n + 1)[:-1]]), dtype=np.int64)
            for i in np.nonzero(words > 0.08 * n)[0]:
                out.update({c for c in set(some[i]) if "一" <= c <= "鿿"})
        return out

    def know(self, han: dict[str, int], texts: int) -> "Profiles":
        """Takes the counts of `han` in so many texts."""
        often = max(2, 0.002 * texts)
        common = {c for c, n in han.items() if n >= often} or set(han)
        self.table = np.array([_class(chr(c), common) if not 0xD800 <= c < 0xE000 else 9 for c in range(0x10000)], np.uint8)
        return self

    @staticmethod
    def _places() -> dict[str, slice]:
        """Where each distribution stands in a row of `sums`, behind the number of units."""
        out, at = {}, 1
        for name, k in {"classes": len(CLASSES), "words": 4, **{k: len(v) + 1 for k, v in COUNTS.items()}}.items():
            out[name] = slice(at, at + k)
            at += k
        return out

    def sums(self, texts: list[str]) -> np.ndarray:
        """Of the unmistakable units of each kind, and in the last row of all units: their number, and the sum of each of
        their distributions."""
        places = self._places()
        out = np.zeros((len(KINDS) + 1, 1 + sum(x.stop - x.start for x in places.values())), np.int64)
        us, at = units(texts)
        if not us:
            return out
        place: dict[str, int] = {}
        of = np.array([place.setdefault(u, len(place)) for u in us])  # equal units are described once
        f = self.describe(list(place))
        shares, bins = self._distributions(f)
        siblings = np.bincount(at, minlength=len(texts))[at]
        seed = self._seeds(us, at, {k: x[of] for k, x in f.items()}, siblings)
        one = np.zeros((len(place), out.shape[1]), np.int64)
        one[:, 0] = 1
        for name, x in {**shares, **{k: np.eye(len(COUNTS[k]) + 1)[x] for k, x in bins.items()}}.items():
            one[:, places[name]] = np.rint(x * POINT)
        many = np.rint(self._one_hot("units", siblings) * POINT).astype(np.int64)
        for k in range(len(out)):
            some = seed == k if k < len(KINDS) else np.ones(len(us), bool)
            times = np.bincount(of[some], minlength=len(place))
            out[k] = times[times > 0] @ one[times > 0]
            out[k, places["units"]] = many[some].sum(0)
        return out

    def learn(self, total: np.ndarray) -> "Profiles":
        """Takes the profiles from the `sums` of all texts."""
        places, n = self._places(), total[:, 0]
        self.kinds = [k for i, k in enumerate(KINDS) if n[i] >= 3]
        if self.kinds:
            at = [KINDS.index(k) for k in self.kinds]
            self.p = {name: total[at, x] / POINT / n[at][:, None] for name, x in places.items()}
            # how many units a text has tells rows and items from running text, whose kinds share one profile
            rest = [i for i, k in enumerate(KINDS) if k not in ("list", "table")]
            rest = rest if n[rest].sum() else [len(KINDS)]
            running = total[rest, places["units"]].sum(0) / POINT / n[rest].sum()
            self.p["units"] = np.array([x if k in ("list", "table") else running for k, x in zip(self.kinds, self.p["units"])])
        return self

    @staticmethod
    def _bins(name: str, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(COUNTS[name], float), x, side="left")

    def _one_hot(self, name: str, x: np.ndarray) -> np.ndarray:
        return np.eye(len(COUNTS[name]) + 1)[self._bins(name, x)]

    def _far(self, name: str, bins: np.ndarray) -> np.ndarray:
        """The divergence of a count that falls into one bin from each profile: one value per bin and profile."""
        return _jsd(np.eye(len(COUNTS[name]) + 1)[:, None, :], self.p[name][None, :, :])[bins]

    def describe(self, us: list[str]) -> dict[str, np.ndarray]:
        """Counts of every unit, by name."""
        m = len(us)
        n = np.array([len(u) for u in us])
        start = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        blob = "\n".join(us)
        codes = _codes(blob)
        unit = np.repeat(np.arange(m), n + 1)[:-1]
        body = np.ones(len(codes), bool)
        body[start[1:] - 1] = False
        low = np.minimum(codes, 0xFFFF)
        cls = np.where(codes > 0xFFFF, 9, self.table[low])
        hist = np.bincount(unit[body] * 11 + cls[body], minlength=11 * m).reshape(m, 11).astype(float)

        total = lambda x: np.bincount(unit, weights=x, minlength=m)
        f: dict[str, np.ndarray] = {"n": n.astype(float), "hist": hist, "zh": total(self.zh.covered(codes)), "nav": total(self.nav.covered(codes))}
        latin, digit = (codes < 128) & (cls == 2), (codes < 128) & (cls == 3)
        a, b = _runs(latin & body)
        common = np.isin(_word_keys(codes, a, b, self.longest), self.en) if self.longest else np.zeros(len(a), bool)
        f["en"] = np.bincount(unit[a], weights=(b - a) * common, minlength=m)
        f["n_en"] = np.bincount(unit[a], weights=common, minlength=m)
        f["tokens"] = np.bincount(unit[a], weights=b - a > 1, minlength=m)
        # runs of letters and figures mixed, as in keys and hashes
        a, b = _runs((latin | digit | np.isin(codes, _IN_KEYS)) & body)
        letters, figures = (np.concatenate([[0], np.cumsum(x)]) for x in (latin, digit))
        mixed = (b - a >= 9) & (letters[b] - letters[a] < b - a) & (figures[b] - figures[a] < b - a)
        f["mixed"] = np.bincount(unit[a], weights=(b - a) * mixed, minlength=m)
        f["tags"], f["n_tags"] = np.zeros(m), np.zeros(m)
        for i in np.nonzero(total(np.isin(codes, _IN_TAGS)))[0]:
            spans = [len(x.group()) for x in TAG.finditer(us[i])]
            f["tags"][i], f["n_tags"][i] = sum(spans), len(spans)
        f["symbols"] = np.bincount(unit[body], weights=(self.symbol[low] & (codes <= 0xFFFF))[body], minlength=m) / n
        full = np.isin(codes, np.array([ord(c) for c in "。！？"], np.uint32))
        f["stops"] = np.bincount(unit, weights=full, minlength=m)
        tails = [u.rstrip()[-1:] for u in us]
        stop = np.array([t in STOP and t != "" for t in tails])
        f["closed"] = (stop | (np.array([t == "." for t in tails]) & (f["tokens"] > 4))).astype(float)
        f["marked"] = np.array([bool(ITEM.match(u)) for u in us], float)
        f["columns"] = np.array([_columns(u) for u in us], float)
        f["repetition"] = np.where(n >= 24, np.maximum(0.0, 1 - 6 * _distinct_fours(codes, unit, n) / n), 0.0)
        return f

    def _distributions(self, f: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(the two named distributions, the bin of each basic count) of every unit."""
        size = np.maximum(f["hist"].sum(1, keepdims=True), 1)
        letters = np.maximum(f["hist"][:, :3].sum(1), 1)
        fun = np.stack([f["zh"], f["en"], f["nav"], np.maximum(0.0, letters - f["zh"] - f["en"] - f["nav"])], 1)
        length = np.searchsorted(np.array([15, 30, 60]), f["n"])
        counts = {
            "stops": f["stops"], "closed": f["closed"], "item": np.where(f["marked"] > 0, np.minimum(length, 2) + 4, length), "columns": f["columns"], "repetition": f["repetition"],
            "random": f["mixed"] / f["n"], "symbols": np.where(f["n"] > 30, f["symbols"], 0.0), "markup": f["tags"] / f["n"],
        }
        return {"classes": f["hist"] / size, "words": fun / np.maximum(fun.sum(1, keepdims=True), 1e-9)}, {k: self._bins(k, x) for k, x in counts.items()}

    def _seeds(self, us: list[str], at: np.ndarray, f: dict[str, np.ndarray], siblings: np.ndarray) -> np.ndarray:
        """The kind of each unmistakable unit, -1 for the others."""
        n, hist = f["n"], f["hist"]
        tail = np.array([u[-1] for u in us])
        solid = np.array([len(re.sub(r"[\s|>/»·]", "", u)) if nav else 1 for u, nav in zip(us, f["nav"] > 0)])
        worded = np.array([bool(re.search(r"[A-Za-z]{4}|[一-鿿]{2}|[-|=_]{3}", u)) if s > 0.4 else True for u, s in zip(us, f["symbols"])])
        item = (n < 40) & ~np.isin(tail, list(STOP)) & (hist[:, [0, 2]].sum(1) >= 2)
        items = np.bincount(at, weights=item & (f["columns"] == 0))[at] >= 0.8 * siblings
        rules = [
            ("junk_markup", (f["n_tags"] >= 2) & (f["tags"] > 0.5 * n)), ("junk_garbled", (hist[:, 1] + hist[:, 9] > 0.3 * n) & (n > 10)), ("junk_symbols", (n > 30) & (f["symbols"] > 0.4) & ~worded),
            ("junk_navigation", f["nav"] > 0.6 * solid), ("junk_repeated", f["repetition"] > 0.3), ("junk_random", f["mixed"] > 0.6 * n),
            ("table", (siblings >= 3) & (f["columns"] >= 3) & (n < 120)), ("list", item & ((siblings >= 3) & (f["marked"] > 0) | (siblings >= 5) & items)),
            ("prose_zh", np.isin(tail, list("。！？")) & (n >= 25) & (f["zh"] > 0.05 * n)), ("prose_en", np.isin(tail, list(".!?")) & (n >= 40) & (f["n_en"] >= 4)),
        ]
        return np.select([c for _, c in rules], [KINDS.index(k) for k, _ in rules], -1)

    def divergences(self, us: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per unit: the sum of divergences from each profile without the count of units; the divergence of the two named
        distributions from the nearer prose; the length."""
        shares, bins = self._distributions(self.describe(us))
        named = sum(_jsd(x[:, None, :], self.p[k][None, :, :]) for k, x in shares.items())
        total = named + sum(self._far(k, x) for k, x in bins.items())
        prose = [i for i, x in enumerate(self.kinds) if x.startswith("prose")]
        return total, named[:, prose].min(1) if prose else np.full(len(us), np.nan), np.array([len(u) for u in us])

    def judge_all(self, texts: list[str | None]) -> list[tuple[str | None, str | None, float | None]]:
        """(kind: list, table, junk or None; nearest profile; mean divergence from prose) of each text."""
        none = (None, None, None)
        some = [i for i, t in enumerate(texts) if t is not None and t.strip()]
        if not some or not self.kinds:
            return [none] * len(texts)
        us, at = units([texts[i] for i in some])
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(dict.fromkeys(u for u in us if u not in self.cache))
        fresh: dict[str, np.ndarray] = {}
        if new:
            total, prose, _ = self.divergences(new)
            rows = np.concatenate([total, prose[:, None]], 1)
            fresh = dict(zip(new, rows))
            self.cache.update((u, r) for u, r in fresh.items() if len(u) <= CACHED)
        rows = np.array([fresh[u] if u in fresh else self.cache[u] for u in us])
        n = np.array([len(u) for u in us], float)
        many = np.bincount(at, minlength=len(some))
        total = rows[:, :-1] + self._far("units", self._bins("units", many[at]))
        kind = total.argmin(1)
        k = len(self.kinds)
        sizes = np.bincount(at * k + kind, weights=n, minlength=len(some) * k).reshape(len(some), k)
        far = np.bincount(at, weights=np.nan_to_num(rows[:, -1]) * n, minlength=len(some)) / np.maximum(sizes.sum(1), 1)
        group = np.array([x.split("_")[0] for x in self.kinds])
        by = {g: sizes[:, group == g].sum(1) for g in ("prose", "list", "table", "junk")}
        whole = sizes.sum(1)
        rest = np.stack([by[g] for g in ("list", "table", "junk")], 1)
        best = rest.argmax(1)
        most = rest.max(1)
        is_prose = (by["prose"] >= 0.5 * whole) | (most <= 0.5 * (whole - by["prose"])) & (by["prose"] > most)
        out = [none] * len(texts)
        nearest = sizes.argmax(1)
        for j, i in enumerate(some):
            if whole[j]:
                out[i] = (None if is_prose[j] else ("list", "table", "junk")[best[j]], self.kinds[nearest[j]], float(far[j]))
        return out

    def judge(self, text: str | None) -> tuple[str | None, str | None, float | None]:
        return self.judge_all([text])[0]


def _jsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return (a + b) / 2


def _common(common_words: DataFrame) -> list:
    """The list of common words: a table of the design, which must not exceed MOST_WORDS."""
    w = common_words.filter("word is not null").select("word", "lang").distinct().limit(MOST_WORDS + 1).collect()
    if len(w) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return w


def train(df: DataFrame, common_words: DataFrame, text: str = "text") -> Profiles:
    """Profiles of all different texts; what reaches the driver are the counts of characters and the sums of each kind."""
    w = _common(common_words)
    model = Profiles(None, Words([r["word"] for r in w if r["lang"] == "zh"], [r["word"] for r in w if r["lang"] != "zh"]))
    texts = cut(df.filter(F.col(text).rlike("\\S")).select(F.col(text).alias("t")).distinct(), "texts")

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
        for b in batches:
            for lo in range(0, len(b), STEP):
                yield list(b["t"].iloc[lo : lo + STEP])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        han: Counter[str] = Counter()
        n = 0
        for part in steps(batches):
            han.update(model.han(part))
            n += len(part)
        yield pd.DataFrame({"key": [*han, ""], "n": [*han.values(), n]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = model.sums([])
        for part in steps(batches):
            total += model.sums(part)
        at = np.nonzero(total.ravel())[0]
        yield pd.DataFrame({"key": at, "n": total.ravel()[at]})

    han = {r["key"]: r["n"] for r in texts.mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    model.know({c: n for c, n in han.items() if c}, han.get("", 0))
    total = model.sums([])
    for r in texts.mapInPandas(add, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        total.ravel()[r["key"]] = r["n"]
    remove(texts)
    return model.learn(total)


def judged(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text", model: Profiles | None = None) -> DataFrame:
    """doc_id, kind (list, table, junk or NULL), profile (the nearest), divergence (from prose)."""
    model = model or train(df, common_words, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                r = model.judge_all(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "kind": [x[0] for x in r], "profile": [x[1] for x in r], "divergence": [x[2] for x in r]})

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, kind string, profile string, divergence double")


def statistics(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the basic counts of each text, by column expressions only."""
    w = _common(common_words)
    zh = sorted({r["word"] for r in w if r["lang"] == "zh"}, key=lambda x: (-len(x), x))
    en = sorted({r["word"].lower() for r in w if r["lang"] == "en"})
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    lines = F.filter(F.split(t, "\r\n|\r|\n"), lambda x: x.rlike("\\S"))
    ending = F.size(F.filter(lines, lambda x: x.rlike("[。！？；：.!?;:…”\"）)」』]\\s*$")))
    latin = F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))
    common_en = F.size(F.filter(latin, lambda x: F.lower(x).isin(*en))) if en else F.lit(0)
    common_zh = count(t, "|".join(zh)) if zh else F.lit(0)
    d = df.select(F.col(id_col).alias("doc_id"), F.char_length(t).alias("n_chars"), F.size(lines).alias("n_lines"), F.size(latin).alias("n_latin"), count(t, "[一-鿿]").alias("n_han"), count(t, "[A-Za-z]").alias("n_letters"), count(t, "[^A-Za-z0-9一-鿿\\s]").alias("n_symbols"), ending.alias("n_ending"), (common_en + common_zh).alias("n_common"))
    words = F.col("n_latin") + F.col("n_han")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return d.select("doc_id", "n_chars", "n_lines", words.alias("n_words"), F.round(share(F.col("n_letters") + F.col("n_han"), words), 6).alias("mean_word_length"), F.round(share(F.col("n_symbols"), F.col("n_chars")), 6).alias("symbol_ratio"), F.round(share(F.col("n_ending"), F.col("n_lines")), 6).alias("line_end_share"), F.round(share(F.col("n_common"), words), 6).alias("common_share"))


STATISTICS_SQL = r"""
WITH p AS (
  SELECT coalesce((SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) FROM (SELECT DISTINCT word FROM common_words WHERE lang = 'zh')), '$^') AS zh,
    coalesce((SELECT list(lower(word)) FROM common_words WHERE lang = 'en'), []) AS en
), d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), c AS (
  SELECT doc_id, length(t) AS n_chars,
    list_filter(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')) AS lines,
    regexp_extract_all(t, '[A-Za-z]+') AS latin, len(regexp_extract_all(t, '[一-鿿]')) AS n_han,
    len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '[^A-Za-z0-9一-鿿\s]')) AS n_symbols,
    len(regexp_extract_all(t, p.zh)) AS n_zh, p.en AS en FROM d, p
), e AS (
  SELECT doc_id, n_chars, len(lines) AS n_lines, len(latin) + n_han AS n_words, n_letters + n_han AS n_in_words, n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '[。！？；：.!?;:…”"）)」』]\s*$'))) AS n_ending,
    n_zh + len(list_filter(latin, lambda x: list_contains(en, lower(x)))) AS n_common FROM c
)
SELECT doc_id, n_chars, n_lines, n_words,
  round(CASE WHEN n_words > 0 THEN n_in_words / n_words ELSE 0 END, 6) AS mean_word_length,
  round(CASE WHEN n_chars > 0 THEN n_symbols / n_chars ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN n_lines > 0 THEN n_ending / n_lines ELSE 0 END, 6) AS line_end_share,
  round(CASE WHEN n_words > 0 THEN n_common / n_words ELSE 0 END, 6) AS common_share
FROM e
"""
