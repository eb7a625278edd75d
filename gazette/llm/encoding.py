"""Text decoded with the wrong character encoding (problem 6).

A stretch of text (a line; inside it the runs that one encoding can have produced) has a latent chain: clean, or one of
`CHAINS`, which says with what it was decoded and what it really was.  Under a chain the stretch has the probability of
its restored text in a character bigram model of clean text; a chain that cannot have produced it has none, and `lost`
stands for text whose bytes are gone.  Weights of the chains per source and field come from EM over all suspicious
stretches of that source and field, so that weak evidence of one record is pooled with the others'; each stretch is then
assigned by posterior, and repaired where its chain can be undone.

The text is read once: stretches with their likelihoods go to a table in the shared folder, which every round of the EM
sums up.

Defined results: NULL and blank values are no case; rightful accents, symbols and rare characters stay (no chain makes
them likelier); repeated rows are treated alike; a value without a source has the source ''.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.units import let
from gazette.session import cut, remove

MOST_KEYS = 1_000_000  # different pairs that a task gathers before it hands them on
SMALL = 200_000  # rows up to which a counted side is broadcast
#: chain: (what it was decoded with, what it is), the last step first
CHAINS = {
    "utf8_as_latin1": [("latin1", "utf8")],
    "utf8_as_cp1252": [("cp1252", "utf8")],
    "utf8_as_latin1_twice": [("latin1", "utf8"), ("latin1", "utf8")],
    "utf8_as_cp1252_twice": [("cp1252", "utf8"), ("cp1252", "utf8")],
    "utf8_as_gbk": [("gb18030", "utf8")],
    "gbk_as_latin1": [("latin1", "gb18030")],
    "gbk_as_cp1252": [("cp1252", "gb18030")],
    "gbk_as_big5": [("big5", "gb18030")],
    "gbk_as_utf8": [("utf8", "gb18030")],
    "big5_as_gbk": [("gb18030", "big5")],
}
NAMES = ["clean", *CHAINS, "lost"]
LOST_MARK = "�"
LATIN = ("latin1", "cp1252")
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_RUN = {
    "latin1": re.compile("[\x00-\xff]*[\x80-\xff][\x00-\xff]*"),
    "cp1252": re.compile("[\x00-\xff" + "".join(map(re.escape, _CP1252)) + "]+"),
}
SIGN = {LOST_MARK, *map(chr, range(0x80, 0xA0)), *map(chr, range(0xE000, 0xF900))}
HARD = "[\\u0080-\\u009f\\ufffd\\ue000-\\uf8ff]|[\\u00a0-\\u00ff]{2}"


def _bytes(text: str, enc: str) -> bytes | None:
    if enc == "cp1252":  # with the bytes cp1252 leaves open kept as they are
        try:
            return bytes(_CP1252[c] if c in _CP1252 else ord(c) for c in text)
        except ValueError:
            return None
    if enc == "big5":
        out = b""
        for c in text:
            for e in ("big5", "cp950", "big5hkscs"):
                try:
                    out += c.encode(e)
                    break
                except UnicodeEncodeError:
                    continue
            else:
                if c != LOST_MARK:
                    return None
                out += b"\xff"
        return out
    if LOST_MARK in text and enc != "utf8":
        parts = [p.encode(enc, "strict") if _can(p, enc) else None for p in text.split(LOST_MARK)]
        return None if None in parts else b"\xff".join(parts)
    return text.encode(enc) if _can(text, enc) else None


def _can(text: str, enc: str) -> bool:
    try:
        text.encode(enc)
        return True
    except UnicodeEncodeError:
        return False


def undo(text: str, chain: str) -> str | None:
    """The text before the chain garbled it, lost bytes as U+FFFD; None if the chain cannot have produced it."""
    for enc, real in CHAINS[chain]:
        raw = _bytes(text, enc)
        if raw is None:
            return None
        if enc == "utf8" and LOST_MARK in text:
            return None
        fixed = raw.decode(real, "replace")
        if fixed == text:
            return None
        text = fixed
    return text


BITS = 21  # of a code point
DOCS = 1 << 2 * BITS  # added to a character: its count is that of the texts that have it
_DIGITS = set("123456789")


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, the sum of the counts of each)."""
    got, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(got), np.int64)
    np.add.at(total, at, n)
    return got, total


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of neighbours, digits as one, and characters + DOCS; how often the pair stands, how many texts have the character)."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 49) & (codes <= 57), np.uint32(48), codes)
    if len(codes) and codes.max() < 0x10000:  # half as wide, sorted sooner
        pairs, n = np.unique((codes[:-1] << np.uint32(16)) | codes[1:], return_counts=True)
        pairs = (pairs.astype(np.int64) >> 16 << BITS) | (pairs & np.uint32(0xFFFF))
    else:
        pairs, n = np.unique((codes[:-1].astype(np.int64) << BITS) | codes[1:], return_counts=True)
    df: Counter[str] = Counter()
    for t in texts:
        have = set(t)
        df.update(have if _DIGITS.isdisjoint(have) else (have - _DIGITS) | {"0"})
    return np.concatenate([pairs, np.array([ord(c) + DOCS for c in df], np.int64)]), np.concatenate([n, np.array(list(df.values()), np.int64)])


class CharModel:
    """Interpolated character bigrams of clean text."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, texts: int, vocabulary: int = 25_000, common: float = 0.002):
        """From what `counted` finds in so many texts."""
        docs = keys >= DOCS
        keys, n, chars, k = keys[~docs], n[~docs], keys[docs] - DOCS, n[docs]
        first, second = keys >> BITS, keys & (1 << BITS) - 1
        total = n.sum() or 1
        self.floor = math.log(0.02 / vocabulary)
        ends, at = np.unique(second, return_inverse=True)
        share = 0.18 * np.bincount(at, weights=n) / total if len(n) else np.zeros(0)
        self.uni = {chr(c): x for c, x in zip(ends.tolist(), share.tolist())}
        _, of = np.unique(first, return_inverse=True)
        before = np.bincount(of, weights=n)[of] if len(n) else n
        logs = np.log(0.8 * n / before + (share[at] if len(n) else 0) + 0.02 / vocabulary)
        self.bi = {(chr(a), chr(b)): x for a, b, x in zip(first.tolist(), second.tolist(), logs.tolist())}
        self.one = {c: math.log(x + 0.02 / vocabulary) for c, x in self.uni.items()}
        often = max(2, texts * common)
        self.common = {chr(c) for c in chars[k >= often].tolist()} | set("0123456789")

    def score(self, text: str) -> float:
        s = "\n" + _digits(text) + "\n"
        bi, one, floor = self.bi, self.one, self.floor
        total = 0.0
        for p in zip(s, s[1:]):
            x = bi.get(p)
            if x is None:
                c = p[1]
                x = one.get(c, floor) if c != LOST_MARK else -14.0
            total += x
        return total


_DIG = str.maketrans("123456789", "000000000")


def _digits(t: str) -> str:
    return t.translate(_DIG)


def likelihoods(text: str, model: CharModel) -> list[float]:
    """Log likelihood of the stretch under each of NAMES."""
    out = [model.score(text)]
    for name in CHAINS:
        fixed = undo(text, name)
        if fixed is None or (fixed.count(LOST_MARK) > 0.34 * len(fixed)):
            out.append(-1e4)
        else:
            out.append(model.score(fixed) - 2.0)
    k = text.count(LOST_MARK)
    odd = sum(c not in model.common for c in text)
    out.append(k * -2.0 + odd * -9.0 + (len(text) - k - odd) * -5.0 if k else -1e4)
    return out


def stretches(text: str, model: CharModel, whole: bool = False) -> list[tuple[int, int]]:
    """Places of the stretches that might be garbled: lines, or runs in a line, with characters clean text hardly has."""
    out, at = [], 0
    for line in text.split("\n"):
        odd = set(line) - model.common
        if odd:
            body = line.strip()
            a = at + line.index(body) if body else at
            half = 2 * sum(c in odd for c in body) >= len(body)  # a word of which one character is odd is judged as a whole
            if whole or half or not _mixed(body, model):
                spans = [(a, a + len(body))]
            else:
                spans = [(a + i, a + j) for i, j in _runs(body, model)]
            # one rare character by itself, among others, is a rare character
            out.extend((i, j) for i, j in spans if half and len(body) > 1 or sum(text[k] not in model.common for k in range(i, j)) >= 2 or not SIGN.isdisjoint(text[i:j]))
        at += len(line) + 1
    return out


def _mixed(line: str, model: CharModel) -> bool:
    """Clean wide characters beside characters that only one-byte decoding makes, or a garbled part in a clean line."""
    wide = sum(c > "⹿" and c in model.common for c in line)
    thin = sum("\x80" <= c <= "\xff" or c in _CP1252 for c in line)
    return wide > 0 and thin > 0 or (wide > 0.5 * len(line))


def _runs(line: str, model: CharModel) -> list[tuple[int, int]]:
    """Runs of a mixed line: maximal stretches between clean wide characters (at most one of them inside)."""
    out = []
    for m in re.finditer("[\x20-\xff" + "".join(map(re.escape, _CP1252)) + "]*[\x80-\xff" + "".join(map(re.escape, _CP1252)) + "][\x20-\xff" + "".join(map(re.escape, _CP1252)) + "]*", line):
        out.append(m.span())
    last = None
    for i, c in enumerate(line):
        odd = c > "\xff" and c not in model.common and c not in _CP1252
        if odd:
            if last is not None and i - last[1] <= 3:
                last[1] = i + 1
            else:
                if last is not None:
                    out.append(tuple(last))
                last = [i, i + 1]
    if last is not None:
        out.append(tuple(last))
    return out


def garble_signs(model: CharModel, top: int = 400) -> str:
    """Characters that garbled forms of the most frequent clean characters are made of and clean text hardly has."""
    often = [c for c, _ in sorted(model.uni.items(), key=lambda x: -x[1]) if c > "⹿"][:top]
    pairs = [a + b for (a, b), _ in sorted(model.bi.items(), key=lambda x: -x[1] - model.one.get(x[0][0], -99)) if a > "⹿" and b > "⹿"][: 8 * top]
    signs: set[str] = set(LOST_MARK)
    for t in often + pairs:
        for steps in CHAINS.values():
            s = t
            try:
                for enc, real in reversed(steps):
                    raw = s.encode(real)
                    s = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in raw) if enc == "cp1252" else raw.decode(enc, "replace")
            except UnicodeEncodeError:
                continue
            signs |= set(s)
    return "".join(sorted(c for c in signs if c not in model.common and c > "\x7f"))


def _garbled(texts: list[str], signs: np.ndarray) -> list[tuple[str, str]]:
    """(text, text without those lines that consist of what garbling makes) of the texts that have such lines."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.nonzero(codes == 10)[0]
    if not len(ends):
        return []
    begin = np.concatenate([[0], ends[:-1] + 1])
    wide, odd = (np.add.reduceat(x, begin, dtype=np.int64) for x in (codes > 0x7F, signs[codes]))
    bad = odd > 0.4 * wide
    out, at = [], 0
    lines = np.concatenate([[0], np.cumsum([t.count("\n") + 1 for t in texts])])
    for i in np.unique(np.searchsorted(lines, np.nonzero(bad)[0], side="right") - 1):
        at = lines[i]
        out.append((texts[i], "\n".join(x for k, x in enumerate(texts[i].split("\n")) if not bad[at + k])))
    return out


def _without(texts: list[str], signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `counted` has to be changed by if the garbled lines are left out."""
    pairs = _garbled(texts, signs)
    old, new = counted([a for a, _ in pairs]), counted([b for _, b in pairs])
    return _tally(np.concatenate([old[0], new[0]]), np.concatenate([-old[1], new[1]]))


def _signs(model: CharModel) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in garble_signs(model)]] = True
    return out


def _sums(d: DataFrame, count: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, their sums, the number of texts) of what `count` finds in all texts t of d."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = list(b["t"].iloc[lo : lo + 2000])
                k, m = count(part)
                keys, n = _tally(np.concatenate([keys, k]), np.concatenate([n, m]))
                texts += len(part)
            if len(keys) > MOST_KEYS:
                yield pd.DataFrame({"key": keys, "n": n})
                keys, n = keys[:0], n[:0]
        yield pd.DataFrame({"key": np.append(keys, -1), "n": np.append(n, texts)})

    got = d.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 0").toPandas()
    key, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    return key[key >= 0], n[key >= 0], int(n[key < 0].sum())


def train(df: DataFrame, fields: list[str]) -> CharModel:
    """A model of all values of the fields without a hard sign of garbling; what reaches the driver are counts of pairs and characters."""
    texts = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("t"))
    clean = texts.filter(F.col("t").rlike("\\S") & ~F.col("t").rlike(HARD))
    keys, n, total = _sums(clean, counted)
    signs = _signs(CharModel(keys, n, total, common=0.015))
    less = _sums(clean, lambda t: _without(t, signs))
    return _model(keys, n, less, total)


def _model(keys: np.ndarray, n: np.ndarray, less: tuple, total: int) -> CharModel:
    keys, n = _tally(np.concatenate([keys, less[0]]), np.concatenate([n, less[1]]))
    return CharModel(keys[n > 0], n[n > 0], total)


def purified(texts: list[str]) -> CharModel:
    """A model of the texts without those lines that consist of what garbling makes of frequent characters."""
    keys, n = counted(texts)
    return _model(keys, n, _without(texts, _signs(CharModel(keys, n, len(texts), common=0.015))), len(texts))


def suspicious(df: DataFrame, id_col: str, fields: list[str], source: Column, model: CharModel) -> DataFrame:
    """id, field, source, start, stop, ll: every stretch that might be garbled, with its likelihoods.

    Read are all values with a character that clean text hardly has: no other value has a stretch.
    """
    usual = "".join(sorted(c for c in model.common if c != "\n"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    odd = lambda c: F.replace(F.translate(c, usual, ""), F.lit("\n"), F.lit("")) != ""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("source"), F.filter(pairs, lambda p: odd(p["text"])).alias("p")).filter(F.size("p") > 0)
    d = d.select("id", "source", F.explode("p").alias("p")).select("id", "source", F.col("p.field").alias("field"), F.col("p.text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s, f, t in zip(b["id"], b["source"], b["field"], b["text"]):
                for x, y in stretches(t, model):
                    rows.append((i, s, f, x, y, likelihoods(t[x:y], model)))
            yield pd.DataFrame(rows, columns=["id", "source", "field", "start", "stop", "ll"])

    return d.mapInPandas(run, "id long, source string, field string, start int, stop int, ll array<double>")


def _posterior(ll: Column, w: Column) -> Column:
    """The probability of each of NAMES for likelihoods and weights."""
    logs = F.zip_with(ll, w, lambda x, y: x + F.log(y))
    relative = lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    scaled = lambda a: let(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), lambda t: F.transform(a, lambda x: x / t))
    return let(let(logs, relative), scaled)


def weights(sus: DataFrame, rounds: int = 30, prior: float = 1.0, still: float = 1e-2) -> DataFrame:
    """source, field, w (array over NAMES) by EM over all stretches of that source and field.

    A round is one sum of posteriors per source and field, combined before it is sent, with the likelihoods as they are;
    no group is gathered.  It ends when no weight moves by more than `still`, at the latest after `rounds`.
    """
    k = len(NAMES)
    even = F.array(*[F.lit(1.0 / k)] * k)
    w = sus.groupBy("source", "field").agg(F.lit(1).alias("one")).select("source", "field", even.alias("w"))
    few = w.count() <= SMALL
    old = None
    for _ in range(rounds):
        p = sus.join(F.broadcast(w) if few else w, ["source", "field"]).select("source", "field", "w", _posterior(F.col("ll"), F.col("w")).alias("p"))
        sums = p.groupBy("source", "field").agg(F.first("w").alias("old"), F.count("*").alias("n"), *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)])
        new = cut(sums.select("source", "field", "old", F.array(*[(F.col(f"s{i}") + prior / k) / (F.col("n") + prior) for i in range(k)]).alias("w")), "weights")
        moved = new.agg(F.max(F.array_max(F.zip_with("w", "old", lambda a, b: F.abs(a - b))))).first()[0]
        if old is not None:
            remove(old)
        old, w = new, new.select("source", "field", "w")
        if moved is None or moved <= still:
            break
    return w


def assigned(df: DataFrame, id_col: str, fields: list[str], source: Column, model: CharModel | None = None) -> DataFrame:
    """id, field, start, stop, chain, probability of every stretch whose most likely chain is not `clean`."""
    model = model or train(df, fields)
    sus = cut(suspicious(df, id_col, fields, source, model), "encoding")
    d = sus.join(weights(sus), ["source", "field"]).withColumn("p", _posterior(F.col("ll"), F.col("w")))
    d = d.withColumn("probability", F.array_max("p")).withColumn("k", F.array_position("p", F.col("probability")).cast("int"))
    d = d.withColumn("chain", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("k")))
    return d.filter("k > 1").select("id", "field", "start", "stop", "chain", "probability")


def found(df: DataFrame, id_col: str, fields: list[str], source: Column) -> DataFrame:
    """id, field of every value with at least one garbled stretch."""
    return assigned(df, id_col, fields, source).select("id", "field").distinct()


def mend(text: str, parts: list[tuple[int, int, str]]) -> str:
    for a, b, chain in sorted(parts, reverse=True):
        fixed = undo(text[a:b], chain) if chain in CHAINS else None
        if fixed is not None:
            text = text[:a] + fixed + text[b:]
    return text


def restored(df: DataFrame, id_col: str, fields: list[str], source: Column) -> DataFrame:
    """id, field, text, whole: the original text of every garbled value as far as it can be recovered.

    `whole`: no byte of it is lost.
    """
    a = cut(assigned(df, id_col, fields, source), "assigned")
    parts = a.groupBy("id", "field").agg(F.collect_list(F.struct("start", "stop", "chain")).alias("parts"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p")
    t = df.select(F.col(id_col).alias("id"), pairs).select("id", F.col("p.field").alias("field"), F.col("p.text").alias("text"))
    # texts without a stretch leave before anything is sent, where the ids of the others are few enough to go to all tasks
    ids = a.select("id", "field").distinct()
    if ids.count() <= SMALL:
        t = t.join(F.broadcast(ids), ["id", "field"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [mend(x, [(p["start"], p["stop"], p["chain"]) for p in ps]) for x, ps in zip(b["text"], b["parts"])]
            yield pd.DataFrame({"id": b["id"], "field": b["field"], "text": texts, "whole": [LOST_MARK not in x for x in texts]})

    return t.join(parts, ["id", "field"]).mapInPandas(run, "id long, field string, text string, whole boolean")
