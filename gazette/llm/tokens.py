"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

A text is split into pieces by the tokenizer's pattern; each distinct piece is merged once per batch of texts.  Merging
keeps a segment tree over the ranks of adjacent pairs: the root holds the leftmost pair of the lowest rank, a merge
changes three leaves, each a logarithmic number of node updates, until no pair can be merged.  The trees of all pieces of
one size class are one array, so a round of merges over thousands of pieces is a handful of vector operations.

Defined results: NULL and empty texts have no ids (an empty list); blank texts have the ids of their blanks; special
tokens' strings in a text are ordinary text.  Texts are encoded whole.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: the pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000
_INF = np.int64(1) << 60


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Vocabulary and pair ranks of a byte-level BPE, from its .json (merges) or .tiktoken (ranks) file."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER):
        self.split = regex.compile(PATTERN)
        self.cache: dict[str, np.ndarray] = {}
        at = os.path.join(folder, name)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        if os.path.exists(at + ".json"):
            model = json.load(open(at + ".json", encoding="utf-8"))["model"]
            letters, vocab = _byte_letters(), model["vocab"]
            self.byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
            for rank, m in enumerate(model["merges"]):
                a, b = m if isinstance(m, list) else m.split(" ")
                pairs[(vocab[a], vocab[b])] = (rank, vocab[a + b])
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at + ".tiktoken", "rb"))}
            self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
            for t, r in ranks.items():
                for i in range(1, len(t)):
                    a, b = ranks.get(t[:i]), ranks.get(t[i:])
                    if a is not None and b is not None:
                        pairs[(a, b)] = (r, r)
        key = np.array([a << 20 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        got = np.array(list(pairs.values()), dtype=np.int64)[order]
        self.key, self.rank, self.merged = np.append(key[order], _INF), np.append(got[:, 0], 0), np.append(got[:, 1], 0)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, merged id) of pairs of ids; a negative id is no token."""
        k = a << np.int64(20) | b
        i = np.searchsorted(self.key, k)
        hit = (self.key[i] == k) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[i], -1), self.merged[i]

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) == 1:
                out[k] = self.byte[[p[0]]].astype(np.int32)
            elif p:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for size, members in classes.items():
            step = max(1, (1 << 19) // size)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for k, ids in zip(part, self._trees([pieces[k] for k in part], size)):
                    out[k] = ids
        return out

    def _trees(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        n = len(pieces)
        ids = np.full((n, size + 1), -1, dtype=np.int64)
        for i, p in enumerate(pieces):
            ids[i, : len(p)] = self.byte[np.frombuffer(p, dtype=np.uint8)]
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))  # next living position
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
        rank, _ = self._pair(ids[:, :-1], ids[:, 1:])
        tree = np.empty((n, 2 * size), dtype=np.int64)
        tree[:, size:] = np.where(rank >= 0, rank * size + np.arange(size), _INF)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.nonzero(tree[:, 1] < _INF)[0]
        while len(live):
            at = (tree[live, 1] % size).astype(np.int64)
            right = after[live, at]
            _, new = self._pair(ids[live, at], ids[live, right])
            beyond = after[live, right]
            ids[live, at] = new
            ids[live, right] = -1
            after[live, at] = beyond
            inside = beyond <= size
            before[live[inside], beyond[inside]] = at[inside]
            left = before[live, at]
            r_right, _ = self._pair(new, np.where(inside, ids[live, np.minimum(beyond, size)], -1))
            r_left, _ = self._pair(np.where(left >= 0, ids[live, np.maximum(left, 0)], -1), new)
            rows = np.concatenate([live, live, live])
            leaf = np.concatenate([right.astype(np.int64), at, np.where(left >= 0, left, at).astype(np.int64)])
            keep = np.where(left >= 0, np.where(r_left >= 0, r_left * size + left, _INF), np.where(r_right >= 0, r_right * size + at, _INF))
            value = np.concatenate([np.full(len(live), _INF), np.where(r_right >= 0, r_right * size + at, _INF), keep])
            use = leaf < size
            rows, node = rows[use], leaf[use] + size
            tree[rows, node] = value[use]
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < _INF]
        return [row[row >= 0].astype(np.int32) for row in ids]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; an empty array for an empty text and None."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        new = list({p for ps in cut for p in ps if p not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list({p for ps in cut for p in ps})
        self.cache.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new])))
        empty = np.empty(0, np.int32)
        return [np.concatenate([self.cache[p] for p in ps]) if ps else empty for ps in cut]


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(name: str, folder: str) -> ByteBPE:
    """One per Python worker."""
    if (name, folder) not in _loaded:
        _loaded[(name, folder)] = ByteBPE(name, folder)
    return _loaded[(name, folder)]


def _blocks(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Spans of a batch with a bounded number of characters, so that long texts don't add up in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id, ids of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(name, folder)
        for b in batches:
            texts = list(b["text"])
            for i, j in _blocks(texts):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j], "ids": bpe.encode(texts[i:j])})

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def counted(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """df without its text and with `n_tokens`, the number of ids of the text (in place of a column of that name)."""
    rest = [c for c in df.columns if c not in (text, "n_tokens")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(name, folder)
        for b in batches:
            texts = list(b[text])
            sizes = [len(x) for i, j in _blocks(texts) for x in bpe.encode(texts[i:j])]
            yield b[rest].assign(n_tokens=np.array(sizes, dtype=np.int64))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in rest] + ["n_tokens long"])
    return df.mapInPandas(run, schema)
