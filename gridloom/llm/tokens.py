"""Byte-level BPE encoding of a whole corpus: speculate, verify, repair.

A text is split into words by the public pattern of the vocabulary. For each
distinct word

1. *speculate*: greedy longest match proposes tokens;
2. *verify*: a proposal is the merge result if and only if each adjacent pair
   is what merging the pair alone would give. All pairs of a batch are tested
   at once with numpy by walking both merge trees down from the boundary;
3. *repair*: only words with a failing pair are merged exactly, with a heap,
   in O(n log n) of their length.

Every row is encoded on its own, in one narrow pass over ``(id, text)``: no
shuffle, nothing collected, so neither a hot host nor repeated texts matter.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARIES = "/opt/tokenizers"

#: The public split pattern of these byte-level vocabularies (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words one Python worker remembers, and the longest it remembers.
#: Only a cache: words beyond it are encoded anew.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Characters of text encoded together; bounds a worker's memory.
SLICE_CHARS = 2_000_000

_NEVER = np.int64(2**40)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge trees and ranks of one byte-level BPE file (JSON form)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.ids = {bytes(letter[c] for c in t): i for t, i in ids.items() if all(c in letter for c in t)}
        self.longest = max(map(len, self.ids))
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = np.empty(len(model["merges"]), np.int64)
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges.setdefault((x, y), (rank, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
            pairs[rank] = x * size + y
        self.size = size
        self.order = np.argsort(pairs, kind="stable")
        self.keys = pairs[self.order]
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.own: dict[int, bool] = {}

    # -- 1: speculate ---------------------------------------------------------
    def propose(self, word: bytes) -> list[int]:
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    # -- 2: verify --------------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of tokens, whether each pair ``a[i], b[i]`` stays apart.

        Going back in time from the finished pair, the later of both tokens is
        undone; the pair then at the boundary must not have a merge that ranks
        before the one undone. Of equal merges the left one is done first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NEVER)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            merged = np.where(self.keys[at] == key, self.order[at], _NEVER)
            bad = merged < limit[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            left = rx > ry
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
            limit[live] = np.where(left, rx, ry + 1)
            live = live[~bad & ~((rx < 0) & (ry < 0))]
        return good

    def stands(self, token: int, word: bytes) -> bool:
        """Whether merging a token's own bytes gives that token."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merge(word) == [token]
        return known

    # -- 3: repair ----------------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        tok = [self.byte[c] for c in word]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := self.merges.get((tok[i], tok[i + 1])):
                heap.append((m[0], i, tok[i], tok[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = nxt[i] if tok[i] == x else n
            if j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = z, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := self.merges.get((z, tok[k])):
                    heapq.heappush(heap, (m[0], i, z, tok[k], m[1]))
            if (h := prv[i]) >= 0 and (m := self.merges.get((tok[h], z))):
                heapq.heappush(heap, (m[0], h, tok[h], z, m[1]))
        return [t for t in tok if t >= 0]

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Token ids of each word, and how many words needed exact merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [self.propose(w) for w in raw]
        doubtful = {i for i, t in enumerate(out) if len(t) == 1 and not self.stands(t[0], raw[i])}
        lens = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(lens.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), lens)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pair, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            good = self.compatible(pair // self.size, pair % self.size)
            doubtful.update(owner[inside[~good[back]]].tolist())
        for i in doubtful:
            out[i] = self.merge(raw[i])
        return out, len(doubtful)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One copy per Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Encoder:
    """Encodes lists of texts; remembers short words between calls."""

    def __init__(self, path: str):
        import regex

        self.vocab = vocabulary(path)
        self.split = regex.compile(WORD_PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts in a row."""
        words, ends = [], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.split(t)
            ends[i + 1] = len(words)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in set(words) if w not in known]
        ids, _ = self.vocab.encode(new)
        known.update(zip(new, ids))
        lens = np.fromiter((len(known[w]) for w in words), np.int64, len(words))
        total = np.concatenate(([0], np.cumsum(lens)))
        flat = np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32, int(total[-1]))
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del known[w]
        return total[ends], flat


_encoders: dict[str, Encoder] = {}


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = f"{VOCABULARIES}/byte_bpe_50k.json"
) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row of ``df``.

    Texts are taken exactly as they stand, whole, without special tokens. A null
    text and an empty text both give an empty list; a null id stays null;
    repeated rows stay repeated; other columns are not read. ``vocab`` must be
    readable at that path by every executor.
    """
    if not vocab.endswith(".json"):
        raise ValueError("vocab must be a byte-level BPE file in its JSON form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(vocab) or _encoders.setdefault(vocab, Encoder(vocab))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = chars = 0
            for stop, t in enumerate(texts, 1):
                chars += len(t or "")
                if chars >= SLICE_CHARS or stop == len(texts):
                    ends, flat = enc(texts[start:stop])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), lists], names=["k", "ids"])
                    start, chars = stop, 0

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def default_vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, name)
