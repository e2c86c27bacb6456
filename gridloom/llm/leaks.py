"""Passages of evaluation items inside training texts.

A positional inverted index of the training texts is stored: for every text the
postings ``(pos, term)`` of the terms that any item uses. It is partitioned by
document, as the texts are read, so each partition is an index of its own and
building it moves nothing. Items are laid before every partition, as queries are
before the shards of a search engine: the postings of an item's rarest terms,
counted over all texts, give candidates ``(doc, item, shift)``, whose lists are
then intersected, offset-adjusted, with those of all other terms.

So nothing is shuffled but counts and results, and neither a frequent term nor a
passage that a third of all texts hold is a hot key. Items are taken in blocks of
bounded size, each against all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .lookalike import caseless

#: Words of passages that are laid before the partitions at once; more items are
#: taken block by block.
BLOCK_WORDS = 2_000_000
#: Characters, postings and candidate positions worked on at once; they bound a
#: worker's memory only.
SLICE_CHARS, SLICE_POSTINGS, SLICE_CANDIDATES = 4_000_000, 100_000, 1_000_000


def spaced_words(text: Column) -> Column:
    """The words of a text with one blank between: runs of letters and digits,
    case and what problem 9 calls invisible put into one form. Null gives null."""
    return F.trim(F.regexp_replace(caseless(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Words of a text. Null and empty texts give an empty array."""
    return F.coalesce(F.filter(F.split(spaced_words(text), " "), lambda w: w != ""), F.array().cast("array<string>"))


# -- items ------------------------------------------------------------------------


class Passages:
    """A block of passages as flat arrays of term numbers."""

    def __init__(self, ids: list[int], passages: list[list[str]]):
        self.ids = np.array(ids, np.int64)
        self.size = np.array([len(p) for p in passages], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        flat = [w for p in passages for w in p]
        self.vocab = sorted(set(flat))
        number = {w: i for i, w in enumerate(self.vocab)}
        self.term = np.fromiter((number[w] for w in flat), np.int64, len(flat))

    def each(self) -> Iterator[tuple[int, np.ndarray]]:
        for i, (a, b) in enumerate(zip(self.start[:-1], self.start[1:])):
            yield i, self.term[a:b]


def passage_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Passages]:
    """The different passages in blocks of about ``block_words`` words. Null ids
    are left out; repeated rows count once."""
    rows = (
        items.where(F.col(item_col).isNotNull())
        .select(F.col(item_col).cast("bigint").alias("item_id"), words(F.col(text_col).cast("string")).alias("w"))
        .where(F.size("w") > 0)
        .distinct()
    )
    rows = stored(rows, "passages")
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = 1 + total // block_words
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == k).collect()  # about block_words words
        yield Passages([r.item_id for r in part], [r.w for r in part])


# -- index ------------------------------------------------------------------------


def run_sizes(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each entry and run sizes, where a run goes on with the next
    place of one owner."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0)))
    run = np.cumsum(new) - 1
    return run, np.bincount(run)


def positional_index(docs: DataFrame, vocab: list[str], least_run: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings ``(doc_id, pos array<int>, term array<int>)``, by place, of
    every occurrence in ``docs`` of a term of ``vocab`` that stands in a run of at
    least ``least_run`` such terms. Texts without any and rows of null ids or
    texts have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    slim = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), spaced_words(F.col(text_col).cast("string")).alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.string())
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(chars // SLICE_CHARS)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    part = batch.slice(a, b - a)
                    lists = pc.split_pattern(part.column(1), " ")
                    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                    first = np.concatenate(([0], np.cumsum(size)))
                    at = np.flatnonzero(term >= 0)
                    owner = np.searchsorted(first, at, "right") - 1
                    number, sizes = run_sizes(at, owner)
                    dense = sizes[number] >= least_run
                    at, owner = at[dense], owner[dense]
                    have, begin = np.unique(owner, return_index=True)
                    ends = pa.array(np.concatenate((begin, [len(at)])), pa.int32())
                    place = pa.ListArray.from_arrays(ends, pa.array(at - first[owner], pa.int32()))
                    which = pa.ListArray.from_arrays(ends, pa.array(term[at], pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(have)), place, which], names=["doc_id", "pos", "term"])

    return stored(slim.mapInArrow(run, "doc_id bigint, pos array<int>, term array<int>"), "postings")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over all texts; as many numbers as the block of items
    has terms."""
    out = np.zeros(n_terms, np.int64)
    for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        out[r.term] = r["count"]
    return out


# -- search -----------------------------------------------------------------------


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the owner of each unit, and its place within the owner."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _chunks(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of entries whose counts add up to about ``most``."""
    cut = np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1
    for a, b in zip([0, *cut], [*cut, len(n)]):
        if b > a:
            yield slice(a, b)


def _different(*cols: np.ndarray) -> list[np.ndarray]:
    """The different rows of some columns, sorted."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    if not len(order):
        return cols
    new = np.concatenate(([True], np.any([np.diff(c) != 0 for c in cols], axis=0)))
    return [c[new] for c in cols]


class _Anchors:
    """Places of the passages by the key that stands there."""

    def __init__(self, key: np.ndarray, passage: np.ndarray, place: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.passage, self.place = key[order], passage[order], place[order]

    def meet(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(index of the asked key, passage, place)`` of all equal ones."""
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        hit = np.flatnonzero(high > low)
        for s in _chunks((high - low)[hit], SLICE_CANDIDATES):
            owner, k = _spread((high - low)[hit[s]])
            at = low[hit[s]][owner] + k
            yield hit[s][owner], self.passage[at], self.place[at]


class PhraseSearch:
    """Runs of at least ``least`` words of a passage. Anchors are, of each run of so
    many words, the two neighbours with the least product of postings."""

    def __init__(self, q: Passages, counts: np.ndarray, least: int):
        self.q, self.least, self.terms = q, least, max(1, len(q.vocab))
        passage, place = [], []
        for i, t in q.each():
            if len(t) >= least:
                n = counts[t]
                pair = np.lib.stride_tricks.sliding_window_view(n[:-1].astype(float) * n[1:], least - 1)
                known = np.lib.stride_tricks.sliding_window_view(n > 0, least).all(axis=1)
                at = np.unique((np.arange(len(pair)) + pair.argmin(axis=1))[known])
                passage.append(np.full(len(at), i))
                place.append(at)
        passage, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (passage, place))
        first = q.start[passage] + place
        self.anchors = _Anchors(q.term[first] * self.terms + q.term[np.minimum(first + 1, len(q.term) - 1)] if len(first) else first, passage, place)

    def __call__(self, doc: np.ndarray, pos: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(doc, passage, words)`` of postings sorted by document and place."""
        q = self.q
        next_to = np.flatnonzero((np.diff(doc) == 0) & (np.diff(pos) == 1))
        found = []
        for at, passage, place in self.anchors.meet(term[next_to] * self.terms + term[next_to + 1]):
            at = next_to[at]
            found.append(_different(doc[at], passage, pos[at] - place))
        if not found:
            return
        d, p, shift = _different(*(np.concatenate(c) for c in zip(*found)))
        wide = int(pos.max()) + 2
        key = doc * wide + pos
        for s in _chunks(q.size[p], SLICE_CANDIDATES):
            owner, i = _spread(q.size[p[s]])
            want = shift[s][owner] + i
            asked = d[s][owner] * wide + want
            k = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            met = np.flatnonzero((want >= 0) & (want < wide) & (key[k] == asked) & (term[k] == q.term[q.start[p[s]][owner] + i]))
            run, sizes = run_sizes(i[met], owner[met])
            best = np.zeros(len(d[s]), np.int64)
            np.maximum.at(best, owner[met], sizes[run])
            ok = best >= self.least
            yield d[s][ok], p[s][ok], best[ok]


class NearSearch:
    """Stretches of a passage of which at most ``missing`` words are not in place,
    give or take ``slack`` words. So of the ``missing + k`` rarest words of such a
    stretch at least ``k`` are in place; these are the anchors."""

    EXTRA = 3

    def __init__(self, q: Passages, counts: np.ndarray, run: int, missing: int, slack: int, least: int):
        self.q, self.slack, self.terms = q, slack, max(1, len(q.vocab))
        self.run = np.minimum(q.size, run)
        self.need = np.maximum(1, np.ceil(self.run * (run - missing) / run - 1e-9).astype(np.int64))
        self.few = np.ones(len(q.size), np.int64)
        passage, place = [], []
        for i, t in q.each():
            lost = int(self.run[i] - self.need[i])
            if len(t) < least:
                continue
            width = int(self.run[i])
            some = min(width, lost + self.EXTRA)
            self.few[i] = max(1, some - lost)
            n = np.lib.stride_tricks.sliding_window_view(counts[t], width)
            rare = np.argsort(n, axis=1, kind="stable")[:, :some]
            can = (n == 0).sum(axis=1) <= lost
            at = np.unique((rare + np.arange(len(n))[:, None])[can])
            passage.append(np.full(len(at), i))
            place.append(at)
        passage, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (passage, place))
        self.anchors = _Anchors(q.term[q.start[passage] + place], passage, place)

    def __call__(self, doc: np.ndarray, pos: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, slack = self.q, self.slack
        found = []
        for at, passage, place in self.anchors.meet(term):
            b = (pos[at] - place) // slack
            found.append(_different(np.tile(doc[at], 2), np.tile(passage, 2), np.concatenate((b, b - 1)), np.tile(place, 2)))
        if not found:
            return
        d, p, b, _ = _different(*(np.concatenate(c) for c in zip(*found)))
        new = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(p) != 0) | (np.diff(b) != 0)))
        n = np.diff(np.concatenate((np.flatnonzero(new), [len(d)])))
        d, p, b = d[new], p[new], b[new]
        ok = n >= self.few[p]
        d, p, b = d[ok], p[ok], b[ok]
        wide = int(pos.max()) + 1
        key = np.sort((doc * self.terms + term) * wide + pos)
        for s in _chunks(q.size[p], SLICE_CANDIDATES):
            owner, i = _spread(q.size[p[s]])
            low = b[s][owner] * slack + i
            base = (d[s][owner] * self.terms + q.term[q.start[p[s]][owner] + i]) * wide
            met = np.searchsorted(key, base + np.clip(low + 2 * slack, 0, wide)) > np.searchsorted(key, base + np.clip(low, 0, wide))
            total = np.concatenate(([0], np.cumsum(met)))
            width = self.run[p[s]][owner]
            whole = i + width <= q.size[p[s]][owner]
            k = np.arange(len(i))
            best = np.zeros(len(d[s]), np.int64)
            np.maximum.at(best, owner[whole], (total[k + width * whole] - total[k])[whole])
            ok = best >= self.need[p[s]]
            yield d[s][ok], p[s][ok], best[ok]


def search(index: DataFrame, q: Passages, make: Callable[[], Callable]) -> DataFrame:
    """``(doc_id, item_id, words)``, the best per pair, of a search over every
    partition of the index."""
    shared = index.sparkSession.sparkContext.broadcast(make())
    ids = q.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy()
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(size)))
            pos, term = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2))
            for s in _chunks(size, SLICE_POSTINGS):
                a, b = first[s.start], first[s.stop]
                owner, _ = _spread(size[s])
                for d, p, n in find(owner, pos[a:b], term[a:b]):
                    if len(d):
                        cols = [pa.array(docs[s][d], pa.int64()), pa.array(ids[p], pa.int64()), pa.array(n, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "words"])

    return index.mapInArrow(run, "doc_id bigint, item_id bigint, words bigint")


def _best(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leaked_items(
    docs: DataFrame, items: DataFrame, min_words: int = 13, item_col: str = "item_id", passage_col: str = "passage", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``(doc_id, item_id, words)``: texts that hold at least ``min_words``
    consecutive words of an item's passage, with the longest such run.

    Items with fewer words than that match nothing. Only terms in runs of
    ``min_words`` test terms are in the index, as no others can be part of a
    phrase. Texts are read whole; of several passages of one item each counts.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    parts = []
    for q in passage_blocks(items, item_col, passage_col, block_words):
        index = positional_index(docs, q.vocab, min_words)
        counts = term_counts(index, len(q.vocab))
        parts.append(search(index, q, lambda q=q, c=counts: PhraseSearch(q, c, min_words)))
    return _best(parts)


def near_items(
    docs: DataFrame, items: DataFrame, run: int = 13, missing: int = 3, slack: int = 6, least: int = 6,
    item_col: str = "item_id", passage_col: str = "passage", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, terms)``: proximity matches. Of ``run`` consecutive words
    of the passage at most ``missing`` are not in the text at about the place where
    one alignment puts them: their places less those in the passage all lie in one
    range of ``2 * slack`` that starts at a multiple of ``slack``. So inserted,
    dropped and changed words do little harm. ``terms`` is the best such count.

    Passages shorter than ``run`` are one stretch, of which the same share must be
    there; those with fewer than ``least`` words match nothing. Every word counts,
    however frequent it is, and every match is found.
    """
    parts = []
    for q in passage_blocks(items, item_col, passage_col, block_words):
        index = positional_index(docs, q.vocab)
        counts = term_counts(index, len(q.vocab))
        parts.append(search(index, q, lambda q=q, c=counts: NearSearch(q, c, run, missing, slack, least)))
    return _best(parts).withColumnRenamed("words", "terms")
