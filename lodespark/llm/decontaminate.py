"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents gets a suffix array over its normalised words (prefix doubling over packed word numbers, to the
depth of the longest benchmark suffix). Every benchmark suffix that is long enough is binary-searched in every shard;
each shard place that shares its first MIN_WORDS words (an item's all, if it has fewer) is extended to the longest
verbatim match. A benchmark that is too large for one broadcast is searched slice by slice.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import cut, docs_of, small
from lodespark.llm.textkernel import chunks, eased, expand, words

MIN_WORDS = 13
SHARD_BYTES = 2 << 20
SLICE_BYTES = 16 << 20


class Tests(NamedTuple):
    """Benchmark words: hashes, each suffix's start, its item's number and end, and the words that must match."""

    h: np.ndarray
    at: np.ndarray
    end: np.ndarray
    item: np.ndarray
    first: np.ndarray
    need: np.ndarray
    ids: np.ndarray


def tests_of(ids: np.ndarray, texts: pa.Array, least: int) -> Tests:
    hs, sizes = [], []
    for _, part in chunks(texts):
        w = words(part)
        hs.append(w.h)
        sizes.append(np.diff(w.off))
    h = np.concatenate(hs or [np.zeros(0, np.uint64)])
    size = np.concatenate(sizes or [np.zeros(0, np.int64)]).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    need = np.minimum(size, least)
    count = np.where(size > 0, size - need + 1, 0)
    at, item = expand(off[:-1], count), np.repeat(np.arange(len(size)), count)
    return Tests(h, at, off[1:][item], item, off[:-1][item], need[item], ids)


def suffix_array(a: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Suffixes of a (numbers up to top, 0 between documents) sorted by their first depth numbers at least; with the
    sorted keys of their first words, how many words a key has and the bits of each."""
    n = len(a)
    bits = max(1, int(top).bit_length())
    per = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for k in range(per):
        key <<= np.uint64(bits)
        key[: max(0, n - k)] |= a[k:].astype(np.uint64)
    sa = np.argsort(key)
    skey = key[sa]
    new = np.concatenate([[True], skey[1:] != skey[:-1]])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(at, np.diff(np.append(at, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in sa
    have = per
    while have < depth and len(tied):
        pos = sa[tied]
        nxt = pos + have
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = (rank[pos].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(both, kind="stable")
        sa[tied] = pos = pos[order]
        both = both[order]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        run = np.flatnonzero(new)
        rank[pos] = np.repeat(tied[run], np.diff(np.append(run, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        have *= 2
    return sa, skey, per, bits


def _search(a: np.ndarray, sa: np.ndarray, skey: np.ndarray, per: int, bits: int, q: np.ndarray, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix q[at:], the range of sa whose suffixes share its first need words."""
    n, m = len(a), len(at)
    low, high = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for k in range(per):
        inside = need > k
        v = np.where(inside, q[np.minimum(at + k, len(q) - 1)], 0).astype(np.uint64)
        low = (low << np.uint64(bits)) | v
        high = (high << np.uint64(bits)) | np.where(inside, v, np.uint64((1 << bits) - 1))
    lo, hi = np.searchsorted(skey, low, side="left"), np.searchsorted(skey, high, side="right")
    act = np.flatnonzero((lo < hi) & (need > per))

    def below(rows, mid, equal_too):
        """Is the suffix at mid before the query, or, with equal_too, equal to it in the words needed?"""
        out, left = np.full(len(rows), equal_too), np.arange(len(rows))
        k = per
        while len(left):
            left = left[need[rows[left]] > k]
            p = sa[mid[left]] + k
            x = np.where(p < n, a[np.minimum(p, n - 1)], 0)
            y = q[at[rows[left]] + k]
            out[left[x < y]], out[left[x > y]] = True, False
            left = left[x == y]
            k += 1
        return out

    for side in (False, True):
        l, h = lo[act].copy(), hi[act].copy()
        while True:
            go = np.flatnonzero(l < h)
            if not len(go):
                break
            mid = (l[go] + h[go]) // 2
            b = below(act[go], mid, side)
            l[go[b]] = mid[b] + 1
            h[go[~b]] = mid[~b]
        if side:
            hi[act] = l
        else:
            keep_lo = l
    lo[act] = keep_lo
    return lo, hi


def matches(part: pa.Array, t: Tests, depth: int):
    """Left-maximal matches in one shard: row of part, item number, words, first word in the document and in the item."""
    w = words(part)
    if not len(w.h) or not len(t.h):
        return None
    vocab, number = np.unique(w.h, return_inverse=True)
    nd = len(part)
    size = np.diff(w.off)
    doc = np.repeat(np.arange(nd), size)
    a = np.zeros(len(w.h) + nd, np.int64)
    a[np.arange(len(w.h)) + doc] = number + 1
    at = np.searchsorted(vocab, t.h)
    at[at == len(vocab)] = 0
    q = np.where(vocab[at] == t.h, at + 1, -1)
    gone = np.concatenate([[0], np.cumsum(q < 0)])
    live = np.flatnonzero(gone[t.at + t.need] == gone[t.at])  # suffixes whose needed words all occur in the shard
    if not len(live):
        return None
    sa, skey, per, bits = suffix_array(a, len(vocab), depth)
    lo, hi = _search(a, sa, skey, per, bits, q, t.at[live], t.need[live])
    count = np.maximum(0, hi - lo)
    who, place = live[np.repeat(np.arange(len(live)), count)], sa[expand(lo, count)]
    if not len(who):
        return None
    maximal = (t.at[who] == t.first[who]) | (place == 0) | (a[np.maximum(place - 1, 0)] != q[np.maximum(t.at[who] - 1, 0)])
    who, place = who[maximal], place[maximal]
    length = t.need[who].copy()
    go = np.arange(len(who))
    while len(go):
        p, s = place[go] + length[go], t.at[who[go]] + length[go]
        ok = (s < t.end[who[go]]) & (p < len(a))
        go, p, s = go[ok], p[ok], s[ok]
        go = go[a[p] == q[s]]
        length[go] += 1
    starts = w.off[:-1] + np.arange(nd)
    row = np.searchsorted(starts, place, side="right") - 1
    return row, t.item[who], length, place - starts[row], t.at[who] - t.first[who]


def _matched(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """The matches of docs (doc_id, text, ver) as the search finds them: doc_id, ver, item_id, match_words, doc_word, item_word."""
    spark = docs.sparkSession
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = 1 + int(total) // SLICE_BYTES
    out = None
    for k in range(slices):
        part = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        got = part.orderBy("item_id", "text").toArrow()
        tests = spark.sparkContext.broadcast(tests_of(got.column("item_id").to_numpy().astype(np.int64), got.column("text").combine_chunks(), least))
        one = docs.mapInArrow(_searcher(tests), "doc_id long, ver long, item_id long, match_words long, doc_word long, item_word long")
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The longest verbatim match of each document and item: doc_id, item_id, match_words, doc_word, item_word.

    Only matches of least normalised words, or of all words of an item that has fewer, are listed; of equal ones the
    first in the document, then in the item. Null and empty texts and items match nothing; rows without an id are left
    out; repeated rows count once, and rows with one doc_id are one document; extra columns are ignored; empty tables
    give no rows.
    """
    out = _matched(docs_of(docs, F.lit(0).cast("long").alias("ver")), benchmark, least)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    out = out.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.match_words", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def _searcher(tests):
    def run(batches):
        t = tests.value
        depth = int(max(t.end - t.at, default=0))
        for b in eased(batches):
            ids, vers, out = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("ver").to_numpy(zero_copy_only=False), []
            for first, part in chunks(b.column("text"), SHARD_BYTES):
                m = matches(part, t, depth)
                if m is not None:
                    out.append([ids[first + m[0]], vers[first + m[0]], t.ids[m[1]], *m[2:]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["doc_id", "ver", "item_id", "match_words", "doc_word", "item_word"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs without the rows that hold a match; all columns are kept.

    Rows are judged, not ids: a row without a match stays, if another of its doc_id goes; repeated rows go or stay
    together. Rows without doc_id or text, and empty texts, stay; an empty table of either kind changes nothing. An item of
    fewer than least words, be it a single word, takes every document that holds all of it in a row.
    """
    ver = F.xxhash64(F.col("text").cast("string"))
    gone = cut(_matched(docs_of(docs, ver.alias("ver")), benchmark, least).select(F.col("doc_id").alias("__gone"), F.col("ver").alias("__ver")).distinct())
    at = (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__ver"])
    return docs.join(small(gone, gone.count(), 24), at, "left_anti")
