"""Substring dedup by seed and extend.

Words are raw words. A *repeat* is a run of MIN_WORDS words that occurs at two places or more, in one document or in
several. Seeds: each document is winnowed, that is, of any MIN_WORDS - SEED + 1 consecutive SEED-grams the least by hash
(the last of equals) is an anchor, so each repeat holds an anchor at all its places. Anchors are joined by hash. Those
at two places or more are extended both ways, by up to MIN_WORDS - SEED words each: places that share l words before
and MIN_WORDS - SEED - l after, for some l, share a repeat. Extension compares places by classes of equal context, so a
passage at m places costs m, not m squared. The union of a document's repeats gives its maximal repeated spans; the
repeats other than the first place (least doc_id, text checksum, position) are the ones to remove. No place is dropped
or capped, and nothing but word hashes is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import BROADCAST_BYTES, cut, docs_of
from lodespark.llm.textkernel import by_bucket, chunks, eased, from_buckets, mix, ngrams, words

MIN_WORDS = 50
SEED = 20
_POS = 24
_Q = np.uint64(0xA0761D6478BD642F)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _anchors(w, seed: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the chunk of the anchors, and the hashes of all its seeds."""
    span = least - seed + 1
    g = ngrams(w.h, seed)
    if len(g) < span:
        return np.zeros(0, np.int64), g
    doc = w.doc_of()
    pos = (np.arange(len(g)) - w.off[:-1][doc[: len(g)]]).astype(np.uint64)
    low = np.uint64((1 << _POS) - 1)
    key = (g & ~low) | (low - (pos & low))
    m = _sliding_min(key, span)
    whole = doc[: len(m)] == doc[least - 1 : least - 1 + len(m)]
    at = np.flatnonzero(whole)
    p = (low - (m[at] & low)).astype(np.int64)
    if len(w.h) > 1 << _POS:  # positions in a very long document wrap around
        rel = at - w.off[:-1][doc[at]]
        p += (rel >> _POS) << _POS
        p += np.where(p < rel, 1 << _POS, 0)
    return np.unique(p + w.off[:-1][doc[at]]), g


def _seeds(docs: DataFrame, least: int, seed: int, buckets: int) -> DataFrame:
    def run(batches):
        for b in eased(batches):
            ids, vers = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("ver").to_numpy(zero_copy_only=False)
            cols: list[list] = [[], [], [], []]
            for first, part in chunks(b.column("text")):
                w = words(part, norm=False)
                at, g = _anchors(w, seed, least)
                doc = w.doc_of()[at]
                for c, v in zip(cols, (g[at], ids[first + doc], vers[first + doc].astype(np.uint32), (at - w.off[doc]).astype(np.uint32)), strict=True):
                    c.append(v)
            if cols[0]:
                c = [np.concatenate(x) for x in cols]
                yield by_bucket((c[0] % np.uint64(buckets)).astype(np.int64), c)

    def shared(batches):
        for a, ids, ver, pos in from_buckets(batches, [(np.uint64, 1), (np.int64, 1), (np.uint32, 1), (np.uint32, 1)]):
            order = np.argsort(a, kind="stable")
            new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
            run = np.cumsum(new) - 1
            keep = order[np.bincount(run)[run] > 1]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ver[keep].astype(np.int64)), pa.array(pos[keep].astype(np.int32))], ["doc_id", "ver", "pos"])

    return docs.mapInArrow(run, "bucket long, blob binary").repartition("bucket").mapInArrow(shared, "doc_id long, ver long, pos int")


def _spread(docs: DataFrame, at: DataFrame, least: int, seed: int, buckets: int) -> DataFrame:
    """(doc_id, ver, start, stop, later): for each anchor the union of the repeats around it, all and the later ones."""
    room = least - seed
    need = cut(at.groupBy("doc_id", "ver").agg(F.collect_set("pos").alias("at")))
    rows, places = need.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    if 24 * rows + 4 * places <= BROADCAST_BYTES:
        need = F.broadcast(need)

    def run(batches):
        for b in eased(batches):
            ids, vers = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("ver").to_numpy(zero_copy_only=False)
            lists = b.column("at")
            lo, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for first, part in chunks(b.column("text")):
                w = words(part, norm=False)
                g = ngrams(w.h, seed)
                n = np.diff(lo[first : first + len(part) + 1])
                doc = np.repeat(np.arange(len(part)), n)
                pos = flat[lo[first] : lo[first + len(part)]].astype(np.int64)
                p = pos + w.off[doc]
                left = np.minimum(pos, room).astype(np.uint8)
                right = np.minimum(w.off[doc + 1] - p - seed, room).astype(np.uint8)
                h = (w.h >> np.uint64(32)).astype(np.uint32)
                step = np.concatenate([np.arange(-1, -room - 1, -1), np.arange(seed, least)])
                near = np.empty((len(p), 2 * room), np.uint32)
                for k, s in enumerate(step):
                    near[:, k] = h[np.clip(p + s, 0, len(h) - 1)]
                if len(p):
                    yield by_bucket((g[p] % np.uint64(buckets)).astype(np.int64), [g[p], ids[first + doc], vers[first + doc].astype(np.uint32), pos.astype(np.uint32), left, right, near])

    def extend(batches):
        kinds = [(np.uint64, 1), (np.int64, 1), (np.uint32, 1), (np.uint32, 1), (np.uint8, 1), (np.uint8, 1), (np.uint32, 2 * room)]
        for a, ids, ver, pos, left, right, near in from_buckets(batches, kinds):
            order = np.lexsort((pos, ver, ids, a))
            a, ids, ver, pos, left, right, near = (x[order] for x in (a, ids, ver, pos, left, right, near))
            one = np.concatenate([[True], (a[1:] != a[:-1]) | (ids[1:] != ids[:-1]) | (ver[1:] != ver[:-1]) | (pos[1:] != pos[:-1])])
            a, ids, ver, pos, left, right, near = (x[one] for x in (a, ids, ver, pos, left, right, near))
            m = len(a)
            after = np.empty((room + 1, m), np.uint64)
            after[0] = 0
            for r in range(room):
                after[r + 1] = after[r] * _Q + near[:, room + r] + np.uint64(1)
            before = np.zeros(m, np.uint64)
            most, fewest = np.full((2, m), -1, np.int64), np.full((2, m), room + 1, np.int64)
            for l in range(room + 1):
                if l:
                    before = before * _Q + near[:, l - 1] + np.uint64(1)
                ok = np.flatnonzero((left >= l) & (right >= room - l))
                if len(ok) < 2:
                    continue
                c = mix(a[ok] + mix(before[ok]) * np.uint64(3) + mix(after[room - l][ok] + np.uint64(7)))
                o = np.argsort(c, kind="stable")
                new = np.concatenate([[True], c[o][1:] != c[o][:-1]])
                run_ = np.cumsum(new) - 1
                many = np.bincount(run_)[run_] > 1
                for kind, rows_ in ((0, ok[o[many]]), (1, ok[o[many & ~new]])):
                    most[kind][rows_] = np.maximum(most[kind][rows_], l)
                    fewest[kind][rows_] = np.minimum(fewest[kind][rows_], l)
            out: list[list] = [[], [], [], [], []]
            for kind in (0, 1):
                s = np.flatnonzero(most[kind] >= 0)
                for c, v in zip(out, (ids[s], ver[s].astype(np.int64), pos[s].astype(np.int64) - most[kind][s], pos[s].astype(np.int64) + least - fewest[kind][s], np.full(len(s), kind == 1)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "ver", "start", "stop", "later"])

    joined = docs.join(need, ["doc_id", "ver"])
    return joined.mapInArrow(run, "bucket long, blob binary").repartition("bucket").mapInArrow(extend, "doc_id long, ver long, start long, stop long, later boolean")


def _union(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with those that overlap or touch made one. doc: dense indices."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    big = np.int64(1) << 32
    reach = np.maximum.accumulate(stop + doc * big)
    new = np.concatenate([[True], (start + doc * big)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - doc[at] * big


def _spans(spread: DataFrame) -> DataFrame:
    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        ids, ver, start, stop, later = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(5))
        order = np.lexsort((ver, ids))
        ids, ver, start, stop, later = ids[order], ver[order], start[order], stop[order], later[order].astype(bool)
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ver[1:] != ver[:-1])])
        doc, at = np.cumsum(new) - 1, np.flatnonzero(new)
        d, s, e = _union(doc[~later], start[~later], stop[~later])
        ld, ls, le = _union(doc[later], start[later], stop[later])
        big = np.int64(1) << 32
        inside = np.searchsorted(s + d * big, ls + ld * big, side="right") - 1
        gone = np.bincount(inside, weights=le - ls, minlength=len(d)).astype(np.int64)
        cut_at = np.searchsorted(inside, np.arange(len(d) + 1))
        pairs = np.stack([ls, le], axis=1).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array((2 * cut_at).astype(np.int32)), pa.array(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at][d]), pa.array(ver[at][d]), pa.array(s), pa.array(e), pa.array(gone), lists], ["doc_id", "ver", "start_word", "end_word", "later_words", "later"])

    return spread.repartition("doc_id").mapInArrow(run, "doc_id long, ver long, start_word long, end_word long, later_words long, later array<long>")


def _found(docs: DataFrame, least: int, seed: int) -> DataFrame:
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    docs = docs_of(docs, F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("ver"))
    return _spans(_spread(docs, _seeds(docs, least, seed, buckets), least, seed, buckets))


def repeats(docs: DataFrame, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The maximal repeated spans: doc_id, start_word, end_word (exclusive), n_words, later_words.

    later_words counts the words of the span that lie in a repeat other than its first place; it is 0 for the copy to
    keep. Rows with equal doc_id and text are one document; rows with equal doc_id and other text are several. Null,
    empty and shorter texts have no repeats; rows without doc_id are left out; extra columns are ignored; an empty
    table gives no rows.
    """
    return _found(docs, least, seed).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "later_words")


def without(texts: pa.Array, cuts: list) -> list[bytes | None]:
    """Each text without the words in its cuts (pairs of word positions) and the white space after them."""
    out: list[bytes | None] = []
    for first, part in chunks(texts):
        w = words(part, norm=False)
        raw = w.data.tobytes()
        for i in range(len(part)):
            lo, hi = int(w.byte_off[i]), int(w.byte_off[i + 1])
            st, keep, at = w.start[w.off[i] : w.off[i + 1]], [], lo
            pairs = cuts[first + i]
            for s, e in zip(pairs[::2], pairs[1::2], strict=True):
                keep.append(raw[at : int(st[s])])
                at = int(st[e]) if e < len(st) else hi
            keep.append(raw[at:hi])
            kept = len(st) - sum(e - s for s, e in zip(pairs[::2], pairs[1::2], strict=True))
            out.append(b"".join(keep) if kept else None)
    return out


def cut_repeats(docs: DataFrame, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs with the later places of each repeat cut from text, and n_chars (if there) counted again; columns as before.

    The first place of each repeat stays, so no passage is lost. A document left without a word goes; one that had none
    before stays as it is, as do null texts and rows without doc_id.
    """
    names = docs.columns
    at = "__cuts"
    while at.lower() in {c.lower() for c in names}:
        at += "_"
    cuts = _found(docs, least, seed).filter("later_words > 0").groupBy(F.col("doc_id").alias("__id"), F.col("ver").alias("__ver"))
    cuts = cut(cuts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_word", "later"))), lambda x: x["later"])).alias(at)))
    n, m = cuts.agg(F.count("*"), F.coalesce(F.sum(F.size(at)), F.lit(0))).first()
    if 24 * n + 8 * m <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)

    def rest(batches):
        for b in eased(batches):
            left = without(b.column(names.index("text")), b.column(len(names)).to_pylist())
            keep = pa.array([x is not None for x in left])
            cols = [c.filter(keep) for c in b.columns[:-1]]
            text = pa.array([x.decode("utf-8") for x in left if x is not None], pa.string())
            cols[names.index("text")] = text
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pc.utf8_length(text).cast(cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    ver = F.coalesce(F.crc32(docs["text"].cast("binary")), F.lit(0))
    out = docs.join(cuts, (docs["doc_id"].cast("long") == cuts["__id"]) & (ver == cuts["__ver"]), "left")
    hit = out.filter(F.col(at).isNotNull()).select(*names, at).mapInArrow(rest, docs.schema)
    return hit.unionByName(out.filter(F.col(at).isNull()).select(*names))
