"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of hashed word n-grams (64-bit fingerprints of normalised words; a document of fewer than n words is
one n-gram of all its words, an empty one is the empty set and matches nothing). Equal texts are one class, joined once.
The join is exact up to fingerprint collisions and has no cap on partners:

0. A document that links to another has a share t of its tokens in it. Tokens are counted over all documents; those of
   which a smaller share of tokens is in any other document are left out of all that follows. Tokens are counted by part
   of their bits, and documents by part of theirs: what coincides there only keeps more documents.
1. Tokens that HOT_DF documents or more have are counted over all documents; they come last in the global token order
   (hot, hash). Any order is correct; this one keeps passages that many documents share
   out of the prefixes. At most HOT_TOKENS, the most frequent, are kept, as they are broadcast; that changes only how
   many documents are looked at, not the result.
2. A document's group is the first hot token of its prefix, else the first that is in another document of its batch too,
   else the very first, so copies, and documents that share a passage, tend to share a group. Groups are ordered by how
   frequent their token is, and documents ask greater groups: the few of a cluster of near copies that chance tokens lead
   elsewhere ask the cluster's group, and not the whole cluster each of them. The token-group
   matrix holds, for each prefix token, the groups having it, with the sizes of their members. It is cut into buckets
   of tokens; a bucket sees documents and groups together, so one shuffle of packed postings builds and probes it. A
   pair with Jaccard >= t shares a token of its prefixes, so a document can only match groups that its prefix meets.
3. The tokens of a document's prefix that lie in a group's union are counted over all buckets. All that a pair shares
   besides lies beyond the prefix that ends first, so the count and the rest of that document bound the overlap (the
   shorter rest, where both end at one place); where the bound falls short of what t asks for, the group stays shut.
4. Groups of more than BLOCK documents are cut into blocks, each a group with a union of its own, so no task holds more
   than two blocks' documents of a group. A pair of documents meets in one block only.
5. Groups still in question are bounded once more, by the whole token union as a bitmap of hashed tokens, two bits a
   token: at least as many of a document's tokens as it has bits outside the union aren't in it.
6. Opened groups get the whole token sets and are compared by products of 0/1 matrices. What leaves them isn't the pairs
   but each document's number of links and edges that span what the block links, at most one for each of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import cut, docs_of, free_name, small
from lodespark.llm.textkernel import by_bucket, chunks, eased, expand, from_buckets, grouped, inside, mix, ngrams, relieve, words

N_WORDS = 3
THRESHOLD = 0.5
HOT_DF = 8
HOT_TOKENS = 4_000_000
BATCH_ROWS = 4096
BLOCK = 2048
#: has a normalised word
WORDED = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def token_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: first row, offsets, and each document's sorted distinct tokens."""
    for first, part in chunks(col):
        w = words(part)
        nd = len(part)
        g = ngrams(w.h, n)
        ok = inside(w.off, n, len(w.h))
        doc = w.doc_of()
        tok, who = g[ok], doc[: len(g)][ok]
        size = np.diff(w.off)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = size[short] > k
                h[has] = h[has] * np.uint64(0xA0761D6478BD642F) + w.h[w.off[short][has] + k]
            tok, who = np.concatenate([tok, mix(h + size[short].astype(np.uint64))]), np.concatenate([who, short])
        order = np.argsort(tok)
        who = who[order].astype(np.uint16 if nd < 1 << 16 else np.uint32)
        order = order[np.argsort(who, kind="stable")]
        tok, who = tok[order], np.sort(who, kind="stable")
        if len(tok):
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (who[1:] != who[:-1])])
            tok, who = tok[new], who[new]
        yield first, np.searchsorted(who, np.arange(nd + 1)), tok


def _prefix(off: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The document of each token, and whether the token is in its prefix."""
    size = np.diff(off)
    who = np.repeat(np.arange(len(size)), size)
    rank = np.arange(len(who)) - off[:-1][who]
    return who, rank < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[who]


def _slices(batches):
    return eased(x.slice(i, BATCH_ROWS) for x in batches for i in range(0, x.num_rows, BATCH_ROWS))


_TOKEN = [(np.uint8, 3), (np.uint32, 1)]


def _three(x: np.ndarray) -> np.ndarray:
    """Numbers under 2 ** 24 as their three bytes."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]


def _sharing(docs: DataFrame, n: int, t: float, bits: int) -> DataFrame:
    """The docs (doc_id, text and other columns) that have a share t of their tokens, at least, in other documents."""
    low, most = np.uint64(40 - bits), (1 << 24) - 1

    def tokens(batches):
        for b in _slices(batches):
            num = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64).astype(np.uint32)
            cols: list[list] = [[], [], []]
            for first, off, tok in token_sets(b.column("text"), n):
                size, own = np.diff(off), num[first : first + len(off) - 1]
                need = np.minimum(np.ceil(t * size - 1e-9), most).astype(np.int64)
                some = size > 0
                for c, x, y in zip(cols, ((tok >> np.uint64(64 - bits)).astype(np.int64), (tok >> low) & np.uint64(most), np.repeat(own, size)), ((1 << bits) + (own[some] & np.uint32((1 << bits) - 1)).astype(np.int64), need[some], own[some]), strict=True):
                    c += [x, y.astype(x.dtype)]
            if cols[0]:
                yield by_bucket(np.concatenate(cols[0]), [_three(np.concatenate(cols[1])), np.concatenate(cols[2])])

    def counts(batches):
        def sums(held):
            num, c = np.unique(np.concatenate(held), return_counts=True)
            return by_bucket((num & np.uint32((1 << bits) - 1)).astype(np.int64), [num, c.astype(np.int32)])

        held, size = [], 0
        for key, low_, num in from_buckets(batches, _TOKEN, keyed=True):
            x = np.zeros((len(num), 4), np.uint8)
            x[:, :3] = low_
            x = x.view("<u4").reshape(-1)
            if key >> bits:  # what documents need
                yield by_bucket((num & np.uint32((1 << bits) - 1)).astype(np.int64), [num, -x.astype(np.int32)])
                continue
            x = np.sort(x.astype(np.uint64) << np.uint64(32) | num)
            same = (x[1:] >> np.uint64(32)) == (x[:-1] >> np.uint64(32))
            held.append(x[np.append(same, False) | np.append(False, same)].astype(np.uint32))
            size += len(held[-1])
            if size > 1 << 22:
                yield sums(held)
                held, size = [], 0
        if size:
            yield sums(held)

    def enough(batches):
        for num, v in from_buckets(batches, [(np.uint32, 1), (np.int32, 1)]):
            some, at = np.unique(num, return_inverse=True)
            c = np.bincount(at, weights=np.maximum(v, 0), minlength=len(some))
            need = np.full(len(some), most + 1)
            np.minimum.at(need, at[v < 0], -v[v < 0])
            yield pa.RecordBatch.from_arrays([pa.array(some[c >= need].astype(np.int64))], ["num"])

    sent = docs.select("doc_id", "text").mapInArrow(tokens, "bucket long, blob binary").repartition("bucket")
    found = cut(sent.mapInArrow(counts, "bucket long, blob binary").repartition("bucket").mapInArrow(enough, "num long"))
    return docs.join(small(found, found.count(), 16), F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("num"), "left_semi")


def _hot_tokens(docs: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 32 + bits bits of the hot tokens, sorted; what is hot depends on those alone. And how frequent each is: 1
    to 15, by powers of two."""
    low = np.uint64(32 - bits)

    def local(batches):
        for b in _slices(batches):
            tok = np.concatenate([x for _, _, x in token_sets(b.column("text"), n)] or [np.zeros(0, np.uint64)])
            yield by_bucket((tok >> np.uint64(64 - bits)).astype(np.int64), [(tok >> low).astype(np.uint32)])

    def frequent(batches):
        for key, tok in from_buckets(batches, [(np.uint32, 1)], keyed=True):
            tok = np.sort(tok)
            at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            c = np.diff(np.append(at, len(tok)))
            keep = c >= HOT_DF
            yield pa.RecordBatch.from_arrays([pa.array(tok[at][keep].astype(np.int64) + (key << 32)), pa.array(c[keep])], ["token", "c"])

    counts = docs.select("text").mapInArrow(local, "bucket long, blob binary").repartition("bucket").mapInArrow(frequent, "token long, c long")
    level = F.least(F.floor(F.log2("c")), F.lit(15)).cast("byte")
    got = cut(counts).orderBy(F.desc("c"), "token").limit(HOT_TOKENS).select("token", level.alias("level")).toArrow()
    tok, level = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy().astype(np.uint8)
    order = np.argsort(tok)
    return tok[order], level[order]


def _among(tok: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(tok), bool)
    at = np.searchsorted(some, tok)
    at[at == len(some)] = 0
    return some[at] == tok


_LOG = np.log(2) / 16  # sizes are kept rounded down to powers of 2 ** (1 / 16)
_POSTING = [(np.int64, 1), (np.uint64, 1), (np.uint32, 1), (np.uint8, 1), (np.uint8, 1)]
_OPEN = 255  # a prefix that goes on into the hot tokens


def _ends(off: np.ndarray, who: np.ndarray, tok: np.ndarray, late: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each document's prefix ends, and what is in it: it goes on to the next of the few places in the order of
    tokens where prefixes may end, so many end at the same one."""
    size = np.diff(off)
    at, some = tok / 2.0**64, np.flatnonzero(size)
    last = off[:-1][some] + np.bincount(who, weights=take, minlength=len(size)).astype(np.int64)[some] - 1
    end = np.zeros(len(size), np.uint8)
    end[some] = np.where(late[last], _OPEN, np.maximum(np.ceil((at[last] - 0.0625) * 8), 0)).astype(np.uint8)
    stop = end[who]
    return end, np.where(stop == _OPEN, take, ~late & (at <= 0.0625 + stop / 8))


def _leads(row: np.ndarray, tok: np.ndarray, lead: list[np.ndarray]) -> np.ndarray:
    """For each token, where the token is that leads its document's group: the document's first of lead[0], else of
    lead[1], .., else its first."""
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = at
    for some in reversed(lead):
        first = np.minimum.reduceat(np.where(some, np.arange(len(tok)), len(tok)), at)
        out = np.where(first == len(tok), out, first)
    return np.repeat(out, np.diff(np.append(at, len(row))))


def _postings(docs: DataFrame, n: int, t: float, bits: int, hot) -> DataFrame:
    """Packed prefix postings (document, token, group, size, end of the prefix) by bucket of tokens. The first four bits of
    a group are how frequent its token is, if it is hot."""

    def run(batches):
        (heavy, much), low = hot.value, np.uint64(32 - bits)
        for b in _slices(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            cols: list[list] = [[], [], [], []]
            for first, off, tok in token_sets(b.column("text"), n):
                size = np.diff(off)
                who, take = _prefix(off, t)
                late = _among(tok >> low, heavy)
                if late.any():
                    order = np.argsort((who.astype(np.int64) << 1) | late, kind="stable")
                    tok, late = tok[order], late[order]
                end, take = _ends(off, who, tok, late, take)
                who = who[take]
                level = np.minimum(255, np.floor(np.log(np.maximum(1, size)) / _LOG + 1e-9)).astype(np.uint8)
                for c, v in zip(cols, (first + who, tok[take], level[who], end[who]), strict=True):
                    c.append(v)
            if not cols[0] or not sum(map(len, cols[0])):
                continue
            row, tok, level, end = (np.concatenate(c) for c in cols)
            key = np.sort(tok)
            common = key[1:][key[1:] == key[:-1]]
            common = common[np.concatenate([[True], common[1:] != common[:-1]])] if len(common) else common
            is_hot = _among(tok >> low, heavy)
            lead = _leads(row, tok, [is_hot, _among(tok, common)])
            grp = (mix(tok[lead]) & np.uint64((1 << 28) - 1)).astype(np.uint32)
            by_hot = is_hot[lead]
            grp[by_hot] |= much[np.searchsorted(heavy, tok[lead[by_hot]] >> low)].astype(np.uint32) << np.uint32(28)
            yield by_bucket((tok >> np.uint64(64 - bits)).astype(np.int64), [ids[row], tok, grp, level, end])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, blob binary")


def _meet(rep, tok, grp, level, end, t: float, room: int = 1 << 19):
    """Columns (document, group, role, count, need) of one bucket. Role 1: the document in its own group, counting tokens
    that another member has; 2: the document against a greater group, counting tokens of that group's union. need is how
    many tokens, over all buckets, the bound asks for at least."""
    low = (tok & np.uint64((1 << 20) - 1)).astype(np.int64)
    many = np.bincount(low, minlength=1 << 20)[low] > 1  # most tokens occur once
    rep, tok, grp, level, end = rep[many], tok[many], grp[many], level[many], end[many]
    order = np.lexsort((grp, tok))
    rep, tok, grp, level, end = rep[order], tok[order], grp[order], level[order], end[order]
    if not len(rep):
        return
    new = np.concatenate([[True], tok[1:] != tok[:-1]])
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    rep, tok, grp, level, end = rep[many], tok[many], grp[many], level[many], end[many]
    if not len(rep):
        return
    size = np.floor(np.exp(level * _LOG))
    most = np.where(level == 255, 2.0**60, np.ceil(np.exp((level + 1.0) * _LOG)))
    first = np.concatenate([[True], (tok[1:] != tok[:-1]) | (grp[1:] != grp[:-1])])
    cell = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    members = np.diff(np.append(at, len(rep)))
    lo, hi = np.minimum.reduceat(size, at), np.maximum.reduceat(most, at)
    e0, e1 = np.minimum.reduceat(end, at), np.maximum.reduceat(end, at)
    cell_tok, cell_grp = tok[at], grp[at]
    seen = members > 1

    def need(who, to):
        x, y, e = most[who], hi[to], end[who]
        rest = np.where((e == e0[to]) & (e == e1[to]) & (e < _OPEN), np.minimum(x, y), np.maximum(x, y))
        rest = np.where(e < e0[to], x, np.where(e > e1[to], y, rest))
        return t / (1 + t) * (size[who] + lo[to]) - t * rest - 1e-6

    new = np.concatenate([[True], cell_tok[1:] != cell_tok[:-1]])
    run_end = np.append(np.flatnonzero(new), len(cell_tok))[np.cumsum(new)]
    counts = run_end[cell] - cell - 1  # cells of the same token with a greater group
    ends = np.cumsum(counts)
    i = 0
    while i < len(rep):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + room, side="right")))
        c = counts[i:j]
        who = np.repeat(np.arange(i, j), c)
        if len(who):
            e = np.cumsum(c)
            to = np.arange(len(who)) - np.repeat(e - c, c) + cell[who] + 1
            ok = (size[who] * t <= hi[to]) & (lo[to] * t <= most[who])
            who, to = who[ok], to[ok]
            seen[to] = True
            yield rep[who], cell_grp[to].astype(np.int64), np.full(len(who), 2), np.ones(len(who), np.int64), need(who, to)
        i = j
    who = np.flatnonzero(seen[cell])
    yield rep[who], grp[who].astype(np.int64), np.ones(len(who), np.int64), (members[cell[who]] > 1).astype(np.int64), need(who, cell[who])


def _summed(parts: list) -> list[np.ndarray]:
    """Parts with the counts of equal (document, group, role) added, and the least need of each."""
    rep, grp, role, c, need = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((grp * 4 + role, rep))
    rep, key, c, need = rep[order], (grp * 4 + role)[order], c[order], need[order]
    at = np.flatnonzero(np.concatenate([[True], (rep[1:] != rep[:-1]) | (key[1:] != key[:-1])])) if len(rep) else np.zeros(0, np.int64)
    if not len(at):
        return [rep, key >> 2, key & 3, c, need]
    return [rep[at], key[at] >> 2, key[at] & 3, np.add.reduceat(c, at), np.minimum.reduceat(need, at)]


def _met(posts: DataFrame, t: float) -> DataFrame:
    """(doc_id, grp, role) of the cells that the bound leaves open, and of the members they are to be compared with."""

    def run(batches):
        got, held = [], 0
        for cols in from_buckets(batches, _POSTING):
            for part in _meet(*cols, t):
                got.append(part)
                held += len(part[0])
                if held > 1 << 20:
                    got = [_summed(got)]
                    held = len(got[0][0])
        if got:
            rows = _summed(got)
            del got
            relieve()
            for i in range(0, len(rows[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in (*rows[:4], rows[4].astype(np.float32))], ["doc_id", "grp", "role", "c", "need"])

    cells = posts.repartition("bucket").mapInArrow(run, "doc_id long, grp long, role long, c long, need float")
    cells = cut(cells.groupBy("doc_id", "grp", "role").agg((F.sum("c") >= F.min("need")).alias("open")).filter("open OR role = 1"))
    asked = cells.filter("role = 2").select("grp").distinct()
    members = cells.filter("role = 1 AND NOT open").join(small(asked, asked.count(), 16), "grp", "left_semi")
    return cells.filter("open").unionByName(members.select("doc_id", "grp", "role", "open")).select("doc_id", "grp", "role")


def in_blocks(cells: DataFrame, block: int) -> DataFrame:
    """cells with groups of more than block documents cut into groups of two blocks at most: members of one block, and
    askers of one (documents of other groups, or members of an earlier block). Role 3: a member for askers only."""
    large = cut(cells.groupBy("grp").agg(F.count_if(F.col("role") == 1).alias("m"), F.count_if(F.col("role") == 2).alias("a")).filter(F.col("m") + F.col("a") > block))
    n = large.count()
    if not n:
        return cells
    up = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("long")
    large = large.select("grp", up("m").alias("nb"), up("a").alias("na"))
    some = cells.join(small(large, n, 24), "grp", "left")
    i, na, nb, zero = F.pmod(F.xxhash64("doc_id"), F.when(F.col("role") == 1, F.col("nb")).otherwise(F.col("na"))), F.col("na"), F.col("nb"), F.lit(0).cast("long")
    some = some.withColumn("i", i)
    i = F.col("i")
    cell = lambda j, k, role: F.struct(j.alias("j"), k.alias("k"), F.lit(role).cast("long").alias("role"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(zero, n - 1), f)).otherwise(F.array().cast("array<struct<j:long,k:long,role:long>>"))
    member = F.concat(F.array(cell(i, zero, 1)), upto(na - 1 + i, lambda k: cell(i, k + 1, 3)), upto(nb - 1 - i, lambda j: cell(i + 1 + j, na + i, 2)))
    ask = upto(nb, lambda j: cell(j, i, 2))
    cut_up = some.filter("nb IS NOT NULL").select("doc_id", "grp", F.explode(F.when(F.col("role") == 1, member).otherwise(ask)).alias("c"))
    key = F.shiftrightunsigned(F.xxhash64("grp", "c.j", "c.k"), 4) + F.lit(1 << 32)
    return some.filter("nb IS NULL").select("doc_id", "grp", "role").unionByName(cut_up.select("doc_id", key.alias("grp"), "c.role"))


def _asked(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """docs in cells, with their cells."""
    need = cells.groupBy("doc_id").agg(F.collect_list(F.col("grp") * 4 + F.col("role")).alias("cells"))
    rows, distinct = cells.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return docs.join(small(need, rows + 4 * distinct, 16), "doc_id")


def _spread(cells: list, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, role and document of each cell of the documents first .. first + n."""
    some = cells[first : first + n]
    flat = np.array([c for x in some for c in x], np.int64)
    return flat >> 2, flat & 3, np.repeat(np.arange(n), [len(x) for x in some])


def _fold(bits: np.ndarray, words_: int) -> np.ndarray:
    """A bitmap of packed tokens made narrower: bit i of the result is set if a bit equal to i modulo its width is."""
    return np.bitwise_or.reduce(bits.reshape(-1, words_), axis=0) if len(bits) > words_ else bits


def _outside(q: list[np.ndarray], m: list[np.ndarray], room: int = 1 << 21) -> np.ndarray:
    """At least how many tokens of each q aren't in each m."""
    out = np.zeros((len(q), len(m)), np.int64)
    wq, wm = np.array([len(x) for x in q]), np.array([len(x) for x in m])
    for a in np.unique(wq):
        i = np.flatnonzero(wq == a)
        for b in np.unique(wm):
            j, w = np.flatnonzero(wm == b), int(min(a, b))
            x, y = np.stack([_fold(q[k], w) for k in i]), ~np.stack([_fold(m[k], w) for k in j])
            step = max(1, room // (len(j) * w))
            for k in range(0, len(i), step):
                out[np.ix_(i[k : k + step], j)] = np.bitwise_count(x[k : k + step, None, :] & y[None]).sum(axis=2)
    return out


def _shut(docs: DataFrame, cells: DataFrame, n: int, t: float) -> DataFrame:
    """The cells whose groups are to be opened, and the members to open them for."""

    def bitmaps(batches):
        for b in eased(batches):
            ids, cells_ = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("cells").to_pylist()
            for first, off, tok in token_sets(b.column("text"), n):
                size = np.diff(off)
                maps = []
                for i in range(len(size)):
                    width = max(64, 1 << int(2 * size[i] - 1).bit_length()) if size[i] else 64
                    bits = np.zeros(width, np.uint8)
                    bits[(tok[off[i] : off[i + 1]] & np.uint64(width - 1)).astype(np.int64)] = 1
                    maps.append(np.packbits(bits).tobytes())
                grp, role, at = _spread(cells_, first, len(size))
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(role), pa.array(ids[first + at]), pa.array(size[at]), pa.array([maps[i] for i in at], pa.binary())], ["grp", "role", "doc_id", "size", "bits"])

    def fits(q, sq, m, sm):
        most = np.minimum(sq[:, None] - _outside(q, m), sm[None, :] - _outside(m, q).T)
        return most * (1 + t) >= t * (sq[:, None] + sm[None, :]) - 1e-9

    def run(batches):
        for b in grouped(batches):
            grp, role, ids, size = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(4)]
            keep = np.zeros(len(grp), bool)
            for o in _runs(grp, role, ids):
                mem, ask = o[role[o] != 2], o[role[o] == 2]
                m = [bits[x] for x in mem]
                if len(o) < 2 or not len(mem):
                    continue
                if role[mem[0]] == 1 and len(mem) > 1:
                    for k in range(0, len(mem), 1024):
                        some = slice(k, k + 1024)
                        ok = fits(m[some], size[mem[some]], m, size[mem])
                        ok[np.arange(ok.shape[0]), np.arange(k, k + ok.shape[0])] = False
                        keep[mem[some]] |= ok.any(axis=1)
                if len(ask):
                    w = min(map(len, m))
                    union = np.bitwise_or.reduce([_fold(x, w) for x in m])
                    most = size[ask] - _outside([bits[k] for k in ask], [union])[:, 0]
                    ask = ask[most * (1 + t) >= t * (size[ask] + size[mem].min()) - 1e-9]
                for k in range(0, len(ask), 256):
                    some = ask[k : k + 256]
                    ok = fits([bits[x] for x in some], size[some], m, size[mem])
                    keep[some[ok.any(axis=1)]] = True
                    keep[mem[ok.any(axis=0)]] = True
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(grp[keep]), pa.array(role[keep])], ["doc_id", "grp", "role"])

    rows = _asked(docs.select("doc_id", "text"), cells).mapInArrow(bitmaps, "grp long, role long, doc_id long, size long, bits binary")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "doc_id long, grp long, role long")


def _runs(grp: np.ndarray, role: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each group, one of each document: a row of docs that is there twice counts once."""
    order = np.lexsort((ids, role, grp))
    g, r, i = grp[order], role[order], ids[order]
    order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
    g = grp[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g)) if len(g) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield order[a:b]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], block: int = 512, width: int = 8192) -> np.ndarray:
    """|x & y| for each x of a and y of b: tokens that many have by products of 0/1 matrices, the others pair by pair."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ia, ib = np.repeat(np.arange(len(a)), la), np.repeat(np.arange(len(b)), lb)
    ca, cb = at[: la.sum()], at[la.sum() :]
    na, nb = np.bincount(ca, minlength=len(flat)), np.bincount(cb, minlength=len(flat))
    out = np.zeros((len(a), len(b)), np.float32)
    few = na * nb <= len(a) * len(b) // 256  # tokens whose pairs cost less than a column of the products
    order, start = np.argsort(cb, kind="stable"), np.cumsum(nb) - nb
    rare = np.flatnonzero(few[ca] & (nb[ca] > 0))
    ends, i = np.cumsum(nb[ca[rare]]), 0
    while i < len(rare):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), side="right")))
        c = ca[rare[i:j]]
        np.add.at(out.reshape(-1), np.repeat(ia[rare[i:j]], nb[c]) * len(b) + ib[order[expand(start[c], nb[c])]], np.float32(1))
        i = j
    both = (na > 0) & (nb > 0) & ~few
    new = np.cumsum(both) - 1
    ka, kb = both[ca], both[cb]
    ia, ca, ib, cb, k = ia[ka], new[ca[ka]], ib[kb], new[cb[kb]], int(both.sum())
    for c in range(0, k, width):
        w = min(width, k - c)
        sa, sb = (ca >= c) & (ca < c + w), (cb >= c) & (cb < c + w)
        xa, xca, xb, xcb = ia[sa], ca[sa] - c, ib[sb], cb[sb] - c
        for i in range(0, len(a), block):
            m = np.zeros((min(block, len(a) - i), w), np.float32)
            s = (xa >= i) & (xa < i + block)
            m[xa[s] - i, xca[s]] = 1
            for j in range(0, len(b), block):
                q = np.zeros((min(block, len(b) - j), w), np.float32)
                s = (xb >= j) & (xb < j + block)
                q[xb[s] - j, xcb[s]] = 1
                out[i : i + block, j : j + block] += m @ q.T
    return np.rint(out).astype(np.int64)


def _open(ids, roles, sets, t: float):
    """Pairs of one group, as places in ids, with their Jaccard: member with member, and document of another group or
    block with member, if the union's bound allows."""
    sizes = np.array([len(s) for s in sets])
    mem, ask = np.flatnonzero(roles != 2), np.flatnonzero(roles == 2)
    if not len(mem):
        return
    both = roles[mem[0]] == 1
    if len(ask):
        union = np.unique(np.concatenate([sets[i] for i in mem]))
        bound = np.array([_among(sets[i], union).sum() for i in ask])
        ask = ask[bound * (1 + t) >= t * (sizes[ask] + sizes[mem].min()) - 1e-9]
    rows = np.concatenate([mem, ask]) if both else ask
    for i in range(0, len(rows), 2048):
        for j in range(0, len(mem), 2048):
            r, c = rows[i : i + 2048], mem[j : j + 2048]
            ov = _overlaps([sets[k] for k in r], [sets[k] for k in c])
            jac = ov / np.maximum(1, sizes[r][:, None] + sizes[c][None, :] - ov)
            x, y = np.nonzero(jac >= t)
            s = jac[x, y]
            x, y = r[x], c[y]
            ok = (roles[x] == 2) | (ids[x] < ids[y])
            yield x[ok], y[ok], s[ok]


def _lowest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places the least one that links (x, y) connect it with."""
    low = np.arange(n)
    while len(x):
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        low = low[low]
        go = low[x] != low[y]
        x, y = x[go], y[go]
    while True:
        nxt = low[low]
        if np.array_equal(nxt, low):
            return low
        low = nxt


def _verify(docs: DataFrame, cells: DataFrame, n: int, t: float, pairs: bool) -> DataFrame:
    """a, b, v: all pairs with their Jaccard, or (pairs false) the weighed links v of a, where a = b, and edges (a, b) that
    span all pairs, with v 0."""

    def sets(batches):
        for b in eased(batches):
            ids, m, cells_ = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("m").to_numpy(zero_copy_only=False), b.column("cells").to_pylist()
            for first, off, tok in token_sets(b.column("text"), n):
                grp, role, at = _spread(cells_, first, len(off) - 1)
                blobs = [tok[off[i] : off[i + 1]].tobytes() for i in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(role), pa.array(ids[first + at]), pa.array(m[first + at]), pa.array([blobs[i] for i in at], pa.binary())], ["grp", "role", "doc_id", "m", "tokens"])

    def compare(batches):
        for b in grouped(batches):
            grp, role, ids, m = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            blobs, out, held = b.column(4), [], 0
            for o in _runs(grp, role, ids):
                if len(o) < 2:
                    continue
                own, weight, links = ids[o], m[o], np.zeros(len(o), np.int64)
                xs, ys = [], []
                for x, y, s in _open(own, role[o], [np.frombuffer(blobs[int(k)].as_buffer(), np.uint64) for k in o], t):
                    if pairs:
                        out.append((np.minimum(own[x], own[y]), np.maximum(own[x], own[y]), s))
                        held += len(x)
                        if held > 1 << 17:
                            yield _triples(out)
                            out, held = [], 0
                        continue
                    links += (np.bincount(x, weights=weight[y], minlength=len(o)) + np.bincount(y, weights=weight[x], minlength=len(o))).astype(np.int64)
                    low = _lowest(len(o), x, y)
                    far = np.flatnonzero(low != np.arange(len(o)))
                    xs.append(far)
                    ys.append(low[far])
                if xs:
                    low = _lowest(len(o), np.concatenate(xs), np.concatenate(ys))
                    some, far = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(o)))
                    out += [(own[some], own[some], links[some].astype(float)), (own[far], own[low[far]], np.zeros(len(far)))]
            if out:
                yield _triples(out)

    joined = _asked(docs, cells)
    rows = joined.select("doc_id", "text", "m", "cells").mapInArrow(sets, "grp long, role long, doc_id long, m long, tokens binary")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long, v double")


def _triples(got) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in range(3)], ["a", "b", "v"])


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts that have a word: key (a hash of the text), m (its rows), first (its least doc_id); and
    one row of each class: doc_id (the key), text, m. A class's rows are pre-aggregated before they are shuffled."""
    some = docs_of(docs).filter(F.col("text").rlike(WORDED)).withColumn("key", F.xxhash64("text"))
    classes = cut(some.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")))
    copied = classes.filter("m > 1").select("key", "m")
    copied = small(copied, copied.count(), 16)
    one = cut(some.join(copied, "key").select(F.col("key").alias("doc_id"), "text", "m").dropDuplicates(["doc_id"]))
    alone = some.join(copied, "key", "left_anti").select(F.col("key").alias("doc_id"), "text", F.lit(1).cast("long").alias("m"))
    return classes, alone.unionByName(one)


def _compared(texts: DataFrame, n: int, t: float, pairs: bool) -> DataFrame:
    spark = texts.sparkSession
    size = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = max(8, min(16, (8 * size - 1).bit_length()), (size - 1).bit_length())
    texts = cut(_sharing(texts, n, t, bits))
    hot = spark.sparkContext.broadcast(_hot_tokens(texts, n, bits))
    cells = in_blocks(_met(_postings(texts, n, t, bits, hot), t), BLOCK)
    return _verify(texts, cut(_shut(texts, cells, n, t)), n, t, pairs)


def jaccard_pairs(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different texts whose n-gram sets have Jaccard >= threshold (> 0): doc_a < doc_b, jaccard.

    A text stands under the least doc_id of its rows. Null and empty texts match nothing. Rows without doc_id are left
    out. Texts that share their least doc_id don't pair; if two doc_ids pair by several texts, the greatest Jaccard is
    listed. Extra columns are ignored. An empty table gives no rows. Its rows may grow with the square of a group of
    near copies: near_copies() has no such growth.
    """
    classes, texts = _texts(docs)
    pairs = _compared(texts, n, threshold, True)
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("key").alias(side), F.col("first").alias(f"doc_{side}")), side)
    least, most = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
    return pairs.filter("doc_a <> doc_b").groupBy(least.alias("doc_a"), most.alias("doc_b")).agg(F.max("v").alias("jaccard"))


def _linked(docs: DataFrame, n: int, t: float) -> DataFrame:
    """key, m, first, links (to rows of other texts) and root (a key of its connected component) of each text that has a
    link or a copy."""
    classes, texts = _texts(docs)
    found = cut(_compared(texts, n, t, False))
    links = found.filter("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("v").cast("long").alias("links"))
    roots = components(found.filter("a <> b").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).select(F.col("doc_id").alias("key"), "root")
    out = classes.join(links, "key", "left").join(roots, "key", "left").filter("m > 1 OR links IS NOT NULL")
    return cut(out.select("key", "m", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")))


def near_copies(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links for each document, that is, row of docs, that has a link.

    Two documents are linked if their n-gram sets have Jaccard >= threshold (> 0); those of equal texts are. n_links
    counts all of a document's links; class_id is the least doc_id of its connected component. No pair is left out of
    either, but pairs aren't listed, so there is one row for each document, whatever the size of its class.

    A document without a link is in a class of its own and not listed; those of null and empty texts never have one.
    Rows without doc_id are left out. Repeated rows are documents and link to each other. Extra columns are ignored. An
    empty table gives no rows.
    """
    linked = _linked(docs, n, threshold)
    names = linked.groupBy("root").agg(F.min("first").alias("class_id"))
    of_text = linked.join(small(names, names.count(), 16), "root").select("key", "class_id", (F.col("m") - 1 + F.col("links")).alias("n_links"))
    rows = docs_of(docs).select("doc_id", F.xxhash64("text").alias("key"))
    return rows.join(small(of_text, linked.count(), 24), "key").select("doc_id", "class_id", "n_links")


def components(pairs: DataFrame) -> DataFrame:
    """doc_id and the least doc_id of its connected component, for each document in pairs (doc_a, doc_b).

    Alternates linking neighbours to the least of a neighbourhood (large star, small star) until nothing changes, so
    long chains take few rounds. Each round is written to the shared folder.
    """
    edges = cut(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).distinct()
        before = now


def keep_one(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near copies: of each connected group of near_copies() one row stays, that of the least doc_id. All
    columns are kept.

    What goes is judged by row, not by doc_id: a text without a near copy stays, whatever doc_id it has. Of rows with
    equal doc_id and text one stays. Documents in no group stay, null texts, texts without a word and rows without
    doc_id among them.
    """
    linked = _linked(docs, n, threshold)
    kept = linked.groupBy("root").agg(F.min(F.struct("first", "key")).alias("w"))
    ways = linked.join(small(kept, kept.count(), 24), "root").select("key", F.when(F.col("key") == F.col("w.key"), F.col("first")).alias("stays"))
    key, stays = free_name(docs, "__key"), free_name(docs, "__stays")
    ways = cut(ways.select(F.col("key").alias(key), F.col("stays").alias(stays), F.lit(True).alias(key + "s")))
    known = docs.withColumn(key, F.when(F.col("doc_id").isNotNull() & F.col("text").rlike(WORDED), F.xxhash64(F.col("text").cast("string"))))
    rows = known.join(small(ways, ways.count(), 17), key, "left")
    id_ = F.col("doc_id").cast("long")
    out = rows.filter(F.col(key + "s").isNull() | F.coalesce(id_ == F.col(stays), F.lit(False)))
    twice = out.filter(F.col(stays).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    twice = cut(twice)
    n_twice = twice.count()
    if n_twice:  # repeated rows of a doc_id and text
        twice = small(twice, n_twice, 8)
        out = out.join(twice, key, "left_anti").select(*docs.columns, key).unionByName(out.join(twice, key, "left_semi").select(*docs.columns, key).dropDuplicates([key]))
    return out.select(*docs.columns)

