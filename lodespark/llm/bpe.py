"""BPE encoding and decoding with a prefix-sharing trie.

The distinct pre-tokens of a stretch of text form a trie, walked depth first (the sorted order of its words). A node's
state is the last token of its prefix's encoding and where that token starts; it follows from the states of its
ancestors: the last token is the one suffix token of the prefix that is compatible with the last token of what precedes
it. So a prefix that many words share is encoded once, and a word's tokens are read off by jumping from state to state.
Two tokens are compatible if BPE, given their joined bytes, would leave them apart; that is found by undoing their
merges, latest first, and looking for an earlier merge across the border, and remembered.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.common import docs_of
from lodespark.llm.textkernel import buffers, chunks, expand, gathered

VOCABULARY = os.environ.get("LODESPARK_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TRIE_BYTES = 4 << 20


class Vocabulary(NamedTuple):
    """Tokens by rank, and the two tokens that each was merged from (twice itself, if it is a byte)."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]


_LOADED: dict[str, Vocabulary] = {}


def load(path: str = VOCABULARY) -> Vocabulary:
    """Reads a rank file (base64 token, space, rank in each line) and finds each token's last merge."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        left, right = list(range(len(tokens))), list(range(len(tokens)))
        for r, t in enumerate(tokens):
            if len(t) > 1:
                parts = [t[i : i + 1] for i in range(len(t))]
                while len(parts) > 2:
                    best, at = min((ranks.get(parts[i] + parts[i + 1], r), i) for i in range(len(parts) - 1))
                    if best >= r:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
        _LOADED[path] = Vocabulary(tokens, left, right)
    return _LOADED[path]


class Encoder:
    """Encodes sorted distinct words of a vocabulary; remembers which token pairs are compatible."""

    def __init__(self, v: Vocabulary):
        self.tokens, self.left, self.right = v
        self.ranks = {t: r for r, t in enumerate(v.tokens) if t}
        # a token that BPE never makes from its own bytes can only be a whole word
        self.made = {t: r for t, r in self.ranks.items() if len(t) == 1 or v.left[r] != r}
        self.longest = max(map(len, self.made))
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        tokens, ranks, left, right, limit = self.tokens, self.ranks, self.left, self.right, 1 << 60
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            undo_a = a > b
            for _ in (0, 1):
                if undo_a:
                    limit, nxt = a, right[a]
                    if nxt != a:
                        a = nxt
                        break
                else:
                    limit, nxt = b + 1, left[b]
                    if nxt != b:
                        b = nxt
                        break
                undo_a = not undo_a
            else:
                return True

    def words(self, ordered: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after another, and the number of each."""
        made, ranks, pairs, longest = self.made.get, self.ranks.get, self.pairs, self.longest
        known = pairs.get
        room = max(map(len, ordered), default=0) + 1
        last, back = [0] * room, [0] * room
        out: list[int] = []
        count: list[int] = []
        before = b""
        for w in ordered:
            whole = ranks(w)
            if whole is not None:
                out.append(whole)
                count.append(1)
                continue
            n = len(w)
            i, m = 0, min(n, len(before))
            if w[:m] == before[:m]:
                i = m
            else:
                while w[i] == before[i]:
                    i += 1
            while i < n:
                i += 1
                j = i - longest if i > longest else 0
                while True:
                    t = made(w[j:i])
                    if t is not None:
                        if not j:
                            break
                        key = last[j] << 20 | t
                        ok = known(key)
                        if ok is None:
                            ok = pairs[key] = self.compatible(last[j], t)
                        if ok:
                            break
                    j += 1
                last[i], back[i] = t, j
            k, at = len(out), n
            while at:
                out.append(last[at])
                at = back[at]
            out[k:] = out[k:][::-1]
            count.append(len(out) - k)
            before = w
        return np.array(out, np.int32), np.array(count, np.int64)


def encoded(texts: pa.Array, encoder: Encoder) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch of texts: first row, the texts, words of each document (offsets, word numbers), and the words'
    tokens (offsets, tokens)."""
    import regex

    find = regex.compile(PATTERN).findall
    for first, part in chunks(texts, TRIE_BYTES):
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        get, rows = number.__getitem__, []
        for x in part:
            found = find(x.as_py())
            rows.append(np.fromiter(map(get, found), np.int32, len(found)))
        words = [w.encode() for w in number]
        order = sorted(range(len(words)), key=words.__getitem__)
        flat, count = encoder.words([words[k] for k in order])
        del words
        number.clear()
        where = np.empty(len(order), np.int64)
        where[np.array(order, np.int64)] = np.arange(len(order))
        tok_off = np.concatenate([[0], np.cumsum(count)])
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        yield first, part, off, where[np.concatenate(rows)] if rows else np.zeros(0, np.int64), tok_off, flat


def decode(tokens: np.ndarray, table: np.ndarray, table_off: np.ndarray) -> np.ndarray:
    """Bytes of a run of tokens; table and table_off hold the vocabulary's bytes one after another."""
    return table[expand(table_off[tokens], table_off[tokens + 1] - table_off[tokens])]


def byte_table(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(v.tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in v.tokens])]).astype(np.int64)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids, and round_trip: do the decoded tokens give back the text's bytes?

    One row for each row with a doc_id, repeated ones too. A null text has null token_ids and round_trip and n_tokens 0;
    an empty one has an empty list. Strings of special tokens are ordinary text. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load(vocabulary)))

    def run(batches):
        v = Vocabulary(*shared.value)
        encoder, (table, table_off) = Encoder(v), byte_table(v)
        for b in gathered(batches, TRIE_BYTES):
            ids, nulls = b.column("doc_id"), b.column("text").is_null().to_numpy(zero_copy_only=False)
            for first, part, off, word, tok_off, flat in encoded(b.column("text"), encoder):
                size = tok_off[word + 1] - tok_off[word]
                ends = np.concatenate([[0], np.cumsum(size)])[off]
                step = max(1, len(part) // max(1, int(ends[-1]) >> 18))  # about 262,144 tokens at a time
                for i in range(0, len(part), step):
                    j = min(len(part), i + step)
                    sl = slice(off[i], off[j])
                    tokens = flat[expand(tok_off[word[sl]], size[sl])]
                    back = decode(tokens, table, table_off)
                    src, src_off = buffers(part.slice(i, j - i))
                    lens = np.concatenate([[0], np.cumsum(table_off[tokens + 1] - table_off[tokens])])
                    at = ends[i : j + 1] - ends[i]
                    same = np.ones(j - i, bool) if len(back) == len(src) and np.array_equal(back, src) and np.array_equal(lens[at], src_off) else np.array([np.array_equal(back[lens[at[k]] : lens[at[k + 1]]], src[src_off[k] : src_off[k + 1]]) for k in range(j - i)], bool)
                    no = nulls[first + i : first + j]
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens), mask=pa.array(no))
                    yield pa.RecordBatch.from_arrays([ids.slice(first + i, j - i), pa.array(np.diff(at)), lists, pa.array(same, mask=no)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, docs: how many rows of docs have each encoded length. Null and empty texts have length 0."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load(vocabulary)))

    def run(batches):
        encoder, total = Encoder(Vocabulary(*shared.value)), {}
        for b in gathered(batches, TRIE_BYTES):
            for _, part, off, word, tok_off, _ in encoded(b.column("text"), encoder):
                ends = np.concatenate([[0], np.cumsum(tok_off[word + 1] - tok_off[word])])[off]
                for n, c in zip(*np.unique(np.diff(ends), return_counts=True), strict=True):
                    total[int(n)] = total.get(int(n), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["n_tokens", "docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def decode_documents(encoded_docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and token_ids; null token_ids give a null text, bytes that aren't UTF-8 U+FFFD."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(tuple(load(vocabulary)))

    def run(batches):
        table, table_off = byte_table(Vocabulary(*shared.value))
        for b in batches:
            texts = [None if x.as_py() is None else decode(np.array(x.as_py(), np.int64), table, table_off).tobytes().decode("utf-8", "replace") for x in b.column("token_ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
