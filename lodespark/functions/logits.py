"""Scores of logits and log-probabilities held as array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: used inside another lambda, it would be computed for each
    element there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shifted(logits: Column, body: Callable[[Column], Column]) -> Column:
    """body(logits less their maximum)."""
    return let(F.array_max(logits), lambda top: let(F.transform(logits, lambda x: x - top), body))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def softmax(logits: Column) -> Column:
    parts = lambda s: let(F.transform(s, lambda x: F.exp(x)), lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))
    return shifted(logits, parts)


def entropy(logits: Column) -> Column:
    """Softmax entropy in nats, with 1e-12 inside the logarithm. NULL for an empty array."""
    return F.when(F.size(logits) > 0, F.aggregate(softmax(logits), F.lit(0.0), lambda s, p: s - p * F.log(p + EPSILON)))


def argmax(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def cross_entropy(logits: Column, correct: Column) -> Column:
    """-log softmax at the correct place; NULL if there is no such place."""
    return shifted(logits, lambda s: F.log(total(F.transform(s, lambda x: F.exp(x)))) - F.when(correct >= 0, F.get(s, correct.cast("int"))))


def sparse_probabilities(logits: Column, cutoff: float = 1e-5) -> Column:
    """(token_idx, token_prob) of the tokens whose probability is over the cutoff."""
    pairs = F.transform(softmax(logits), lambda p, i: F.struct(i.cast("int").alias("token_idx"), p.alias("token_prob")))
    return F.filter(pairs, lambda x: x["token_prob"] > cutoff)


def top_tokens(logits: Column, k: int = 5) -> Column:
    """The k likeliest (token_idx, token_prob), ties by place."""
    pairs = F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("n"), i.cast("int").alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["i"].alias("token_idx"), (-x["n"]).alias("token_prob")))


def truncated_entropy(logprobs: Column) -> Column:
    """-sum p ln p over the log-probabilities at hand, not made to sum to one."""
    return -F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x * F.exp(x))


def log_softmax(logits: Column) -> Column:
    return shifted(logits, lambda s: let(F.log(total(F.transform(s, lambda x: F.exp(x)))), lambda z: F.transform(s, lambda x: x - z)))


def pooled(vectors: Column) -> Column:
    """Per-dimension min, max and mean of array<array<double>>; NULL if there is no vector."""
    n = F.size(vectors)
    fold = lambda f: F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, f))
    return F.when(n > 0, F.struct(fold(lambda a, b: F.least(a, b)).alias("min"), fold(lambda a, b: F.greatest(a, b)).alias("max"), F.transform(fold(lambda a, b: a + b), lambda x: x / n).alias("mean")))


def entropy_at(entropies_json: Column, index: Column) -> Column:
    """One entropy out of a JSON array; NULL outside it."""
    return F.when(index >= 0, F.get(F.from_json(entropies_json, "array<double>"), index.cast("int")))


def token_at(stats_json: Column, index: Column) -> Column:
    """The likeliest token_idx at a place of the JSON stats, the first of equals; NULL outside them."""
    s = F.when(index >= 0, F.get(F.from_json(stats_json, "array<array<struct<token_idx:int,token_prob:double>>>"), index.cast("int")))
    best = F.transform(s, lambda x: x["token_prob"])
    return F.get(s, (F.array_position(best, F.array_max(best)) - 1).cast("int"))["token_idx"]
