"""Token sequences: slices, masks, windows at the end, and attention-weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespark.functions.logits import let, total

IGNORE = -100


def clip_weights(w: Column) -> Column:
    return F.transform(w, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def mean(h: Column) -> Column:
    return F.when(F.size(h) > 0, total(h) / F.size(h))


def median(h: Column) -> Column:
    s, n = F.array_sort(h), F.size(h)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def weighted_mean(h: Column, w: Column) -> Column:
    """Mean by weights with negative ones as 0; the plain mean if they have no mass; NULL for no tokens."""
    w = clip_weights(w)
    mass = total(w)
    return F.when(F.size(h) == 0, None).when(mass <= 1e-12, mean(h)).otherwise(total(F.zip_with(h, w, lambda x, y: x * y)) / mass)


def share_over(h: Column, threshold: Column) -> Column:
    """Share of tokens strictly over the threshold."""
    return F.when(F.size(h) > 0, F.size(F.filter(h, lambda x: x > threshold)) / F.size(h))


def weight_share_over(h: Column, w: Column, threshold: Column) -> Column:
    """Share of the weight that lies on tokens over the threshold; NULL if there is no weight or token."""
    w = clip_weights(w)
    mass = total(w)
    return F.when((F.size(h) > 0) & threshold.isNotNull() & (mass > 1e-12), total(F.zip_with(h, w, lambda x, y: F.when(x > threshold, y).otherwise(0.0))) / mass)


def top_by_weight(h: Column, w: Column, k: int = 5) -> Column:
    """The values at the k greatest weights, ties by place."""
    rows = F.transform(F.arrays_zip(h.alias("h"), w.alias("w")), lambda x, i: F.struct((-x["w"]).alias("n"), i.alias("i"), x["h"].alias("h")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: x["h"])


def tail(h: Column, k: int) -> Column:
    """The last k values; NULL if there are fewer."""
    return F.when(F.size(h) >= k, F.slice(h, -k, k))


def normal_weights(w: Column) -> Column:
    """Clipped weights that sum to one; equal ones if they have no mass."""
    c = clip_weights(w)
    return let(total(c), lambda mass: F.transform(c, lambda x: F.when(mass <= 1e-12, F.lit(1.0) / F.size(w)).otherwise(x / mass)))


def tail_features(h: Column, w: Column, n: int = 64) -> Column:
    """3n numbers: the last n values, their normalised weights, and a mask, each padded with zeros on the left."""
    k = F.least(F.lit(n), F.size(h))
    pad = lambda a: F.concat(F.array_repeat(F.lit(0.0), n - k), F.when(k > 0, F.slice(a, -k, k)).otherwise(F.array().cast("array<double>")))
    k = F.coalesce(k, F.lit(0))
    return F.concat(pad(h), pad(normal_weights(w)), F.concat(F.array_repeat(F.lit(0.0), n - k), F.array_repeat(F.lit(1.0), k)))


def marker_token(tokens: Column, left: str = "[[", right: str = "]]") -> Column:
    """0-based place of the token after the one that completes the first left marker, if a later token completes a
    right marker; -1 otherwise."""
    ends = F.aggregate(tokens, F.array().cast("array<int>"), lambda s, t: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + F.length(t))))
    text = F.array_join(tokens, "")
    upto = lambda mark, size: F.when(F.locate(mark, text) > 0, F.size(F.filter(ends, lambda e: e < F.locate(mark, text) + size - 1)))
    a, b = upto(left, len(left)), upto(right, len(right))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(tokens) > F.greatest(a + 1, b)), a + 1).otherwise(-1)


def answer_slice(a: Column, start: Column, end: Column, room: Column) -> Column:
    """a[start:end] with both ends clipped to 0..room."""
    lo = F.least(F.greatest(start, F.lit(0)), room)
    hi = F.least(F.greatest(end, F.lit(0)), room)
    return F.slice(a, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def without_special(tokens: Column, h: Column, w: Column, special: Column) -> Column:
    """array<struct<t,h,w>> of the tokens that are not special."""
    return F.filter(F.arrays_zip(tokens.alias("t"), h.alias("h"), w.alias("w")), lambda x: ~F.array_contains(special, x["t"]))


def find_subsequence(a: Column, b: Column) -> Column:
    """First place where b stands in a, or -1; 0 for an empty b."""
    n, m = F.size(a), F.size(b)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.slice(a, i + 1, m) == b)
    return F.when(m == 0, 0).when(n < m, -1).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def label_ids(prompt: Column, answer: Column, mask_prompt: bool = True) -> Column:
    """Labels of prompt + answer, the prompt's masked or copied."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)) if mask_prompt else prompt, answer)


def mask_before(ids: Column, start: Column, pad: int) -> Column:
    """ids with those before start and all pads masked; all masked if start is negative."""
    return F.transform(ids, lambda x, i: F.when((start < 0) | (i < start) | (x == pad), IGNORE).otherwise(x))


def pad_left(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0)).cast("int")), ids)


def fit_to(ids: Column, size: int, pad: int) -> Column:
    """Truncated to size, then padded on the right to it."""
    cut = F.slice(ids, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(ids), F.lit(0)).cast("int")))


def shifted_hits(labels: Column, predicted: Column, eos: int) -> Column:
    """struct<hits,n>: predictions that equal the next label, over labels that are neither masked nor eos."""
    n = F.size(labels)
    pairs = F.filter(F.arrays_zip(F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("y"), F.slice(predicted, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("p")), lambda x: (x["y"] != IGNORE) & (x["y"] != eos))
    return F.struct(F.size(F.filter(pairs, lambda x: x["y"] == x["p"])).alias("hits"), F.size(pairs).alias("n"))


def first_id(ids: Column) -> Column:
    """The first token id of an answer letter, -1 if it has none."""
    return F.coalesce(F.get(ids, F.lit(0)), F.lit(-1))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max rescaled to 0..1; 0 if lo and hi are the same."""
    return F.coalesce(F.least(F.greatest(F.try_divide(x - lo, hi - lo), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def html(tokens: Column, scaled: Column) -> Column:
    """Tokens as coloured, escaped HTML spans; scaled in 0..1 gives the shade."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.array_join(F.zip_with(tokens, scaled, lambda t, s: F.concat(F.lit('<span style="background:rgba(255,0,0,'), F.format_number(s, 2), F.lit(')">'), esc(t), F.lit("</span>"))), "")
