"""Curation: validity filters, banding, exact splits, sampling, judge joins, resume, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions import answers
from lodespark.sources.shared import cut

BROADCAST_ROWS = 2_000_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (narrow ones: keys and a few values)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def keep_valid_and_known(df: DataFrame, col: str) -> DataFrame:
    return df.filter(answers.is_known_answer(F.col(col)))


def unknown_answers(df: DataFrame, col: str) -> DataFrame:
    return df.filter(answers.is_unknown_answer(F.col(col)))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing, with their defaults."""
    return df.withColumns({k: v for k, v in defaults.items() if k.lower() not in {c.lower() for c in df.columns}})


def hash_order(key: Column, seed: int = 48271) -> Column:
    """A portable pseudo-random order of integer keys (Lehmer's generator)."""
    return F.pmod(key.cast("long") * F.lit(seed), F.lit(2147483647))


def in_order(df: DataFrame, order: list[Column], part: str, pos: str) -> DataFrame:
    """df sorted by range, with the number of each row's part and its 0-based place there. The sorted table is written
    once: range bounds are sampled, so what is computed twice from them needn't agree."""
    n, at = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), F.col(pos)
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id()))
    return rows.withColumns({part: F.shiftright(at, 33), pos: at.bitwiseAND(F.lit((1 << 33) - 1))})


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Are a and b equal in keys, NULL being equal to NULL?"""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def ranked(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None, size: str | None = None) -> DataFrame:
    """df with the 0-based rank in name, of all rows or of those of each group in by, and the number of rows ranked
    together in size, if given.

    Rows don't move to one task: they are sorted by range, counted by part, and ranked inside their part on top of the
    counts before it. Rows that are equal in order come in any order, each with a rank of its own."""
    by = by or []
    rows = in_order(df, [F.col(c).asc() for c in by] + order, "__part", "__pos")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per part
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__pos") + F.col("__before")).drop("__part", "__pos", "__before")
    if not by:
        return out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(size)))) if size else out
    starts = out.groupBy(*by).agg(F.min(name).alias("__start"), F.count("*").alias(size or "__size"))
    out = out.alias("a").join(sized(starts).alias("b"), same(out, starts, by))
    return out.select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{name}") - F.col("__start")).alias(name), *([F.col(size)] if size else []))


def quantiles(df: DataFrame, x: Column, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q0, q1, ..: the interpolated quantiles of x without NULL and NaN, for each group, or in one row for all. They
    are read off ranks, so no task holds a group's values."""
    by = by or []
    some = df.select(*by, x.cast("double").alias("__x")).filter("__x IS NOT NULL AND NOT isnan(__x)")
    r = ranked(some, [F.col("__x").asc()], "__r", by, "__n")
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in shares]
    near = F.lit(False)
    for a in at:
        near = near | F.col("__r").isin(F.floor(a), F.ceil(a))
    value = lambda place: F.max(F.when(F.col("__r") == place, F.col("__x")))
    aggs = [(value(F.floor(a)) + (value(F.ceil(a)) - value(F.floor(a))) * F.max(a - F.floor(a))).alias(f"q{k}") for k, a in enumerate(at)]
    return r.filter(near).groupBy(*by).agg(*aggs)


def bands(df: DataFrame, score: str, key: str, k: int = 5, answer: str | None = None) -> DataFrame:
    """Equal complexity bands: sorted by score (NaN and NULL last), ties by key, cut into k bands of n // k rows; the
    n % k rows at the hard end go. Rows without a known answer go first, if answer is given."""
    if answer:
        df = keep_valid_and_known(df, answer)
    s = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    out = ranked(df, [s.asc_nulls_last(), F.col(key).asc()], "__rank", size="__total")
    band = F.floor(F.col("__rank") / F.nullif(F.floor(F.col("__total") / k), F.lit(0)))
    return out.withColumn("band", band.cast("int")).filter(F.col("band") < k).drop("__rank", "__total")


def train_test(df: DataFrame, share: float, key: str, by: list[str]) -> DataFrame:
    """split: exactly round(n * share) rows (half to even) of each group are train, the others test; the choice depends
    on the key alone."""
    out = ranked(df, [hash_order(F.col(key)).asc(), F.col(key).asc()], "__rank", by, "__size")
    train = F.col("__rank") < F.bround(F.col("__size") * F.lit(share), 0)
    return out.withColumn("split", F.when(train, "train").otherwise("test")).drop("__rank", "__size")


def chunks(df: DataFrame, key: str, size: int = 30) -> DataFrame:
    """chunk: the 0-based number of the chunk of size rows, in key order."""
    return ranked(df, [F.col(key).asc()], "__rank").withColumn("chunk", F.floor(F.col("__rank") / size)).drop("__rank")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 48271) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """fold: stratified by label, 0..k-1."""
    out = ranked(df, [hash_order(F.col(key)).asc(), F.col(key).asc()], "__rank", [label])
    return out.withColumn("fold", F.pmod("__rank", F.lit(k)).cast("int")).drop("__rank")


def join_education_levels(df: DataFrame, judge: DataFrame, key: str = "question_id", threshold: int = 9, level: str | None = None) -> DataFrame:
    """Inner join with the judge's levels rated at least threshold, encoded as masj_complexity; the level's name in
    level, if given."""
    right = judge.filter(F.col("masj_rating") >= threshold)
    right = right.select(key, answers.level_score(F.col("masj_complexity")).alias("masj_complexity"), *([F.col("masj_complexity").alias(level)] if level else []))
    return df.join(sized(right), key, "inner")


def join_reasoning_steps(df: DataFrame, judge: DataFrame, key: str = "question_id", level: str | None = None) -> DataFrame:
    """Inner join with the judged number of reasoning steps (NULL ones go), encoded; its name in level, if given."""
    steps = F.col("masj_num_reasoning_steps")
    right = judge.dropna(subset=["masj_num_reasoning_steps"]).select(key, answers.steps_score(steps).alias("masj_num_reasoning_steps"), *([steps.alias(level)] if level else []))
    return df.join(sized(right), key, "inner")


def rows_of(df: DataFrame, ids: DataFrame, key: str = "question_id", once: bool = False) -> DataFrame:
    """Rows whose key is in ids: once each, or as often as it is there."""
    return df.join(ids.select(key), key, "left_semi" if once else "inner")


def latest_success(records: DataFrame, key: Column, order: Column) -> DataFrame:
    """One record for each key: a successful one (no error) before a failed one, then the latest."""
    w = Window.partitionBy(key).orderBy(F.col("output.error").isNull().desc(), order.desc())
    return records.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def todo(source: DataFrame, done: DataFrame, key: str = "question_id", limit: int | None = None) -> DataFrame:
    """Rows still to be done: the first limit rows in key order, less those done without error."""
    if limit is not None:
        source = source.orderBy(key).limit(limit)
    if "output" in done.columns:
        done = done.filter(F.col("output.error").isNull()).select(F.col(f"input.{key}").cast(source.schema[key].dataType).alias(key))
    return source.join(done.select(key).distinct(), key, "left_anti")


def review_input(source: DataFrame, branch_a: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions whose latest successful first-branch record is wrong, with its answer and thinking."""
    good = branch_a.filter(F.col("output.error").isNull())
    last = good.groupBy(F.col(f"input.{key}").cast(source.schema[key].dataType).alias(key)).agg(F.max_by("output", "seq").alias("o"))
    wrong = last.filter(~F.coalesce(F.col("o.is_correct"), F.lit(False))).select(key, F.col("o.answer").alias("previous_answer"), F.col("o.thinking").alias("previous_thinking"))
    return source.join(wrong, key)


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts one after another, with their name in dataset; columns that a part lacks are NULL."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column, sorted; NULL is one of them and comes first."""
    return df.select(col).distinct().orderBy(F.col(col).asc_nulls_first())


def head(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


#: What still has to be done: rows for which a kind of work has no result that counts.
RESUME = {
    "scored": lambda: F.coalesce(answers.strip(F.col("answer")), F.lit("")) == "",
    "correct": lambda: ~F.coalesce(F.col("ans_correct"), F.lit(False)),
    "response": lambda: F.coalesce(F.col("response"), F.lit("")) == "",
    "judged": lambda: ~(F.coalesce(F.col("masj_complexity").isin(answers.LEVELS), F.lit(False)) & F.coalesce(F.col("masj_rating").between(1, 10), F.lit(False))),
}


def unfinished(df: DataFrame, kind: str) -> DataFrame:
    """Rows still to be done, by the kind of work: scored (an empty answer), correct (any answer that isn't right, so
    wrong ones are asked again), response (no response) or judged (no known level, or a rating outside 1..10)."""
    return df.filter(RESUME[kind]())


def with_formatted(df: DataFrame, prompt: Column, name: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Rows whose prompt can be formatted (it is not NULL), with it in name; and one row: how many were skipped."""
    out = df.withColumn(name, prompt)
    return out.filter(F.col(name).isNotNull()), out.agg(F.count_if(F.col(name).isNull()).alias("skipped"))


def answered(df: DataFrame, col: str) -> DataFrame:
    """Rows with a value in col."""
    return df.filter(F.col(col).isNotNull())


def with_labels(predictions: DataFrame, labels: DataFrame, key: str = "question_id") -> DataFrame:
    """Predictions with the labels of the same key; predictions without a label go."""
    return predictions.join(labels, key, "inner")
