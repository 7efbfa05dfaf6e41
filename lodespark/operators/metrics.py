"""Metrics: accuracy, tie-aware ROC-AUC by category, histograms, percentiles, token budgets, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.operators.curate import in_order, quantiles, same


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def auc_by(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """ROC-AUC with half credit for ties, by group: by, auc, n_pos, n_neg; auc is NULL with one class only.

    Rows are first counted by distinct score; NULL and NaN scores don't count. The distinct scores are sorted by range,
    and what lies below a score is summed in its part and over the parts before it, so no task holds a group's scores.
    """
    some = df.filter(F.col(score).isNotNull() & ~F.isnan(_num(score)) & F.col(label).isNotNull())
    y = F.col(label).cast("int")
    cells = some.groupBy(*by, _num(score).alias("__s")).agg(F.sum(y).alias("__p"), F.sum(1 - y).alias("__n"))
    cells = in_order(cells, [F.col(c).asc() for c in (*by, "__s")], "__part", "__pos")
    w = Window.partitionBy("__part", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    parts = cells.groupBy(*by, "__part").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"), F.sum(F.col("__p") * (F.col("__below") + F.col("__n") / 2)).alias("__u"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per part
    parts = parts.withColumn("__u", F.col("__u") + F.col("__p") * F.coalesce(F.sum("__n").over(w), F.lit(0)))
    out = parts.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum("__u").alias("__u"))
    return out.select(*by, F.try_divide(F.col("__u"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def report(df: DataFrame, model: str, categories: list[str], correct: str, score: str, threshold: int = 10) -> DataFrame:
    """category, roc_auc, accuracy, gini, num_samples, model, metric: for ALL rows and each value of each category
    column with at least threshold rows. Scores count against correctness (a low score means an easy row): the AUC is
    that of 1 - score / max, which only depends on order. NULL categories count under ALL only."""
    keys = [F.struct(F.lit("ALL").alias("col"), F.lit("ALL").alias("category"))] + [F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("category")) for c in categories]
    long = df.select(F.explode(F.array(*keys)).alias("k"), F.col(correct).cast("int").alias("y"), (-_num(score)).alias("s")).select("k.col", "k.category", "y", "s").filter("category IS NOT NULL")
    size = long.groupBy("col", "category").agg(F.avg("y").alias("accuracy"), F.count("*").alias("num_samples")).filter((F.col("num_samples") >= threshold) | (F.col("col") == "ALL"))
    auc = auc_by(long, ["col", "category"], "y", "s")
    out = size.join(auc, ["col", "category"], "left")
    return out.select("category", F.col("auc").alias("roc_auc"), "accuracy", F.abs(2 * F.col("auc") - 1).alias("gini"), "num_samples", F.lit(model).alias("model"), F.lit(score).alias("metric"))


def normalised(df: DataFrame, score: str, name: str, basis: float | None = None) -> DataFrame:
    """name = 1 - score / basis; the basis is the greatest score if it is None or 0."""
    if basis:
        return df.withColumn(name, 1 - _num(score) / F.lit(float(basis)))
    top = df.agg(F.max(F.when(~F.isnan(_num(score)), _num(score))).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, 1 - F.try_divide(_num(score), F.col("__top"))).drop("__top")


def metric_table(df: DataFrame, metrics: list[str], label: str, min_valid: int = 10) -> DataFrame:
    """metric, auc, n_valid, n_incorrect, n_correct: for each metric with enough finite scores and both classes. The
    label is 1 for an incorrect row."""
    long = df.unpivot([label], metrics, "metric", "score").withColumn("score", F.when(F.abs(F.col("score")) < float("inf"), F.col("score")))
    out = auc_by(long, ["metric"], label, "score").filter((F.col("n_pos") + F.col("n_neg") >= min_valid) & F.col("auc").isNotNull())
    return out.select("metric", "auc", (F.col("n_pos") + F.col("n_neg")).alias("n_valid"), F.col("n_pos").alias("n_incorrect"), F.col("n_neg").alias("n_correct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def describe(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    x = F.when(~F.isnan(_num(col)), _num(col))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, x, [0.25, 0.5, 0.75], by)
    both = out.join(q, same(out, q, by), "left")
    return both.select(*[out[c] for c in by], "n", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def auto_bins(df: DataFrame, col: str) -> int:
    """The greater of Sturges' and Freedman and Diaconis' numbers of bins."""
    import math

    x = _num(col)
    some = df.filter(x.isNotNull() & ~F.isnan(x))
    n, lo, hi = some.agg(F.count("*"), F.min(x), F.max(x)).first()
    if not n or hi == lo:
        return 1
    q1, q3 = quantiles(some, x, [0.25, 0.75]).first()
    width = 2 * (q3 - q1) / n ** (1 / 3)
    return max(math.ceil(math.log2(n)) + 1, math.ceil((hi - lo) / width) if width else 1)


def histogram(df: DataFrame, x: str, hue: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """by, bin (1..bins), hue, n, share: rows by bin and outcome, and the share of each outcome in its bin. Bins are
    equal parts of the range of x over all rows; the greatest x is in the last."""
    by = by or []
    lim = df.agg(F.min(_num(x)).alias("__lo"), F.max(_num(x)).alias("__hi"))
    b = df.crossJoin(F.broadcast(lim)).filter(F.col(x).isNotNull())
    pos = F.floor(F.try_divide(_num(x) - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins)) + 1
    b = b.withColumn("bin", F.least(F.coalesce(pos, F.lit(1)), F.lit(bins)).cast("int"))
    cells = b.groupBy(*by, "bin", hue).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "bin")))


def masked_accuracy(df: DataFrame, hits: str, by: list[str]) -> DataFrame:
    """Accuracy over all unmasked tokens, from struct<hits,n> columns."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(f"{hits}.hits")).cast("double"), F.sum(F.col(f"{hits}.n"))).alias("accuracy"), F.sum(F.col(f"{hits}.n")).alias("tokens"))


def weighted_running(df: DataFrame, values: list[str], weight: str, by: list[str]) -> DataFrame:
    """Means weighted by sample counts."""
    return df.groupBy(*by).agg(*[F.try_divide(F.sum(_num(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values])


def qa_accuracy(df: DataFrame, predicted: Column, gold: Column, allowed: Column, by: list[str]) -> DataFrame:
    """correct, processed, errors, accuracy: predictions that are not allowed are errors and don't count as processed."""
    d = df.withColumns({"__p": predicted, "__g": gold}).withColumn("__ok", F.coalesce(F.array_contains(allowed, F.col("__p")), F.lit(False)))
    hit = F.col("__ok") & F.coalesce(F.col("__p") == F.col("__g"), F.lit(False))
    out = d.groupBy(*by).agg(F.count_if(hit).alias("correct"), F.count_if("__ok").alias("processed"), F.count_if(~F.col("__ok")).alias("errors"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("processed")), F.lit(0.0)))


def jsonl_accuracy(lines: DataFrame, value: str = "value") -> DataFrame:
    """total, correct, incorrect, malformed, accuracy of JSON lines with input.gold and output.answer. Blank lines don't
    count; lines that aren't JSON are malformed only; lines that lack a key are counted in total and as malformed; two
    nulls are equal."""
    v = F.trim(F.col(value))
    rows = lines.filter(v != "").select(v.alias("v")).withColumn("j", F.try_parse_json("v"))
    has = F.expr("""coalesce(array_contains(json_object_keys(get_json_object(v, '$.input')), 'gold'), false)
                    AND coalesce(array_contains(json_object_keys(get_json_object(v, '$.output')), 'answer'), false)""")
    gold, answer = F.get_json_object("v", "$.input.gold"), F.get_json_object("v", "$.output.answer")
    ok = F.col("j").isNotNull()
    out = rows.agg(F.count_if(ok).alias("total"), F.count_if(ok & has & gold.eqNullSafe(answer)).alias("correct"), F.count_if(~ok | ~has).alias("malformed"))
    return out.select("total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "malformed", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0)).alias("accuracy"))


def quality_issues(records: DataFrame) -> DataFrame:
    """records with issues: what is structurally wrong with each (API error, missing thinking or raw response)."""
    o = F.col("output")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    issues = F.array(
        F.when(F.col("input").isNull(), "missing input"),
        F.when(o.isNull(), "missing output"),
        F.when(o.isNotNull() & ~empty(o["error"]), "api error"),
        F.when(o.isNotNull() & empty(o["thinking"]), "missing thinking"),
        F.when(o.isNotNull() & empty(o["raw_response"]), "missing raw response"),
    )
    return records.withColumn("issues", F.array_compact(issues))


def token_budget(splits: DataFrame, distilled: DataFrame, key: str, count: Column, sft_count: Column) -> DataFrame:
    """One row: tokens of plain tuning, distillation, the alternative plan (easy and mid distilled) and the pipeline
    (hard distilled), and the pipeline's advantage. splits has key and split (easy, mid, hard); a response that is NULL
    has no tokens."""
    sft = splits.groupBy("split").agg(F.sum(F.coalesce(sft_count, F.lit(0))).alias("sft"))
    dis = splits.select(key, "split").join(distilled, key).groupBy("split").agg(F.sum(F.coalesce(count, F.lit(0))).alias("dis"))
    both = sft.join(dis, "split", "full")
    of = lambda c, *names: F.coalesce(F.sum(F.when(F.col("split").isin(*names), F.col(c))), F.lit(0))
    every = ("easy", "mid", "hard")
    out = both.agg(of("sft", *every).alias("sft_tokens"), of("dis", *every).alias("distill_tokens"), (of("dis", "easy", "mid") + of("sft", "hard")).alias("alternative_tokens"), (of("sft", "easy", "mid") + of("dis", "hard")).alias("pipeline_tokens"))
    return out.withColumn("advantage", 1 - F.try_divide(F.col("pipeline_tokens").cast("double"), F.col("distill_tokens")))


def skip_after_zero(scores: DataFrame) -> DataFrame:
    """(dataset, epoch, accuracy) with accuracy 0 and skipped for all epochs after a dataset's first 0."""
    first = F.min(F.when(F.col("accuracy") == 0, F.col("epoch"))).over(Window.partitionBy("dataset"))
    s = scores.withColumn("skipped", F.coalesce(F.col("epoch") > first, F.lit(False)))
    return s.withColumn("accuracy", F.when(F.col("skipped"), 0.0).otherwise(F.col("accuracy")))


def curve_summary(curves: DataFrame) -> DataFrame:
    """name, best, best_epoch (the earliest), final, of (name, epoch, accuracy)."""
    best = F.max(F.struct("accuracy", (-F.col("epoch")).alias("e")))
    return curves.groupBy("name").agg(best.alias("b"), F.max_by("accuracy", "epoch").alias("final")).select("name", F.col("b.accuracy").alias("best"), (-F.col("b.e")).alias("best_epoch"), "final")
