import math

from lodespark.operators import curate, metrics, ml
from pyspark.sql import functions as F


def test_bands(spark):
    rows = [(k, None if k == 3 else float("nan") if k == 4 else float(k % 4), "a" if k % 6 else "0") for k in range(23)]
    df = spark.createDataFrame(rows, "question_id long, h double, ans string")
    got = curate.bands(df, "h", "question_id", 5, "ans").collect()
    known = [r for r in rows if r[2] == "a"]
    order = sorted(known, key=lambda r: (r[1] is None or math.isnan(r[1]), 0.0 if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
    size = len(known) // 5
    assert {r.question_id: r.band for r in got} == {r[0]: i // size for i, r in enumerate(order[: 5 * size])}
    assert curate.bands(df.limit(3), "h", "question_id", 5).count() == 0
    assert curate.bands(df.limit(0), "h", "question_id", 5).count() == 0


def test_split_is_exact(spark):
    df = spark.range(101).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    got = curate.train_test(df, 0.5, "k", ["g"]).groupBy("g").agg(F.count_if(F.col("split") == "train").alias("n"), F.count("*").alias("c")).collect()
    assert all(r.n == round(r.c * 0.5) for r in got)
    a, b = (sorted(r.k for r in curate.train_test(df, 0.5, "k", ["g"]).filter("split = 'train'").collect()) for _ in range(2))
    assert a == b
    f = curate.folds(df, "g", "k", 5).groupBy("g", "fold").count().collect()
    assert max(r["count"] for r in f) - min(r["count"] for r in f) <= 1


def test_ranks_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.n for r in curate.ranked(df, [F.col("k").asc()], "n").collect())
    assert {r.chunk for r in curate.chunks(df, "k", 30).collect()} == set(range(34))


def test_ranks_of_a_large_table_with_payload(spark, tmp_path):
    n = 1_000_000
    spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("p"), F.col("id").alias("v")).repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = curate.ranked(df, [F.col("k").asc()], "r", size="n").agg(F.count_if(F.col("k") == F.col("r")), F.count_distinct("r"), F.max("n"), F.count_if(F.col("p") == F.concat(F.lit("payload "), F.col("v").cast("string")))).first()
    assert tuple(got) == (n, n, n, n)
    b = curate.bands(df.withColumn("s", (F.col("k") / 3).cast("long")), "s", "k", 5).groupBy("band").count().collect()
    assert sorted(tuple(r) for r in b) == [(k, n // 5) for k in range(5)]


def test_quantiles(spark):
    rows = [(g, x) for g in ("a", None) for x in (5.0, 1.0, 2.0, 2.0, None, float("nan"))] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = [(g, *(round(x, 9) for x in q)) for g, *q in curate.quantiles(df, F.col("x"), [0.5, 0.9, 1.0], ["g"]).collect()]
    assert sorted(got, key=str) == sorted([("a", 2.0, 4.1, 5.0), (None, 2.0, 4.1, 5.0)], key=str)
    assert tuple(curate.quantiles(df.limit(0), F.col("x"), [0.5]).first()) == (None,)
    assert tuple(curate.quantiles(df, F.col("x"), [0.0, 0.25]).first()) == (1.0, 1.75)


def test_work_still_to_be_done(spark):
    df = spark.createDataFrame([(1, "a", True, "r", "graduate", 9), (2, " ", False, "", "graduate", 0), (3, None, None, None, "x", 5)], "k int, answer string, ans_correct boolean, response string, masj_complexity string, masj_rating int")
    left = {kind: sorted(r.k for r in curate.unfinished(df, kind).collect()) for kind in curate.RESUME}
    assert left == dict.fromkeys(curate.RESUME, [2, 3])
    ok, skipped = curate.with_formatted(df, F.concat(F.lit("Q: "), "answer"))
    assert sorted(r.k for r in ok.collect()) == [1, 2] and skipped.first().skipped == 1
    assert [r.answer for r in curate.distinct_values(df, "answer").collect()] == [None, " ", "a"]
    assert [r.k for r in curate.head(df, [F.col("k").desc()], 2).collect()] == [3, 2] and curate.answered(df, "answer").count() == 2
    assert [r.lab for r in curate.with_labels(df.withColumnRenamed("k", "question_id"), spark.createDataFrame([(1, "x"), (9, "y")], "question_id int, lab string")).collect()] == ["x"]


def test_joins_and_resume(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "question_id long")
    judge = spark.createDataFrame([(1, "graduate", 9, "low"), (2, "graduate", 8, None), (3, "x", 10, "high")], "question_id long, masj_complexity string, masj_rating int, masj_num_reasoning_steps string")
    assert sorted(tuple(r) for r in curate.join_education_levels(df, judge).collect()) == [(1, 0.6), (3, 0.0)]
    assert sorted(tuple(r) for r in curate.join_reasoning_steps(df, judge).collect()) == [(1, 0.25), (3, 0.75)]
    ids = spark.createDataFrame([(1,), (1,), (9,)], "question_id long")
    assert curate.rows_of(df, ids).count() == 2 and curate.rows_of(df, ids, once=True).count() == 1
    rec = spark.createDataFrame(
        [(("1",), ("A", True, "t", None), 1), (("2",), ("B", False, "u", None), 2), (("2",), ("C", True, "v", "429"), 3), (("3",), ("D", False, "w", "429"), 4), (("4",), ("A", True, "x", None), 5), (("4",), ("B", None, "y", None), 6)],
        "input struct<question_id:string>, output struct<answer:string,is_correct:boolean,thinking:string,error:string>, seq long",
    )
    assert [r.question_id for r in curate.todo(df, rec).collect()] == [3]
    assert [r.question_id for r in curate.todo(df, rec, limit=2).collect()] == []
    assert sorted(tuple(r) for r in curate.review_input(df, rec).collect()) == [(2, "B", "u"), (4, "B", "y")]
    assert sorted((r.input.question_id, r.seq) for r in curate.latest_success(rec, F.col("input.question_id"), F.col("seq")).collect()) == [("1", 1), ("2", 2), ("3", 4), ("4", 6)]
    assert curate.with_defaults(df, {"QUESTION_ID": F.lit(0), "x": F.lit(1)}).columns == ["question_id", "x"]
    assert curate.combined({"a": df, "b": judge}).filter("dataset = 'b'").count() == 3


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_and_report(spark):
    rows = [(k, (k * 7) % 5 % 2, float((k * 13) % 6), ["x", "y", None][k % 3], "rare" if k < 3 else "many") for k in range(60)]
    df = spark.createDataFrame(rows, "k int, y int, s double, c string, d string")
    got = {r.category: r for r in metrics.report(df, "m", ["c", "d"], "y", "s").collect()}
    assert got.keys() == {"ALL", "x", "y", "many"}
    for name, keep in (("ALL", lambda r: True), ("x", lambda r: r[3] == "x"), ("many", lambda r: r[4] == "many")):
        part = [r for r in rows if keep(r)]
        auc = brute_auc([(r[1], -r[2]) for r in part])
        assert abs(got[name].roc_auc - auc) < 1e-12 and abs(got[name].gini - abs(2 * auc - 1)) < 1e-12
        assert got[name].num_samples == len(part) and abs(got[name].accuracy - sum(r[1] for r in part) / len(part)) < 1e-12
    a = metrics.auc_by(df, ["c"], "y", "s").collect()
    b = {r.c: r.auc for r in metrics.auc_by(df.withColumn("s", -F.col("s")), ["c"], "y", "s").collect()}
    assert all(abs(r.auc + b[r.c] - 1) < 1e-12 for r in a)
    one = metrics.report(df.withColumn("y", F.lit(1)), "m", [], "y", "s").first()
    assert one.roc_auc is None and one.accuracy == 1
    nan = df.withColumn("t", F.when(F.col("k") % 2 == 0, float("nan")).otherwise(F.col("s"))).withColumn("few", F.when(F.col("k") < 5, F.col("s")))
    m = {r.metric: r for r in metrics.metric_table(nan, ["s", "t", "few"], "y").collect()}
    assert m.keys() == {"s", "t"} and m["t"].n_valid == 30 and m["s"].n_valid == 60


def test_histogram_and_bins(spark):
    df = spark.createDataFrame([(float(x), int(x > 4)) for x in range(9)] + [(None, 1)], "x double, y int")
    h = metrics.histogram(df, "x", "y", 4).collect()
    assert sum(r.n for r in h) == 9 and max(r.bin for r in h) == 4
    assert all(abs(sum(r.share for r in h if r.bin == b) - 1) < 1e-12 for b in {r.bin for r in h})
    assert metrics.auto_bins(df, "x") == 5 and metrics.auto_bins(df.filter("x = 1"), "x") == 1
    assert [r.bin for r in metrics.histogram(df.filter("x = 1"), "x", "y", 4).collect()] == [1]


def test_reports(spark):
    lines = ["", '{"input": {"gold": "A"}, "output": {"answer": "A"}}', '{"input": {"gold": "A"}, "output": {"answer": "B"}}', "{bad", '{"input": {}, "output": {}}', '{"input": {"gold": null}, "output": {"answer": null}}', '{"input": {"gold": "A"}, "output": {"answer": null}}']
    r = metrics.jsonl_accuracy(spark.createDataFrame([(x,) for x in lines], "value string")).first()
    assert tuple(r) == (5, 2, 3, 2, 0.4)
    s = spark.createDataFrame([("d", 0, 0.5), ("d", 1, 0.0), ("d", 2, 0.7), ("e", 0, 0.1)], "dataset string, epoch int, accuracy double")
    assert sorted(tuple(x) for x in metrics.skip_after_zero(s).collect()) == [("d", 0, 0.5, False), ("d", 1, 0.0, False), ("d", 2, 0.0, True), ("e", 0, 0.1, False)]
    c = metrics.curve_summary(s.withColumnRenamed("dataset", "name")).orderBy("name").collect()
    assert [tuple(x) for x in c] == [("d", 0.7, 2, 0.7), ("e", 0.1, 0, 0.1)]
    rec = spark.createDataFrame([(("g",), ("t", "r", None)), (("g",), ("", None, "429")), (None, None)], "input struct<gold:string>, output struct<thinking:string,raw_response:string,error:string>")
    assert [r.issues for r in metrics.quality_issues(rec).collect()] == [[], ["api error", "missing thinking", "missing raw response"], ["missing input", "missing output"]]
    n = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, s double")
    assert [r.z for r in metrics.normalised(n, "s", "z", 0.0).orderBy("k").collect()] == [0.5, 0.0]
    assert [r.z for r in metrics.normalised(n, "s", "z", 8.0).orderBy("k").collect()] == [0.75, 0.5]


def test_token_budget(spark):
    splits = spark.createDataFrame([(1, "easy"), (2, "mid"), (3, "hard"), (4, "hard")], "k int, split string")
    dis = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b c d")], "k int, r string")
    r = metrics.token_budget(splits, dis, "k", F.when(F.col("r").isNotNull(), F.size(F.split("r", " "))), F.lit(1)).first()
    assert (r.sft_tokens, r.distill_tokens, r.alternative_tokens, r.pipeline_tokens) == (4, 6, 4, 6) and r.advantage == 0


def test_models(spark):
    df = spark.range(120).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 10 != 3, F.col("id") % 2 + F.col("id") % 3 / 4).alias("x"))
    r = ml.fold_auc(df, {"lr": ml.logistic(["x"])}, "k").first()
    assert r.n == 120 and r.auc > 0.8


def test_all_models_share_folds(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    dealt, whole = [], ml.folds
    monkeypatch.setattr(ml, "folds", lambda *a: dealt.append(a) or whole(*a))
    got = ml.fold_auc(df, {"a": ml.logistic(["x"]), "b": ml.logistic(["x"])}, "k", k=2).collect()
    assert len(dealt) == 1 and len({(r.auc, r.n) for r in got}) == 1 and len(got) == 2
