import os
import sys

import pytest
from lodespark.plans import pipelines
from lodespark.sources import remote, tables
from lodespark.streaming import resume
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])
QUESTIONS = [(1, "Q1?", ["x", "y"], "s", "A", 0), (2, " ", ["x", "y"], "s", "", 1), (3, "Q3?", ["x"], None, "", 0), (4, "Q4?", ["x", "y", "z"], None, "", 1), (5, "Q5?", ["x", "y"], "s", "Z", 7)]
SCHEMA = "question_id long, question string, options array<string>, subject string, answer string, answer_index int"


def test_tsv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi"\tthere', 0.5, True), (2, "two\nlines", None, False), (3, "NA", 1.0, None), (4, None, 2.0, True)]
    df = spark.createDataFrame(rows, "question_id long, q string, h double, ok boolean")
    tables.write_tsv(df, f"{tmp_path}/t.tsv")
    got = tables.read_tsv(spark, f"{tmp_path}/t.tsv", df.schema).orderBy("question_id").collect()
    assert [tuple(r) for r in got] == [(1, 'say "hi"\tthere', 0.5, True), (2, "two\nlines", None, False), (3, None, 1.0, None), (4, None, 2.0, True)]
    raw = tables.read_strings(spark, f"{tmp_path}/t.tsv", ["question_id", "q", "h", "missing"]).orderBy("question_id").collect()
    assert [r.q for r in raw][2:] == ["NA", ""] and raw[0].missing == ""
    with open(f"{tmp_path}/bare.tsv", "w") as f:
        f.write('id\ts\n1.0\ta "b\\\tc\n')
    assert tuple(tables.read_tsv(spark, f"{tmp_path}/bare.tsv", "id long, s string", quoted=False).first())[0] == 1


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    with open(f"{tmp_path}/x.jsonl", "w") as f:
        f.write('{"k": 1, "s": "a"}\n{"k": 2, "s": "b"}\n')
    tables.convert_jsonl(spark, f"{tmp_path}/x.jsonl", f"{tmp_path}/x", "k long, s string")
    assert tables.read_table(spark, f"{tmp_path}/x").count() == tables.read_table(spark, f"{tmp_path}/x.jsonl", "k long, s string").count() == 2
    tables.append_parquet(df, f"{tmp_path}/x")
    assert tables.read_parquet(spark, f"{tmp_path}/x", ["k"]).count() == 4
    tables.write_parquet(df, f"{tmp_path}/gz", "gzip")
    assert any(n.endswith(".gz.parquet") for n in os.listdir(f"{tmp_path}/gz"))
    for i in range(2):
        for part in ("train", "test"):
            with open(f"{tmp_path}/group{i}_{part}.tsv", "w") as f:
                f.write(f"k\ts\n{i}\t{part}\n" if i else f"s\tother\tk\n{part}\tz\t{i}\n")
    got = tables.read_bands(spark, str(tmp_path), "k long, s string").collect()
    assert sorted((r.k, r.s, r.band, r.split) for r in got) == [(i, p, i, p) for i in range(2) for p in ("test", "train")]
    names = spark.createDataFrame([("checkpoint-99",), ("checkpoint-120",)], "name string")
    assert tables.last_checkpoint(names).first().name == "checkpoint-120" and tables.last_checkpoint(names, False).first().name == "checkpoint-99"


def flaky():
    def model(row):
        if row["question_id"] == 4:
            raise ValueError("down")
        return {"response": "Because. [[a]]", "thinking": "t"}

    return model


def test_distil_and_synthesis(spark):
    df = spark.createDataFrame(QUESTIONS, SCHEMA)
    got = {r.question_id: r for r in pipelines.distil(df, flaky).collect()}
    assert got[1].distill_ans_correct and got[1].distill_answer == "a" and not got[2].distill_ans_correct
    assert got[4].distill_response is None and "down" in got[4].error and got[4].distill_ans_correct is False
    a = pipelines.synthesise(df, flaky, "A", "m").cache()
    rec = {r.input.question_id: r for r in a.collect()}
    assert rec.keys() == {"1", "4"}  # the others have one option, no text or no gold letter
    assert rec["1"].output.is_correct and rec["1"].input.options == {"A": "x", "B": "y"} and rec["4"].output.error
    again = pipelines.synthesise(df, flaky, "A", "m", done=a)
    assert [r.input.question_id for r in again.collect()] == ["4"]
    assert pipelines.synthesise(df, flaky, "B", "m").count() == 2
    c = pipelines.synthesise(df.withColumn("previous_answer", F.lit("B")).withColumn("previous_thinking", F.lit("hm")), flaky, "C", "m").collect()
    assert all(r.output.previous_answer == "B" and r.input.model_answer_from_A == "B" for r in c)


def test_estimates(spark):
    df = spark.createDataFrame(QUESTIONS, SCHEMA)
    one = pipelines.estimate(df, remote.offline_model()).collect()
    two = pipelines.estimate(df.repartition(3), remote.offline_model()).collect()
    assert sorted(one) == sorted(two) and all(r.entropy_value > 0 and r.valid for r in one)

    def cot():
        return lambda row: {"tokens": ["so", " [[", "b", "]]"], "token_logits": [[0.0, 0.0]] * 4}

    r = pipelines.estimate_cot(df, cot).first()
    assert (r.ans_token_index, r.answer, round(r.entropy_value, 6)) == (2, "b", 0.693147)

    def probs():
        return lambda row: {"field_logprobs": [{"token": "a", "logprob": -0.1}, {"token": "b", "logprob": -3.0}]}

    r = pipelines.distil_logprobs(df, probs).orderBy("question_id").first()
    assert r.distill_answer == "a" and r.distill_ans_correct and abs(r.distill_answer_prob - 0.904837) < 1e-6
    r = pipelines.estimate_cross_entropy(df, lambda: lambda row: {"logits": [0.0, 0.0]}, "m", F.lit(0)).first()
    assert round(r.cross_entropy_value_m, 6) == 0.693147 and r.cross_entropy_token_m == 0


def test_judge(spark):
    df = spark.createDataFrame(QUESTIONS, SCHEMA)

    def level():
        return lambda row: {"response": "[[graduate]]" if row["question_id"] != 2 else "?"}

    got = {r.question_id: (r.masj_complexity, r.masj_rating) for r in pipelines.judge(df, level, lambda: lambda row: {"response": "[[9]]"}).collect()}
    assert got[1] == ("graduate", 9) and got[2] == (None, 0) and len(got) == 5


def test_retries():
    calls = []

    def call(client, row):
        calls.append(client)
        if len(calls) < 3:
            raise remote.RateLimited
        return row

    assert remote.with_retries(call, ["a", "b"], (0.0, 0.0))("x") == "x" and calls == ["a", "b", "a"]
    calls.clear()
    with pytest.raises(remote.RateLimited):
        remote.with_retries(call, ["a"], (0.0,))("x")


def test_resume(spark, tmp_path):
    df = spark.createDataFrame([(k, "q") for k in range(6)], "k long, q string")
    broken = {"on": True}

    def work(d):
        bad = F.col("k") == 3 if broken["on"] else F.lit(False)
        return d.withColumn("error", F.when(bad, "429"))

    at = f"{tmp_path}/out"
    assert resume.resume_batch(spark, df, at, work, "k") == 6
    broken["on"] = False
    assert resume.resume_batch(spark, df, at, work, "k") == 1
    assert resume.resume_batch(spark, df, at, work, "k") == 0
    assert spark.read.parquet(at).filter("error IS NULL").count() == 6


def test_resume_stream(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    go = lambda: resume.resume_stream(spark, src, "id long", out, ck, lambda d: d.withColumn("y", F.col("id") * 2))
    go()
    go()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    go()
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [2 * k for k in range(8)]


def test_plans(spark):
    bands = spark.createDataFrame([(0,), (1,)], "band int")
    assert sorted(tuple(r) for r in pipelines.evaluation_plan(bands).collect())[1] == ("group0_train", "group1_test", 0)
    assert pipelines.curriculum(["easy", "hard"])[1]["init_from"] == "easy"
    assert pipelines.accumulation_steps(256, 16) == 16
    with pytest.raises(ValueError):
        pipelines.accumulation_steps(10, 3)


def test_reasoning(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        n = int(rng.integers(0, 14))
        toks = [str(x) for x in rng.choice(["a", "b", "<s>"], n)]
        rows.append((k, toks, rng.random(n).round(2).tolist(), (rng.random(n) - 0.3).tolist(), "[[a]]" if k % 8 else "none", "[[ B]]", k % 9 != 0, [True, False, None][k % 3 if k % 5 else 2], 1, None if k == 11 else n))
    df = spark.createDataFrame(rows, "k int, tokens array<string>, entropies array<double>, attn_importance array<double>, decoded_pred string, decoded_label string, is_cot_eval boolean, is_correct boolean, input_len int, seq_len int")
    keep = {r[0]: r for r in rows if r[4] != "none" and r[6] and r[7] is not None and r[9] is not None and r[9] > r[8]}
    got = {r.k: r for r in pipelines.reasoning_metrics(df, ["<s>"], keep=["k"]).collect()}
    assert got.keys() == keep.keys() and len(keep) > 5
    h = {k: np.array([e for t, e in zip(r[1][1:], r[2][1:], strict=True) if t != "<s>"]) for k, r in keep.items()}
    w = {k: np.array([e for t, e in zip(r[1][1:], r[3][1:], strict=True) if t != "<s>"]).clip(0) for k, r in keep.items()}
    thr = np.percentile(np.concatenate(list(h.values())), 75)
    near = lambda a, b: a is None if b is None else abs(a - b) < 1e-9
    for k, r in got.items():
        n = len(h[k])
        assert near(r.unc_mean_ans, h[k].mean() if n else None) and near(r.unc_median_ans, float(np.median(h[k])) if n else None)
        assert near(r.unc_tail3_max, h[k][-3:].max() if n >= 3 else None) and near(r.unc_frac_high_ans, (h[k] > thr).mean() if n else None)
        mass = w[k].sum()
        assert near(r.unc_attn_mean_ans, None if not n else h[k].mean() if mass <= 1e-12 else float(h[k] @ w[k] / mass))
        assert near(r.unc_frac_attn_high, None if not n or mass <= 1e-12 else w[k][h[k] > thr].sum() / mass) and r.y == int(not keep[k][7])
    t = pipelines.reasoning_table(df, ["<s>"]).collect()
    assert [r.auc for r in t] == sorted((r.auc for r in t), reverse=True) and all(r.n_valid >= 10 for r in t)
    assert pipelines.lengths_agree(df).first().ok and not pipelines.lengths_agree(df.withColumn("tokens", F.lit(None).cast("array<string>"))).first().ok
    assert pipelines.invalid_answers(df.withColumn("a", F.lit("A")), "a").first().invalid == 40
    ck = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "name string, epoch int")
    ex = spark.createDataFrame([("x", 3), ("y", 3), ("z", 3)], "name string, epochs int")
    assert {r.name: r.done for r in pipelines.trained(ck, ex).collect()} == {"x": True, "y": False, "z": False}


def test_combined_union_counts_every_language(spark, tmp_path):
    from lodespark.plans import registry

    docs = [(1, "en", 5), (2, "it", 7), (3, None, 11), (4, "it", None), (5, "labels", 2)]
    spark.createDataFrame(docs, "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.dataset, r.n, r.chars) for r in registry.QUERIES["combined_union"](spark, str(tmp_path)).collect()}
    assert got == {("en", 1, 5), ("it", 2, 7), (None, 1, 11), ("labels", 2, 2)}
