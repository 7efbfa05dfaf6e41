"""Whole pipelines: score, distil, synthesise, judge, analyse, and plan training and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import answers, logits, prompts, tokens
from lodespark.operators import curate, metrics
from lodespark.sources.remote import call_model
from lodespark.sources.shared import cut

Model = Callable[[], Callable[[dict], dict]]


def estimate(df: DataFrame, model: Model, kind: str = "plain", extra: dict[str, Column] | None = None, subject: Column | None = None, question: Column | None = None, options: Column | None = None, correct: Column | None = None) -> DataFrame:
    """Single-token entropy: question_id, response, answer, entropy_value, greedy_token, valid, correct, error. Columns
    of the question may be given as expressions, as may the correctness rule and extra columns."""
    subject, question, options = (c if c is not None else F.col(n) for c, n in ((subject, "subject"), (question, "question"), (options, "options")))
    p = F.concat(prompts.system_prompt(subject, kind), F.lit("\n"), prompts.user_prompt(question, options))
    out = call_model(df.withColumn("prompt", p), model, "logits array<double>, response string, thinking string")
    out = out.withColumn("answer_found", answers.marker_text(F.col("response")))
    ok = correct if correct is not None else answers.answer_correct(F.col("answer_index"), F.col("answer_found"))
    out = out.select("question_id", "response", F.col("answer_found").alias("answer"), F.round(logits.entropy(F.col("logits")), 6).alias("entropy_value"), logits.argmax(F.col("logits")).alias("greedy_token"), answers.is_valid_answer(F.col("answer_found")).alias("valid"), ok.alias("correct"), "error", *[c.alias(n) for n, c in (extra or {}).items()])
    return out


def estimate_cot(df: DataFrame, model: Model) -> DataFrame:
    """df with, of the model's tokens and their logits: entropies, ans_token_index, the answer token, and its entropy."""
    out = call_model(df, model, "tokens array<string>, token_logits array<array<double>>")
    out = out.withColumn("entropies", F.transform("token_logits", logits.entropy)).withColumn("ans_token_index", tokens.marker_token(F.col("tokens")))
    at = F.when(F.col("ans_token_index") >= 0, F.col("ans_token_index"))
    return out.withColumn("answer", F.get("tokens", at)).withColumn("entropy_value", F.get("entropies", at)).drop("token_logits")


def estimate_cross_entropy(df: DataFrame, model: Model, name: str, correct_token: Column) -> DataFrame:
    """df with cross_entropy_value_{name} and cross_entropy_token_{name} of the model's last-position logits."""
    out = call_model(df, model, "logits array<double>")
    return out.withColumn(f"cross_entropy_value_{name}", logits.cross_entropy(F.col("logits"), correct_token)).withColumn(f"cross_entropy_token_{name}", logits.argmax(F.col("logits"))).drop("logits")


def distil_logprobs(df: DataFrame, model: Model) -> DataFrame:
    """df with distill_answer (the likeliest token), its probability, the truncated entropy and correctness; all NULL
    where that token is no valid answer, but for field_logprobs."""
    out = call_model(df, model, "field_logprobs array<struct<token:string,logprob:double>>")
    lp = F.transform("field_logprobs", lambda x: x["logprob"])
    best = F.get("field_logprobs", logits.argmax(lp))
    valid = lambda c: F.when(answers.is_valid_answer(best["token"]), c)
    found = {"distill_answer": best["token"], "distill_answer_prob": F.exp(best["logprob"]), "distill_entropy": logits.truncated_entropy(lp), "distill_ans_correct": answers.answer_correct(F.col("answer_index"), best["token"])}
    return out.withColumns({k: valid(c) for k, c in found.items()})


def distil(df: DataFrame, model: Model, correct: Column | None = None) -> DataFrame:
    """df with distill_response, distill_answer (in markers) and distill_ans_correct; a failed call leaves NULLs."""
    p = F.concat(prompts.system_prompt(F.col("subject"), "cot"), F.lit("\n"), prompts.user_prompt(F.col("question"), F.col("options")))
    out = call_model(df.withColumn("prompt", p), model, "response string").drop("prompt")
    out = out.withColumnRenamed("response", "distill_response").withColumn("distill_answer", answers.marker_text(F.col("distill_response")))
    return out.withColumn("distill_ans_correct", correct if correct is not None else answers.answer_correct(F.col("answer_index"), F.col("distill_answer")))


def synthesise(df: DataFrame, model: Model, branch: str, name: str, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Records (input, output) of branch A (answer), B (explain the right answer) or C (review a wrong answer; df has
    previous_answer and previous_thinking). Questions need two options, text and a gold letter; those done are skipped."""
    if done is not None or limit is not None:
        df = curate.todo(df, done if done is not None else df.limit(0), limit=limit)
    ls = answers.letters_for(F.size("options"))
    df = df.withColumn("gold", answers.gold_letter(F.col("answer"), F.col("answer_index"), ls))
    df = df.filter((F.size("options") >= 2) & (answers.strip(F.col("question")) != "") & (F.col("gold") != ""))
    q, o, s = F.col("question"), F.col("options"), F.col("subject")
    if branch == "A":
        p = F.concat(prompts.system_prompt(s), F.lit("\n"), prompts.user_prompt(q, o, True))
    elif branch == "B":
        p = prompts.explain_prompt(q, o, F.col("gold"))
    else:
        p = prompts.chatml(prompts.review_chat(s, q, o, F.coalesce(F.col("previous_thinking"), F.col("previous_answer"), F.lit("")), F.col("gold")))
    out = call_model(df.withColumn("prompt", p), model, "response string, thinking string")
    n = F.size("options")
    letter = F.coalesce(answers.marker_last_letter(F.col("response"), answers.letters_for(n)), answers.letter_in_text(F.col("response"), n))
    fields = [F.col("question_id").cast("string").alias("question_id"), s.alias("subject"), q.alias("question"), F.map_from_arrays(answers.letters_for(n), F.slice("options", 1, 26)).alias("options"), F.col("gold"), F.lit(name).alias("model"), F.lit(branch).alias("branch")]
    if branch == "C":
        fields.append(F.col("previous_answer").alias("model_answer_from_A"))
    failed = F.col("error").isNotNull()
    previous = F.col("previous_answer") if branch == "C" else F.lit(None).cast("string")
    result = F.struct(F.when(~failed, letter).alias("answer"), F.when(~failed & F.lit(branch == "A"), letter == F.col("gold")).alias("is_correct"), "thinking", F.col("response").alias("raw_response"), F.col("gold"), previous.alias("previous_answer"), "error")
    return out.select(F.struct(*fields).alias("input"), result.alias("output"))


def judge(df: DataFrame, level_model: Model, rating_model: Model) -> DataFrame:
    """df with masj_complexity and masj_rating; questions whose level can't be read aren't rated (rating 0)."""
    one = call_model(df.withColumn("prompt", prompts.level_prompt(F.col("question"))), level_model, "response string")
    one = one.withColumn("masj_complexity", answers.judge_level(F.col("response"))).drop("response", "error", "prompt")
    one = cut(one)  # the model isn't called again for the second question, nor if an executor is lost
    two = call_model(one.filter("masj_complexity IS NOT NULL").withColumn("prompt", prompts.rating_prompt(F.col("question"), F.col("masj_complexity"))), rating_model, "response string")
    two = two.withColumn("masj_rating", F.coalesce(answers.judge_rating(F.col("response")), F.lit(0))).drop("response", "error", "prompt")
    return two.unionByName(one.filter("masj_complexity IS NULL").withColumn("masj_rating", F.lit(0)))


def _part(df: DataFrame, part: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), key.alias("key"), value.cast("double").alias("value"))


def _counts(df: DataFrame, part: str, col: str) -> DataFrame:
    c = metrics.value_counts(df, col)
    return _part(c, part, F.coalesce(F.col(col).cast("string"), F.lit("NULL")), F.col("n"))


def _judged_report(known: DataFrame, judged: DataFrame, model: str, correct: str, score: str, category: str, bins: tuple[int, int, int]) -> DataFrame:
    """Histograms by outcome and ROC-AUC of the score and of both judge labels, over rows that both tables judge."""
    d = curate.join_education_levels(known, judged, level="__level")
    d = cut(curate.join_reasoning_steps(d, judged, level="__steps"))
    out = None
    for x, n in zip((score, "masj_complexity", "masj_num_reasoning_steps"), bins, strict=True):
        h = metrics.histogram(d, x, correct, n)
        one = _part(h, f"histogram {x}", F.concat_ws("/", F.col("bin").cast("string"), F.col(correct).cast("int").cast("string")), F.col("n"))
        r = metrics.report(d, model, [category, "__level", "__steps"] if x == score else [], correct, x)
        one = one.unionByName(_part(r, f"auc {x}", F.col("category"), F.round("roc_auc", 6)))
        out = one if out is None else out.unionByName(one)
    return out


def standard_analysis(df: DataFrame, judged: DataFrame, model: str, answer: str, correct: str, score: str, category: str = "category", bins: int = 10) -> DataFrame:
    """One long table (part, key, value): answers counted before and after the filter, the histogram of unknown answers'
    scores, and, over rows with a known answer that both judge tables have, histograms by outcome of the score and both
    labels and their ROC-AUC: the score's by category, level and steps, the labels' over all rows."""
    unknown = curate.unknown_answers(df, answer).withColumn("__all", F.lit(1))
    known = curate.keep_valid_and_known(df, answer)
    out = _counts(df, "answers before", answer).unionByName(_counts(known, "answers after", answer))
    h = metrics.histogram(unknown, score, "__all", bins)
    out = out.unionByName(_part(h, "histogram unknown", F.col("bin").cast("string"), F.col("n")))
    return out.unionByName(_judged_report(known, judged, model, correct, score, category, (bins, len(answers.LEVELS), 3)))


def cot_analysis(df: DataFrame, judged: DataFrame, model: str, correct: str, letter: Callable[[Column], Column], category: str = "category", bins: int = 10) -> DataFrame:
    """The same table for chains of thought: rows with an answer token (ans_token_index <> -1), whose answer is the
    likeliest token there, spelt by letter, and whose score is the entropy there; JSON is decoded in the plan."""
    at = F.col("ans_token_index")
    d = df.filter(at != -1)
    d = d.withColumn("model_answer", letter(logits.token_at(F.col("every_token_info"), at))).withColumn("model_answer_entropy", logits.entropy_at(F.col("entropies"), at))
    known = curate.keep_valid_and_known(d, "model_answer")
    out = _counts(df, "answer tokens", "ans_token_index").unionByName(_counts(d, "answers before", "model_answer")).unionByName(_counts(known, "answers after", "model_answer"))
    return out.unionByName(_judged_report(known, judged, model, correct, "model_answer_entropy", category, (bins, bins, bins)))


def evaluation_plan(bands: DataFrame) -> DataFrame:
    """train, test, stage: each band's training split with every band's test split."""
    name = lambda c, part: F.concat(F.lit("group"), c.cast("string"), F.lit(f"_{part}"))
    tests = bands.select(name(F.col("band"), "test").alias("test"))
    return bands.select(name(F.col("band"), "train").alias("train"), F.col("band").alias("stage")).crossJoin(tests).select("train", "test", "stage")


def curriculum(stages: list[str]) -> list[dict]:
    """Ordered stages; each starts from the checkpoint of the one before it."""
    return [{"stage": i, "data": s, "init_from": stages[i - 1] if i else None} for i, s in enumerate(stages)]


def accumulation_steps(global_batch: int, per_device: int) -> int:
    """How many steps make up the global batch; it must be a multiple."""
    if per_device <= 0 or global_batch % per_device:
        raise ValueError("the global batch must be a multiple of the batch of a device")
    return global_batch // per_device


def clean_token_rows(df: DataFrame) -> DataFrame:
    """Evaluated rows with an answer: is_cot_eval true, is_correct not NULL, pred letter found, lengths known and
    seq_len over input_len."""
    d = df.withColumn("pred", answers.marker_first_letter(F.col("decoded_pred"))).withColumn("label", answers.marker_first_letter(F.col("decoded_label")))
    lens = F.col("input_len").isNotNull() & F.col("seq_len").isNotNull() & (F.col("seq_len") > F.col("input_len"))
    return d.filter(F.coalesce(F.col("is_cot_eval"), F.lit(False)) & F.col("pred").isNotNull() & F.col("is_correct").isNotNull() & lens)


def lengths_agree(df: DataFrame) -> DataFrame:
    """One row: do the three parallel arrays of every row have equal lengths?"""
    same = (F.size("tokens") == F.size("entropies")) & (F.size("tokens") == F.size("attn_importance"))
    return df.agg(F.coalesce(F.bool_and(F.coalesce(same, F.lit(False))), F.lit(True)).alias("ok"))


TAILS = (1, 2, 3, 5, 10)


def reasoning_metrics(df: DataFrame, special: list[str], percentile: float = 0.75, keep: list[str] | None = None) -> DataFrame:
    """keep, y (1 for an incorrect row) and the uncertainty metrics of the answer tokens that aren't special: mean,
    median, max; mean, max, median of the last k; attention-weighted mean, values at the five greatest weights, and the
    shares of tokens and of attention over the global percentile of their entropies."""
    d = clean_token_rows(df)
    room = F.least(F.size("tokens"), F.size("entropies"), F.size("attn_importance"))
    cut = lambda c: tokens.answer_slice(F.col(c), F.col("input_len"), F.col("seq_len"), room)
    d = d.withColumn("__kept", tokens.without_special(cut("tokens"), cut("entropies"), cut("attn_importance"), F.array(*[F.lit(s) for s in special]).cast("array<string>")))
    d = d.select(*(keep or []), (~F.col("is_correct")).cast("int").alias("y"), F.col("__kept.h").alias("h"), F.col("__kept.w").alias("w"))
    x = d.select(F.explode("h").alias("x"))
    thr = curate.quantiles(x, F.col("x"), [percentile]).withColumnRenamed("q0", "thr")
    d = d.crossJoin(F.broadcast(thr))  # one row
    h, w = F.col("h"), F.col("w")
    top = tokens.top_by_weight(h, w, 5)
    out = {"unc_mean_ans": tokens.mean(h), "unc_median_ans": tokens.median(h), "unc_max_ans": F.array_max(h)}
    for k in TAILS:
        t = tokens.tail(h, k)
        out |= {f"unc_tail{k}_mean": tokens.mean(t), f"unc_tail{k}_max": F.array_max(t), f"unc_tail{k}_median": tokens.median(t)}
    out |= {"unc_attn_mean_ans": tokens.weighted_mean(h, w), "unc_attn_top5_mean": tokens.mean(top), "unc_attn_top5_max": F.array_max(top), "unc_frac_high_ans": tokens.share_over(h, F.col("thr")), "unc_frac_attn_high": tokens.weight_share_over(h, w, F.col("thr"))}
    return d.select(*(keep or []), "y", *[c.alias(n) for n, c in out.items()])


def reasoning_table(df: DataFrame, special: list[str], digits: int | None = None) -> DataFrame:
    """The AUC of each metric, rounded to digits if given, for telling incorrect rows from correct ones, the best first."""
    m = reasoning_metrics(df, special)
    if digits is not None:
        m = m.select("y", *[F.round(c, digits).alias(c) for c in m.columns if c != "y"])
    return metrics.metric_table(m, [c for c in m.columns if c != "y"], "y").orderBy(F.desc("auc"), "metric")


def invalid_answers(df: DataFrame, col: str) -> DataFrame:
    """One row: how many answers are not valid."""
    return df.agg(F.count_if(~answers.is_valid_answer(F.col(col))).alias("invalid"))


def trained(checkpoints: DataFrame, expected: DataFrame) -> DataFrame:
    """name, done: does the last checkpoint (name, epoch) of each expected training (name, epochs) have its last epoch?"""
    last = checkpoints.groupBy("name").agg(F.max("epoch").alias("last"))
    return expected.join(last, "name", "left").select("name", F.coalesce(F.col("last") == F.col("epochs"), F.lit(False)).alias("done"))
