import math

import pytest
from lodespark.functions import answers as a
from lodespark.functions import logits as l
from lodespark.functions import prompts as p
from lodespark.functions import tokens as t
from pyspark.sql import functions as F


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_answer_predicates(spark):
    xs = ["a", "A", " a", "0", "", "10", "z", None, "a\n"]
    assert col(spark, xs, a.is_valid_answer) == [True, False, False, True, False, False, True, False, False]
    assert col(spark, xs, a.is_known_answer) == [True, False, False, False, False, False, True, False, False]
    assert col(spark, xs, a.is_unknown_answer) == [x == "0" for x in xs]


def test_correctness(spark):
    rows = [("0", "a"), ("1", " b\n"), ("25", "z"), ("26", "a"), ("-1", "z"), ("-27", "z"), ("x", "a"), (None, "a"), ("2", None), ("0", "A")]
    df = spark.createDataFrame(rows, "i string, x string")
    assert [r.y for r in df.select(a.answer_correct(F.col("i"), F.col("x")).alias("y")).collect()] == [True, True, True, False, True, False, False, False, False, False]
    df = spark.createDataFrame([("B ", "b"), (None, "b"), ("c", "b")], "x string, g string")
    assert [r.y for r in df.select(a.answer_equals(F.col("x"), F.col("g")).alias("y")).collect()] == [True, False, False]


def test_markers(spark):
    xs = ["x [[a]] y [[ C ]]", "]] [[a", "[[ 7 ]] and [[12]] [[d", "none", "[[]]", None, "[[b\nc]]"]
    assert col(spark, xs, a.marker_text) == ["a", "", " 7 ", "", "", "", "b\nc"]
    assert col(spark, xs, a.marker_last_letter) == ["C", None, None, None, None, None, "B"]
    assert col(spark, xs, a.marker_last_number) == [None, None, 12, None, None, None, None]
    assert col(spark, xs, a.marker_first_letter) == ["a", None, None, None, None, None, "b"]
    assert col(spark, ["[[graduate]]", "[[other]]", "x", None], a.judge_level) == ["graduate", None, None, None]
    assert col(spark, ["[[10]]", "[[0]]", "[[11]]", "[[x]]", None, "[[99999999999]]"], a.judge_rating) == [10, None, None, None, None, None]


def test_letters(spark):
    of4 = lambda c: a.letter_of(c, a.letters_for(F.lit(4)))
    assert col(spark, ["b", " D ", "0", "3", "4", "5", "x", "", None, "99999999999"], of4) == ["B", "D", "A", "D", "D", "", "", "", "", ""]
    assert col(spark, [-3, 0, 2, 30], lambda c: F.size(a.letters_for(c)), "int") == [0, 0, 2, 26]
    in4 = lambda c: a.letter_in_text(c, F.lit(4))
    assert col(spark, ["The b", "```json\nzz c```", "no 2", "no 123", "!!", None, "9"], in4) == ["B", "C", "C", "", "", "", ""]
    assert col(spark, ["4", "x 3"], in4) == ["D", "D"]
    assert col(spark, ["['a', \"b'c\", 3]", "oops", None, "[]"], a.parse_options) == [["a", "b'c", "3"], [], [], []]
    gold = lambda c: a.gold_letter(c, F.lit(2), a.letters_for(F.lit(3)))
    assert col(spark, ["b", "", None], gold) == ["B", "C", "C"]


def test_encodings(spark):
    assert col(spark, ["high_school_and_easier", "postgraduate", "x", None], a.level_score) == [0.2, 0.8, 0.0, 0.0]
    assert col(spark, ["low", "medium", "high", None], a.steps_score) == [0.25, 0.5, 0.75, 0.0]
    assert col(spark, ["Org/Model:v1.5-X"], a.slug) == ["org_model_v1_5_x"]
    assert col(spark, ["", " s ", None], lambda c: a.first_subject(c, F.lit("z"))) == ["z", "s", "z"]


def test_prompts(spark):
    o = F.array(F.lit("one"), F.lit(""), F.lit(None).cast("string"))
    r = spark.range(1).select(p.option_lines(o).alias("o"), p.system_prompt(F.lit(None).cast("string")).alias("s"), p.chatml(p.chat(F.lit("S"), F.lit("U"))).alias("c"), p.review_chat(F.lit("x"), F.lit("q"), o, F.lit("w"), F.lit("A")).alias("m"), p.option_lines(F.array_repeat(F.lit("v"), 40)).alias("many")).first()
    assert r.o == "a. one\nb.\nc." and r.s == p.SYSTEM["plain"]
    assert r.c == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    assert [m.role for m in r.m] == ["system", "user", "assistant", "user"] and len(r.many.split("\n")) == 26


def test_logits(spark):
    xs = [[1.0, 2.0, 3.0], [5.0], [0.0, 0.0], [], [1000.0, 0.0]]
    got = col(spark, xs, l.entropy, "array<double>")
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    for v, h in zip(xs, got, strict=True):
        assert h is None if not v else abs(h + sum(q * math.log(q + 1e-12) for q in soft(v))) < 1e-9
        assert h is None or -1e-9 <= h <= math.log(len(v)) + 1e-9
    assert col(spark, xs[:3], l.argmax, "array<double>") == [2, 0, 0]
    ce = col(spark, xs[:3], lambda c: l.cross_entropy(c, F.lit(0)), "array<double>")
    assert [round(v, 9) for v in ce] == [round(-math.log(soft(v)[0]), 9) for v in xs[:3]]
    assert col(spark, xs[:1], lambda c: l.cross_entropy(c, F.lit(9)), "array<double>") == [None]
    assert [[x.token_idx for x in v] for v in col(spark, xs[:1], lambda c: l.top_tokens(c, 2), "array<double>")] == [[2, 1]]
    te = col(spark, [[-1.0, -2.0]], l.truncated_entropy, "array<double>")[0]
    assert abs(te - (math.exp(-1) + 2 * math.exp(-2))) < 1e-12
    pool = col(spark, [[[1.0, 4.0], [3.0, 2.0]], []], l.pooled, "array<array<double>>")
    assert (pool[0].min, pool[0].max, pool[0]["mean"]) == ([1.0, 2.0], [3.0, 4.0], [2.0, 3.0]) and pool[1] is None
    assert col(spark, ["[0.5, 0.25]"], lambda c: l.entropy_at(c, F.lit(1))) == [0.25]
    stats = '[[{"token_idx": 4, "token_prob": 0.5}, {"token_idx": 2, "token_prob": 0.5}]]'
    assert col(spark, [stats, stats], lambda c: l.token_at(c, F.col("k"))) == [4, None]


def test_sequences(spark):
    h, w = F.array(*map(F.lit, [1.0, 5.0, 2.0, 4.0])), F.array(*map(F.lit, [1.0, -3.0, 3.0, 0.0]))
    zero, none = F.array(*map(F.lit, [0.0, -1.0, 0.0, 0.0])), F.array().cast("array<double>")
    r = spark.range(1).select(
        t.weighted_mean(h, w).alias("wm"), t.weighted_mean(h, zero).alias("wm0"), t.weighted_mean(none, none).alias("wmn"), t.median(h).alias("med"), t.share_over(h, F.lit(2.0)).alias("so"),
        t.weight_share_over(h, w, F.lit(1.5)).alias("ws"), t.weight_share_over(h, zero, F.lit(1.5)).alias("ws0"), t.top_by_weight(h, w, 2).alias("top"), t.top_by_weight(h, w, 9).alias("all"), t.tail(h, 3).alias("t3"), t.tail(h, 5).alias("t5"),
        t.normal_weights(w).alias("nw"), t.normal_weights(zero).alias("nw0"), t.tail_features(h, w, 2).alias("f2"), t.tail_features(none, none, 2).alias("f0"), t.tail_features(h, w, 5).alias("f5"),
    ).first()
    assert (r.wm, r.wm0, r.wmn, r.med, r.so) == (7 / 4, 3.0, None, 3.0, 0.5)
    assert (r.ws, r.ws0, r.top, r.all, r.t3, r.t5) == (0.75, None, [2.0, 1.0], [2.0, 1.0, 4.0, 5.0], [5.0, 2.0, 4.0], None)
    assert r.nw == [0.25, 0.0, 0.75, 0.0] and r.nw0 == [0.25] * 4
    assert r.f2 == [2.0, 4.0, 0.75, 0.0, 1.0, 1.0] and r.f0 == [0.0] * 6 and r.f5 == [0.0, 1.0, 5.0, 2.0, 4.0, 0.0, 0.25, 0.0, 0.75, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0]


@pytest.mark.parametrize("toks,want", [(["a", "[[", "b", "]]"], 2), (["a [", "[x", "]", "]"], 2), (["[[b]]"], -1), (["[[", "b"], -1), ([], -1), (["]]", "[[", "c", "]]"], 2), (["[[", "b]]"], 1)])
def test_marker_token(spark, toks, want):
    def rule():
        s, a_, b_ = "", -1, -1
        for i, x in enumerate(toks):
            s += x
            if a_ == -1:
                a_ = i if "[[" in s else -1
            elif b_ == -1:
                b_ = i if "]]" in s else -1
        return a_ + 1 if b_ != -1 else -1

    assert rule() == want
    assert col(spark, [toks], t.marker_token, "array<string>") == [want]


def test_token_ids(spark):
    ids = F.array(*map(F.lit, [5, 6, 0, 7, 6, 0]))
    pair = F.array(F.lit(6), F.lit(0))
    r = spark.range(1).select(
        t.find_subsequence(ids, pair).alias("at"), t.find_subsequence(pair, ids).alias("no"), t.find_subsequence(ids, F.array().cast("array<int>")).alias("e"), t.mask_before(ids, F.lit(3), 0).alias("m"), t.mask_before(ids, F.lit(-1), 0).alias("mm"),
        t.label_ids(pair, F.array(F.lit(9))).alias("lab"), t.label_ids(pair, F.array(F.lit(9)), False).alias("copy"), t.pad_left(pair, F.lit(4), 1).alias("pad"), t.fit_to(ids, 2, 1).alias("cut"), t.fit_to(pair, 4, 1).alias("fit"), t.first_id(F.array().cast("array<int>")).alias("none"),
        t.answer_slice(ids, F.lit(2), F.lit(99), F.lit(4)).alias("sl"), t.answer_slice(ids, F.lit(5), F.lit(2), F.lit(6)).alias("sl0"), t.shifted_hits(F.array(*map(F.lit, [1, 2, -100, 4, 3])), F.array(*map(F.lit, [2, 9, 4, 8, 1])), 3).alias("hits"),
        t.clamp(F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("c1"), t.clamp(F.lit(3.0), F.lit(1.0), F.lit(1.0)).alias("c0"), t.html(F.array(F.lit("<a&b>")), F.array(F.lit(0.5))).alias("html"),
    ).first()
    assert (r.at, r.no, r.e, r.none) == (1, -1, 0, -1)
    assert r.m == [-100, -100, -100, 7, 6, -100] and r.mm == [-100] * 6
    assert r.lab == [-100, -100, 9] and r.copy == [6, 0, 9] and r.pad == [1, 1, 6, 0] and r.cut == [5, 6] and r.fit == [6, 0, 1, 1]
    assert r.sl == [0, 7] and r.sl0 == [] and (r.hits.hits, r.hits.n) == (2, 2) and (r.c1, r.c0) == (1.0, 0.0)
    assert "&lt;a&amp;b&gt;" in r.html
