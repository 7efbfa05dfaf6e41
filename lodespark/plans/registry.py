"""All queries of the engine's own operators over the driver's tables, with their oracle SQL.

The tables hold no multiple-choice data, so each operator runs on a proxy that Spark and SQL build alike: embeddings as
logits, documents with labels as scored rows, events by user as token sequences, conversations as chats. Every query
reads its whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import answers, logits, prompts, tokens
from lodespark.operators import curate, metrics
from lodespark.sources import remote, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- logits -------------------------------------------------------------------------------------------------------

SOFT = """WITH l AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT *, list_max(e) AS m FROM l), x AS (SELECT *, list_transform(e, lambda v: exp(v - m)) AS x FROM m),
z AS (SELECT *, list_sum(x) AS z FROM x), p AS (SELECT *, list_transform(x, lambda v: v / z) AS p FROM z)"""


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", logits.doubles(F.col("embedding")).alias("e"))


@query(SOFT + """ SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))), 6) AS entropy,
round(ln(z) - (e[label + 1] - m), 6) AS cross_entropy, (list_position(e, m) - 1)::INT AS greedy_token FROM p""")
def token_entropy(spark, d):
    e = F.col("e")
    return _logits(spark, d).select("vec_id", r6(logits.entropy(e)).alias("entropy"), r6(logits.cross_entropy(e, F.col("label"))).alias("cross_entropy"), logits.argmax(e).alias("greedy_token"))


@query(SOFT + """, i AS (SELECT vec_id, p, list_transform(range(1, len(p) + 1), lambda i: {'n': -p[i], 'i': i - 1}) AS s FROM p)
SELECT vec_id, len(list_filter(p, lambda v: v > 0.015)) AS n_over,
array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: p[i] > 0.015), lambda i: i - 1), ',') AS over_idx,
array_to_string(list_transform(list_sort(s)[1:5], lambda t: t.i), ',') AS top_idx, round(-list_sort(s)[5].n, 6) AS fifth_prob FROM i""")
def sparse_probabilities(spark, d):
    df = _logits(spark, d).select("vec_id", logits.sparse_probabilities(F.col("e"), 0.015).alias("s"), logits.top_tokens(F.col("e"), 5).alias("t"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x["token_idx"].cast("string")), ",")
    return df.select("vec_id", F.size("s").cast("long").alias("n_over"), join(F.col("s")).alias("over_idx"), join(F.col("t")).alias("top_idx"), r6(F.get("t", F.lit(4))["token_prob"]).alias("fifth_prob"))


@query(SOFT + """, q AS (SELECT vec_id, list_reverse_sort(list_transform(e, lambda v: v - m - ln(z)))[1:20] AS t FROM p)
SELECT vec_id, round(-list_sum(list_transform(t, lambda v: v * exp(v))), 6) AS distill_entropy, round(exp(t[1]), 6) AS distill_answer_prob FROM q""")
def logprob_entropy(spark, d):
    top = F.slice(F.sort_array(logits.log_softmax(F.col("e")), asc=False), 1, 20)
    df = _logits(spark, d).select("vec_id", top.alias("t"))
    return df.select("vec_id", r6(logits.truncated_entropy(F.col("t"))).alias("distill_entropy"), r6(F.exp(F.get("t", F.lit(0)))).alias("distill_answer_prob"))


@query("""SELECT label, pos::INT AS pos, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(avg(v), 6) AS mean_v
FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos""")
def embedding_pool(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy("label", "pos").agg(r6(F.min("v")).alias("min_v"), r6(F.max("v")).alias("max_v"), r6(F.avg("v")).alias("mean_v"))


BANDED = SOFT + """, h AS (SELECT vec_id, label, e, p, -list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))) AS h, list_position(e, m) - 1 AS g FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY round(h, 9), vec_id) - 1 AS r, count(*) OVER () AS c FROM h),
b AS (SELECT *, r // nullif(c // 5, 0) AS band FROM r)"""


@query(BANDED + """ SELECT band::INT AS band, count(*) AS n, round(avg(h), 6) AS mean_entropy, round(min(h), 6) AS min_entropy, round(max(h), 6) AS max_entropy,
round(avg((g = label)::INT), 6) AS accuracy FROM b WHERE band < 5 GROUP BY band""")
def entropy_bands(spark, d):
    """The flagship: score, band, summarise."""
    df = _logits(spark, d).select("vec_id", logits.entropy(F.col("e")).alias("h"), (logits.argmax(F.col("e")) == F.col("label")).cast("int").alias("ok"))
    b = curate.bands(df.withColumn("s", F.round("h", 9)), "s", "vec_id", 5)
    return b.groupBy("band").agg(F.count("*").alias("n"), r6(F.avg("h")).alias("mean_entropy"), r6(F.min("h")).alias("min_entropy"), r6(F.max("h")).alias("max_entropy"), r6(F.avg("ok")).alias("accuracy"))


# ---- curation -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, (r // nullif(c // 7, 0))::INT AS band FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS c FROM documents) WHERE r // nullif(c // 7, 0) < 7""")
def complexity_bands(spark, d):
    return curate.bands(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 7).select("doc_id", "band")


@query("""SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 48271) % 2147483647, doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.2::DOUBLE, 0) THEN 'train' ELSE 'test' END AS split FROM documents""")
def exact_train_test_split(spark, d):
    return curate.train_test(table(spark, d, "documents").select("doc_id", "lang"), 0.2, "doc_id", ["lang"])


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 30)::BIGINT AS chunk FROM orders")
def fixed_chunks(spark, d):
    return curate.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 30).select("o_orderkey", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 48271) % 2147483647, doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_folds(spark, d):
    return curate.folds(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@query("SELECT doc_id, n_chars FROM documents ORDER BY (doc_id * 48271) % 2147483647, doc_id LIMIT 3")
def random_sample(spark, d):
    return curate.sample_rows(table(spark, d, "documents").select("doc_id", "n_chars"), 3, "doc_id")


JUDGED = """levels AS (SELECT p_partkey AS question_id, CASE p_size % 5 WHEN 0 THEN 'high_school_and_easier' WHEN 1 THEN 'undergraduate' WHEN 2 THEN 'graduate' WHEN 3 THEN 'postgraduate' ELSE 'other' END AS lvl,
p_size % 11 AS rating, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS steps FROM part)"""


def _judged(spark, d):
    s = F.col("p_size")
    level = F.when(s % 5 == 0, answers.LEVELS[0]).when(s % 5 == 1, answers.LEVELS[1]).when(s % 5 == 2, answers.LEVELS[2]).when(s % 5 == 3, answers.LEVELS[3]).otherwise("other")
    steps = F.when(s % 4 == 0, "low").when(s % 4 == 1, "medium").when(s % 4 == 2, "high")
    return table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), level.alias("masj_complexity"), (s % 11).alias("masj_rating"), steps.alias("masj_num_reasoning_steps"))


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("question_id"), "l_orderkey", "l_linenumber")


@query(f"""WITH {JUDGED} SELECT l_partkey AS question_id, l_orderkey, l_linenumber, CASE lvl WHEN 'high_school_and_easier' THEN 0.2 WHEN 'undergraduate' THEN 0.4 WHEN 'graduate' THEN 0.6 WHEN 'postgraduate' THEN 0.8 ELSE 0 END::DOUBLE AS masj_complexity
FROM lineitem JOIN levels ON l_partkey = question_id WHERE rating >= 9""")
def judge_join(spark, d):
    return curate.join_education_levels(_lines(spark, d), _judged(spark, d))


@query(f"""WITH {JUDGED} SELECT l_partkey AS question_id, l_orderkey, l_linenumber, CASE steps WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 END::DOUBLE AS masj_num_reasoning_steps
FROM lineitem JOIN levels ON l_partkey = question_id WHERE steps IS NOT NULL""")
def reasoning_join(spark, d):
    return curate.join_reasoning_steps(_lines(spark, d), _judged(spark, d))


@query("""SELECT o_orderkey AS question_id, o_totalprice FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ON o_orderkey = l_orderkey""")
def semi_split(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("question_id"))
    return curate.rows_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_totalprice"), ids, once=True)


@query("""SELECT o_orderkey AS question_id, o_totalprice FROM orders JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ON o_orderkey = l_orderkey""")
def split_rows(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("question_id"))
    return curate.rows_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_totalprice"), ids)


RECORDS = """rec AS (SELECT l_orderkey::VARCHAR AS question_id, chr((65 + l_linenumber)::INT) AS answer, (l_returnflag = 'R') AS is_correct, 't' || l_suppkey AS thinking,
CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'timeout' END AS error, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS seq FROM lineitem)"""


def _records(spark, d):
    f = F.col
    out = F.struct(F.char(65 + f("l_linenumber")).alias("answer"), (f("l_returnflag") == "R").alias("is_correct"), F.concat(F.lit("t"), f("l_suppkey").cast("string")).alias("thinking"), F.when((f("l_linestatus") == "F") & (f("l_quantity") > 25), "timeout").alias("error"))
    seq = f("l_orderkey") * 100000000 + f("l_linenumber") * 10000000 + f("l_partkey") * 1000 + f("l_suppkey")
    return table(spark, d, "lineitem").select(F.struct(f("l_orderkey").cast("string").alias("question_id")).alias("input"), out.alias("output"), seq.alias("seq"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderpriority")


@query(f"WITH {RECORDS} SELECT o_orderkey AS question_id, o_orderpriority FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT question_id FROM rec WHERE error IS NULL)")
def anti_done(spark, d):
    return curate.todo(_orders(spark, d), _records(spark, d))


@query(f"""WITH {RECORDS}, g AS (SELECT question_id, seq, error FROM rec QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY error IS NULL DESC, seq DESC) = 1)
SELECT question_id, seq, error FROM g""")
def latest_success(spark, d):
    out = curate.latest_success(_records(spark, d), F.col("input.question_id"), F.col("seq"))
    return out.select("input.question_id", "seq", "output.error")


@query(f"""WITH {RECORDS}, g AS (SELECT * FROM rec WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY seq DESC) = 1)
SELECT o_orderkey AS question_id, o_orderpriority, answer AS previous_answer, thinking AS previous_thinking FROM orders JOIN g ON question_id = o_orderkey::VARCHAR WHERE NOT is_correct""")
def branch_c_input(spark, d):
    return curate.review_input(_orders(spark, d), _records(spark, d))


@query("SELECT dataset, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM (SELECT lang AS dataset, n_chars FROM documents UNION ALL SELECT 'labels', NULL FROM labels) GROUP BY dataset")
def combined_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    langs = sorted((r.lang for r in docs.select("lang").distinct().collect()), key=str)
    parts = {lang: docs.filter(F.col("lang").eqNullSafe(lang)) for lang in langs}
    labels = table(spark, d, "labels").select("doc_id", "quality")
    parts["labels"] = labels.unionByName(parts["labels"], allowMissingColumns=True) if "labels" in parts else labels
    return curate.combined(parts).groupBy("dataset").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


# ---- answers ------------------------------------------------------------------------------------------------------

ANSWERED = """a AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN chr((97 + doc_id % 26)::INT) WHEN 1 THEN ' ' || chr((97 + doc_id % 7)::INT) WHEN 2 THEN chr((65 + doc_id % 26)::INT) WHEN 3 THEN '0' WHEN 4 THEN (doc_id % 13)::VARCHAR END AS answer,
CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE (doc_id % 30 - 2)::VARCHAR END AS idx, chr((97 + doc_id % 7)::INT) AS gold FROM documents)"""


def _answered(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 6 == 0, F.char(97 + i % 26)).when(i % 6 == 1, F.concat(F.lit(" "), F.char(97 + i % 7))).when(i % 6 == 2, F.char(65 + i % 26)).when(i % 6 == 3, "0").when(i % 6 == 4, (i % 13).cast("string"))
    idx = F.when(i % 11 == 0, "x").otherwise((i % 30 - 2).cast("string"))
    return table(spark, d, "documents").select("doc_id", answer.alias("answer"), idx.alias("idx"), F.char(97 + i % 7).alias("gold"))


@query(f"""WITH {ANSWERED} SELECT doc_id, coalesce(regexp_full_match(answer, '[a-z0]'), false) AS valid, coalesce(regexp_full_match(answer, '[a-z]'), false) AS known, coalesce(answer = '0', false) AS unknown,
coalesce(CASE WHEN idx = 'x' THEN NULL WHEN idx::INT < 0 THEN chr((97 + 26 + idx::INT)::INT) WHEN idx::INT < 26 THEN chr((97 + idx::INT)::INT) END = trim(answer), false) AS correct, coalesce(lower(trim(answer)) = gold, false) AS equal_gold FROM a""")
def answers_valid(spark, d):
    a = F.col("answer")
    return _answered(spark, d).select("doc_id", answers.is_valid_answer(a).alias("valid"), answers.is_known_answer(a).alias("known"), answers.is_unknown_answer(a).alias("unknown"), answers.answer_correct(F.col("idx"), a).alias("correct"), answers.answer_equals(a, F.col("gold")).alias("equal_gold"))


@query(f"WITH {ANSWERED} SELECT doc_id, answer FROM a WHERE regexp_full_match(answer, '[a-z]')")
def known_rows(spark, d):
    return curate.keep_valid_and_known(_answered(spark, d), "answer").select("doc_id", "answer")


@query(f"WITH {ANSWERED} SELECT doc_id FROM a WHERE answer = '0'")
def unknown_rows(spark, d):
    return curate.unknown_answers(_answered(spark, d), "answer").select("doc_id")


MARKED = """m AS (SELECT doc_id, 'So ' || lang || CASE doc_id % 7 WHEN 0 THEN ' [[b]]' WHEN 1 THEN ' [[ C ]] and [[ 12 ]]' WHEN 2 THEN ' ]] no [[' WHEN 3 THEN ' [[only' WHEN 4 THEN ' [[7]] [[dx]]' WHEN 5 THEN ' [[undergraduate]] [[]]' ELSE '' END AS s FROM documents)"""


def _marked(spark, d):
    i = F.col("doc_id") % 7
    tail = F.when(i == 0, " [[b]]").when(i == 1, " [[ C ]] and [[ 12 ]]").when(i == 2, " ]] no [[").when(i == 3, " [[only").when(i == 4, " [[7]] [[dx]]").when(i == 5, " [[undergraduate]] [[]]").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("So "), F.col("lang"), tail).alias("s"))


@query(f"""WITH {MARKED}, p AS (SELECT *, instr(s, '[[') AS a, instr(s, ']]') AS b, string_split(s, '[[')[-1] AS t FROM m),
q AS (SELECT *, CASE WHEN a > 0 AND contains(t, ']]') THEN upper(trim(string_split(t, ']]')[1])) END AS u FROM p)
SELECT doc_id, CASE WHEN a > 0 AND b > a + 2 THEN s[a + 2:b - 1] ELSE '' END AS first_text, CASE WHEN u[1] BETWEEN 'A' AND 'Z' AND u <> '' THEN u[1] END AS last_letter,
coalesce(try_cast(regexp_extract_all(s, '\\[\\[\\s*(\\d+)\\s*\\]\\]', 1)[-1] AS BIGINT), -1) AS last_number, nullif(lower(regexp_extract(s, '\\[\\[\\s*([A-Za-z])[\\s\\S]*?\\]\\]', 1)), '') AS first_letter,
CASE WHEN regexp_extract(s, '\\[\\[(.+?)\\]\\]', 1) IN ('high_school_and_easier', 'undergraduate', 'graduate', 'postgraduate') THEN regexp_extract(s, '\\[\\[(.+?)\\]\\]', 1) END AS level,
CASE WHEN try_cast(regexp_extract(s, '\\[\\[(\\d+?)\\]\\]', 1) AS INT) BETWEEN 1 AND 10 THEN try_cast(regexp_extract(s, '\\[\\[(\\d+?)\\]\\]', 1) AS INT) ELSE -1 END AS rating FROM q""")
def markers(spark, d):
    s = F.col("s")
    return _marked(spark, d).select("doc_id", answers.marker_text(s).alias("first_text"), answers.marker_last_letter(s).alias("last_letter"), F.coalesce(answers.marker_last_number(s), F.lit(-1)).alias("last_number"), answers.marker_first_letter(s).alias("first_letter"), answers.judge_level(s).alias("level"), F.coalesce(answers.judge_rating(s), F.lit(-1)).alias("rating"))


@query("""WITH t AS (SELECT p_partkey, (p_size % 12)::INT AS n, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN (p_size % 14)::VARCHAR WHEN 2 THEN ' ' || chr((97 + p_size % 14)::INT) || ' ' ELSE '``` 7 and ' || p_size || '``` ' END AS x FROM part),
l AS (SELECT *, list_transform(range(65, 65 + n), lambda i: chr(i::INT)) AS ls, upper(trim(x)) AS u, regexp_replace(trim(x), '^```[a-zA-Z]*\\s*|\\s*```$', '', 'g') AS f FROM t),
k AS (SELECT *, CASE WHEN n > 0 THEN nullif(upper(regexp_extract(f, '([A-' || chr((64 + n)::INT) || 'a-' || chr((96 + n)::INT) || '])', 1)), '') END AS c, try_cast(nullif(regexp_extract(f, '(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)', 1), '') AS INT) AS num, CASE WHEN regexp_full_match(u, '[0-9]+') THEN u::INT END AS i FROM l)
SELECT p_partkey, CASE WHEN list_contains(ls, u) THEN u ELSE coalesce(CASE WHEN i >= 0 AND i < n THEN ls[i + 1] END, CASE WHEN i - 1 >= 0 AND i - 1 < n THEN ls[i] END, '') END AS letter,
coalesce(c, CASE WHEN num < n THEN ls[num + 1] WHEN num - 1 >= 0 AND num - 1 < n THEN ls[num] END, '') AS in_text FROM k""")
def letters(spark, d):
    i, s = F.col("p_partkey") % 4, F.col("p_size")
    x = F.when(i == 0, F.col("p_name")).when(i == 1, (s % 14).cast("string")).when(i == 2, F.concat(F.lit(" "), F.char(97 + s % 14), F.lit(" "))).otherwise(F.concat(F.lit("``` 7 and "), s.cast("string"), F.lit("``` ")))
    n = (s % 12).cast("int")
    df = table(spark, d, "part").select("p_partkey", n.alias("n"), x.alias("x"))
    return df.select("p_partkey", answers.letter_of(F.col("x"), answers.letters_for(F.col("n"))).alias("letter"), answers.letter_in_text(F.col("x"), F.col("n")).alias("in_text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 3 END::INT AS n, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS first_option, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS option_b,
CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr((65 + p_size % 3)::INT) END AS gold FROM part""")
def options_parse(spark, d):
    f = F.col
    text = F.when(f("p_partkey") % 5 == 0, "[oops").otherwise(F.concat(F.lit("['"), f("p_name"), F.lit("', \""), f("p_type"), F.lit("\", '"), f("p_brand"), F.lit("']")))
    df = table(spark, d, "part").select("p_partkey", answers.parse_options(text).alias("o"), (f("p_size") % 3).alias("i"))
    ls = answers.letters_for(F.size("o"))
    by = F.map_from_arrays(ls, F.col("o"))
    return df.select("p_partkey", F.size("o").alias("n"), F.get("o", F.lit(0)).alias("first_option"), F.try_element_at(by, F.lit("B")).alias("option_b"), answers.gold_letter(F.lit(""), F.col("i"), ls).alias("gold"))


@query("SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k, '[' || (event_id % 3) || ',1]' AS packed FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.array(F.col("event_id") % 3, F.lit(1))).alias("packed"))


@query("SELECT p_partkey, translate(lower(p_brand || '/' || p_type || ':v1.' || p_size), '/:-.', '____') AS slug, p_name[1:5] AS preview, coalesce(nullif(trim(p_type), ''), 'x') AS subject FROM part")
def slugs(spark, d):
    f = F.col
    s = F.concat(f("p_brand"), F.lit("/"), f("p_type"), F.lit(":v1."), f("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", answers.slug(s).alias("slug"), F.left("p_name", F.lit(5)).alias("preview"), answers.first_subject(F.lit(None).cast("string"), F.lit(""), f("p_type"), f("p_brand")).alias("subject"))


# ---- prompts ------------------------------------------------------------------------------------------------------

_P = prompts.SYSTEM


@query(f"""WITH o AS (SELECT *, 'Question: ' || p_name || chr(10) || chr(10) || 'Options:' || chr(10) || 'a. ' || p_brand || chr(10) || 'b. ' || p_type || chr(10) || 'c.' AS u,
CASE WHEN p_size % 3 = 0 THEN '' ELSE 'You answer questions about ' || p_type || '. ' END || $${_P['unsure']}$$ AS s FROM part)
SELECT p_partkey, s AS system, u AS prompt, '<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_brand || '<|im_end|>' || chr(10) ELSE '' END AS example FROM o""")
def prompt_render(spark, d):
    f = F.col
    options = F.array(f("p_brand"), f("p_type"), F.lit(""))
    df = table(spark, d, "part").withColumn("s", prompts.system_prompt(F.when(f("p_size") % 3 != 0, f("p_type")), "unsure")).withColumn("u", prompts.user_prompt(f("p_name"), options))
    return df.select("p_partkey", f("s").alias("system"), f("u").alias("prompt"), prompts.chatml_example(f("s"), f("u"), F.when(f("p_size") % 2 == 0, f("p_brand"))).alias("example"))


@query("""SELECT conv_id, count(*) AS messages, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) || '<|im_start|>assistant' || chr(10) AS chat FROM conversations GROUP BY conv_id""")
def chat_messages(spark, d):
    df = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return df.select("conv_id", F.size("m").cast("long").alias("messages"), prompts.chatml(F.col("m")).alias("chat"))


# ---- token sequences ----------------------------------------------------------------------------------------------

SEQ = """s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t, list(value ORDER BY ts, event_id) AS h, list((event_id % 7 - 1)::DOUBLE ORDER BY ts, event_id) AS w FROM events WHERE event_type <> 'signup' GROUP BY user_id),
q AS (SELECT quantile_cont(value, 0.75) AS thr FROM events WHERE event_type <> 'signup')"""


def sequences(spark, d):
    """user_id, t, h, w of the tokens that are not special; users without any are left out."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value", (F.col("event_id") % 7 - 1).cast("double").alias("w"))))
    df = table(spark, d, "events").groupBy("user_id").agg(rows.alias("r"))
    kept = tokens.without_special(F.col("r.event_type"), F.col("r.value"), F.col("r.w"), F.array(F.lit("signup")))
    return df.select("user_id", kept.alias("k")).filter(F.size("k") > 0).select("user_id", F.col("k.t").alias("t"), F.col("k.h").alias("h"), F.col("k.w").alias("w"))


def threshold(spark, d, p: float = 0.75) -> DataFrame:
    return curate.quantiles(table(spark, d, "events").filter("event_type <> 'signup'"), F.col("value"), [p]).withColumnRenamed("q0", "thr")


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events GROUP BY user_id""")
def describe_events(spark, d):
    df = metrics.describe(table(spark, d, "events"), "value", ["user_id"])
    return df.select("user_id", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("""SELECT round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.99), 6) AS p99 FROM events""")
def entropy_percentiles(spark, d):
    q = curate.quantiles(table(spark, d, "events"), F.col("value"), [0.75, 0.01, 0.99])
    return q.select(r6(F.col("q0")).alias("p75"), r6(F.col("q1")).alias("p1"), r6(F.col("q2")).alias("p99"))


@query(f"""WITH {SEQ} SELECT user_id, round(list_avg(h), 6) AS mean, round(list_median(h), 6) AS median, round(list_max(h), 6) AS max, CASE WHEN len(h) >= 5 THEN round(list_avg(h[-5:]), 6) END AS tail5_mean,
CASE WHEN len(h) >= 5 THEN round(list_max(h[-5:]), 6) END AS tail5_max, CASE WHEN len(h) >= 5 THEN round(list_median(h[-5:]), 6) END AS tail5_median FROM s""")
def tail_k_uncertainty(spark, d):
    h, t = F.col("h"), tokens.tail(F.col("h"), 5)
    return sequences(spark, d).select("user_id", r6(tokens.mean(h)).alias("mean"), r6(tokens.median(h)).alias("median"), r6(F.array_max(h)).alias("max"), r6(tokens.mean(t)).alias("tail5_mean"), r6(F.array_max(t)).alias("tail5_max"), r6(tokens.median(t)).alias("tail5_median"))


ATT = f"""WITH {SEQ}, c AS (SELECT *, list_transform(w, lambda x: greatest(x, 0)) AS cw, list_transform(range(1, len(h) + 1), lambda i: {{'n': -w[i], 'i': i, 'h': h[i]}}) AS z FROM s, q),
k AS (SELECT *, list_sum(cw) AS m, list_transform(list_sort(z)[1:5], lambda x: x.h) AS top FROM c),
a AS (SELECT user_id, CASE WHEN m <= 1e-12 THEN list_avg(h) ELSE list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i] * cw[i])) / m END AS attn_mean, list_avg(top) AS top5_mean, list_max(top) AS top5_max,
len(list_filter(h, lambda x: x > thr)) / len(h) AS frac_high, CASE WHEN m > 1e-12 THEN list_sum(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] > thr THEN cw[i] ELSE 0 END)) / m END AS frac_attn_high, list_avg(h) AS mean FROM k)"""
ATTENTION = ["attn_mean", "top5_mean", "top5_max", "frac_high", "frac_attn_high"]


def attention(spark, d):
    h, w = F.col("h"), F.col("w")
    top = tokens.top_by_weight(h, w, 5)
    s = sequences(spark, d).crossJoin(F.broadcast(threshold(spark, d)))  # one row
    return s.select("user_id", tokens.weighted_mean(h, w).alias("attn_mean"), tokens.mean(top).alias("top5_mean"), F.array_max(top).alias("top5_max"), tokens.share_over(h, F.col("thr")).alias("frac_high"), tokens.weight_share_over(h, w, F.col("thr")).alias("frac_attn_high"), tokens.mean(h).alias("mean"))


@query(ATT + " SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ATTENTION) + " FROM a")
def attention_metrics(spark, d):
    return attention(spark, d).select("user_id", *[r6(F.col(c)).alias(c) for c in ATTENTION])


@query(ATT + ", u AS (SELECT (user_id % 3 = 0)::INT AS y, unnest([" + ", ".join(f"{{'m': '{c}', 'v': round({c}, 9)}}" for c in ATTENTION) + """], recursive := true) FROM a),
r AS (SELECT m, y, v, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2 AS rk FROM u WHERE v IS NOT NULL)
SELECT m AS metric, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) AS n_valid, count(*) FILTER (y = 1) AS n_incorrect, count(*) FILTER (y = 0) AS n_correct
FROM r GROUP BY m HAVING count(*) >= 10 AND count(DISTINCT y) = 2""")
def metric_auc_table(spark, d):
    df = attention(spark, d).select((F.col("user_id") % 3 == 0).cast("int").alias("y"), *[F.round(c, 9).alias(c) for c in ATTENTION])
    return metrics.metric_table(df, ATTENTION, "y").withColumn("auc", r6(F.col("auc")))


@query(f"""WITH {SEQ}, k AS (SELECT user_id, h, least(8, len(h)) AS k, list_transform(w, lambda x: greatest(x, 0)) AS c FROM s),
m AS (SELECT *, list_sum(c) AS m FROM k), n AS (SELECT *, list_transform(c, lambda x: CASE WHEN m <= 1e-12 THEN 1.0 / len(c) ELSE x / m END) AS nw FROM m),
f AS (SELECT user_id, list_concat(list_transform(range(0, 8 - k), lambda i: 0.0::DOUBLE), h[-k:], list_transform(range(0, 8 - k), lambda i: 0.0::DOUBLE), nw[-k:], list_transform(range(0, 8), lambda i: CASE WHEN i >= 8 - k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS f FROM n)
SELECT user_id, unnest(range(0, 24))::INT AS pos, round(unnest(f), 6) AS v FROM f""")
def seq_features(spark, d):
    return sequences(spark, d).select("user_id", F.posexplode(tokens.tail_features(F.col("h"), F.col("w"), 8)).alias("pos", "v")).withColumn("v", r6(F.col("v")))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT conv_id, turn, coalesce((SELECT min(i) FROM (SELECT unnest(range(0, len(w) - 1)) AS i) WHERE w[i + 1:i + 2] = w[3:4]), -1)::INT AS at, len(w[2:greatest(1, least(5, len(w)))])::INT AS sliced FROM t""")
def subsequence(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    n = F.size("w")
    part = F.slice(F.col("w"), 3, 2)
    at = F.when(F.size(part) == 2, tokens.find_subsequence(F.col("w"), part))
    return df.select("conv_id", "turn", F.coalesce(at, F.lit(-1)).alias("at"), F.size(tokens.answer_slice(F.col("w"), F.lit(1), F.lit(5), n)).alias("sliced"))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: len(x)::INT) AS ids FROM conversations),
l AS (SELECT *, list_transform(range(0, len(ids)), lambda i: CASE WHEN i < 3 OR ids[i + 1] = 2 THEN -100 ELSE ids[i + 1] END) AS y FROM t),
p AS (SELECT conv_id, turn, list_filter(range(2, len(y) + 1), lambda i: y[i] <> -100 AND y[i] <> 4) AS k, y, ids FROM l)
SELECT (conv_id % 5)::INT AS grp, sum(len(k))::BIGINT AS tokens, round(sum(len(list_filter(k, lambda i: y[i] = ids[i - 1]))) / sum(len(k)), 6) AS accuracy FROM p GROUP BY grp""")
def masked_token_accuracy(spark, d):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    df = table(spark, d, "conversations").select((F.col("conv_id") % 5).cast("int").alias("grp"), ids.alias("ids"))
    df = df.withColumn("hits", tokens.shifted_hits(tokens.mask_before(F.col("ids"), F.lit(3), 2), F.col("ids"), 4))
    return metrics.masked_accuracy(df, "hits", ["grp"]).withColumn("accuracy", r6(F.col("accuracy")))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: len(x)::INT) AS ids FROM conversations),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS mx FROM t), p AS (SELECT *, (ceil(mx / 8) * 8)::INT AS size FROM m)
SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(0, size - len(ids)), lambda i: 0), ids), ',') AS padded, array_to_string(list_concat(ids[1:16], list_transform(range(0, 16 - least(16, len(ids))), lambda i: 0)), ',') AS fitted,
array_to_string(list_concat(list_transform(ids[1:2], lambda i: -100), [7]), ',') AS labels FROM p""")
def padded_batches(spark, d):
    from pyspark.sql import Window

    f = F.col
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    df = table(spark, d, "conversations").select("conv_id", "turn", ids.alias("ids"))
    size = F.ceil(F.max(F.size("ids")).over(Window.partitionBy("conv_id")) / 8) * 8
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return df.withColumn("size", size).select("conv_id", "turn", join(tokens.pad_left(f("ids"), f("size"), 0)).alias("padded"), join(tokens.fit_to(f("ids"), 16, 0)).alias("fitted"), join(tokens.label_ids(F.slice("ids", 1, 2), F.array(F.lit(7)))).alias("labels"))


# ---- metrics ------------------------------------------------------------------------------------------------------

SCORED = "d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query(f"""WITH {SCORED}, u AS (SELECT 'ALL' AS col, 'ALL' AS category, quality AS y, -n_chars AS s FROM d UNION ALL SELECT 'lang', lang, quality, -n_chars FROM d UNION ALL SELECT 'source', source, quality, -n_chars FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY col, category ORDER BY s) + (count(*) OVER (PARTITION BY col, category, s) - 1) / 2 AS rk FROM u),
g AS (SELECT col, category, count(*) AS n, avg(y) AS acc, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM r GROUP BY col, category HAVING count(*) >= 10 OR col = 'ALL')
SELECT category, round(auc, 6) AS roc_auc, round(acc, 6) AS accuracy, round(abs(2 * auc - 1), 6) AS gini, n AS num_samples, 'demo' AS model, 'n_chars' AS metric FROM g""")
def roc_auc_by_category(spark, d):
    df = metrics.report(scored(spark, d), "demo", ["lang", "source"], "quality", "n_chars")
    return df.select("category", r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("accuracy")).alias("accuracy"), r6(F.col("gini")).alias("gini"), "num_samples", "model", "metric")


@query("SELECT vec_id, round(1 - label / max(label) OVER (), 6) AS score FROM embeddings")
def normalised_score(spark, d):
    return metrics.normalised(table(spark, d, "embeddings").select("vec_id", "label"), "label", "score").select("vec_id", r6(F.col("score")).alias("score"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def value_counts(spark, d):
    return metrics.value_counts(table(spark, d, "documents"), "source")


@query(f"""WITH {SCORED}, b AS (SELECT lang, quality, least(floor((n_chars - lo) / ((hi - lo) / 12)) + 1, 12)::INT AS bin FROM d, (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM d))
SELECT lang, bin, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, bin), 6) AS share FROM b GROUP BY lang, bin, quality""")
def histogram_outcome(spark, d):
    df = metrics.histogram(scored(spark, d), "n_chars", "quality", 12, ["lang"])
    return df.withColumn("share", r6(F.col("share")))


@query("""SELECT user_id % 10 AS grp, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase_mean, round(avg(value) FILTER (event_type <> 'purchase'), 6) AS other_mean, round(sum(value * (event_id % 5)) / nullif(sum(event_id % 5), 0), 6) AS value FROM events GROUP BY grp""")
def conditional_means(spark, d):
    e = table(spark, d, "events").withColumn("grp", F.col("user_id") % 10).withColumn("w", F.col("event_id") % 5)
    is_p = F.col("event_type") == "purchase"
    a = e.groupBy("grp").agg(r6(F.avg(F.when(is_p, F.col("value")))).alias("purchase_mean"), r6(F.avg(F.when(~is_p, F.col("value")))).alias("other_mean"))
    return a.join(metrics.weighted_running(e, ["value"], "w", ["grp"]).withColumn("value", r6(F.col("value"))), "grp")


@query("""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'mid' ELSE 'hard' END AS split FROM customer),
d AS (SELECT split, sum(coalesce(len(string_split(o_orderpriority, ' ')), 0)) AS dis FROM s JOIN orders ON k = o_custkey GROUP BY split), f AS (SELECT split, sum(1) AS sft FROM s GROUP BY split),
t AS (SELECT sum(sft) AS a, sum(dis) AS b, sum(CASE WHEN split = 'hard' THEN sft ELSE dis END) AS c, sum(CASE WHEN split = 'hard' THEN dis ELSE sft END) AS p FROM f JOIN d USING (split))
SELECT a::BIGINT AS sft_tokens, b::BIGINT AS distill_tokens, c::BIGINT AS alternative_tokens, p::BIGINT AS pipeline_tokens, round(1 - p / b, 6) AS advantage FROM t""")
def token_budget(spark, d):
    k = F.col("c_custkey")
    splits = table(spark, d, "customer").select(k.alias("k"), F.when(k % 3 == 0, "easy").when(k % 3 == 1, "mid").otherwise("hard").alias("split"))
    dis = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    out = metrics.token_budget(splits, dis, "k", F.size(F.split("o_orderpriority", " ")), F.lit(1))
    return out.withColumn("advantage", r6(F.col("advantage")))


EVALS = """e AS (SELECT doc_id, 'set' || (doc_id % 4) AS dataset, e AS epoch, CASE WHEN doc_id % 4 = 2 AND e IN (1, 3) THEN 'z' WHEN (doc_id * 7 + e) % 3 = 0 THEN chr((97 + (doc_id + e) % 8)::INT) ELSE chr((97 + doc_id % 5)::INT) END AS p, chr((97 + doc_id % 5)::INT) AS g FROM labels, (SELECT unnest([0, 1, 2, 3, 4]) AS e))"""


def evaluations(spark, d):
    i, e = F.col("doc_id"), F.col("epoch")
    df = table(spark, d, "labels").select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("epoch"))
    p = F.when((i % 4 == 2) & e.isin(1, 3), "z").when((i * 7 + e) % 3 == 0, F.char(97 + (i + e) % 8)).otherwise(F.char(97 + i % 5))
    return df.select("doc_id", F.concat(F.lit("set"), (i % 4).cast("string")).alias("dataset"), "epoch", p.alias("p"), F.char(97 + i % 5).alias("g"))


@query(f"""WITH {EVALS} SELECT dataset, epoch, count(*) FILTER (p <= 'g' AND p = g) AS correct, count(*) FILTER (p <= 'g') AS processed, count(*) FILTER (p > 'g') AS errors, coalesce(round(count(*) FILTER (p <= 'g' AND p = g) / nullif(count(*) FILTER (p <= 'g'), 0), 6), 0) AS accuracy FROM e GROUP BY dataset, epoch""")
def eval_accuracy(spark, d):
    allowed = F.array(*[F.lit(c) for c in "abcdefg"])
    return metrics.qa_accuracy(evaluations(spark, d), F.col("p"), F.col("g"), allowed, ["dataset", "epoch"]).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"WITH {EVALS} SELECT doc_id, dataset, epoch, p AS output FROM e WHERE p <> g")
def incorrect_log(spark, d):
    return evaluations(spark, d).filter(~answers.answer_equals(F.col("p"), F.col("g"))).select("doc_id", "dataset", "epoch", F.col("p").alias("output"))


@query(f"""WITH {EVALS}, a AS (SELECT dataset, epoch, avg((p = g)::INT) AS acc FROM e GROUP BY dataset, epoch), f AS (SELECT *, coalesce(epoch > min(epoch) FILTER (acc = 0) OVER (PARTITION BY dataset), false) AS skipped FROM a)
SELECT dataset, epoch, skipped, round(CASE WHEN skipped THEN 0 ELSE acc END, 6) AS accuracy FROM f""")
def skip_after_zero(spark, d):
    a = evaluations(spark, d).groupBy("dataset", "epoch").agg(F.avg((F.col("p") == F.col("g")).cast("int")).alias("accuracy"))
    return metrics.skip_after_zero(a).select("dataset", "epoch", "skipped", r6(F.col("accuracy")).alias("accuracy"))


@query(f"""WITH {EVALS}, a AS (SELECT dataset AS name, epoch, round(avg((p = g)::INT), 9) AS acc FROM e GROUP BY dataset, epoch) SELECT name, round(max(acc), 6) AS best, min(epoch) FILTER (acc = m)::INT AS best_epoch, round(arg_max(acc, epoch), 6) AS final FROM (SELECT *, max(acc) OVER (PARTITION BY name) AS m FROM a) GROUP BY name""")
def curve_summary(spark, d):
    a = evaluations(spark, d).groupBy(F.col("dataset").alias("name"), "epoch").agg(F.round(F.avg((F.col("p") == F.col("g")).cast("int")), 9).alias("accuracy"))
    return metrics.curve_summary(a).select("name", r6(F.col("best")).alias("best"), "best_epoch", r6(F.col("final")).alias("final"))


def synth_records(spark, d):
    f = F.col
    i = f("conv_id") + f("turn")
    out = F.when(i % 13 == 0, None).otherwise(F.struct(f("role").alias("answer"), F.when(i % 3 != 0, f("text")).alias("thinking"), F.when(i % 4 == 0, "").otherwise(f("text")).alias("raw_response"), F.when(i % 5 == 0, "429").alias("error")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.struct(f("role").alias("gold")).alias("input"), out.alias("output"))


@query("""WITH c AS (SELECT conv_id, turn, text, conv_id + turn AS i FROM conversations)
SELECT conv_id, turn, CASE WHEN i % 13 = 0 THEN 'missing output' ELSE concat_ws(';', CASE WHEN i % 5 = 0 THEN 'api error' END, CASE WHEN i % 3 = 0 OR text = '' THEN 'missing thinking' END, CASE WHEN i % 4 = 0 OR text = '' THEN 'missing raw response' END) END AS issues FROM c
WHERE i % 13 = 0 OR i % 5 = 0 OR i % 3 = 0 OR i % 4 = 0 OR text = ''""")
def quality_report(spark, d):
    df = metrics.quality_issues(synth_records(spark, d)).filter(F.size("issues") > 0)
    return df.select("conv_id", "turn", F.array_join("issues", ";").alias("issues"))


@query("""WITH c AS (SELECT conv_id % 11 AS i, role FROM conversations) SELECT count(*) FILTER (i NOT IN (0, 1)) AS total, count(*) FILTER (i NOT IN (0, 1, 2) AND (i = 3 OR i % 2 = 0)) AS correct,
count(*) FILTER (i NOT IN (0, 1)) - count(*) FILTER (i NOT IN (0, 1, 2) AND (i = 3 OR i % 2 = 0)) AS incorrect, count(*) FILTER (i IN (1, 2)) AS malformed, round(count(*) FILTER (i NOT IN (0, 1, 2) AND (i = 3 OR i % 2 = 0)) / count(*) FILTER (i NOT IN (0, 1)), 6) AS accuracy FROM c""")
def jsonl_accuracy(spark, d):
    i = F.col("conv_id") % 11
    good = F.concat(F.lit('{"input": {"gold": "'), F.col("role"), F.lit('"}, "output": {"answer": "'), F.when(i % 2 == 0, F.col("role")).otherwise("other"), F.lit('"}}'))
    line = F.when(i == 0, " ").when(i == 1, "{broken").when(i == 2, '{"input": {}, "output": {"answer": "x"}}').when(i == 3, '{"input": {"gold": null}, "output": {"answer": null}}').otherwise(good)
    return metrics.jsonl_accuracy(table(spark, d, "conversations").select(line.alias("value"))).withColumn("accuracy", r6(F.col("accuracy")))


# ---- plans, streams, models ---------------------------------------------------------------------------------------


@query("""SELECT 'group' || a.i || '_train' AS train, 'group' || b.i || '_test' AS test, a.i::INT AS stage FROM (SELECT DISTINCT s_nationkey % 6 AS i FROM supplier) a, (SELECT DISTINCT s_nationkey % 6 AS i FROM supplier) b""")
def evaluation_plan(spark, d):
    from lodespark.plans.pipelines import evaluation_plan

    bands = table(spark, d, "supplier").select((F.col("s_nationkey") % 6).cast("int").alias("band")).distinct()
    return evaluation_plan(bands)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_windowed_counts(spark, d):
    from lodespark.streaming.resume import run_windowed_counts

    out = run_windowed_counts(spark, d, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet", ["event_type"], "windowed_counts")
    return out.withColumn("total", r6(F.col("total"))).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def hist_sql(part: str, source: str, x: str, bins: int, hue: str | None) -> str:
    key = f"(bin::VARCHAR || '/' || {hue}::VARCHAR)" if hue else "bin::VARCHAR"
    return f"""SELECT '{part}' AS part, {key} AS key, count(*)::DOUBLE AS value FROM (SELECT *, CASE WHEN hi = lo THEN 1 ELSE least(floor(({x} - lo) / ((hi - lo) / {bins})) + 1, {bins}) END::INT AS bin
FROM {source}, (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source})) GROUP BY ALL"""


def auc_sql(part: str, source: str, x: str, y: str, categories: list[str]) -> str:
    rows = " UNION ALL ".join([f"SELECT 'ALL' AS col, 'ALL' AS category, {y} AS y, -{x} AS s FROM {source}"] + [f"SELECT '{c}', {c}::VARCHAR, {y}, -{x} FROM {source} WHERE {c} IS NOT NULL" for c in categories])
    return f"""SELECT '{part}' AS part, category AS key, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS value
FROM (SELECT *, rank() OVER (PARTITION BY col, category ORDER BY s) + (count(*) OVER (PARTITION BY col, category, s) - 1) / 2 AS rk FROM ({rows})) GROUP BY col, category HAVING count(*) >= 10 OR col = 'ALL'"""


def judged_sql(score: str, bins: tuple[int, int, int]) -> str:
    out = []
    for x, n in zip((score, "masj_complexity", "masj_num_reasoning_steps"), bins, strict=True):
        out += [hist_sql(f"histogram {x}", "j", x, n, "correct"), auc_sql(f"auc {x}", "j", x, "correct", ["category", "lvl", "steps"] if x == score else [])]
    return " UNION ALL ".join(f"({q})" for q in out)


NORMED = """CASE lvl WHEN 'high_school_and_easier' THEN 0.2 WHEN 'undergraduate' THEN 0.4 WHEN 'graduate' THEN 0.6 WHEN 'postgraduate' THEN 0.8 ELSE 0 END::DOUBLE AS masj_complexity,
CASE steps WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 ELSE 0 END::DOUBLE AS masj_num_reasoning_steps"""
_CALL = """h AS (SELECT *, list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(prompt), 2 * i + 1, 2))::INT) AS b FROM p),
r AS (SELECT *, 'Reasoned ' || b[18] || '. [[' || chr((97 + b[17] % 5)::INT) || ']]' AS response, 't' || b[19] AS thinking, chr((97 + b[17] % 5)::INT) AS letter, list_transform(b[1:16], lambda v: v / 32) AS e FROM h)"""
_OPTIONS = "chr(10) || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_name"
_SYSTEM = f"'You answer questions about ' || p_type || '. ' || $${_P['plain']}$$"


@query(f"""WITH p AS (SELECT p_partkey AS question_id, p_size, {_SYSTEM} || chr(10) || 'Question: ' || p_name || lower_options AS prompt FROM (SELECT *, chr(10) || chr(10) || 'Options:' || chr(10) || 'a. ' || p_brand || chr(10) || 'b. ' || p_type || chr(10) || 'c. ' || p_name AS lower_options FROM part)),
{_CALL}, m AS (SELECT *, list_max(e) AS m FROM r), x AS (SELECT *, list_transform(e, lambda v: exp(v - m)) AS x FROM m)
SELECT question_id, response, letter AS answer, round(-list_sum(list_transform(x, lambda v: v / list_sum(x) * ln(v / list_sum(x) + 1e-12))), 6) AS entropy_value, (list_position(e, m) - 1)::INT AS greedy_token, true AS valid, chr((97 + p_size % 3)::INT) = letter AS correct, NULL::VARCHAR AS error FROM x""")
def estimate_pipeline(spark, d):
    from lodespark.plans.pipelines import estimate

    p = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", "p_name").alias("options"), F.col("p_type").alias("subject"), (F.col("p_size") % 3).alias("answer_index"))
    return estimate(p, remote.offline_model())


_GOLD = "chr((65 + p_size % 3)::INT)"
_REVIEW = f"""'<|im_start|>system' || chr(10) || {_SYSTEM} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Question: ' || p_name || {_OPTIONS} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'hm ' || p_brand || '<|im_end|>' || chr(10)
|| '<|im_start|>user' || chr(10) || 'That is wrong; the right option is ' || {_GOLD} || '. Say where the reasoning went astray.' || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"""


@query(f"""WITH p AS (SELECT p_partkey, p_brand, p_type, {_GOLD} AS gold, 'A' AS branch, {_SYSTEM} || chr(10) || 'Question: ' || p_name || {_OPTIONS} AS prompt FROM part
UNION ALL SELECT p_partkey, p_brand, p_type, {_GOLD}, 'B', 'Question: ' || p_name || {_OPTIONS} || chr(10) || chr(10) || 'Right option: ' || {_GOLD} || chr(10) || 'Explain step by step why it is right.' FROM part
UNION ALL SELECT p_partkey, p_brand, p_type, {_GOLD}, 'C', {_REVIEW} FROM part), {_CALL}, l AS (SELECT *, CASE WHEN upper(letter) <= 'C' THEN upper(letter) ELSE 'E' END AS up FROM r)
SELECT branch, p_partkey::VARCHAR AS question_id, gold, p_type AS option_b, CASE WHEN upper(letter) <= 'C' THEN upper(letter) ELSE 'A' END AS answer, CASE WHEN branch = 'A' THEN CASE WHEN upper(letter) <= 'C' THEN upper(letter) ELSE 'A' END = gold END AS is_correct, thinking, response AS raw_response, CASE WHEN branch = 'C' THEN 'B' END AS previous_answer, NULL::VARCHAR AS error FROM l""")
def synthesis_pipeline(spark, d):
    """All three branches: answer, explain the right answer, review a wrong one. A letter beyond the options is looked
    for in the whole text, where the a of "Reasoned" comes first."""
    from lodespark.plans.pipelines import synthesise

    p = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", "p_name").alias("options"), F.col("p_type").alias("subject"), F.lit("").alias("answer"), (F.col("p_size") % 3).alias("answer_index"), F.lit("B").alias("previous_answer"), F.concat(F.lit("hm "), F.col("p_brand")).alias("previous_thinking"))
    out = None
    for branch in "ABC":
        one = synthesise(p, remote.offline_model(), branch, "offline")
        one = one.select("input.branch", "input.question_id", "input.gold", F.col("input.options")["B"].alias("option_b"), "output.answer", "output.is_correct", "output.thinking", "output.raw_response", "output.previous_answer", "output.error")
        out = one if out is None else out.unionByName(one)
    return out


ANALYSED = """d AS (SELECT doc_id AS question_id, CASE doc_id % 9 WHEN 0 THEN '0' WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE chr((97 + doc_id % 5)::INT) END AS answer, n_chars::DOUBLE AS entropy, quality AS correct, lang AS category FROM documents JOIN labels USING (doc_id)),
k AS (SELECT * FROM d WHERE regexp_full_match(answer, '[a-z]'))"""


@query(f"""WITH {JUDGED}, {ANALYSED}, u AS (SELECT * FROM d WHERE answer = '0'), j AS (SELECT k.*, lvl, steps, {NORMED} FROM k JOIN levels USING (question_id) WHERE rating >= 9 AND steps IS NOT NULL)
SELECT 'answers before' AS part, coalesce(answer, 'NULL') AS key, count(*)::DOUBLE AS value FROM d GROUP BY ALL UNION ALL SELECT 'answers after', answer, count(*) FROM k GROUP BY ALL
UNION ALL ({hist_sql("histogram unknown", "u", "entropy", 10, None)}) UNION ALL {judged_sql("entropy", (10, 4, 3))}""")
def standard_analysis(spark, d):
    from lodespark.plans.pipelines import standard_analysis

    i = F.col("doc_id")
    answer = F.when(i % 9 == 0, "0").when(i % 9 == 1, "A").when(i % 9 != 2, F.char(97 + i % 5))
    df = scored(spark, d).select(i.alias("question_id"), answer.alias("answer"), F.col("n_chars").cast("double").alias("entropy"), F.col("quality").alias("correct"), F.col("lang").alias("category"))
    return standard_analysis(df, _judged(spark, d), "demo", "answer", "correct", "entropy")


@query(f"""WITH {JUDGED}, c AS (SELECT doc_id AS question_id, quality AS correct, lang AS category, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 2 END::INT AS pos, CASE WHEN doc_id % 2 = 1 THEN 0.5 ELSE n_chars END::DOUBLE AS model_answer_entropy, CASE WHEN doc_id % 2 = 1 THEN 7 ELSE doc_id % 4 END AS tok FROM documents JOIN labels USING (doc_id)),
d AS (SELECT *, CASE WHEN tok < 3 THEN chr((97 + tok)::INT) ELSE '?' END AS answer FROM c WHERE pos <> -1), k AS (SELECT * FROM d WHERE answer <> '?'), j AS (SELECT k.*, lvl, steps, {NORMED} FROM k JOIN levels USING (question_id) WHERE rating >= 9 AND steps IS NOT NULL)
SELECT 'answer tokens' AS part, pos::VARCHAR AS key, count(*)::DOUBLE AS value FROM c GROUP BY ALL UNION ALL SELECT 'answers before', answer, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'answers after', answer, count(*) FROM k GROUP BY ALL UNION ALL {judged_sql("model_answer_entropy", (10, 10, 10))}""")
def cot_analysis(spark, d):
    from lodespark.plans.pipelines import cot_analysis

    i = F.col("doc_id")
    stat = lambda t: F.concat(F.lit('[{"token_idx": '), t.cast("string"), F.lit(', "token_prob": 0.6}, {"token_idx": 9, "token_prob": 0.4}]'))
    info = F.concat(F.lit("["), stat(i % 4), F.lit(", "), stat(F.lit(7)), F.lit("]"))
    df = scored(spark, d).select(i.alias("question_id"), F.when(i % 5 == 0, -1).otherwise(i % 2).cast("int").alias("ans_token_index"), info.alias("every_token_info"), F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit(", 0.5]")).alias("entropies"), F.col("quality").alias("correct"), F.col("lang").alias("category"))
    return cot_analysis(df, _judged(spark, d), "demo", "correct", lambda t: F.when(t < 3, F.char(97 + t.cast("long"))).otherwise("?"))


def token_stats(spark, d):
    """Events by user as evaluated generations: the first two tokens are the prompt."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value", (F.col("event_id") % 7 - 1).cast("double").alias("w"))))
    df = table(spark, d, "events").groupBy("user_id").agg(rows.alias("r"))
    mark = F.when(F.col("user_id") % 9 == 0, "none").otherwise("[[b]]")
    return df.select("user_id", F.col("r.event_type").alias("tokens"), F.col("r.value").alias("entropies"), F.col("r.w").alias("attn_importance"), mark.alias("decoded_pred"), F.lit("[[b]]").alias("decoded_label"), (F.col("user_id") % 7 > 0).alias("is_cot_eval"), (F.col("user_id") % 3 > 0).alias("is_correct"), F.lit(2).alias("input_len"), F.size("r").alias("seq_len"))


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t, list(value ORDER BY ts, event_id) AS h FROM events WHERE user_id % 9 > 0 AND user_id % 7 > 0 GROUP BY user_id HAVING count(*) > 2),
k AS (SELECT user_id, list_transform(list_filter(range(3, len(t) + 1), lambda i: t[i] <> 'signup'), lambda i: h[i]) AS h FROM s)
SELECT user_id, (user_id % 3 = 0)::INT AS y, round(list_avg(h), 6) AS unc_mean_ans, CASE WHEN len(h) >= 10 THEN round(list_max(h[-10:]), 6) END AS unc_tail10_max, round(len(list_filter(h, lambda x: x > thr)) / nullif(len(h), 0), 6) AS unc_frac_high_ans
FROM k, (SELECT quantile_cont(x, 0.75) AS thr FROM (SELECT unnest(h) AS x FROM k))""")
def reasoning_metrics(spark, d):
    from lodespark.plans.pipelines import reasoning_metrics

    m = reasoning_metrics(token_stats(spark, d), ["signup"], keep=["user_id"])
    return m.select("user_id", "y", *[r6(F.col(c)).alias(c) for c in ("unc_mean_ans", "unc_tail10_max", "unc_frac_high_ans")])


_TAIL_SQL = ", ".join(f"'unc_tail{k}_mean': list_avg(t{k}), 'unc_tail{k}_max': list_max(t{k}), 'unc_tail{k}_median': list_median(t{k})" for k in (1, 2, 3, 5, 10))


@query(f"""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t, list(value ORDER BY ts, event_id) AS h, list((event_id % 7 - 1)::DOUBLE ORDER BY ts, event_id) AS w FROM events WHERE user_id % 9 > 0 AND user_id % 7 > 0 GROUP BY user_id HAVING count(*) > 2),
i AS (SELECT user_id, h, w, list_filter(range(3, len(t) + 1), lambda i: t[i] <> 'signup') AS i FROM s),
k AS (SELECT user_id, list_transform(i, lambda i: h[i]) AS h, list_transform(i, lambda i: greatest(w[i], 0)) AS c, list_transform(range(1, len(i) + 1), lambda j: {{'n': -w[i[j]], 'i': j, 'h': h[i[j]]}}) AS z FROM i),
q AS (SELECT k.*, thr, list_sum(c) AS m, list_transform(list_sort(z)[1:5], lambda x: x.h) AS top, {", ".join(f"CASE WHEN len(h) >= {k} THEN h[-{k}:] END AS t{k}" for k in (1, 2, 3, 5, 10))} FROM k, (SELECT quantile_cont(x, 0.75) AS thr FROM (SELECT unnest(h) AS x FROM k))),
v AS (SELECT (user_id % 3 = 0)::INT AS y, unnest(map_entries(MAP {{'unc_mean_ans': list_avg(h), 'unc_median_ans': list_median(h), 'unc_max_ans': list_max(h), {_TAIL_SQL},
'unc_attn_mean_ans': CASE WHEN m <= 1e-12 THEN list_avg(h) ELSE list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i] * c[i])) / m END, 'unc_attn_top5_mean': list_avg(top), 'unc_attn_top5_max': list_max(top), 'unc_frac_high_ans': len(list_filter(h, lambda x: x > thr)) / nullif(len(h), 0),
'unc_frac_attn_high': CASE WHEN m > 1e-12 THEN list_sum(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] > thr THEN c[i] ELSE 0 END)) / m END}})) AS e FROM q),
u AS (SELECT y, e.key AS m, round(e.value, 9) AS v FROM v), r AS (SELECT m, y, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2 AS rk FROM u WHERE v IS NOT NULL)
SELECT m AS metric, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) AS n_valid, count(*) FILTER (y = 1) AS n_incorrect, count(*) FILTER (y = 0) AS n_correct FROM r GROUP BY m HAVING count(*) >= 10 AND count(DISTINCT y) = 2""")
def reasoning_table(spark, d):
    from lodespark.plans.pipelines import reasoning_table

    return reasoning_table(token_stats(spark, d), ["signup"], 9).withColumn("auc", r6(F.col("auc")))


@query()
def ml_oof_auc(spark, d):
    from lodespark.operators import ml

    df = attention(spark, d).select("user_id", (F.col("user_id") % 3 == 0).cast("int").alias("label"), *ATTENTION)
    return ml.fold_auc(df, {"logistic": ml.logistic(ATTENTION), "boosted": ml.boosted(ATTENTION)}, "user_id")
