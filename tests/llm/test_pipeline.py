import os
import re

import pytest

DIR = "/root/testdata/sf0.001"
if not os.path.exists(DIR):
    pytest.skip("no test data", allow_module_level=True)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as cp
    from lodespark.llm import bpe, quality

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    keep = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.keep}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in keep}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in rows}
    ids = sorted(rows)
    changed = True
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    rows = {i: t for i, t in rows.items() if root[i] == i}
    seen, texts = set(), {}
    for i in sorted(rows):
        parts = re.findall(r"[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*", rows[i])
        lead = rows[i][: len(rows[i]) - len("".join(parts))]
        w, later = [p.rstrip(" \t\n\r\x0b\x0c") for p in parts], set()
        for s in range(len(w) - 49):
            g = tuple(w[s : s + 50])
            if g in seen:
                later.update(range(s, s + 50))
            seen.add(g)
        if not w or len(later) < len(w):
            texts[i] = lead + "".join(p for k, p in enumerate(parts) if k not in later)
    bench = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = {tuple(b[k : k + 13]) for b in bench for k in range(max(1, len(b) - 12))}
    clean = {}
    for i, t in texts.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        if not any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12)):
            clean[i] = t
    got = cp.run(spark, DIR)
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]
    got = bpe.decode_documents(got)
    assert {r.doc_id: r.text for r in got.collect()} == clean and len(clean) > 50


def test_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_registered(spark):
    import __spark_entry__ as e

    q = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and set(e.oracle_sql()) <= set(q)


def edge_case_folder(spark, path, docs):
    """A folder of the tables that run() reads, with these documents."""
    docs.write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_pipeline_edge_cases(spark, tmp_path):
    """Null, empty, repeated, very long rows, rows without an id, rows of one id, columns with clashing names."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    schema = docs.select("doc_id", "text").schema
    long_ = " ".join(f"{w} and the" for w in "house river tree stone road field garden morning winter summer".split() for _ in range(9000))
    some = docs.filter("lang = 'en' AND n_chars BETWEEN 500 AND 5000").orderBy("doc_id").first()
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, long_), (None, None), (None, "no id here"), (some.doc_id, some.text), (some.doc_id, "other words under the same id")]
    more = spark.createDataFrame(odd, schema)
    rows = docs.unionByName(more, allowMissingColumns=True).selectExpr("*", "1 AS ver", "2 AS __gone", "3 AS __p", "4 AS __cuts", "5 AS keep", "6 AS word", "7 AS grp", "8 AS bucket", "9 AS blob")
    at = edge_case_folder(spark, tmp_path / "odd", rows)
    step = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        before, step = step.count(), cp.cut(stage(spark, step, at))
        assert step.columns == rows.columns and step.filter("ver <> 1 OR __gone <> 2 OR __p <> 3 OR __cuts <> 4 OR blob <> 9").count() == 0
        assert 0 < step.count() <= before
    got = cp.STAGES[-1][1](spark, step, at).select("doc_id").collect()
    assert not {r.doc_id for r in got} & {10**6, 10**6 + 1, 10**6 + 2} and all(r.doc_id is not None for r in got)
    at = edge_case_folder(spark, tmp_path / "none", docs.limit(0))
    assert cp.run(spark, at).count() == 0
