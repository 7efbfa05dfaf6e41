import base64
import gzip
import hashlib
import os
import random

import pytest
from lodespark.llm import ring, warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("n,shards,nodes,capacity", [(500, 7, 5, "1.05"), (64, 8, 3, "1"), (3, 10, 2, "1.25"), (1000, 3, 1, "1.01"), (200, 1, 4, "1.1")])
def test_ring_equals_the_rule(spark, n, shards, nodes, capacity):
    docs = spark.createDataFrame([(k * 37, "t") for k in range(n)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in ring.assign(docs, shards, nodes, capacity).collect()}
    assert got == ring.brute_force([k * 37 for k in range(n)], shards, nodes, capacity)
    cap = -(-n * ring.Fraction(capacity) // shards)
    assert max(list(got.values()).count(s) for s in range(shards)) <= cap


def test_ring_moves_few(spark):
    ids = list(range(4000))
    before, after = ring.brute_force(ids, 16, 32, "1.25"), ring.brute_force(ids, 17, 32, "1.25")
    assert sum(before[k] != after[k] for k in ids) < 0.3 * len(ids)


def test_ring_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS arc", "2 AS shard", "3 AS place")
    rows = ring.assign(docs, 4, 4).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and rows[0].asDict().keys() == {"doc_id", "home", "shard"}
    assert ring.assign(docs.limit(0)).count() == 0


def pages(rng, n):
    return [(k, f"http://x/{k}?ü", "<p>" + "".join(rng.choice("abc é\n") for _ in range(rng.randrange(2000))) + "</p>") for k in range(n)]


def test_whole_archives_round_trip(spark):
    rng = random.Random(1)
    rows = pages(rng, 70) + [(70, None, None), (71, "u", ""), (None, "n", "x"), (73, " a\\x\r\n\x00é", "x"), (5, "again", "WARC/1.0\r\n\r\n"), (5, "again", "WARC/1.0\r\n\r\n"), (72, "long", "é" * 400_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("page_id", "url", "html", "1 AS kind", "2 AS file_no")
    got = warc.salvage_pages(df, per_file=16, fault_rate=0.0).collect()
    assert all(r.kind == "record" and r.reason is None for r in got)
    key = lambda r: str(r)
    assert sorted(((r.page_id, r.url, r.html) for r in got), key=key) == sorted(rows, key=key)


def test_faults_lose_only_what_they_hit(spark):
    rng = random.Random(2)
    rows = pages(rng, 400)
    got = warc.salvage_pages(spark.createDataFrame(rows, PAGES), per_file=32, fault_rate=0.2).collect()
    faults = {k: warc.fault_of(k, 0.2) for k, _, _ in rows}
    assert all(list(faults.values()).count(f) > 5 for f in range(5))
    records = {r.page_id: r.html for r in got if r.kind == "record"}
    assert records == {k: h for k, _, h in rows if faults[k] in (0, 3)}
    # records and gaps tile each archive, and the gaps are just the damaged bytes
    files = {r.file_no: bytes(r.content) for r in warc.archives(spark.createDataFrame(rows, PAGES), 32, 0.2).collect()}
    damaged = 0
    for no, content in files.items():
        at = 0
        for r in sorted((r for r in got if r.file_no == no), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == len(content)
    for k, u, h in rows:
        data = warc.record(k, u, h)
        whole = warc.member(data) if k // 32 % 2 == 0 else data
        out = warc.damage(whole, faults[k])
        damaged += len(out) if faults[k] in (1, 2, 4) else len(out) - len(whole)
    assert damaged == sum(r.length for r in got if r.kind == "gap")


def test_salvage_of_fragments():
    rec = [warc.record(k, "u", "x" * k * 100) for k in range(4)]
    read = lambda data, *a: [(e[0], e[1], e[2]) for e in warc.salvage(lambda o, n: data[o : o + n], len(data), *a)]
    assert read(b"") == []
    assert read(b"junk") == [("gap", 0, 4)]
    data = warc.member(rec[1]) + rec[2] + b"\x1f\x8b\x08" + rec[3][:-3]
    a, b = len(warc.member(rec[1])), len(rec[2])
    assert read(data) == [("record", 0, a), ("record", a, b), ("gap", a + b, len(data) - a - b)]
    for at in range(len(data) + 1):  # two readers of two parts see what one sees
        assert read(data, 0, at) + read(data, at, len(data)) == read(data)


def standard(k, rng, zipped):
    """Records as common crawlers write them."""
    page = f"<p>{k} é</p>".encode() * rng.randrange(1, 40)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{k}>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Target-URI: http://a/\\x", "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>", "X-Long: a", "  b", f"WARC-Payload-Digest: sha1:{digest(page)}", f"WARC-Block-Digest: {['sha1:' + digest(block).lower(), 'sha256:' + hashlib.sha256(block).hexdigest().upper(), 'md5:' + hashlib.md5(block).hexdigest(), 'blake9:zz'][k % 4]}", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return (gzip.compress(data) if zipped else data), page.decode()


@pytest.mark.parametrize("zipped", [False, True])
def test_standard_archives_and_mutations(zipped, monkeypatch):
    rng = random.Random(7)
    made = [standard(k, rng, zipped) for k in range(12)]
    data = b"".join(d for d, _ in made)
    read = lambda data: [warc._row(0, e) for e in warc.salvage(lambda o, n: data[o : o + n], len(data))]
    rows = read(data)
    assert [(r[0], r[6]) for r in rows] == [("record", p) for _, p in made] and all(r[5] == "http://a/\\x" and r[4] is None for r in rows)
    wrong = data.replace(b"<p>3 ", b"<p>4 ", 1)
    assert zipped or [r[7] for r in read(wrong) if r[0] == "gap"] == ["digest mismatch"]
    for _ in range(150):
        bad = bytearray(data)
        for _ in range(rng.randrange(1, 8)):
            i = rng.randrange(len(bad))
            bad[i : i + rng.choice([0, 1, 1, 40])] = rng.choice([b"", b"\xff", b"9" * 30, b"\r\n", b"WARC/1.0\r\n", b"<urn:page:abc>"])
        rows = read(bytes(bad))
        assert sum(r[3] for r in rows) == len(bad)
    huge = b"WARC/1.0\r\nContent-Length: 99999999999999\r\n\r\n"
    assert [(r[0], r[7]) for r in read(huge + made[0][0])] == [("gap", "too large"), ("record", None)]
    assert read(b"WARC/1.0\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n")[0][0] == "gap"
    monkeypatch.setattr(warc, "MAX_RECORD", 1000)
    bomb = gzip.compress(b"WARC/1.0\r\n" + b"x" * 10_000_000)
    assert [(r[0], r[7]) for r in read(bomb)] == [("gap", "too large")]


def test_pages_without_an_id(spark):
    rows = [(None, f"u{k}", "x") for k in range(40)]
    got = warc.salvage_pages(spark.createDataFrame(rows, PAGES), per_file=8, fault_rate=0.0).collect()
    assert sorted(r.url for r in got) == sorted(u for _, u, _ in rows) and len({r.file_no for r in got}) > 2


def test_read_warc_in_splits(spark, tmp_path):
    rng = random.Random(3)
    rows = pages(rng, 60)
    paths = []
    for r in warc.archives(spark.createDataFrame(rows, PAGES), 20, 0.1).collect():
        paths.append(os.path.join(tmp_path, f"{r.file_no}.warc"))
        with open(paths[-1], "wb") as f:
            f.write(r.content)
    open(os.path.join(tmp_path, "empty.warc"), "w").close()
    paths.append(os.path.join(tmp_path, "empty.warc"))
    whole = {(r.kind, r.page_id, r.offset, r.length) for r in warc.read_warc(spark, paths).collect()}
    split = [(r.kind, r.page_id, r.offset, r.length) for r in warc.read_warc(spark, paths, 1500).collect()]
    assert set(split) == whole and len(split) == len(whole)


def test_empty_tables(spark):
    assert warc.salvage_pages(spark.createDataFrame([], PAGES)).count() == 0
    assert warc.read_archives(spark.createDataFrame([(1, None), (2, bytearray())], "file_no long, content binary")).count() == 0
