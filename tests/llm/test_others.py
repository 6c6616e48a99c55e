"""WARC, sharding, nearest neighbours, pipeline and the entry module."""

import base64
import gzip
import hashlib
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.llm import ann, sharding, warc

from .helpers import SF, awkward, empty, shingle_set

ROOT = Path(__file__).resolve().parents[2]
PAGES = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n"), (6, "u", "x" * 300_000), (7, "", "\r\n\r\n"), (None, "u", "<p>é</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, kind string")
    rows = warc.captures(pages, least).collect()
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        owner = max((x for x in groups[html or ""] if x is not None), default=None)
        again = len(data) >= least and i is not None and owner != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", owner if again else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert warc.captures(pages.where("false")).count() == 0


def test_warc_of_repeated_rows_in_several_partitions(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (3, "u", "c")]
    for i in (0, 1):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    assert pages.rdd.getNumPartitions() == 2
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(pages).collect())
    sha = lambda html: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    want = [(1, sha("a"), "revisit", 2), (1, sha("b"), "response", None), (2, sha("a"), "response", None), (3, sha("c"), "response", None)]
    assert got == sorted(want * 2, key=lambda r: r[:3])


def test_warc_loses_no_row(spark):
    """Equal rows in many partitions, one page_id with several payloads, and record ids that revisits name."""
    rows = [(5, "u", "A")] * 6 + [(5, "u", "AAA"), (5, "u", "BBB"), (9, "u", "AAA"), (5, "u", "BBB"), (None, "u", "BBB"), (None, "v", "BBB"), (None, "v", None)]
    for parts in (1, 6):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(pages).collect()), key=str)
        want = [(5, 1, "response", None)] * 6 + [(5, 3, "revisit", 9), (9, 3, "response", None)] + [(5, 3, "response", None)] * 2 + [(None, 3, "response", None)] * 2 + [(None, 0, "response", None)]
        assert got == sorted(want, key=str)
        records = warc.read_archives(spark, warc.write_archives(pages)).collect()
        ids = [r.record_id for r in records]
        assert len(ids) == len(set(ids)) == 3 * len(rows)
        assert {r.refers_to for r in records if r.refers_to} <= {r.record_id for r in records if r.kind == "response"}


def test_warc_transactions_are_whole(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    path = warc.write_archives(pages, f"file://{tmp_path}/out")
    records = warc.read_archives(spark, path, with_payload=True)
    assert records.count() == 12
    found = warc.assemble(records).collect()
    assert len(found) == 4 and all(r.request.kind == "request" and r.metadata.kind == "metadata" for r in found)
    assert {r.response.payload for r in found if r.response.kind == "response"} == {"<p>é</p>".encode(), b""}
    lonely = warc.assemble(records.where("kind <> 'metadata'")).collect()
    assert all(r.metadata is None for r in lonely)


def test_warc_parser_reads_members_and_rejects_cut_archives():
    one = b"".join(x + b"\r\n" for x in warc.transaction(1, "http://x/", b"payload"))
    members = gzip.compress(one[:0]) + gzip.compress(one)
    assert [h["warc-type"] for h, _ in warc.parse(members)] == ["response", "request", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse(one[:-60]))


def test_shards(spark):
    for docs, n in ((awkward(spark), 3), (spark.read.parquet(f"{SF}/documents.parquet"), 8)):
        rows, given = sharding.byte_shards(docs, n).collect(), docs.collect()
        text = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given]
        assert sorted((tuple(r)[:3] for r in rows), key=str) == sorted(text, key=str)
        total, most = sum(t[1] for t in text), max(t[1] for t in text)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(0 <= s < n for s in by) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
            assert abs(sum(r.size for r in own) - total / n) <= most + 0.01 * total / n
    assert sharding.byte_shards(empty(spark)).count() == 0


def brute_nearest(rows, k=20):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in good:
        if q % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(good[q].tolist(), v.tolist(), strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (320, [1.0, 2.0, 3.0]), (321, [3.0, 2.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = sorted(map(tuple, ann.nearest(table).collect()))
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()])
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)
    assert ann.nearest(table.where("false")).count() == 0


def test_nearest_of_doubles_and_repeated_ids(spark, monkeypatch):
    """Several groups and stripes, components that float32 can't hold, and ids that stand there twice."""
    for name, size in (("QUERY_BLOCK", 2), ("BLOCK", 7), ("GROUP", 2), ("TILES", 3)):
        monkeypatch.setattr(ann, name, size)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(20, [0.5] * 6), (33, [9.0] * 6), (33, [9.0] * 6), (400, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0]), (401, [1e-300, 1e-12, 0.0, 0.0, 0.0, 0.0]), (402, [1.0 + 1e-12] * 6), (403, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, ann.nearest(table).collect()))
    once = {}
    for i, v in rows:
        once[i] = min(once.get(i, v), v)
    want = brute_nearest(sorted(once.items()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)
    assert all(len({v for q, _, v, _ in got if q == i}) == 20 for i in (20, 400))


def test_quantised_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 16)).astype(np.float32), (rng.normal(size=(50, 16)) * 100).astype(np.float32)
    (ca, sa, na, ra), (cb, sb, nb, rb) = ann.quantise(a), ann.quantise(b)
    near = (ca.astype(float) @ cb.astype(float).T) * sa[:, None] * sb[None, :]
    slack = na[:, None] * rb[None, :] + ra[:, None] * (nb + rb)[None, :]
    assert (np.abs(near - a.astype(float) @ b.astype(float).T) <= slack * (1 + 1e-9) + 1e-9).all()


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for n, (_, stage) in enumerate(C.STAGES[:-1]):
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and all(before[i] == r for i, r in after.items())
        if n == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            known = [i for i in before if i in labels]
            assert sum((i in after) == (labels[i] == 1) for i in known) >= 0.97 * len(known)
        if n == 1:
            assert len(after) == len(before)  # all of these are in a language
        if n == 2:
            best = {}
            for i, r in before.items():
                key = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
                best[key] = max(best.get(key, i), i)
            assert set(after) == set(best.values())
        if n == 3:
            from .helpers import components

            comp = components({i: shingle_set(r.text, 5) for i, r in before.items()})
            assert set(after) == {i for i, c in comp.items() if i == c}
    assert {r.doc_id for r in C.STAGES[-1][1](spark, kept, SF).collect()} == set(after)
    assert {r.doc_id for r in C.run(spark, SF).select("doc_id").collect()} == set(after)


def test_pipeline_of_awkward_rows(spark):
    import corpus_pipeline as C

    docs = awkward(spark)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0
    none = empty(spark)
    for _, stage in C.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            want = con.sql(sql).df()
            got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
            order = list(want.columns)
            a, b = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
            same = lambda x, y: np.isclose(x, y, rtol=1e-13, equal_nan=True) if x.dtype.kind == y.dtype.kind == "f" else (x == y) | (x.isna() & y.isna())
            assert len(a) == len(b) and all(same(a[c], b[c]).all() for c in order), name


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the two folders and the pipeline still imports and has its other queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_thinned_keeps_all_that_match(spark):
    from terravox.llm.id_filter import thinned

    rows = spark.range(5000).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    ids = spark.range(0, 5000, 50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in thinned(rows, "doc_id", ids).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 150 and None not in got
    assert thinned(rows, "doc_id", ids.where(F.lit(False))).count() == 0
