"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from terravox.llm import common, exact_dedup, near_dedup, words
from terravox.llm.components import components

from . import helpers
from .helpers import SF, awkward, empty, lower, shingle_set


def test_trie_holds_what_a_dictionary_holds():
    rng = random.Random(2)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(2000)]
    for largest in (True, False):
        trie, want = exact_dedup.PatriciaTrie(largest), defaultdict(list)
        for i, k in enumerate(keys):
            trie.insert(k, None if i % 7 == 0 else i)
            want[k].append(None if i % 7 == 0 else i)
        best = lambda v: (max if largest else min)([x for x in v if x is not None], default=None)  # noqa: B023, E731
        assert {k: (b, n) for k, b, n in trie.terminals()} == {k: (best(v), len(v)) for k, v in want.items()}


def test_trie_spills_subtrees_and_loses_nothing():
    trie, out = exact_dedup.PatriciaTrie(budget=5_000), defaultdict(int)
    for i in range(400):
        trie.insert(f"{i % 90:03d}-{'x' * 50}".encode(), i)
        for k, _, n in trie.spill():
            out[k] += n
    assert trie.held <= 5_000 and out
    for k, _, n in trie.terminals():
        out[k] += n
    assert sum(out.values()) == 400 and len(out) == 90


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    out = []
    for r in rows:
        own = groups[lower(r.text)]
        keep = max((i for i in own if i is not None), default=None)
        out.append((r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(lower(r.text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    for docs in (awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == brute_exact(docs.collect())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_keep_owners_keeps_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.keep_owners(docs)
    assert kept.columns == docs.columns
    want = {i for i, keep, *_ in brute_exact(docs.collect()) if i is None or i == keep}
    assert {r.doc_id for r in kept.collect()} == want


def test_shingles_are_those_of_the_words():
    rng = random.Random(4)
    text = ["".join(rng.choice("aAb\tc é\n\x0b.") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in text])])
    for k in (1, 2, 5):
        got = words.shingles(*words.words(data, offsets), k)
        assert [len(s) for s in got] == [len(shingle_set(t, k)) for t in text]
        sets = [shingle_set(t, k) for t in text]
        for a in range(0, 60):
            for b in range(a):
                assert len(np.intersect1d(got[a], got[b])) == len(sets[a] & sets[b])


def brute_near(rows, k):
    sets = {r.doc_id: shingle_set(r.text, k) for r in rows if r.doc_id is not None}
    comp = helpers.components(sets)
    return sorted(((r.doc_id, len(shingle_set(r.text, k)), None if r.doc_id is None else comp[r.doc_id], r.doc_id is None or comp[r.doc_id] == r.doc_id) for r in rows), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(spark, k):
    for docs in (awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        assert sorted(map(tuple, near_dedup.classes(docs, k).collect()), key=str) == brute_near(docs.collect(), k)


def test_near_dedup_of_one_large_family(spark):
    """300 edits of one text at all distances from it: a crowded region, with links at its edge."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = base[:]
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.classes(docs, 2).collect()), key=str) == brute_near(docs.collect(), 2)


def test_near_dedup_of_one_template(spark, monkeypatch):
    """Pages of one template whose minima are mostly the template's: regions over OUTSIDE lose no link."""
    monkeypatch.setattr(near_dedup, "OUTSIDE", 16)
    template = [f"t{i}" for i in range(94)]
    rows = []
    for i in range(800):
        own = [f"p{i // 2}", *(f"d{i}x{j}" for j in range(11))]
        rows.append((i, " ".join(template + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(docs.collect(), 5)
    assert len({r[2] for r in want}) == 400
    assert sorted(map(tuple, near_dedup.classes(docs, 5).collect()), key=str) == want


def test_near_dedup_of_nothing(spark):
    assert near_dedup.classes(empty(spark)).count() == 0
    docs = awkward(spark)
    kept = near_dedup.keep_first_of_each(docs, 5)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in brute_near(docs.collect(), 5))


def several_texts(spark):
    """A doc_id with several texts, repeated rows, and a third of all rows equal."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "x"), (1, "unique"), (2, "X"), (3, long), (1, long + " tail"), (4, "other " + long.replace("w", "v")), (1, "other " + long.replace("w", "v") + " end"), (4, "other " + long.replace("w", "v"))]
    return spark.createDataFrame(rows + [(100 + i, "copy of it all") for i in range(4)], "doc_id long, text string")


def test_a_doc_id_with_several_texts(spark):
    docs = several_texts(spark)
    assert sorted(map(tuple, exact_dedup.keep_owners(docs).collect()), key=str) == sorted([tuple(r) for r in docs.collect() if tuple(r) not in [(1, "x"), *((i, "copy of it all") for i in (100, 101, 102))]], key=str)
    sets = [(r.doc_id, r.text, shingle_set(r.text, 2)) for r in docs.collect()]
    comp = helpers.components({n: s for n, (*_, s) in enumerate(sets)})
    least = {c: min(sets[n][0] for n in comp if comp[n] == c) for c in comp.values()}
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(docs, 2).collect())
    assert got == sorted((i, len(s), least[comp[n]], i == least[comp[n]]) for n, (i, _, s) in enumerate(sets))
    kept = sorted(map(tuple, near_dedup.keep_first_of_each(docs, 2).collect()))
    assert kept == sorted((i, t) for n, (i, t, _) in enumerate(sets) if i == least[comp[n]])


def test_large_groups_are_joined_like_others(spark, monkeypatch):
    """Hot groups go by broadcast: same result with a bound that makes all of them hot, some, or none."""
    docs = spark.createDataFrame([(i, ["hot", "HOT", None][i % 3] if i < 600 else f"t{i // 3}") for i in range(1000)], "doc_id long, text string")
    for hot in (1, 5, 1000):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == brute_exact(docs.collect())
        star = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(500, 501)], "a long, b long")
        assert {r.node: r.component for r in components(star).collect()} == {**{i: 0 for i in range(1, 400)}, 501: 500}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + [(5, 5), (2000, 2001), (2000, 2001)]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
