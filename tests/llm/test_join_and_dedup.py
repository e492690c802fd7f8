"""N-gram join, components and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from sparkrecon.llm import ngram_join, substring_dedup
from sparkrecon.llm.components import components
from tests.llm import brute


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def copies(seed: int, n: int):
    """Exact and near copies, a shared passage, quotes, short and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    bases, passages = [some(rng.choice([3, 8, 60, 120])) for _ in range(12)], [some(60), some(90)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.4:
            text = some(30) + rng.choice(passages) + some(rng.choice([0, 20]))
        rows.append((1000 + i, " ".join(text), f"s{i % 3}"))
    return rows + brute.ODD


@pytest.mark.parametrize("group, cold", [(256, 2048), (6, 10)])
def test_components_of_links(spark, monkeypatch, group, cold):
    """Small groups and hot counters take the block and the second-round paths."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "COLD", cold)
    rows = copies(1, 220)
    same(ngram_join.jaccard_components(brute.frame(spark, rows)).collect(), brute.jaccard_components(rows))


def test_one_of_each_group_stays(spark):
    rows = copies(2, 60)
    kept = ngram_join.one_of_each(brute.frame(spark, rows))
    assert kept.columns == brute.frame(spark, rows).columns
    # rows are the nodes: equal ones are one, and rows of one id with texts of their own all stay
    single = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    named = [(i, text) for i, (_, text) in enumerate(single)]
    want = [single[c][0] for c in {c for _, _, c in brute.jaccard_components(named)}]
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(want)
    assert kept.filter("doc_id is null").count() == 1


def test_rows_of_one_id_go_only_when_they_link(spark):
    rows = [(i, f"{i} {j} " + " ".join(f"w{i}x{j}x{k}" for k in range(20)), f"s{j}") for i in range(10) for j in range(4)]
    long = " ".join(f"v{k}" for k in range(60))
    rows += [(20, "a text in two sources", "t"), (20, "a text in two sources", "s"), (21, None, "t"), (21, "", "t")]
    rows += [(22, long, "t"), (22, long + " end", "t"), (23, long, "t"), (23, "an own text of the id", "t")]
    want = rows[:40] + [(21, None, "t"), (21, "", "t"), (23, "an own text of the id", "t")]
    for ordered in (rows, rows[::-1]):
        kept = ngram_join.one_of_each(brute.frame(spark, ordered).coalesce(1)).select("doc_id", "text", "source").collect()
        linked = [tuple(r) for r in kept if r["doc_id"] in (20, 22)]
        same([r for r in kept if r["doc_id"] not in (20, 22)], want)
        assert sorted(r[0] for r in linked) == [20, 22]


def test_one_of_each_passes_any_column(spark):
    from pyspark.sql import functions as F

    docs = brute.frame(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e f", "t")])
    for name in ("node", "row", "order", "id", "first", "a.b"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("source")))
    kept = ngram_join.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted((r["doc_id"], r["m"]["k"], r["node"]) for r in kept.collect()) == [(1, "s", "clash"), (2, "t", "clash")]


def test_trie_join_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 4000, 60)) for _ in range(4)]
    sets = [np.unique(np.append(rng.permutation(b)[:-3], rng.integers(0, 4000, 3))).astype(np.uint64) for b in base for _ in range(9)]
    trie = ngram_join.join_group(list(range(len(sets))), sets)
    for a in range(len(sets)):
        for b in range(a):
            if ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                assert trie.find(a) == trie.find(b)
    for a, b in trie.links:
        assert ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(100, i) for i in range(101, 160)] + [(7, None), (9, 9)]
    df = spark.createDataFrame(chain + hub, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_are_removed(spark, monkeypatch, hot):
    """A low limit sends every shared anchor through the window aggregation."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = copies(4, 160)
    got = substring_dedup.without_repeats(brute.frame(spark, rows)).collect()
    same(got, brute.without_repeats(rows, substring_dedup.WINDOW))


def test_automaton_reports_earlier_windows():
    rng = random.Random(5)
    segments = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))], rng.randrange(9)) for _ in range(60)]
    first: dict = {}
    for words, doc in segments:
        for i in range(len(words) - 3):
            k = tuple(words[i : i + 4])
            first[k] = min(first.get(k, doc), doc)
    want = [[i for i in range(len(w) - 3) if first[tuple(w[i : i + 4])] < d] for w, d in segments]
    assert substring_dedup.earlier_windows(segments, 4) == want


def test_empty_tables(spark):
    empty = brute.frame(spark, brute.ODD).limit(0)
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0


def test_probes_of_a_frozen_trie_equal_single_tests():
    import numpy as np

    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 5000, 80))
    sets = [np.unique(np.append(rng.permutation(base)[: -int(rng.integers(0, 25))or None], rng.integers(0, 5000, 4))).astype(np.uint64) for _ in range(60)]
    asks = [i % 3 == 0 for i in range(60)]
    trie = ngram_join.join_group(list(range(60)), sets, asks)
    parent = list(range(60))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(60):
        for b in range(60):
            if asks[a] and not asks[b] and ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                parent[find(a)] = find(b)
    assert trie.links
    for a in range(60):
        for b in range(60):
            assert (find(a) == find(b)) == (trie.find(a) == trie.find(b))


def test_a_long_text_leaves_groups_of_short_passages(spark):
    """Document 100 links with 101 and shares one shingle with each of six other linked pairs."""
    n, keys = 400, lambda doc: [1000 * doc + k for k in range(120)]
    heads = [(doc, n, keys(doc - doc % 2)) for doc in [*range(12), 100, 101]]
    heads[-2] = (100, n, keys(100) + [1000 * doc for doc in range(0, 12, 2)])
    groups = {tuple(r) for r in ngram_join.hub_groups(spark.createDataFrame(heads, "doc_id long, n long, head array<long>")).collect()}
    assert groups == {(doc - doc % 2, doc) for doc in [*range(12), 100, 101]}


def test_rows_of_other_ids_are_not_moved(spark):
    from sparkrecon.llm.id_table import likely

    ids = spark.range(0, 3000, 100)
    left = {r["doc"] for r in likely(spark.range(3000).withColumnRenamed("id", "doc"), "doc", ids).collect()}
    assert set(range(0, 3000, 100)) <= left and len(left) < 300
