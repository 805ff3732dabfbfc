"""The Jaccard join against brute force over all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from freshet.llm import ngram_join


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(1, len(words)))))


def brute(rows):
    """{row number: (class id, links)} of (doc_id, text) rows."""
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {i: (least[find(i)], links[i]) for i in range(len(rows))}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = rng.choice(rows).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.7:
            text = passage + " " + " ".join(word() for _ in range(rng.randrange(5, 150)))
        else:
            text = " ".join(word() for _ in range(rng.randrange(1, 200)))
        rows.append(text)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "small", "block"), [(1, 64, 256), (2, 3, 5), (3, 2, 2)])
def test_join_equals_brute_force(spark, seed, small, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, small=small, block=block).collect()}
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, block=64).collect()}
    assert got == brute(rows)


def near_copies(rng, base, n, most):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def test_pivots_decide_on_near_copies_and_leave_the_rest_to_blocks(spark, monkeypatch):
    """Copies with an edit or two need no comparison; two clusters and looser copies get exact counts all the same."""
    compared = []
    real = ngram_join.decided

    def decided(*args):
        sure, met = real(*args)
        compared.append(met.count())
        return sure, met

    monkeypatch.setattr(ngram_join, "decided", decided)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = list(enumerate(near_copies(rng, base, 200, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, block=32).collect()}
    assert got == brute(rows) and compared == [0]
    other = base[:140] + [f"v{i}" for i in range(12)]
    rows = list(enumerate([*near_copies(rng, base, 120, 5), *near_copies(rng, other, 120, 3)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, block=16).collect()}
    assert got == brute(rows) and compared[1] > 0


def test_loose_copies_meet_few_others(spark, monkeypatch):
    """Looser copies than any link allows are compared with none, and the others by strata of a bounded number of sets, not ring by ring."""
    compared = []
    real = ngram_join.decided

    def decided(*args):
        sure, met = real(*args)
        compared.append(met.count())
        return sure, met

    monkeypatch.setattr(ngram_join, "decided", decided)
    rng = random.Random(6)
    rows = list(enumerate(near_copies(rng, [f"w{i}" for i in range(150)], 400, 20)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, block=64).collect()}
    assert got == brute(rows)
    assert 0 < compared[0] < 4 * 400


def test_distances_from_a_pivot_are_rounded_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40), dtype=np.uint64)) for _ in range(50)]
    value, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    of = np.repeat(np.arange(50), sizes)
    for pivot in sets[:10]:
        down, up = ngram_join.distance_rings(value, of, sizes, pivot)
        exact = [1 - len(set(x.tolist()) & set(pivot.tolist())) / len(set(x.tolist()) | set(pivot.tolist())) for x in sets]
        assert all(d / 100 <= e + 1e-12 and e - 1e-12 <= u / 100 and u - d <= 1 for d, u, e in zip(down, up, exact))
    assert 1 <= len(ngram_join.pivots_of(value, of, sizes)) <= ngram_join.PIVOTS


def test_runs_follow_from_the_recall():
    assert ngram_join.missed(ngram_join.runs_for(0.9999)) <= 1e-4 < ngram_join.missed(ngram_join.runs_for(0.9999) - 1)
    rng = random.Random(8)

    def together(depth):
        return depth == 0 or any(rng.random() < 0.8 and together(depth - 1) for _ in range(1 + (rng.random() < 0.25)))

    lost = sum(not (rng.random() < 0.8 and together(3)) for _ in range(20000)) / 20000
    assert abs(lost - (ngram_join.missed(2) / ngram_join.missed(1))) < 0.02  # the second run starts with one coordinate


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_recall_on_whole_documents(spark):
    """Every link that brute force finds among the documents of sf0.01, by an index of their n-grams, is counted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: grams(r.text) for r in docs.select("doc_id", "text").collect()}
    index, links = {}, dict.fromkeys(sets, 0)
    for i, held in sets.items():
        for gram in held:
            index.setdefault(gram, []).append(i)
    shared = {}
    for ids in index.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs).collect()}
    assert got == links and sum(links.values()) > 100


def test_other_columns_may_have_any_name(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, 10, 20, 30, "a"), (2, near + " x", 11, 21, 31, "b"), (3, None, 12, 22, 32, "c"), (None, "z", 13, 23, 33, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, _row long, _id long, `a.b` string")
    out = ngram_join.deduplicated(df)
    assert out.columns == df.columns and sorted(r["row"] for r in out.collect()) == [10, 12, 13]
    assert all((r["row"], r["_row"], r["_id"]) == (r["row"], r["row"] + 10, r["row"] + 20) for r in out.collect())


def test_cases(spark, docs, no_docs, texts):
    rows = ngram_join.join(docs.unionByName(docs)).collect()
    assert len(rows) == 2 * len(texts)
    twice = [(i, t) for i, t in enumerate(texts) for _ in range(2)]
    expected = {doc_id: want for (doc_id, _), want in zip(twice, brute(twice).values())}
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == expected
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if expected[i][0] == i]
    assert ngram_join.deduplicated(no_docs).count() == 0
    no_id = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(no_id).collect()} == {(None, 3, 2), (3, 3, 2)}


def test_one_row_of_a_class_stays_with_tied_or_null_ids(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(7, near), (7, near + " x"), (9, near + " y"), (None, near + " z"), (None, near + " z")]
    rows += [(None, "other " + near.replace("w", "v") + end) for end in ("", " x", " y")]
    rows += [(7, ""), (7, " "), (None, None), (3, "a b c"), (3, "d e f")]
    kept = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept if (r.text or "").startswith("w0")] == [7]
    assert [r.doc_id for r in kept if (r.text or "").startswith("other")] == [None]
    assert sorted(repr((r.doc_id, r.text)) for r in kept if not (r.text or "").startswith(("w0", "other"))) == sorted(map(repr, rows[-5:]))


def test_local_roots():
    a, b = np.array([5, 4, 3, 9]), np.array([4, 3, 1, 8])
    assert ngram_join.local_roots(10, a, b).tolist() == [0, 1, 2, 1, 1, 1, 6, 7, 8, 8]
