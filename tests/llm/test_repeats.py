"""op11 against brute force over every string of every text."""

import random

import numpy as np
import pytest

from freshet.llm import repeats


def brute(rows, length=repeats.LENGTH):
    """(id, n_bytes, n_removed, spans, kept) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        for run in bytes(gone).split(b"\0"):
            if run:
                spans.append((p, p + len(run)))
            p += len(run) + 1
        out.append((i, len(t), sum(gone), tuple(spans), bytes(b for b, x in zip(t, gone) if not x)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.removed(df, **options)
    assert rows_of(got) == sorted(brute(rows, options.get("length", repeats.LENGTH)), key=repr)
    assert all(r.n_spans == len(r.spans) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}, {"block_bytes": 300, "period": 7}, {"period": 21, "block_bytes": 1500}, {"length": 23, "block_bytes": 500}])
def test_shared_passages(spark, options):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(3)]
        for at in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(20)
            parts.insert(at, p[a : a + rng.randrange(40, 90)])
        rows.append((rng.randrange(10**6), " ".join(parts)))
    rows += [(10**6 + i, passages[0]) for i in range(40)] + [(-5, passages[0][3:])]
    check(spark, rows, **options)


def test_runs_and_repeats_inside_a_document(spark):
    check(spark, [(3, "x" * 400), (1, "x" * 49), (2, "x" * 50), (4, "ab" * 80), (5, "ba" * 80), (6, "x" * 120 + "y" + "x" * 30)], block_bytes=64)


def test_rows_of_one_id_and_of_none(spark, messy, messy_rows):
    assert rows_of(repeats.removed(messy)) == sorted(brute(messy_rows), key=repr)
    check(spark, [(7, "p" * 60), (7, "p" * 60), (8, "p" * 55), (8, "p" * 55), (None, "p" * 70), (9, None), (10, "")], block_bytes=10)


def test_empty_table(spark, no_docs):
    out = repeats.removed(no_docs)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]


@pytest.mark.parametrize("period", sorted(repeats.COVERS))
def test_covers(period):
    d = repeats.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


@pytest.mark.parametrize("length", [1, 2, 7, 8, 30, 38, 44, 50, 64])
def test_names_follow_the_bytes(length):
    rng = np.random.default_rng(length)
    buf = rng.integers(0, 3, 70_000).astype(np.uint8)
    one, two = repeats.names(buf, length)
    assert len(one) == len(buf) - length + 1
    for a in range(0, 3000):
        assert (one[a] == one[0]) == (bytes(buf[a : a + length]) == bytes(buf[:length]))
    assert len(np.unique(one)) == len(np.unique(two)) == len({bytes(buf[a : a + length]) for a in range(len(one))})


def test_coded_numbers():
    rng = np.random.default_rng(1)
    for names in (np.array([0], np.uint64), np.array([2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64)), np.arange(300, dtype=np.uint64)):
        assert (repeats.decoded(repeats.coded(names)) == names).all()
    assert len(repeats.coded(np.arange(300, dtype=np.uint64))) == 301
