"""op12 against brute force over all pairs of words."""

import random
import re
from collections import Counter

import pytest

from freshet.llm import registry, spelling

SF_DIR = "/root/testdata/sf0.001"


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    at = spelling._first_difference(x, y)
    return x != y and (x[at + 1 :] == y[at + 1 :] if len(x) == len(y) else len(y) == len(x) + 1 and x[at:] == y[at + 1 :])


def brute(counts, ratio=spelling.RATIO):
    by_gap: dict = {}
    for w in counts:
        for i in range(len(w) + 1):
            by_gap.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out, form = {}, {}
    for w in counts:
        others = {x for i in range(len(w) + 1) for x in by_gap.get(w[:i] + w[i + 1 :], ())} | {x for x in by_gap.get(w, ())}
        around = [x for x in others if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x)) if around else None
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
        out[w] = (counts[w], len(around), form[w], counts[best] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("limit", [2, 5, 4000])
def test_variants(spark, limit):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(500)} | {"aaaaaaaaaaaaaaa" + c + d for c in "abcdef" for d in ("", "x", "y")}
    words |= {"z" * 3000, "z" * 3001, "z" * 2999 + "y", ""}
    counts = {w: 10 ** rng.randrange(0, 6) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(vocabulary, limit=limit)) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefx": 10, "abcdefy": 10, "lonelyword": 5}
    found = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and found["abcdefg"][2:] == ("abcdefgh", 10, "abcdefghij")


def test_distance_one():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(150)})
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}
    found = list(spelling.distance_one(words))
    assert len(found) == len(want) and set(found) == want


def counted(rows, min_length=7, min_count=2):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = spelling.with_slips(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in run))
            if len(word) >= min_length:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= min_count}


def test_words_of_messy_rows(spark, messy, messy_rows, no_docs):
    rows = messy_rows + [(1, "ÀÉtudes Àétudes ÀÉTUDES étudesx")] * 2
    df = messy.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(i, t, 0) for i, t in rows[len(messy_rows) :]], "doc_id long, text string, row int"))
    found = {r.word: r.n for r in spelling.word_counts(df, change=spelling.with_slips).collect()}
    assert found == counted(rows) and "étudesx" in found
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0


def test_query(spark):
    out = registry.QUERIES["op12_active_node_variants"](spark, SF_DIR)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got(out) == brute(counted([(r.doc_id, r.text) for r in docs]))
