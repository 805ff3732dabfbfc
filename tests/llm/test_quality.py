"""Base counts against a plain version; classifiers by held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import linear, positive_unlabelled, quality, textfeatures


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def counted(texts):
    out = []
    for _, group in textfeatures.groups(texts):
        c = textfeatures.counts(group)
        out += list(zip(c.n_words.tolist(), c.word_chars.tolist(), c.n_symbols.tolist(), c.n_dup_lines.tolist(), c.n_repeat_words.tolist()))
    return out


def test_counts_equal_a_plain_version(texts):
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "a b c ", "#", "|", "x\n", "\x0b", "\x1f", " ", "🙂", "a\n"]) for _ in range(rng.randrange(60))) for _ in range(600)]
    for chosen in (texts, made, made[:1], [""], ["\n"]):
        assert counted(chosen) == [plain_counts(t) for t in chosen]


def test_groups_don_t_change_results(monkeypatch):
    texts = ["one two three one two three\n" * k for k in range(30)]
    whole = counted(texts)
    monkeypatch.setattr(textfeatures, "GROUP", 50)
    assert counted(texts) == whole
    assert [i for i, _ in textfeatures.groups(texts)][:2] == [0, 2]


def test_linear_equals_sparse_product():
    texts = ["Some words, some more words.", "", "a a a b\nb", "é" * 50]
    weights = np.random.default_rng(1).normal(size=textfeatures.DIM).astype(np.float32)
    (_, group), = textfeatures.groups(texts)
    c = textfeatures.counts(group)
    rows = linear.Rows.of(textfeatures.sparse(group, c))
    np.testing.assert_allclose(textfeatures.linear(group, c, weights), rows.product(weights), rtol=1e-4, atol=1e-4)


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose and three kinds of junk, about a fifth; most rows are labelled."""
    rng = random.Random(12)
    syllables = ["ta", "ri", "mon", "el", "or", "sha", "ne", "qui", "lo", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randrange(55, 140))]
        bad = rng.random() < 0.2
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["###", "$$$", "%%%"]) for w in words] if kind == 1 else [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(not bad), 0))
    bad_ids = {i for i, good, _ in labels if not good}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), bad_ids, {i for i, _, _ in labels}


def test_quality_rules(corpus):
    docs, labels, bad, labelled = corpus
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    right = [(r.doc_id not in bad) == r.kept for r in rows if r.doc_id in labelled and not r.base_failed]
    assert sum(right) / len(right) > 0.97
    kept = {r.doc_id for r in quality.filtered(docs, quality.fit(docs, labels)).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_quality_cases(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, again = plain_counts(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed)
    assert quality.score(no_docs, quality.KEEPS_ALL).count() == 0 and quality.filtered(no_docs, quality.KEEPS_ALL).count() == 0


def test_the_drivers_sample_is_bounded(spark, monkeypatch):
    """A thousand rows of one id are one row of the sample, and features are bounded."""
    from pyspark.sql import functions as F

    docs = spark.range(2000).select((F.col("id") % 1000 * (F.col("id") % 2)).alias("doc_id"), F.concat(F.lit("some words and number "), "id").alias("text")).repartition(4)
    named = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (3, 1), (5000, 0)], "doc_id long, mark int")
    rows, marks, ids = quality.sparse_rows(docs, named, "mark")
    assert list(zip(marks.tolist(), ids.tolist())) == [(0, 3), (1, 0), (1, 1), (1, 3)] and len(rows) == 4
    texts = {i: min((r.text for r in docs.where(f"doc_id = {i}").select("text", F.xxhash64("text").alias("h")).orderBy("h").limit(1).collect())) for i in (0, 1, 3)}
    (_, group), = textfeatures.groups([texts[i] for i in (3, 0, 1, 3)])
    for i, (n, v) in enumerate(textfeatures.sparse(group, textfeatures.counts(group))):
        at = slice(rows.starts[i], rows.starts[i + 1])
        assert np.array_equal(rows.number[at], n) and np.array_equal(rows.value[at], v)
    again = quality.sparse_rows(docs.repartition(2), named, "mark", numbers=2 * int(np.diff(rows.starts).max()))
    assert again[1].tolist() == [0, 1, 1]
    none = quality.sparse_rows(docs, named.limit(0), "mark")
    assert len(none[0]) == 0 and len(none[1]) == 0


def test_other_columns_keep_their_names_and_values(spark):
    from freshet.llm import pii

    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111", "v", 2), (None, None, None, None)], "doc_id long, text string, `a.b` string, `c0` int")
    for out in (quality.filtered(df, quality.KEEPS_ALL, base_rules=False), pii.masked(df)):
        assert out.columns == df.columns
        assert {(r["doc_id"], r["a.b"], r["c0"]) for r in out.collect()} == {(1, "v", 2), (None, None, None)}


def test_positive_unlabelled(corpus):
    docs, labels, bad, labelled = corpus
    model, prior = positive_unlabelled.fit(docs, labels)
    assert 0.7 < prior < 0.92
    rows = positive_unlabelled.classify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = [(r.doc_id not in bad) == bool(r.predicted) for r in rows if r.held_out and r.doc_id in labelled]
    assert len(right) > 60 and sum(right) / len(right) > 0.93


def test_labels_of_the_held_out_fold_are_not_used(corpus, spark):
    docs, labels, _, _ = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(positive_unlabelled.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, _ = positive_unlabelled.fit(docs, labels)
    b, _ = positive_unlabelled.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_positive_unlabelled_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, _ = positive_unlabelled.fit(docs, labels)
    assert all(r.predicted == 1 for r in positive_unlabelled.classify(docs, model).collect())
    assert positive_unlabelled.classify(no_docs, model).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(6)
    p = rng.normal(2, 1, 800)
    u = np.concatenate([rng.normal(2, 1, 700), rng.normal(-3, 1, 300)])
    assert abs(positive_unlabelled.estimate_prior(p, u) - 0.7) < 0.06


def test_back_is_the_transposed_product():
    texts = ["Some words, some more words.", "", "a a a b\nb", "é" * 50]
    (_, group), = textfeatures.groups(texts)
    c = textfeatures.counts(group)
    of_text = np.array([0.25, 0.1, 0.003, 0.2])
    out = textfeatures.back(group, textfeatures.features(group, c), textfeatures.dense(group, c), of_text) / textfeatures.UNIT
    np.testing.assert_allclose(out, linear.Rows.of(textfeatures.sparse(group, c)).back(of_text, textfeatures.DIM), rtol=1e-5, atol=1e-7)


def dense_rows(texts):
    """Features as a matrix of the columns in use, and these columns."""
    rows = [row for _, group in textfeatures.groups(texts) for row in textfeatures.sparse(group, textfeatures.counts(group))]
    used = np.unique(np.concatenate([n for n, _ in rows]))
    x = np.zeros((len(rows), len(used)))
    for i, (n, v) in enumerate(rows):
        x[i, np.searchsorted(used, n)] = v
    return x, used, linear.Rows.of(rows)


def plain_adam(gradient, dim, steps, rate, decay, w, b):
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        by_w, by_b = gradient(w, b)
        g = np.append(by_w + decay * w, by_b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_the_risks_gradient_is_its_derivative(spark, monkeypatch, prior):
    """The derivative of the risk by numeric differences, by the plain formula, and the descent that sums it in tasks."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta!", "eps 7", "ZETA"]
    good = [" ".join(rng.choice(words[:4], 30)) for _ in range(12)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(30)]
    x, used, _ = dense_rows(good + texts)
    p_rows, u_rows = x[:12], x[12:]
    w0, b0 = rng.normal(0, 0.05, len(used)), 0.1
    z = lambda rows, w, b: linear.sigmoid(rows @ w + b)
    risk = lambda w, b: positive_unlabelled.risk(z(p_rows, w, b), z(u_rows, w, b).mean(), prior)

    def gradient(w, b):
        p, u = z(p_rows, w, b), z(u_rows, w, b)
        of_p, of_u = prior * p * (1 - p) / len(p), u * (1 - u) / len(u)
        whole = u.mean() >= prior * p.mean()
        # The risk's own derivative, or, where the negatives' risk came out below zero, away from it.
        side = (-2 * of_p, of_u) if whole else (of_p, -of_u)
        return side[0] @ p_rows + side[1] @ u_rows, side[0].sum() + side[1].sum()

    direction = rng.normal(0, 1, len(used))
    numeric = (risk(w0 + 1e-6 * direction, b0) - risk(w0 - 1e-6 * direction, b0)) / 2e-6
    p, u = z(p_rows, w0, b0), z(u_rows, w0, b0)
    if u.mean() >= prior * p.mean():
        assert numeric == pytest.approx(gradient(w0, b0)[0] @ direction, rel=1e-4, abs=1e-8)
    else:
        assert numeric == pytest.approx(-(prior * p * (1 - p) / 12) @ p_rows @ direction, rel=1e-4, abs=1e-8)
    steps = (4, 0.01, 1e-5)
    monkeypatch.setattr(positive_unlabelled, "SECOND", steps)
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    begin = np.zeros(textfeatures.DIM, np.float32)
    begin[used] = w0
    positive = dense_rows(good)[2]
    weights, bias = positive_unlabelled.descent(table, 1, positive, prior, (begin, b0))
    w, b = plain_adam(gradient, len(used), *steps, w0, b0)
    np.testing.assert_allclose(weights[used], w, rtol=1e-3, atol=2e-5)
    assert bias == pytest.approx(b, rel=1e-3)


def test_sums_are_the_same_with_a_second_level_of_tasks(spark, monkeypatch):
    df = spark.range(400).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(9)
    add = lambda group, ids: np.array([group.n, ids.sum(), 1 << 40], np.int64)
    whole = positive_unlabelled.summed(df.coalesce(1), add, 3)
    monkeypatch.setattr(positive_unlabelled, "TASKS", 2)
    again = positive_unlabelled.summed(df, add, 3)
    assert whole[:2].tolist() == again[:2].tolist() == [400, 400 * 399 // 2] and again[2] % (1 << 40) == 0


def test_training_follows_the_plain_descent():
    """Logistic regression on the hashed features: the derivative by numeric differences, and the descent by a plain one."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "worse"], 20)) for _ in range(40)]
    y = np.array([t.count("good") + t.count("fine") > 10 for t in texts], int)
    x, used, rows = dense_rows(texts)
    share = np.full(40, 1 / 40)
    loss = lambda w, b: -(share * (y * np.log(linear.sigmoid(x @ w + b)) + (1 - y) * np.log(1 - linear.sigmoid(x @ w + b)))).sum()
    by = lambda w, b: (x.T @ (share * (linear.sigmoid(x @ w + b) - y)), (share * (linear.sigmoid(x @ w + b) - y)).sum())
    w0, direction = rng.normal(0, 0.1, len(used)), rng.normal(0, 1, len(used))
    assert (loss(w0 + 1e-6 * direction, 0) - loss(w0 - 1e-6 * direction, 0)) / 2e-6 == pytest.approx(by(w0, 0)[0] @ direction, rel=1e-4)
    weights, bias = linear.minimise(rows, lambda z: share * (linear.sigmoid(z) - y), textfeatures.DIM, 30, 0.05, 1e-4)
    w, b = plain_adam(by, len(used), 30, 0.05, 1e-4, np.zeros(len(used)), 0.0)
    np.testing.assert_allclose(weights[used], w, rtol=1e-3, atol=1e-4)
    assert bias == pytest.approx(b, rel=1e-3) and not np.delete(weights, used).any()


def test_all_unlabelled_text_is_used(corpus):
    """A sample of 24 says little of the prior, and has few of each kind of junk."""
    docs, labels, bad, labelled = corpus
    model, prior = positive_unlabelled.fit(docs, labels, unlabelled=24)
    again, same = positive_unlabelled.fit(docs.repartition(5), labels, unlabelled=24)
    assert prior == same and np.array_equal(model.weights, again.weights) and model.bias == again.bias
    assert abs(prior - 0.8) < 0.06
    rows = positive_unlabelled.classify(docs, model).collect()
    right = [(r.doc_id not in bad) == bool(r.predicted) for r in rows if r.held_out and r.doc_id in labelled]
    assert sum(right) / len(right) > 0.93


def test_platt_calibrates():
    rng = np.random.default_rng(7)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < linear.sigmoid(1.5 * z - 0.5)).astype(int)
    a, b = linear.platt(z, y)
    assert abs(a - 1.5) < 0.2 and abs(b + 0.5) < 0.2
