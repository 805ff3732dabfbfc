"""The pipeline on a small corpus against plain versions of its stages, stage by stage."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from freshet.llm import bytebpe, packing, pii  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ta", "ri", "mon", "el", "or", "sha"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [(900, None, None, None, None), (901, "", "en", "s", 0)], []
    for i in range(300):
        words = [word() for _ in range(rng.randrange(60, 120))]
        if i % 6 == 5:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        elif i % 10 == 0:
            words[30] = f"user{i}@mail.example.com"
        labels.append((i, int(i % 6 != 5), 0))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join(words), "en", "copy", 0))
            words[10] = "changed"
            rows.append((2000 + i, " ".join(words), "en", "near", 0))
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
    rules, classified, single, masked = kept
    junk = {i for i in range(300) if i % 6 == 5}
    assert not {900, 901} & set(rules)
    assert not {i for i in rules if i % 1000 in junk} and len(rules) > 320
    assert set(classified) >= {i for i in rules if i % 1000 not in junk}
    assert not {i for i in single if i >= 1000} and set(single) == {i for i in classified if i < 300}
    assert set(masked) == set(single)
    for i, r in masked.items():
        assert r.text == pii.mask(single[i].text, pii.all_spans(single[i].text)[1]) and r.n_chars == len(r.text)
        assert ("<email>" in r.text) == (i % 10 == 0)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(masked)
    bpe = bytebpe.load(bytebpe.default_path())
    assert sum(r.length for r in packed) == sum(len(bpe.encode(r.text)) + 1 for r in masked.values())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)
    assert max(r.offset + r.length for r in whole) <= packing.CAPACITY


def test_cases(spark, sf_dir, tmp_path):
    """Null and repeated ids, a very long text, nulls in every column and columns with other names pass all stages; so does an empty table."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = whole.where("doc_id = 1").first().text
    long = " ".join(f"{w}{i}" for i in range(60) for w in words.split())
    rows = [(1, words + " one more", None, None, None), (None, "different " + words[::-1], None, None, 5), (None, "different " + words[::-1], None, None, 6), (1, long, "en", "s", 0)]
    more = spark.createDataFrame(rows, whole.schema)
    from pyspark.sql import functions as F

    docs = whole.unionByName(more).withColumns({"row": F.lit(1), "_row": F.lit(2), "part": F.lit("x")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    kept = kept.collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 1 for r in kept) == 2  # the near copy of a text went, the long text stayed
    assert all((r.row, r._row, r.part) == (1, 2, "x") for r in kept)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
