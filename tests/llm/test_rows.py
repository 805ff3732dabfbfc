"""Every operator on rows with null and repeated ids, very long and missing texts, and columns named like its own; the queries' columns."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from freshet.llm import bytebpe, grammar, lexicon, media, ngram_join, packing, pii, positive_unlabelled, quality, registry, tokencount

PATH = bytebpe.default_path()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids_of(library, messy_rows):
    return {t: library.encode(t or "", add_special_tokens=False).ids for _, t in messy_rows}


def test_token_operators(messy, messy_rows, ids_of, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = lexicon.encode_documents(messy, PATH, keep_ids=False, digests=True).collect()
    want = Counter((i, len(ids_of[t]), digest(",".join(map(str, ids_of[t]))), digest(library.decode(ids_of[t], skip_special_tokens=False))) for i, t in messy_rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    got = tokencount.token_counts(messy, PATH).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), len(ids_of[t])) for i, t in messy_rows)


def test_packing(messy, messy_rows, ids_of):
    got = packing.pack(messy, PATH).collect()
    want = Counter()
    for i, t in messy_rows:
        ids = np.array([*ids_of[t], packing.END], "<u4")
        want.update((i, at, zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_grammar(messy, messy_rows, ids_of):
    runs = [grammar.read_documents(grammar.write_blocks(df, PATH, partitions=n)).collect() for df, n in ((messy, 3), (messy.repartition(7), 5))]
    first, second = (Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) for rows in runs)
    assert first == second  # starts don't depend on how rows arrive
    assert Counter((r.doc_id, tuple(r.ids)) for r in runs[0]) == Counter((i, (*ids_of[t], grammar.END)) for i, t in messy_rows)
    rows = sorted(runs[0], key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_per_text_operators(messy, messy_rows):
    got = pii.find(messy).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter((i, pii.joined(pii.all_spans(t or "")[1])) for i, t in messy_rows)
    assert pii.masked(messy).columns == messy.columns
    got = media.media_columns(messy, digests=True).collect()
    assert Counter((r.doc_id, r.payload_sha256) for r in got) == Counter((i, hashlib.sha256(media.payload(t)).hexdigest()) for i, t in messy_rows)


def test_classifiers(spark, messy, messy_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(messy, quality.fit(messy, labels)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in messy_rows)
    model, _ = positive_unlabelled.fit(messy, labels, unlabelled=8)
    rows = positive_unlabelled.classify(messy, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in messy_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id is None}) <= 7  # equal texts, equal scores
    out = quality.filtered(messy, model, 0.0, base_rules=False)
    assert out.columns == messy.columns and out.count() == len(messy_rows)


def test_join(messy, messy_rows):
    from test_ngram_join import brute

    rows = [(10**6 if i is None else i, t) for i, t in messy_rows]
    want = Counter((i, *v) for (i, _), v in zip(messy_rows, brute(rows).values()))
    got = Counter((r.doc_id, 10**6 if r.class_id is None else r.class_id, r.n_links) for r in ngram_join.join(messy).collect())
    assert got == want
    kept = ngram_join.deduplicated(messy)
    assert kept.columns == messy.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {v[0] if t and t.split() else (i, t) for (i, t), v in zip(messy_rows, brute(rows).values())}
    assert len(kept) == len(set(kept)) and len(kept) >= len(classes) - 1


#: The columns that each query must return, and their types.
COLUMNS = {
    "op1_chosen_path_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op2_hashed_ngram_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_min_bin_slack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_transducer_lexicon": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_repair_grammar": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_stratified_interleaving": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_overlap_resync_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_wav_fingerprints": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_positive_unlabelled": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_difference_cover": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = registry.QUERIES[name](spark, SF_DIR)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert set(COLUMNS) | {"op12_active_node_variants", "pipeline"} == set(registry.QUERIES)
