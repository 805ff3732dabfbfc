"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import bytebpe, grammar, lexicon, media, ngram_join, packing, pii, positive_unlabelled, quality, repeats, sharding, spelling, tokencount
from freshet.llm.common import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_chosen_path_join(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir)).drop("row")


def op2_hashed_ngram_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op3_min_bin_slack(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), bytebpe.default_path())


def op4_transducer_lexicon(spark, sf_dir):
    return lexicon.encode_documents(documents(spark, sf_dir), bytebpe.default_path(), keep_ids=False, digests=True)


def op5_repair_grammar(spark, sf_dir):
    blocks = grammar.write_blocks(documents(spark, sf_dir), bytebpe.default_path())
    return grammar.read_documents(blocks, keep_ids=False)


def op6_personal_data(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def op7_stratified_interleaving(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op8_overlap_resync_counts(spark, sf_dir):
    return tokencount.token_counts(documents(spark, sf_dir), bytebpe.default_path())


def op9_wav_fingerprints(spark, sf_dir):
    return media.media_columns(documents(spark, sf_dir), keep_media=False, digests=True).drop("fp_time", "fp_pair")


def op10_positive_unlabelled(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model, _ = positive_unlabelled.fit(docs, labels(spark, sf_dir))
    return positive_unlabelled.classify(docs, model)


def op11_difference_cover(spark, sf_dir):
    return repeats.removed(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_active_node_variants(spark, sf_dir):
    counted = spelling.word_counts(documents(spark, sf_dir), change=spelling.with_slips)
    return spelling.variants(counted)


QUERIES = {
    "op1_chosen_path_join": op1_chosen_path_join,
    "op2_hashed_ngram_quality": op2_hashed_ngram_quality,
    "op3_min_bin_slack": op3_min_bin_slack,
    "op4_transducer_lexicon": op4_transducer_lexicon,
    "op5_repair_grammar": op5_repair_grammar,
    "op6_personal_data": op6_personal_data,
    "op7_stratified_interleaving": op7_stratified_interleaving,
    "op8_overlap_resync_counts": op8_overlap_resync_counts,
    "op9_wav_fingerprints": op9_wav_fingerprints,
    "op10_positive_unlabelled": op10_positive_unlabelled,
    "op11_difference_cover": op11_difference_cover,
    "op12_active_node_variants": op12_active_node_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {}
