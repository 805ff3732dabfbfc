"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside each source and ranked; the row of rank r among n gets the fraction
(r + 0.5) / n. Sorted by fraction, every stretch of rows holds the sources in their overall shares, so equal cuts
give shards that match the mixture and differ by one row at most.

Only ids, sources and hashes are sorted, never texts. Both sorts are range shuffles, and a source of any size is
ranked by adding up counts per partition, so no source is gathered in a task.

Cases: a null source is a stratum of its own; null texts have no bytes; an empty table gives no rows; rows with null
or repeated ids are shuffled by their texts' sizes and checksums too; rows alike in all of these are rows like others,
and it makes no difference which of them takes which place. Equal fractions go by source. Texts of any length are only
measured. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import materialise, numbered

SHARDS = 40
SEED = 17
OVERHEAD = 16  # bytes that a row takes besides its text


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`), source for each row of `df`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = materialise(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("_stratum"),
        ).withColumn("_shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")),
        "shard-rows",
    ).withColumn("_row", F.monotonically_increasing_id())
    total = small.count()
    ranked = numbered(small, ["_stratum", "_shuffled", "doc_id", "text_crc32", "size", "_row"], "shard-strata", within=["_stratum"])
    strata = ranked.groupBy("_stratum").agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    places = ranked.select("_part", "_stratum").distinct().join(strata, "_stratum")
    fraction = (F.col("row_no") - F.col("_first") + 0.5) / F.col("_rows")
    mixed = ranked.join(places, ["_part", "_stratum"]).select("doc_id", "source", "size", "text_crc32", "_stratum", fraction.alias("_fraction"))
    placed = numbered(mixed, ["_fraction", "_stratum", "doc_id"], "shard-mixed")
    at = F.expr(f"cast(row_no * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", at)
        .withColumn("slot", F.col("row_no") - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
    )
