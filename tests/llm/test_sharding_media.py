"""Sharding and media columns against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from freshet.llm import media, sharding


def test_shards_match_the_mixture(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sharding.shard(df).collect()
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    slots, mix, whole = defaultdict(list), defaultdict(Counter), Counter(s for _, _, s in rows)
    for r in got:
        slots[r.shard].append(r.slot)
        mix[r.shard][r.source] += 1
        assert r.law == "rows" and r.grown_shard is None and r.size == 16 + r.doc_id % 7 and r.text_crc32 == zlib.crc32(b"t" * (r.doc_id % 7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for shard, held in mix.items():
        for source, n in whole.items():
            assert abs(held[source] - n / 40) <= 2, (shard, source)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(2)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_shards_equal_a_plain_version(spark, messy, messy_rows):
    """Ranks within the sources, fractions, one sort and equal cuts, in plain Python; the shuffle's hash is Spark's."""
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    crc, size = F.crc32(text.cast("binary")), F.octet_length(text) + sharding.OVERHEAD
    rows = [tuple(r) for r in messy.select("source", F.xxhash64(F.lit(sharding.SEED), "doc_id", crc, size.cast("long")), "doc_id", crc, size).collect()]
    sources = defaultdict(list)
    for source, *rest in rows:
        sources["-" if source is None else "+" + source].append(tuple((v is not None, v) for v in rest))
    mixed = sorted(((rank + 0.5) / len(held), source, row) for source, held in sources.items() for rank, row in enumerate(sorted(held)))
    places, next_slot = Counter(), Counter()
    for i, (_, _, (_, doc_id, crc, size)) in enumerate(mixed):
        shard = i * 40 // len(mixed)
        places[doc_id[1], size[1], crc[1], shard, next_slot[shard]] += 1
        next_slot[shard] += 1
    for df in (messy, messy.repartition(7)):
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(df).collect()) == places


def test_shard_cases(docs, no_docs, texts):
    got = sharding.shard(docs.unionByName(docs)).collect()
    assert len(got) == 2 * len(texts)
    assert {r.doc_id: r.size for r in got} == {i: 16 + len((t or "").encode()) for i, t in enumerate(texts)}
    assert sharding.shard(no_docs).count() == 0


def test_media_round_trip(docs, no_docs, texts):
    rows = {r.doc_id: r for r in media.media_columns(docs, digests=True).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        back = media.read(bytes(rows[i].media))
        assert back[: len(data)] == data and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and len(back) > 0
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].media_bytes) == (len(data), len(back), len(rows[i].media))
        assert rows[i].tail_crc32 == zlib.crc32(back[-32:])
    assert rows[0].feature == rows[1].feature and rows[5].feature == rows[6].feature
    assert media.media_columns(no_docs).count() == 0


def test_fingerprints_equal_a_plain_version():
    data = media.payload("some words to hear, and some more of them " * 60)
    x = np.frombuffer(data, np.uint8).astype(float) - 128
    frames = [np.abs(np.fft.rfft(x[i : i + 576] * media._WINDOW)) ** 2 for i in range(0, len(x) - 575, 288)]
    best = [[(lo + int(np.argmax(f[lo:hi])), float(max(f[lo:hi]))) for lo, hi in zip(media.BANDS, media.BANDS[1:])] for f in frames]
    peaks = []
    for t, bands in enumerate(best):
        for b, (k, p) in enumerate(bands):
            if p > 1e-6 and (t == 0 or p >= best[t - 1][b][1]) and (t + 1 == len(best) or p >= best[t + 1][b][1]):
                peaks.append((t, k))
    pairs = sorted((t1, (f1 << 15) | (f2 << 5) | (t2 - t1)) for i, (t1, f1) in enumerate(peaks) for t2, f2 in peaks[i + 1 : i + 4] if t2 - t1 <= 31)
    times, numbers = media.fingerprint(data)
    assert list(zip(times.tolist(), numbers.tolist())) == pairs
