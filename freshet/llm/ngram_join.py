"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed word n-grams. Equal sets become one class, stood for by one row; only such
rows go on. Each set is embedded in `COORDINATES` min-hash tokens, on which Jaccard similarity is the share of equal
tokens. Each of several runs grows a tree: a node samples one coordinate (a quarter of the nodes, two), and its sets
go to the child of their token there. Nodes with one set end; nodes with up to `SMALL` are compared pair by pair;
larger ones split again, to `DEPTH` levels, unless all their sets are in one candidate group already: at the first
level, the sets of a large node are compared with one of them, drawn by hash, for that. What still isn't small at the last level
is joined as a star without comparison. Runs are repeated until a pair at the threshold is found with a probability of `RECALL`.

Comparisons on tokens only link sets into candidate groups. Inside each group, similarities, link counts and classes
are exact. A group of up to `BLOCK` sets is compared pair by pair. In a larger one, every set is compared with a few
pivots (the n-grams that most sets of a cluster have). One less the Jaccard similarity is a metric, so two sets are
linked for certain if their distances from a pivot add up to at most the threshold's, and not linked for certain if
they differ by more. Nor are two sets linked if what either shares with any other set of the group is too little for that. Only
sets that neither decides on are compared, in blocks of bounded size. Near copies of one text
cost comparisons in proportion to their number, and nothing but a count of links and one edge a set is emitted.

No key gathers its rows in a task: nodes, groups, classes and repeated rows that hold a great share of all are few,
and are met by `spread_join`.

Cases: texts with fewer words than n are one n-gram of all their words; texts without words have no set, no
links, and are their own class; rows repeated (id and text) are copies of each other; a null id is kept as it is, and a
class whose ids are all null has a null class_id; an empty table gives no rows; a very long text is one set, held whole
by its task; other columns are ignored by the join and kept by `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import textfeatures
from freshet.llm.common import arrow_schema, map_rows, materialise, shuffle_partitions, to_batch
from freshet.operators.components import components
from freshet.operators.joins import spread_join
from freshet.scratch import scope

N = 5
THRESHOLD = (4, 5)  # similarity of 0.8, as a fraction
COORDINATES = 128
RECALL = 0.9999  # of the candidates, for pairs at the threshold; pairs above it are found more often
SMALL = 64
DEPTH = 4
SLACK = 0.14  # candidates may look this much less similar on tokens (four standard deviations)
BLOCK = 256  # sets of a chunk; two chunks meet in a block
BLOCK_GRAMS = 2_000_000  # n-grams of a chunk, on average
PIVOTS = 12  # of a group of more than one chunk, at most
RINGS = 100  # a set's distance from its pivot is known in such parts
LIMIT = RINGS * (THRESHOLD[1] - THRESHOLD[0]) // THRESHOLD[1]  # the distance at the threshold

_rng = np.random.default_rng(20_001)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By group of texts: number of the first, how many, and all their distinct n-gram hashes with the text of each, in order."""
    for first, g in textfeatures.groups(texts):
        words = np.bincount(g.word_text, minlength=g.n)
        begin = np.cumsum(words) - words
        h = g.word_hash
        size = np.minimum(words, n)  # words in an n-gram of this text
        grams = np.maximum(words - n + 1, np.minimum(words, 1))
        text = np.repeat(np.arange(g.n), grams)
        at = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams) + begin[text]
        value = np.zeros(len(text), np.uint64)
        for i in range(n):
            here = i < size[text]
            value[here] = textfeatures.mix(value[here] * np.uint64(3) + h[at[here] + i] + np.uint64(1))
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        yield first, g.n, value[keep], text[keep]


def embed(df: DataFrame, n: int = N) -> DataFrame:
    """row, row2, doc_id, n_grams, key1, key2 (of the set; null without words), tokens, brief (their lowest bytes)."""
    schema = "row long, row2 long, doc_id long, n_grams int, key1 long, key2 long, tokens array<int>, brief binary"
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = batch.num_rows
        sizes, keys, has = np.zeros(m, np.int32), np.zeros((m, 2), np.uint64), np.zeros(m, bool)
        tokens = np.zeros((m, COORDINATES), np.uint32)
        for first, _, value, text in shingle_sets(batch.column(3).to_pylist(), n):
            if not len(value):
                continue
            starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            of = first + text[starts]
            has[of] = True
            sizes[of] = np.diff(np.append(starts, len(value)))
            keys[of, 0] = np.add.reduceat(textfeatures.mix(value + np.uint64(1)), starts)
            keys[of, 1] = np.add.reduceat(textfeatures.mix(value ^ np.uint64(0x5DEECE66D)), starts)
            for k in range(COORDINATES):
                tokens[of, k] = np.minimum.reduceat((value ^ _FLIP[k]) * _TIMES[k], starts) >> np.uint64(32)
        key = [pa.array(keys[:, i].view(np.int64), mask=~has) for i in range(2)]
        offsets = pa.array(np.arange(m + 1, dtype=np.int32) * COORDINATES)
        brief = tokens.astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array(sizes),
                *key,
                pa.ListArray.from_arrays(offsets, pa.array(tokens.reshape(-1).view(np.int32))).cast(arrow.field("tokens").type),
                pa.array([brief[i * COORDINATES : (i + 1) * COORDINATES] for i in range(m)], type=pa.binary()),
            ],
            schema=arrow,
        )

    return map_rows(keyed(df), schema, run)


def keyed(df: DataFrame) -> DataFrame:
    """row and row2 (hashes of id and text, 128 bits together), doc_id, text."""
    doc_id = F.col("doc_id").cast("long")
    return df.select(*row_hashes(doc_id, F.col("text")), doc_id.alias("doc_id"), "text")


def row_hashes(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("row"), F.xxhash64(F.lit(11), text, doc_id).alias("row2")]


def by_key(batches: Iterator[pa.RecordBatch], key: str, fn: Callable[[np.ndarray, pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call `fn` with whole groups only: rows come sorted by `key`, and the last group of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1], "left"))
        if waiting and waiting[0].column(key)[0].as_py() != values[0]:
            held = pa.Table.from_batches(waiting)
            yield from fn(held[key].to_numpy(), held)
            waiting = []
        if last:
            held = pa.Table.from_batches([*waiting, batch.slice(0, last)])
            yield from fn(held[key].to_numpy(), held)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        held = pa.Table.from_batches(waiting)
        yield from fn(held[key].to_numpy(), held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of `n` items' component, under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def small_nodes(node: np.ndarray, brief: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each node whose tokens agree in `least` coordinates."""
    found = []
    shift = 1
    while True:
        left = np.flatnonzero(node[:-shift] == node[shift:]) if shift < len(node) else np.empty(0, np.int64)
        if not len(left):
            break
        for i in range(0, len(left), 1 << 15):
            some = left[i : i + (1 << 15)]
            same = (brief[some] == brief[some + shift]).sum(1) >= least
            found.append(np.stack([some[same], some[same] + shift]))
        shift += 1
    pairs = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def missed(runs: int, depth: int = DEPTH, s: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """The probability that no run keeps a pair of similarity `s` together down to level `depth`."""
    kept = 1.0
    for _ in range(depth - 1):
        kept = 0.75 * s * kept + 0.25 * (1 - (1 - s * kept) ** 2)
    out = 1.0
    for r in range(runs):
        out *= (1 - s * kept) ** (1 + (r % 4 == 0))  # every fourth run starts with two coordinates
    return out


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """How many runs find a pair at the threshold with a probability of `recall`."""
    runs = 1
    while missed(runs, depth) > 1 - recall:
        runs += 1
    return runs


def candidates(sets: DataFrame, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) that link sets (row, tokens, brief) into candidate groups."""
    least = int((THRESHOLD[0] / THRESHOLD[1] - SLACK) * COORDINATES)
    rng = np.random.default_rng(7)
    first = []
    for r in range(runs_for(recall, depth)):
        for _ in range(1 + (r % 4 == 0)):
            c = int(rng.integers(COORDINATES))
            first.append(F.xxhash64(F.lit(r), F.lit(c), F.col("tokens")[c]))
    # Rows carry their candidate group as it is known so far: at first, the set itself.
    rows = sets.select("row", F.col("row").alias("group"), F.explode(F.array(*first)).alias("node"))
    leaves, stars = [], []
    for level in range(1, depth + 1):
        rows = materialise(rows, f"join-level{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min_by("row", F.xxhash64("node", "row")).alias("first"), F.min("group").alias("one"), F.max("group").alias("other"))
        # A node whose sets are all in one candidate group already has nothing to add.
        nodes = materialise(sizes.where("n > 1 and one <> other").select("node", "n", F.col("n").alias("size"), "first", "one"), f"join-nodes{level}")
        sized = materialise(spread_join(rows, nodes, "node", rows.count()), f"join-sized{level}")
        leaves.append(sized.where(F.col("size") <= small).select("node", "row"))
        large = sized.where(F.col("size") > small)
        if level == depth:
            stars.append(large.select(F.col("group").alias("a"), F.col("one").alias("b")).distinct())
            break
        if large.isEmpty():
            break
        if level == 1:
            groups, links = first_groups(near_first(large, sets, least))
            stars.append(links)
            tagged = materialise(large.drop("group").join(groups, "row", "left").select("node", "row", F.coalesce("root", "row").alias("group")), "join-tagged")
            mixed = tagged.groupBy("node").agg(F.min("group").alias("one"), F.max("group").alias("other"), F.count(F.lit(1)).alias("n")).where("one <> other").select("node", "n")
            large = spread_join(tagged, mixed, "node", tagged.count())
        c = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(COORDINATES)).cast("int")
        child = lambda i: F.xxhash64("node", c(i), F.get("tokens", c(i)))
        children = F.when(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(4)) == 0, F.array(child(1), child(2))).otherwise(F.array(child(1)))
        rows = large.select("node", "row", "group").join(sets.select("row", "tokens"), "row").select("row", "group", F.explode(children).alias("node")).distinct()
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionAll(more)

    schema = "a long, b long"
    arrow = arrow_schema(sets.sparkSession, schema)

    def compare(node: np.ndarray, held: pa.Table) -> Iterator[pa.RecordBatch]:
        row = held["row"].to_numpy()
        brief = np.frombuffer(b"".join(held["brief"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        root = local_roots(len(row), *small_nodes(node, brief, least))
        joined = np.flatnonzero(root != np.arange(len(row)))
        if len(joined):
            yield to_batch({"a": row[joined], "b": row[root[joined]]}, arrow)

    parts = shuffle_partitions(sets.sparkSession)
    edges = leaf.join(sets.select("row", "brief"), "row").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(lambda batches: by_key(batches, "node", compare), schema)
    for more in stars:
        edges = edges.unionAll(more)
    return edges


def near_first(large: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) from the sets of large nodes to the one drawn from the node, where their tokens agree in `least` coordinates."""
    pairs = materialise(large.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct(), "join-pairs")
    brief = lambda name: sets.select(F.col("row").alias(name), F.col("brief").alias(f"brief_{name}"))
    drawn = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(brief("b"), "b")

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [np.frombuffer(b"".join(batch.column(f"brief_{x}").to_pylist()), np.uint8).reshape(-1, COORDINATES) for x in "ab"]
        return batch.select(["a", "b"]).filter(pa.array((sides[0] == sides[1]).sum(1) >= least))

    both = spread_join(pairs, drawn, "b", pairs.count()).join(brief("a"), "a")
    return map_rows(both.select("a", "b", "brief_a", "brief_b"), "a long, b long", agree)


def first_groups(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row and root, a set that the row is linked with through edges (a, b) of `near`; and edges that link the same sets, one or two for each a.

    The root is the least b of any a that shares a b: all of a large cluster find the same one, as a rule.
    """
    near = materialise(near, "join-near")
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    of_b = near.join(least, "a").groupBy("b").agg(F.min("least").alias("root"), F.count(F.lit(1)).alias("n"))
    pairs = spread_join(near, of_b, "b", near.count())
    groups = materialise(pairs.groupBy(F.col("a").alias("row")).agg(F.min("root").alias("root"), F.collect_set("b").alias("others")), "join-first")  # as many others as runs have first coordinates
    links = groups.select(F.col("row").alias("a"), F.col("root").alias("b")).unionAll(groups.select(F.col("root").alias("a"), F.explode("others").alias("b")).distinct())
    return groups.select("row", "root"), links


def linked(value: np.ndarray, of: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of sets with a similarity of at least THRESHOLD; `value` holds all sets' n-grams, `of` their set."""
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    new = np.append(True, value[1:] != value[:-1])
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram)[gram] > 1
    gram, of = gram[shared], of[shared]
    both = np.zeros((len(left), len(right)), np.float32)
    if len(gram):
        gram = np.cumsum(np.append(True, gram[1:] != gram[:-1])) - 1
        column = np.full(len(sizes), -1), np.full(len(sizes), -1)
        column[0][left], column[1][right] = np.arange(len(left)), np.arange(len(right))
        for low in range(0, int(gram[-1]) + 1, 4096):
            i, j = np.searchsorted(gram, [low, low + 4096])
            sides = []
            for where, n in zip(column, both.shape):
                dense = np.zeros((4096, n), np.float32)
                inside = where[of[i:j]] >= 0
                dense[gram[i:j][inside] - low, where[of[i:j][inside]]] = 1
                sides.append(dense)
            both += sides[0].T @ sides[1]
    up, down = THRESHOLD
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return np.nonzero(down * both.astype(np.int64) >= up * union.astype(np.int64))


def distance_rings(value: np.ndarray, of: np.ndarray, sizes: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's Jaccard distance from the set `pivot`, in RINGS parts: rounded down, and up. `value` holds all sets' n-grams, `of` their set."""
    hit = pivot[np.minimum(np.searchsorted(pivot, value), len(pivot) - 1)] == value
    both = np.bincount(of[hit], minlength=len(sizes))
    union = sizes + len(pivot) - both
    return RINGS * (union - both) // union, -(-RINGS * (union - both) // union)


def pivots_of(value: np.ndarray, of: np.ndarray, sizes: np.ndarray, most: int = PIVOTS) -> list[np.ndarray]:
    """Sets that stand in the middle of the clusters among some sets: of a cluster, the n-grams that most of it has. Any sets would do; good ones decide more."""
    near_enough = RINGS * (THRESHOLD[1] - THRESHOLD[0]) // (2 * THRESHOLD[1])
    left, out = np.ones(len(sizes), bool), []
    while left.any() and len(out) < most:
        seed = int(np.argmax(left))
        own = value[of == seed]
        cluster = left & (distance_rings(value, of, sizes, own)[1] <= 4 * near_enough)
        grams, times = np.unique(value[cluster[of]], return_counts=True)
        pivot = grams[2 * times > cluster.sum()]
        pivot = pivot if len(pivot) else own
        out.append(pivot)
        left &= distance_rings(value, of, sizes, pivot)[1] > near_enough
        left[seed] = False
    return out


def _sets_of(grams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of some sets, the set of each, and the sets' sizes."""
    values = [np.frombuffer(g, np.uint64) for g in grams]
    sizes = np.array([len(v) for v in values], np.int64)
    return np.concatenate(values), np.repeat(np.arange(len(values)), sizes), sizes


def _groups_in(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of rows whose keys are all equal."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    cuts = np.flatnonzero(new)
    return zip(cuts, np.append(cuts[1:], n))


def placed_sets(groups: DataFrame, docs: DataFrame, n: int, block: int) -> DataFrame:
    """row, group, copies, chunks, chunk and grams of each set; a group's sets are dealt to chunks of about `block`, and none of the group's first chunk is empty.

    `groups` has row, group, copies (documents with this set), n_grams, and doc1 and doc2, the hashes of a document with it.
    """
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("all_grams"), F.min("row").alias("least"))
    chunks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    dealt = F.when(F.col("row") == F.col("least"), F.lit(0)).otherwise(F.pmod(F.xxhash64("row", F.lit(3)), F.col("chunks"))).cast("int")
    placed = spread_join(groups, sizes.select("group", "n", "least", chunks.alias("chunks")), "group", groups.count())
    wanted = placed.select(F.col("doc1").alias("row"), F.col("doc2").alias("row2"), F.col("row").alias("set"), "group", "copies", "chunks", dealt.alias("chunk"), F.col("copies").alias("n"))
    texts = spread_join(keyed(docs).select("row", "row2", "text"), wanted, ["row", "row2"], docs.count(), distinct=True)
    schema = "row long, group long, copies long, chunks int, chunk int, grams binary"

    def sets(batch):
        grams = []
        for _, m, value, text in shingle_sets(batch.column("text").to_pylist(), n):
            cut = np.searchsorted(text, np.arange(1, m))
            grams += [x.tobytes() for x in np.split(value, cut)]
        return {name: batch.column(name) for name in ("group", "copies", "chunks", "chunk")} | {"row": batch.column("set"), "grams": grams}

    return map_rows(texts.select("set", "group", "copies", "chunks", "chunk", "text"), schema, sets)


def ringed(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the sets of groups of more than one chunk: row, group, copies, n_grams, pivot, ring (distance from the pivot, rounded up),
    shared (n-grams that other sets of the group have too); and of their groups, far: for each two pivots, their distance, rounded down."""
    spark, parts = held.sparkSession, shuffle_partitions(held.sparkSession)
    pivot_schema = "group long, pivot int, far array<int>, grams binary"
    pivot_arrow = arrow_schema(spark, pivot_schema)

    def choose(group: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        for low, high in _groups_in(group):
            found = pivots_of(*_sets_of(table["grams"][low:high].to_pylist()))
            each = _sets_of([p.tobytes() for p in found])
            far = [distance_rings(*each, p)[0].tolist() for p in found]
            yield to_batch({"group": [group[low]] * len(found), "pivot": range(len(found)), "far": far, "grams": [p.tobytes() for p in found]}, pivot_arrow)

    first = held.where("chunk = 0").select("group", "row", "grams").repartition(parts, "group").sortWithinPartitions("group", "row")
    pivots = materialise(first.mapInArrow(lambda batches: by_key(batches, "group", choose), pivot_schema), "join-pivots")
    # A group's pivots go to each of its chunks.
    chunked = pivots.join(held.groupBy("group").agg(F.max("chunks").alias("chunks")), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "pivot", F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("copies"), "grams")
    rows = held.select("group", "chunk", F.lit(-1).alias("pivot"), "row", "copies", "grams").unionByName(chunked)
    ring_schema = "row long, group long, copies long, n_grams long, pivot int, ring int"
    ring_arrow = arrow_schema(spark, ring_schema)

    def measure(place: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, chunk, pivot = (table[name].to_numpy() for name in ("group", "chunk", "pivot"))
        for low, high in _groups_in(group, chunk):
            own = int(np.searchsorted(pivot[low:high], 0)) + low  # sets come first, then the pivots in order
            if own == low:
                continue
            value, of, sizes = _sets_of(table["grams"][low:own].to_pylist())
            best, ring = np.zeros(own - low, np.int64), np.full(own - low, RINGS + 1, np.int64)
            settled = np.zeros(own - low, bool)
            for j, p in enumerate(table["grams"][own:high].to_pylist()):
                up = distance_rings(value, of, sizes, np.frombuffer(p, np.uint64))[1]
                better = ~settled & (up < ring)
                best[better], ring[better] = j, up[better]
                settled |= 2 * THRESHOLD[1] * ring <= RINGS * (THRESHOLD[1] - THRESHOLD[0])  # the first pivot that is near enough: a cluster isn't parted
            yield to_batch({"row": table["row"][low:own].to_numpy(), "group": group[low:own], "copies": table["copies"][low:own].to_numpy(), "n_grams": sizes, "pivot": best, "ring": ring}, ring_arrow)

    placed = rows.withColumn("place", F.xxhash64("group", "chunk")).repartition(parts, "place").sortWithinPartitions("place", "group", "chunk", "pivot")
    rings = materialise(placed.mapInArrow(lambda batches: by_key(batches, "place", measure), ring_schema), "join-rings")
    shared = F.col("n_grams") - F.coalesce("alone", F.lit(0))
    rings = rings.join(alone(held), "row", "left").select("row", "group", "copies", "n_grams", "pivot", "ring", shared.alias("shared"))
    far = pivots.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pivot", "far"))).alias("far"))  # at most PIVOTS
    return rings, far.select("group", F.col("far.far").alias("far"))


def alone(held: DataFrame) -> DataFrame:
    """row, alone: how many of the set's n-grams no other set of its group has; sets without any are left out.

    A task gives the distinct n-grams of a batch, so those that all sets of a group have are hardly shuffled.
    """
    schema = "group long, gram long, n long, row long"
    arrow = arrow_schema(held.sparkSession, schema)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, row = batch.column("group").to_numpy(), batch.column("row").to_numpy()
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                value, of, _ = _sets_of(batch.column("grams").take(pa.array(rows)).to_pylist())
                found, first, times = np.unique(value, return_index=True, return_counts=True)
                yield to_batch({"group": np.full(len(found), g), "gram": found.view(np.int64), "n": times, "row": row[rows[of[first]]]}, arrow)

    each = held.select("group", "row", "grams").mapInArrow(grams, schema).groupBy("group", "gram").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    return each.where("n = 1").groupBy("row").agg(F.count(F.lit(1)).alias("alone"))


def decided(rings: DataFrame, far: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """What the pivots say. row, root, links of each set, as far as it is certain; and block, row, copies, pivot, ring, side, own
    for each comparison of a set's stratum with another that may hold links that aren't.

    A cell is the sets of one pivot and ring, at most PIVOTS * (RINGS + 1) in a group. Cells are linked for certain as a whole.
    A stratum is about `block` sets of one pivot, next to each other by their rings. A set that shares too little with all
    others of its group for any link is in none.
    """
    up, down = THRESHOLD
    rings = materialise(rings.withColumn("may", down * F.col("shared") >= up * F.col("n_grams")), "join-rings")
    weight = F.greatest(F.count_if("may") / block, F.sum(F.when(F.col("may"), F.col("n_grams")).otherwise(0)) / BLOCK_GRAMS)
    cells = rings.groupBy("group", "pivot", "ring").agg(F.count(F.lit(1)).alias("sets"), F.sum("copies").alias("copies"), F.min("row").alias("least"), weight.alias("weight"))
    before = Window.partitionBy("group", "pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)  # at most RINGS rows
    cells = cells.withColumn("at", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    of_group = cells.groupBy("group").agg(F.sum("sets").alias("n"), F.collect_list(F.struct("pivot", "ring", "copies", "least", "weight", "at")).alias("cells"))
    rows = spread_join(rings, of_group, "group", rings.count())
    linked_cells = F.filter("cells", lambda c: (c.pivot == F.col("pivot")) & (c.ring + F.col("ring") <= LIMIT))
    own_cell = F.filter("cells", lambda c: (c.pivot == F.col("pivot")) & (c.ring == F.col("ring")))[0]
    part = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    stratum = F.floor(own_cell["at"] + own_cell["weight"] * part)
    certain = materialise(rows.select("row", "group", "copies", "n_grams", "pivot", "ring", "shared", "may", stratum.alias("stratum"), linked_cells.alias("linked"), F.when(2 * F.col("ring") <= LIMIT, F.col("copies")).otherwise(F.lit(0)).alias("own")), "join-certain")
    closest = F.array_min(F.transform("linked", lambda c: F.struct(c.ring.alias("ring"), c.least.alias("least"))))["least"]
    sure = certain.select("row", F.coalesce(closest, F.col("row")).alias("root"), (F.aggregate("linked", F.lit(0).cast("long"), lambda acc, c: acc + c.copies) - F.col("own")).alias("links"))

    placed = certain.where("may").select("row", "group", "copies", "n_grams", "pivot", "ring", "shared", "stratum")
    strata = placed.groupBy("group", "pivot", "stratum").agg(F.count(F.lit(1)).alias("sets"), F.min("ring").alias("low"), F.max("ring").alias("high"), F.min("n_grams").alias("least"), F.max("shared").alias("most"))
    of_group = strata.groupBy("group").agg(F.sum("sets").alias("n"), F.collect_list(F.struct("pivot", "stratum", "low", "high", "least", "most")).alias("strata")).join(far, "group")

    def is_open(s: Column) -> Column:
        apart = F.greatest(s.low - F.col("ring"), F.col("ring") - s.high) - 1
        one = (s.high + F.col("ring") > LIMIT) & (apart < LIMIT)
        near = F.when(s.pivot == F.col("pivot"), one).otherwise(F.get(F.get("far", F.col("pivot")), s.pivot) - F.col("ring") - s.high <= LIMIT)
        return near & ((up + down) * F.least(s.most, F.col("shared")) >= up * (s.least + F.col("n_grams")))

    # A stratum meets each open one in one block. Sets stay away from strata that hold nothing open for them.
    number = lambda pivot, stratum: pivot.cast("long") * F.lit(1 << 32) + stratum
    met = spread_join(placed, of_group, "group", placed.count()).withColumn("s", F.explode(F.filter("strata", is_open)))
    met = met.select("row", "group", "copies", "pivot", "ring", number(F.col("pivot"), F.col("stratum")).alias("me"), number(F.col("s.pivot"), F.col("s.stratum")).alias("other"))
    return sure, met.select(F.xxhash64("group", F.least("me", "other"), F.greatest("me", "other")).alias("block"), "row", "copies", "pivot", "ring", (F.col("me") > F.col("other")).cast("int").alias("side"), (F.col("me") == F.col("other")).alias("own"))


def verified(groups: DataFrame, docs: DataFrame, n: int = N, block: int = BLOCK) -> tuple[DataFrame, bool]:
    """row, root, links, settled: each set's number of linked documents and its local root, once for each block that it is in;
    where settled, the local root is the only one. And whether any row isn't settled.

    `groups` is as placed_sets has it. Sets are read again from the documents.
    """
    spark = docs.sparkSession
    held = materialise(placed_sets(groups, docs, n, block), "join-placed")
    blocks = held.where("chunks = 1").select(F.xxhash64("group").alias("block"), "row", "copies", F.lit(0).alias("pivot"), F.lit(RINGS + 1).alias("ring"), F.lit(0).alias("side"), F.lit(True).alias("own"), "grams", F.lit(True).alias("settled"))
    sure, is_open = None, False
    large = held.where("chunks > 1")
    if not large.isEmpty():
        sure, met = decided(*ringed(large), block)
        met = materialise(met, "join-met")
        if is_open := not met.isEmpty():
            blocks = blocks.unionByName(met.join(large.select("row", "grams"), "row").withColumn("settled", F.lit(False)))
    out_schema = "row long, root long, links long, settled boolean"
    arrow = arrow_schema(spark, out_schema)

    def compare(key: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        row, copies = table["row"].to_numpy(), table["copies"].to_numpy()
        side, own = table["side"].to_numpy(), table["own"].to_numpy()
        pivot, ring = table["pivot"].to_numpy(), table["ring"].to_numpy()
        links, root = np.zeros(len(row), np.int64), np.arange(len(row))
        for low, high in _groups_in(key):
            value, of, lengths = _sets_of(table["grams"][low:high].to_pylist())
            same = own[low:high].all()
            left = np.arange(high - low) if same else np.flatnonzero(side[low:high] == 0)
            right = left if same else np.flatnonzero(side[low:high] == 1)
            if not len(left) or not len(right):
                continue
            i, j = linked(value, of, lengths, left, right)
            a, b = left[i], right[j]
            # Links that the pivots are certain of are counted already.
            new = (pivot[low + a] != pivot[low + b]) | (ring[low + a] + ring[low + b] > LIMIT)
            a, b = a[new], b[new]
            if same:
                a, b = a[a != b], b[a != b]  # each pair both ways
                np.add.at(links, low + a, copies[low + b])
            else:
                np.add.at(links, low + a, copies[low + b])
                np.add.at(links, low + b, copies[low + a])
            root[low:high] = low + local_roots(high - low, a, b)
        yield to_batch({"row": row, "root": row[root], "links": links, "settled": table["settled"].combine_chunks()}, arrow)

    parts = shuffle_partitions(spark)
    out = blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lambda batches: by_key(batches, "block", compare), out_schema)
    return (out if sure is None else out.unionByName(sure.withColumn("settled", F.lit(not is_open)))), is_open


def join(df: DataFrame, n: int = N, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_grams, row for each row of `df`.

    Two documents are linked at a similarity of at least 0.8; class_id is the least doc_id of the documents
    connected by links, n_links how many documents are linked to this one.
    """
    return classified(df, n, recall, small, depth, block).drop("row2", "class")


def classified(df: DataFrame, n: int = N, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """The columns of `join`, row2, and class: a number of the class, the same for all of its rows; null for a text without words."""
    spark = df.sparkSession
    with scope(spark) as held:
        embedded = materialise(embed(df, n), "join-sets")
        total = embedded.count()
        equal = embedded.where("key1 is not null").groupBy("key1", "key2").agg(
            F.min(F.struct("row", "row2")).alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.max("n_grams").cast("long").alias("n_grams"), F.first("tokens").alias("tokens"), F.first("brief").alias("brief")
        )
        # Sets are numbered as they are written: unlike hashes, two never share a number.
        equal = materialise(equal.withColumn("rep", F.monotonically_increasing_id()), "join-classes")
        with scope(spark) as inner:
            groups = components(candidates(equal.select(F.col("rep").alias("row"), "tokens", "brief"), recall, small, depth), "join-groups")
            of_set = equal.select(F.col("rep").alias("row"), "copies", "n_grams", F.col("doc.row").alias("doc1"), F.col("doc.row2").alias("doc2"))
            grouped = materialise(groups.select(F.col("node").alias("row"), F.col("root").alias("group")).join(of_set, "row"), "join-grouped")
            inner.keep(grouped)
        with scope(spark) as inner:
            checked, is_open = verified(grouped, df, n, block)
            checked = materialise(checked, "join-checked")
            inner.keep(checked)
        found = checked.groupBy(F.col("row").alias("rep")).agg(F.sum("links").alias("links"), F.min(F.when(F.col("settled"), F.col("root"))).alias("root"))
        if is_open:
            classes = components(checked.where("not settled").select(F.col("row").alias("a"), F.col("root").alias("b")), "join-links")
            found = found.join(classes.select(F.col("node").alias("rep"), F.col("root").alias("joined")), "rep", "left").select("rep", "links", F.coalesce("root", "joined").alias("root"))
        whole = equal.select("rep", "key1", "key2", "copies", "least_id").join(found, "rep", "left")
        whole = materialise(whole.select("key1", "key2", "copies", "least_id", F.coalesce("root", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "join-whole")
        names = whole.groupBy("class").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
        named = spread_join(whole, names, "class", whole.count()).select("key1", "key2", "class", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
        rows = spread_join(embedded.select("doc_id", "n_grams", "row", "row2", "key1", "key2"), named, ["key1", "key2"], total, "left")
        out = materialise(rows.select("doc_id", F.coalesce("class_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_grams", "row", "row2", "class"), "join-documents")
        held.keep(out)
    return out


def deduplicated(df: DataFrame) -> DataFrame:
    """One row of each class: that of the least id, then of the least row hash, null ids last; all columns as they are.

    Rows with the same id and text are one: any of them stays. A text without words is a class of its own.
    """
    doc_id, text = (f"c{df.columns.index(name)}" for name in ("doc_id", "text"))
    found = classified(df.select("doc_id", "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "row2")
    alone = F.when(F.col("class").isNull(), F.struct("row", "row2"))
    kept = found.groupBy("class", alone.alias("alone")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).select("first.row", "first.row2", "n")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = plain.select("*", *row_hashes(F.col(doc_id).cast("long"), F.col(text)))
    return spread_join(rows, kept, ["row", "row2"], found.count(), distinct=True).select(*plain.columns).toDF(*df.columns)
