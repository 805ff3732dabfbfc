"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced character, and the form each goes by (op12).

The vocabulary is joined with itself in tries. Two words at distance one share all that lies before the character at
which they first differ, and all that lies behind it. So a word goes to a group of those that share its first half, for
differences in the second, and to one of those that share its second half, for differences in the first; a group of more
than `limit` words is halved again in the same way, until words of a group differ at one character only and can't be more
than the alphabet has letters. No group is gathered before its size is known. A task takes the groups one after
another: it builds the trie of the stretches in which the group's words differ and goes down it with the set of active
nodes, those at distance one from the node it stands at. At the end of a word the active nodes that end words are its
near words. A pair is found in the one group whose stretch holds the first difference; what leaves a task are counts and
best candidates for each word, not pairs.

Cases: null texts have no words; a null id counts as the text "null"; repeated rows count again; words of any length are
treated whole; an empty table, or one without a word that is frequent enough, gives no rows; of near words with equal
counts the smaller one in code-point order is the form; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import arrow_schema, materialise, to_batch
from freshet.operators.joins import spread_join
from freshet.scratch import scope

#: Least length in code points, least count, and how many times as frequent a form must be (fixed values).
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a group beyond which it is halved.
LIMIT = 4000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_KEY = ["m", "a", "b", "before", "after"]


def with_slips(doc_id: object, word: str, one_in: int = 31) -> str:
    """The word as the query counts it: in one of `one_in` cases, drawn by document and word, without one of its characters."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change: Callable[[object, str], str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters with A-Z in lower case, of at least `min_length` code points and `min_count` occurrences.

    `change` (of a document's id and a word; the same for the same two) may shorten a word before it is counted.
    """
    schema = "word string, n long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lower: Counter[str] = Counter()
                for word, n in Counter(find(text.as_py() or "")).items():
                    lower[word if word.islower() else word.translate(_LOWER)] += n
                for word, n in lower.items():
                    if change:
                        word = change(doc_id, word)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield to_batch({"word": list(held), "n": list(held.values())}, arrow)
                    held.clear()
        if held:
            yield to_batch({"word": list(held), "n": list(held.values())}, arrow)

    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def distance_one(strings: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs (i < j) of different `strings` at distance one, by a trie and its active nodes."""
    kids: list[dict[str, int]] = [{}]
    word_at = [-1]
    for i, s in enumerate(strings):
        at = 0
        for c in s:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                word_at.append(-1)
            at = to
        word_at[at] = i
    # A node's active nodes: itself at distance 0 and, kept here, those at distance 1.
    walk = [(0, set(kids[0].values()))]
    while walk:
        node, near = walk.pop()
        if (mine := word_at[node]) >= 0:
            for other in near:
                if word_at[other] > mine:
                    yield mine, word_at[other]
        below = kids[node]
        for c, kid in below.items():
            further = set(kids[kid].values())  # a character more
            further.update(below.values())  # another character
            further.add(node)  # a character less
            for other in near:
                to = kids[other].get(c)
                if to is not None:
                    further.add(to)
            further.discard(kid)
            walk.append((kid, further))


def _first_difference(x: str, y: str) -> int:
    at = 0
    for a, b in zip(x, y):
        if a != b:
            break
        at += 1
    return at


def near_in_group(m: int, a: int, b: int, before: str, after: str, middles: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs of a group that first differ inside its stretch, the longer word having m characters."""
    for i, j in distance_one(middles):
        x, y = middles[i], middles[j]
        if max(len(x), len(y)) == m - a - b and a + _first_difference(x + after, y + after) < m - b:
            yield i, j


def _grouped(rows: DataFrame) -> DataFrame:
    """word, times and the group's key from word, times, m, a and b."""
    return rows.select("word", "times", "m", "a", "b", F.expr("substring(word, 1, a)").alias("before"), F.expr("substring(word, length(word) - b + 1, b)").alias("after"))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row in two groups: one for either half of its stretch."""
    half = F.expr("(m - a - b) div 2").cast("int")
    sides = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b"))))
    return _grouped(rows.select("word", "times", "m", sides.alias("s")).select("word", "times", "m", "s.a", "s.b"))


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, near, near_n of the words of `vocabulary` (word, n) that have a near word; near is the one of largest n."""
    schema = "word string, n_near long, near string, near_n long"
    arrow = arrow_schema(vocabulary.sparkSession, schema)
    # A word is the longer one, or as long as the other, in one class, and the shorter one in the next.
    size = F.length("word").cast("int")
    classes = F.explode(F.array(size, size + 1)).alias("m")
    whole = vocabulary.select("word", F.col("n").alias("times"), classes, F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows = _halved(whole.where("m > 1")).unionByName(_grouped(whole.where("m = 1")))
    done = None
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
        large = materialise(sizes.where(f"n > {limit} and m - a - b > 1").withColumn("large", F.lit(True)), "spelling-large")
        if large.isEmpty():
            break
        rows = materialise(spread_join(rows, large, _KEY, rows.count(), "left"), "spelling-groups")
        small = rows.where("large is null").drop("large")
        done = small if done is None else done.unionByName(small)
        rows = materialise(_halved(rows.where("large")), "spelling-halves")
    rows = rows if done is None else done.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def join(key: tuple, group: list[tuple[str, int]]) -> None:
            if len(group) < 2:
                return
            m, a, b, before, after = key
            middles = [w[a : len(w) - b] for w, _ in group]
            for pair in near_in_group(m, a, b, before, after, middles):
                for i, j in (pair, pair[::-1]):
                    (word, _), (near, n) = group[i], group[j]
                    best = found.setdefault(word, [0, near, n])
                    best[0] += 1
                    if n > best[2] or (n == best[2] and near < best[1]):
                        best[1:] = near, n

        def rows_found() -> pa.RecordBatch:
            out = to_batch({"word": list(found), **{c: [v[i] for v in found.values()] for i, c in enumerate(("n_near", "near", "near_n"))}}, arrow)
            found.clear()
            return out

        key, group = None, []
        for batch in batches:
            word, times, *of_key = (c.to_pylist() for c in batch.columns)
            for w, n, k in zip(word, times, zip(*of_key)):
                if k != key:
                    if key:
                        join(key, group)
                    key, group = k, []
                group.append((w, n))
            if len(found) > HELD:
                yield rows_found()
        if key:
            join(key, group)
        yield rows_found()

    dealt = rows.select("word", "times", *_KEY).repartition(*_KEY).sortWithinPartitions(*_KEY)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    return dealt.mapInArrow(run, schema).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.n")).alias("near_n"))


def variants(vocabulary: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of `vocabulary` (word, n).

    A form is at least `ratio` (over 1) times as frequent as its word, so a chain of forms is as long as the logarithm of
    the largest count at most; following it takes as many joins as that length has binary digits.
    """
    with scope(vocabulary.sparkSession) as held:
        words = materialise(vocabulary, "spelling-words")
        near = near_words(words, limit)
        is_form = F.col("near_n") >= F.col("n") * ratio
        named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
        named = materialise(named, "spelling-forms")
        roots = named.where("form is not null").select("word", F.col("form").alias("root"))
        while True:
            up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
            if roots.join(up, "root", "left_semi").isEmpty():
                break
            roots = materialise(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")), "spelling-roots")
        out = materialise(named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling")
        held.keep(out)
    return out
