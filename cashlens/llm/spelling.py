"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are put in one global order, rare ones first. Its *prefix* is the first three (with all ties of the
third); of these, dynamic programming chooses two *pivots* that share no character and are rarest together. One edit
touches at most one of two disjoint grams. So of two words one edit apart, the one whose prefix ends earlier in the
global order has a pivot that the other holds in its prefix, moved by no more than the edit allows. The join therefore
meets pivots with prefixes on (gram, place, length) and keeps the pairs that the native edit distance confirms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import stage

RUN = "[A-Za-zÀ-ÿ]"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: place and length of a gram in the other word, relative to this one: replaced, grown by one, shrunk by one
MOVES = [(0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)]


def lower_ascii(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


def word_counts(docs: DataFrame, min_length: int = 6, drop_one_in: int = 199, flush: int = 200_000) -> DataFrame:
    """(word, n) of the runs of letters in the texts, short results left out; partial counts leave a task every ``flush`` words.

    Of a run whose crc32 together with the doc_id divides by ``drop_one_in`` one code point is deleted.
    """
    find = re.compile(f"{RUN}{{{min_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "k"])
            total.clear()
            return got

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                runs: Counter = Counter()
                for w, k in Counter(find(text)).items():
                    runs[lower_ascii(w)] += k
                for w, k in runs.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    total[w] += k
                if len(total) >= flush:
                    yield out()
        if total:
            yield out()

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, k bigint")
            .groupBy("word").agg(F.sum("k").alias("n")))


def gram_weights(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram. The alphabet has 90 letters, so this is at most 8,100 rows, whatever the corpus."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    return {r.gram: r.k for r in words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k")).collect()}


def choose_pivots(grams: list[tuple[int, int, int]], count: int = 2) -> list[tuple[int, int]]:
    """The ``count`` disjoint grams of least weight together. grams: (place, rank, weight) by place; gives (rank, place)."""
    best: list[list] = [[(0, ())] + [None] * count]                    # best[i][j]: j grams among the first i
    for i, (place, rank, weight) in enumerate(grams):
        clear = i                                                      # grams before this one that end before it
        while clear and grams[clear - 1][0] > place - 2:
            clear -= 1
        row = list(best[i])
        for j in range(1, count + 1):
            if (held := best[clear][j - 1]) is not None:
                new = (held[0] + weight, held[1] + ((rank, place),))
                if row[j] is None or new < row[j]:
                    row[j] = new
        best.append(row)
    return list(best[-1][count][1])


def profile(word: str, order: dict[str, int], weight: list[int]) -> tuple[int, list, list, int]:
    """(rank that ends the prefix, pivots, prefix grams as (rank, place), 64-bit set of the letters)."""
    grams = [(i, order[word[i:i + 2]]) for i in range(len(word) - 1)]
    last = sorted(r for _, r in grams)[2]
    prefix = [(i, r) for i, r in grams if r <= last]
    letters = 0
    for c in word:
        letters |= 1 << (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 38)
    return last, choose_pivots([(i, r, weight[r]) for i, r in prefix]), [(r, i) for i, r in prefix], letters - (1 << 64) * (letters >> 63)


def profiles(words: DataFrame) -> DataFrame:
    """word, n, size, last, letters, pivots and prefix (arrays of rank and place) of every word."""
    weights = gram_weights(words)
    ranked = sorted(weights, key=lambda g: (weights[g], g))
    shared = words.sparkSession.sparkContext.broadcast(({g: i for i, g in enumerate(ranked)}, [weights[g] for g in ranked]))
    held = pa.list_(pa.struct([("gram", pa.int32()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, weight = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).to_pylist()
            last, pivots, prefix, letters = zip(*(profile(w, order, weight) for w in names))
            as_rows = lambda col: pa.array([[{"gram": g, "place": i} for g, i in x] for x in col], held)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(w) for w in names], pa.int32()), pa.array(last, pa.int32()), pa.array(letters, pa.int64()),
                 as_rows(pivots), as_rows(prefix)], names=["word", "n", "size", "last", "letters", "pivots", "prefix"])

    side = "array<struct<gram:int,place:int>>"
    return words.select("word", "n").mapInArrow(
        run, f"word string, n bigint, size int, last int, letters bigint, pivots {side}, prefix {side}")


def near_pairs(words: DataFrame, block: int = 20_000) -> DataFrame:
    """(a, b, a_n, b_n), once in each direction, of the words (word, n) that differ by exactly one edit.

    Words of at least four code points. A (gram, place, length) that more than ``block`` prefixes hold is dealt to
    several keys, each of which meets every pivot of it, so that no task gets a popular gram whole.
    """
    p = stage(profiles(words), "spelling-profiles")
    key = ["gram", "place", "size"]
    held = p.select("word", "n", "last", "letters", "size", F.inline("prefix"))
    hot = (held.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block)
           .select(*key, F.ceil(F.col("k") / block).cast("int").alias("parts")))
    moves = F.array(*[F.struct(F.lit(i).alias("dp"), F.lit(s).alias("ds")) for i, s in MOVES])
    met = (p.select("word", "n", "last", "letters", "size", F.inline("pivots")).select("*", F.inline(moves))
           .withColumns({"place": F.col("place") + F.col("dp"), "size": F.col("size") + F.col("ds")}).where("place >= 0"))
    parts = F.coalesce("parts", F.lit(1))
    left = (met.join(hot, key, "left").select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("word").alias("a"),
                                              F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.col("letters").alias("a_letters")))
    right = (held.join(hot, key, "left").select(*key, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("b"),
                                                F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.col("letters").alias("b_letters")))
    same = [left[c] == right[c] for c in (*key, "part")]
    pairs = left.join(right, [*same, F.col("a_last") <= F.col("b_last"), F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2,
                              F.levenshtein("a", "b", 1) == 1])
    a_first = F.col("a") < F.col("b")
    once = pairs.select(F.when(a_first, F.struct("a", "b", "a_n", "b_n")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))).alias("p")).select("p.*").distinct()
    return once.select(F.inline(F.array(F.struct("a", "b", "a_n", "b_n"),
                                        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n")))))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to their last, each round twice as far, until nothing moves.

    A form is at least ``ratio`` times as frequent as its word, so there is no cycle and the rounds are few.
    """
    ways = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ways = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return ways


def spelling_groups(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_one_in: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``min_length`` code points with ``min_count`` occurrences.

    form: the near word of largest n (of equals the first in code-point order) if it is ``ratio`` times as frequent;
    root: the last of the chain of forms, or the word itself. A null or empty text has no word; a null doc_id counts as
    an empty key; repeated rows count each; very long texts are counted whole; without words (an empty table) no row
    comes out. Columns besides doc_id and text are ignored, whatever their names.
    """
    words = stage(word_counts(docs, min_length, drop_one_in).where(F.col("n") >= min_count), "spelling-words")
    best = F.min(F.struct((-F.col("b_n")).alias("k"), F.col("b").alias("form")))
    near = stage(near_pairs(words).groupBy(F.col("a").alias("word"), F.col("a_n")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
                 .withColumn("has", -F.col("best.k") >= ratio * F.col("a_n"))
                 .select("word", "n_near", F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.k")).alias("form_n")), "spelling-near")
    roots = follow(near.where("form is not null"))
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
