"""Spelling variants: words one edit apart, by PartEnum signatures of their letter multisets.

1. Tasks count words of their texts and send one row a word and task; counts are summed by word.
2. A word's letters are a binary vector over (letter, how many times before). One edit changes
   two entries at most. The entries are dealt to PARTS parts by hash; two vectors at Hamming
   distance two agree on all but two parts, so each choice of two parts to leave out gives a
   signature, an exact sum of hashes of the rest, and near words share one of them.
3. Anagrams, and words that differ in all but a few letters, would share signatures too. One edit
   leaves the first or the last half of the shorter word as it is, so a signature goes with one of
   these halves, which keeps buckets small and loses no pair.
4. Words are joined on signatures and verified by their edit distance in the join itself.
5. A word's form is the most frequent near word, if it is at least RATIO times as frequent. Forms
   are followed by pointer doubling: counts at least double in each step, so few turns are needed.

What is shuffled grows with distinct words, not with texts. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import mixed, written

RUN = re.compile("[a-zÀ-ÿ]+")
PARTS = 4
RATIO = 2
MIN_POINTS, MIN_COUNT = 5, 3
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 18
#: A word of a text as it is to be counted: (doc_id, word) to a word, None for the word itself.
Misspell = Callable[[bytes, str], "str | None"]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def slip(doc_id: bytes, word: str) -> str | None:
    """The word less a letter, for one of 97 pairs of id and word by hash."""
    h = crc32(word.encode(), crc32(doc_id + b":"))
    if h % 97:
        return None
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def _count(misspell: Misspell | None):
    def apply(batches):
        held: Counter[str] = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                words = RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))
                if misspell:
                    changed = [(w, other) for w in set(words) if (other := misspell(doc_id or b"", w)) is not None]
                    for word, other in changed:
                        times = words.count(word)
                        held[other] += times
                        held[word] -= times
                held.update(words)
                if len(held) > HELD:
                    yield sent()
                    held = Counter()
        yield sent()

    return apply


def word_counts(documents: DataFrame, misspell: Misspell | None = None) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z, and how often they occur."""
    rows = documents.select(F.col("doc_id").cast("string").cast("binary").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(_count(misspell), "word string, n long")
    return counted.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, base, signature): base is the length of the shorter word that the signature is for."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    row = np.repeat(np.arange(len(words)), sizes)
    # The letter's place among its equals in the word
    key = (row << 21) | points
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)[: len(key)]
    place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    entries = mixed(((points[order] << 32) | place).astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (row[order], (mixed(entries) % np.uint64(PARTS)).astype(np.int64)), entries)
    # Hashes of the first and of the last letters, from powers of a base
    step = np.uint64(0x9E3779B97F4A7C15)
    powers = np.ones(int(sizes.max(initial=0)) + 2, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, step), out=powers[1:])
    spread = mixed(points.astype(np.uint64) + np.uint64(1))
    fore = np.append(np.uint64(0), np.cumsum(spread * powers[np.arange(len(points)) - bounds[row]], dtype=np.uint64))
    back = np.append(np.uint64(0), np.cumsum(spread * powers[bounds[row + 1] - 1 - np.arange(len(points))], dtype=np.uint64))
    rows, bases, found = [], [], []
    every = np.arange(len(words))
    for shorter in (0, 1):
        base = sizes - shorter
        halves = fore[bounds[:-1] + base // 2] - fore[bounds[:-1]], back[bounds[1:]] - back[bounds[1:] - (base - base // 2)]
        for side, half in enumerate(halves):
            for left_out in combinations(range(PARTS), 2):
                rest = sums.sum(axis=1, dtype=np.uint64) - sums[:, left_out[0]] - sums[:, left_out[1]]
                salt = np.uint64((side * PARTS + left_out[0]) * PARTS + left_out[1] + 1)
                found.append(mixed(mixed(mixed(rest + salt) + half) + base.astype(np.uint64)))
                rows.append(every)
                bases.append(base)
    return np.concatenate(rows), np.concatenate(bases), np.concatenate(found).view(np.int64)


def _signatures(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        if words:
            row, base, found = signatures(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(base.astype(np.int32)), pa.array(found)], ["word", "base", "signature"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) for every ordered pair of different words of `words` (word) that are one edit of a code point apart."""
    signed = words.select("word").mapInArrow(_signatures, "word string, base int, signature long")
    # Written, so that the join's sides are plain exchanges, of which large buckets can be split
    signed = written(signed, "signatures")
    size = F.length("word")
    left = signed.select("signature", "base", F.col("word").alias("a")).where(size == F.col("base"))
    right = signed.select("signature", "base", F.col("word").alias("b"))
    # The left word is the shorter one; of equal lengths each pair comes once
    pairs = left.join(right, ["signature", "base"]).where(((F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    once = written(pairs.select("a", "b").distinct(), "near")
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), by pointer doubling; forms have no cycle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(counts: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root), one for each of `counts` (word, n) that is long and frequent enough.

    n_near: words that are one inserted, deleted or replaced code point away. form: of those the one with the
    largest n, the smallest in code-point order of several, if its n is at least `ratio` times the word's; else null.
    root: where forms lead, the word itself without a form. `ratio` must be over 1, or forms could go round. A null
    word is left out; a word in several rows counts as one, with their sum.
    """
    summed = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(summed.where((F.length("word") >= min_points) & (F.col("n") >= min_count)), "words")
    near = near_words(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    # The greatest count first, then the smallest word
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("n_b").alias("most"), F.min_by("b", F.struct(-F.col("n_b"), "b")).alias("best"))
    found = words.join(best, "word", "left")
    stands = F.col("most") >= ratio * F.col("n")
    found = written(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("best")).alias("form"), F.when(stands, F.col("most")).alias("form_n")), "forms"
    )
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(documents: DataFrame) -> DataFrame:
    """Variants among the words of whole texts, some of them misspelt by `slip`.

    Null and empty texts have no words; a null doc_id is the empty text in `slip`. Repeated rows count again.
    """
    found = spelling_variants(word_counts(documents, slip))
    return found.select("word", "n", "n_near", "form", "form_n", "root")
