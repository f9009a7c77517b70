"""Benchmark decontamination by suffix arrays of the training words.

Every task holds a shard of the training texts. Its words become numbers of the
benchmark's vocabulary (0: not in it), the suffixes that could hold a window are
sorted into a suffix array, and every test window is found in it by binary search;
runs of found windows along one test item give the longest verbatim matches. A text
lies in one shard, so nothing is shuffled. The benchmark is searched for in blocks of
a bounded number of bytes, each broadcast by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.llm.common import ALNUM, Block, blocks, lowered, row_of, row_sums, span_hashes

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds.
BENCHMARK_BYTES = 8 << 20


class Tests:
    """A block of test items: vocabulary, and the distinct windows with the items they are of."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.window = window
        self.ids = sorted({name for name, _ in rows})
        number = {name: i for i, name in enumerate(self.ids)}
        block = Block(slice(0, len(rows)), [text for _, text in rows])
        data = lowered(block.data)
        begin, end, first = block.words(ALNUM, data)
        hashes = span_hashes(data, begin, end)
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        counts = np.diff(first)
        per_item = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(rows)), per_item)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        start, length = first[item] + offset, np.minimum(counts[item], window)
        padded = np.append(words + 1, np.zeros(window, np.int64)).astype(np.int32)
        grid = padded[start[:, None] + np.arange(window)]
        grid[np.arange(window) >= length[:, None]] = 0
        self.grid, kind = np.unique(grid.reshape(-1, window), axis=0, return_inverse=True)
        kind = kind.ravel()
        self.lengths = (self.grid > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.grid) else 0
        # Which items have a window, and the windows' places along their items for matches longer than one window
        owner = np.array([number[name] for name, _ in rows], np.int64)
        by = np.argsort(kind, kind="stable")
        self.owners, self.item_rows, self.offsets = owner[item[by]], item[by], offset[by]
        self.owner_first = np.searchsorted(kind[by], np.arange(len(self.grid) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.coarse[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


def packed(tokens: np.ndarray, at: np.ndarray, per: int, bits: int) -> np.ndarray:
    """`per` tokens from each place as one number; places past the end hold 0."""
    out = np.zeros(len(at), np.int64)
    for i in range(per):
        out = (out << bits) | tokens[np.minimum(at + i, len(tokens) - 1)]
    return out


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int, per: int, bits: int) -> np.ndarray:
    """The starts by their next `depth` tokens. Only suffixes that are still equal are looked at further on.

    The last token must be 0.
    """
    order, group, tied = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts))
    for level in range(0, depth, per):
        key = packed(tokens, order[tied] + level, per, bits)
        by = np.lexsort((key, group[tied]))
        order[tied], key, old = order[tied][by], key[by], group[tied]
        head = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))[: len(tied)]
        group[tied] = tied[head][np.cumsum(head) - 1]
        tied = tied[~(head & np.append(head[1:], True)[: len(tied)])]
        if not len(tied):
            break
    return order


def find_windows(tokens: np.ndarray, order: np.ndarray, tests: Tests, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that occur, and the bounds of their suffixes in the array, by binary search."""
    bits, short = tests.bits, min(per, tests.shortest)
    heads = packed(tokens, order, short, bits)
    wanted = np.zeros(len(tests.grid), np.int64)
    for i in range(short):
        wanted = (wanted << bits) | tests.grid[:, i]
    low, high = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
    which = np.flatnonzero(low < high)
    low, high, length = low[which], high[which], tests.lengths[which]

    def side(upper: bool) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            order_at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(which), np.int64)
            for i in range(short, tests.window):
                live = (sign == 0) & (i < length) & open_
                if not live.any():
                    break
                sign[live] = np.sign(tokens[np.minimum(order_at[live] + i, len(tokens) - 1)] - tests.grid[which[live], i])
            right = open_ & ((sign < 0) | (upper & (sign == 0)))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    low, high = side(False), side(True)
    found = low < high
    return which[found], low[found], high[found]


def search(block: Block, tests: Tests) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]], np.ndarray]:
    """Of each text: words, runs of hit words (begin, end), items found, and words of the longest match."""
    rows = len(block.texts)
    data = lowered(block.data)
    begin, end, first = block.words(ALNUM, data)
    n_words, spans, items, longest = np.diff(first), [[] for _ in range(rows)], [[] for _ in range(rows)], np.zeros(rows, np.int64)
    if not len(tests.grid) or not len(begin):
        return n_words, spans, items, longest
    row = row_of(first)
    # A 0 after each text, so that no window runs on into the next one
    tokens = np.zeros(len(begin) + rows + 1, np.int64)
    place = np.arange(len(begin)) + row
    tokens[place] = tests.numbers(span_hashes(data, begin, end))
    ends = np.where(tokens == 0, np.arange(len(tokens)), len(tokens))
    left = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(tokens))
    starts = np.flatnonzero(left >= tests.shortest)
    if not len(starts):
        return n_words, spans, items, longest
    per = max(1, 62 // tests.bits)
    order = suffix_array(tokens, starts, tests.window, per, tests.bits)
    which, low, high = find_windows(tokens, order, tests, per)
    if not len(which):
        return n_words, spans, items, longest
    count = high - low
    window = np.repeat(which, count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    row_at = np.repeat(np.arange(rows), np.diff(first) + 1)
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + tests.lengths[window], -1)
    hit = np.append(np.cumsum(change)[:-1] > 0, False)
    edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0)))
    for b, e in zip(edges[::2], edges[1::2]):
        r = int(row_at[b])
        base = int(first[r]) + r
        spans[r].append((int(b) - base, int(e) - base))
    # Items of a text: distinct windows of it, then their owners
    pairs = np.unique(row_at[at] * len(tests.grid) + window)
    pair_row, pair_window = pairs // len(tests.grid), pairs % len(tests.grid)
    n_owners = np.diff(tests.owner_first)[pair_window]
    flat = np.arange(n_owners.sum()) - np.repeat(np.cumsum(n_owners) - n_owners, n_owners) + np.repeat(tests.owner_first[pair_window], n_owners)
    for pair in np.unique(np.repeat(pair_row, n_owners) * len(tests.ids) + tests.owners[flat]):
        items[pair // len(tests.ids)].append(tests.ids[pair % len(tests.ids)])
    # Longest: neighbouring windows of an item on neighbouring places are one match
    owners = np.diff(tests.owner_first)[window]
    flat = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(tests.owner_first[window], owners)
    at_flat, size = np.repeat(at, owners), np.repeat(tests.lengths[window], owners)
    by = np.lexsort((at_flat, at_flat - tests.offsets[flat], tests.item_rows[flat]))
    a, o, it = at_flat[by], tests.offsets[flat][by], tests.item_rows[flat][by]
    new = np.append(True, (it[1:] != it[:-1]) | (a[1:] - o[1:] != a[:-1] - o[:-1]) | (a[1:] != a[:-1] + 1))
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(a))) - 1 + size[by][heads]
    np.maximum.at(longest, row_at[a[heads]], lengths)
    return n_words, spans, items, longest


def test_blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator:
    """Broadcasts of Tests, each of about `limit` bytes of benchmark text; an item lies in one of them."""
    spark: SparkSession = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # Blocks by hash of the text hold about as much each
    n = -(-total // limit) or 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).dropDuplicates()
        yield spark.sparkContext.broadcast(Tests([(r.item_id, bytes(r.text)) for r in part.sort("item_id", "text").collect()], window))


RESULT = "n_words long, spans array<struct<begin:int,end:int>>, items array<string>, longest long"


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, longest) for each row of documents.

    Words are runs of ASCII letters and digits and any other non-ASCII characters, A-Z as a-z. A window is `window`
    consecutive words of an item, or all its words if it has fewer. spans: runs [begin, end) of words inside
    occurrences; items: ids of the items with an occurring window, as strings, in order, a null id as "null";
    longest: words of the longest verbatim match (0: none). Null and empty texts have no words and no hits; items
    without words have no windows; rows of one item_id are one item. Words are compared by 64-bit hashes.
    """

    def pass_over(tests):
        def scan(batches):
            for batch in batches:
                for block in blocks(batch):
                    n_words, spans, items, longest = search(block, tests.value)
                    part = batch.slice(block.rows.start, len(block.texts))
                    columns = [pa.array(n_words), pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())), pa.array(longest)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_hash", "n_words", "spans", "items", "longest"])

        kind = documents.schema["doc_id"].dataType.simpleString()
        texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
        return texts.mapInArrow(scan, f"doc_id {kind}, text_hash long, {RESULT}")

    passes = [pass_over(tests) for tests in test_blocks(benchmark, window, limit)]
    found = passes[0]
    for one in passes[1:]:
        found = found.unionByName(one)
    if len(passes) > 1:
        # Rows alike in id and text have the same result, which is given as often as there are rows
        found = (
            found.groupBy("doc_id", "text_hash")
            .agg(
                F.max("n_words").alias("n_words"),
                F.flatten(F.collect_set("spans")).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                F.max("longest").alias("longest"),
                (F.count("*") / len(passes)).cast("int").alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        )
        words = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1)))))
        found = found.withColumn("n_hit", F.size(words).cast("long"))
    else:
        found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long"))
    return found.select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"), "spans", "longest")


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """The documents without a hit, all columns kept. Null and empty texts stay. See matches."""
    columns = documents.columns
    held = documents.select(F.struct(*columns).alias("row"), F.col("text").cast("binary").alias("text"))
    for tests in test_blocks(benchmark, window, limit):

        def keep(batches, tests=tests):
            for batch in batches:
                clean = [not s for block in blocks(batch) for s in search(block, tests.value)[1]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        held = held.mapInArrow(keep, held.schema)
    return held.select(*[F.col("row")[c].alias(c) for c in columns])


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS v
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS v FROM t, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, item_id, p.n, i FROM places p JOIN windows w ON p.n = w.n AND p.v = w.v
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
), chains AS (
  SELECT DISTINCT h.doc_id, h.item_id, h.n, h.i, k.o FROM hits h JOIN (
    SELECT item_id, i AS o, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS v
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
  ) k ON h.item_id = k.item_id AND h.n = k.n JOIN places p ON p.doc_id = h.doc_id AND p.n = h.n AND p.i = h.i WHERE p.v = k.v
), longest AS (
  SELECT doc_id, max(c) AS longest FROM (
    SELECT doc_id, count(*) - 1 + max(n) AS c FROM (
      SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - o ORDER BY i) AS g FROM chains
    ) GROUP BY doc_id, item_id, i - o, g
  ) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
