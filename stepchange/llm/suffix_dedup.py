"""Suffix-array dedup: removes every byte under a 200-byte string that starts twice.

1. Anchors. Of each 200-byte string the 32-byte piece with the least hash is its anchor.
   Equal strings have equal anchors at equal offsets, so neighbouring strings with one
   anchor form a run, and a repeated string lies in runs whose anchors' hashes are equal.
   Anchors that occur once are dropped: none of their strings can be repeated.
2. Equal runs are counted before any text moves. All strings of a run that occurs twice are
   repeated. Only different runs that share an anchor need a look at their strings.
3. Such runs meet in buckets by anchor hash, and each bucket gets a suffix array by two-stage
   sorting: suffixes smaller than their successors are sorted directly, the others are induced
   by scanning the first-byte buckets in order. Adjacent common prefixes of 200 bytes or more
   mark repeated strings.
4. An anchor with more than HOT_RUNS different runs has its runs cut into single strings,
   which are dealt by their own hash, so no bucket is unbounded.
5. The marks go back to the runs' places, and each text is cut once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import Block, blocks, span_hashes, written

LENGTH = 200
ANCHOR = 32
#: Bytes of runs that one suffix array holds about, and different runs of one anchor that meet in it at most.
BUCKET_BYTES = 1 << 20
HOT_RUNS = 2000
#: Starts that are looked at together in a long text.
_PIECE = 1 << 19


def anchored_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of the texts data[begin:end]: place of the first start, number of starts, anchor hash, hash of the run."""
    found = []
    for low in range(0, len(data), _PIECE):
        part = data[low : low + _PIECE + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        at = np.arange(len(part) - anchor + 1)
        grams = span_hashes(part, at, at + anchor)
        # Place in the low bits: of equal hashes the first one is taken
        least = (grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        del at
        width, size = length - anchor + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        chosen = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        # Only strings inside one text
        text = np.searchsorted(begin, np.arange(low, low + n), "right") - 1
        good = np.arange(low, low + n) + length <= end[text]
        head = np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1]))
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, n))
        keep = good[first]
        first, count = first[keep], count[keep]
        whole = span_hashes(part, first, first + count + length - 1)
        found.append((first + low, count, grams[chosen[first]], whole, text[first]))
    if not found:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(x) for x in zip(*found)]


def _find_runs(length: int, anchor: int):
    def scan(batches):
        for batch in batches:
            for block in blocks(batch):
                first, count, hashes, whole, text = anchored_runs(block.data, block.begin, block.end, length, anchor)
                part = batch.slice(block.rows.start, len(block.texts))
                rows = pa.array(text)
                columns = [part.column(0).take(rows), part.column(1).take(rows), pa.array((first - block.begin[text]).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "start", "n", "anchor", "whole"])

    return scan


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes, right to `depth` symbols at least.

    text: symbols as uint16 with a 0 after each piece (and at the end); places are inside pieces. With each wanted
    place come its successors up to the next one that is sorted directly.
    """
    n = len(text)
    # Smaller than the successor: by the next different symbol
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    nxt = np.append(text, np.uint16(0))[np.minimum(at + 1, n)]
    small = text < nxt
    small[text == 0] = True  # ends of pieces are least and sorted directly
    need = np.zeros(n, bool)
    need[wanted] = True
    edge = np.flatnonzero(need[:-1] & ~need[1:] & ~small[:-1])
    while len(edge):
        edge = edge + 1
        edge = edge[~need[edge]]
        need[edge] = True
        edge = edge[~small[edge]]
    keys = seven(text)
    direct = np.flatnonzero(need & small)
    order, group, tied = direct.copy(), np.zeros(len(direct), np.int64), np.arange(len(direct))
    for level in range(0, depth, 7):
        key = keys[np.minimum(order[tied] + level, n - 1)]
        by = np.lexsort((key, group[tied]))
        order[tied], key, old = order[tied][by], key[by], group[tied]
        head = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))[: len(tied)]
        group[tied] = tied[head][np.cumsum(head) - 1]
        tied = tied[~(head & np.append(head[1:], True)[: len(tied)])]
        if not len(tied):
            break
    # Bucket scans in ascending order of first symbols; a larger suffix goes to its own bucket when its successor is met
    induced: dict[int, list[np.ndarray]] = {}
    symbols, firsts = np.unique(text[order], return_index=True)
    direct_of = dict(zip(symbols.tolist(), np.split(order, firsts[1:]))) if len(order) else {}
    out, symbol, waiting = [], -1, set(direct_of)
    larger = need & ~small
    while waiting:
        symbol = min(waiting)
        waiting.discard(symbol)
        turn = np.concatenate(induced.pop(symbol)) if symbol in induced else np.zeros(0, np.int64)
        chain = [turn]
        while len(turn):  # runs of one symbol: the larger ones follow within the bucket
            turn = turn[turn > 0] - 1
            turn = turn[larger[turn] & (text[turn] == symbol)]
            chain.append(turn)
        bucket = np.concatenate([*chain, direct_of.get(symbol, np.zeros(0, np.int64))])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > symbol)]
        owner = text[before]
        by = np.argsort(owner, kind="stable")
        values, starts = np.unique(owner[by], return_index=True)
        for value, part in zip(values.tolist(), np.split(before[by], starts[1:])):
            induced.setdefault(value, []).append(part)
            waiting.add(value)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)
    chosen[wanted] = True
    return order[chosen[order]]


def seven(text: np.ndarray) -> np.ndarray:
    """From each place seven symbols of nine bits as one number."""
    out = np.zeros(len(text), np.int64)
    padded = np.append(text, np.zeros(7, text.dtype)).astype(np.int64)
    for i in range(7):
        out = (out << 9) | padded[i : i + len(text)]
    return out


def repeated_starts(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its first `count` starts begin a string that starts again in some piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[begin + sizes] = 0
    wanted = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    order = two_stage_order(text, wanted, length)
    marks = np.zeros(len(text), bool)
    if len(order) > 1:
        keys, alive = seven(text), np.arange(len(order) - 1)
        for level in range(0, length, 7):  # adjacent common prefixes, as far as the needed length
            drop = np.int64(9 * max(0, level + 7 - length))
            alive = alive[keys[order[alive] + level] >> drop == keys[order[alive + 1] + level] >> drop]
        marks[order[alive]] = marks[order[alive + 1]] = True
    return [marks[b : b + c] for b, c in zip(begin, counts)]


def _mark_bucket(length: int):
    def mark(table: pa.Table) -> pa.Table:
        pieces = [x.as_py() for x in table["piece"]]
        counts = table["n"].to_numpy().astype(np.int64)
        spans = []
        for marks in repeated_starts(pieces, counts, length):
            edges = np.flatnonzero(np.diff(marks.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            spans.append([{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])])
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return pa.table({"anchor": table["anchor"], "whole": table["whole"], "n": table["n"], "spans": pa.array(spans, kind)})

    return mark


def repeated_spans(documents: DataFrame, length: int = LENGTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, text_hash, spans): pieces [low, high) of bytes under repeated strings, which may overlap; see cut()."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    runs = texts.mapInArrow(_find_runs(length, min(ANCHOR, length)), f"doc_id {kind}, text_hash long, start long, n int, anchor long, whole long")
    place = F.xxhash64("doc_id", "text_hash", "start")
    again = runs.select("anchor", place.alias("place")).groupBy("anchor").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi")
    # Written, so that the join's sides are plain exchanges, of which hot anchors can be split
    again = written(again.select("anchor"), "anchors")
    runs = written(runs.join(again, "anchor", "left_semi"), "runs")
    key = ["anchor", "whole", "n"]
    where = F.struct("doc_id", "text_hash", "start")
    kinds = written(runs.groupBy(*key).agg(F.min(where).alias("first"), (F.min(where) != F.max(where)).alias("twice")), "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = kinds.join(several, "anchor").select(*key, "kinds", "twice", "first.*")
    # The text of one place of each run that needs a look
    of = [F.col(c).alias(f"of_{c}") for c in ("doc_id", "text_hash")]
    asked = open_.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*key, "kinds", "start")).alias("asked")).select(*of, "asked")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("text_hash") == F.col("of_text_hash"))

    def slice_of(a: Column) -> Column:
        return F.struct(a["anchor"].alias("anchor"), a["whole"].alias("whole"), a["n"].alias("n"), a["kinds"].alias("kinds"), F.substring(F.col("text"), (a["start"] + 1).cast("int"), a["n"] + length - 1).alias("piece"))

    pieces = (
        texts.join(asked, same)
        .select(F.explode(F.transform("asked", slice_of)).alias("p"))
        .select("p.*")
        .dropDuplicates(key)
    )
    pieces = written(pieces, "pieces")
    usual = pieces.where(F.col("kinds") <= hot_runs)
    # Hot anchors: every string by itself, told by 128 bits
    hot = pieces.where(F.col("kinds") > hot_runs)
    hot = hot.select("anchor", "whole", "kinds", F.col("n").alias("of_n"), "piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    hot = hot.withColumn("piece", F.substring("piece", F.col("at") + 1, F.lit(length)))
    strings = hot.withColumn("s1", F.xxhash64("piece")).withColumn("s2", F.xxhash64(F.lit("second"), F.col("piece")))
    twin = F.struct("whole", "of_n", "at")
    pairs = strings.groupBy("s1", "s2").agg((F.min(twin) != F.max(twin)).alias("repeated")).where("repeated").select("s1", "s2")
    hot_marks = strings.join(pairs, ["s1", "s2"], "left_semi").select("anchor", "whole", F.col("of_n").alias("n"), F.array(F.struct(F.col("at").alias("low"), (F.col("at") + 1).alias("high"))).alias("spans"))
    total = usual.agg(F.sum(F.length("piece"))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    usual = usual.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets)))
    marked = (
        usual.select(*key, "piece", "bucket")
        .groupBy("bucket")
        .applyInArrow(_mark_bucket(length), "anchor long, whole long, n int, spans array<struct<low:int,high:int>>")
        .where(F.size("spans") > 0)
    )
    full = kinds.where("twice").select(*key, F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high"))).alias("spans"))
    kind_twice = kinds.where("twice").select(*key)
    part = marked.unionByName(hot_marks).join(kind_twice, key, "left_anti")
    marks = full.unionByName(part)
    starts = runs.join(marks, key).select(
        "doc_id", "text_hash", F.transform("spans", lambda s: F.struct((F.col("start") + s["low"]).alias("low"), (F.col("start") + s["high"] + (length - 1)).alias("high"))).alias("spans")
    )
    return starts.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching [low, high) as maximal ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[head, 0], reach[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)]], axis=1)


def cut(text: bytes, spans: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The text without the spans, and the spans merged."""
    spans = merged(spans)
    bounds = np.concatenate([[0], spans.ravel(), [len(text)]])
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])), spans


def dedup_substrings(documents: DataFrame, length: int = LENGTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, removed array<struct<low,high>>) for each row of documents.

    Texts are UTF-8 bytes, null and empty ones have none. A byte goes if a `length`-byte string over it starts
    anywhere else, in the same document or another; all occurrences go. Rows alike in doc_id and text are one
    document: one read twice is no copy of itself. kept may end inside a UTF-8 character.
    """
    spans = repeated_spans(documents, length, hot_runs).select(F.col("doc_id").alias("of_doc_id"), F.col("text_hash").alias("of_text_hash"), "spans")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("text_hash") == F.col("of_text_hash")), "left").select(
        "doc_id", "text", F.col("spans.low").alias("low"), F.col("spans.high").alias("high")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            kept, sizes, removed = [], [], []
            for text, low, high in zip(batch.column(1), batch.column(2), batch.column(3)):
                text = text.as_py() or b""
                gone = np.zeros((0, 2), np.int64)
                if low.is_valid and len(low.values):
                    text_kept, gone = cut(text, np.stack([low.values.to_numpy(), high.values.to_numpy()], axis=1).astype(np.int64))
                else:
                    text_kept = text
                kept.append(text_kept)
                sizes.append(len(text))
                removed.append([{"low": int(a), "high": int(b)} for a, b in gone])
            spans_kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            n_removed = [s - len(k) for s, k in zip(sizes, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans_kind)],
                ["doc_id", "kept", "n_bytes", "n_removed", "removed"],
            )

    return joined.mapInArrow(apply, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, removed array<struct<low:long,high:long>>")


def report(documents: DataFrame) -> DataFrame:
    return dedup_substrings(documents).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The result by a table of all strings, for small tables."""
    seen: dict[bytes, int] = {}
    for text in texts.values():
        for i in range(len(text) - length + 1):
            seen[text[i : i + length]] = seen.get(text[i : i + length], 0) + 1
    out = {}
    for name, text in texts.items():
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int((np.diff(gone.view(np.int8), prepend=np.int8(0)) > 0).sum())
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[name] = (len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())
    return out
