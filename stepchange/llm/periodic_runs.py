"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are the same),
of at least MIN_WORDS and EXPONENT * q words, that can't be extended on either side.

1. Re-Pair: adjacent symbols that occur together most often become a nonterminal, again and
   again until no pair occurs twice. A round replaces every pair that is more frequent than the
   pairs it overlaps, so there are few rounds; a pair has one nonterminal wherever it stands.
   Texts of a block share the rules, no pair goes across two texts. What stays of a text is
   joined by a balanced tree of nodes that occur once.
2. Of all nodes that hold a run the lowest has it across its boundary, whole. So runs are
   searched only across the boundary of each nonterminal, once, however often it occurs: a run
   of four periods has two of them on one side of the boundary, a square. Squares are found by
   hashes of prefix sums, each one inside a shorter-period run is left out (so q is smallest),
   extents by binary lifting, and both are then compared word by word.
3. Runs of a nonterminal stand at every position at which it was derived. Intervals of equal
   period that share a period's length are one run: the merged ones are maximal.

It is one pass over the texts, without a shuffle. A text is in one task, about 200 bytes a
word; work grows with n log n.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import blocks, mixed, row_of

MIN_WORDS, EXPONENT = 6, 4
#: Words of a rewritten text: (doc_id, number of words) to the numbers of the words to take, None for the text as it is.
Rewrite = Callable[[object, int], "np.ndarray | None"]
#: Squares that are tested at a time.
SLAB = 1 << 20
_P = np.int64((1 << 31) - 1)


class Collision(Exception):
    """Two different stretches have the same hash."""


class Hashes:
    """Hashes of all stretches of a sequence, modulo a prime; `equal` is never wrong about equal ones."""

    def __init__(self, words: np.ndarray, salt: int):
        n = len(words)
        base = int(np.random.default_rng(salt).integers(1 << 20, int(_P) - 1))
        self.words, self.powers = words, np.ones(n + 1, np.int64)
        size, step = 1, base
        while size <= n:
            part = self.powers[size : 2 * size]
            part[:] = self.powers[: len(part)] * step % _P
            size, step = 2 * size, step * step % int(_P)
        values = (mixed(words.astype(np.uint64) + np.uint64(salt << 32)) >> np.uint64(33)).astype(np.int64) % _P
        self.sums = np.zeros(n + 1, np.int64)
        np.cumsum(values * self.powers[:n] % _P, out=self.sums[1:])
        self.sums %= _P

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether words[a : a + length] and words[b : b + length] have one hash; a <= b."""
        left = (self.sums[a + length] - self.sums[a]) % _P * self.powers[b - a] % _P
        return left == (self.sums[b + length] - self.sums[b]) % _P

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and b on are the same, `most` at most; backwards, before a and b, for step -1."""
        found = np.zeros(len(a), np.int64)
        size = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while size:
            fits = np.flatnonzero(found + size <= most)
            at = found[fits] if step > 0 else -found[fits] - size
            fits = fits[self.equal(a[fits] + at, b[fits] + at, np.int64(size))]
            found[fits] += size
            size >>= 1
        return found


def repair(words: np.ndarray, bounds: np.ndarray):
    """Re-Pair of the texts words[bounds[i] : bounds[i + 1]].

    Returns what is left, as the positions at which its symbols begin; the rules, as (first position, length of the
    left part, length); and every derivation, as (rule, position).
    """
    n = len(words)
    symbols, at = words.astype(np.int64), np.arange(n + 1)
    lengths = np.ones(n, np.int64)  # of the symbols, by their place
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first[n] = True
    rules: dict[int, int] = {}
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    derived: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = int(symbols.max(initial=-1)) + 1
    none = fresh
    live = np.flatnonzero(~first[at[1:-1]]) if n > 1 else np.zeros(0, np.int64)
    while len(live):
        keys = (symbols[live] << 32) | symbols[live + 1]
        kinds, kind, often = np.unique(keys, return_inverse=True, return_counts=True)
        again = often[kind] > 1
        live, kind = live[again], kind[again]
        if not len(live):
            break
        # The more frequent pair wins, equals by a shuffled order (one of keys would leave long chains of losers);
        # 0 stands for a pair that occurs once
        weight = np.zeros(len(symbols) + 2, np.int64)
        bits = len(kinds).bit_length()
        weight[live + 1] = (often[kind] << bits) + (kind * 0x9E3779B1 & (1 << bits) - 1) + 1
        own = weight[live + 1]
        best = (weight[live] <= own) & (weight[live + 2] <= own)
        places, kind = live[best], kind[best]
        # Neighbours among the best are one pair repeated (aaa): every other one of them
        run = np.cumsum(np.append(True, np.diff(places) != 1)[: len(places)]) - 1
        begin = places[np.append(True, np.diff(run) > 0)[: len(places)]]
        every = (places - begin[run]) % 2 == 0
        places, kind = places[every], kind[every]
        taken, where, back = np.unique(kind, return_index=True, return_inverse=True)
        names = np.empty(len(taken), np.int64)
        added = []
        for i, key in enumerate(kinds[taken].tolist()):
            name = rules.get(key)
            if name is None:
                name = rules[key] = fresh
                fresh += 1
                added.append(i)
            names[i] = name
        new = places[where[added]]
        made.append((at[new], lengths[new], lengths[new] + lengths[new + 1]))
        derived.append((names[back] - none, at[places]))
        lengths[places] += lengths[places + 1]
        symbols[places] = names[back]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        # Pairs that didn't change and occur once stay as they are
        open_ = np.zeros(len(symbols) + 1, bool)
        open_[live] = open_[places] = True
        open_[np.maximum(places - 1, 0)] = True
        open_ = open_[:-1][keep]
        symbols, lengths, at = symbols[keep], lengths[keep], np.append(at[:-1][keep], n)
        open_[-1:] = False
        live = np.flatnonzero(open_)
        live = live[~first[at[live + 1]]]
    empty = np.zeros(0, np.int64)
    rules_ = tuple(np.concatenate([x[i] for x in made]) if made else empty for i in range(3))
    derived_ = tuple(np.concatenate([x[i] for x in derived]) if derived else empty for i in range(2))
    return at, rules_, derived_


def balanced(at: np.ndarray, bounds: np.ndarray):
    """The nodes (low, boundary, high) of balanced trees over the symbols of each text; they begin at `at`."""
    first = np.searchsorted(at, bounds)
    index = np.arange(len(at) - 1)
    begin, end = (np.repeat(x, np.diff(first)) for x in (first[:-1], first[1:]))
    local = index - begin
    inner = local > 0
    index, begin, end, local = index[inner], begin[inner], end[inner], local[inner]
    width = local & -local
    return at[index - width], at[index], at[np.minimum(index + width, end)]


def crossing(hashes: Hashes, low: np.ndarray, mid: np.ndarray, high: np.ndarray):
    """Stretches with a smallest period that is at most a quarter of their node, across its boundary: (node, start, end, period)."""
    words, found = hashes.words, []
    quarter = (high - low) // EXPONENT
    quarter[high - low < MIN_WORDS] = 0
    for right in (True, False):
        most = np.minimum(quarter, ((high - mid) if right else (mid - low)) // 2)
        nodes = np.flatnonzero(most > 0)
        total = np.cumsum(most[nodes])
        for part in np.split(nodes, np.searchsorted(total, np.arange(SLAB, int(total[-1]) if len(total) else 0, SLAB))):
            node = np.repeat(part, most[part])
            if not len(node):
                continue
            period = np.arange(len(node)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
            centre = mid[node]
            hit = np.flatnonzero(words[centre] == words[centre + period] if right else words[centre - 1] == words[centre - 1 - period])
            node, period, centre = node[hit], period[hit], centre[hit]
            hit = np.flatnonzero(hashes.equal(centre if right else centre - 2 * period, centre + period if right else centre - period, period))
            node, period = node[hit], period[hit]
            while len(node):
                head = np.append(True, node[1:] != node[:-1])
                of, q = node[head], period[head]
                a = mid[of] if right else mid[of] - q
                start = a - hashes.common(a, a + q, a - low[of], -1)
                end = a + q + hashes.common(a, a + q, high[of] - a - q, 1)
                check(words, start, end, q)
                found.append((of, start, end, q))
                # Squares inside this stretch have multiples of its period
                group = np.cumsum(head) - 1
                beyond = (mid[node] + 2 * period > end[group]) if right else (mid[node] - 2 * period < start[group])
                node, period = node[beyond & ~head], period[beyond & ~head]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def check(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
    """That the stretches have their periods, word by word."""
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        if not np.array_equal(words[s : e - q], words[s + q : e]):
            raise Collision


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Maximal intervals of each period, long enough for a run, by start, then period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    apart = period * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    new = np.append(True, reach[:-1] - apart[1:] - start[1:] < period[1:])
    begin = np.flatnonzero(new)
    start, period = start[begin], period[begin]
    end = np.maximum.reduceat(end, begin)
    long = end - start >= np.maximum(MIN_WORDS, EXPONENT * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(words: np.ndarray, bounds: np.ndarray):
    """All runs (start, end, period) of the texts words[bounds[i] : bounds[i + 1]], by start, then period."""
    at, (where, left, length), (rule, position) = repair(words, bounds)
    low, mid, high = balanced(at, bounds)
    n = len(where)
    low, mid, high = np.append(where, low), np.append(where + left, mid), np.append(where + length, high)
    for salt in count():
        try:
            node, start, end, period = crossing(Hashes(words, salt), low, mid, high)
            break
        except Collision:
            continue
    ruled = node < n
    # Each run of a rule at every place of the rule
    order = np.argsort(rule, kind="stable")
    position, uses = position[order], np.bincount(rule, minlength=n)
    begins = np.cumsum(uses) - uses
    of = node[ruled]
    times = uses[of]
    places = position[np.repeat(begins[of] - np.cumsum(times) + times, times) + np.arange(times.sum())]
    shift = places - np.repeat(where[of], times)
    starts = np.concatenate([start[~ruled], np.repeat(start[ruled], times) + shift])
    ends = np.concatenate([end[~ruled], np.repeat(end[ruled], times) + shift])
    return merged(starts, ends, np.concatenate([period[~ruled], np.repeat(period[ruled], times)]))


def _find(rewrite: Rewrite | None):
    def apply(batches):
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch):
                texts = [t.split() for t in block.texts]
                if rewrite:
                    for i, words in enumerate(texts):
                        taken = rewrite(ids[block.rows.start + i].as_py(), len(words))
                        if taken is not None:
                            texts[i] = [words[k] for k in taken.tolist()]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                bounds = np.append(0, np.cumsum(sizes))
                flat = np.empty(int(bounds[-1]), object)
                flat[:] = [w for words in texts for w in words]
                start, end, period = runs_of(pd.factorize(flat)[0].astype(np.int64), bounds)
                row = np.searchsorted(bounds, start, "right") - 1
                dropped = np.zeros(len(flat) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, end, -1)
                kept = np.cumsum(dropped[:-1]) == 0
                cut = np.bincount(row_of(bounds)[~kept], minlength=len(texts)) > 0
                out = [b" ".join(flat[a:b][kept[a:b]] if c else words) for a, b, c, words in zip(bounds[:-1], bounds[1:], cut, texts)]
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - bounds[row], end - start, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.rows.start, len(texts)), pa.array(sizes), lists, pa.array(out, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    return apply


def periodic_runs(documents: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one for each row of documents.

    Words are runs of anything but ASCII white space, numbered from 0. runs: start, length and smallest period of each
    run, by start, then period. collapsed: the words joined by one space, less those that some run contains after its
    first `period` words. Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are
    worked on alone: repeated rows and ids each have a row. rewrite: takes other words of a text for its own (a test's
    planted repetition).
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_find(rewrite), schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """For a tenth of the ids, by hash, words that repeat from some word on; a null id is left as it is."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    a = h // 10 % n
    period = 1 + (n - a) // (3 + h // 10 % 8)
    index = np.arange(n)
    return np.where(index < a, index, a + (index - a) % period)


def report(documents: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """Digest columns of periodic_runs; those of the longest run (the first of them) are null without a run."""
    found = periodic_runs(documents, rewrite)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.shorter")
    return found.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
