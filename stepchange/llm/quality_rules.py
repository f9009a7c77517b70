"""Quality rules with risk-controlled thresholds.

Measures of a text (rates of symbols, repeated lines, repeated words, capitals, marks,
word length) reject it above cutoffs. Cutoffs come from labelled good texts, by stratum
(language): one half gives the measures' quantiles at ever stricter levels, the other
half, the holdout, says at each level how many good texts all rules together reject. A
level is taken if the exact binomial upper bound of its false rejections is within RISK;
levels are tried from lenient to strict and the first failure ends the trial (a fixed
sequence), and the error rate is divided among the strata (Bonferroni). So, with
probability 1 - DELTA, no stratum loses more than RISK of its good texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepchange.functions.quantiles import exact_quantiles
from stepchange.llm.common import GRAPHIC, Block, blocks, byte_table, mixed, remainder, row_of, row_sums, span_hashes, written

RISK, DELTA = 0.02, 0.05
#: Shares of good texts of the fitting half that a single rule rejects at each level.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008)
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = byte_table(b"#*$%&|<>")
CAPITALS, MARKS, LINE = byte_table(range(65, 91)), byte_table(b"!?"), byte_table(set(range(256)) - {10})
MEASURES = {
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "capital_rate": "n_capitals / word_chars",
    "mark_rate": "n_marks / n_words",
    "word_length": "word_chars / n_words",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def doubled(row: np.ndarray, hashes: np.ndarray, later: bool) -> np.ndarray:
    """Which items occur again among those of their row; with `later`, the first one is not marked."""
    keys = mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not later:
        out[order[:-1][same]] = True
    return out


def block_counts(block: Block) -> dict[str, np.ndarray]:
    data = block.data
    begin, end, first = block.words(GRAPHIC)
    row = row_of(first)
    bounds = np.append(block.begin, len(data))
    tally = lambda mask: row_sums(mask.astype(np.int64), bounds)
    repeated = np.zeros(len(begin), bool)
    if len(begin) > 2:
        words = span_hashes(data, begin, end)
        step = np.uint64(0xD6E8FEB86659FD93)
        windows = mixed((words[:-2] * step + words[1:-1]) * step + words[2:])
        inside = np.flatnonzero(row[:-2] == row[2:])
        at = inside[doubled(row[inside], windows[inside], later=False)]
        for i in range(3):
            repeated[at + i] = True
    # Lines with a word: the first word after a line's begin is inside it
    low, high = (np.append(0, np.flatnonzero(data == 10) + 1)[:-1], np.flatnonzero(data == 10))
    next_word = np.append(begin, len(data))[np.searchsorted(begin, low)]
    worded = next_word < high
    low, high = low[worded], high[worded]
    line_row = np.searchsorted(block.begin, low, "right") - 1
    line_first = np.searchsorted(low, bounds)
    again = doubled(line_row, span_hashes(data, low, high), later=True)
    return {
        "n_words": np.diff(first),
        "word_chars": tally(GRAPHIC[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": tally(SYMBOLS[data]),
        "n_dup_lines": row_sums(again.astype(np.int64), line_first),
        "n_repeat_words": row_sums(repeated.astype(np.int64), first),
        "n_lines": np.diff(line_first),
        "n_capitals": tally(CAPITALS[data]),
        "n_marks": tally(MARKS[data]),
    }


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, counts) of each row; null and empty texts have counts of 0."""
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}

    def apply(batches):
        for batch in batches:
            for block in blocks(batch):
                counts = block_counts(block)
                n = len(block.texts)
                own = [batch.column(i).slice(block.rows.start, n) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], ["doc_id", "lang", *COUNTS])

    texts = documents.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(apply, ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"{c} long" for c in COUNTS]))


def with_measures(counts: DataFrame) -> DataFrame:
    def rate(expression: str) -> Column:
        above, below = expression.split(" / ")
        return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.withColumns({name: rate(e) for name, e in MEASURES.items()}).withColumn("base_failed", failed).withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit("(none)")))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k in n were seen, wrong with probability delta."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:  # of k or fewer in n
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > delta else (low, mid)
    return high


def quantiles(rows: DataFrame, levels=LEVELS) -> DataFrame:
    """(stratum, an array a measure): of each level the least value that a share 1 - level of the rows doesn't exceed.

    Ranks are found by counts of bins and of one bin's parts, so no stratum meets in one task.
    """
    return exact_quantiles(rows, ["stratum"], {m: F.col(m) for m in MEASURES}, [1.0 - x for x in levels])


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, levels=LEVELS) -> dict[str, dict[str, float]]:
    """By stratum the cutoffs of the rules; a stratum without a level within the risk has none and rejects nothing.

    measures: see with_measures. labels: (doc_id, quality), 1 for good. Texts that fail the base rules aren't used.
    The ids' crc32 says which half a labelled text is in.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    half = F.when(remainder("doc_id", 2) == 0, "fit").otherwise("holdout")
    rows = written(measures.where(~F.col("base_failed")).join(good, "doc_id").select("stratum", half.alias("half"), *MEASURES), "good")
    fitted = written(quantiles(rows.where("half = 'fit'"), levels), "cutoffs")
    exceeds = F.lit(False)
    for m in MEASURES:
        exceeds = exceeds | (F.col(m) > F.element_at(f"c_{m}", F.col("level")))
    tried = rows.where("half = 'holdout'").join(fitted.select("stratum", *[F.col(m).alias(f"c_{m}") for m in MEASURES]), "stratum")
    tried = tried.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(len(levels)))))
    # Strata times levels: what the driver sees grows with the languages only
    seen = {(r.stratum, r.level): (r.k, r.n) for r in tried.groupBy("stratum", "level").agg(F.count(F.when(exceeds, 1)).alias("k"), F.count("*").alias("n")).collect()}
    found = {r.stratum: r for r in fitted.collect()}
    chosen = {}
    for stratum, row in found.items():
        level = 0
        while (stratum, level + 1) in seen and upper_bound(*seen[stratum, level + 1], delta / len(found)) <= risk:
            level += 1
        chosen[stratum] = {m: row[m][level - 1] for m in MEASURES} if level else {}
    return chosen


def judged(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts and measures of each row with base_failed, kept and `rules`, the names of rules that it fails.

    Null and empty texts fail the base. A stratum that was not seen in labels rejects nothing beyond the base.
    """
    measures = with_measures(written(measured(documents), "measures"))
    limits = cutoffs(measures, labels, **options)
    rules = []
    for m in MEASURES:
        limit = F.lit(None).cast("double")
        for stratum, of in limits.items():
            if m in of:
                limit = F.when(F.col("stratum") == stratum, F.lit(float(of[m]))).otherwise(limit)
        rules.append(F.when(F.col(m) > limit, F.lit(m)))
    out = measures.withColumn("rules", F.array_compact(F.array(*rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(documents, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.array_join("rules", ",").alias("rules"))


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base columns by plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)
