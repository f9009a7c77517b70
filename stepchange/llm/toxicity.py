"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training runs in SHARDS tasks at a time: each goes once over its part of the labelled
texts, updating its own copy of the per-coordinate state, and the copies are averaged
after each epoch. The L1 term leaves most weights at exactly zero; what is broadcast is
an array of 2**BITS floats at most, whatever the corpus. A part of the learning rows sets
where 0.5 is. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import ALNUM, Block, blocks, lowered, mixed, remainder, removed, row_of, row_sums, span_hashes, written


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18  # 2**bits hashed features
    orders: tuple[int, ...] = (1, 2)  # n-grams
    skips: tuple[int, ...] = (1, 2)  # pairs of words with so many words between
    alpha: float = 20.0  # step of a coordinate: alpha / (beta + root of its squared gradients)
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.0
    bias_alpha: float = 0.1  # the bias begins at the sample's log odds and moves by smaller steps
    positive: float = 8.0  # weight of a toxic row at most; less if fewer rows are clean
    epochs: int = 5
    shards: int = 4  # at most
    shard_rows: int = 5_000  # rows of a shard, unless that makes more than `shards`
    clean: float = 0.98  # of the clean rows that set the cut-off, the least share left alone
    calibration: int = 4  # one of so many learning rows sets the cut-off
    labelled: int = 20_000  # ids with a usable text that a model is fitted on at most, those with the least hash
    row_bytes: int = 1 << 20  # longer labelled texts are left out of the fit
    sample_bytes: int = 1 << 28  # of all texts of a fit; ids beyond it are left out, those with the greatest hash first


def features(block: Block, params: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, sorted and distinct within it, and their bounds by text."""
    data = lowered(block.data)
    begin, end, first = block.words(ALNUM, data)
    words, row = span_hashes(data, begin, end), row_of(first)
    gaps = [(0,)] + [tuple(range(n)) for n in params.orders if n > 1] + [(0, skip + 1) for skip in params.skips]
    if 1 not in params.orders:
        gaps = gaps[1:]
    shift = np.uint64(64 - params.bits)
    parts = []
    for salt, gap in enumerate(gaps):
        n = len(words) - gap[-1]
        if n <= 0:
            continue
        h = np.full(n, salt + 1, np.uint64)
        for g in gap:
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[g : g + n]
        inside = row[:n] == row[gap[-1] : gap[-1] + n]
        parts.append((row[:n][inside].astype(np.int64) << params.bits) | (mixed(h)[inside] >> shift).astype(np.int64))
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    bounds = np.searchsorted(keys, np.arange(len(block.texts) + 1, dtype=np.int64) << params.bits)
    return keys & ((1 << params.bits) - 1), bounds


def weights(z: np.ndarray, n: np.ndarray, params: FtrlParams) -> np.ndarray:
    """The closed form of the weights: zero where |z| is at most l1."""
    step = (params.beta + np.sqrt(n)) / params.alpha + params.l2
    return np.where(np.abs(z) <= params.l1, 0.0, (np.sign(z) * params.l1 - z) / step)


def scale(n_features: np.ndarray | int):
    """A text's features have a common value, so that long texts don't outweigh short ones in an update."""
    return 1.0 / np.sqrt(np.maximum(n_features, 1))


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def bias_step(bias: np.ndarray, error: float, params: FtrlParams) -> None:
    """One update of the bias (value, squared gradients), in place."""
    bias[1] += error * error
    bias[0] -= params.bias_alpha / (1.0 + np.sqrt(bias[1])) * error


def _epoch(params: FtrlParams, state, positive: float):
    """One pass over a shard, as a table of the coordinates that it met; the bias stands at -1."""

    def fit(shard: pa.Table) -> pa.Table:
        z, n, bias = (x.copy() for x in state.value)
        # The same order in every run
        shard = shard.sort_by([("key", "ascending"), ("text", "ascending")])
        for batch in shard.select(["text", "label"]).to_batches():
            labels = batch.column(1).to_numpy()
            for block in blocks(batch):
                found, bounds = features(block, params)
                for i, label in enumerate(labels[block.rows]):
                    at = found[bounds[i] : bounds[i + 1]]
                    value = scale(len(at))
                    w = weights(z[at], n[at], params)
                    error = (probability(w.sum() * value + bias[0]) - label) * (positive if label else 1.0)
                    g = error * value
                    z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha * w
                    n[at] += g * g
                    bias_step(bias, error, params)
        used = np.flatnonzero(n > 0)
        return pa.table({"at": np.append(used, -1), "z": np.append(z[used], bias[0]), "n": np.append(n[used], bias[1])})

    return fit


def _sample(documents: DataFrame, labels: DataFrame, params: FtrlParams) -> DataFrame:
    """(key, text, label, fold) of the learning rows, one text an id, written; at most `labelled` rows and `sample_bytes`."""
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.length("text") <= params.row_bytes)
    # Distinct in the tasks first, so that rows of one id don't meet in the join
    usable = rows.where(F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).select("doc_id").distinct()
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .join(usable, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.labelled)
    )
    # At most `labelled` ids, 16 bytes each: a broadcast of a known size
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"), F.min("text").alias("text"))
    found = written(found.select(F.xxhash64("doc_id").alias("key"), "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(params.calibration)).alias("fold")), "labelled")
    sizes = found.select("key", F.length("text").alias("bytes")).toArrow().sort_by("key")
    beyond = np.flatnonzero(np.cumsum(sizes["bytes"].to_numpy()) > params.sample_bytes)
    return found.where(F.col("key") < int(sizes["key"][int(beyond[0])].as_py())) if len(beyond) else found


def _fitted(sample: DataFrame, params: FtrlParams) -> tuple[np.ndarray, float]:
    """Weights and bias of the sample's rows."""
    spark = sample.sparkSession
    sums = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rows, toxic = int(sums[0]), float(sums[1])
    positive = min(params.positive, max(1.0, (rows - toxic) / max(1.0, toxic)))
    shards = max(1, min(params.shards, -(-rows // params.shard_rows)))
    z, n = np.zeros(1 << params.bits), np.zeros(1 << params.bits)
    bias = np.array([np.log((positive * toxic + 0.5) / (rows - toxic + 0.5)) if rows else 0.0, 0.0])
    # A shard is a bounded part of a bounded sample
    sharded = sample.withColumn("shard", F.pmod("key", F.lit(shards)))
    for _ in range(params.epochs if rows else 0):
        state = spark.sparkContext.broadcast((z, n, bias))
        parts = sharded.groupBy("shard").applyInArrow(_epoch(params, state, positive), "at long, z double, n double")
        # A shard that never met a coordinate has no say in it
        mean = parts.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        # Its blocks leave the driver, too
        state.destroy()
        at, new_z, new_n = (mean[c].to_numpy() for c in ("at", "z", "n"))
        inner = at >= 0
        z[at[inner]], n[at[inner]] = new_z[inner], new_n[inner]
        bias = np.array([new_z[~inner][0], new_n[~inner][0]])
    return weights(z, n, params), float(bias[0])


def cut_off(margins: np.ndarray, labels: np.ndarray, clean: float) -> float:
    """The margin from which rows count as toxic: most recall and clean rows left alone, of these a share of `clean` at least.

    The middle between the two rows that it parts; 0 if one of the classes has no rows.
    """
    if not (labels > 0).any() or (labels > 0).all():
        return 0.0
    order = np.argsort(margins, kind="stable")
    margins, toxic = margins[order], labels[order] > 0
    spared = np.append(0, np.cumsum(~toxic)) / (~toxic).sum()
    caught = 1 - np.append(0, np.cumsum(toxic)) / toxic.sum()
    # Between equal margins there is no cut
    apart = np.concatenate([[True], margins[1:] > margins[:-1], [True]])
    gain = np.where(apart & (spared >= clean), spared + caught, -1)
    best = int(gain.argmax())
    if best == len(margins):
        return float(margins[-1]) + 1.0
    return float(margins[best - 1] + margins[best]) / 2 if best else float(margins[0]) - 1.0


def train(documents: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows (doc_id, toxic) whose crc32(doc_id) modulo 5 isn't 0.

    Labels that are null are left out; several labels of one id count as the greatest, of several texts of one id the
    least in byte order is learned from. Labels without a document, or with only null or too long texts, take no
    place in the sample. The cut-off at 0.5 is set on rows that a first model has not seen; the second one has all
    rows. Without rows all weights are 0.
    """
    sample = _sample(documents, labels, params)
    first = _fitted(sample.where("fold <> 0"), params)
    held = sample.where("fold = 0").select("key", "text", "label")
    scored = score(held.withColumnRenamed("key", "doc_id"), first, params).select(F.col("doc_id").alias("key"), "score")
    rows = held.select("key", "label").join(scored, "key").select("label", "score").toArrow()
    chance = np.clip(rows["score"].to_numpy(), 1e-12, 1 - 1e-12)
    cut = cut_off(np.log(chance / (1 - chance)), rows["label"].to_numpy(), params.clean)
    w, b = _fitted(sample, params)
    removed(sample)
    return w, b - cut


def block_scores(block: Block, w: np.ndarray, b: float, params: FtrlParams) -> np.ndarray:
    found, bounds = features(block, params)
    return probability(row_sums(w[found], bounds) * scale(np.diff(bounds)) + b)


def score(documents: DataFrame, model: tuple[np.ndarray, float], params: FtrlParams = FtrlParams()) -> DataFrame:
    """(doc_id, score) of each row, 0 to 1. Null, empty and wordless texts get the score of the bias alone."""
    held = documents.sparkSession.sparkContext.broadcast((np.float32(model[0]), model[1]))

    def apply(batches):
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.texts)), pa.array(block_scores(block, *held.value, params))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(apply, f"doc_id {kind}, score double")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, params: FtrlParams = FtrlParams()) -> DataFrame:
    """The documents with a score below the threshold, all columns kept."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels, params))
    columns = documents.columns

    def keep(batches):
        for batch in batches:
            scores = [block_scores(block, *held.value, params) for block in blocks(batch)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    frame = documents.select(F.struct(*columns).alias("row"), F.col("text").cast("binary").alias("text"))
    return frame.mapInArrow(keep, frame.schema).select(*[F.col("row")[c].alias(c) for c in columns])


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
