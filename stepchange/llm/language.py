"""Language ID by words first, then ever shorter character n-grams.

Word counts by language cover all learning texts; they are summed inside each task
before the shuffle. Runs of letters over WORD_BYTES, as in scripts without spaces, are
counted by their n-grams instead, all of them. The model holds the most frequent words of each
language, MODEL_WORDS together, and, from the whole word list, the most frequent n-grams of
each length, so its size is bounded. A
known word scores its log frequency in each language, an unseen one the mean log
frequency of its longest known n-grams. A long run is scored in pieces of about WORD_BYTES,
each of which counts as an unseen word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepchange.llm.common import blocks, byte_table, remainder, row_sums, span_hashes, written

#: Bytes of words: a to z, and all of UTF-8's upper half. Text is put in lower case before.
LETTERS = byte_table(b for b in range(256) if 97 <= b <= 122 or b >= 128)
#: Words, and n-grams of each length, that a model holds, each language's most frequent ones alike; lengths of n-grams.
MODEL_WORDS = 100_000
MODEL_GRAMS = 50_000
ORDERS = (4, 3, 2, 1)
#: Longer runs of letters are no words: their n-grams are counted, and each so many bytes score as an unseen word.
WORD_BYTES = 64
SMOOTHING = 0.5
UNKNOWN = "und"
#: Distinct words that a task counts before it hands them on.
_HELD = 200_000


def _lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    text = pc.utf8_lower(batch.column(at).cast(pa.large_string())).cast(pa.large_binary())
    return pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with marks at both ends, so a word's first and last letters differ from inner ones; where each
    character begins, and the end; the word of each character."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    return data, np.append(at, len(data)), np.searchsorted(ends, at, side="right")


def gram_spans(at: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams inside words: the number of the first character, begin and end."""
    n = max(len(word) - size + 1, 0)
    inside = np.flatnonzero(word[:n] == word[len(word) - n :])
    return inside, at[inside], at[inside + size]


def parts(sizes: np.ndarray) -> np.ndarray:
    """Words that a run of so many bytes counts as."""
    return -(-sizes // WORD_BYTES)


def _count_words(batches):
    """(lang, word, size, n), summed in the task. Size 0 is a word, 1 to 4 an n-gram of a long run, -1 all long runs."""
    held: Counter = Counter()

    def given():
        rows = [(lang, word.decode("utf-8", "replace"), size, n) for (lang, word, size), n in held.items()]
        held.clear()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "word", "size", "n"])

    def summed(data, begin, end, langs, lang, size):
        hashes = span_hashes(data, begin, end)
        order = np.lexsort((lang, hashes))
        h, lg = hashes[order], lang[order]
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lg[1:] != lg[:-1]))[: len(h)])
        text = data.tobytes()
        for i, n in zip(head, np.diff(np.append(head, len(h)))):
            j = order[i]
            held[langs[lang[j]], text[begin[j] : end[j]], size] += int(n)
            if len(held) > _HELD:
                yield given()

    for batch in batches:
        batch = _lower(batch)
        langs, row_lang = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        for block in blocks(batch):
            begin, end, first = block.words(LETTERS)
            keep = end - begin <= WORD_BYTES
            lang = np.repeat(row_lang[block.rows], np.diff(first))
            yield from summed(block.data, begin[keep], end[keep], langs, lang[keep], 0)
            if keep.all():
                continue
            text, lang, weight = block.data.tobytes(), lang[~keep], parts(end - begin)[~keep]
            for i, n in zip(lang, weight):
                held[langs[i], b"", -1] += int(n)
            data, at, word = marked([text[b:e] for b, e in zip(begin[~keep], end[~keep])])
            for size in ORDERS:
                start, gram_begin, gram_end = gram_spans(at, word, size)
                yield from summed(data, gram_begin, gram_end, langs, lang[word[start]], size)
    if held:
        yield given()


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # words x languages, log frequency
    grams: list[tuple[int, np.ndarray, np.ndarray]]  # length, sorted hashes, log frequencies
    floor: np.ndarray  # of a character never met


def _logs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (totals + SMOOTHING * (len(counts) + 1)))


def hash_bytes(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes)
    return span_hashes(np.frombuffer(b"".join(words) or b"\0", np.uint8), end - sizes, end)


def train(documents: DataFrame) -> Model | None:
    """The model of all rows with text and lang whose crc32(doc_id) modulo 3 isn't 1; None without any letter.

    Ties of frequency go by the word. Languages are the lang values of texts with letters, in words or long runs.
    """
    texts = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 3) != 1)).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = texts.mapInArrow(_count_words, "lang string, word string, size int, n long").groupBy("word", "lang", "size").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None

    def table(frame: DataFrame, most: int):
        wide = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
        chosen = F.broadcast(frequent(frame, most // len(langs)))
        return frame.join(chosen, "word", "left_semi").groupBy("word").agg(*wide).orderBy("word").toArrow().to_pandas()

    whole = counts.where("size = 0")
    totals = {r.lang: r.n for r in counts.where("size <= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = np.array([totals[x] for x in langs], float)
    columns = [f"n{i}" for i in range(len(langs))]

    def scored(found, total):
        hashes = hash_bytes([w.encode() for w in found["word"]])
        by = np.argsort(hashes)
        return hashes[by], _logs(found[columns].to_numpy(float), total)[by]

    words, word_scores = scored(table(whole, MODEL_WORDS), total)
    grams, floor = [], np.zeros(len(langs))
    for size in ORDERS:
        # Marks as in marked()
        marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        places = F.sequence(F.lit(1), F.length(marked) - size + 1)
        each = whole.where(F.length("word") >= size - 2).select("lang", "n", F.explode(F.transform(places, lambda i: F.substring(marked, i, F.lit(size)))).alias("word"))
        each = each.unionByName(counts.where(F.col("size") == size).select("lang", "n", "word"))
        summed = each.groupBy("word", "lang").agg(F.sum("n").alias("n"))
        top = table(summed, MODEL_GRAMS)
        sums = np.maximum(top[columns].sum().to_numpy(float), 1)
        grams.append((size, *scored(top, sums)))
        floor = np.log(SMOOTHING / (sums + SMOOTHING * (len(top) + 1)))
    return Model(langs, words, word_scores, grams, floor)


def frequent(counts: DataFrame, quota: int) -> DataFrame:
    """(word): the most frequent words of each language among (word, lang, n), `quota` each at most.

    Words are ranked by their counts within a language, so a large one leaves a small one's words in. Words that tie
    at the edge stay out; where even the most frequent ones are too many, a part of them stays, by hash.
    """
    # A row a count, not a word: few, as most words share a low count
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    edges = levels.withColumn("upto", upto).groupBy("lang").agg(
        F.min(F.when(F.col("upto") <= quota, F.col("n"))).alias("edge"), F.max("n").alias("top"), F.max_by("words", "n").alias("tied")
    )
    part = F.pmod(F.xxhash64("word"), F.ceil(F.col("tied") / F.lit(max(quota, 1)))) == 0
    kept = (F.col("n") >= F.col("edge")) | (F.col("edge").isNull() & (F.col("n") == F.col("top")) & part)
    return counts.join(F.broadcast(edges), "lang").where(kept).select("word").distinct()


def looked_up(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, -1 if missing."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def unseen_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Mean log frequencies of each word's longest known n-grams; of a long run, the mean over its pieces.

    An n-gram is of the piece that it begins in, so none is lost between two.
    """
    data, at, word = marked(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n_pieces = parts(sizes)
    first = np.append(0, np.cumsum(n_pieces))
    offset = at[:-1] - (np.cumsum(sizes + 2) - sizes - 2)[word]
    piece = first[word] + offset * n_pieces[word] // (sizes[word] + 2)
    out = np.tile(model.floor, (first[-1], 1))
    open_ = np.ones(len(out), bool)
    for size, keys, scores in model.grams:
        start, begin, end = gram_spans(at, word, size)
        owner = piece[start]
        left = open_[owner]
        found = looked_up(span_hashes(data, begin[left], end[left]), keys)
        owner, found = owner[left][found >= 0], found[found >= 0]
        n = np.bincount(owner, minlength=len(out))
        done = np.flatnonzero(n)
        for i in range(len(model.langs)):
            out[done, i] = np.bincount(owner, scores[found, i], len(out))[done] / n[done]
        open_[done] = False
    return np.add.reduceat(out, first[:-1], axis=0) / n_pieces[:, None]


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from the text alone.

    score: the chosen language's share, by mean log frequencies of the text's words and pieces of long runs. Null texts and texts without
    a letter are "und" with score 0, as is everything without a model. Ties go to the first language in order.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        model = held.value
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            raw, batch = batch.column(1), _lower(batch)
            for block in blocks(batch):
                n = len(block.texts)
                names, shares = [UNKNOWN] * n, np.zeros(n)
                if model is not None:
                    begin, end, first = block.words(LETTERS)
                    hashes = span_hashes(block.data, begin, end)
                    kinds, example, back = np.unique(hashes, return_index=True, return_inverse=True)
                    at = looked_up(kinds, model.words)
                    scores = model.word_scores[at] if len(model.words) else np.zeros((len(kinds), len(model.langs)))
                    new = [i for i in np.flatnonzero(at < 0) if int(kinds[i]) not in cache]
                    if len(cache) > _HELD:
                        cache.clear()
                        new = np.flatnonzero(at < 0).tolist()
                    if len(new):
                        text = block.data.tobytes()
                        found = unseen_scores(model, [text[begin[j] : end[j]] for j in example[new]])
                        cache.update(zip(kinds[new].tolist(), found))
                    for i in np.flatnonzero(at < 0):
                        scores[i] = cache[int(kinds[i])]
                    counts, weight = np.diff(first), parts(end - begin)
                    mean = row_sums(scores[back.ravel()] * weight[:, None], first) / np.maximum(row_sums(weight, first), 1)[:, None]
                    best = mean.argmax(axis=1)
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    share = (share / share.sum(axis=1, keepdims=True))[np.arange(n), best]
                    for i in range(n):
                        text = block.texts[i]
                        # Bytes of the upper half may be other than letters
                        plain = counts[i] and (any(97 <= b <= 122 for b in text[:200]) or any(c.isalpha() for c in raw[block.rows.start + i].as_py()))
                        if plain:
                            names[i], shares[i] = model.langs[best[i]], share[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, n), pa.array(names, pa.string()), pa.array(shares)], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")


def report(documents: DataFrame) -> DataFrame:
    found = predict(documents, train(documents))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
