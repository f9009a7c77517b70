"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Keys are cut into ranges that are small for
every source, words are summed by (source, range), the ranges' sums are added up
within the source, and the documents of one range are put in order by themselves: a
document's place in its source's stream is the range's base plus a running sum. No
source, however large, meets in one task. The stream is cut at the exact budget; a
budget beyond the source's size runs through the source again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepchange.llm.common import SPACES, word_count, written

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Documents that one range of keys holds about.
RANGE_ROWS = 5_000
#: Ranges whose sums are added up together.
PART_RANGES = 1_000
_DIGITS = 13  # hex digits of a key: 52 bits


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) by source, null being one of them.

    Sources share `share` of all words by weight. A source whose part is above `most` times its size gets just
    that; what it leaves is shared anew by weight among the others, until none is above. If all are at their
    limit, the rest goes unused. A loop of sums over the sources: only two numbers a round reach the driver.
    """
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    # Places in code point order without one task for all sources: rank inside a first letter, plus those before it
    letter = F.coalesce(F.substring("source", 1, 1), F.lit(""))
    known = totals.where(F.col("source").isNotNull()).withColumn("letter", letter)
    letters = known.groupBy("letter").agg(F.count("*").alias("n"))
    before = letters.select("letter", (F.sum("n").over(Window.orderBy("letter")) - F.col("n")).alias("before"))
    ranked = known.join(before, "letter").select(
        "source", "source_size", "n_docs", (F.col("before") + F.row_number().over(Window.partitionBy("letter").orderBy("source")) - 1).alias("place")
    )
    last = totals.where(F.col("source").isNull()).withColumn("place", F.lit(known.count()).cast("long"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = written(
        ranked.unionByName(last).select("source", "source_size", "n_docs", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")),
        "weights",
    )
    words, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    pool = share * float(words or 0)
    limit = F.col("source_size") * float(most)
    # (rest, open weight) sets a level; it only rises, so what is at its limit stays there
    rest, open_weight, gone = pool, weight or 0, 0
    while open_weight > 0:
        full = limit < F.lit(rest) * F.col("weight") / F.lit(open_weight)
        taken, now = weighed.agg(F.sum(F.when(full, limit)), F.sum(F.when(full, F.col("weight")))).first()
        if (now or 0) == gone:
            break
        rest, open_weight, gone = pool - taken, weight - now, now
    target = limit if open_weight <= 0 else F.least(limit, F.lit(rest) * F.col("weight") / F.lit(open_weight))
    return weighed.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def random_key(seed: int = 0) -> Column:
    """A number from 0 to 2^52 from the document's id and text, so texts of one id are spread like others."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), text)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


KEYS = ["source", "doc_id", "text_hash", "size"]


def takes(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """(source, doc_id, text_hash, size, copies, nth, source_size, target, taken), one for each row of `documents`.

    taken: words that the mix takes of the document, over all epochs. A source's stream is its documents by key,
    then id, text hash and size; whole epochs take each document, the last one takes those before the cut, and
    the document at the cut up to it. So a source's taken words are its target, rounded to a word. Null and empty
    texts have size 0 and take 0; a source of size 0 has target 0. Rows alike in KEYS (there are `copies`) stand
    one after the other, as `nth` 0, 1 and so on.
    """
    narrow = written(documents.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), word_count("text").alias("size"), random_key(seed).alias("key")), "sizes")
    targets = written(source_targets(narrow, weights, share, most), "targets")
    # Ranges of keys: as many as the source's documents need
    n_ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS))
    by_source = targets.select(F.col("source").alias("of"), "source_size", "target", n_ranges.alias("n_ranges"))
    place = F.floor(F.col("key") / F.lit(float(1 << (4 * _DIGITS))) * F.col("n_ranges"))
    placed = (
        narrow.groupBy(*KEYS, "key")
        .agg(F.count("*").alias("copies"))
        .join(by_source, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("range", place)
    )
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("of", "range").agg(F.sum(words).alias("words"))
    # Sums in two levels, so that not even the ranges of one source meet in a task
    sums = sums.withColumn("part", F.floor(F.col("range") / PART_RANGES))
    whole = sums.groupBy("of", "part").agg(F.sum("words").alias("words"))
    parts_before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("of").alias("part_of"), F.col("part").alias("part_no"), F.coalesce(F.sum("words").over(parts_before), F.lit(0)).alias("part_base"))
    so_far = Window.partitionBy("of", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select(F.col("of").alias("base_of"), F.col("range").alias("base_range"), "part", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("inner"))
    base = inner.join(whole, F.col("base_of").eqNullSafe(F.col("part_of")) & (F.col("part") == F.col("part_no"))).select(
        "base_of", "base_range", (F.col("inner") + F.col("part_base")).alias("base")
    )
    inside = Window.partitionBy("of", "range").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    stream = (
        placed.join(base, F.col("of").eqNullSafe(F.col("base_of")) & (F.col("range") == F.col("base_range")))
        .withColumn("start", F.col("base") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("tail", budget - epochs * F.col("source_size"))
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    )
    start = F.col("start") + F.col("nth") * F.col("size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("tail") - start))
    return stream.select(*KEYS, "copies", "nth", "source_size", "target", taken.cast("long").alias("taken"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """Each row of `documents` as a struct `row`, with size, source_size, target and taken; see takes()."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), "source", "doc_id", F.xxhash64("text").alias("text_hash"), word_count("text").alias("size"))
    parts = takes(documents, **options).select(*[F.col(c).alias(f"at_{c}") for c in KEYS], "copies", "nth", "source_size", "target", "taken")
    same = F.lit(True)
    for c in KEYS:
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    one = rows.join(parts.where(F.col("copies") == 1), same)
    # Only rows that are several have to be told apart
    several = parts.where(F.col("copies") > 1)
    # They are numbered within the tasks that read them, after all of the tasks before: no task has them all
    spread = rows.withColumn("salt", F.spark_partition_id())
    alike = written(spread.join(several.where(F.col("nth") == 0).select(*[f"at_{c}" for c in KEYS]), same, "left_semi"), "alike")
    counted = alike.groupBy(*KEYS, "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select(*[F.col(c).alias(f"salted_{c}") for c in KEYS], F.col("salt").alias("salted"), before.alias("before"))
    salted = F.col("salt") == F.col("salted")
    for c in KEYS:
        salted = salted & F.col(c).eqNullSafe(F.col(f"salted_{c}"))
    inside = F.row_number().over(Window.partitionBy(*KEYS, "salt").orderBy(F.lit(0))) - 1
    alike = alike.withColumn("inside", inside).join(counted, salted).withColumn("row_nth", F.col("inside") + F.col("before"))
    found = alike.join(several, same & (F.col("row_nth") == F.col("nth")))
    columns = ["row", "size", "source_size", "target", "taken"]
    return one.select(*columns).unionByName(found.select(*columns))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows: each taken copy of a document with its columns, `copy` from 1 and `copy_words`.

    The copy at a source's cut has its text cut after copy_words words; a document of which nothing is taken has
    no row. Extra columns called copy, copy_words or target are renamed with a trailing underscore.
    """
    taken = mix(documents, **options).where(F.col("taken") > 0)
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    copies = copies.withColumn("copy_words", words.cast("long"))
    # Splits where a word ends: what is left after the n-th split is what the cut takes away
    ends = F.split(F.col("row.text"), f"(?<=[^\\x20\\x09-\\x0D])(?={SPACES})", F.col("copy_words").cast("int") + 1)
    cut = F.expr("left(row.text, length(row.text) - length(rest))")
    copies = copies.withColumn("rest", F.when(F.col("copy_words") < F.col("size"), F.element_at(ends, -1)))
    text = F.when(F.col("rest").isNotNull(), cut).otherwise(F.col("row.text"))
    own = {"copy", "copy_words", "target"}
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c + "_" if c in own else c) for c in documents.columns]
    return copies.select(*columns, "copy", "copy_words", "target")


def report(documents: DataFrame) -> DataFrame:
    return takes(documents).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0:' || coalesce(md5(text), '')), 1, {_DIGITS}) AS BIGINT) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), level AS (
  SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE AS rest, (SELECT sum(weight) FROM totals)::DOUBLE AS weight, 0 AS n
  UNION ALL
  SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE - coalesce((SELECT sum(2 * source_size) FROM totals t WHERE 2 * t.source_size < l.rest * t.weight / l.weight), 0)::DOUBLE,
    (SELECT sum(weight) FROM totals)::DOUBLE - coalesce((SELECT sum(t.weight) FROM totals t WHERE 2 * t.source_size < l.rest * t.weight / l.weight), 0)::DOUBLE, n + 1
  FROM level l WHERE n < 40 AND l.weight > 0
), final AS (SELECT rest, weight FROM level ORDER BY n DESC LIMIT 1),
targets AS (
  SELECT t.source, t.source_size, CASE WHEN f.weight > 0 THEN least(2.0::DOUBLE * t.source_size, f.rest * t.weight / f.weight) ELSE 2.0::DOUBLE * t.source_size END AS target
  FROM totals t, final f
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
