"""Near duplicates by one-permutation MinHash, banded buckets, star-shaped edges and full-set checks.

1. Words make shingles, shingles 64-bit hashes. One permutation fills BINS bins with their
   minima; a bin without a shingle takes the value of the first full bin in an order of its
   own (optimal densification), so short texts get full signatures too.
2. Documents with equal sets are one node. Bands of ROWS bins put nodes into buckets.
3. In each bucket one hub, the node that shares most buckets with others, is paired with the
   rest: a bucket of n nodes gives n-1 edges, not n*n/2. Edges are checked on the full sets.
4. Linked nodes are joined into components. The nodes of buckets that still hold several of them
   are grouped anew, by each shingle of their prefixes: sets that are similar enough have one of
   their rarest shingles in common, so unlike texts with a common passage don't meet again, and
   enough shingles must come after it in both. Such a group gets hubs from outside its largest
   component, first one, then all that are left, so no pair that shares a bucket is lost.
   What can be lost is a pair that shares no bucket: (1 - 0.75^6)^64, 4 in a million, at 0.75.

Signatures and edges are tables in the shared folder; nothing of a document's size reaches
the driver, which sees counts only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import GRAPHIC, Block, blocks, lowered, mixed, removed, span_hashes, written

SHINGLE = 5
BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
SIMILARITY = 75  # of 100
#: Hubs that a group of a rare shingle gets in each round; 0: all nodes outside its largest component that weren't one.
HUBS = (1, 0)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(block: Block, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the block."""
    data = lowered(block.data)
    begin, end, first = block.words(GRAPHIC, data)
    words = span_hashes(data, begin, end)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        grams = grams * _STEP + words[i : i + len(grams)]
    grams = mixed(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= size:
            found = grams[a : b - size + 1].copy()
            found.sort()
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _STEP + w
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin, the rank that it gives every other bin when it looks for a full one."""
    random = np.random.default_rng(97)
    return np.stack([random.permutation(BINS).astype(np.int16) for _ in range(BINS)])


def signature(found: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty sorted set; the bins are consecutive ranges of the permuted values."""
    bins = ((found >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    full, at = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    out[full] = found[at]
    empty = np.ones(BINS, bool)
    empty[full] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        out[empty] = out[full[_orders()[empty[:, None], full].argmin(axis=1)]]
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(rows), 1))
    for i in range(ROWS):
        out = mixed(out * _STEP + rows[:, :, i])
    return out


def _sketch(batches):
    for batch in batches:
        for block in blocks(batch):
            sets = shingle_sets(block)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            sums = [np.array([int(f(s).sum()) & (2**64 - 1) for s in sets], np.uint64).view(np.int64) for f in (lambda s: s, lambda s: mixed(s ^ _STEP))]
            some = n > 0
            bands = band_hashes(np.stack([signature(s) for s in sets if len(s)])) if some.any() else np.zeros((0, BANDS), np.uint64)
            offsets = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.view(np.int64).ravel()))
            ids = batch.column(0).slice(block.rows.start, len(sets))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _full_sets(batches):
    for batch in batches:
        for block in blocks(batch):
            sets = [s for s in shingle_sets(block)]
            offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(sets)), lists], ["doc_id", "shingles"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"))


def similar(inter: Column, a: Column, b: Column, percent: int = SIMILARITY) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node of the component.

    Alternates between joining larger neighbours and smaller neighbours to the smallest one, until nothing
    changes; each turn is written to the shared folder and takes the place of the one before.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        before, edges = edges, written(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct(),
            "stars",
        )
        removed(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
            roots = written(roots.distinct(), "roots")
            removed(edges)
            return roots
        seen = now


class Linker:
    """Links among nodes so far: pairs that were checked, those that hold, and the components that they make."""

    def __init__(self, sets: DataFrame, known: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.good, self.tested = known, None
        self.roots = None if known.isEmpty() else components(known)

    def unsettled(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (group, node, ...) that hold nodes of several components, with `root`, and the group's `least` and `most` root."""
        if self.roots is None:
            state = groups.withColumn("root", F.col("node"))
        else:
            state = groups.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = state.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("group")
        return state.join(several, "group")

    def pair(self, state: DataFrame, hubs: DataFrame) -> None:
        """Checks every hub (group, hub, hub_root, hub_n) with the nodes of its group that are in other components.

        With a `place` of the group's shingle in the sets, and a `hub_place`, pairs go that can't be similar enough if
        this is their first common shingle: their sets must share `overlap` shingles, all from here on.
        """
        n, m = F.col("n_shingles"), F.col("hub_n")
        near = (F.col("root") != F.col("hub_root")) & (100 * F.least(n, m) >= self.percent * F.greatest(n, m))
        if "place" in state.columns:
            overlap = F.ceil(self.percent * (n + m) / (100 + self.percent) - 1e-9)
            near = near & (n - F.col("place") >= overlap) & (m - F.col("hub_place") >= overlap)
        edges = state.join(hubs, "group").where(near).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        if self.tested is not None:
            edges = edges.join(self.tested, ["a", "b"], "left_anti")
        half = edges.join(self.sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        whole = half.join(self.sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        checked = whole.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("inter"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
        checked = written(checked.select("a", "b", similar(F.col("inter"), F.col("na"), F.col("nb"), self.percent).alias("ok")), "edges")
        own = checked.select("a", "b")
        self.tested = own if self.tested is None else self.tested.unionByName(own)
        passed = checked.where("ok").select("a", "b")
        if not passed.isEmpty():
            self.good = self.good.unionByName(passed)
            before, self.roots = self.roots, components(self.good)
            removed(before)


def rare_groups(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(group, node, n_shingles, place): nodes by each shingle of their prefix that another of the nodes has, too.

    With the rarest shingles first, two sets that are similar enough have a shingle in common among the first
    n - ceil(percent * n / 100) + 1 of each. Texts that share only what many texts share don't meet. place: how many
    shingles of the set come before.
    """
    own = sets.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    # An id may have several sets
    each = own.select(F.col("doc_id").alias("node"), F.size("shingles").alias("n_shingles"), F.xxhash64("shingles").alias("which"), F.explode("shingles").alias("group"))
    often = each.groupBy("group").agg(F.count("*").alias("often"))
    ranked = each.join(often, "group").groupBy("node", "n_shingles", "which").agg(F.sort_array(F.collect_list(F.struct("often", "group"))).alias("ranked"))
    n = F.col("n_shingles")
    prefix = n - F.ceil(percent * n / 100).cast("int") + 1
    placed = F.transform(F.slice("ranked", F.lit(1), prefix), lambda x, i: F.struct(x["often"].alias("often"), x["group"].alias("group"), i.alias("place")))
    first = ranked.select("node", "n_shingles", F.explode(F.filter(placed, lambda x: x["often"] > 1)).alias("x"))
    return first.select(F.col("x.group").alias("group"), "node", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("x.place").alias("place"))


def links(documents: DataFrame, nodes: DataFrame, known: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(node, root) of the linked nodes among (node, n_shingles, bands); a node's text is that of its doc_id.

    known: links (a, b) that need no check.
    """
    members = nodes.select("node", "n_shingles", F.explode("bands").alias("group"))
    # Written, so that the join's sides are plain exchanges, of which hot buckets can be split
    sizes = written(members.groupBy("group").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    met = written(members.join(sizes, "group"), "members")
    removed(sizes)
    degree = met.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    live = written(met.join(degree, "node").select("group", "node", "n_shingles", "degree"), "members")
    removed(met)
    involved = live.select(F.col("node").alias("doc_id")).distinct()
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = _texts(documents).join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = written(texts.mapInArrow(_full_sets, f"doc_id {kind}, shingles array<long>"), "sets")
    linker = Linker(sets, known, percent)
    # A star in each bucket: its hub with the rest
    state = linker.unsettled(live)
    best = F.max(F.struct("degree", (-F.col("node")).alias("minus"), "root", "n_shingles")).alias("best")
    hub = [(-F.col("best.minus")).alias("hub"), F.col("best.root").alias("hub_root"), F.col("best.n_shingles").alias("hub_n")]
    hubs = written(state.groupBy("group").agg(best).select("group", *hub), "hubs")
    if not hubs.isEmpty():
        linker.pair(state, hubs)
    removed(hubs)
    open_ = written(linker.unsettled(live).select("node").distinct(), "open")
    removed(live)
    groups = None if open_.isEmpty() else written(rare_groups(sets, open_, percent), "rare")
    done = None
    for hubs_each in [] if groups is None else HUBS:
        state = linker.unsettled(groups)
        # Pairs with the largest component are met from the other side
        sizes = state.groupBy("group", "root").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("group").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
        fresh = state.join(largest, "group").where("root <> largest")
        fresh = fresh if done is None else fresh.join(done, ["group", "node", "place"], "left_anti")
        hub = [F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("n_shingles").alias("hub_n"), F.col("place").alias("hub_place")]
        if hubs_each:
            part = F.pmod(F.xxhash64("node"), F.lit(hubs_each))
            chosen = fresh.groupBy("group", part.alias("part")).agg(F.min(F.struct("node", "root", "n_shingles", "place")).alias("best"))
            fresh = chosen.select("group", "best.*")
        hubs = written(fresh.select("group", *hub), "hubs")
        if hubs.isEmpty():
            break
        linker.pair(state, hubs)
        own = hubs.select("group", F.col("hub").alias("node"), F.col("hub_place").alias("place"))
        done = own if done is None else done.unionByName(own)
    removed(open_, groups, sets)
    return linker.roots if linker.roots is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def near_duplicates(documents: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one for each row of documents.

    Words are runs of anything but ASCII white space, A-Z as a-z; the set has each distinct run of five words, or
    the whole sequence if there are fewer. Documents whose sets share `percent` of 100 of their union are linked,
    equal sets included. component_id: the smallest doc_id reachable. Null, empty and blank texts have an empty
    set and stand alone. Rows with one doc_id are one document with all of their sets. A null doc_id is linked
    with nothing, has a null component and is kept.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    sketches = written(_texts(documents).mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    real = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["s1", "s2", "n_shingles"]
    classes = written(real.groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    # A class's bands are those of its smallest document
    own = real.join(classes, key).where("doc_id = node").select("node", *key, "bands").dropDuplicates(["node", "s1", "s2"])
    # An id with several sets ties their classes together
    several = real.groupBy("doc_id").agg((F.min(F.struct(*key)) != F.max(F.struct(*key))).alias("several")).where("several").select("doc_id")
    ties = real.join(several, "doc_id", "left_semi").join(classes, key).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    ties = written(ties, "ties")
    roots = links(documents, own.select("node", "n_shingles", "bands"), ties, percent)
    # A class without links is its own component; an id that ties classes is a node itself
    rooted = classes.join(roots, "node", "left").select(*[F.col(c).alias(f"of_{c}") for c in key], F.coalesce("root", "node").alias("root"))
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"of_{c}"))
    result = sketches.select("doc_id", *key).join(rooted, same & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("root", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(documents: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The documents, all columns, less those that are not the smallest doc_id of their component.

    Rows of one doc_id stay or go together; a null doc_id stays.
    """
    columns = documents.columns
    gone = near_duplicates(documents, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), (F.col("n_shingles") > 0).alias("linked"))
    gone = gone.where("linked").select("gone_id").distinct()
    held = documents.select(F.struct(*columns).alias("row"), "doc_id").join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    return held.select(*[F.col("row")[c].alias(c) for c in columns])


def report(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 75 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM w
  UNION
  SELECT p.b, r.r FROM reach r JOIN pairs p ON p.a = r.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.r AS component_id, c.r = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(r) AS r FROM reach GROUP BY a) c ON c.a = w.doc_id
"""
