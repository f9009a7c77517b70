"""What the corpus operators share: the shared folder, and words of many texts at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step works on at a time.
CHUNK = 1 << 19

#: Where the tables of `written` are.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, which a lost executor can't take along."""
    path = f"{shared_folder(frame.sparkSession)}/corpus/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _FOLDERS[found] = path
    return found


def removed(*frames: DataFrame | None) -> None:
    """Deletes the tables that `written` made, once what was built on them is written itself. Other frames are left alone."""
    for frame in frames:
        path = None if frame is None else _FOLDERS.pop(frame, None)
        if path:
            place = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


# --- words and hashes of a block of texts, as arrays


def byte_table(kept) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(kept)] = True
    return found


#: Bytes of words between white space, and of words of letters and digits (all of UTF-8's upper half counts).
GRAPHIC = byte_table(b for b in range(256) if b != 32 and not 9 <= b <= 13)
ALNUM = byte_table(b for b in range(256) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20250105).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    ups, downs = (np.full(1 << bits, x, np.uint64) for x in (_BASE, _INVERSE))
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], which depends on its bytes alone."""
    ups, downs = _powers(max(19, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * ups[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * downs[begin])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Block:
    """Some rows of a batch with their texts joined by line feeds."""

    def __init__(self, rows: slice, texts: list[bytes]):
        self.rows = rows
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.begin = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.end = self.begin + self.lengths

    def words(self, kind: np.ndarray, data: np.ndarray | None = None):
        """Begin and end of the words, and where each text's words begin (one more than texts)."""
        begin, end = runs(kind[self.data if data is None else data])
        first = np.searchsorted(begin, np.append(self.begin, len(self.data)))
        return begin, end, first


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[Block]:
    """The batch in blocks of about `limit` bytes; a longer text is a block of its own. Null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    texts, size, at = [], 0, 0
    for i in range(len(values)):
        text = values[i].as_py() or b""
        if texts and size + len(text) > limit:
            yield Block(slice(at, i), texts)
            texts, size, at = [], 0, i
        texts.append(text)
        size += len(text)
    if texts:
        yield Block(slice(at, len(values)), texts)


def row_of(first: np.ndarray) -> np.ndarray:
    """For items grouped by row with bounds `first`, the row of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive items by row, also for empty rows."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
