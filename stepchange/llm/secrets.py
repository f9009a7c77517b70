"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits, embedded checksums.

One pass over the texts without a shuffle. The automaton finds keywords in the bytes of
each text; only there are expressions tried, anchored at the hit. Long hex runs, which
no keyword announces, come from the bytes' classes. Kinds with a checksum inside are
kept only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import Block, blocks, byte_table, runs

# The base kinds, by keyword, expression, least length
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
HEX = byte_table(b"0123456789abcdef")
# Added kinds, whose forms hold a checksum
TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(rb"""card(?:\x20?(?:number|no\.?))?["']?\x20*[:=#]?\x20*["']?((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])""", re.I)
KINDS = ("assign", "access", "hex", "token", "card")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "token",
    "gho_": "token",
    "ghu_": "token",
    "ghs_": "token",
    "ghr_": "token",
    "npm_": "token",
    "card": "card",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _automaton():
    # Needed by tasks only: the module, and all other operators, can be imported without it
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def token_checksum(body: bytes) -> bytes:
    """crc32 of the body in base 62, six digits."""
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed([b - 48 for b in digits if 48 <= b <= 57])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= ASSIGN_CHARS
    if kind == "access":
        return len(match[0]) >= ACCESS_CHARS
    if kind == "token":
        return token_checksum(match[1]) == match[2]
    return luhn(match[1])


EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "token": TOKEN, "card": CARD}


def keyword_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes at the automaton's hits. Matches of a kind don't overlap; failing ones count as met."""
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _automaton().iter(text.lower().decode("latin-1")))
    found, over = [], dict.fromkeys(EXPRESSIONS, 0)
    for start, kind in hits:
        if start >= over[kind] and (match := EXPRESSIONS[kind].match(text, start)):
            over[kind] = match.end()
            if valid(kind, match):
                found.append((start, kind, match.end()))
    return found


def block_spans(block: Block) -> list[list[tuple[int, str, int]]]:
    """Of each text its spans in code points, by start, then kind."""
    begin, end = runs(HEX[block.data])
    long = end - begin >= HEX_CHARS
    begin, end = begin[long], end[long]
    owner = np.searchsorted(block.begin, begin, "right") - 1
    out = [keyword_spans(text) for text in block.texts]
    for b, e, i in zip(begin, end, owner):
        out[i].append((int(b - block.begin[i]), "hex", int(e - block.begin[i])))
    for i, spans in enumerate(out):
        if spans:
            text = np.frombuffer(block.texts[i], np.uint8)
            points = np.append(0, np.cumsum((text & 0xC0) != 0x80))
            out[i] = sorted(((int(points[s]), kind, int(points[e])) for s, kind, e in spans), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return out


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row: array of (kind, start, end), code points, end exclusive, by start, then kind.

    Null and empty texts have no spans. Kinds of different names may overlap.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        for batch in batches:
            for block in blocks(batch):
                found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans] for spans in block_spans(block)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(found)), pa.array(found, span)], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(apply, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redacted(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """(doc_id, text) with each maximal run of spans as `mark`; null texts stay null."""

    def apply(batches):
        for batch in batches:
            raw = batch.column(1)
            for block in blocks(batch):
                out = []
                for i, spans in enumerate(block_spans(block)):
                    text, at, parts = block.texts[i].decode("utf-8", "replace"), 0, []
                    for s, _, e in spans:
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    out.append("".join([*parts, text[at:]]) if raw[block.rows.start + i].is_valid else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(out)), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(apply, f"doc_id {kind}, text string")


def report(documents: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns from expressions over the whole text."""
    data, found = text or "", []
    for kind, expression, keep in (
        ("assign", re.compile(ASSIGN.pattern.decode(), re.I | re.A), lambda m: len(m[2]) >= ASSIGN_CHARS),
        ("access", re.compile(ACCESS.pattern.decode()), lambda m: len(m[0]) >= ACCESS_CHARS),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= HEX_CHARS),
    ):
        found += [(m.start(), KINDS.index(kind), m.end()) for m in expression.finditer(data) if keep(m)]
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())
