"""Chat formatting by schema fingerprints.

A record is a JSON object in one of many layouts: messages, instruction and output,
prompt and response. The set of those of its nested field paths that mappings name is
hashed to a fingerprint, which selects a declarative mapping to canonical turns; other
fields, as id or weight, don't matter. A template marks turns with control
strings; control strings inside texts are escaped reversibly. What is written can be read
back, with the characters under the loss mask (the assistants' texts).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- layouts


@dataclass(frozen=True)
class Mapping:
    """turns: path of a list of turns with the fields of role and text; or pairs of (role, fields whose texts are joined)."""

    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
Layouts = tuple[tuple[tuple[str, ...], Mapping], ...]
_SYSTEM = (("system", ("system",)),)
LAYOUTS: Layouts = (
    (("messages[].role", "messages[].content"), Mapping("messages", "role", "content")),
    (("messages[].content", "messages[].role", "system"), Mapping("messages", "role", "content", (("system", ("system",)),))),
    (("conversations[].from", "conversations[].value"), Mapping("conversations", "from", "value")),
    (("conversations[].from", "conversations[].value", "system"), Mapping("conversations", "from", "value", (("system", ("system",)),))),
    (("turns[].role", "turns[].text"), Mapping("turns", "role", "text")),
    (("instruction", "output"), Mapping(fields=(("user", ("instruction",)), ("assistant", ("output",))))),
    (("instruction", "input", "output"), Mapping(fields=(("user", ("instruction", "input")), ("assistant", ("output",))))),
    (("prompt", "response"), Mapping(fields=(("user", ("prompt",)), ("assistant", ("response",))))),
    (("prompt", "completion"), Mapping(fields=(("user", ("prompt",)), ("assistant", ("completion",))))),
    (("prompt", "response", "system"), Mapping(fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
    (("answer", "question"), Mapping(fields=(("user", ("question",)), ("assistant", ("answer",))))),
    (("system", "turns[].role", "turns[].text"), Mapping("turns", "role", "text", _SYSTEM)),
    (("instruction", "output", "system"), Mapping(fields=(*_SYSTEM, ("user", ("instruction",)), ("assistant", ("output",))))),
    (("input", "instruction", "output", "system"), Mapping(fields=(*_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))))),
    (("completion", "prompt", "system"), Mapping(fields=(*_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))))),
    (("answer", "question", "system"), Mapping(fields=(*_SYSTEM, ("user", ("question",)), ("assistant", ("answer",))))),
    (("messages[]",), Mapping("messages")),
    (("conversations[]",), Mapping("conversations")),
    (("turns[]",), Mapping("turns")),
)


def paths(value, at: str = "") -> Iterator[str]:
    """The nested field paths of a value: lists add [], an empty list or object counts as a leaf."""
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list) and value:
        for inner in value:
            yield from paths(inner, at + "[]")
    else:
        yield at + "[]" if isinstance(value, list) else at


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(set(found))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Canonical:
    """Turns of records by layouts, each the paths that its records have and their mapping."""

    def __init__(self, layouts: Layouts = LAYOUTS):
        self.mappings = {fingerprint(fields): mapping for fields, mapping in layouts}
        self.named = {field for fields, _ in layouts for field in fields}
        # What lies under a text's path is part of the text, so it is no further field
        self.under = tuple(f + more for f in self.named if not f.endswith("[]") for more in (".", "[]"))

    def __call__(self, record: dict) -> tuple[str, list[tuple[str, str]] | None]:
        """The fingerprint and the turns (role, text). Null and missing texts and roles are empty.

        An unknown layout has None and the fingerprint of all its paths; so has a list of turns with other than objects.
        """
        found = set(paths(record))
        mark = fingerprint(p for p in found if p in self.named or p.startswith(self.under))
        mapping = self.mappings.get(mark)
        rows = (record.get(mapping.turns) or []) if mapping and mapping.turns else []
        if mapping is None or not all(isinstance(turn, dict) for turn in rows):
            return fingerprint(found), None
        turns = [(role, "\n".join(t for f in fields if (t := text_of(record.get(f))))) for role, fields in mapping.fields]
        for turn in rows:
            role = text_of(turn.get(mapping.role))
            turns.append((ROLES.get(role, role) if mapping.role == "from" else role, text_of(turn.get(mapping.text))))
        return mark, turns


# --- template

#: The template's own control strings, and others that texts must not bring in.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|assistant|>", "<|user|>", "<|system|>")
_INSIDE = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def escape(text: str) -> str:
    """A backslash is doubled, and a control string gets one after its first character, which breaks it up."""
    return _INSIDE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask: [start, end) of each assistant text, escapes included."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; fails if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if not match:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


# --- on tables

FORMATTED = "fingerprint string, formatted string, mask array<struct<start:int,end:int>>"


def format_records(records: DataFrame, record: str = "record", key: str = "conv_id", layouts: Layouts = LAYOUTS) -> DataFrame:
    """(key, fingerprint, formatted, mask) of each JSON record.

    layouts: pairs of field paths and mapping. Fields that none of them names are ignored. An unknown layout keeps its fingerprint and has null formatted and mask, so no row is lost and new layouts can
    be counted; null, broken and non-object records have the fingerprint "none". A record without turns is an
    empty string.
    """
    canonical = Canonical(layouts)

    def apply(batches):
        mask_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            marks, texts, masks = [], [], []
            for value in batch.column(1):
                try:
                    parsed = json.loads(value.as_py() or "null")
                except ValueError:
                    parsed = None
                mark, turns = canonical(parsed) if isinstance(parsed, dict) else ("none", None)
                text, mask = (None, None) if turns is None else format_turns(turns)
                marks.append(mark)
                texts.append(text)
                masks.append(None if mask is None else [{"start": a, "end": b} for a, b in mask])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(texts, pa.string()), pa.array(masks, mask_kind)], [key, "fingerprint", "formatted", "mask"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, record).mapInArrow(apply, f"{key} {kind}, {FORMATTED}")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conv_id by turn as one messages record.

    Equal turns go by role, then text; a null turn comes first, null roles and texts are empty. One conversation is
    one record by nature: its turns meet in one row, whose length is that of the text it becomes.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_formatted(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts alone.

    The loss text is what the mask covers, unescaped, put together in order. Null formatted texts have null columns.
    """

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def apply(batches):
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.select(key, "formatted", "mask").mapInArrow(apply, f"{key} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and one more, -1, which says control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_formatted(format_records(conversation_records(rows)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>|<\|assistant\|>|<\|user\|>|<\|system\|>'))
    + length(role) + len('<|im_start|>') + len('<|im_end|>') + 2 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
