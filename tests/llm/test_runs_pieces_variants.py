"""Operators 11 to 13 against brute force, the library, and on odd tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from stepchange.llm import periodic_runs, pieces, queries, variants
from test_corpus import FOLDER, ODD, SCHEMA, frame_of

MODEL = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


REPORTS = {
    "periodic_runs": periodic_runs.report,
    "pieces": lambda d: pieces.report(d, MODEL),
    "variants": variants.report,
}


@pytest.mark.parametrize("name", REPORTS)
def test_odd_and_empty_tables_and_clashing_columns(spark, odd, name):
    rows = sorted(map(str, REPORTS[name](odd).collect()))
    extra = odd
    for column in ("row", "ids", "runs", "word", "n", "root", "packed", "begins", "signature", "collapsed"):
        extra = extra.withColumn(column, F.lit("x"))
    assert sorted(map(str, REPORTS[name](extra).collect())) == rows
    assert len(rows) == len(ODD) or name == "variants"
    assert REPORTS[name](odd.limit(0)).collect() == []


# --- 11 periodic runs


def brute_runs(words):
    """Every run (start, length, period) by trying every period, smallest first."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                stretch = words[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_runs_query_against_brute_force(spark, texts):
    found = queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    # A doc_id and its short text are enough for the quadratic way; long ones are held to it by the test below
    short = {i for i, t in texts.items() if t is None or len(t) < 12_000}
    assert {tuple(r) for r in found if r.doc_id in short} == {brute_report(i, texts[i]) for i in short}
    assert len(found) == len(texts) and sum(r.n_runs for r in found) > 10


def test_runs_against_brute_force_on_small_alphabets():
    rng = random.Random(5)
    some = 0
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(1, 4)
            words = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
            if rng.random() < 0.6:
                words[len(words) // 2 : len(words) // 2] = [rng.randrange(k) for _ in range(rng.randint(1, 8))] * rng.randint(2, 9)
            if rng.random() < 0.2:
                words *= rng.randint(2, 6)
            docs.append(words)
        bounds = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        found = periodic_runs.runs_of(np.array([w for d in docs for w in d], np.int64), bounds)
        expected = {(s + b, s + b + length, q) for d, b in zip(docs, bounds.tolist()) for s, length, q in brute_runs(d)}
        assert set(zip(*(x.tolist() for x in found))) == expected
        some += len(expected)
    assert some > 500


def test_grammar_derives_the_texts():
    rng = random.Random(8)
    words = np.array([rng.randrange(3) for _ in range(500)] + [1, 2] * 200, np.int64)
    bounds = np.array([0, 200, 200, 700, 900])
    at, (where, left, length), (rule, position) = periodic_runs.repair(words, bounds)
    for r, p in zip(rule, position):
        assert (words[p : p + length[r]] == words[where[r] : where[r] + length[r]]).all()
    assert set(bounds) <= set(at.tolist()) and len(at) < 500 and (left < length).all()


def test_long_runs_and_runs_of_long_periods(spark):
    words = np.arange(60_000) % 7_000
    assert [x.tolist() for x in periodic_runs.runs_of(words, np.array([0, len(words)]))] == [[0], [60_000], [7_000]]
    one = periodic_runs.periodic_runs(frame_of(spark, ["x " * 50_000, "a b " * 3, "a " * 5, "a " * 6 + "b"])).collect()
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in one}
    assert runs == {0: [(0, 50_000, 1)], 1: [], 2: [], 3: [(0, 6, 1)]}
    assert {r.doc_id: r.collapsed for r in one} == {0: "x", 1: "a b a b a b", 2: "a a a a a", 3: "a b"}


def test_a_wrong_hash_is_found_out(monkeypatch):
    words = np.array([0, 1, 2, 0, 1, 3] * 3 + [4] * 9, np.int64)
    right, calls = periodic_runs.Hashes.equal, []

    def wrong(self, a, b, length):
        calls.append(1)
        return right(self, a, b, length) if len(calls) > 40 else np.ones(len(a), bool)

    monkeypatch.setattr(periodic_runs.Hashes, "equal", wrong)
    found = periodic_runs.runs_of(words, np.array([0, len(words)]))
    assert [x.tolist() for x in found] == [[18], [27], [1]]


# --- 12 SentencePiece


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


ALPHABET = "ab cé▁ \n\t\x00ßxyz0123…“”日本語🙂́ <s></s>"


def test_pieces_query_against_the_library(spark, texts, library):
    found = {r.doc_id: r for r in queries.QUERIES["op12_sentencepiece"](spark, FOLDER).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = found[i]
        assert row.n_tokens == len(ids) and row.n_source_bytes == len((text or "").encode())
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_are_the_librarys(library, texts):
    rng = random.Random(4)
    model = pieces.model_of(pieces.read_model(MODEL))
    tries = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [t for t in texts.values() if t][:30]
    for text, (ids, begins, ends) in zip(tries, model.encode([t.encode() for t in tries])):
        expected = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1] == expected
        assert (ids[0], ids[-1]) == (1, 2)


def double_array(keys):
    """A compiled character map of {key: replacement}, in the format that the library reads."""
    values, places = b"", {}
    for key, value in keys.items():
        places[key.encode()] = len(values)
        values += value.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        below = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in places
        labels = ([0] if leaf else []) + below
        base = 1
        while any(base ^ c in used for c in labels) or (node ^ base) >= 1 << 21:
            base += 1
        used.update(base ^ c for c in labels)
        units[node] = units.get(node, 0) | (node ^ base) << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = places[prefix] | 1 << 31
        for c in below:
            units[base ^ c] = c
        for c in below:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    size = (max(units) // 256 + 1) * 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + values


@pytest.mark.parametrize("trim", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_longest_prefixes_of_a_compiled_map(trim, dummy):
    rules = {"ﬁ": "fi", "A": "a", "AB": "x y", "ABC": "q", "\t": " ", "é": "e", "…": "...", "ß": "", "　": "  "}
    spec = pieces.field(1, b"own") + pieces.field(2, double_array(rules)) + pieces.field(3, dummy) + pieces.field(4, trim) + pieces.field(5, 1)
    blob = b"".join(pieces.field(n, v) for n, v in pieces.fields(pieces.read_model(MODEL)) if n != 3) + pieces.field(3, spec)
    library, model = SentencePieceProcessor(model_proto=blob), pieces.Model(blob)
    rng = random.Random(trim * 2 + dummy)
    tries = ["".join(rng.choice("ABCABC  \tﬁé…ß　xyz🙂") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    for text, (ids, begins, ends) in zip(tries, model.encode([t.encode() for t in tries])):
        expected = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1] == expected, text


def test_decoding_frames_of_ids(spark, library):
    frame = spark.createDataFrame([(1, [1, 306, 626, 2], "x"), (2, None, "y"), (3, [], None)], "doc_id long, ids array<int>, text string")
    found = {r.doc_id: (r.text, bytes(r.packed)) for r in pieces.decoded(frame, pieces.read_model(MODEL)).collect()}
    assert found == {1: (library.decode([1, 306, 626, 2]), struct.pack("<4I", 1, 306, 626, 2)), 2: ("", b""), 3: ("", b"")}


# --- 13 spelling variants


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return counts


def brute_variants(counts):
    """Rows of all words by deletion neighbourhoods: words one edit apart share a word less a letter, or are one."""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by = {}
    for w in counts:
        by.setdefault(w, set()).add((w, -1))
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add((w, i))
    near = {w: set() for w in counts}
    for short, group in by.items():
        for a, i in group:
            for b, j in group:
                if a != b and (i == j or -1 in (i, j)):
                    near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


def test_variants_query_against_brute_force(spark, texts):
    found = queries.QUERIES["op13_spelling_variants"](spark, FOLDER).collect()
    expected = brute_variants(brute_counts(texts.items()))
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert sum(r.form is not None for r in found) > 20 and any(r.root != r.form for r in found if r.form)


def test_no_near_pair_is_lost(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(1500)} | {"aaaaa", "aaaaaa", "baaaaa", "aaaaab"}
    counts = {w: rng.randint(3, 40) for w in words}
    frame = spark.createDataFrame([*counts.items(), (None, 9), ("abc", 50), ("zzzzzz", 1), ("zzzzzz", 2)], "word string, n long")
    found = variants.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in found} == brute_variants({**counts, "zzzzzz": 3})


def test_chains_of_forms_lead_to_their_root(spark):
    # Each word is one edit from the next and twice as frequent
    chain = ["abcdef"[:i] + "zzzzzzzz"[i:] for i in range(7)]
    frame = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    found = {r.word: r for r in variants.spelling_variants(frame).collect()}
    assert {r.root for r in found.values()} == {chain[-1]} and found[chain[0]].form == chain[1]
    assert found[chain[-1]].form is None


def test_counts_of_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 10)
    rows = [(1, "Élan Vital ÉLAN x×y")] * 50 + [(None, "vital"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    assert {r.word: r.n for r in variants.word_counts(frame, variants.slip).collect()} == dict(brute_counts(rows))
