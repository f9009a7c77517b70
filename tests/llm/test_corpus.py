"""The corpus operators against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import TABLES, arrow_kinds, normal, same_rows
from stepchange.llm import chat, common, decontaminate, language, line_dedup, mixing, near_dup, quality_rules, queries, secrets, suffix_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts
LONG = "\n".join(f"line {i} holds word{i % 977} and number {i * i % 7919} and nothing else" for i in range(4_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t\n ", "en", None, 5),
    (4, LONG, "en", "b", len(LONG)),
    (4, LONG, "en", "b", len(LONG)),
    (None, "no id here at all but text", "de", "b", 1),
    (None, None, None, None, None),
    (5, "one id", "en", "a", 6),
    (5, "another text of one id", "fr", "a", 6),
    (6, "«»–…", "xx", "a", 4),
    (7, "ünïcödé ÀÉ " * 60, "fr", "é", 9),
    (8, LONG, None, "c", 1),
]


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (5, 0, 1), (8, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")


def frame_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_its_sql(spark, engine, name):
    found = queries.QUERIES[name](spark, FOLDER).toArrow()
    expected = engine.sql(queries.ORACLES[name]).to_arrow_table()
    assert arrow_kinds(found.schema) == arrow_kinds(expected.schema)
    assert same_rows(normal(found), normal(expected))


# --- every operator on odd and empty tables


def operators(spark, labels):
    benchmark = spark.createDataFrame([(1, "number 1 and nothing else"), (2, None), (None, "ünïcödé"), (3, "")], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.report(d, labels),
        "line_dedup": line_dedup.report,
        "language": language.report,
        "mixing": mixing.report,
        "near_dup": near_dup.report,
        "decontaminate": lambda d: decontaminate.report(d, benchmark),
        "suffix_dedup": suffix_dedup.report,
        "secrets": secrets.report,
        "quality_rules": lambda d: quality_rules.report(d, labels),
    }


NAMES = ["toxicity", "line_dedup", "language", "mixing", "near_dup", "decontaminate", "suffix_dedup", "secrets", "quality_rules"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_have_a_result(spark, odd, labels, name):
    rows = operators(spark, labels)[name](odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, labels, name):
    assert operators(spark, labels.limit(0))[name](empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_of_any_name_change_nothing(spark, odd, labels, name):
    run = operators(spark, labels)[name]
    extra = odd
    for column in ("row", "size", "score", "text_hash", "n", "spans", "kept", "label", "key", "copy", "bucket", "lines", "record"):
        extra = extra.withColumn(column, F.lit("x"))
    assert sorted(map(str, run(extra).collect())) == sorted(map(str, run(odd).collect()))


def test_filters_keep_columns(spark, odd, labels):
    extra = odd.withColumn("row", F.lit(1)).withColumn("copy", F.lit("x")).withColumn("target", F.lit("y"))
    benchmark = spark.createDataFrame([(1, "number 1 and nothing else")], "item_id long, text string")
    for out in (
        toxicity.without_toxic(extra, labels),
        line_dedup.dedup_lines(extra),
        near_dup.deduplicated(extra),
        decontaminate.decontaminated(extra, benchmark),
    ):
        assert out.columns == extra.columns
        assert out.where("row <> 1 or copy <> 'x' or target <> 'y'").count() == 0
    mixed = mixing.mixed_documents(extra)
    assert mixed.columns == [*odd.columns, "row", "copy_", "target_", "copy", "copy_words", "target"]
    assert mixed.where("copy_ <> 'x'").count() == 0


# --- 1 toxicity


def test_toxicity_learns_and_is_sparse(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(600)]
    toxic = [i % 4 == 0 for i in range(600)]
    texts = [t + (" you rotten thing" if bad else " you kind thing") for t, bad in zip(texts, toxic)]
    documents = frame_of(spark, texts)
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, toxic int")
    rows = toxicity.report(documents, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    weights, _ = toxicity.train(documents, labels)
    assert 0 < (weights != 0).sum() < 2000
    again, _ = toxicity.train(documents, labels)
    assert np.allclose(weights, again)


def test_toxicity_never_sees_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(common.remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(documents, x) for x in (labels, turned))
    assert np.allclose(one[0], two[0]) and np.isclose(one[1], two[1])


def test_toxicity_sample_is_of_usable_documents(spark):
    texts = ["you rotten thing" if i % 4 == 0 else "you kind thing" for i in range(400)]
    long = [(1000 + i, "rotten " * 50, "en", "s", 0) for i in range(200)] + [(1200 + i, None, "en", "s", 0) for i in range(200)]
    own = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    others = spark.createDataFrame([(1000 + i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    params = toxicity.FtrlParams(labelled=100, row_bytes=100)
    documents = frame_of(spark, texts)
    alone = toxicity.train(documents, own, params)
    among = toxicity.train(documents.union(spark.createDataFrame(long, SCHEMA)), own.union(others), params)
    assert (alone[0] != 0).any()
    assert np.allclose(alone[0], among[0]) and np.isclose(alone[1], among[1])


# --- 2 line dedup


def brute_lines(rows, n=3):
    seen, gone = set(), {}
    for name, text in sorted(rows):
        lines = text.split("\n")
        for i in range(len(lines) - n + 1):
            window = tuple(lines[i : i + n])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone.setdefault(name, set()).update(range(i, i + n))
            seen.add(window)
    return {name: "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone.get(name, ())) for name, text in rows}


def test_line_windows_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choices(["a", "b", "", "c d"], k=rng.randint(0, 12)))) for i in range(80)]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame_of(spark, [t for _, t in rows])).collect()}
    assert found == brute_lines(rows)


# --- 3 chat formatting


def test_chat_round_trip_and_escapes():
    pieces = [*chat.CONTROLS, "\\", "\n", "<", "|", "im_end", "a", ">", "[INST", "é"]
    rng = random.Random(7)
    for _ in range(500):
        turns = [("".join(rng.choices(pieces, k=rng.randint(0, 3))), "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        turns = [(rng.choice(["user", "assistant", r]), t) for r, t in turns]
        text, mask = chat.format_turns(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
        for control in chat.CONTROLS:
            assert text.count(control) == (len(turns) if control in (chat.OPEN, chat.CLOSE) else 0)


def test_chat_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "x", "output": "done"},
        {"prompt": "p", "response": "r", "system": "s"},
        {"messages": []},
        {"unknown": {"shape": 1}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "{broken"), (8, "[1]")]
    out = {r.conv_id: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    turns = {i: chat.read_back(r.formatted) if r.formatted is not None else None for i, r in out.items()}
    assert turns[0] == [("user", "q"), ("assistant", "")]
    assert turns[1] == [("user", "q"), ("assistant", "a")]
    assert turns[2] == [("user", "do\nx"), ("assistant", "done")]
    assert turns[3] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert turns[4] == []
    assert turns[5] is None and len(out[5].fingerprint) == 16
    assert {out[i].fingerprint for i in (6, 7, 8)} == {"none"}


def test_chat_further_fields_and_layouts_of_callers(spark):
    said = [("user", "q"), ("assistant", "a")]
    records = [
        {"id": 7, "source": {"url": "x"}, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "weight": 1}]},
        {"prompt": "q", "completion": "a", "system": "s", "tags": ["t"]},
        {"id": 1, "messages": []},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"text": "a"}]}]},
        {"prompt": "q", "response": "a", "answer": "b"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]},
        {"messages": [None]},
        {"ask": "q", "say": "a", "id": 2},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    own = ((("ask", "say"), chat.Mapping(fields=(("user", ("ask",)), ("assistant", ("say",))))),)
    read = lambda f: {r.conv_id: None if r.formatted is None else chat.read_back(r.formatted) for r in f.collect()}
    # Texts that no mapping reaches make a layout unknown, so they are never left out silently
    assert read(chat.format_records(frame)) == {0: said, 1: [("system", "s"), *said], 2: [], 3: None, 4: None, 5: [said[0], ("assistant", "")], 6: None, 7: None}
    assert read(chat.format_records(frame, layouts=(*chat.LAYOUTS, *own)))[7] == said
    assert read(chat.format_records(frame, layouts=own)) == {**dict.fromkeys(range(7)), 7: said}


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, None, None, None), (1, 1, "user", ""), (None, 0, "user", "x"), (1, 1, "user", "")], schema)
    out = {r.conv_id: r for r in chat.report(rows.withColumn("record", F.lit(1))).collect()}
    assert out[1].n_turns == 3 and out[None].n_turns == 1 and out[-1].n_turns == 2
    assert out[1].turns_sha256 == hashlib.sha256(b"\n\nuser\n\nuser\n\n").hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert out[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[-1].loss_chars == len(said)
    assert [r.conv_id for r in chat.report(rows.limit(0)).collect()] == [-1]


# --- 4 language


def test_language_on_held_out_rows(spark, documents):
    truth = {r.doc_id: r for r in documents.collect()}
    rows = language.report(documents).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_letters_and_unseen_words(spark):
    texts = ["the house and the garden of the king"] * 30 + ["das haus und der garten des königs"] * 30 + [None, "", "123 «»", "– …", "thegarden gardenhouse", "hausgarten"]
    rows = [(i, t, "en" if i < 30 else "de" if i < 60 else None, None, None) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in language.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {out[i].lang_pred for i in range(60, 64)} == {"und"}
    assert out[64].lang_pred == "en" and out[65].lang_pred == "de"


def test_language_of_scripts_without_spaces(spark):
    rng = random.Random(5)
    kinds = {"zh": "的一是不了在人有我他这中大来上国", "ja": "のにはをたがでてとしれさある国中", "th": "กขคงจฉชซญดตถทนบป", "en": None}
    made = lambda k, n: "，".join("".join(rng.choices(kinds[k], k=40)) for _ in range(n)) if kinds[k] else "the house and the garden of the king " * n
    rows = [(100 * i + j, made(k, 4), k, None, None) for i, k in enumerate(kinds) for j in range(60)]
    # Only the part after the first 64 bytes is in the language; one run with a Latin name inside; null lang isn't learned
    last = {1000: ("国中" * 11 + made("zh", 5), "zh"), 1001: ("国中" * 11 + made("ja", 5), "ja"), 1002: (made("zh", 2) + "garden" + made("zh", 2), "zh"), 1003: (made("th", 900), "th")}
    frame = spark.createDataFrame(rows + [(i, t, None, None, None) for i, (t, _) in last.items()], SCHEMA)
    out = {r.doc_id: r.lang_pred for r in language.report(frame).collect()}
    assert {i: out[i] for i in last} == {i: k for i, (_, k) in last.items()}
    assert np.mean([out[r[0]] == r[2] for r in rows]) > 0.95


def test_language_counts_all_ngrams_of_a_long_run():
    import pyarrow as pa

    text = "ab" + "語学é" * 40 + "z"
    mark = f"^{text}$"
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text])], ["lang", "text"])
    rows = [r for b in language._count_words([batch]) for r in b.to_pylist()]
    for size in language.ORDERS:
        brute = Counter(mark[i : i + size] for i in range(len(mark) - size + 1))
        assert {r["word"]: r["n"] for r in rows if r["size"] == size} == brute
    assert not [r for r in rows if r["size"] == 0]


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_WORDS", 40)
    monkeypatch.setattr(language, "MODEL_GRAMS", 40)
    rng = random.Random(2)
    many = [(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}") for i in range(100)]
    rows = [(i, " ".join(rng.choices(many, range(1, 101), k=60)), "big", None, None) for i in range(200)]
    rows += [(1000 + i, "zorq zimp zalt", "small", None, None) for i in range(3) if zlib.crc32(str(1000 + i).encode()) % 3 != 1]
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    assert set(language.hash_bytes([b"zorq", b"zimp", b"zalt"]).tolist()) <= set(model.words.tolist())
    assert 20 <= len(model.words) <= 40


def test_words_that_all_tie_are_thinned_out(spark):
    counts = spark.createDataFrame([(f"w{i}", "x", 1) for i in range(3000)] + [("v", "y", 7), ("u", "y", 5)], "word string, lang string, n long")
    found = {r.word for r in language.frequent(counts, 300).collect()}
    assert {"u", "v"} < found and 200 < len(found) < 400


def test_equal_rows_and_one_id_are_mixed_whole(spark):
    # One row in a thousand copies, and one id in a thousand texts: each row is in the mix as often as it is taken
    rows = [(1, "same words here", "en", "a", i) for i in range(1000)] + [(2, f"text {i} of one id", "en", "a", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    taken = mixing.mix(frame).select("row.doc_id", "row.text", "row.n_chars", "size", "taken").collect()
    assert len(taken) == 2000 and len({(r.doc_id, r.text, r.n_chars) for r in taken}) == 2000
    report = mixing.report(frame)
    assert sorted((r.doc_id, r.taken) for r in taken) == sorted((r.doc_id, r.taken) for r in report.collect())
    keys = frame.select(mixing.random_key().alias("k")).distinct().count()
    assert keys == 1001


# --- 5 mixing


def test_mix_targets_and_limits(spark):
    rows = [(i, "w " * (i % 7), None, ["a", "b", "c", "d", None][i % 5] if i > 20 else "tiny", 0) for i in range(400)]
    found = mixing.takes(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, taken, targets = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size == len((rows[r.doc_id][1]).split())
    assert all(abs(taken[s] - targets[s]) <= 0.5 and targets[s] <= 2 * sizes[s] for s in sizes)
    assert abs(sum(targets.values()) - min(1.5, 2) * sum(sizes.values())) < 1e-6
    assert targets["tiny"] == 2 * sizes["tiny"]
    assert sorted(map(str, found)) == sorted(map(str, mixing.takes(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()))


def test_mixed_documents_hold_the_taken_words(spark, odd):
    out = mixing.mixed_documents(odd).collect()
    takes = mixing.takes(odd).collect()
    assert sum(r.copy_words for r in out) == sum(r.taken for r in takes)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.copy_words for r in out)


# --- 6 near duplicates


def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {i: (len(sets[i]), root[i]) for i in ids}


def test_near_duplicates_in_chains_and_stars(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 150]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 15])):
            # A chain: each copy changes the last one, so ends are far from the start
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += ["", None, "One", "one", "a  B\tc", "A b\nC"]
    rng.shuffle(texts)
    wanted = brute_links(dict(enumerate(texts)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.report(frame_of(spark, texts)).collect()}
    assert found == wanted
    assert len({c for _, c in wanted.values()}) < len(texts) - 40


def test_unlike_texts_with_a_common_passage_are_hardly_compared(spark, monkeypatch):
    rng, linkers = random.Random(31), []
    init = near_dup.Linker.__init__

    def kept(self, *args):
        linkers.append(self)
        init(self, *args)

    monkeypatch.setattr(near_dup.Linker, "__init__", kept)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = {i: passage + " " + " ".join(f"own{i}x{k}" for k in range(40)) for i in range(600)}
    # Two that are alike, and stragglers of a family that a star alone does not reach
    texts[600] = texts[17].replace("own17x5", "other")
    base = [f"base{k}" for k in range(100)]
    for i in range(601, 680):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(100)] = f"edit{i}x{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    found = {r.doc_id: r.component_id for r in near_dup.report(frame_of(spark, [texts[i] for i in range(680)])).collect()}
    assert found == {i: root for i, (_, root) in brute_links(texts).items()} and found[600] == 17
    # Stars give one pair a bucket and text; what follows doesn't grow with the square of the texts
    assert linkers[0].tested.count() < 680 * 30


def test_densified_signatures_match_like_sets():
    rng = np.random.default_rng(1)
    close = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 12, dtype=np.uint64))
        a, b = pool[:-1], pool[1:]
        close.append((near_dup.signature(a) == near_dup.signature(b)).mean())
    assert abs(np.mean(close) - 10 / 12) < 0.06


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, j) for j in range(1001, 1060)] + [(500, 1030)]
    roots = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(41)} == {0}
    assert {roots[i] for i in range(1000, 1060)} == {500}


# --- 7 decontamination


def test_matches_do_not_depend_on_blocks(spark, documents):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = lambda limit: sorted(map(str, decontaminate.matches(documents.unionByName(documents.limit(3)), benchmark, limit=limit).drop("spans").collect()))
    assert rows(decontaminate.BENCHMARK_BYTES) == rows(1500)
    clean = decontaminate.decontaminated(documents, benchmark, limit=1500).count()
    assert clean == decontaminate.matches(documents, benchmark).where("n_hit = 0").count()


def test_suffix_array_of_words():
    rng = np.random.default_rng(2)
    for _ in range(50):
        tokens = np.append(rng.integers(0, 3, 60), 0)
        starts = np.flatnonzero(tokens[:-1] > 0)
        order = decontaminate.suffix_array(tokens, starts, 61, 2, 2)
        padded = np.append(tokens, np.zeros(70, int))
        assert [tuple(padded[i : i + 61]) for i in order] == sorted(tuple(padded[i : i + 61]) for i in starts)


def test_short_items_and_longest_match(spark):
    item = " ".join(f"q{i}" for i in range(14))
    documents = frame_of(spark, [f"x {item} y", "x q2 q3 q4 Yes, NO z", "yes", None, "yes no yes no", " ".join(f"q{i}" for i in range(9))])
    benchmark = spark.createDataFrame([(10, item), (9, "Yes no"), (8, "..."), (7, None)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.matches(documents, benchmark).collect()}
    assert (out[0].n_hit, out[0].items, out[0].longest) == (14, ["10"], 14)
    assert (out[1].n_hit, out[1].items) == (2, ["9"])
    assert [out[i].n_hit for i in (2, 3, 5)] == [0, 0, 0]
    assert out[4].n_hit == 4


# --- 8 suffix arrays


def test_two_stage_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(4)
    for _ in range(100):
        pieces = [rng.integers(1, 4, rng.integers(5, 30)) for _ in range(5)]
        text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.uint16)
        wanted = np.flatnonzero(text)
        order = suffix_dedup.two_stage_order(text, wanted, 40)
        # Up to the end of its piece, by which equal ones are in any order
        key = lambda i: tuple(text[i : i + np.flatnonzero(text[i:] == 0)[0] + 1])
        assert [key(i) for i in order] == sorted(key(i) for i in wanted)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_RUNS, 1])
def test_repeated_strings_against_brute_force(spark, hot):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdef ", k=400))
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 900))) for _ in range(40)]
    texts = [t[: len(t) // 2] + passage[rng.randint(0, 90) : rng.randint(250, 400)] + t[len(t) // 2 :] if i % 3 else t for i, t in enumerate(texts)]
    texts += [texts[1], "z" * 700, "z" * 200, "z" * 199, "", "é" * 150, texts[2] + "tail", "\0\x01" * 300, "zy" * 150 + "é" * 100]
    wanted = suffix_dedup.brute_force({i: t.encode() for i, t in enumerate(texts)})
    rows = suffix_dedup.dedup_substrings(frame_of(spark, texts), hot_runs=hot).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert found == wanted


def test_a_document_read_twice_is_no_copy(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    one = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_substrings(one).collect()] == [0, 0]
    two = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_substrings(two).collect()] == [300, 300]


# --- 9 secrets


def test_secrets_against_expressions_over_whole_texts(spark):
    rng = random.Random(9)
    pieces = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "abc123", "AAAA0000BBBB1111", "0123456789abcdef", "é", "\n", "-", "ſecret", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    for row in secrets.report(frame_of(spark, texts)).collect():
        assert secrets.brute_force(texts[row.doc_id]) == (row.n_assign, row.n_access, row.n_hex, row.base_sha256)


def test_checksums_decide(spark):
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + secrets.token_checksum(body.encode()).decode()
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    texts = [f"é {good} end", f"{bad}", "card number: 4111 1111 1111 1111.", "card number: 4111 1111 1111 1112."]
    out = {r.doc_id: r for r in secrets.report(frame_of(spark, texts)).collect()}
    assert out[0].spans == f"token:2:{2 + len(good)}"
    assert out[1].spans == out[3].spans == ""
    assert out[2].n_card == 1
    clean = {r.doc_id: r.text for r in secrets.redacted(frame_of(spark, texts)).collect()}
    assert clean[0] == "é [secret] end" and clean[1] == bad


# --- 10 quality


def test_quality_counts_against_plain_python(spark):
    rng = random.Random(13)
    pieces = ["a", "b", "c d", "\n", " ", "a b c", "#", "é*", "\t", "\n\n", "x\x0by"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 90))) for _ in range(300)] + [None, "", "a\na\na"]
    rows = quality_rules.with_measures(quality_rules.measured(frame_of(spark, texts))).collect()
    for row in rows:
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert found == quality_rules.brute_force(texts[row.doc_id])


def test_exact_bounds():
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    p = quality_rules.upper_bound(3, 50, 0.01)
    from math import comb

    assert abs(sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) - 0.01) < 1e-9
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_quantiles_of_rates_without_a_buffer_a_stratum(spark, capsys):
    rng = random.Random(23)
    rows = [("en" if i % 3 else "de", *[0.0 if rng.random() < 0.5 else rng.random() * (9 if m == "word_length" else 0.1) for m in quality_rules.MEASURES]) for i in range(3000)]
    frame = spark.createDataFrame(rows, ["stratum", *quality_rules.MEASURES])
    fitted = quality_rules.quantiles(frame)
    found = {r.stratum: r for r in fitted.collect()}
    for stratum in ("en", "de"):
        for i, m in enumerate(quality_rules.MEASURES):
            values = sorted(r[i + 1] for r in rows if r[0] == stratum)
            assert found[stratum][m] == [values[max(math.ceil(round((1 - x) * len(values), 6)), 1) - 1] for x in quality_rules.LEVELS]
    fitted.explain()
    assert "percentile" not in capsys.readouterr().out


def test_cutoffs_hold_their_risk_and_reject_junk(spark):
    rng = random.Random(17)
    words = [f"word{i}" for i in range(2000)]
    good = [" ".join(rng.choices(words, k=120)) for _ in range(3000)]
    junk = [" ".join(w + "###" for w in rng.choices(words, k=120)) for _ in range(100)]
    documents = frame_of(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(0, 3100)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.report(documents, labels).collect()}
    assert np.mean([kept[i] for i in range(3000)]) > 1 - quality_rules.RISK
    assert not any(kept[i] for i in range(3000, 3100))
    # With few labels no cutoff can be guaranteed, and only the base rejects
    few = labels.where("doc_id < 40")
    assert all(r.kept for r in quality_rules.report(documents, few).collect())
