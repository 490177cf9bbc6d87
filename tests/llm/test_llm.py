"""Operators on training data: against brute force, on nulls, empty and long texts, ties, repeats and empty tables."""

import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from forumloom.llm import (  # noqa: E402
    automaton,
    components,
    decontaminate,
    language,
    minhash,
    packing,
    queries,
    repeats,
    secrets,
    toxicity,
    urls,
    vectors,
    warc,
)

SMALL = "/root/testdata/sf0.001"
RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words) for _ in range(n))


BASE = prose(60)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE + " tail"), (3, None), (4, ""), (5, "   \n\t "), (6, "one two"), (7, "One TWO"), (7, "One TWO"),
    (None, BASE), (8, prose(40) + " " + BASE[:120] + " " + prose(30)), (9, prose(6000)), (10, "x" * 300_000), (11, "é ß ñ 中文 \x00 \x85"),
    (12, prose(12)), (13, 'token = "abcdef12" AKIA' + "A" * 16 + " " + "0f" * 14), (14, "token=short password: 123456\nsecret x"),
]
SCHEMA = "doc_id long, text string, lang string, spans string, score double, n_words long, shard long"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names the operators use."""
    rows = [(i, t, "en" if t and i else None, "s", 1.0, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_cuts_every_token_once(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, capacity=64).collect()
    used, pieces = {}, {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) <= 64
    assert len(used) * 64 - sum(r.length for r in rows) < 64 * 3  # less than a sequence of padding a task
    for i, text in set(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = [r for r in pieces[(i, len(ids))] if zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        covered = sorted({(r.start, r.length) for r in own})
        assert sum(n for _, n in covered) >= len(ids)
    assert packing.pack(empty).count() == 0


def test_balance_prefers_the_cheapest_sequence():
    pieces = packing.balance([5, 4, 3, 2, 2], 8, 1.0, 0.1)
    assert [(d, s) for d, _, _, s, _ in pieces[:2]] == [(0, 0), (1, 1)]
    assert sum(n for _, _, n, _, _ in pieces) == 16 and packing.balance([], 8, 1, 1) == []


def test_language(spark, docs, empty):
    rows = [(i, t * 8, lang) for i in range(12) for t, lang in (("the then there this ", "en"), ("der die das und ", "de"))]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.train_profiles(known)
    found = {(r.doc_id, r.text): r for r in language.identify(docs.drop("score"), profiles).collect()}
    assert found[(5, "   \n\t ")].lang_pred == found[(3, None)].lang_pred == "und" and found[(4, "")].score == 0
    guess = language.identify(known.limit(6), profiles).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in guess)
    assert language.identify(empty.drop("score"), profiles).count() == 0
    none = language.identify(docs.drop("score"), language.train_profiles(empty)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_gram_vectors_are_bound_and_counted():
    letters = language.letter_vectors(32, 1)
    gram = (5 * language.LETTERS + 6) * language.LETTERS + 7
    bound = np.roll(letters[5], 2) * np.roll(letters[6], 1) * letters[7]
    assert (language.gram_vectors(np.array([gram]), letters)[0] == bound).all()
    grams, place = language.grams_of(["ab!! c", "", None, "12"], language.letter_codes())
    assert list(place) == [0] * 4 and grams[0] == (0 * 128 + 1) * 128 + 2


def held_out_language_and_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r.doc_id: r for r in docs.collect()}


def test_held_out_quality(spark):
    docs = held_out_language_and_toxicity(spark)
    found = [r for r in queries.op2_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(found) > 100 and np.mean([docs[r.doc_id].lang == r.lang_pred for r in found]) > 0.97
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    scored = [r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert np.mean([labels[r.doc_id] == r.predicted for r in scored]) > 0.9


def test_held_out_toxic_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = [r for r in queries.op9_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    hits = sum(labels[r.doc_id] == 1 for r in scored if r.predicted == 1)
    assert hits / sum(labels[r.doc_id] == 1 for r in scored) > 0.5
    assert hits / sum(r.predicted for r in scored) > 0.8
    toxic = np.array([r.score for r in scored if labels[r.doc_id] == 1])
    plain = np.array([r.score for r in scored if labels[r.doc_id] == 0])
    wins = (toxic[:, None] > plain).mean() + (toxic[:, None] == plain).mean() / 2
    assert wins > 0.88


def test_dictionaries_are_trained_and_distances_are_those_of_zstandard():
    import zstandard as zstd

    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)).encode() for _ in range(300)]
    windows = [b" %s " % b" ".join(draw.choice(words) for _ in range(12)) for _ in range(500)]
    made = toxicity.dictionary(windows, 2048)
    assert len(made) <= 2048 and zstd.ZstdCompressionDict(made).dict_id() != 0
    assert toxicity.dictionary(windows[:2], 2048) == windows[0] + windows[1]
    assert toxicity.dictionary([], 2048) == b""
    found = toxicity.Distances(made, b"").features(windows[7])
    bare = len(zstd.ZstdCompressor(level=toxicity.LEVEL, write_content_size=False).compress(windows[7]))
    assert 0 < found[0] < bare and found[1] == 0.0


def brute_repeats(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, 10**9), 10**9 - 1 if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (10**9 - 1 if i is None else i):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [4, 13])
def test_repeats_equal_brute_force(spark, docs, empty, size):
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    found = repeats.remove_repeats(docs, size=size).select("doc_id", "n_words", removed.alias("r"), "kept_text").collect()
    assert sorted(map(tuple, found), key=repr) == brute_repeats(TEXTS, size)
    few = [WORDS[0], WORDS[1], WORDS[2]]
    rows = [(i, prose(RNG.randrange(0, 60), few)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.remove_repeats(frame, size=size).select("doc_id", "n_words", removed.alias("r"), "kept_text").collect()
    assert sorted(map(tuple, found), key=repr) == brute_repeats(rows, size)
    assert repeats.remove_repeats(empty).count() == 0


def brute_components(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == brute_components({x for e in edges for x in e}, edges)


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(3, 8))
    rows = [(i, int(i % 2), [float(x) for x in centre[i % 3] + rng.normal(scale=0.25, size=8)]) for i in range(300)]
    rows += [(900, 0, rows[0][2]), (901, 0, [2 * x for x in rows[0][2]]), (902, None, rows[0][2]), (903, 0, None), (904, 0, [0.0] * 8)]
    rows += [(905, 0, [float("nan")] + [1.0] * 7), (906, 0, [None] + [1.0] * 7), (907, 1, rows[0][2]), (908, 0, [])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1))
    good = [r for r in rows if r[1] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all() and any(r[2])]
    x = np.array([r[2] for r in good])
    cosine = x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    links = [
        (good[a][0], good[b][0])
        for a, b in zip(*np.nonzero(cosine >= 0.9), strict=True)
        if a != b and good[a][1] == good[b][1]
    ]
    label = brute_components([r[0] for r in rows], links)
    expected = sorted((i, sum(a == i for a, _ in links), label[i], label[i] == i) for i, *_ in rows)
    assert sorted(map(tuple, vectors.near_vectors(frame, threshold=0.9).collect())) == expected
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_dual_traversal_counts_dense_groups():
    rng = np.random.default_rng(2)
    x = vectors.unit(np.concatenate([rng.normal(size=(200, 16)), np.ones((300, 16)) + rng.normal(scale=0.02, size=(300, 16))]))
    weight = rng.integers(1, 4, 500).astype(float)
    total, a, b = vectors.dual_links(x, x, weight, 0.98)
    assert (total == (x @ x.T >= 0.98) @ weight).all()
    ids, root = vectors.roots(a, b)
    assert len(set(root[np.isin(ids, np.arange(200, 500))])) == 1


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 200_000
    rows = [(1, "a", 0), (2, "a", 0), (3, None, 0), (4, "", 0), (5, long, 0), (6, long, 0), (None, "a", 0), (7, "b\r\n\r\nc", 0), (7, "b\r\n\r\nc", 0)]
    pages = spark.createDataFrame(rows, "page_id long, html string, payload int").repartition(2)
    found = sorted(map(tuple, warc.archive_pages(pages).collect()), key=repr)
    digest = lambda t: warc.sha1_text(warc.hashlib.sha1(t.encode()))
    best = {"a": 2, "": 4, long: 6, "b\r\n\r\nc": 7}
    expected = [
        (i, len((t or "").encode()), digest(t or ""), "response" if i == best[t or ""] else "revisit", None if i == best[t or ""] else best[t or ""])
        for i, t, _ in rows
    ]
    assert found == sorted(expected, key=repr)
    files = warc.write_archives(warc.with_roles(pages))
    chunks = warc.read_chunks(spark, files).where("page_id = 6").orderBy("chunk_no").collect()
    assert len(chunks) > 5 and b"".join(bytes(c.data) for c in chunks).decode() == long and chunks[-1].is_last
    assert warc.archive_pages(pages.limit(0)).count() == 0


def brute_contamination(texts, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if tuple(w[k : k + length]) in windows:
                    hit |= set(range(k, k + length))
                    found |= windows[tuple(w[k : k + length])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, docs, empty, block):
    items = [(1, BASE[:150]), (2, "One, two!"), (3, None), (4, ""), (5, BASE[40:170]), (6, "w1 w2"), (None, "w3"), (7, "中文")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_bytes=block)
    hit = F.aggregate("covered", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rows = [tuple(r) for r in found.select("doc_id", "n_words", hit.alias("h"), "items").collect()]
    assert sorted(rows, key=repr) == brute_contamination(TEXTS, items, 10)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where(F.size("covered") > 0).count() == 0


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    for i in range(100, 160):
        words = prose(80).split() if i % 6 == 0 else [w if RNG.random() > 0.01 else "changed" for w in rows[-1][1].split()]
        rows.append((i, " ".join(words)))
    frame = docs.select("doc_id", "text").where("doc_id IS NULL").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [(i, brute_shingles(t)) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = brute_components({i for i, _ in rows}, links)
    expected = [(i, len(s), label[i], label[i] == i) for i, s in sets] + [(None, len(brute_shingles(BASE)), None, True)]
    assert sorted(map(tuple, minhash.near_duplicates(frame).collect()), key=repr) == sorted(expected, key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    joined = sorted(map(tuple, minhash.near_duplicates(docs).select(columns).collect()))
    for name, value in {"DENSE": 1, "BLOCK": 2, "CELL_SHINGLES": 300, "STAR_ROUNDS": 0}.items():
        monkeypatch.setattr(minhash, name, value)
    assert sorted(map(tuple, minhash.near_duplicates(docs).select(columns).collect())) == joined


def test_url_rules_and_list(spark):
    rows = [(1, "http://WWW.example.com/en/x?q#f"), (2, "https://a.example.com/en/"), (3, "x://notexample.com/en/1"), (4, None), (5, "no scheme")]
    rows += [(6, "http://h.org/a/"), (7, "http://h.org/a#z"), (8, "http://h.org/b"), (8, "http://h.org/b"), (9, "http://s.net/fr/"), (10, "http://s.net/fr")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("h.org/a",), (None,)], "url string")
    found = {tuple(r) for r in urls.filter_urls(pages, queries.URL_RULES, listed, blocks=1).drop("url").collect()}
    assert found == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "notexample.com", "/en/1", "com/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "h.org", "/a/", None, "block"), (7, "h.org", "/a", None, "block"), (8, "h.org", "/b", None, "allow"),
        (9, "s.net", "/fr/", "net/fr/", "block"), (10, "s.net", "/fr", None, "allow"),
    }
    assert urls.filter_urls(pages.limit(0), [], listed).count() == 0


def test_url_filter_stays_in_the_engine(spark):
    plan = queries.op8_filter_urls(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_secrets(text):
    found = []
    for order, (kind, pattern, group, least, _) in enumerate(secrets.RULES):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets_equal_brute_force(spark, docs, empty):
    alphabet = ["token", "Secret", "API_key", "password", "=", ":", " ", '"', "abcdef", "0123456789ab", "AKIA", "ABCDEFGH", "\n", "é", "ghp_", "k"]
    rows = [(i, "".join(RNG.choice(alphabet) for _ in range(RNG.randrange(80)))) for i in range(400)] + TEXTS
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    found = secrets.find_secrets(frame).collect()
    assert len(found) == len(rows) and sum(bool(r.spans) for r in found) > 50
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute_secrets(r.text), r.text
    assert secrets.find_secrets(empty).count() == 0


def test_automaton_finds_matches_across_lanes():
    machine = automaton.compile_rules((r"ab{3}c*d", r"[0-9]{5}"))
    data = ("".join(RNG.choice("abbbccd0123456789\n") for _ in range(20_000)) + "abbb" + "c" * 500 + "d").encode()
    places, rules = automaton.scan(machine, data, lanes=700)
    for bit, pattern in enumerate((rb"ab{3}c*d\Z", rb"[0-9]{5}\Z")):
        mine = set(places[rules >> bit & 1 == 1].tolist())
        ends = {i for i in range(len(data)) if re.search(pattern, data[max(0, i - 600) : i + 1])}
        assert mine == ends


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(15)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.drop("score"), labels)
    found = toxicity.score(docs.drop("score"), model).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(empty.drop("score"), nothing).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), T.StructType(docs.schema.fields))
    left = {r.doc_id for r in docs.collect()}
    texts = [(i, r.text) for i, r in before.items()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, _, hit, _ in brute_contamination(texts, items, 10) if hit} | {i for i, t in texts if brute_secrets(t)}
    near = {r.doc_id for r in queries.op7_near_duplicates(spark, SMALL).where("NOT kept").collect()}
    assert left == set(before) - dirty - near
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == left
