"""Each operator against a brute-force version on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import (
    bayes_lsh,
    cnn,
    common,
    components,
    gam,
    histogram_sort,
    kmeans_tree,
    license_join,
    positional_index,
    rans,
    sp_agenda,
    template_html,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, score string, size string, h int, key string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"
AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, LONG), (5, SAME), (6, SAME), (6, SAME), (7, SAME.replace("six", "Six")), (8, "a"), (8, "b"),
    (9, "It's we'll DON'T 'quoted' x'y 12ab_c"), (10, "  two  blanks \n\n and\ttabs "), (11, "<|endoftext|> <s> ▁a"), (12, "é ß — “q” 日本語 🙂\x00\x01"),
    (None, "no id"), (13, "x" * 5000), (14, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (15, "...,,, !!!"),
]


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def frame(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def largest_batch(session):
    """Bytes of the largest Arrow batch that 3,000 texts of 22 kB are handed to Python in."""
    rows = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("long words "), 2000).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long")
    return sizes.agg(F.max("n")).first()[0]


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    own, kept = spark.newSession(), spark.newSession()
    common.short_batches(own)
    assert largest_batch(own) < 2 << 20
    kept.conf.set(common.BATCH_BYTES, "8m")
    common.short_batches(kept)
    assert kept.conf.get(common.BATCH_BYTES) == "8m"


# --- 1: token ids -------------------------------------------------------------------------------


def test_rans_round_trip(spark, docs, none):
    tok = Tokenizer.from_file(BPE)
    path = rans.new_path(spark)
    coder = rans.encode(docs, BPE, path)
    got = rans.read(spark, path, coder).collect()
    assert len(got) == len(AWKWARD)
    want = sorted((np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in AWKWARD))
    assert sorted(bytes(r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    path = rans.new_path(spark)
    assert rans.read(spark, path, rans.encode(none, BPE, path)).count() == 0


def test_rans_bounds_its_batches_in_bytes(spark):
    own = spark.newSession()
    rans.encode(frame(own), BPE, rans.new_path(own))
    assert largest_batch(own) < 5 << 20


def test_rans_blocks_decode_from_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 200_000), 999).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=1000), 16), 16, lanes=64, interval=16)
    for n in (1, 2, 63, 64, 65, 5000, len(ids)):
        payload = coder.encode(ids[:n])
        assert (coder.decode(payload) == ids[:n]).all()
        a, b = n // 3, n - n // 5
        assert (coder.decode(payload, a, b) == ids[a:b]).all()
    freq = rans.scaled(np.array([10**9, 1, 0, 1]), 4)
    assert freq.sum() == 16 and freq[1] >= 1 and freq[2] == 0


def test_rans_checksum_is_checked(spark, docs):
    path = rans.new_path(spark)
    coder = rans.encode(docs.limit(3), BPE, path)
    blocks = spark.read.parquet(path).withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(path + "-bad")
    with pytest.raises(Exception, match="checksum"):
        rans.read(spark, path + "-bad", coder).collect()


def test_blocks_decode_from_all_checkpoints_at_once():
    rng = np.random.default_rng(31)
    for n, lanes, interval in ((1, 1, 4), (31, 3, 2), (1000, 7, 4), (4096, 16, 64), (5000, 2048, 64), (70_001, 33, 64)):
        ids = (rng.zipf(1.4, n) % 500).astype(np.uint32)
        coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=500), 16), 16, lanes, interval)
        payload = coder.encode(ids)
        assert (coder.decode_block(payload) == ids).all() and (coder.decode(payload) == ids).all()
    assert len(coder.decode_block(coder.encode(ids[:0]))) == 0


def test_a_dataset_is_read_by_itself(spark, docs, none, tmp_path):
    for k, table in enumerate((docs, none)):
        path = f"file://{tmp_path}/blocks{k}"
        coder = rans.encode(table, BPE, path)
        mine = rans.read_model(spark, path)
        assert (mine.freq == coder.freq).all() and mine.bits == coder.bits
        assert sorted(map(tuple, rans.read(spark, path).collect()), key=repr) == sorted(map(tuple, rans.read(spark, path, coder).collect()), key=repr)


def test_pieces_equal_the_library():
    rng = random.Random(3)
    alphabet = list("abcé ßAB12_'.,-!\n ") + ["'s", "'ll", "'re", " '", "don't", "  ", "\t", "—", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    tok = rans.PieceTokenizer(BPE, 0)
    flat, n = tok.ids(texts)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends, strict=True):
        assert flat[a:b].tolist() == [*tok.tok.encode(t, add_special_tokens=False).ids, 0], repr(t)


# --- 2: nearest neighbours -----------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:800] = x[200]  # one vector held by many rows
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)]
    bad = [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] + [1.0] * 15, ""), (2060, [1.0] * 3, ""), (2080, [None] * 16, ""), (None, [1.0] * 16, ""), (2100, [], "")]
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<float>, rank string").repartition(3)
    index = kmeans_tree.build(df, k=20)
    got = {}
    for r in kmeans_tree.search(index, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    found = total = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, hits in got.items():
        s = (wide * wide[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert all(abs(s[v] - c) < 1e-9 for _, v, c in hits)
        assert [(-c, v) for _, v, c in hits] == sorted((-c, v) for _, v, c in hits)
        found += len({v for _, v, _ in hits} & set(best.tolist()))
        total += 20
    assert found / total >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank string")
    assert kmeans_tree.search(kmeans_tree.build(few), few, 20).count() == 6
    assert kmeans_tree.build(few.filter("false")) is None


def test_nearest_neighbours_of_small_leaves(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 8)).repeat(5, 0) + 0.001 * rng.normal(size=(300, 8))  # tight clusters of fewer than k rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = kmeans_tree.build(df, k=4, leaf_size=8)
    index.visits = 1
    assert max(index.sizes.values()) < 21
    got = kmeans_tree.search(index, df, 20).groupBy("query_id").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {20}


def test_nearest_ties_and_equal_ids(spark):
    rng = np.random.default_rng(29)
    base = rng.integers(-2, 3, size=(200, 3))  # many equal inner products and vectors
    rows = [(i, v.tolist()) for i, v in enumerate(base) if v.any()]
    rows += [(7, [5, 5, 5]), (7, [4, 5, 5]), (7, [4, 5, 5])]  # one id with several vectors, one of them twice
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    index = kmeans_tree.build(df, k=20, leaf_size=4)
    index.visits = index.tree.leaves  # all leaves: exact
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    got = {}
    for r in kmeans_tree.search(index, df.filter("vec_id % 20 = 0 or vec_id = 7"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in sorted({i for i, _ in rows if i % 20 == 0 or i == 7}):
        want = []
        for own in [v for i, v in distinct if i == q]:
            others = sorted((-float(np.dot(own, v)), i) for i, v in distinct if (i, v) != (q, own))[:20]
            want += [(n, i, -s) for n, (s, i) in enumerate(others, 1)]
        assert sorted(got[q]) == sorted(want), q
    walk = index.tree.visits(np.array([1.0, 2.0, 3.0]), index.tree.leaves)
    assert sorted(walk) == list(range(index.tree.leaves))


def test_units_hold_every_leaf_once():
    sizes = np.array([5, 0, 9, 3, 25, 4, 4, 4, 11, 1])
    first, parts = kmeans_tree.units(sizes, 10)
    held = {}
    for leaf, (f, p) in enumerate(zip(first, parts)):
        assert p == max(1, -(-sizes[leaf] // 10) if sizes[leaf] > 10 else 1)
        for u in range(f, f + p):
            held.setdefault(u, []).append(leaf)
    assert all(len(x) == 1 or sum(sizes[x]) <= 10 for x in held.values()) and sorted(held) == list(range(max(held) + 1))


# --- 3: license scan -----------------------------------------------------------------------------


def test_license_scan(spark, docs, none):
    got = {(r["doc_id"], r["n_words"], r["labels"]): r for r in license_join.scan(docs).collect()}
    assert sum(k[0] == 6 for k in got) == 1
    hit = next(r for r in got.values() if r["doc_id"] == 14)
    assert (hit["n_base"], hit["first_word"], hit["last_word"], hit["base_labels"], hit["labels"], hit["score"]) == (2, 3, 8, "apache,mit", "apache,mit", 1.0)
    assert license_join.scan(docs).count() == len(AWKWARD) and license_join.scan(none).count() == 0
    across = frame(spark, [(1, "the mit\nlicense"), (2, "permission is hereby granted free of charge to any person obtaining a copy of this software")])
    rows = {r["doc_id"]: r for r in license_join.scan(across, threshold=0.6).collect()}
    assert rows[1]["n_base"] == 1 and rows[2]["labels"] == "mit" and rows[2]["n_base"] == 0


def test_license_join_is_exact():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for k in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_join.TemplateIndex(templates, {w.encode(): rng.randrange(50) for w in vocabulary}, threshold)
        for _ in range(300):
            block = [rng.choice([*vocabulary, "other"]).encode() for _ in range(rng.randrange(0, 12))]
            want = {k for k, (_, t) in enumerate(templates) if len({*t.encode().split()} & {*block}) >= threshold * len(t.split()) - 1e-9}
            assert {k for k, _ in index.match(block)} == want


def test_license_spans_cross_lines(spark):
    wrapped = lambda text, n: "\n".join(" * " + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows = [(k, "Some file.\n\n" + wrapped(t, n) + "\nint x;") for k, (_, t) in enumerate(license_join.TEMPLATES) for n in (3, 8)]
    for r in license_join.scan(frame(spark, rows)).collect():
        assert license_join.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1.0
        n = len(words(license_join.TEMPLATES[r["doc_id"]][1]))
        # Leading words that occur again in the notice may be left out of its span.
        assert any(2 <= s["first_word"] <= 4 and s["end_word"] == 2 + n for s in r["spans"])
    twice = [(1, "Released under the MIT License. Released under the MIT License."), (2, "released " + "x " * 9 + "under the mit license " + "x " * 9 + "released")]
    got = {r["doc_id"]: r["spans"] for r in license_join.scan(frame(spark, twice)).collect()}
    assert [(s["block"], s["first_word"], s["end_word"]) for s in got[1]] == [(0, 0, 5), (0, 5, 10)]
    assert [(s["first_word"], s["end_word"], s["containment"]) for s in got[2]] == [(10, 14, 0.8)]


def test_license_windows_are_exact():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for k in range(8)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_join.TemplateIndex(templates, {w.encode(): rng.randrange(50) for w in vocabulary}, threshold)
        for _ in range(200):
            text = [rng.choice([*vocabulary, *["other"] * 12]).encode() for _ in range(rng.randrange(0, 60))]
            best = {}
            for k, (_, t) in enumerate(templates):
                own, width = {*t.encode().split()}, -(-len(t.split()) * 3 // 2)
                n = max((len(own & {*text[i : i + width]}) for i in range(len(text))), default=0)
                if n >= threshold * len(own) - 1e-9:
                    best[k] = n / len(own)
            got = {}
            for k, a, b, c in index.spans(text):
                assert b - a <= index.width[k] and c == len({*text[a:b]} & {*templates[k][1].encode().split()}) / len(templates[k][1].split())
                got[k] = max(got.get(k, 0), c)
            assert got == best


def test_license_names_decide(spark):
    others = [
        "Released under the BSD License.", "Released under the Apache License, Version 2.0.", "Licensed under the Mozilla Public License, Version 2.0.",
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "It was released in May under a new name, and " + "so on " * 30 + "the license of mit " + "and more " * 30,
    ]
    cc = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License"
    rows = [*enumerate(others), (50, cc.format("NonCommercial")), (51, cc.format("ShareAlike")), (52, "Released under\nthe terms of the MIT\nLicense")]
    got = {r["doc_id"]: r["labels"] for r in license_join.scan(frame(spark, rows)).collect()}
    assert got == {0: "", 1: "apache", 2: "", 3: "", 4: "", 5: "", 6: "", 50: "cc-by-nc", 51: "cc-by-sa", 52: "mit"}


def brute_scan(text, templates, index, threshold=0.8):
    """n_words, base places, base labels, and the templates that some window holds."""
    w = [x.encode() for x in words(text)]
    places, base = [], set()
    for p, label in license_join.PHRASES:
        own = p.encode().split()
        at = [i for i in range(len(w)) if w[i : i + len(own)] == own]
        places += at
        base |= {label} if at else set()
    held = set()
    for k, (label, t) in enumerate(templates):
        own = {x.encode() for x in words(t)}
        for i in range(len(w)):
            have = own.intersection(w[i : i + index.width[k]])
            if len(have) >= threshold * len(own) - 1e-9 and own & license_join.NAMES <= have:
                held.add(label)
                break
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(held | base))


def test_whole_scan_equals_brute_force(spark):
    rng = random.Random(47)
    filler = lambda n: " ".join(rng.choice(("alpha", "software", "the", "license", "of", "any", "mit", "public", "bsd")) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "MIT License"), (3, "the mit\nlicense; Apache\tLicense")]
    for k, (_, t) in enumerate(license_join.ALL_TEMPLATES):
        own = t.split()
        kept = [x for x in own if rng.random() < 0.97]
        cut = own[: len(own) // 2]
        for n, body in enumerate((own, kept, cut)):
            lines = "\n".join("# " + " ".join(body[i : i + 9]) for i in range(0, len(body), 9))
            rows.append((10 * k + n + 10, f"{filler(30)}\n\n{lines}\n\n{filler(20)}"))
    df = frame(spark, rows)
    index = license_join.TemplateIndex(license_join.ALL_TEMPLATES, license_join.token_frequency(df, license_join.ALL_TEMPLATES, "text"), 0.8)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_join.scan(df).collect()}
    for i, t in rows:
        assert got[i] == brute_scan(t, license_join.ALL_TEMPLATES, index), i
    assert all(label in got[10 * k + 10][5].split(",") for k, (label, _) in enumerate(license_join.ALL_TEMPLATES))


# --- 4: decontamination ----------------------------------------------------------------------------


def brute_contamination(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        names = ",".join(sorted({str(x) for x in found if x is not None}))
        out.append((d, len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small_rows", [20_000, 0])
def test_decontamination(spark, small_rows):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(n))
    items = [(i, text(rng.randrange(8, 25))) for i in range(12)] + [(12, None), (13, ""), (14, "Gx AX"), (3, "bz cz dz"), (15, SAME), (16, SAME)]
    rows = []
    for i in range(60):
        own = rng.choice([t for _, t in items if t])
        rows.append((i, f"{text(rng.randrange(30))} {own.upper()}. {text(5)} {own if rng.random() < 0.5 else ''}"))
    rows += [(i, t) for i, t in AWKWARD]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    got = positional_index.contamination(frame(spark, rows), bench, small_rows=small_rows)
    assert sorted((tuple(r) for r in got.drop("h", "items").collect()), key=repr) == brute_contamination(rows, items)


def test_decontamination_of_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.contamination(docs, bench).filter("contaminated").count() == 0
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert positional_index.contamination(none, some).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "gamma x beta y alpha"), (2, "alpha beta"), (3, "alpha 1 2 3 4 5 6 7 8 9 beta gamma")]
    assert {r["doc_id"] for r in positional_index.near_matches(frame(spark, rows), bench, window=3, slop=3).collect()} == {1}


@pytest.mark.parametrize("small_rows", [0, 20_000])
def test_proximity_equals_brute_force(spark, small_rows):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(9)] + [(3, text(5)), (20, None), (21, "ax"), (22, "ax ax ax")]
    rows = [(i, text(rng.randrange(60))) for i in range(40)] + [(None, items[2][1] + " x " + items[4][1]), (7, items[1][1]), (7, items[1][1]), (8, None), (9, "")]
    window, slop = 4, 2
    count = {}
    for _, t in rows:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    wins = {(str(i), tuple(w[s : s + window])) for i, t in items for w in [words(t)] for s in range(max(1, len(w) - window + 1)) if w}
    want = set()
    for i, t in rows:
        w = words(t)
        for item, win in wins:
            if all(x in count for x in win):
                rare = min(win, key=lambda x: (count[x], x))
                for p, x in enumerate(w):
                    if x == rare and set(win) <= set(w[max(0, p - window + 1 - slop) : p + window + slop]):
                        want.add((i, t, item, p))
    got = positional_index.near_matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window, slop, small_rows)
    hashes = frame(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    rows_got = [(r["doc_id"], r["text"], r["item"], r["at"]) for r in got.join(hashes, "h").collect()]
    assert sorted(rows_got, key=repr) == sorted(want, key=repr)


# --- 5: quality --------------------------------------------------------------------------------------


def test_training_samples_are_bounded_and_fixed(spark):
    rng = random.Random(21)
    rows = [(i % 150, " ".join(rng.choice(("bad", "good", "some", "word")) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(150)] * 2, "doc_id long, quality int, toxic int")
    models = []
    for parts in (1, 5):
        df = frame(spark, rows).repartition(parts)
        models.append((gam.train(df, labels, max_train=60), cnn.train(df, labels, max_train=60, max_bytes=3000)))
    assert all((a == b).all() for a, b in zip(models[0][0].tables, models[1][0].tables)) and models[0][0].intercept == models[1][0].intercept
    assert (models[0][1].word == models[1][1].word).all() and (models[0][1].centre == models[1][1].centre).all()


def test_convolution_equals_a_plain_one():
    rng = np.random.default_rng(23)
    model = cnn.Cnn()
    model.shift = rng.normal(size=len(model.shift)).astype(np.float32)
    texts = [[f"w{rng.integers(50)}".encode() for _ in range(n)] for n in (0, 1, 2, 0, 3, 40)]
    got = cnn.Scorer(model).logits(texts)
    for t, z in zip(texts, got):
        v = [model.word[a] + model.stem[b] for a, b in map(cnn.hashed, t)] + [np.zeros(model.dim)] * cnn.PAD
        pooled = [max(sum(v[i + k] @ model.taps[w][k][:, f] for k in range(w)) for i in range(max(1, len(t)))) for w in cnn.WIDTHS for f in range(model.filters)]
        assert abs(np.maximum(np.array(pooled) + model.shift, 0) @ model.out + model.bias - z) < 1e-4


def test_scores_equal_added_tables():
    rng = np.random.default_rng(27)
    x = rng.normal(size=(400, 3))
    model = gam.Gam(pairs=2).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, s in zip(x[:50], model.score(x[:50])):
        z = model.intercept + sum(t[sum(c <= v for c in e)] for e, t, v in zip(model.edges, model.tables, row))
        z += sum(t[sum(c <= row[i] for c in model.pair_edges[i]), sum(c <= row[j] for c in model.pair_edges[j])] for i, j, t in model.pairs)
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-9


def test_gam_learns_interactions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.Gam(pairs=2).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert model.score(np.zeros((0, 4))).shape == (0,)
    one = gam.Gam().fit(x[:50], np.ones(50))
    assert (one.score(x[:5]) > 0.9).all()
    assert (gam.Gam().fit(x[:0], y[:0]).score(x[:2]) == 0.5).all()


def test_quality_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, "e") for i in range(20)] + [(1, None, "e"), (None, 1, "e"), (2, 1, "e")], "doc_id long, quality int, text string")
    model = gam.train(docs, labels)
    scored = gam.score(docs, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scored)
    assert gam.score(none, gam.train(none, labels)).count() == 0
    assert gam.score(docs, gam.train(docs, labels.filter("false")), keep=["doc_id"]).first()["score"] == 0.5


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.join(docs.select("doc_id", "text"), "doc_id")
    if kind == "quality":
        scored, held = gam.score(known, gam.train(docs, labels), 0.3), gam.fold_of(F.col("doc_id"), 5) == 0
    else:
        scored, held = cnn.score(known, cnn.train(docs, labels), 0.7), gam.fold_of(F.col("doc_id"), 3) == 1
    rows = scored.filter(held).select(kind, "predicted").collect()
    right = [r[0] == r[1] for r in rows]
    positive = [r[1] for r in rows if r[0] == 1]
    assert sum(right) / len(right) > 0.95
    assert sum(positive) / len(positive) > 0.8


# --- 6: HTML ------------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>t {n}</title><script>var a='<p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><h1>Head {n}</h1><p>One &amp; <b>two</b>\n three {n}<p>Same passage<br>here</article><div id=comments><p>Nice!</p></div><footer>foot {n}</footer></body></html>"
)
PLAIN_PAGE = "<body><div class=menu>m</div><div>Fixed banner line</div><div><p>Text {n} a</p><p>Text {n} b</p></div><form>f</form></body>"


def test_html_text(spark):
    rows = [(n, f"http://h.com/{n}", PAGE.format(n=n), "c") for n in range(6)] + [(100 + n, f"http://p.com/{n}", PLAIN_PAGE.format(n=n), "c") for n in range(6)]
    rows += [(200, "http://x.com/", None, "c"), (201, None, "", "c"), (202, "http://[bad", "plain text", "c"), (0, "http://h.com/0", PAGE.format(n=0), "c"), (203, "", "<p>open <i>end", "c")]
    got = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Head 3\n\nOne & two three 3\n\nSame passage here" and by[3]["n_chars"] == len(by[3]["text"])
    assert by[103]["text"] == "Text 3 a\n\nText 3 b"  # the banner is in every page's template
    assert (by[200]["text"], by[201]["text"], by[202]["text"], by[203]["text"]) == ("", "", "plain text", "open end")
    assert by[3]["n_template"] > 5
    assert template_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article>{}</article></body>",
        "<body class='home sidebar'><div id=page class='with-comments'><article class='post share-enabled'>{}</article></div>",
        "<form id=aspnetForm><article>{}</article></form>",
        "<div class=ad>buy<article>{}</article>",
        "<p>intro</p><aside class=sidebar><p>unclosed<article>{}</article>",
        "<div class=comments><main>{}</main></div>",
        "<article>{}<div id=comments><article>Nice!</article></div><aside><article>teaser</article></aside></article>",
        "<article>{}</article><article class=comment id=comment-12>Nice!</article>",
        "<nav class=main>menu</nav><article>{}</article>",
        "<div>{}</div><div id=comments><article class=comment>Nice!</article></div><div class=cookie-notice>c</div><div class=site-footer>f</div>",
    ],
)
def test_html_articles_survive_what_encloses_them(page):
    inner = "<header class=header><h1>Title</h1></header><section id=discussion><h2 id=header-files>Files</h2></section><div class=related-work>Work</div>"
    if "<article>{}" not in page and "<main>" not in page and "share-enabled" not in page:
        inner = "<h1>Title</h1><section id=discussion><h2 id=header-files>Files</h2></section><div class=related-work>Work</div>"
    assert template_html.template_text(page.format(inner), set()) == "Title\n\nFiles\n\nWork"


def test_html_copies_are_no_template(spark):
    page = lambda *texts: "<body><div class=menu>m</div><div>Fixed banner line</div><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div></body>"
    rng = random.Random(11)
    long = lambda: " ".join(rng.choice("abcdef") * 3 for _ in range(30))
    shared = [long() for _ in range(8)]
    hosts = {
        "two": [page("Copied a", "Copied b")] * 2,
        "four": [page("Copied a", "Copied b")] * 2 + [page(f"Own {n}", f"More {n}") for n in range(2)],
        "half": [page(*shared)] * 20 + [page(long(), long()) for _ in range(20)],
        "near": [page(*shared, f"edited {n}") for n in range(20)] + [page(long(), long()) for _ in range(20)],
        "links": [page(*(f"<a href=/{n}>Reference {n} {k}</a>" for k in range(5))) for n in range(6)],
    }
    rows = [(1000 * k + n, f"http://{h}.com/{n}", x) for k, (h, pages) in enumerate(hosts.items()) for n, x in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Copied a\n\nCopied b" in got[i] for i in (0, 1, 1000, 1001)) and "Own 1\n\nMore 1" in got[1003]
    assert all("\n\n".join(shared) in got[i] for i in (*range(2000, 2020), *range(3000, 3020)))
    assert "banner" not in got[2039] + got[3039]  # on distinct pages it is the template's
    assert got[4003] == "\n\n".join(f"Reference 3 {k}" for k in range(5))


# --- 7: SentencePiece ------------------------------------------------------------------------------------


def test_sentencepiece(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sp_agenda.encode_decode(docs, PIECES).collect()
    want = sorted(np.array(sp.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes() for _, t in AWKWARD)
    assert sorted(bytes(r["ids"]) for r in got) == want
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sp_agenda.encode_decode(none, PIECES).count() == 0


def test_agenda_heap_and_rows_agree():
    agenda = sp_agenda.Agenda(PIECES)
    rng = random.Random(7)
    runs = ["▁" + "".join(rng.choice("abcdeinrst▁é日.\n") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    assert agenda.together(runs, 64) == [agenda.one(r) for r in runs]


# --- 8: n-gram Jaccard join --------------------------------------------------------------------------------


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i)
    return sorted((i, min(classes[find(k)]), links[k]) for k, (i, _) in enumerate(rows))


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(bayes_lsh, "CHUNK_NODES", 16)  # large buckets are dealt in several chunks
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(160):
        own = list(base[0] if i < 60 else base[i % 12])
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "new" + str(rng.randrange(1000))
        rows.append((100 + i, " ".join(own)))
    rows += [(i, t) for i, t in AWKWARD if i is not None and i != 8]
    got = bayes_lsh.similar_documents(frame(spark, [*rows, (None, "no id")]))
    found = sorted(tuple(r) for r in got.filter("doc_id is not null").collect())
    assert found == brute_links(rows)
    assert [tuple(r) for r in got.filter("doc_id is null").collect()] == [(None, None, 0)]


def test_jaccard_join_of_empty_table(none):
    assert bayes_lsh.similar_documents(none).count() == 0


def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, -1)], "k long, v long").cache()
    weights = {r["k"]: r["count"] for r in left.groupBy("k").count().collect() if r["k"] is not None}
    right = spark.createDataFrame([(k, n, f"r{k}") for k, n in weights.items() if k != 5] + [(99, 10**6, "none")], "k long, n long, r string")
    want = sorted((k, v, f"r{k}") for k, v in left.collect() if k is not None and k != 5)
    for least, most in ((1, 2), (50, 100), (10**9, 1)):
        got = common.hot_join(left, right, "k", "n", least, most)
        assert sorted((r["k"], r["v"], r["r"]) for r in got.collect()) == want


def test_bayesian_bounds_and_components(spark):
    least = bayes_lsh.least_matches(0.8, 1e-6)
    assert len(least) == 6 and least == sorted(least) and least[0] < 0.8 * 16
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (200, 50), (50, 200)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and got[200] == 50


# --- 9: toxicity ----------------------------------------------------------------------------------------------


def test_toxicity_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = cnn.train(docs, labels)
    scored = cnn.score(docs, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scored)
    empty = cnn.train(none, labels)
    assert empty.constant is not None and cnn.score(none, empty).count() == 0
    assert cnn.language(b"the cat of and".split()) == 0 and cnn.language([]) == len(cnn.FUNCTION_WORDS)


def test_toxicity_learns_from_every_label(spark):
    rng = random.Random(31)
    y = {i: int(i % 5 < 2) for i in range(10_000)}
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    # "zap" is toxic only in rows that a sample of 5,000 leaves out, and in those held out.
    sample = {r["__id"] for r in gam.bounded_labels(labels, "toxic", 3, 1, 5000, positives=1 / 3).collect()}
    held = {i for i in y if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = []
    for i in y:
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 9))]
        rows.append((i, " ".join([*w, "bad" if i in sample else "zap"] if y[i] else w)))
    df = frame(spark, rows)
    got = {r["doc_id"]: r["predicted"] for r in cnn.score(df, cnn.train(df, labels)).collect()}
    assert sum(got[i] == y[i] for i in held) > 0.99 * len(held)


def test_toxicity_shards_are_fixed_and_whole(spark, monkeypatch):
    rng = random.Random(33)
    rows = [(i, " ".join([f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 30))] + ["bad"] * (i % 4 == 0))) for i in range(600)]
    rows += [rows[0]] * 50 + [(i, None) for i in range(600, 610)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(610)], "doc_id long, toxic int")
    seen, calibrate = [], cnn.Cnn.calibrate
    monkeypatch.setattr(cnn.Cnn, "calibrate", lambda self, z, lang, y, clean, n: (seen.append((n[y > 0].sum(), n.sum())), calibrate(self, z, lang, y, clean, n)))
    monkeypatch.setattr(cnn, "TOXIC_BYTES", 4000)
    models = [cnn.train(frame(spark, rows).repartition(p), labels, shard_bytes=8000) for p in (1, 5)]
    assert all((getattr(models[0], k) == getattr(models[1], k)).all() for k in ("word", "stem", "out", "shift", "centre", "scale"))
    # Of each row that is not held out (equal ones once) a hash decides; copies in several shards count once.
    own = frame(spark, rows).filter(gam.fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.xxhash64("doc_id", "text").alias("k")).distinct().collect()
    kept = [r["doc_id"] % 4 == 0 for r in own if (r["k"] >> 60) % 4 == 1]
    assert seen == [(sum(kept), len(kept))] * 2
    scored = cnn.score(frame(spark, rows), models[0]).filter("text is not null").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in scored) > 0.98 * len(scored)
    blank = cnn.train(frame(spark, [(i, None) for i in range(9)]), labels, shard_bytes=1)
    assert blank.constant is None and np.isfinite(blank.centre).all()


def test_strongest_windows_across_slices(monkeypatch):
    rng = np.random.default_rng(35)
    model = cnn.Cnn()
    texts = [[f"w{rng.integers(50)}".encode() for _ in range(n)] for n in (3, 0, 1, 40, 2, 0, 17)]
    rows = [np.array([cnn.hashed(w) for w in t], np.uint16).reshape(-1, 2) for t in texts]
    flat = cnn._flat([(r[:, 0], r[:, 1]) for r in rows])
    want = model.strongest(*flat)
    for size in (1, 7, 16):
        monkeypatch.setattr(cnn, "SLICE", size)
        top, where = model.strongest(*flat)
        assert np.allclose(top, want[0], atol=1e-6) and (where == want[1]).all()
    assert np.allclose(model.logits(top), cnn.Scorer(model).logits(texts), atol=1e-4)


def test_cnn_finds_a_word_pair():
    rng = random.Random(9)
    texts, y = [], []
    for i in range(400):
        w = [rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(5, 40))]
        if i % 2:
            k = rng.randrange(len(w))
            w[k : k + 1] = ["bad", "thing"]
        texts.append([x.encode() for x in w])
        y.append(i % 2)
    rows = [np.array([cnn.hashed(w) for w in t]) for t in texts]
    model = cnn.Cnn()
    model.fit([(r[:, 0], r[:, 1]) for r in rows[:300]], np.array(y[:300], float), steps=200)
    z = cnn.Scorer(model).logits(texts)
    model.calibrate(z[:300], np.zeros(300, int), np.array(y[:300]))
    p = model.probability(z[300:], np.zeros(100, int))
    assert ((p >= 0.7) == np.array(y[300:])).mean() > 0.95


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "t", "x") for i, u, h in rows], "page_id long, url string, html string, n_chars int, template string, host string").repartition(3)


def lorem(rng, n):
    return " ".join(rng.choice(("stone", "river", "cloud", "green", "seven", "paper", "night", "ocean")) + str(rng.randrange(1000)) for _ in range(n))


def test_template_decides_the_main_slot(spark):
    rng = random.Random(41)
    body, side = {}, {}
    rows = []
    for i in range(12):  # no article, no telling class names
        body[i], side[i] = [lorem(rng, 40), lorem(rng, 30)], lorem(rng, 9)
        html = f"<body><div class=q1><span>{side[i]}</span></div><div class=q2><h1>T{i}</h1><p>{body[i][0]}</p><p>{body[i][1]}</p></div></body>"
        rows.append((i, f"http://a.com/{i}", html))
    for i in range(12, 24):  # the only article is a teaser beside the main text
        body[i] = [lorem(rng, 50)]
        rows.append((i, f"http://b.com/{i}", f"<body><div id=x><div id=y><p>{body[i][0]}</p></div></div><div class=z><article>{lorem(rng, 4)}</article></div></body>"))
    got = {r["page_id"]: r["text"] for r in template_html.extract(pages_frame(spark, rows)).collect()}
    for i in range(24):
        assert got[i] == "\n\n".join(([f"T{i}"] if i < 12 else []) + body[i])
    html = rows[0][2]  # without its template the page keeps all
    assert template_html.template_text(html, set()) == "\n\n".join([side[0], "T0", *body[0]])


def test_long_banners_are_boilerplate_and_hosts_are_parsed_once(spark):
    rng = random.Random(43)
    banner = "Offer of the day. " * 300  # 5,400 characters on every page
    hosts = ("http://c.com", "//d.com", "http://[::1]:80", "HTTPS://User:pw@E.com:8080")
    rows = [(i, f"{h}/{i}", f"<div>{banner}</div><p>{lorem(rng, 20)}</p>") for n, h in enumerate(hosts) for i in range(10 * n, 10 * n + 8)]
    rows += [(100, None, None), (100, None, None), (101, "", "<p>x"), (102, "http://c.com/long", "<p>" + "a &amp; b " * 60_000)]
    got = [(r["page_id"], r["url"], r["text"], r["n_template"]) for r in template_html.extract(pages_frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    for i, _, text, n in got:
        if i < 100:
            assert "Offer" not in text and text and n > 0
    assert [t for i, _, t, _ in got if i == 100] == ["", ""]
    assert next(t for i, _, t, _ in got if i == 102) == ("a & b " * 60_000).strip()
    assert template_html.extract(pages_frame(spark, [])).count() == 0


def test_classes_that_a_page_contradicts_are_invalid():
    assert template_html.in_order(list("abcabc"), 3) == template_html.in_order(list("abc"), 3) >= 0
    assert template_html.in_order(list("abcacb"), 3) == template_html.in_order(list("abca"), 3) == template_html.in_order(list("aab"), 3) == -1
    tags = {"/html": 100, "/html/body": 100, "/html/body/div[a]": 20, "/html/body/div[b]": 80, "/html/body/div[b]/p": 30, "/html/body/div[b]/h1": 5, "/html/body/div[b]/div": 45}
    assert template_html.main_slot(tags, 100) == "/html/body/div[b]"
    assert template_html.main_slot({**tags, "/html/body/div[b]/div": 60}, 100, "/html/body/div[b]/h1") == "/html/body/div[b]"
    assert template_html.main_slot({"/html": 5, "/html/body": 5}, 5) == template_html.main_slot({}, 0) == ""
    assert template_html.cut_of("/a/b[x/y]") == 2


# --- 10: sharding ------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    rng = random.Random(10)
    rows = [(i, "hot" * 30 if i % 3 == 0 else "x" * rng.randrange(0, 900)) for i in range(3000)] + AWKWARD
    got = histogram_sort.shard(frame(spark, rows), shards=8, part_bytes=1 << 16).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        shards.setdefault(r["shard"], []).append(r)
    total = [sum(r["size"] for r in s) for s in shards.values()]
    assert sorted(shards) == list(range(8)) and all(abs(x - sum(total) / 8) <= len(LONG) for x in total)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        assert [r["sort_key"] for r in sorted(s, key=lambda r: r["slot"])] == sorted(r["sort_key"] for r in s)
    order = sorted(shards)
    assert all(max(r["sort_key"] for r in shards[a]) <= min(r["sort_key"] for r in shards[b]) for a, b in zip(order, order[1:], strict=False))
    again = histogram_sort.shard(frame(spark, rows).repartition(7), shards=8, part_bytes=1 << 16)
    place = lambda x: sorted((r["doc_id"] or -1, r["text"] or "", r["shard"]) for r in x)
    assert place(again.collect()) == place(got)
    assert histogram_sort.shard(none).count() == 0 and histogram_sort.shard(docs, shards=1).count() == len(AWKWARD)


def test_splitters_meet_the_tolerance(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("sort_key"), (F.col("id") % 50 + 1).alias("size"))
    total = keys.agg(F.sum("size")).first()[0]
    found = histogram_sort.find_splitters(keys, 16, 1, total, 20_000, 0.005)
    below, _ = histogram_sort.counts_below(keys, found.keys)
    assert all(abs(b - total * (i + 1) / 16) <= 0.005 * total / 16 + 1 for i, b in enumerate(below))
    assert found.rounds <= 6
