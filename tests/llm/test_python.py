"""The other operators against brute force and round trips."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import components, decontaminate, jaccard, langid, mixing, tokens

DOC = "doc_id long, text string, lang string, component_id string"


def words(rng, n):
    return [rng.choice(["ka", "lo", "mi", "tu", "re"]) + rng.choice(["x", "yo", "zu"]) + str(rng.randrange(30)) for _ in range(n)]


def corpus(rng, n=60):
    texts = [" ".join(words(rng, rng.randrange(5, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    shared = " ".join(words(rng, 40))
    texts += [f"{' '.join(words(rng, 30))} {shared} {' '.join(words(rng, 30))}" for _ in range(8)]
    return [*texts, *texts[:5], None, "", "  \n", "one two", "ONE\ttwo", "one", "x " * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], DOC).repartition(3)


def brute_classes(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "num", "block"), [(4, 85, 4_000_000), (5, 80, 4_000_000), (4, 85, 150)])
def test_jaccard_classes(spark, k, num, block):
    texts = corpus(random.Random(k))
    n, least = brute_classes(texts, k, num, 100)
    got = {r["doc_id"]: r for r in jaccard.similarity_classes(frame(spark, texts), k, num, 100, block_hashes=block).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == least


def test_jaccard_edges(spark):
    none = frame(spark, ["a b c d e"]).withColumn("doc_id", F.lit(None).cast("long"))
    r = jaccard.similarity_classes(none).collect()
    assert len(r) == 1 and r[0]["component_id"] is None
    assert jaccard.similarity_classes(none.limit(0)).count() == 0
    kept = jaccard.keep_one(frame(spark, ["a b c d e f", "a b c d e f", "other words here now and then", None]).unionByName(none))
    assert sorted((x["doc_id"] is None, x["doc_id"]) for x in kept.collect()) == [(False, 0), (False, 2), (False, 3), (True, None)]


def test_levels_spare_every_shared_hash(spark):
    """A hash that two different sets hold is never left out as if one held it; copies of a set count once."""
    texts = corpus(random.Random(11))
    sets = jaccard.shingle_sets([(t or "").encode() for t in texts], 4)
    held = frame(spark, texts).select("doc_id", "text").withColumn("mark", F.lit(0).cast("long"))
    owners = defaultdict(set)
    for s in sets:
        for h in s[s < np.uint64(jaccard.LOW)].tolist():
            owners[h].add(s.tobytes())
    for bits, size in ((18, 0), (8, 0), (18, 24 * jaccard.PIECE * 900)):
        levels = jaccard.level_map(held, 4, bits, size)
        h = np.asarray(list(owners), np.uint64)
        got, many = levels[jaccard._slot(h, len(levels))], np.asarray([len(o) for o in owners.values()])
        assert (got[many > 1] >= many[many > 1] - 1).all() and (many > 1).any()
        if bits == 18:
            assert (got[many == 1] == 0).mean() > 0.9


def test_jaccard_with_a_very_common_hash(spark):
    rng = random.Random(12)
    texts = [f"thank you very much indeed {w}" for w in words(rng, 80)] + [f"{w} thank you very much indeed my dear friends and all of you {w}" for w in words(rng, 40)]
    texts += ["thank you very much indeed my dear friends and all of you too"] * 3
    n, least = brute_classes(texts, 4, 60, 100)
    got = {r["doc_id"]: r for r in jaccard.similarity_classes(frame(spark, texts), 4, 60, 100).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == least and len(set(least)) < len(texts) - 2


def test_keep_one_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "other words here now and then", "x", 2), (1, "a b c d e f", "x", 3), (2, "A b c d e f", "y", 4), (3, None, "z", 5), (3, None, "z", 6), (None, None, "z", 7), (None, None, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark string, _doc_id int")
    got = jaccard.keep_one(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"]), key=str) == sorted([(1, "a b c d e f"), (1, "other words here now and then"), (3, None)], key=str) and sum(r["doc_id"] is None for r in got) == 2
    assert got[0].asDict().keys() == set(df.columns) and sorted(map(str, jaccard.keep_one(df.repartition(5)).collect())) == sorted(map(str, got))


def test_prefix_tree_agrees_with_sets():
    rng = np.random.Generator(np.random.PCG64(5))
    t = jaccard.Threshold(80, 100)
    base = [np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(6)]
    sets = sorted((np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for b in base for _ in range(5)), key=len)
    roots = jaccard.link_family(sets, t)
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    same = lambda x: {(i, j) for i in range(len(x)) for j in range(len(x)) if x[i] == x[j]}
    assert same(roots) == same(parent)


def test_sets_that_only_share_common_hashes_are_not_walked(monkeypatch):
    """Near copies just below the threshold, and sets with one common passage, meet few trees; the classes are those of all pairs."""
    rng = np.random.Generator(np.random.PCG64(6))
    t, walked, finds = jaccard.Threshold(85, 100), [], jaccard.PrefixTree.finds
    monkeypatch.setattr(jaccard.PrefixTree, "finds", lambda *a: (walked.append(1), finds(*a))[1])
    fresh = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    base, passage = fresh(100), fresh(20)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.12], fresh(4)])) for _ in range(150)] + [np.unique(np.concatenate([fresh(80), passage])) for _ in range(150)]
    sets += [np.unique(np.append(sets[0], fresh(2))), np.unique(np.append(sets[200], fresh(3)))]
    order = {h: -n for h, n in zip(*np.unique(np.concatenate(sets), return_counts=True), strict=True)}
    sets = sorted((np.asarray(sorted(s.tolist(), key=lambda h: (order[h], h)), np.uint64) for s in sets), key=len)
    roots, own = jaccard.link_family(sets, t), list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = own[i], own[j]
                own = [a if x == b else x for x in own]
    assert {frozenset(i for i, x in enumerate(roots) if x == r) for r in roots} == {frozenset(i for i, x in enumerate(own) if x == r) for r in own}
    assert 2 <= len(sets) - len(set(roots)) and len(walked) < 600  # of some 22,000 pairs


def test_components_end_without_a_round_that_only_confirms(spark, monkeypatch):
    """Stars that one task contracts are written once as edges and once as the result; a long path takes few rounds."""
    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    stars = spark.createDataFrame([(i, i - i % 4) for i in range(400)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(stars).collect()} == {i: i - i % 4 for i in range(400)}
    assert written == ["edges", "components"]
    written.clear()
    path = spark.createDataFrame([(i * 7919 % 5000, (i + 1) * 7919 % 5000) for i in range(4999)], "a long, b long").repartition(40)
    assert {r["component"] for r in components.components(path).collect()} == {0} and written.count("edges") <= 6


def test_components_cut_into_chunks(spark, monkeypatch):
    """A task that holds more edges than it contracts at once still joins what meets at a node."""
    monkeypatch.setattr(components, "EDGES", 5)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        edges = spark.createDataFrame([(100, i) for i in range(30)] + [(200, 100), (300, 301), (301, 302)], "a long, b long").coalesce(1)
        got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == {**dict.fromkeys([*range(30), 100, 200], 0), **dict.fromkeys([300, 301, 302], 300)}


def test_components_of_hubs(spark):
    """A hub of several thousand edges, one with every id repeated, and a chain between two hubs."""
    edges = [(5000, i) for i in range(3000)] + [(i, 9000) for i in range(9001, 11000)] * 2 + [(10999, 12000), (12000, 20000)] + [(20000, i) for i in range(20001, 20500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in (*range(3000), 5000)}, **{i: 9000 for i in (*range(9000, 11000), 12000, *range(20000, 20500))}}


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(e).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


TEXTS = [None, "", " ", "Hello, world!", "a  b", "tab\tb", "line\nnext line.", "it's <|endoftext|> x", "café ÉTÉ 123 １２", "word " * 9000, "trail ", "\n\nx", "same", "same"]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_packing_round_trip(spark, name, keeps):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rows = tokens.pack(frame(spark, TEXTS), public_tokenizers.path(name), keeps).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in enumerate(TEXTS):
        whole = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in sorted(by[i], key=lambda r: r["start"]) for x in r["ids"]] == whole and {r["doc_tokens"] for r in by[i]} == {len(whole)}
    assert tokens.pack(frame(spark, TEXTS).limit(0), public_tokenizers.path(name), keeps).count() == 0


def test_orc_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(tokens.orc_round_trip(frame(spark, TEXTS), path).collect())
    start = 0
    for r, (i, text) in zip(got, enumerate(TEXTS), strict=True):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    tokens.write_orc(frame(spark, TEXTS), str(tmp_path / "o"), path)
    import pyarrow.orc as po

    files = [f for f in sorted((tmp_path / "o").glob("*.orc"))]
    ids = [i for f in files for i in po.read_table(f, columns=["doc_id"]).column("doc_id").to_pylist()]
    assert ids == list(range(len(TEXTS)))
    assert tokens.read_orc(spark, str(tmp_path / "o")).filter("doc_id = 3").count() == 1


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_encoded_once(monkeypatch, name, keeps):
    """A known word with marks behind it isn't encoded again, nor, once the memo overflows, is a word that was met again."""
    enc, asked = tokens.Encoder(public_tokenizers.path(name), keeps), []
    monkeypatch.setattr(tokens, "MEMO", 150)
    fresh = enc._fresh
    monkeypatch.setattr(enc, "_fresh", lambda texts: (asked.extend(w for t in texts for w in t.split()), fresh(texts))[1])
    common = [f"{a}{b}{c}" for a in "kp" for b in ("ora", "uri", "él") for c in ("n", "st", "x")]
    once = iter([f"{a}{b}{c}" for a in "bdfg" for b in ("ilo", "ane", "oku") for c in (f"{x}{y}" for x in "rstv" for y in ("on", "im", "ul", "ek"))])
    for turn in range(16):
        words = common + [w + "!" * (turn + 1) for w in common if turn] + [next(once) for _ in range(12)] + ["3.5", "it's,", f"x{turn}"]
        texts = [" ".join(words[i::3]).encode() for i in range(3)] + [b"", b"two  gaps "]
        assert enc.encode(texts) == [np.asarray(enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    again = Counter(asked)
    assert enc.known < 300 and max(again[w] for w in common) <= 2  # at a text's start and after a space


def test_language(spark):
    rng = random.Random(3)
    make = {"xx": ["kala", "mono", "tiri"], "yy": ["strum", "blund", "grent"]}
    rows = []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(rng.choice(make[lang]) + rng.choice("ae") * rng.randrange(3) for _ in range(30)), lang, ""))
    rows += [(200, None, "xx", ""), (201, "12 !!", None, ""), (202, "kalaeea monoaa", None, ""), (203, "", "yy", "")]
    df = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [r for i, r in got.items() if i < 120 and r["held_out"]]
    assert held and all(r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in held)
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "xx", "und"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_context_mixing(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice(["", "ing", "ed"]) for _ in range(60)) for _ in range(80)] + [None, "", "Alpha ALPHA unseen-word unseen-word other"]
    toks = [[*(t or "").encode().lower().split(), b""] for t in texts]
    train = Counter(w for i, ws in enumerate(toks) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for hot in (3, 1000):
        got = {r["doc_id"]: r for r in mixing.score_documents(frame(spark, texts), hot_words=hot).collect()}
        assert len(got) == len(texts)
        for i, ws in enumerate(toks):
            r = got[i]
            base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(train[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0 and r["bits_per_byte"] > 0 and r["n_bytes"] == sum(map(len, ws)) + len(ws)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 80]
    assert sum(r["score"] for r in held) > 1.15 * sum(r["base_score"] for r in held)


def test_context_mixing_edges(spark):
    assert mixing.score_documents(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b", None, ""), (None, None, None, ""), (7, "x", None, ""), (7, "x y", None, ""), (7, "x y", None, ""), (8, "z " * 40_000, None, "")]
    got = sorted(map(tuple, mixing.score_documents(spark.createDataFrame(rows, DOC).withColumn("part", F.lit(1)).withColumn("home", F.lit("x"))).select("doc_id", "n_tokens", "held_out").collect()), key=str)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    assert got == sorted([(i, len((t or "").split()) + 1, held(i)) for i, t, *_ in rows], key=str)
    assert next(i for i in range(99) if held(i)) is not None
    none = spark.createDataFrame([(i, "only held out", None, "") for i in range(99) if held(i)], DOC)
    assert {(r["n_known"], r["train_tokens"]) for r in mixing.score_documents(none).collect()} == {(0, 0)}


def chained(rng, n):
    """Texts in which each word depends on the one before, and now and then a word of syllables comes."""
    common = [f"w{i}" for i in range(40)]
    after = {w: rng.sample(common, 3) for w in common}
    syllables = ["ba", "na", "ti", "kor", "elu", "gi", "sh"]
    texts = []
    for _ in range(n):
        w, out = rng.choice(common), []
        for _ in range(80):
            w = rng.choice(after[w])
            out.append("".join(rng.choices(syllables, k=5)) if rng.random() < 0.05 else w)
        texts.append(" ".join(out).encode())
    return texts


def small_model(texts):
    hashes = [mixing.words(mixing.joined([t])[0])[2] for t in texts]
    h, c = np.unique(np.concatenate(hashes), return_counts=True)
    often = c > 2
    return mixing.Model(mixing.Code.of(h[often], c[often], len(texts), int(c.sum()) + len(texts), len(h) + 1), 18)


def test_the_mixer_brings_the_gain():
    """Held-out bits with contexts of words before, against the same code without, and with a mixer that hasn't learned."""
    texts = chained(random.Random(2), 400)
    train, probe = texts[:320], texts[320:]
    with np.errstate(over="ignore"):
        m = small_model(train)
        for i in range(0, 320, 8):
            m.learn(train[i : i + 8])
        frozen = mixing.Frozen.of(m)
        bits = lambda f, t: -f.score(t)[1].sum()
        full = bits(frozen, probe)
        fresh = frozen._replace(tree_mixer=mixing.Mixer.start(mixing.TREE_GATES, mixing.TREE + 1), spell_mixer=mixing.Mixer.start(mixing.SPELL_GATES, mixing.SPELL))
        blind = bits(mixing.Frozen.of(small_model(train)), probe)
        assert full < 0.7 * blind and full < bits(fresh, probe)
        shuffled = [b" ".join(random.Random(1).sample(t.split(), len(t.split()))) for t in probe]
        assert bits(frozen, shuffled) > 1.3 * full  # order counts


def test_every_decision_is_mixed_and_learned(monkeypatch):
    """The tree's decisions are each token's whole path with the counts so far in its text, and the mixers take a step at each."""
    texts = chained(random.Random(3), 30) + 3 * [" ".join(f"v{i}" for i in range(900)).encode()]
    m, steps = small_model(texts), Counter()
    text = mixing.Text(texts, m.code)
    got, want = {}, {}
    for depth, (at, _, bit, zeros, ones) in enumerate(text.decisions()):
        own = [*zip(zeros.tolist(), ones.tolist(), strict=True), *[(0, 0)] * (len(at) - len(ones))]
        got |= {(t, depth): (b, *n) for t, b, n in zip(at.tolist(), bit.tolist(), own, strict=True)}
    seen = Counter()
    for t, (doc, path, n) in enumerate(zip(text.doc.tolist(), text.path.tolist(), text.length.tolist(), strict=True)):
        for depth in range(n):
            node, b = (doc, depth, path >> (64 - depth)), path >> (63 - depth) & 1
            want[t, depth] = (b, seen[node, 0], seen[node, 1])
            seen[node, b] += 1
    assert got == want and max(text.length) > 8
    learn = mixing.Mixer.learn
    monkeypatch.setattr(mixing.Mixer, "learn", lambda self, x, gate, bit, **k: (steps.update({self.weights.shape[1]: len(bit)}), learn(self, x, gate, bit, **k))[1])
    with np.errstate(over="ignore"):
        m.learn(texts)
    at, again, _, _ = text.rare()
    assert steps == {mixing.TREE_GATES: int(text.length.sum()), mixing.SPELL_GATES: 8 * int((text.size[at[~again]] + 1).sum())}


def test_mixed_probabilities_sum_to_one():
    texts = chained(random.Random(5), 60)
    with np.errstate(over="ignore"):
        m = small_model(texts)
        m.learn(texts)
        frozen = mixing.Frozen.of(m)
        vocabulary = sorted({w for t in texts for w in t.split()})
        start = b"w1 w2 xyz w2"
        last = lambda t, k: 2.0 ** frozen.score([t])[1][k]
        total = last(start, -1) + sum(last(start + b" " + w, -2) for w in vocabulary) + last(start + b" xyz", -2)
        assert 0.9 < total <= 1 + 1e-6
        text, logs = frozen.score([bytes([c]) for c in range(256) if not 65 <= c <= 90 and not chr(c).isspace()])
        escape = last(b"qqq", 0)
        assert escape < 1 and 0 < sum(2.0 ** logs[::2][text.symbol[::2] == mixing.ESCAPE]) <= 1


def edits(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    items = [" ".join(words(rng, 25)) for _ in range(6)]
    clean = [" ".join(words(rng, 80)) for _ in range(12)]
    def edited(t, k):
        t = list(t)
        for _ in range(k):
            t[rng.randrange(len(t))] = "q"
        return "".join(t)
    texts = [*clean, *(f"{clean[i]} {edited(items[i % 6], i)}\n{clean[-1]}" for i in range(6)), None, "", items[0].upper().replace(" ", " ** "), "z" * 50_000]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "tiny")], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, texts), bench).collect()
    s = decontaminate.Settings()
    want = set()
    for d, t in enumerate(texts):
        folded = bytes(decontaminate.fold((t or "").encode())[0])
        for i, item in enumerate(items):
            x = bytes(decontaminate.fold(item.encode())[0]).strip()
            starts = {*range(0, len(x) - s.window + 1, s.window // 2), len(x) - s.window}
            if any(edits(x[a : a + s.window], folded) <= int(s.rate * s.window) for a in starts if len(folded) < 5000):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and {d for d, _ in want} >= {12, 13, 14, 15, 16, 17, 20}
    left = decontaminate.clean(frame(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want} and left.columns == ["doc_id", "text", "lang", "component_id"]
    small = decontaminate.contaminated(frame(spark, texts), bench, settings=s._replace(block_bytes=300))
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == want
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_short_items(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "x"), (3, "?!"), (4, "Été 1990"), (5, "who wrote it"), (6, "a part of the whole")], "item_id long, text string")
    texts = ["So: WHO  wrote\nit, and who wrote it?", "who wrote its", "X", "un \u00e9t\u00e9-1990 l\u00e0", "a part of the whol", None, "", "  !"]
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(0, 1, 4, 35, 0), (0, 5, 4, 35, 0), (2, 2, 0, 1, 0), (3, 4, 3, 13, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, texts), bench).collect()} == {1, 4, 5, 6, 7}
    assert decontaminate.Index([(i, t.encode()) for i, t in enumerate(["x", "?!", "y " * 60])], decontaminate.Settings()).n_short == 1


def test_alignment_matches_the_full_table():
    rng = random.Random(8)
    for _ in range(40):
        a = bytes(rng.choice(b"abc") for _ in range(30))
        b = bytes(rng.choice(b"abc") for _ in range(60))
        if rng.random() < 0.7:
            at = rng.randrange(20)
            b = b[:at] + a[:14] + b"x" + a[15:] + b[at:]
        got = decontaminate.aligned(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), 6)
        best = edits(a, b)
        assert all(decontaminate.within(a, b, limit) == (best <= limit) for limit in (0, 3, 6, 9, 30))
        assert (got[0] if got else None) == (best if best <= 6 else None)
        if got:
            assert edits(a, b[got[1] : got[2]]) == best


def test_orc_files_hold_indexes_and_bloom_filters(spark, tmp_path):
    """Stripe footers: run-length ids, row indexes, Bloom filters of doc_id; a filter on it is pushed to the scan."""
    path = str(tmp_path / "o")
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    tokens.write_orc(df, path, public_tokenizers.path("byte_bpe_50k.json"), row_index_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in (tmp_path / "o").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
        assert ("BLOOM_FILTER_UTF8", 1) in streams and {("ROW_INDEX", c) for c in (1, 2, 3)} <= streams
        assert footer.getColumns(1).getKind().toString() == footer.getColumns(3).getKind().toString() == "DIRECT_V2"
    read = spark.read.schema(tokens.ORC_SCHEMA).orc(path).filter("doc_id = 4321")
    assert "EqualTo(doc_id,4321)" in read._jdf.queryExecution().toString() and read.count() == 1


def test_buckets_hold_one_length_each(spark, tmp_path):
    path, at = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "b")
    pieces = tokens.pack(frame(spark, TEXTS), path)
    tokens.write_buckets(pieces, at)
    assert {p.name for p in (tmp_path / "b").iterdir() if p.is_dir()} == {f"length={r[0]}" for r in pieces.select("length").distinct().collect()}
    back = tokens.read_buckets(spark, at, pieces.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, pieces.collect()))
    assert {len(r["ids"]) for r in tokens.read_buckets(spark, at, pieces.schema, 4096).collect()} == {4096}
    plan = tokens.read_buckets(spark, at, pieces.schema, 4096)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(length" in plan
    assert sorted(map(str, tokens.packed_buckets(frame(spark, TEXTS), path).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, pieces.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_null_ids_repeats_and_empty_tables(spark):
    """Every operator on whole rows keeps null ids and repeated rows, gives nothing for an empty table, and minds no other column."""
    rows = [(None, "some text here", "xx", ""), (None, None, None, ""), (3, "some text here", "xx", ""), (3, "some text here", "xx", ""), (3, "other", "yy", ""), (4, "", "yy", "")]
    names = ("text_", "_mark", "item_id", "ids", "length", "part")
    df = spark.createDataFrame(rows, DOC).select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    bench = spark.createDataFrame([(None, "some text here"), (-1, "some text here"), (5, None), (6, " -- ")], "item_id long, text string")
    ids = lambda out: sorted(str(r["doc_id"]) for r in out.collect())
    want = sorted(str(r[0]) for r in rows)
    byte, word = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert ids(tokens.orc_round_trip(df, byte)) == want and ids(langid.identify(df)) == want
    packed = tokens.pack(df, word).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()
    assert {r["doc_id"] for r in packed} == {None, 3, 4} and all(r["n"] >= r["most"] for r in packed)
    found = decontaminate.contaminated(df, bench).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in found) == sorted((d, i) for d in ("None", "3", "3") for i in ("None", "-1"))
    assert ids(decontaminate.clean(df, bench)) == ["3", "4", "None"] and decontaminate.clean(df, bench).columns == df.columns
    none = df.limit(0)
    for out in (tokens.orc_round_trip(none, byte), tokens.pack(none, word), tokens.packed_buckets(none, word), langid.identify(none), decontaminate.contaminated(none, bench), decontaminate.clean(none, bench)):
        assert out.count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == 6 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_in_blocks_and_of_long_items(spark):
    """Several blocks find what one does, and a passage far behind its place in a very long item is found."""
    rng = random.Random(6)
    items = [" ".join(words(rng, 40)) for _ in range(12)]
    long = " ".join(f"{rng.getrandbits(44):011x}" for _ in range(100_000))
    texts = [f"{' '.join(words(rng, 20))} {items[i]} {' '.join(words(rng, 20))}" for i in range(6)] + [" ".join(words(rng, 60)) for _ in range(6)] + [long[-700:]]
    assert len(long) > 1 << 20
    bench = spark.createDataFrame(list(enumerate([*items, long])), "item_id long, text string")
    one, many = decontaminate.Settings(), decontaminate.Settings(block_bytes=500_000)
    got = [sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, texts), bench, settings=s).collect()) for s in (one, many)]
    assert got[0] == got[1] == [*((i, i) for i in range(6)), (12, 12)]
    few = bench.filter("item_id < 12")
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame(spark, texts), few, settings=decontaminate.Settings(block_bytes=1500)).collect()) == list(range(6, 13))


def test_language_matches_plain_backoff(spark):
    """Brute force: sums of log frequencies, and for unknown words the mean over their longest known n-grams."""
    rng = random.Random(7)
    make = {"xx": ["kala", "mono", "tiri", "selu"], "yy": ["strum", "blund", "grent", "kalt"]}
    rows = [(i, " ".join(rng.choice(make[lang]) + rng.choice(["", "a", "ul"]) for _ in range(12)), lang, "") for i in range(80) for lang in [("xx", "yy")[i % 3 == 0]]]
    rows += [(100, "strumming kalamono grentul", None, ""), (101, "zzz qqq", None, ""), (102, "mono mono blundest", None, "")]
    df = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    train = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({lang for _, lang in train})
    word = {x: Counter(w for t, lang in train if lang == x for w in t.split()) for x in langs}
    vocabulary = sorted(set().union(*word.values()))
    grams = {x: Counter() for x in langs}
    for x in langs:
        for w, n in word[x].items():
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    grams[x][f" {w} "[i : i + k]] += n
    known = sorted(set().union(*grams.values()))
    log = lambda counts, x, key, names: math.log((counts[x][key] + 0.5) / (sum(counts[x].values()) + 0.5 * (len(names) + 1)))
    for i, t, *_ in rows:
        total = {x: math.log(sum(lang == x for _, lang in train) / len(train)) for x in langs}
        for w in t.split():
            for x in langs:
                if w in vocabulary:
                    total[x] += log(word, x, w, vocabulary)
                    continue
                for k in range(5, 0, -1):
                    if hits := [g for j in range(len(w) + 3 - k) if (g := f" {w} "[j : j + k]) in known]:
                        total[x] += sum(log(grams, x, g, known) for g in hits) / len(hits)
                        break
        best = max(langs, key=lambda x: total[x])
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(math.exp(total[x] - total[best]) for x in langs)) < 1e-3, (i, t)
