"""Alignment, periodic runs and byte-pair encoding against plain versions, edge cases included."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from threadloom.llm import align, bpe, queries, runs

ODD = [None, "", " ", "  \n", "a", "\n", "a  b", " lead", "trail ", "tab\tand\r\nline\n\nend", "x▁y", "no break   space", "<|endoftext|> <s> </s> <unk>", "日本語 текст \U0001f600‍", "a b 　c", "it's we'll 'tis ''s", "1234567 89", "café café", "\x00 \x1c\x1f"]
SCHEMA = "doc_id long, text string, ids string, `a.b` int"
A, B, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def texts_of(seed, n=40):
    rng = random.Random(seed)
    syllables = ["the", "ing", "éau", "qu", "tion", "Xy", "9", "-", "'s", "ß", ".", "zz"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    return [rng.choice([" ", "\n", " "]).join(word() for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    docs, count = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(s[3:5], 16)]) if len(s := b.id_to_piece(i)) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode() for i in y]
        if not text or b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            docs.append([])
            continue
        groups, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b and i < len(x):
                at_a, i, _ = at_a + len(p[i]), i + 1, ga.append(x[i])
            else:
                at_b, j, _ = at_b + len(q[j]), j + 1, gb.append(y[j])
            if at_a == at_b and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append(groups)
        count.update({(u, v) for g, h in groups for u in g for v in h})
    highest = defaultdict(int)
    for (u, _), n in count.items():
        highest[u] = max(highest[u], n)
    out = []
    for groups in docs:
        links = [(u, v) for g, h in groups for u in g for v in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(count[k] == highest[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("hot", [1 << 18, 30])
def test_alignment_equals_a_plain_one(spark, hot):
    texts = [*ODD, *texts_of(1), *texts_of(1)[:6], "x" * 3000 + " y"]
    got = {r["doc_id"]: tuple(r)[1:] for r in align.aligned_documents(frame(spark, texts), A, B, digest=True, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_alignment_of_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_token_alignment(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in docs] == plain_alignment([r["text"] for r in docs])


def test_aligner_keeps_few_units(monkeypatch):
    """A full memo stays within its bound, the units met most often survive, and results stay the same."""
    monkeypatch.setattr(align, "MEMO", 60)
    texts = [f"the same words and {' '.join(f'w{i}x{j}' for j in range(20))}" for i in range(12)]

    def rows(texts, al):
        return [align._aligned(al, pa.array([0]), [t], 0, align.Counts(), False).to_pylist()[0] for t in texts]

    al = align.Aligner(A, B)
    got = rows(texts, al)
    assert len(al.known) <= 60 and {" the", " same", " words", " and"} <= set(al.known) and len(al.name) == len(al.text) == len(al.known)
    monkeypatch.setattr(align, "MEMO", 10**6)
    key = lambda r: {c: sorted(zip(r["units"], r["times"], strict=True)) if c == "units" else v for c, v in r.items() if c != "times"}
    assert list(map(key, got)) == list(map(key, rows(texts, align.Aligner(A, B))))


def test_alignment_edges(spark):
    rows = [(None, "the same"), (None, "the same"), (1, "the same"), (1, None)]
    got = align.aligned_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted((str(r["doc_id"]), r["n_links"] > 0, r["count_sum"]) for r in got)[0] == ("1", False, 0) and len(got) == 4
    assert len({r["count_sum"] for r in got if r["n_links"]}) == 1
    assert align.aligned_documents(frame(spark, ["a"]).limit(0), A, B).count() == 0


def test_groups_are_components():
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([*sorted(rng.sample(range(1, 60), rng.randrange(0, 20))), 60] for _ in range(2))
        both = sorted(set(x) & set(y))
        got = align.groups_of(np.asarray(x), np.asarray(y))
        assert [g.tolist() for g in got] == [[next(i for i, e in enumerate(both) if end <= e) for end in ends] for ends in (x, y)]
    for _ in range(50):
        n, edges = 30, [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(0, 40))]
        least = list(range(n))
        for _ in range(n):
            for u, v in edges:
                least[u] = least[v] = min(least[u], least[v])
        assert align.united(n, *(np.asarray([e[k] for e in edges], np.int64) for k in (0, 1))).tolist() == least


def plain_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(s <= i and s + n >= j + q for s, n, p in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def periodic(rng):
    w = []
    for _ in range(rng.randrange(1, 7)):
        k = rng.choice([1, 2, 3, 400])
        base = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 14))]
        part = (base * 60)[: rng.randrange(1, 60)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "odd"
        w += part
    return w * 3 if rng.random() < 0.3 else w + w[::-1] if rng.random() < 0.3 else w


@pytest.mark.parametrize(("least", "times"), [(24, 3), (8, 2), (6, 3), (10, 4), (2, 2), (5, 2)])
def test_runs_equal_plain_ones(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(60):
        texts = [periodic(rng) for _ in range(rng.randrange(1, 6))]
        assert runs.runs_of_texts([[x.encode() for x in t] for t in texts], least, times) == [plain_runs(t, least, times) for t in texts]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(spark):
    rng = random.Random(9)
    texts = [*ODD, *(rng.choice([" ", "\n", "\t "]).join(periodic(rng)) for _ in range(150)), "ab cd " * 200_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.digests(runs.find_runs(queries.planted(frame(spark, texts)))).collect()}
    assert [got[i] for i in range(len(texts) - 1)] == [plain_row(i, t) for i, t in enumerate(texts[:-1])]
    assert got[len(texts) - 1][:5] == (1, 0, 400_000, 2, 200_000_000)


def test_runs_of_whole_table_and_edges(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_tandem_runs(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in docs] == [plain_row(*r) for r in docs] and sum(r[0] for r in got.values())
    none = spark.createDataFrame([(None, "a b " * 20), (None, "a b " * 20), (7, None)], "doc_id long, text string")
    assert sorted((r["n_runs"], r["period"] or 0) for r in runs.digests(runs.find_runs(queries.planted(none))).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert runs.find_runs(none.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pairs_stand_as_merging_says(vocabulary):
    rng, tokens = random.Random(4), [t for t in vocabulary.bytes if t]
    short = [t for t in tokens if len(t) < 4]
    for _ in range(4000):
        a, b = rng.choice(rng.choice([tokens, short])), rng.choice(rng.choice([tokens, short]))
        assert vocabulary.stands(vocabulary.ranks[a], vocabulary.ranks[b]) == (bpe.merged(a + b, vocabulary.ranks) == [a, b])


def test_encoding_equals_the_library(spark, vocabulary, library):
    texts = [*ODD, *texts_of(3), *texts_of(3)[:4], "a" * 5000, "ab" * 3000 + " " * 700 + "\n" * 90, "".join(map(chr, range(1, 3000)))]
    held = bpe.encoded_documents(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in held.collect()}
    assert [got[i] for i in range(len(texts))] == [(library.encode_ordinary(t or ""), (t or "").encode()) for t in texts]
    assert held.limit(0).count() == 0


def test_digests_of_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_prefix_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))


def test_appends_and_edits(vocabulary, library):
    rng = random.Random(6)
    table, piece = bpe.Table(vocabulary), b""
    for _ in range(60):
        more = "".join(rng.choice("abinthe") for _ in range(rng.randrange(1, 9))).encode()
        piece += more
        assert table.append(more) == len(more) and tuple(table.ids()) == vocabulary.encode_all([piece])[0]
    long = bpe.Table(vocabulary, piece * 20)
    assert long.edit(100, 3, b"xyz!") < len(piece) * 10
    assert long.ids() == bpe.Table(vocabulary, (piece * 20)[:100] + b"xyz!" + (piece * 20)[103:]).ids()
    for text in [*texts_of(8, 6), "it's  \n aéb   1234"]:
        held = bpe.Encoded(vocabulary, text)
        for _ in range(25):
            at = rng.randrange(len(held.text) + 1)
            held.edit(at, min(rng.randrange(4), len(held.text) - at), rng.choice(["", "s", "'", " ", "\n", "  x", "é", "the end", "'ll", "9"]))
            assert held.ids() == library.encode_ordinary(held.text)
        held.append(" and more")
        assert held.ids() == library.encode_ordinary(held.text)


def test_edited_documents(spark, library):
    rows = [(1, "the quick brown fox " * 200, 400, 5, "slow"), (2, None, None, None, "new"), (None, "short", 99, 99, None), (3, "", 0, 0, "")]
    got = {r["doc_id"]: r for r in bpe.edited(spark.createDataFrame(rows, "doc_id long, text string, at int, removed int, inserted string"), RANKS, public_tokenizers.PATTERN).collect()}
    text = rows[0][1]
    assert got[1]["ids"] == library.encode_ordinary(text[:400] + "slow" + text[405:]) and got[1]["worked"] < 40
    assert got[2]["ids"] == library.encode_ordinary("new") and got[None]["ids"] == library.encode_ordinary("short") and got[3]["ids"] == []
