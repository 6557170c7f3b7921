"""The operators against brute force, exact round trips and the defined cases."""

import base64
import hashlib
import random
import re
import string
import struct
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubeloom.llm import ann, byte_bpe, fingerprint, hostextract, idstore, neardup, packing, pieces, pseudonym, suffix_lm, texthash, toxicity
from cubeloom.llm.runtime import components, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, `range` int, h1 long, fp string, key string, _private string"
LONG = " ".join(f"word{k % 997} and{k % 13}" for k in range(12_000))
CASES = [(1, "One two three four five six.\nSeven eight nine."), (2, None), (3, ""), (4, "  \t\n "), (5, LONG), (6, "One two three four five six.\nSeven eight nine."), (6, "One two three four five six.\nSeven eight nine."), (None, "Nobody's text, with words in it."), (7, "Kurz."), (8, "漢字 é 😀\x1c\xa0x  y \n z"), (9, "a <|endoftext|> b<|startoftext|>")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, "f", "k", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def cases(spark):
    return table(spark, CASES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def byte_encoder():
    return pieces.byte_level_encoder(P.path("byte_bpe_50k.json"))


def word_encoder():
    return pieces.word_encoder(P.path("word_bpe_49k.json"))


@lru_cache
def library_file(name, keep_special):
    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = keep_special
    return tok


def library(name, texts, end, keep_special=False):
    tok = library_file(name, keep_special)
    return [[*e.ids, end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["a", "b", "the ", " ", "  ", "\n", "'s", "'", "é", "É", "漢字", "😀", "1", "2024", "ing", "\t", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "ve", "aaaa", "=====", "\xa0", "\x85", "\x1c", "Foo,", "--", "İ", "ΑΣ", "ß", ".", "ſ", "e\u0301", "\u0301", "Σ", "Ⅷ", "½", "\u2003", "\u200b", "\u3000", "\ufeff", "\u180e", "ǅ", "и\u0306", "؉", "१"]
odd_texts = st.lists(st.sampled_from(ODD), max_size=25).map("".join)


def test_a_cluster_has_to_name_the_shared_folder():
    from unittest.mock import MagicMock

    from cubeloom.llm.runtime import shared_dir

    fake = MagicMock()
    fake.sparkContext.getConf().get.return_value = None
    fake.sparkContext.getCheckpointDir.return_value = None
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        fake.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_dir(fake)
    fake.sparkContext.getConf().get.return_value = "hdfs://x/y/"
    assert shared_dir(fake) == "hdfs://x/y"


# Encoders ------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(odd_texts, st.text(max_size=20)), min_size=1, max_size=4))
def test_encoders_equal_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for name, make in (("byte_bpe_50k.json", pieces.byte_level_encoder), ("word_bpe_49k.json", pieces.word_encoder)):
        for keep in (False, True):
            got = [ids[a:b].tolist() for _, ids, at in make(P.path(name), keep_special=keep).encode(texts) for a, b in zip(at[:-1], at[1:])]
            assert got == [e[:-1] for e in library(name, texts, 0, keep)]


def test_added_tokens_are_those_of_the_library():
    assert byte_encoder().one("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    assert word_encoder().one("a <|endoftext|> b").tolist() == [320, 49407, 321]


def test_parts_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcDE.'s1\n", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    want = library("word_bpe_49k.json", texts, 0)
    for chars, group, known in ((1, 3, 5), (100, 1, 40), (100, 7, 1 << 19), (1 << 20, 512, 1 << 19)):
        monkeypatch.setattr(pieces, "CHARS", chars)
        monkeypatch.setattr(pieces, "GROUP", group)
        monkeypatch.setattr(pieces, "KNOWN", known)
        pieces.word_encoder.cache_clear()
        rows = [[*ids[a:b].tolist(), 0] for _, ids, at in word_encoder().encode(texts) for a, b in zip(at[:-1], at[1:])]
        assert rows == want


def test_white_space_that_only_the_library_knows_is_met_one_by_one():
    closes = np.zeros(1 << 16, bool)
    closes[9] = True
    bulk = lambda texts: [[1, 9, 9, 9] for _ in texts]  # noqa: E731  one end too many
    ids, start, size = pieces._grouped(bulk, lambda piece: [len(piece), 9], " ", closes, True, "<u2", np.frombuffer(b"abcde", np.uint8), np.array([0, 2, 5]))
    assert ids.tolist() == [2, 9, 3, 9] and start.tolist() == [0, 2] and size.tolist() == [2, 2]


RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(odd_texts, st.text(max_size=40)))
def test_transducer_equals_tiktoken(text):
    text = text.encode("utf-8", "replace").decode()
    bpe = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == OWN.encode_ordinary(text)
    assert "".join(bpe.decode(ids, block=1)) == text


def test_transducer_forgets_and_goes_on():
    t = byte_bpe.Transducer(RANKS, limit=20)
    for word in ("tokenisation", "incomprehensible", "aaaaaaaaaaaaaaa", "strawberries"):
        assert t.encode(word.encode()) == OWN.encode_ordinary(word)


def test_utf8_stream():
    s, out = byte_bpe.Utf8Stream(), ""
    for b in "aé漢😀z".encode():
        out += s.feed(bytes([b]))
    s.finish()
    assert out == "aé漢😀z"
    s.feed("é".encode()[:1])
    with pytest.raises(UnicodeDecodeError):
        s.finish()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12), st.integers(1, 5))
def test_utf8_stream_accepts_what_is_utf8(raw, step):
    raw = raw if len(raw) % 3 else raw.decode("latin-1").encode()

    def run():
        s = byte_bpe.Utf8Stream()
        out = "".join([s.feed(raw[k : k + step]) for k in range(0, len(raw), step)])
        s.finish()
        return out

    try:
        want = raw.decode()
    except UnicodeDecodeError:
        with pytest.raises(UnicodeDecodeError):
            run()
    else:
        assert run() == want


def test_byte_bpe_cases(cases, empty):
    rows = byte_bpe.digests(cases, P.path("byte_bpe_50k.tiktoken")).collect()
    want = Counter((i, len(ids := OWN.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in CASES)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.digests(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0
    full = byte_bpe.encode(cases, P.path("byte_bpe_50k.tiktoken")).where("doc_id = 8").first()
    assert full.decoded == dict(CASES)[8] and len(full.ids) == 4 * full.n_tokens


# Packing --------------------------------------------------------------------------


def check_packed(rows, docs, window):
    ids = {}
    for (i, _), e in zip(docs, library("byte_bpe_50k.json", [t for _, t in docs], 0)):
        ids.setdefault(i, []).append(e)
    covered, sequences = Counter(), {}
    for r in rows:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        covered.update({(r.doc_id, k): 1 for k in range(r.start, r.start + r.length)})
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(i, k): len(es) for i, es in ids.items() for k in range(len(es[0]))})
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, cases, empty):
    assert check_packed(packing.pack(cases, byte_encoder).collect(), CASES, 1024) == 0
    assert packing.pack(empty, byte_encoder).count() == 0
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices(["the", "of", "and", "zebra"], k=rng.randint(0, 120)))) for k in range(400)]
    assert check_packed(packing.pack(table(spark, docs).repartition(5), byte_encoder, window=64).collect(), docs, 64) == 0


def test_nnls_uses_up_a_histogram_that_combines():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 54, 20, 44, 32]] = [500, 500, 300, 300, 200]
    rows = packing.combinations(64)
    assert (rows.sum(1) == 64).all() and len({tuple(r) for r in rows.tolist()}) == len(rows)
    x = packing.nnls(rows, histogram.astype(float))
    assert (x >= 0).all()
    p = packing.plan(histogram, 64)
    assert (p["used"][[10, 54, 20, 44, 32]] >= [490, 490, 290, 290, 190]).all()


# Near duplicates --------------------------------------------------------------------


def brute_components(docs, percent=75):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_docs(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(300)]
    base = [rng.choices(words, k=rng.randint(3, 90)) for _ in range(n // 8)]
    docs = []
    for k in range(n):
        w = list(rng.choice(base[:3] if k % 3 == 0 else base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [3_000_000, 400])
def test_near_duplicates_equal_brute_force(spark, block):
    docs = near_docs(240, 11)
    rows = neardup.near_duplicates(table(spark, docs), block_shingles=block).collect()
    want = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicate_cases(cases, empty):
    rows = neardup.near_duplicates(cases).collect()
    assert len(rows) == len(CASES)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 5, 1, True), (6, 5, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (7, 1, 7, True)} <= got
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(empty).count() == 0


def test_sketch_fills_and_agrees():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        s = neardup.sketch(a)
        assert (s != np.uint64(2**64 - 1)).all() and (neardup.sketch(a[::-1].copy()) == s).all()
    both = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    agree = np.mean([(neardup.sketch(both[:1000] ^ np.uint64(k)) == neardup.sketch(both[200:] ^ np.uint64(k))).mean() for k in range(20)])
    assert abs(agree - 800 / 1200) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {(r.a, r.b) for r in components(df).collect()} == {(x, find(x)) for x in up if find(x) != x}


def test_word_hashes_ignore_position_and_segments(monkeypatch):
    import pyarrow as pa

    texts = ["a b  c\td", None, "", " Abc abc ABC ", "x" * 50 + " y", "é è"]
    h, at = texthash.words(pa.array(texts))
    assert np.diff(at).tolist() == [4, 0, 0, 3, 2, 2]
    assert len(set(h[4:7].tolist())) == 1 and len(set(h.tolist())) == 9
    monkeypatch.setattr(texthash, "SEGMENT", 3)
    assert (texthash.words(pa.array(texts))[0] == h).all()


# Toxicity -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def moody(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(200)]
    docs, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 9))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vexa", "grumo", "vexatic"])
        docs.append((k, ". ".join(sentences) + "."))
        labels.append((k, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_locates(spark, moody):
    docs, labels = moody
    df = table(spark, docs)
    model = toxicity.fit(df, labels, F.col("doc_id") % 4 != 0)
    rows = toxicity.score(df, model).collect()
    held = [r for r in rows if r.doc_id % 4 == 0]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    texts = dict(docs)
    for r in held:
        if r.predicted and r.doc_id % 5 == 0:
            assert any(re.search("vexa|grumo", texts[r.doc_id][x.start : x.end]) for x in r.offending)
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if not r.predicted}


def test_noisy_or_is_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    bags = [[[int(f) for f in rng.choice(4, rng.integers(1, 3), replace=False)] for _ in range(rng.integers(0, 4))] for _ in range(12)]
    plain, toxic = rng.integers(0, 3, 12).astype(float), rng.integers(0, 2, 12)

    def loss(w):  # by loops: the mean negative log likelihood and the decay
        total = 0.0
        for sentences, none, t in zip(bags, plain, toxic):
            clean = 1.0
            for s in sentences:
                clean *= 1 - 1 / (1 + np.exp(-(w[4] + sum(w[f] for f in s))))
            clean *= (1 - 1 / (1 + np.exp(-w[4]))) ** none
            total -= np.log(max(1 - clean, 1e-300)) if t else np.log(clean)
        return (total + 5e-3 * (w[:4] ** 2).sum()) / len(bags)

    keep = [k for k in range(12) if bags[k] or plain[k] or not toxic[k]]
    bags, plain, toxic = [bags[k] for k in keep], plain[keep], toxic[keep]
    w, at = np.append(np.zeros(4), -5.0), 1e-5
    m = v = np.zeros(5)
    for step in range(1, 21):
        grad = np.array([(loss(w + at * e) - loss(w - at * e)) / (2 * at) for e in np.eye(5)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    flat = [[x for s in b for x in (*s, -1)] for b in bags]
    got, bias = toxicity.noisy_or(flat, plain, toxic, 4, steps=20)
    assert [*got, bias] == pytest.approx(w.tolist(), abs=1e-3)


def test_scores_equal_a_loop_over_sentences():
    rng = random.Random(3)
    model = toxicity.Model({"bad": 4.0, "badl*": 2.0, "good": -3.0, "bade*": 1.0}, -4.0)
    for _ in range(200):
        text = "".join(rng.choice(["bad", "badly", "Bade ", "good", " ", ". ", "\n", "!", "x", "baden"]) for _ in range(rng.randint(0, 12)))
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text):
            words = set(re.findall(r"\w+", sentence.lower()))
            if words:
                told = sum(model.weights.get(f, 0) for w in words for f in [w] + [w[:k] + "*" for k in (4, 5) if len(w) >= k])
                clean *= 1 - 1 / (1 + np.exp(-(told - 4.0)))
        assert model.score(text)[0] == pytest.approx(1 - clean, abs=1e-9)


def test_labels_that_are_null_or_disagree(spark):
    docs = [(k, ("vexa " if k % 2 else "") + " ".join(f"w{j}" for j in range(k % 5 + 1)) + ".") for k in range(200)] + [(1, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(0, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, docs), labels, max_features=3)
    assert len(model.weights) <= 3 and model.weights["vexa"] > 0
    assert {r.doc_id: r.predicted for r in toxicity.score(table(spark, docs[:200]), model).collect()} == {k: k % 2 for k in range(200)}


def test_toxicity_cases(spark, cases, empty, moody):
    docs, labels = moody
    model = toxicity.fit(table(spark, docs), labels)
    rows = toxicity.score(cases, model).collect()
    assert len(rows) == len(CASES) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(empty, labels)
    assert nothing.constant == 0 and toxicity.score(cases, nothing).agg(F.max("score")).first()[0] == 0


# Suffix tree --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    follow = {w: rng.choices("abcdefgh", k=2) for w in "abcdefgh"}
    docs = []
    for k in range(300):
        w, text = rng.choice("abcdefgh"), []
        for _ in range(rng.randint(0, 60)):
            text.append(w)
            w = rng.choice(follow.get(w, "ab")) if rng.random() < 0.9 else rng.choice("abcdefghxyz")
        docs.append((k, " ".join(text)))
    return docs


def test_suffix_tree(spark, prose):
    df = table(spark, prose).repartition(3)
    held = F.coalesce(suffix_lm.crc_modulo("doc_id", 7) == 2, F.lit(False))
    tree, unigrams = suffix_lm.fit(df, ~held)
    rows = {r.doc_id: r for r in suffix_lm.score(df, tree, unigrams, held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in prose}
    words = {i: t.split() + ["</s>"] for i, t in prose}
    c = Counter(w for i in words if not out[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, r in rows.items():
        assert r.held_out == out[i] and r.train_tokens == n and r.n_tokens == len(words[i]) and r.n_known == sum(c[w] > 0 for w in words[i])
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words[i]))
    tested = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested) + 10
    assert all(tree.states[k].where("retained").count() for k in (0, 1))


def test_states_are_distributions(prose):
    texts = [(*t.split(), "</s>") for _, t in prose]
    _, states, log_p = tree_by_hand(texts, 3)
    words = {w for t in texts for w in t} | {"unknown"}
    for context in [s for s in states if len(s) < 4][:400]:
        assert sum(10 ** log_p(context, w) for w in words) == pytest.approx(1)


def test_suffix_tree_cases(cases, empty):
    held = F.coalesce(suffix_lm.crc_modulo("doc_id", 7) == 2, F.lit(False))
    tree, unigrams = suffix_lm.fit(cases, ~held)
    rows = suffix_lm.score(cases, tree, unigrams, held).collect()
    assert len(rows) == len(CASES) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    nothing, none = suffix_lm.fit(empty, F.lit(True))
    assert suffix_lm.score(empty, nothing, none, F.lit(False)).count() == 0
    rows = suffix_lm.score(cases, nothing, none, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == r.score == 0 for r in rows)


def tree_by_hand(texts, depth, least=suffix_lm.MIN_COUNT):
    """log10 of a word after the words before it, by dictionaries over all runs."""
    runs = Counter(t[i : i + k] for t in texts for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    n, v = sum(map(len, texts)), sum(len(r) == 1 for r in runs)
    after, states = {}, {}
    for r, c in runs.items():
        if len(r) > 1 and c >= least:
            after.setdefault(r[:-1], {})[r[-1]] = c

    def log_p(context, w):
        if not context:
            return np.log10((runs[(w,)] + 1) / (n + v + 1))
        given, passed = state(context)
        return given[w] if w in given else passed + log_p(context[1:], w)

    def state(context):
        if context not in states:
            kept, total = after.get(context, {}), runs[context]
            below = {w: log_p(context[1:], w) for w in kept}
            gain = 2 * sum(c * (np.log(c / total) - below[w] * np.log(10)) for w, c in kept.items())
            left, rest = total - sum(c - suffix_lm.DISCOUNT for c in kept.values()), 1 - sum(10 ** x for x in below.values())
            if kept and gain > len(kept) + 4 * np.sqrt(2 * len(kept)) and left > 0 and rest > 1e-9:
                states[context] = {w: np.log10((c - suffix_lm.DISCOUNT) / total) for w, c in kept.items()}, np.log10(left / total / rest)
            else:
                states[context] = {}, 0.0
        return states[context]

    return lambda t: sum(log_p(t[max(0, i - depth) : i], w) for i, w in enumerate(t)), states, log_p


def test_rare_contexts_count_whatever_is_looked_up(spark, prose):
    df = table(spark, prose).repartition(3)
    by_hand, *_ = tree_by_hand([(*t.split(), "</s>") for _, t in prose], 2)
    tree, unigrams = suffix_lm.fit(df, F.lit(True), depth=2)
    for lookups in (3, 40, suffix_lm.LOOKUPS):
        got = {r.doc_id: r.score for r in suffix_lm.score(df, tree, unigrams, F.lit(False), lookups=lookups).collect()}
        assert got == pytest.approx({i: by_hand((*t.split(), "</s>")) for i, t in prose})


def test_long_contexts_are_retained(spark):
    rng, texts = random.Random(8), []
    for _ in range(200):  # the word after "k a b c" tells k
        words = [w for _ in range(6) for k in [rng.choice("rstu")] for w in (k, "a", "b", "c", k.upper() + "x", *rng.choices("mnop", k=2))]
        texts.append(" ".join(words).lower())
    texts += ["one licence line that " + " ".join(f"w{k}" for k in range(30))] * 9
    by_hand, states, _ = tree_by_hand([(*t.split(), "</s>") for t in texts], suffix_lm.DEPTH)
    df = table(spark, list(enumerate(texts))).repartition(3)
    tree, unigrams = suffix_lm.fit(df, F.lit(True))
    for lookups in (suffix_lm.LOOKUPS, 20):
        got = {r.doc_id: r.score for r in suffix_lm.score(df, tree, unigrams, F.lit(False), lookups=lookups).collect()}
        assert got == pytest.approx({k: by_hand((*t.split(), "</s>")) for k, t in enumerate(texts)})
    assert any(kept for s, (kept, _) in states.items() if len(s) == 4)
    assert tree.states[3].where("retained").count()


def test_runs_with_and_without_numbers_count_alike(spark, prose, monkeypatch):
    df = table(spark, prose).repartition(3)
    by_hand, *_ = tree_by_hand([(*t.split(), "</s>") for _, t in prose], suffix_lm.DEPTH)
    monkeypatch.setattr(suffix_lm, "LOOKUPS", 12)  # few words have numbers
    tree, unigrams = suffix_lm.fit(df, F.lit(True))
    got = {r.doc_id: r.score for r in suffix_lm.score(df, tree, unigrams, F.lit(False), lookups=12).collect()}
    assert got == pytest.approx({i: by_hand((*t.split(), "</s>")) for i, t in prose})


def test_numbers_of_words():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    words[:60] &= ~np.uint64(0xFFFF)  # one place in the table
    others = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    others[:60] &= ~np.uint64(0xFFFF)
    numbers = suffix_lm._Numbers(words)
    assert numbers.of(words).tolist() == list(range(4000)) and (numbers.of(others) == -1).all()
    assert (suffix_lm._Numbers(words[:0]).of(others) == -1).all()
    ids, at = rng.integers(0, 4000, 300).astype(np.uint64), np.arange(290)
    for k in range(2, 8):
        run = suffix_lm._named(suffix_lm._numbered(ids, at, k), k, words)
        assert all((run[j] == words[ids[at + j].astype(int)]).all() for j in range(k))


def test_asks_are_small():
    rng = np.random.default_rng(5)
    keys, rows = rng.integers(0, 2**64, 100_000, dtype=np.uint64), np.sort(rng.integers(0, 8000, 100_000))
    asks = suffix_lm._Asks(0, 2, 64)
    list(asks.add(keys, rows))
    batch = asks.blocks()
    assert sum(len(d) for c in ("keys", "rows") for d in batch.column(c).to_pylist()) < 9 * len(keys)
    assert sum(len(suffix_lm._stepped(suffix_lm._unpack(d))) for d in batch.column("keys").to_pylist()) == len(np.unique(keys))


def test_the_sieve_passes_its_keys_and_few_others(spark):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    sieve = suffix_lm.Sieve(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), len(keys))
    assert sieve.has(keys).all()
    assert sieve.has(rng.integers(0, 2**64, 200_000, dtype=np.uint64)).mean() < 0.015


def test_tables_of_the_tree_leave_no_shuffle_files(spark, prose, monkeypatch):
    disk, names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), []

    def files():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    def checked(df, name, write=suffix_lm.written):
        before, out, ends = files(), write(df, name), time.time() + 5
        while files() - before and time.time() < ends:
            time.sleep(0.05)
        assert not files() - before, name
        names.append(name)
        return out

    monkeypatch.setattr(suffix_lm, "written", checked)
    monkeypatch.setattr(suffix_lm, "_free", lambda _: None)  # files go without a collection
    df = table(spark, prose).repartition(3)
    tree, unigrams = suffix_lm.fit(df, F.lit(True))
    assert suffix_lm.score(df, tree, unigrams, F.lit(False), lookups=3).count() == len(prose)
    assert {"unigrams", "frequent", "met", "states", "level", "weights", "scored", "sums"} == set(names)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


# Nearest neighbours --------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [o for o in np.lexsort((ids, d)) if ids[o] != ids[q]][:k]
    return [(int(ids[o]), float(d[o])) for o in order]


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[100:160] = x[100]  # ties
    ids = np.arange(3000) * 5
    rows = ann.search(vectors(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)]), F.col("vec_id") % 100 == 0, block=300).collect()
    x = x.astype(float)
    found, total = 0, 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {int(i) for i in ids if i % 100 == 0}
    for q, got in by.items():
        got.sort()
        want = brute_nearest(x, ids, q // 5)
        assert [g[0] for g in got] == list(range(1, 11)) and got == sorted(got, key=lambda g: (g[2], g[1]))
        for _, i, s in got:
            assert s == pytest.approx(float(np.sqrt(((x[i // 5] - x[q // 5]) ** 2).sum())), rel=1e-12)
        found += len({i for i, _ in want} & {g[1] for g in got})
        total += 10
    assert found / total >= 0.9


def test_nearest_ties_and_further_columns(spark):
    rows = [(k, [float(k % 3 + 1), 1.0], k, k, "x") for k in range(0, 30)] + [(100, [2.0, 1.0], 0, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, block int, v string")
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 100, k=8).orderBy("rank").collect()]
    assert got == [(n + 1, k, 0.0) for n, k in enumerate(range(1, 24, 3))]


def test_nearest_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [1.0, 2.0, 3.0], 0), (7, [0.0, 2.0], 0)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0], 0)]), F.col("vec_id") % 100 == 0).count() == 0


# Fingerprints ------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(9)
    docs = [(k * 700 - 3000, " ".join("".join(rng.choices("abcdé", k=3)).capitalize() + rng.choice(["", ".", "\n"]) for _ in range(rng.randint(0, 40)))) for k in range(12)]
    docs[5] = (docs[5][0], docs[4][1])
    rows = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, docs).repartition(4)).collect()}
    for k, (i, t) in enumerate(docs):
        n = len(t) // 2
        edited = t[: len(t) - n] + docs[(k + 1) % len(docs)][1][:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[docs[4][0]].fingerprint == rows[docs[5][0]].fingerprint and rows[docs[4][0]].near_next == 1


def spark_hash(k, text):
    seed = xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42)
    return xxhash.xxh64_intdigest(text.encode(), seed=seed)


def brute_fingerprint(text):
    units = [u for u in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text) if u.strip(" ")]
    lanes = [0] * 256
    wide = [0] * 4
    for u in units:
        for k in range(4):
            h = spark_hash(k, u)
            for b in range(64):
                lanes[64 * k + b] += h >> b & 1
        for k in range(2):
            h = spark_hash(4 + k, u)
            wide[2 * k] = (wide[2 * k] + (h & 0xFFFFFFFF)) & 0xFFFFFFFF
            wide[2 * k + 1] = (wide[2 * k + 1] + (h >> 32)) & 0xFFFFFFFF
    planes = [sum((lanes[64 * k + b] >> p & 1) << b for b in range(64)) for k in range(4) for p in range(12)]
    return len(units), lanes, f"{len(units):x}-{''.join(f'{w:08x}' for w in wide)}-{''.join(f'{x:016x}' for x in planes)}"


def brute_likeness(a, b):
    if a[0] + b[0] == 0:
        return 1.0
    signed = [((2 * (x - y) - (a[0] - b[0]) + 2048) % 4096) - 2048 for x, y in zip(a[1], b[1])]
    return max(0.0, min(1.0, 1 - sum(d * d for d in signed) / 256 / (a[0] + b[0])))


@pytest.mark.parametrize("spread", ["dense", "sparse", "uneven"])
def test_fingerprints_equal_sums_by_loops(spark, spread, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE", 4)
    monkeypatch.setattr(fingerprint, "COARSE", 5)
    rng = random.Random(10)
    ids = {"dense": range(60), "sparse": sorted({rng.randint(-(2**63), 2**63 - 1) for _ in range(60)}), "uneven": [-(2**63), *range(50), *(10**k for k in range(4, 12)), 2**63 - 1]}[spread]
    docs = [(i, " ".join("".join(rng.choices("abé", k=2)) + rng.choice(["", ".", "!\n", "\n\n"]) for _ in range(rng.choice([0, 3, 30, 90])))) for i in ids]
    rows = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, docs).repartition(4)).collect()}
    for k, (i, t) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(t) // 2
        own, edited, other = (brute_fingerprint(x) for x in (t, t[: len(t) - n] + after[:n], after))
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own[2], edited[2])
        assert (r.near_edited, r.near_next) == pytest.approx((brute_likeness(own, edited), brute_likeness(own, other)))


def test_fingerprint_cases(cases, empty):
    rows = fingerprint.fingerprints(cases).collect()
    assert len(rows) == len(CASES)
    blank = hashlib.sha256(b"").hexdigest()
    assert all(r.edited_sha256 == blank and r.n_chars == 0 for r in rows if r.doc_id in (2, 3))
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_algebra(spark):
    rng = random.Random(5)
    sentences = [f"Sentence {k} {rng.random()}." for k in range(200)]
    shuffled = rng.sample(sentences, 200)
    whole, other, part, rest = " ".join(sentences), "\n".join(shuffled), " ".join(sentences[:150]), " ".join(sentences[150:])
    df = spark.createDataFrame([(whole, other, part, rest)], "a string, b string, c string, d string")
    for c in "abcd":
        df = df.withColumn(f"f{c}", fingerprint.fingerprint(c))
    df = df.select("fa", "fb", "fc", "fd", fingerprint.add("fc", "fd").alias("sum"), fingerprint.subtract("fa", "fd").alias("less"))
    r = df.select((F.col("fa") == F.col("fb")).alias("order"), (F.col("sum") == F.col("fa")).alias("sum"), (F.col("less") == F.col("fc")).alias("less"), fingerprint.likeness("fa", "fc").alias("near")).first()
    assert r.order and r.sum and r.less and abs(r.near - (1 - 50 / 350)) < 0.08


# Pseudonyms ----------------------------------------------------------------------------------------------


KEY = "a secret of the tests"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_pseudonyms(spark):
    rows = [(1, "Mail ann.90@mail2.example.com, card 4179672074533673 or 4179 6720 7453 3673, host 79.31.107.87!! +1 (911) 555-1477."), (2, 'token = "586908a7d09b9e9c999a9eb99999999a999bdde0" 2024-02-29 29.02.2024 30.02.2024 ann.90@mail2.example.com'), (3, "clean 4179672074533674 999.1.1.1 12345 1.2.3 half-life 3.5")]
    got = {r.doc_id: r for r in pseudonym.pseudonymise(table(spark, rows), KEY, count="n").collect()}
    assert (got[1].n, got[2].n, got[3].n) == (5, 4, 0) and got[3].text == rows[2][1]
    for gone in ("ann.90@", "4179672074533673", "79.31.107.87", "555-1477", "586908a7", "2024-02-29"):
        assert gone not in got[1].text + got[2].text
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[1].text)
    assert len(cards) == 2 and all(map(luhn, cards)) and cards[0] == cards[1].replace(" ", "")
    mail = [re.search(r"\S+@mail2\.example\.com", got[i].text).group() for i in (1, 2)]
    assert mail[0] == mail[1] and re.fullmatch(r"[a-z]{3}\.\d{2}@mail2\.example\.com", mail[0])
    iso, dotted = re.search(r"\d{4}-\d\d-\d\d", got[2].text).group(), re.findall(r"\d\d\.\d\d\.\d{4}", got[2].text)
    assert dotted[0] == "{2}.{1}.{0}".format(*iso.split("-")) and dotted[1] == "30.02.2024"
    assert all(int(o) < 256 for o in re.search(r"\d+\.\d+\.\d+\.\d+", got[1].text).group().split("."))
    other = pseudonym.pseudonymise(table(spark, rows), "another").where("doc_id = 1").first().text
    assert other != got[1].text


def test_pseudonyms_are_permutations(spark):
    days = spark.range(146_097).selectExpr("date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') as m")
    r = days.select(F.expr(pseudonym.pseudonym("m", KEY)).alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(r) == (146_097, "1800-01-01", "2199-12-31")
    small = spark.range(10_000).selectExpr("lpad(cast(id as string), 4, '0') as m").select(F.expr(pseudonym.permuted("m", "phone", KEY)).alias("p"))
    assert small.distinct().count() == 10_000


def noise(kind, r, other):
    return int(hashlib.sha256(f"{KEY}{kind}:{r}:{other}".encode()).hexdigest()[:12], 16)


def brute_permuted(value, kind, letters=26, wide=False):
    """The Feistel network over strings, by loops."""
    half = len(value) // 2
    sides = [list(value[:half]), list(value[half:])]
    classes = [(48, 57), (97, 96 + letters), (65, 64 + letters)] + (pseudonym.alphabets() if wide else [])
    for r in range(1, pseudonym.ROUNDS + 1):
        one, two = (0, 1) if r % 2 else (1, 0)
        seed = hashlib.sha256(f"{KEY}{kind}:{r}:{''.join(sides[two])}".encode()).hexdigest()
        for i, c in enumerate(sides[one]):
            low, high = next(((a, b) for a, b in classes if a <= ord(c) <= b), (ord(c), ord(c)))
            if wide and low == high == ord(c) and ord(c) > 127 and not any(a == ord(c) == b for a, b in classes):
                low, high = ord(c) - ord(c) % 64, ord(c) - ord(c) % 64 + 63
            block = hashlib.sha256(f"{seed}:{i // 12}".encode()).hexdigest()
            sides[one][i] = chr(low + (ord(c) - low + int(block[i % 12 * 5 :][:5], 16)) % (high - low + 1))
    return "".join(sides[0] + sides[1])


def brute_number(n, first, second, kind):
    a, b = divmod(n, second)
    for r in range(1, pseudonym.ROUNDS + 1):
        if r % 2:
            a = (a + noise(kind, r, b)) % first
        else:
            b = (b + noise(kind, r, a)) % second
    return a * second + b


def test_pseudonyms_equal_a_network_by_loops(spark):
    import datetime as dt

    rng = random.Random(8)
    mails = ["".join(rng.choices("abzAZ019._-éÉßжЯάшЀ名前ひカ한ƀ𐐀", k=rng.randint(1, 30))) + "x" for _ in range(60)]
    secrets = ["".join(rng.choices("0123456789abcdef", k=rng.randint(31, 60))) + "7a" for _ in range(20)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(20)]
    start = dt.date(1800, 1, 1)
    days = [str(start + dt.timedelta(rng.randrange(146_097))) for _ in range(20)]
    want = {f"{m}@ex.org": f"{brute_permuted(m, 'email', wide=True)}@ex.org" for m in mails} | {m: brute_permuted(m, "secret", 6) for m in secrets}
    for m in ips:
        n = brute_number(int.from_bytes(bytes(map(int, m.split(".")))), 65536, 65536, "ip")
        want[m] = ".".join(map(str, n.to_bytes(4)))
    for m in days:
        want[m] = str(start + dt.timedelta(brute_number((dt.date.fromisoformat(m) - start).days, 27, 5411, "date")))
    got = spark.createDataFrame([(m,) for m in want], "m string").select("m", F.expr(pseudonym.pseudonym("m", KEY)).alias("p")).collect()
    assert {r.m: r.p for r in got} == want


def test_names_in_other_scripts_do_not_stay(spark):
    rows = [(1, "An иван.петров@example.com, ann@example.com; 李小龍@例.example.com"), (2, "ж@a.b"), (3, "иван@localhost")]
    got = {r.doc_id: r for r in pseudonym.pseudonymise(table(spark, rows), KEY, count="n").collect()}
    assert "иван" not in got[1].text and "ann@" not in got[1].text and got[1].n == 2
    assert re.fullmatch(r"An [а-я]{4}\.[а-я]{6}@example\.com, [a-z]{3}@example\.com; 李小龍@例\.example\.com", got[1].text)
    assert got[3].n == 0


def test_long_texts_without_ends(spark):
    import time

    rows = [(k, c * 50_000) for k, c in enumerate(["a", "1", "a.", "ab@", "1 ", "f0", "(1", "+1 ", "1.", "a@b.c"])]
    start = time.time()
    got = {r.doc_id: r.text for r in pseudonym.pseudonymise(table(spark, rows), KEY).collect()}
    assert time.time() - start < 60 and all(got[k] == t for k, t in rows[:3])


def test_pseudonym_cases(cases, empty):
    out = pseudonym.pseudonymise(cases, KEY)
    assert out.columns == cases.columns
    assert Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == Counter(CASES)
    assert pseudonym.pseudonymise(empty, KEY).count() == 0


# Id store ------------------------------------------------------------------------------------------------------


def test_id_store(spark, cases, empty):
    path = scratch(spark, "test")
    rows = idstore.store(cases, path, word_encoder, 2).collect()
    ids = library("word_bpe_49k.json", [t for _, t in CASES], 2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for (i, _), e in zip(CASES, ids))
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    assert idstore.store(empty, scratch(spark, "test"), word_encoder, 2).count() == 0


def test_id_store_keeps_shared_chunks_once_and_finds_damage(spark):
    rng = random.Random(1)
    shared = " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(3000))
    docs = [(k, f"{rng.random()} {shared} {rng.random()}") for k in range(6)]
    path = scratch(spark, "test")
    idstore.write(table(spark, docs), path, word_encoder, 2)
    chunks = spark.read.parquet(f"{path}/chunks").where("kind = 'chunk'")
    assert chunks.agg(F.sum("n")).first()[0] < 0.35 * idstore.read(spark, path).agg(F.sum("n_tokens")).first()[0]
    bad = scratch(spark, "bad")
    idstore.write(table(spark, docs), bad, word_encoder, 2)
    whole = spark.read.parquet(f"{bad}/chunks").where("kind = 'chunk'").drop("kind").orderBy("digest").collect()
    broken = [(r.digest, bytes(reversed(r.payload)) if k == 0 else r.payload, r.n, r.doc_id, r.recipe, r.root) for k, r in enumerate(whole)]
    spark.createDataFrame(broken, "digest binary, payload binary, n int, doc_id long, recipe binary, root binary").write.mode("overwrite").parquet(f"{bad}/chunks/kind=chunk")
    with pytest.raises(Exception, match="does not match its digest"):
        idstore.read(spark, bad).collect()


def test_id_store_finds_what_is_gone(spark):
    docs = [(k, f"a text of its own {k} " * 30) for k in range(8)]
    for gone in ("manifest", "recipes"):
        path = scratch(spark, "test")
        idstore.write(table(spark, docs).repartition(2), path, word_encoder, 2)
        idstore.read(spark, path).collect()
        rows = spark.read.parquet(f"{path}/{gone}")
        left = spark.createDataFrame(rows.orderBy("pid").collect()[1:], rows.schema)
        left.write.mode("overwrite").parquet(f"{path}/{gone}")
        with pytest.raises(Exception, match="do(es)? not match"):
            idstore.read(spark, path).collect()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=9), max_size=40))
def test_forest_is_the_merkle_tree(leaves):
    tree = idstore.Forest()
    for x in leaves:
        tree.add(x)
    assert tree.root() == idstore.merkle(leaves)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_crc_of_parts(parts):
    after = [sum(map(len, parts[k + 1 :])) for k in range(len(parts))]
    got = np.bitwise_xor.reduce(idstore.shifted(np.array([zlib.crc32(p) for p in parts]), np.array(after)))
    assert int(got) == zlib.crc32(b"".join(parts))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 6000), st.integers(0, 50))
def test_chunks_cover(n, seed):
    ids = np.random.default_rng(seed).integers(0, 50_000, n + 1).astype(np.uint16)
    [ends] = idstore.cuts(ids, np.array([0, n + 1]))
    size = np.diff([0, *ends])
    assert ends[-1] == n + 1 and (size <= idstore.MAX).all() and (size[:-1] >= idstore.MIN).all() and (size > 0).all()


# Page text -----------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, host int")


def test_marked_pages(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><script>var a="</p><article>no</article>";</script></head><body><header>No</header><nav><ul><li>No</li></ul></nav>
    <div class="ad-box">No</div><article><h1>A &amp; B</h1><p>one <b>two</b>
      three<br>four<p>five &lt;six&gt; &eacute;<aside>No</aside><form><p>No</form><section id="comments"><p>No</p></section><p>seven</p></article><!-- <p>No</p> --><footer>No</footer>"""
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/2", ""), (4, "::", "<article></article>"), (None, "http://a.example/1", page), (5, "x", "<main><p>in main</main> out"), (6, "y", "<article><p>cut off <b>here")]
    got = {(r.page_id, r.text) for r in hostextract.extract(pages(spark, rows)).collect()}
    text = "A & B\n\none two three four\n\nfive <six> é\n\nseven"
    assert got == {(1, text), (2, ""), (3, ""), (4, ""), (None, text), (5, "in main"), (6, "cut off here")}
    assert hostextract.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("group", [2000, 3])
def test_host_arrays_remove_what_pages_share(spark, group):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=7))
    notice = "this site belongs to nobody and shows the very same words on every page"
    own = [" ".join(word() for _ in range(30)) for _ in range(12)]
    rows = [(k, f"http://www.host{k % 2}.example/{k}", f"<html><body><div><p>{t}</p><p>{notice}</p></div></body></html>") for k, t in enumerate(own)]
    rows += [(99, "http://single.example/", f"<p>{own[0]}</p><p>{notice}</p>")]
    got = {r.page_id: r.text for r in hostextract.extract(pages(spark, rows), group_pages=group).collect()}
    assert got == {**dict(enumerate(own)), 99: f"{own[0]}\n\n{notice}"}


def test_pages_that_only_seem_marked_meet_the_host(spark):
    rng = random.Random(5)
    notice = "this site belongs to nobody and shows the very same words on every page"
    own = [" ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(30)) for _ in range(4)]
    marks = ["<script>var a='<article>'</script>", "<!-- <main> -->", "<article></article>", "<nav><article>No</article></nav>"]
    rows = [(k, "http://host.example/", f"<html><body>{m}<p>{t}</p><p>{notice}</p></body></html>") for k, (t, m) in enumerate(zip(own, marks))]
    assert {r.page_id: r.text for r in hostextract.extract(pages(spark, rows)).collect()} == dict(enumerate(own))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='has-sidebar'><article><p>kept</p>", ["kept"]),
        ("<article class='post related-posts'><p>kept</p></article>", ["kept"]),
        ("<div class='no-comments'><article><p>kept</p></article></div>", ["kept"]),
        ("<nav><a>No</a><div><article><p>kept</p></article></div>", ["kept"]),
        ("<div><nav>No</div><article><p>kept</p></article>", ["kept"]),
        ("<p title=don't>one</p><p>it's two</p>", ["one", "it's two"]),
        ("<article></article><p>not marked</p>", ["not marked"]),
        ("<main><div class='breadcrumbs'>No</div><article><header><h1>T</h1></header><p>a<p>b<ul><li>x<li>y</ul></article><section class='comments'><article><p>No</p></article></section></main>", ["T", "a", "b", "x", "y"]),
        ("a < b and <3 c <b>d</b>", ["a < b and <3 c d"]),
        ("<ul><li class=ad>No<li>yes</ul>", ["yes"]),
        ("<article><p class=share>No<p>yes<table><tr><td>a<td>b<tr><td>c</table></article>", ["yes", "a", "b", "c"]),
        ("<header><h1>No</h1><main><p>y</p></main></header>", ["y"]),
        ('<a href=x title="a > b">link</a>', ["link"]),
    ],
)
def test_blocks(page, want):
    assert hostextract.blocks(page)[0] == want


def test_long_pages(spark):
    text = " ".join(f"w{k}" for k in range(150_000))
    got = hostextract.extract(pages(spark, [(1, "http://a.example/", f"<article><p>{text}</p></article>"), (2, "http://a.example/", f"<p>{text} end</p>")])).collect()
    assert {r.page_id: r.text for r in got}[1] == text


def test_reading_takes_linear_time():
    import time

    begun = time.time()
    for part in ("<a href=\"x ' ", "<", "<a ", "</p>", "<div>", "<!--", "<script>", "<a b='", '<p a="x" b=\'', "&amp;", "<nav>", "<a class=ad>", "<b>", "<p>x", "<li>", "< "):
        hostextract.blocks(part * (500_000 // len(part)) + "<p>x</p>")
    assert time.time() - begun < 30


def test_loose_blocks_of_articles_go_if_they_repeat(spark):
    rng = random.Random(6)
    own = [" ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(30)) for _ in range(6)]
    shared = "one passage that is quoted by every article of this host"
    page = "<body><article><p>%s</p><p>%s</p><div>please read our other fine pages about very similar things</div></article>"
    rows = [(k, "http://host.example/", page % (t, shared)) for k, t in enumerate(own)]
    for group in (2000, 2):
        assert {r.page_id: r.text for r in hostextract.extract(pages(spark, rows), group_pages=group).collect()} == {k: f"{t}\n\n{shared}" for k, t in enumerate(own)}


def test_mirrors_do_not_empty_each_other(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"http://host.example/{k}", f"<p>{text}</p>") for k in range(3)]
    assert {r.text for r in hostextract.extract(pages(spark, rows)).collect()} == {text}


def test_covered_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        texts = [rng.integers(0, 3, rng.integers(0, 40)) for _ in range(4)]
        got = hostextract.covered(texts, [0, 1, 2, 2], 4)
        who = [0, 1, 2, 2]
        for p, mask in enumerate(got):
            want = np.zeros(len(texts[p]), bool)
            for k in range(len(texts[p]) - 3):
                run = texts[p][k : k + 4].tolist()
                if any(who[q] != who[p] and any(texts[q][j : j + 4].tolist() == run for j in range(len(texts[q]) - 3)) for q in range(4)):
                    want[k : k + 4] = True
            assert (mask == want).all()


def test_ranks_are_those_of_the_file():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        a, b = f.readline().split()
    assert RANKS[base64.b64decode(a)] == int(b)
