"""Token counts, packing, media and language-model scoring against brute force."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkstead.llm import hmm, media, packing, queries, token_counts
from larkstead.llm.common import saved, word_column, words_of
from larkstead.llm.labelled import remainder

from .conftest import words

DATA = "/root/testdata/sf0.001"
PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


# Token counts

def best(token, pieces):
    """(score, tokens) of the best segmentation, without a trie."""
    at = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        n = len(token[i - 1].encode())
        options = [(at[k][0] + pieces[token[k:i]], at[k][1] + 1) for k in range(i) if token[k:i] in pieces]
        if token[i - 1] not in pieces:
            options.append((at[i - 1][0] + n * token_counts.BYTE_SCORE, at[i - 1][1] + n))
        at.append(min(options, key=lambda x: (-x[0], x[1])))
    return at[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=20))
def test_trie_counts_match_separate_programs(tokens):
    pieces = token_counts.vocabulary(PIECES)
    trie = token_counts.Trie(pieces)
    for t in tokens + tokens:
        t = t.encode("utf-8", "replace").decode()
        assert trie.count("▁" + t) == best("▁" + t, pieces)[1]


def test_trie_shares_prefixes():
    trie = token_counts.Trie(token_counts.vocabulary(PIECES))
    trie.count("▁inform")
    nodes = trie.nodes
    trie.count("▁information")
    assert trie.nodes == nodes + len("ation")


def test_token_counts_edges(documents, odd_rows):
    got = [tuple(r) for r in token_counts.token_counts(documents(odd_rows), PIECES).collect()]
    pieces = token_counts.vocabulary(PIECES)
    assert len(got) == len(odd_rows)
    by = {i: (w, n) for i, w, n in got}
    assert by[1] == by[2] == by[3] == (0, 0)
    parts = token_counts.PRE_TOKENS.findall("One"), token_counts.PRE_TOKENS.findall("two"), token_counts.PRE_TOKENS.findall("three")
    assert by[4] == (3, sum(best("▁" + p[0], pieces)[1] for p in parts))
    assert by[6][0] == 60_000
    assert token_counts.token_counts(documents([]), PIECES).count() == 0


# Packing

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_uses_every_length_once(lengths):
    made = packing.plan(dict(Counter(lengths)), 64)
    assert Counter(n for pattern, c in made for n in pattern * c) == Counter(lengths)
    assert all(sum(p) <= 64 for p, _ in made)


def test_exact_complements_are_found():
    assert [len(p) for p, _ in packing.plan({60: 1, 4: 1}, 64)] == [2]
    assert [len(p) for p, _ in packing.plan({40: 1, 20: 1, 4: 1}, 64)] == [3]
    assert [len(p) for p, _ in packing.plan({40: 1, 12: 1, 8: 1, 4: 1, 23: 0}, 64)][0] == 4
    many = packing.plan({40: 10**9, 24: 10**9}, 64)
    assert many == [([40, 24], 10**9)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=8), st.lists(st.integers(0, 7), max_size=6), st.integers(1, 40))
def test_index_finds_what_enumeration_finds(counts, gone, total):
    """Singles, pairs and triples under the counts, also after some were taken."""
    left, stock = packing.Lengths(counts, 40), Counter(counts)
    left.exact(total)
    for i in gone:
        own = sorted(n for n, c in stock.items() if c)
        if own:
            left.take(own[i % len(own)])
            stock[own[i % len(own)]] -= 1
    items = sorted(stock.elements())
    ways = {sum(x) for k in (1, 2, 3) for x in itertools.combinations(items, k)}
    found = left.exact(total)
    assert bool(found) == (total in ways) and (not found or sum(found) == total and not Counter(found) - stock)


def test_packing_of_real_documents_is_close_to_the_bound(spark):
    got = queries.op3_best_fit_packing(spark, "/root/testdata/sf0.001").toPandas()
    used, bound = got["sequence_id"].nunique(), -(-int(got["length"].sum()) // 4096)
    assert bound <= used <= 1.02 * bound + 1


def test_plan_is_close_to_the_bound():
    rng = random.Random(4)
    lengths = [min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    made = sum(c for _, c in packing.plan(dict(Counter(lengths)), 4096))
    assert made <= 1.01 * -(-sum(lengths) // 4096)


def test_packing_matches_the_tokenizer(documents, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = odd_rows + [(20, "x <|endoftext|>y it's 12%%% ΣΑΣ İ")]
    pieces = packing.tokenise(documents(rows), BPE, 512)
    got = packing.pack(pieces, 512).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    parts = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert list(r["token_ids"]) == own and r["piece"] * 512 == r["start"]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        parts[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in rows)
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(packing.tokenise(documents([]), BPE, 512), 512).count() == 0


# Media

def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "b" * 50)
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\x00\x03\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0"
    return {"image/png": png(), "application/zip": held.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "image/bmp": bmp, "image/gif": gif, "image/jpeg": jpeg, "application/pdf": pdf, "audio/midi": midi, "audio/wav": media.wave(b"ab" * 40)}


def test_sniff_validate_and_carve():
    for kind, data in samples().items():
        assert media.sniff(data)[0] == (kind, 0, len(data)), kind
        held = b"text BM PK\x03\x04 RIFF %PDF- " + data + b" tail GIF89a"
        assert (kind, 24, len(data)) in media.sniff(held), kind
        assert not [x for x in media.sniff(data[: len(data) // 2]) if x[1] == 0 and x[0] == kind], kind
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == []


def test_wrong_types_are_corrected(spark):
    rows = [(i, "text/plain", bytes(x)) for i, x in enumerate(samples().values())] + [(90, "image/png", b"nothing"), (91, None, None)]
    df = spark.createDataFrame(rows, "id int, media_type string, media binary")
    got = {r["id"]: r for r in media.inspect_media(df, ["id"]).collect()}
    assert [got[i]["detected_type"] for i in range(len(samples()))] == list(samples()) and all(got[i]["corrected"] for i in range(len(samples())))
    assert got[90]["detected_type"] == media.UNKNOWN and got[91]["media_bytes"] == 0


def test_media_round_trip(documents, odd_rows):
    df = documents(odd_rows)
    stored = media.store_texts(df)
    got = media.inspect_media(stored, ["doc_id", "n_bytes"]).collect()
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append((t or "").encode())
    assert len(got) == len(odd_rows)
    for r in got:
        raw = texts[r["doc_id"]][0]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.wave(padded)).hexdigest() and r["detected_type"] == "audio/wav" and not r["corrected"]
    assert media.inspect_media(media.store_texts(documents([])), ["doc_id"]).count() == 0


# Language model

def test_expected_counts_match_enumeration():
    rng = np.random.default_rng(1)
    flat = rng.random(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES)
    model = hmm.Hmm.from_counts(flat)
    obs = [np.array([3, 5, 3]), np.array([hmm.END])]
    total = np.zeros_like(flat)
    logs = []
    for o in obs:
        paths = np.stack(np.meshgrid(*[range(hmm.STATES)] * len(o), indexing="ij"), -1).reshape(-1, len(o))
        weight = np.array([model.start[p[0]] * model.emit[o[0], p[0]] * math.prod(model.move[p[t - 1], p[t]] * model.emit[o[t], p[t]] for t in range(1, len(o))) for p in paths])
        logs.append(math.log10(weight.sum()))
        k = hmm.STATES
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            total[p[0]] += w
            for t in range(len(o)):
                if t:
                    total[k + p[t - 1] * k + p[t]] += w
                total[k + k * k + o[t] * k + p[t]] += w
    assert np.allclose(hmm.all_expected(model, obs), total)
    assert np.allclose(hmm.forward(model, obs), logs)


def test_model_is_a_distribution():
    model = hmm.Hmm.random(np.ones(hmm.CLASSES))
    assert np.isclose(model.start.sum(), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.emit.sum(0), 1)


def test_scores_match_brute_force(documents, odd_rows):
    rows = odd_rows + [(i, f"the quick w{i % 7} fox THE end rare{i}") for i in range(100, 160)]
    df = documents(rows)
    held = remainder("doc_id", 10) == 0
    vocabulary = hmm.vocabulary(df.where(~held).select(F.col("text").alias("t")))
    encoded = saved(hmm.encode(df, vocabulary, held))
    model = hmm.train(encoded.where("not held_out"), passes=1)
    got = hmm.score(encoded, vocabulary, model).collect()
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not is_held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    own = defaultdict(list)
    for i, t in rows:
        own[i].append([*words(t), None])
    assert len(got) == len(rows)
    # Classes by another way: the most frequent words are their own, others share one by their ending.
    single = set(sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], w.encode()))[: hmm.OWN])
    share = defaultdict(lambda: [0, 0])
    for w, c in counts.items():
        if w is not None and w not in single:
            share[hmm.shared_class(w.encode())][0] += c
            share[hmm.shared_class(w.encode())][1] += 1
    numbers = {w: i for i, w in enumerate(sorted(single, key=lambda w: (-counts[w], w.encode())))}

    def model_score(tokens):
        total, a = 0.0, model.start
        for t, w in enumerate(tokens):
            c = hmm.END if w is None else numbers[w] if w in single else hmm.shared_class(w.encode())
            a = (a if t == 0 else a @ model.move) * model.emit[c]
            total += math.log10(a.sum())
            a = a / a.sum()
            if w is not None and w not in single:
                n_class, v_class = share[c]
                total += math.log10((counts[w] + 0.1) / (n_class + 0.1 * (v_class + 1)))
        return total

    for r in got:
        tokens = own[r["doc_id"]][0]
        assert math.isclose(r["score"], model_score(tokens), rel_tol=1e-9)
        assert r["held_out"] == is_held(r["doc_id"]) and r["train_tokens"] == n and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0


def test_model_beats_the_base_on_held_out_texts(spark):
    got = queries.op7_lm_scoring(spark, DATA).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_empty_language_model(documents):
    df = documents([])
    vocabulary = hmm.vocabulary(df.select(F.col("text").alias("t")))
    encoded = saved(hmm.encode(df, vocabulary, F.lit(False)))
    model = hmm.train(encoded)
    assert hmm.score(encoded, vocabulary, model).count() == 0
    one = hmm.encode(documents([(10, "a b")]), vocabulary, F.lit(True))
    assert hmm.score(one, vocabulary, model).first()["n_known"] == 0


def test_long_texts_are_trained_unbroken(monkeypatch):
    """Expected counts of 10,000 tokens by a plain forward-backward; gathering in any portions gives the same."""
    rng = np.random.default_rng(2)
    model = hmm.Hmm.random(np.ones(hmm.CLASSES))
    obs = [rng.integers(0, hmm.CLASSES, n) for n in (10_000, 1, 2500, 40, 40, 2048, 7)]
    want, k = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES), hmm.STATES
    for o in obs:
        alpha, beta = np.zeros((len(o), k)), np.ones((len(o), k))
        for t in range(len(o)):
            a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[o[t]]
            alpha[t] = a / a.sum()
        for t in range(len(o) - 2, -1, -1):
            b = model.move @ (model.emit[o[t + 1]] * beta[t + 1])
            beta[t] = b / b.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        want[:k] += gamma[0]
        for t in range(1, len(o)):
            x = alpha[t - 1][:, None] * model.move * (model.emit[o[t]] * beta[t])[None]
            want[k : k + k * k] += (x / x.sum()).ravel()
        np.add.at(want[k + k * k :].reshape(hmm.CLASSES, k), o, gamma)
    assert np.allclose(hmm.all_expected(model, obs), want)
    monkeypatch.setattr(hmm, "TOKENS", 50)
    monkeypatch.setattr(hmm, "LONG_TOKENS", 3000)
    assert np.allclose(hmm.all_expected(model, obs), want)


def test_forward_is_scaled_every_few_steps(monkeypatch):
    """Logarithms are taken at each SCALED-th step and where texts end, not at each step; rare classes don't underflow."""
    flat = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES)
    flat[hmm.STATES + hmm.STATES**2 :] = 1e-3
    flat[hmm.STATES + hmm.STATES**2 + hmm.STATES * 5 :][: hmm.STATES] = 1e12
    model = hmm.Hmm.from_counts(flat)
    obs = [np.full(n, 9) for n in (4001, 4000, 12, 1)]
    want = []
    for o in obs:
        total, a = 0.0, model.start
        for t, c in enumerate(o):
            a = (a @ model.move if t else a) * model.emit[c]
            total += math.log10(a.sum())
            a = a / a.sum()
        want.append(total)
    plain, calls = np.log10, []
    monkeypatch.setattr(np, "log10", lambda x: calls.append(1) or plain(x))
    assert np.allclose(hmm.forward(model, obs), want, rtol=1e-12)
    assert len(calls) <= 4001 / 8 + len(obs)
    assert np.isclose(hmm.all_expected(model, obs)[hmm.STATES + hmm.STATES**2 :].reshape(hmm.CLASSES, hmm.STATES)[9].sum(), sum(map(len, obs)))


def test_rare_words_are_counted_in_whole_numbers(documents, monkeypatch):
    """With a small head nearly all words go through the join; it adds up whole numbers, no decimals."""
    monkeypatch.setattr(hmm, "HEAD", 3)
    rows = [(i, " ".join(f"w{i * j % 23} W{j % 7}" for j in range(i % 40)) + f" once{i} x\x1cy É 漢{i}字 b{i}éé") for i in range(60)] + [(7, None), (None, "w1 w1 new")]
    df, held = documents(rows), remainder("doc_id", 10) == 0
    monkeypatch.setattr(hmm, "BATCH_BYTES", 500)
    vocabulary = hmm.vocabulary(df.where(~held).select(F.col("text").alias("t")))
    encoded = saved(hmm.encode(df, vocabulary, held))
    scored = hmm.score(encoded, vocabulary, hmm.train(encoded.where("not held_out"), passes=1))
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not is_held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, sum(counts[w] > 0 for w in [*words(t), None]), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 8)) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_known"], round(r["base_score"], 8)) for r in scored.collect()) == want
    shares = [[c for w, c in counts.items() if w is not None and w.encode() not in vocabulary.classes and hmm.shared_class(w.encode()) == hmm.OWN + k] for k in range(hmm.SHARED)]
    assert len(vocabulary.classes) == 3 and np.allclose(vocabulary.below, [math.log10(sum(x) + 0.1 * (len(x) + 1)) for x in shares])
    assert "decimal" not in scored._jdf.queryExecution().optimizedPlan().toString().lower()


def test_words_of_a_column_are_those_of_each_text():
    rng = random.Random(5)
    bits = [bytes([i]) for i in range(256)] + [b" ", b"\n", b"\x0b", b"\r", b"A", "É".encode(), "\u3000".encode()] * 20
    for k in range(300):
        texts = [None if rng.random() < 0.1 else b"".join(rng.choices(bits, k=rng.randrange(20))) for _ in range(rng.randrange(1, 7))]
        found, sizes = word_column(pa.array(texts, pa.binary()).slice(k % 2))
        want = [words_of(t or b"") for t in texts[k % 2 :]]
        assert sizes.tolist() == [len(x) for x in want] and found.to_pylist() == [w for x in want for w in x]


def test_the_head_is_full_whatever_the_ties(spark):
    words_of_one_count = spark.range(5000).select(F.concat(F.lit("w"), "id").cast("binary").alias("w"), F.lit(3).cast("long").alias("n"))
    for counts, most in ((words_of_one_count, 700), (words_of_one_count.union(spark.sql("select cast(concat('f', id) as binary), id + 100 from range(300)")), 700), (words_of_one_count, 9000)):
        head = hmm.frequent(counts, most)
        assert len(head) == min(most, counts.count()) and head == hmm.frequent(counts.repartition(7), most)
        if counts is not words_of_one_count:
            assert [n for n in head.values() if n > 3] == list(range(399, 99, -1))


def test_a_very_long_word_keeps_the_trie_small():
    pieces = token_counts.vocabulary(PIECES)
    trie = token_counts.Trie(pieces)
    rng = random.Random(3)
    for token in ("a" * 300, "▁" + "".join(rng.choice("thenigo") for _ in range(500)), "=" * 200, "é漢" * 70):
        assert trie.count(token) == best(token, pieces)[1]
    assert trie.count("ab" * 100_000) == best("ab" * 2000, pieces)[1] * 50 and trie.nodes < 1000


def test_streams_are_inflated_in_steps():
    import gzip
    import tracemalloc

    bomb = b"x" + gzip.compress(bytes(300 << 20)) + b"tail"
    tracemalloc.start()
    assert media.sniff(bomb) == [("application/gzip", 1, len(bomb) - 5)]
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert media.sniff(bomb[:-200]) == []
    pdf = b"%PDF-1.4 a startxref 1 %%EOF b startxref 2 %%EOF "
    assert [(t, at, n) for t, at, n in media.sniff(pdf + pdf)] == [("application/pdf", 0, len(pdf) - 1), ("application/pdf", len(pdf), len(pdf) - 1)]


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_best_fit_packing", "op9_media_columns"])
def test_queries_cover_all_documents(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
