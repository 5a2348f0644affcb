"""Joins, dedup, mixing, classifiers, search and the pipeline against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkstead.llm import common, jaccard, knn, line_dedup, mixing, quality, queries, stages, toxicity

from .conftest import WORD, words

DATA = "/root/testdata/sf0.001"


# Shared parts

@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aA bß\n\x1f\t0", max_size=30), max_size=8))
def test_word_hashes_are_per_word_and_text(texts):
    raw = [t.encode() for t in texts]
    h, counts = common.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts] and len(h) == len(flat)
    seen = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_sequences_have_no_structural_collisions(documents):
    """The Thue-Morse word and its complement collide under any polynomial modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    h, _ = common.word_hashes(np.frombuffer(f"{word} {other}".encode(), np.uint8), np.array([0, 2 * 4096 + 1]))
    assert len(set(h.tolist())) == 2
    rows = [(1, word), (2, other), (3, " ".join(word)), (4, " ".join(other))]
    assert len({r["component_id"] for r in jaccard.join(documents(rows[:2])).collect()}) == 2
    assert all(r["n_removed"] == 0 for r in line_dedup.dedup(documents(rows), least=5, run=200).collect() if r["doc_id"] < 3)
    assert len(set(line_dedup.lines_of(np.tile(h, 2048)[np.array([int(c == "b") for c in word + other])], np.arange(8192) % 4096 == 0, np.zeros(8192, int), 5)[0].tolist())) == 2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(-7, 3), (9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, F.lit("hot")).when(F.col("id") < 2950, F.lit(None).cast("string")).otherwise(F.lit("x")).alias("g"), F.col("id"), F.xxhash64("id").alias("h"))
    ranks = defaultdict(list)
    for r in common.rank_in_groups(df, ["g"], "h", ["id"]).collect():
        ranks[r["g"]].append((r["h"], r["rank"]))
    for own in ranks.values():
        assert [k for _, k in sorted(own)] == list(range(len(own)))


# Jaccard join

def components_by_force(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = tuple(words(t))
        sets.append((i, frozenset(w[j : j + k] for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([w] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)), key=str)


def family_rows(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, i = [], 0
    for size in (1, 1, 1, 2, 5, 40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, " ".join(own).capitalize()))
            i += 1
        rows.append((i, " ".join(base)))
        rows.append((i + 1, " ".join(base + passage)))
        i += 2
    # A chain whose ends don't link.
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for step in range(6):
        rows.append((i + step, " ".join(chain[step * 3 :] + [f"c{x}" for x in range(step * 3)])))
    return rows + [(i + 10 + j, "only three words") for j in range(3)]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_matches_all_pairs(documents, odd_rows, k, num):
    rows = [(None if i is None else i + 1000, t) for i, t in odd_rows] + family_rows()
    got = jaccard.join(documents(rows), k, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows, k, num, 100)


def test_jaccard_on_frequent_shingles(documents):
    """Enough copies around one text that its shingles are frequent."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(220):
        own = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = jaccard.join(documents(rows), 4, 85, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows, 4, 85, 100)


def test_jaccard_of_longer_copies_in_a_leading_text(documents):
    """Copies with words appended or cut, all quoted in a longer text that has more copies and so leads."""
    rng = random.Random(6)
    rows = []
    for f in range(80):
        w, extra = ([f"{x}{f}_{i}" for i in range(n)] for x, n in (("q", 23), ("y", 14)))
        longer = w + extra[:2] if f % 2 else extra[:2] + w
        for t in (w, longer, *[w + extra[2 : 2 + rng.randint(4, 12)]] * 3):
            rows.append((len(rows), " ".join(t)))
    got = jaccard.join(documents(rows), 4, 85, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows, 4, 85, 100)


def links_by_force(rows, k, num, den):
    """(id, links with other rows, links with other sets) of each row."""
    sets = [(i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset()) for i, t in rows]
    linked = {s: {t for _, t in sets if s and t and den * len(s & t) >= num * len(s | t)} for _, s in sets}
    copies = Counter(s for _, s in sets)
    return sorted(((i, max(0, sum(copies[t] for t in linked[s]) - 1), len(linked[s] - {s})) for i, s in sets), key=str)


@pytest.mark.parametrize("k,num,cell,size", [(4, 85, 256, 1 << 20), (4, 85, 4, 1 << 20), (5, 80, 256, 1500), (2, 60, 8, 1 << 20)])
def test_jaccard_counts_all_links(documents, odd_rows, monkeypatch, k, num, cell, size):
    """Links within a group of near copies too, be it one cell or many; copies count, and make no pairs."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "CELL_BYTES", size)
    rows = [(None if i is None else i + 1000, t) for i, t in odd_rows] + family_rows()
    got = jaccard.join(documents(rows), k, num, 100).collect()
    want = links_by_force(rows, k, num, 100)
    assert sorted(((r["doc_id"], r["links"], r["class_links"]) for r in got), key=str) == want
    assert max(c for _, _, c in want) > 2


def test_overlaps_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "TOKENS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-40, 40, n)) for n in (30, 0, 50, 9, 1, 60)]
    flat = lambda some: (np.concatenate(some), np.cumsum([0, *map(len, some)]))
    got = jaccard.overlaps(*flat(sets[:2]), *flat(sets[2:]))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]
    assert jaccard.overlaps(*flat([sets[1]]), *flat([sets[1]])).tolist() == [[0]]


def test_jaccard_edges(documents):
    assert jaccard.join(documents([]), 4, 85, 100).count() == 0
    got = jaccard.join(documents([(1, None), (2, None)]), 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["component_id"], r["links"]) for r in got) == [(1, 1, 0), (2, 2, 0)]


# Line dedup

def dedup_by_force(rows, run):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone, own = [False] * len(w), {}
        for p in range(len(w) - run + 1):
            k = tuple(w[p : p + run])
            if k in own or seen.get(k, i) != i:
                gone[p : p + run] = [True] * run
            own[k] = True
        for k in own:
            seen.setdefault(k, i)
        out.append((i, [x for x, g in zip(WORD.findall(t or ""), gone, strict=True) if not g], t is None))
    return sorted(out, key=str)


def passages(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    shared, rows = text(60), []
    for i in range(40):
        own = text(rng.randint(0, 150))
        cut = rng.randint(0, len(own))
        rows.append((i, own if i % 3 else own[:cut] + f"\n{shared} " + own[cut:]))
    rows += [(50, rows[4][1]), (51, rows[4][1].upper()), (52, text(30) + " " + " ".join(["same"] * 300)), (53, shared), (54, text(49)), (55, " ".join(rows[7][1].split()[:49])), (56, shared.replace(" ", "\n\n"))]
    return rows


@pytest.mark.parametrize("run,line", [(50, 16), (10, 4), (5, 5)])
def test_line_dedup_matches_brute_force(documents, odd_rows, run, line):
    rows = [r for r in odd_rows if r[0] not in (4, None)] + [(None, passages()[0][1])] + [(i + 100, t) for i, t in passages()]
    got = line_dedup.dedup(documents(rows), run=run, line=line).collect()
    mine = sorted(((r["doc_id"], WORD.findall(r["text"] or ""), r["text"] is None) for r in got), key=str)
    assert mine == dedup_by_force(rows, run)
    n = {i: len(words(t)) for i, t in rows}
    assert all(r["n_removed"] == n[r["doc_id"]] - len(words(r["text"])) for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "score", "length", "n_removed"}


def lines_by_force(rows, run, least):
    """(words kept, words removed) by text, ids being unique: units of lines and runs of words whose words occur earlier go; whole copies go."""
    seen, texts, out = set(), set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, lines, at = words(t), [], 0
        for x in re.split("[\n\x0b\x0c\r]", t or ""):
            lines.append((at, len(words(x))))
            at += len(words(x))
        lines = [x for x in lines if x[1]]
        units = {(p, p + run, "run") for p in range(len(w) - run + 1)}
        for j in range(len(lines)):
            for step in (1, -1):
                k, n = j, lines[j][1]
                while n < least and 0 <= k + step < len(lines):
                    k += step
                    n += lines[k][1]
                if n >= least:
                    first = lines[min(j, k)][0]
                    units.add((first, first + n, "lines"))
        gone, own = [False] * len(w), set()
        for a, b, kind in sorted(units):
            key = (kind, tuple(w[a:b]))
            if key in seen or key in own:
                gone[a:b] = [True] * (b - a)
            own.add(key)
        kept = [] if t in texts else [x for x, g in zip(WORD.findall(t or ""), gone, strict=True) if not g]
        out[i] = kept, len(w) - len(kept)
        seen |= own
        texts.add(t)
    return out


def line_rows():
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 12, 30, 300) for _ in range(3)]
    rows = [(i, rng.choice("\n\r\f").join((t.upper() if rng.random() < 0.3 else t.replace(" ", "  ")) for t in (rng.choice([*pool, f"own line {i} {j} of text", f"few {i}"]) for j in range(rng.randint(1, 6))))) for i in range(80)]
    rows += [(90 + i, t) for i, t in enumerate(["Home\nAbout us\n\nfive words of a line\nTop", "Home\nAbout us\nfive words\nof a line\nTop", "other\nfive words of a line\nTop"])]
    return [*rows, (100, "two words"), (101, "two words"), (102, " \n "), (103, " \n "), (104, None), (105, None)]


def test_line_dedup_deletes_real_lines_and_short_copies(spark, tmp_path):
    rows = line_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (WORD.findall(r["text"] or ""), r["n_removed"]) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    force = lines_by_force(rows, 50, 5)
    assert got == force and force[101] == ([], 2) and force[92][0] == ["other"]


def test_a_short_line_in_many_texts_stays_once(documents):
    line = "this line of ten words is in each document here"
    got = line_dedup.dedup(documents([(i, f"text of number {i} alone\n{line}\nend of {i} it is") for i in range(50)]), least=5).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [10] * 49


def test_line_dedup_with_text_ids_and_any_columns(spark):
    """String ids; columns named as the operator's own."""
    rows = [("b", "x y z u v w", 1, 2, 3, 4), ("a", "X y z u v w", 1, 2, 3, 4), (None, "x y z u v w\nq", 1, 2, 3, 4), ("", None, 1, 2, 3, 4)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id string, text string, _i int, _s int, N_removed int, _k int"), least=5).collect()
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in got} == {(None, "x y z u v w\nq", 0), ("a", "", 6), ("b", "", 6), ("", None, 0)}
    assert got[0].asDict().keys() == {"doc_id", "text", "_i", "_s", "_k", "n_removed"}


def test_line_dedup_compares_equal_stretches_as_one(documents, monkeypatch):
    """A passage in many texts is no row for each of its words; nor are words that a text repeats."""
    written = []
    monkeypatch.setattr(line_dedup, "saved", lambda df: written.append(common.saved(df)) or written[-1])
    passage = " ".join(f"p{j}" for j in range(1000))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(60)) + f" {passage} " + " ".join(f"b{i}_{j}" for j in range(60))) for i in range(20)]
    rows.append((30, " ".join("again" for _ in range(3000))))
    got = line_dedup.dedup(documents(rows), least=5).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(0, 0)] + [(i, 1000) for i in range(1, 20)] + [(30, 2999)]
    assert max(df.count() for df in written if "g" in df.columns or "r" in df.columns) < 20 * 100


def test_line_dedup_where_stretches_differ(documents):
    """Parts of a passage with other words around them, in texts that repeat themselves, in copies and in versions of one id."""
    rng = random.Random(4)
    passage, beat = [f"p{j}" for j in range(300)], [f"t{j}" for j in range(17)]
    rows = []
    for i in range(60):
        a = rng.randrange(240)
        part = passage[a : a + rng.randint(8, 120)]
        own = [f"o{i}_{j}" for j in range(rng.randint(0, 40))]
        rows.append((i, " ".join(own + part + rng.choice([[], own, beat * 3 + [f"x{i % 4}"] + beat * 2, part[::-1] * 2]))))
    rows += [(70 + i, rows[i][1]) for i in range(0, 60, 7)] + [(80, None), (81, ""), (82, rows[3][1] + " \n")]
    for run, line in ((50, 16), (10, 4), (5, 5)):
        got = line_dedup.dedup(documents(rows), run=run, line=line).collect()
        mine = sorted(((r["doc_id"], WORD.findall(r["text"] or ""), r["text"] is None) for r in got), key=str)
        assert mine == dedup_by_force(rows, run)
    got = line_dedup.dedup(documents([(i // 2, t) for i, t in rows if i < 2]), run=5, line=4).collect()
    alone = [dedup_by_force([r], 5)[0][1] for r in rows[:2]]
    assert sorted(WORD.findall(r["text"]) for r in got) == sorted(alone)


def cut_by_force(text, marks, shortest):
    spans = [m.span() for m in WORD.finditer(text or "")]
    if not marks or not spans or len(spans) < shortest:
        return text, 0
    if min(marks) < 0:
        return "", len(spans)
    gone = sorted({w for m in marks for w in range(m >> 32, (m >> 32) + (m & 0xFFFFFFFF))})
    out = text
    for w in reversed(gone):
        out = out[: spans[w - 1][1] if w else 0] + out[spans[w][1] :]
    return out, len(gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aß漢 \n\x1f\t", max_size=25)), max_size=8), st.integers(0, 3), st.integers(1, 60), st.randoms(use_true_random=False))
def test_cut(texts, shortest, size, rng):
    marks = []
    for t in texts:
        n = len(words(t))
        spans = [(a, rng.randint(1, n - a)) for a in (rng.randrange(n) for _ in range(rng.randint(0, 3)))] if n else []
        marks.append(rng.choice([None, [-(1 << 32)], [-(1 << 32), 1], sorted(a << 32 | k for a, k in spans)]) if n else rng.choice([None, [-(1 << 32)]]))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "HASH_BYTES", size)
        out, removed = line_dedup.cut(pa.array(["cut off", *texts], pa.string())[1:], pa.array([[1], *marks], pa.list_(pa.int64()))[1:], shortest)
    assert list(zip(out.to_pylist(), removed.tolist(), strict=True)) == [cut_by_force(t, m, shortest) for t, m in zip(texts, marks, strict=True)]


def test_line_dedup_leaves_clean_texts_alone(documents, odd_rows):
    got = line_dedup.dedup(documents([r for r in odd_rows if r[0] != 6])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([r for r in odd_rows if r[0] != 6], key=str)
    assert line_dedup.dedup(documents([])).count() == 0


# Mixing

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets(sizes):
    goal = mixing.targets(sizes)
    assert sum(goal) == sum(sizes) and all(t <= 3 * s for t, s in zip(goal, sizes, strict=True))
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    free = {t / w for t, w, s in zip(goal, weight, sizes, strict=True) if t < 3 * s}
    assert len(free) <= 1
    assert all(Fraction(3 * s, w) <= max(free, default=Fraction(3 * s, w)) for t, w, s in zip(goal, weight, sizes, strict=True) if t == 3 * s and s)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(0, 120))
def test_knapsack_is_optimal(counts, budget):
    lengths = list(counts)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    best = max(s for s in sums if s <= budget)
    got = mixing.subset_sum(lengths, [counts[n] for n in lengths], budget)
    assert sum(n * c for n, c in got.items()) == best and all(c <= counts[n] for n, c in got.items())


def test_mix_meets_targets_and_reruns_agree(documents, odd_rows):
    rng = random.Random(1)
    rows = [r for r in odd_rows if r[0] != 6] + [(i, " ".join(["w"] * rng.randint(1, 40))) for i in range(100, 500)]
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    df = documents(rows).withColumn("size", size)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(r["size"] for r in by[s]) for s in order])
    for s, t in zip(order, goal, strict=True):
        assert {(r["target"], r["source_size"]) for r in by[s]} == {(float(t), sum(r["size"] for r in by[s]))}
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 40 and all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in by[s])
    assert abs(sum(r["taken"] for r in by["src1"]) - goal[order.index("src1")]) <= 1
    assert mixing.mix(documents([]).withColumn("size", size)).count() == 0


# Classifiers

def test_bradley_terry_orders_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    y = (x[:, 3] - x[:, 5] > -0.5).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    flat = quality.fit(x, np.ones(600, int))
    assert (flat.score(x) > 0.5).all()


def held_out_accuracy(spark, name, label, d="/root/testdata/sf0.01"):
    got = queries.QUERIES[name](spark, d)
    return got, got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_quality_on_held_out_labels(spark):
    got, right = held_out_accuracy(spark, "op6_quality", "quality")
    assert right >= 0.95 and got.where("score is null or score < 0 or score > 1").count() == 0
    held = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert len(held) == 1000 and all(v == (zlib.crc32(str(i).encode()) % 3 == 1) for i, v in held.items())


def test_toxicity_on_held_out_labels(spark):
    got, right = held_out_accuracy(spark, "op8_toxicity", "toxic")
    assert right >= 0.95 and got.count() == 1000


def test_classifiers_on_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (None, 1, 1), (8, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for rows in (odd_rows, []):
            df = documents(rows)
            got = quality.score(df, quality.train(df, some, F.lit(True)), score_column="s").collect()
            assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
            got = toxicity.score(df, toxicity.train(df, some, F.lit(True)), score_column="s").collect()
            assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)


def test_obfuscated_words_are_restored(spark, documents):
    clean = "the stupid idiot was a moron and a loser with pathetic worthless trash or a clown and some scum that is disgusting"
    lm = toxicity.language_model(documents([(1, " ".join([clean] * 20)), (2, "and then the other words in the text are of some kind " * 20)]))
    for seen, meant in (("1d10t", "idiot"), ("st*pid", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("$cum", "scum"), ("p@thetic", "pathetic"), ("l0ser,", "loser"), ("tr4sh!!!", "trash"), ("m0r0n***", "moron"), ("worthle$$", "worthles"), ("clown", "clown"), ("m0" + "r" * 60 + "on", "moron"), ("1d1" + "0" * 80 + "t", "idiot")):
        assert toxicity.restore(seen.encode(), lm) == [meant]
    for seen, meant in ((b"you i d i o t there", "idiot"), (b"a 1 d  i\no t s c u m", "idiot"), (b"a 1 d  i\no t s c u m", "scum"), (b"so i s the l 0 s e r", "loser")):
        assert meant in {x for w in toxicity.all_words(seen) for x in toxicity.restore(w, lm)}
    assert toxicity.all_words(b"of i s") >= {b"i s"} and toxicity.all_words(b"x a n d y") >= {b"x a n d y"}


def decode_by_force(word, model):
    """Least cost over all ways through the lattice."""
    at = lambda x: 26 if x in ("", " ") else ord(x) - 97 if "a" <= x <= "z" else 27
    best = math.inf
    stack = [(0, 26, 26, "", 0.0)]
    while stack:
        i, x, y, last, cost = stack.pop()
        if i == len(word):
            best = min(best, cost + (0 if last == " " else model[x, y, 26]))
            continue
        if word[i] == " ":
            stack.append((i + 1, x, y, last, cost + toxicity.COST_GAP))
            if last not in ("", " "):
                stack.append((i + 1, y, 26, " ", cost + toxicity.COST_BOUNDARY + model[x, y, 26]))
            continue
        for letter, more in toxicity.options(word[i]):
            if not letter:
                stack.append((i + 1, x, y, last, cost + more))
                continue
            stack.append((i + 1, y, at(letter), letter, cost + more + model[x, y, at(letter)] + (toxicity.COST_KEPT_REPEAT if letter == last else 0)))
            if letter == last:
                stack.append((i + 1, x, y, last, cost + more + toxicity.COST_REPEAT))
    return best


def cost_of(word, made, model):
    """Least cost of the ways through the lattice that make these words."""
    at = lambda x: 26 if x == " " else ord(x) - 97 if "a" <= x <= "z" else 27
    ways = {0: 0.0}
    padded = [26, 26, *(at(c) for c in made)]
    price = lambda j: float(model[padded[j], padded[j + 1], padded[j + 2]])
    for char in word:
        after = {}
        for j, cost in ways.items():
            last = made[j - 1 : j]
            steps = []
            if char == " ":
                steps.append((j, toxicity.COST_GAP))
                if made[j : j + 1] == " " and last not in ("", " "):
                    steps.append((j + 1, toxicity.COST_BOUNDARY + price(j)))
            else:
                for letter, more in toxicity.options(char):
                    if not letter:
                        steps.append((j, more))
                        continue
                    if made[j : j + 1] == letter:
                        steps.append((j + 1, more + price(j) + (toxicity.COST_KEPT_REPEAT if letter == last else 0)))
                    if letter == last:
                        steps.append((j, more + toxicity.COST_REPEAT))
            for k, c in steps:
                after[k] = min(after.get(k, math.inf), cost + c)
        ways = after
    end = 0 if made.endswith(" ") else float(model[(*padded[-2:], 26)])
    return ways.get(len(made), math.inf) + end


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab1!4*. é", min_size=1, max_size=8), st.integers(0, 5))
def test_decoding_is_the_best_of_all_ways(word, seed):
    model = np.random.default_rng(seed).gamma(2.0, 1.0, (28, 28, 28))
    assert math.isclose(cost_of(word, toxicity.decode(word, model), model), decode_by_force(word, model), rel_tol=1e-9)


def test_unseen_evidence_backs_off_and_rates_never_fall():
    model = toxicity.Model(np.zeros((toxicity.SIZE,) * 3), {"idiot": (0.97, 9.0), "moron": (0.97, 9.0), "scum": (0.97, 9.0)}, {0: 0.1, 61: 0.9, 42: 0.7})
    assert model.scores([b"idiot moron scum", b"idiot", b"nothing"], model.memo()) == [0.9, 0.9, 0.1]
    assert [model.rate(x) for x in (62, 53, 43, 52, 51, 11, 23)] == [0.9, 0.7, 0.7, 0.7, 0.7, 0.5, 0.6]
    for rates in ({}, {0: 0.3}, {0: 0.2, 33: 0.9, 63: 0.4, 11: 0.1}):
        model.rates = rates
        for s, n in itertools.product(range(1, 7), range(1, 4)):
            assert model.rate(0) <= model.rate(10 * s + n) <= min(model.rate(10 * t + m) for t in range(s, 7) for m in range(n, 4))


def test_families_are_near_copies():
    rng = random.Random(2)
    texts = [" ".join(["the", "of", *(f"w{rng.randrange(900)}" for _ in range(200))]) for _ in range(40)]
    assert len({toxicity.family(t.encode()) for t in texts}) == 40
    near = [" ".join(w for i, w in enumerate(texts[0].split()) if i != k) for k in range(20, 60)]
    assert Counter(toxicity.family(t.encode()) for t in near).most_common(1)[0][1] >= 30


def test_quality_fit_is_the_optimum(spark):
    """Least loss over pairs, by numeric gradient; the threshold errs no more than any other."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    y = (x[:, 0] + 0.7 * rng.normal(size=200) > 0).astype(int)
    model = quality.fit(x, y, pairs=3000)
    draw = np.random.default_rng(3)
    z = ((x - x.mean(0)) / (x.std(0) + 1e-6)).clip(-8, 8)
    d = z[draw.choice(np.flatnonzero(y == 1), 3000)] - z[draw.choice(np.flatnonzero(y == 0), 3000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + quality.RIDGE / 2 * w @ w
    least = loss(model.weights)
    assert all(loss(model.weights + step * rng.normal(size=16)) >= least for step in (1e-3, 1e-2, 0.1) for _ in range(20))
    wrong = lambda t: ((model.strength(x) >= t) != y).sum()
    assert wrong(model.threshold) == min(wrong(t) for t in [*model.strength(x), 1e9])
    assert (quality.fit(x, np.zeros(200, int)).score(x) < 0.5).all() and (quality.fit(x[:0], y[:0]).score(x) == 0.5).all()


def test_scores_replace_columns_of_their_name(spark, documents):
    docs = documents([(1, "some text"), (2, None)])
    model = quality.fit(np.zeros((0, 16)), np.zeros(0, int))
    for out in (quality.score(docs, model), toxicity.score(docs, toxicity.Model(np.zeros((toxicity.SIZE,) * 3), {}, {}))):
        assert out.columns.count("score") == 1 and out.select("score").count() == 2


# Search

def knn_by_force(vectors, k):
    whole = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in whole if i % 100 == 0):
        width = max(map(len, whole.values()))
        pad = lambda v: np.pad(v, (0, width - len(v)))  # noqa: E731,B023
        scores = sorted((-int(pad(v) @ pad(whole[q])), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block,chunk", [(64, 8192, 16384), (7, 2, 40), (1, 1, 1000)])
def test_knn_matches_brute_force(spark, pivots, block, chunk):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    vectors = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=8) * 0.2) * (1 + i % 3)]) for i in range(700)]
    vectors += [(700, None), (800, [1.0, None]), (801, [float("nan")] * 8), (802, [float("inf")] + [0.0] * 7), (803, []), (900, [0.5, -0.5]), (None, [1.0] * 8)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(4)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = knn.search(df, F.col("id") % 100 == 0, 10, pivots=pivots, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == knn_by_force(floats, 10)


def test_knn_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.search(empty, F.col("id") % 100 == 0, 10).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert knn.search(one, F.col("id") % 100 == 0, 10).count() == 0
    two = spark.createDataFrame([(100, [1.0, 2.0]), (5, [-1.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.search(two, F.col("id") % 100 == 0, 10).collect()] == [(100, 1, 5, -1024 * 1024)]


@pytest.mark.parametrize("pivots", [64, 7])
def test_knn_counts_repeated_rows_once(spark, pivots):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    for q in (0, 100, 200, 300):
        vectors += [(q, vectors[q][1])] * 15 + [(q + 1, [float(np.float32(x) * 2) for x in vectors[q][1]])] * 20
        vectors[q + 1] = vectors[-1]
    floats = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, knn.search(df, F.col("id") % 100 == 0, 10, pivots=pivots).collect())) == knn_by_force(floats, 10)


# Pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.saved(stage(spark, docs, DATA))
        kept.append(docs)
        if i < 4:
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    before, after = rows(kept[0]), rows(kept[1])
    force = {i: w for i, (w, _) in lines_by_force(before, line_dedup.RUN, line_dedup.LEAST).items()}
    had = {i: len(words(t)) for i, t in before}
    assert {i: WORD.findall(t or "") for i, t in after} == {i: w for i, w in force.items() if w or not had[i]}
    least = {i for i, _, c in components_by_force(after, 5, 80, 100) if i == c}
    assert {i for i, _ in rows(kept[2])} == least
    copies = Counter(i for i, _ in rows(kept[3]))
    assert set(copies) <= least and max(copies.values()) <= 3
    # Mixing: each source's words come within its longest document of the target.
    size, source = {i: len(words(t)) for i, t in rows(kept[2])}, {r["doc_id"]: r["source"] for r in kept[2].collect()}
    order = sorted(set(source.values()))
    for s, goal in zip(order, mixing.targets([sum(size[i] for i in size if source[i] == s) for s in order]), strict=True):
        own = [i for i in size if source[i] == s]
        assert abs(sum(size[i] * copies[i] for i in own) - goal) <= max(size[i] for i in own)
    # Packing: each copy's ids once, in gapless sequences.
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows(kept[2])}
    packed = kept[4].collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter((i, p, len(ids[i][p * 4096 : (p + 1) * 4096]), crc(ids[i][p * 4096 : (p + 1) * 4096])) for i in copies.elements() for p in range(-(-len(ids[i]) // 4096)))
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and sum(n for _, n in own) <= 4096 for own in places.values())


def test_near_copies_leave_one(spark, documents):
    docs = documents(family_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    left = stages.jaccard_stage(spark, docs, DATA)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _, c in components_by_force(family_rows(), 5, 80, 100) if i == c}
