"""LM scoring by a hidden Markov model over word classes, trained by Baum-Welch on all data.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, then one end. Frequent words
and the end are classes of their own; other words share classes by their last letters. The model
gives a token the probability of its class in the hidden states, times its share of its class,
(c + 0.1) / (n + 0.1 * (v + 1)) with the class's n tokens of v words. The base is the same over all
words as one class.

Texts are turned into classes once (``encode``). Baum-Welch counts are made per partition over whole
texts, from first to last token, and added up; a bounded sample of ``SEED_ROWS`` texts gives only
the starting point. Scoring is the exact scaled forward recursion over whole texts. Counts of the
``HEAD`` most frequent words, a fixed number (those of one frequency chosen by hash), go to all
executors; those of all other words are joined.

Null texts are empty (one end). Repeated rows and ids give a row each; without training rows all
tokens are unknown; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, Memo, lists, map_batches, saved, slices, word_column

#: Words whose counts are broadcast (at most), words that are classes of their own, and shared classes.
HEAD, OWN, SHARED = 1 << 16, 2048, 64
END = OWN + SHARED
CLASSES = END + 1
STATES, PASSES = 8, 2
#: Texts, and tokens of them, that give the starting point at most.
SEED_ROWS, SEED_TOKENS, SEED_PASSES = 300, 150_000, 20
#: Tokens from which a text counts as long; tokens of short and of long texts that a task takes up at once (results don't depend on it).
LONG, TOKENS, LONG_TOKENS = 2048, 1 << 18, 1 << 20
#: Steps after which forward probabilities are scaled anew, few enough not to underflow; tokens whose emissions are counted at once (results don't depend on it).
SCALED, COUNTED = 8, 1 << 15
#: Bits of the lower part of a logarithm.
PART = 20
#: Bytes of words that a task counts before it hands them on, and the rows that it hands on at once.
GATHERED, ROWS = 32 << 20, 1 << 17
#: Expected counts are added up as whole multiples of 2**-20, so sums don't depend on their order.
UNIT = 1 << 20


def shared_class(word: bytes) -> int:
    return OWN + xxhash.xxh3_64_intdigest(word[-3:]) % SHARED


@dataclass
class Vocabulary:
    counts: DataFrame
    tokens: int
    words: int
    texts: int
    head: dict[bytes, int]
    #: Log10 denominators of the shared classes.
    below: list[float]
    classes: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.classes = {w: i for i, w in enumerate(self.head) if i < OWN}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}  # tasks don't get the table

    def by_code(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, and what a token adds to the base and to the model's share of its class, of frequent words, of other words by shared class
        (without their counts), and of the end."""
        classes = np.array([self.classes[w] if w in self.classes else shared_class(w) for w in self.head] + list(range(OWN, END + 1)), "<u2")
        logs = np.zeros(len(classes))
        logs[: len(self.head)] = [log10(c + 0.1) for c in self.head.values()]
        logs[-1] = log10(self.texts + 0.1)
        share = np.zeros(len(classes), bool)
        share[len(self.classes) : -1] = True
        mine = np.where(share, logs - np.array(self.below)[np.where(share, classes - OWN, 0)], 0.0)
        return classes, logs - log10(self.tokens + 0.1 * (self.words + 1)), mine


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n) of all words of column t."""

    def f(batches):
        def rows():
            counted = pa.chunked_array(waiting, pa.binary()).value_counts()
            for i in range(0, len(counted), ROWS):
                yield pa.RecordBatch.from_arrays(counted.slice(i, ROWS).flatten(), names=["w", "n"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(word_column(batch.column(0))[0])
            size += waiting[-1].nbytes
            if size > GATHERED:
                yield from rows()
                waiting, size = [], 0
        yield from rows()

    return map_batches(texts, f, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The ``most`` most frequent words with their counts, by frequency.

    A histogram of counts tells which of its classes go in whole; of the next one, words are chosen
    by hash. So hardly more than ``most`` words reach the driver.
    """
    size = F.floor(F.log2("n") * 16)
    place = F.pmod(F.xxhash64(F.lit(29), "w"), F.lit(1 << 32))
    chosen, held = F.lit(False), 0
    for r in sorted(counts.groupBy(size.alias("k")).count().collect(), reverse=True):
        left = most - held
        if r["count"] <= left:
            chosen, held = size >= r["k"], held + r["count"]
            continue
        share = min(1.0, (left + 8 * left**0.5 + 8) / r["count"])
        if left:
            chosen = chosen | ((size == r["k"]) & (place < int(share * (1 << 32))))
        break
    rows = counts.where(chosen).select("w", "n", size.alias("k"), place.alias("p")).collect()
    least = min((r["k"] for r in rows), default=0)
    rows = sorted(rows, key=lambda r: (r["k"] == least, r["p"] if r["k"] == least else 0, bytes(r["w"])))[:most]
    return {bytes(r["w"]): r["n"] for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["w"])))}


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Counts over training texts, column t."""
    counts = saved(count_words(texts.select("t")))
    n, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = texts.count()
    head = frequent(counts, HEAD)

    def classed(batches):
        for batch in batches:
            k = [shared_class(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), batch.column(1), batch.column(2)], names=["k", "n", "v"])

    # A word's last letters alone tell its shared class; words that are their own class are taken off.
    endings = counts.groupBy(F.expr("substring(w, -3, 3)").alias("x")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    sizes = {r["k"]: (r["n"], r["v"]) for r in map_batches(endings, classed, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    for w, c in list(head.items())[:OWN]:
        n_, v = sizes[shared_class(w)]
        sizes[shared_class(w)] = n_ - c, v - 1
    below = [log10(n_ + 0.1 * (v + 1)) for n_, v in (sizes.get(OWN + i, (0, 0)) for i in range(SHARED))]
    return Vocabulary(counts, n + rows, words + (rows > 0), rows, head, below)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def from_counts(cls, flat: np.ndarray) -> Hmm:
        """Probabilities from expected counts, smoothed so that no class is impossible."""
        k = STATES
        start, move, emit = flat[:k] + 0.1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k :].reshape(CLASSES, k)
        back = emit.sum(1) + 0.5
        emit = emit + 5 * (back / back.sum())[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def random(cls, counts: np.ndarray, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        flat = np.concatenate([np.ones(STATES), (np.full((STATES, STATES), 0.2) + 3 * np.eye(STATES)).ravel() * 100, (counts[:, None] * rng.gamma(2.0, 0.5, (CLASSES, STATES))).ravel()])
        return cls.from_counts(flat)


def by_step(classes: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int]]:
    """(tokens by step, then by sequence; how many sequences take each step; where each step begins) of sequences, longest first."""
    lengths = np.array([len(c) for c in classes])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    first = np.concatenate([[0], np.cumsum(live)])
    step = np.concatenate([np.arange(n) for n in lengths])
    obs = np.empty(first[-1], np.int64)
    obs[first[step] + np.repeat(np.arange(len(classes)), lengths)] = np.concatenate(classes)
    return obs, [*live.tolist(), 0], first.tolist()


def scaled(t: int, live: list[int]) -> int:
    """The sequences from this one on are scaled at step t: all at each ``SCALED``-th, else those that end."""
    return 0 if t % SCALED == SCALED - 1 else live[t + 1]


def expected(model: Hmm, classes: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts (start, moves, emissions) of whole sequences of classes.

    All sequences take a step at once, longest first, so those that go on are a prefix. What is kept
    is one row of forward probabilities for each token.
    """
    total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
    if not classes:
        return total
    obs, live, ends = by_step(sorted(classes, key=len, reverse=True))
    alpha, scales, a = np.empty((len(obs), STATES)), [], model.start
    for t in range(len(live) - 1):
        i, j = ends[t], ends[t + 1]
        own, s, c = alpha[i:j], scaled(t, live), None
        np.multiply(a[: live[t]] @ model.move if t else a, model.emit.take(obs[i:j], axis=0), out=own)
        if s < live[t]:
            c = 1 / own[s:].sum(1, keepdims=True)
            own[s:] *= c
        scales.append(c)
        a = own
    move, back, x = np.zeros((STATES, STATES)), model.move.T.copy(), None
    for t in range(len(live) - 2, -1, -1):
        i, j = ends[t], ends[t + 1]
        own, y = alpha[i:j], model.emit.take(obs[i:j], axis=0)
        if x is not None:
            n = len(x)
            move += own[:n].T @ x
            beta = x @ back
            y[:n] *= beta
            own[:n] *= beta
        if scales[t] is not None:
            y[scaled(t, live) :] *= scales[t]
        x = y
    emit = np.zeros(STATES * CLASSES)
    for i in range(0, len(obs), COUNTED):
        emit += np.bincount((obs[i : i + COUNTED, None] * STATES + np.arange(STATES)).ravel(), alpha[i : i + COUNTED].ravel(), STATES * CLASSES)
    return np.concatenate([alpha[: live[0]].sum(0), (move * model.move).ravel(), emit])


class Gathered:
    """Sequences that wait until there are enough of their kind: many short ones, or long ones, which take many steps."""

    def __init__(self, model: Hmm):
        self.model, self.total = model, np.zeros(STATES + STATES**2 + STATES * CLASSES)
        self.waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.tokens = {False: 0, True: 0}

    def add(self, sequence: np.ndarray) -> None:
        long = len(sequence) >= LONG
        self.waiting[long].append(sequence)
        self.tokens[long] += len(sequence)
        if self.tokens[long] >= (LONG_TOKENS if long else TOKENS):
            self.flush(long)

    def flush(self, long: bool) -> None:
        self.total += expected(self.model, self.waiting[long])
        self.waiting[long], self.tokens[long] = [], 0

    def counts(self) -> np.ndarray:
        self.flush(False)
        self.flush(True)
        return self.total


def all_expected(model: Hmm, classes: list[np.ndarray]) -> np.ndarray:
    gathered = Gathered(model)
    for c in classes:
        gathered.add(c)
    return gathered.counts()


def encode(docs: DataFrame, words: Vocabulary, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a text: i (id), held_out, u (a hash of the row), n_tokens, ids (classes, two bytes each), and for its score by words:
    known, base and mine (sums over frequent words), rare (tokens of others), words and times (the others)."""
    kept = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"), held_out.alias("held_out"), F.xxhash64(id_column, text_column).alias("u"))
    schema = T.StructType([
        kept.schema["i"], T.StructField("held_out", T.BooleanType()), *(T.StructField(n, t) for n, t in (
            ("u", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("known", T.LongType()), ("base", T.DoubleType()), ("mine", T.DoubleType()), ("rare", T.LongType()),
            ("words", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.IntegerType())))),
    ])
    top = len(words.head)
    end = top + SHARED

    def f(batches):
        def rows(texts):
            own, sizes = word_column(texts)
            # A token's code: the place of a frequent word, then the shared classes, then the end.
            code = pc.index_in(own, value_set=head).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(code < 0)
            others = own.take(pa.array(at)).dictionary_encode()
            which = others.indices.to_numpy()
            code[at] = np.array([top - OWN + shared[w[-3:]] for w in others.dictionary.to_pylist()], np.int64)[which]
            full = np.full(len(own) + len(sizes), end)
            full[np.arange(len(own)) + row] = code
            # Each text's other words, once each.
            pairs, times = np.unique(row[at] * len(others.dictionary) + which, return_counts=True)
            text, word = np.divmod(pairs, max(len(others.dictionary), 1))
            kinds = np.bincount(text, minlength=len(sizes))
            rare = np.bincount(row[at], minlength=len(sizes))
            sizes = sizes + 1
            starts = np.cumsum(sizes) - sizes
            return [
                pa.array(sizes, pa.int64()),
                byte_rows(classes[full], sizes),
                pa.array(sizes - rare - (words.texts == 0), pa.int64()),
                pa.array(np.add.reduceat(base[full], starts), pa.float64()),
                pa.array(np.add.reduceat(mine[full], starts), pa.float64()),
                pa.array(rare, pa.int64()),
                lists(others.dictionary.take(pa.array(word)), kinds, pa.binary()),
                lists(times, kinds, pa.int32()),
            ]

        head, shared = pa.array(list(words.head), pa.binary()), Memo(shared_class)
        classes, base, mine = words.by_code()
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(j).slice(a, b - a) for j in (0, 2, 3)] + rows(batch.column(1).slice(a, b - a)), names=[x.name for x in schema])

    return map_batches(kept, f, schema)


def byte_rows(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """A binary column whose rows hold so many of the values each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def sequences(column: pa.BinaryArray) -> list[np.ndarray]:
    """Classes of each text of an ``ids`` column."""
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def train(encoded: DataFrame, passes: int = PASSES) -> Hmm:
    """The model from encoded training texts; ``encoded`` is read several times: give a saved table."""
    # Hashes of rows choose the sample; equal rows have one hash and count once.
    place = F.xxhash64(F.lit(23), "u")
    seed, tokens = {}, 0
    for r in encoded.groupBy(place.alias("p")).agg(F.max("n_tokens").alias("n")).orderBy("p").limit(SEED_ROWS).collect():
        if tokens + r["n"] <= SEED_TOKENS:
            seed[r["p"]], tokens = None, tokens + r["n"]
    if seed:
        last = max(seed)
        for r in encoded.where(place <= last).groupBy(place.alias("p")).agg(F.min(F.when(place.isin(*seed), F.col("ids"))).alias("ids")).where("ids is not null").collect():
            seed[r["p"]] = np.frombuffer(bytes(r["ids"]), "<u2")
    start = [x for _, x in sorted(seed.items())]
    model = Hmm.random(np.bincount(np.concatenate(start), minlength=CLASSES).astype(float) + 0.01 if start else np.ones(CLASSES))
    for _ in range(SEED_PASSES if start else 0):
        model = Hmm.from_counts(all_expected(model, start))
    for _ in range(passes):

        def count(batches, model=model):
            gathered = Gathered(model)
            for batch in batches:
                for own in sequences(batch.column(0)):
                    gathered.add(own.copy())
            total = gathered.counts()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(total[at] * UNIT).astype(np.int64))], names=["k", "n"])

        rows = map_batches(encoded.select("ids"), count, "k long, n long").groupBy("k").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toPandas()
        flat = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        flat[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(float) / UNIT
        model = Hmm.from_counts(flat)
    return model


def forward(model: Hmm, classes: list[np.ndarray]) -> np.ndarray:
    """Log10 likelihood of each sequence of classes: scaled forward recursion, longest first."""
    if not classes:
        return np.empty(0)
    order = np.argsort([-len(c) for c in classes], kind="stable")
    obs, live, ends = by_step([classes[i] for i in order])
    total, a = np.zeros(len(classes)), model.start
    for t in range(len(live) - 1):
        e = model.emit.take(obs[ends[t] : ends[t + 1]], axis=0)
        e *= a[: live[t]] @ model.move if t else a
        a, s = e, scaled(t, live)
        if s < live[t]:
            c = a[s:].sum(1)
            a[s:] /= c[:, None]
            total[s : live[t]] += np.log10(c)
    out = np.empty(len(classes))
    out[order] = total
    return out


def score(encoded: DataFrame, words: Vocabulary, model: Hmm, id_column: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each encoded row; ``encoded`` is read twice: give a saved table."""
    kept = encoded.select("i", "held_out", "n_tokens", "known", "base", "mine", "u", "rare", "ids")
    schema = T.StructType(kept.schema.fields[:-1] + [T.StructField("hidden", T.DoubleType())])

    def f(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forward(model, sequences(batch.column(8))), pa.float64())], names=[x.name for x in schema])

    rare = encoded.select("u", F.explode(F.arrays_zip("words", "times")).alias("x")).select("u", F.col("x.words").alias("w"), F.col("x.times").cast("long").alias("m"))
    # Logarithms as whole multiples of 1e-12, added up in two parts: sums don't depend on their order and never overflow.
    log = F.rint(F.log10(F.col("n") + 0.1) * 1e12).cast("long")
    known = words.counts.select("w", F.shiftright(log, PART).alias("high"), log.bitwiseAND((1 << PART) - 1).alias("low"))
    none = -(10**12)
    found = rare.join(known, "w", "left").groupBy("u").agg(
        F.sum(F.col("m") * F.coalesce("high", F.lit(none >> PART))).alias("high"), F.sum(F.col("m") * F.coalesce("low", F.lit(none & (1 << PART) - 1))).alias("low"),
        F.sum(F.when(F.col("low").isNotNull(), F.col("m")).otherwise(0)).alias("more"), F.sum("m").alias("all")
    )
    found = found.select("u", ((F.col("high").cast("double") * (1 << PART) + F.col("low").cast("double")) / 1e12).alias("log"), "more", "all")
    # Equal rows have the same u: their sums are shared out.
    part = F.coalesce(F.col("rare") / F.col("all"), F.lit(0.0))
    more = F.coalesce(F.col("log") * part, F.lit(0.0))
    return map_batches(kept, f, schema).join(found, "u", "left").select(
        F.col("i").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("more") * part), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("hidden") + F.col("mine") + more).alias("score"),
    )
