"""Toxicity by noisy-channel deobfuscation.

What is written is a noisy form of words: letters replaced by look-alikes, stretched, cut by
separators or spaced out. The lattice of letters and word boundaries that it may stand for is
decoded by Viterbi's algorithm, exactly and whatever its length, under a character trigram model
counted over all texts. Units of decoding are written words and runs of two or more words of one
character each, whose gaps are either nothing or a boundary. Edges of punctuation are stripped
before, and of doubled letters one counts after. Restored words are then looked up in a lexicon of
roots, words and beginnings of words (inflected forms share one), with the share of toxic texts
among those that have it. The score is the rate of toxic texts among labelled ones with like
evidence: the most toxic root, and how many words have such roots; more evidence never lowers it.

Only lexicon and rates use a sample: at most ``SAMPLE_ROWS`` labelled rows. A word's evidence is
counted in families of texts (by the least hash of their runs of three words), so near copies of
one text count once. Scoring needs each row alone: no shuffle. Null texts are empty and get the
score of texts without such words; repeated rows and ids get a row each; an empty table gives no
rows; without usable labels all scores are 0. A column named as the score is replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Memo, discard, map_batches, others, runs_of, saved, slices, texts_of, word_hashes, words_of
from .labelled import sample

SAMPLE_ROWS = 12_000
#: Letters of the beginnings that may enter the lexicon, beside whole words.
STEMS = range(3, 8)
#: Words of one root that are told apart: 1, 2, or this many and more.
MOST_WORDS = 3
#: Share of toxic families from which a word may enter the lexicon.
LEAST_SHARE = 0.5
#: Steps by which shares of roots are told apart.
SHARE_STEPS = (0.6, 0.7, 0.8, 0.9, 0.95)

# Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
SEPARATORS = ".,-_*~'`^/\\:;|"
#: Costs (negative log probabilities) of what the channel does.
COST_LOOKALIKE, COST_ANY, COST_SEPARATOR, COST_REPEAT, COST_KEPT_REPEAT = 1.0, 2.5, 0.7, 0.5, 1.5
#: Costs of a gap between spaced letters: nothing, or the end of a word.
COST_GAP, COST_BOUNDARY = 0.2, 0.7
GAP = " "

EDGE, OTHER, SIZE = 26, 27, 28
_CLASS = np.full(256, EDGE, np.int64)
_CLASS[128:] = OTHER
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i

_STRIP = re.compile(r"^[\"'(\[{<.,;:?*#%&|~_-]+|(?:[.,;:?!\"')\]}>*#%&|~_-]|[$@](?=[$@#%&*!.,;:?]*$)(?<=[$@][$@]))+$")
_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1+")
_SPACED = re.compile(rb"(?<!\S)\S(?:\s+\S)+(?!\S)")


def trigrams(text: bytes) -> np.ndarray:
    """Counts of character trigrams of a text, words apart."""
    c = _CLASS[np.frombuffer(b" " + text + b"  ", np.uint8)]
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


def language_model(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Negative log probabilities [before, last, next] from all texts; SIZE**3 counts reach the driver."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices([len(x) for x in texts]):
                total += trigrams(b" ".join(texts[a:b]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    rows = map_batches(docs.select(F.col(text_column)), count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pair = counts.sum(0) + 0.1
    back = pair / pair.sum(-1, keepdims=True)
    return -np.log((counts + 5 * back[None]) / (counts.sum(-1, keepdims=True) + 5))


def options(char: str) -> list[tuple[str, float]]:
    """Letters that a written character may stand for, with costs; '' for none."""
    if "a" <= char <= "z":
        return [(char, 0.0)]
    out = [(x, COST_ANY if char == "*" else COST_LOOKALIKE) for x in LOOKALIKES.get(char, "")]
    if char in SEPARATORS:
        out.append(("", COST_SEPARATOR))
    return out or [(char, 0.0)]


def _spell(made: tuple | None) -> str:
    out = []
    while made is not None:
        made, letter = made
        out.append(letter)
    return "".join(reversed(out))


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest words, one space between them, behind what is written: Viterbi over (last two letters, what was made last).

    GAP in ``word`` is a gap between spaced letters. All states are kept, at most a few for each pair
    of letters; of equal costs the first found stays. Time grows with the length.
    """
    at = lambda x: ord(x) - 97 if "a" <= x <= "z" else OTHER
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(EDGE, EDGE, ""): (0.0, None)}
    for char in word:
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        choices = options(char)
        for (x, y, last), (cost, made) in states.items():
            if char == GAP:
                steps = [((x, y, last), cost + COST_GAP, made)]
                if last not in ("", GAP):
                    steps.append(((y, EDGE, GAP), cost + COST_BOUNDARY + float(model[x, y, EDGE]), (made, GAP)))
            else:
                steps = []
                for letter, more in choices:
                    if not letter:
                        steps.append(((x, y, last), cost + more, made))
                        continue
                    z = at(letter)
                    steps.append(((y, z, letter), cost + more + float(model[x, y, z]) + (COST_KEPT_REPEAT if last == letter else 0), (made, letter)))
                    if last == letter:
                        steps.append(((x, y, last), cost + more + COST_REPEAT, made))
            for key, c, way in steps:
                if key not in after or c < after[key][0]:
                    after[key] = (c, way)
        states = after
    return _spell(min(((cost + float(model[x, y, EDGE]) * (last != GAP), made) for (x, y, last), (cost, made) in states.items()), key=lambda s: s[0])[1])


def restore(word: bytes, model: np.ndarray) -> list[str]:
    """A lower-cased written word, or run of spaced letters, as the words it stands for, doubled letters once; edges are stripped."""
    text = word.decode("utf-8", "replace")
    if not text.isalpha():
        text = _STRIP.sub("", text)
    plain = text.isalpha() and not _RUN.search(text)
    if not plain and any("a" <= c <= "z" for c in text):
        text = decode(text, model)
    return [_DOUBLE.sub(r"\1", x) for x in text.split(GAP)]


def spaced(lowered: bytes) -> list[bytes]:
    """Runs of words of one character each, one gap between them."""
    return [GAP.encode().join(x.split()) for x in _SPACED.findall(lowered)]


def all_words(text: bytes) -> set[bytes]:
    own = set(words_of(text))
    return own.union(spaced(text.translate(LOWER))) if sum(len(w) == 1 for w in own) else own


def roots(word: str) -> list[str]:
    """What of a restored word may enter the lexicon: itself, and its beginnings, which end in a mark."""
    return [word, *(word[:k] + "^" for k in STEMS if k < len(word))]


def family(text: bytes) -> int:
    """What near copies of a text most likely share, and other texts don't: the least hash of its runs of three words."""
    h, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    own = runs_of(h, min(3, len(h))) if len(h) else np.zeros(1, np.uint64)
    return int(own.min().view(np.int64))


@dataclass
class Model:
    """roots: root -> share of toxic families; rates: evidence -> probability."""

    language: np.ndarray
    roots: dict[str, tuple[float, float]]
    rates: dict[int, float]

    def memo(self) -> Memo:
        """Written word -> the share of its best-supported root, 0 if the lexicon has none."""

        def share(word: bytes) -> float:
            known = [self.roots[r] for x in restore(word, self.language) for r in roots(x) if r in self.roots]
            return max(known, key=lambda x: x[1])[0] if known else 0.0

        return Memo(share)

    def evidence(self, text: bytes, memo: Memo) -> int:
        """Cell of a text: how toxic its most toxic root is, and how many words have such roots; 0 for none."""
        own = all_words(text)
        shares = [x for x in memo.many(sorted(own)) if x] if own else []
        return (1 + sum(max(shares) >= x for x in SHARE_STEPS)) * 10 + min(len(shares), MOST_WORDS) if shares else 0

    def rate(self, evidence: int) -> float:
        """The highest rate of seen cells with no more words and no higher share; where there is none, the least share of the step, but no more than stronger cells have."""
        step, words = divmod(evidence, 10)
        clean = self.rates.get(0, 0.0)
        if not step:
            return clean

        def below(s: int, n: int) -> list[float]:
            return [r for e, r in self.rates.items() if e and e // 10 <= s and e % 10 <= n]

        seen = below(step, words)
        if not seen:
            above = [below(s, n) for s in range(step, len(SHARE_STEPS) + 2) for n in range(words, MOST_WORDS + 1)]
            return max(clean, min([(LEAST_SHARE, *SHARE_STEPS)[step - 1], *(max(x) for x in above if x)]))
        return max(clean, *seen)

    def scores(self, texts: list[bytes], memo: Memo) -> list[float]:
        rates = {10 * s + n: self.rate(10 * s + n) for s in range(1, len(SHARE_STEPS) + 2) for n in range(1, MOST_WORDS + 1)} | {0: self.rate(0)}
        return [rates[self.evidence(text, memo)] for text in texts]


def _labelled(docs: DataFrame, label: dict, id_column: str, text_column: str, make, schema: str) -> DataFrame:
    """Rows (key, label, family) that ``make`` yields for the texts of labelled ids."""

    def take(batches):
        rows_of = make()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [i for i, x in enumerate(ids) if x in label]
            out = []
            for i, text in zip(own, texts_of(batch.column(1).take(pa.array(own, pa.int32()))), strict=True):
                own_family = family(text)
                out += [(k, label[ids[i]], own_family) for k in rows_of(text)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.string() if "string" in schema else pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "y", "f"])

    # A family counts as the label that most of its rows have.
    rows = map_batches(docs.select(F.col(id_column), F.col(text_column)), take, schema)
    return rows.groupBy("k", "f").agg(F.avg("y").alias("y")).groupBy("k").agg(F.sum((F.col("y") >= 0.5).cast("int")).alias("n1"), F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_column: str = "toxic", rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The language model from all texts; the lexicon, and the rates of its evidence, from at most ``rows`` labelled ones."""
    language = language_model(docs, text_column)
    label = sample(labels, label_column, usable, rows, id_column)
    model = Model(language, {}, {})
    if not label:
        return model

    def found():
        memo = Memo(lambda w: restore(w, language))
        return lambda text: {r for w in all_words(text) for x in memo[w] for r in roots(x)} | {""}

    stats = saved(_labelled(docs, label, id_column, text_column, found, "k string, y int, f long"))
    whole = stats.where("k = ''").first()
    base = whole["n1"] / whole["n"] if whole else 0.0
    if 0 < base < 1:
        share = F.col("n1") / F.col("n")
        gain = F.col("n1") * F.log(share / base) + F.when(F.col("n1") < F.col("n"), (F.col("n") - F.col("n1")) * F.log((1 - share) / (1 - base))).otherwise(0)
        kept = stats.where((F.col("k") != "") & (F.col("n1") > 0)).withColumn("gain", gain).where((share >= max(LEAST_SHARE, 2 * base)) & (F.col("gain") >= math.log(stats.count()) + 2))
        model.roots = {r["k"]: ((r["n1"] + 0.5) / (r["n"] + 1), r["gain"]) for r in kept.collect()}

    def cells():
        memo = model.memo()
        return lambda text: (model.evidence(text, memo),)

    model.rates = {r["k"]: (r["n1"] + base) / (r["n"] + 1) for r in _labelled(docs, label, id_column, text_column, cells, "k long, y int, f long").collect()}
    discard(stats)
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """docs, all columns as they are, with a score column."""
    docs = others(docs, score_column)
    names = [*docs.columns, score_column]
    at = docs.columns.index(text_column)

    def rate(batches):
        memo = model.memo()
        for batch in batches:
            texts = texts_of(batch.column(at))
            scores = [s for a, b in slices([len(t) for t in texts]) for s in model.scores(texts[a:b], memo)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return map_batches(docs, rate, T.StructType(docs.schema.fields + [T.StructField(score_column, T.DoubleType())]))
