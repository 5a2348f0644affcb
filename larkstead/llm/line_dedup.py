"""Line dedup by winnowing: later repeats of lines and of runs of words are deleted.

Two kinds of units are hashed by their words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased):

* real lines (between bytes 10 to 13). A line of ``least`` or more words is a unit; a shorter one makes
  units with the lines that follow it, and with those before it, as many as it takes to ``least``
  words. So a repeat of lines extends both ways over short ones, and units with equal words are
  equal however their lines break;
* as passages need not start at a line break, sliding lines: each run of ``line`` successive words. Of
  every window of ``run - line + 1`` successive ones the least hash is a fingerprint, so any ``run``
  words that occur twice share one in the same place: that is the guarantee.

Hashes of real lines and fingerprints that occur again (a bit set of them) give the positions to be
joined. A match of fingerprints extends as far both ways as the runs of ``run`` words around it
are equal: stretches of runs around one fingerprint are compared as a whole, and run by run where
they differ. The earliest unit or run in order of (id, position) stays, later ones are deleted: a word
goes if a later repeat covers it; exactly that, whatever the partitioning. Texts that equal an
earlier one go whole. With ``least`` None there are runs alone, and texts under ``run`` words stay.

What remains of a text keeps its own white space. Null texts stay null; an empty table gives no
rows. Whole-number ids are ordered as numbers, all others as text; null ids come first. Rows with
one id are one document in several versions, which don't delete from one another. Columns may have
any names; one named as the column of removed words is replaced. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HASH_BYTES, POLYNOMIAL, _powers, bit_set, bits_for, discard, fresh, in_bits, map_batches, mix, others, runs_of, saved, slices, text_bytes, text_slices, word_places

RUN, LINE = 50, 16
#: Words of the shortest unit of real lines.
LEAST = 5
#: Stands for a null id.
NO_ID = -(1 << 63)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values, by doubling."""
    n, size = len(x) - w + 1, 1
    out = x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[w - size : w - size + n]) if n > 0 else x[:0]


def selected(u: np.ndarray, m: np.ndarray, w: int) -> np.ndarray:
    """Units that are the least of a window: those that equal the largest minimum of the windows that hold them."""
    padded = np.zeros(len(m) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(m)] = m
    return np.flatnonzero(~window_min(~padded, w)[: len(u)] == u)


def windows(h: np.ndarray, counts: np.ndarray, run: int, line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, window minima, whether a window lies in one text, text of each word) of texts end to end.

    Minima of windows across texts are 0.
    """
    u = runs_of(h, line)
    m = window_min(u, run - line + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[: len(m)] == text[run - 1 : run - 1 + len(m)]
    return u, np.where(inside, m, np.uint64(0)), inside, text


def line_firsts(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each word, by where it begins in the bytes of texts end to end, is the first of a line."""
    out = np.zeros(len(starts) + 1, bool)
    out[np.searchsorted(starts, np.flatnonzero(data - np.uint8(10) <= 3))] = True
    out[np.cumsum(counts) - counts] = True
    return out[:-1]


def lines_of(h: np.ndarray, firsts: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words, words) of the units of real lines, from the words' hashes, whether a word is the first of a line, and its text."""
    starts = np.flatnonzero(firsts)
    n = np.diff(np.append(starts, len(h)))
    own, last = text[starts], len(starts) - 1
    units = []
    for step in (1, -1):
        at, words, end = np.flatnonzero(n < least), n[n < least], np.flatnonzero(n < least)
        for _ in range(least - 1):
            after = np.clip(end + step, 0, max(last, 0))
            more = (words < least) & (after != end) & (own[after] == own[at])
            words = words + np.where(more, n[after], 0)
            end = np.where(more, after, end)
        units.append((np.minimum(at, end) << 32 | words)[words >= least])
    # Each unit once: its first line and its words, as one number.
    whole = np.flatnonzero(n >= least)
    units = np.unique(np.concatenate([*units, whole << 32 | n[whole]]))
    starts, n = starts[units >> 32], units & 0xFFFFFFFF
    up, down = _powers(0xBF58476D1CE4E5B9, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    # Another constant than that of runs: a unit is equal to units only.
    out = mix((sums[starts + n] - sums[starts]) * down[starts] + n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for i in np.flatnonzero(n > POLYNOMIAL).tolist():
        out[i] = xxhash.xxh3_64_intdigest(h[starts[i] : starts[i] + n[i]].tobytes())
    return out, starts, n


def order_key(docs: DataFrame, id_column: str) -> Column:
    """The id as a number, or else as text, without nulls: they are the least."""
    if docs.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    return F.when(F.col(id_column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(id_column).cast("string")))


def _scan(keyed: DataFrame, per_slice, names: list[str]) -> DataFrame:
    """Columns that per_slice(word hashes, words of each text, text hashes, whether a word is the first of a line) makes of the rows (t, i, s): longs, ``i`` by places of rows, and ``r`` bytes."""

    def f(batches):
        for batch in batches:
            own = batch.column(2).to_numpy()
            for a, b, h, counts, data, starts in text_slices(batch.column(0), places=True):
                columns = per_slice(h, counts, own[a:b], line_firsts(data, starts, counts))
                columns = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64, copy=False)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pc.add(c, a)) if n == "i" else c for n, c in zip(names, columns, strict=True)], names=names)

    kinds = {"i": keyed.schema["i"].dataType, "r": T.BinaryType()}
    return map_batches(keyed, f, T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names]))


def marks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, line: int = LINE, least: int | None = None) -> DataFrame:
    """(i, s, p, n): order key of the id, text hash, first word and words of each later repeat; p is -1 if the whole text is one."""
    units = run - line + 1
    keyed = docs.select(F.col(text_column).alias("t"), order_key(docs, id_column).alias("i"), F.xxhash64(text_column).alias("s"))
    ids = saved(keyed.select("i", "s"))
    first = ids.groupBy("s").agg(F.min("i").alias("first"), F.max("i").alias("last")).where("first < last").select(F.col("s").alias("k"), "first")
    copied = saved(first)
    again = bit_set(copied, "k", bits_for(copied.count()))
    whole = ids.join(copied, F.col("s") == F.col("k")).where("i > first").select("i", "s", F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))

    # Fingerprints of each text, once each; with the text's hash if the text has copies (which count once), else 0, and 2 for those the text has twice.
    def prints(h, counts, s, firsts):
        u, m, _, text = windows(h, counts, run, line)
        at = selected(u, m, units)
        f, own = u[at].view(np.int64), text[at]
        if least:
            r, at, _ = lines_of(h, firsts, text, least)
            f, own = np.concatenate([f, r.view(np.int64)]), np.concatenate([own, text[at]])
        order = np.lexsort((f, own))
        f, own = f[order], own[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        times = np.minimum(np.diff(np.append(first, len(f))), 2)
        return f[first], np.where(in_bits(again, s), s, 0)[own[first]], times

    found = _scan(keyed, prints, ["f", "s", "n"])
    of_copies = F.when(F.col("s") != 0, F.col("s"))
    found = found.groupBy("f").agg(F.sum((F.col("s") == 0).cast("int")).alias("texts"), F.min(of_copies).alias("a"), F.max(of_copies).alias("b"), F.max("n").alias("n"))
    common = saved(found.where("n > 1 or texts > 1 or a <> b or texts = 1 and a is not null").select("f"))
    bits = bit_set(common, "f", bits_for(common.count()))
    discard(common)

    # Stretches of successive runs around one repeated fingerprint, with all their runs' hashes, and known units of lines. Repeats within a text are known at once: they get g = 0.
    def stretches(h, counts, s, firsts):
        _, m, inside, text = windows(h, counts, run, line)
        at = np.flatnonzero(inside)
        at = at[in_bits(bits, m[at])]
        r, f, n, n_runs = runs_of(h, run)[at], m[at], np.full(len(at), run), len(at)
        if least:
            of_lines, starts, words = lines_of(h, firsts, text, least)
            known = in_bits(bits, of_lines)
            r, f, at, n = (np.concatenate(x) for x in ((r, of_lines[known]), (f, of_lines[known]), (at, starts[known]), (n, words[known])))
        if not len(at):
            return [np.empty(0, np.int64)] * 6 + [pa.array([], pa.binary())]
        own = text[at]
        order = np.lexsort((at, r, own))
        again_ = np.zeros(len(at), bool)
        again_[order[1:]] = (r[order[1:]] == r[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
        f = np.where(again_, np.uint64(0), np.maximum(f, np.uint64(1)))
        new = np.ones(len(at), bool)
        before, after = slice(max(n_runs - 1, 0)), slice(1, n_runs)
        new[after] = (at[after] != at[before] + 1) | (own[after] != own[before]) | (f[after] != f[before])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        f, own, again_ = f[first], own[first], again_[first]
        # Runs of a text that are no repeats are different ones, so their sum stands for them.
        g = np.maximum(mix(np.add.reduceat(r, first) + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), np.uint64(1))
        held = np.zeros(len(first) + 1, np.int32)
        np.cumsum(np.where(again_, 0, 8 * length), out=held[1:])
        hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(held), pa.py_buffer(r[~np.repeat(again_, length)])])
        starts = np.cumsum(counts) - counts
        return f.view(np.int64), np.where(again_, np.uint64(0), g).view(np.int64), own, s[own], at[first] - starts[own], n[first] + length - 1, hashes

    found = saved(_scan(keyed, stretches, ["f", "g", "i", "s", "p", "n", "r"]))
    # Equal stretches are compared as one; runs by themselves only where stretches around one fingerprint differ, and there those of the earliest of equal stretches.
    classes = saved(found.where("g <> 0").groupBy("g").agg(F.min("i").alias("e"), F.max("i").alias("l"), F.min("f").alias("f")))
    mixed = saved(classes.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"))
    unlike = bit_set(mixed, "f", bits_for(mixed.count()))
    discard(mixed)
    earliest = classes.where("e < l").select(F.col("g").alias("q"), "e")
    later = found.where("g <> 0").select("g", "i", "s", "p", "n").join(earliest, F.col("g") == F.col("q")).where("i > e").select("i", "s", "p", "n")

    def compared(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bits(unlike, batch.column(0).to_numpy()))).select([1, 2, 3, 4, 5, 6])

    def exploded(batches):
        for batch in batches:
            i, s, p, n, r = batch.columns
            length = pc.binary_length(r).to_numpy() // 8
            row = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(row)) - (np.cumsum(length) - length)[row]
            r = pa.array(np.frombuffer(b"".join(r.to_pylist()), np.int64))
            p, n = pa.array(p.to_numpy()[row] + place), pa.array((n.to_numpy() - length + 1)[row])
            yield pa.RecordBatch.from_arrays([r, i.take(pa.array(row)), s.take(pa.array(row)), p, n], names=["r", "i", "s", "p", "n"])

    kind = keyed.schema["i"].dataType.simpleString()
    apart = map_batches(found.where("g <> 0"), compared, f"g long, i {kind}, s long, p long, n long, r binary")
    apart = apart.join(earliest, F.col("g") == F.col("q"), "left").where("e is null or i = e").select("i", "s", "p", "n", "r")
    rows = saved(map_batches(apart, exploded, f"r long, i {kind}, s long, p long, n long"))
    earliest = rows.groupBy("r").agg(F.min("i").alias("e"), F.max("i").alias("l")).where("e < l").select(F.col("r").alias("q"), "e")
    later = later.union(rows.join(earliest, F.col("r") == F.col("q")).where("i > e").select("i", "s", "p", "n"))
    return later.union(found.where("g = 0").select("i", "s", "p", "n")).union(whole)


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, line: int = LINE, removed_column: str = "n_removed", least: int | None = None) -> DataFrame:
    """docs, all columns in place, with later repeats cut out of the text and the number of words removed."""
    docs = others(docs, removed_column)
    found = saved(marks(docs, id_column, text_column, run, line, least).groupBy("i", "s").agg(F.array_sort(F.collect_set(F.expr("p * 4294967296 + n"))).alias("p")))
    keys = saved(found.select(F.xxhash64("i", "s").alias("k")))
    bits = bit_set(keys, "k", bits_for(keys.count()))
    discard(keys)
    names = docs.columns
    at = names.index(text_column)
    i, s, k, i_found, s_found, p = fresh(names, "_i", "_s", "_k", "_i_found", "_s_found", "_p")
    keyed = docs.withColumns({i: order_key(docs, id_column), s: F.xxhash64(text_column)}).withColumn(k, F.xxhash64(i, s))
    schema = T.StructType(docs.schema.fields + [T.StructField(removed_column, T.LongType())])

    def split(marked: bool):
        def f(batches):
            for batch in batches:
                yes = in_bits(bits, batch.column(len(names) + 2).to_numpy())
                kept = batch.filter(pa.array(yes == marked))
                yield kept if marked else pa.RecordBatch.from_arrays([*kept.columns[: len(names)], pa.array(np.zeros(kept.num_rows, np.int64))], names=[*names, removed_column])

        return f

    def remove(batches):
        for batch in batches:
            texts, removed = cut(batch.column(at), batch.column(len(names)), 1 if least else run)
            columns = [*batch.columns[:at], texts, *batch.columns[at + 1 : len(names)], pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, removed_column])

    # Rows without marks stay where they are; only the others' texts are shuffled.
    clean = map_batches(keyed, split(False), schema)
    touched = map_batches(keyed, split(True), keyed.schema)
    joined = touched.join(found.select(F.col("i").alias(i_found), F.col("s").alias(s_found), F.col("p").alias(p)), (F.col(i) == F.col(i_found)) & (F.col(s) == F.col(s_found)), "left").select(*names, p)
    return clean.union(map_batches(joined, remove, schema))


def cut(column: pa.Array, marks: pa.Array, shortest: int) -> tuple[pa.Array, np.ndarray]:
    """(texts without the repeats ``marks`` (2**32 * first word + words; negative for all), nor the white space before each; words removed).

    Texts under ``shortest`` words, or without marks, stay.
    """
    data, offsets = text_bytes(column)
    n_marks = marks.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    ends_of_marks = np.cumsum(n_marks)
    flat, of = marks.flatten().to_numpy(), np.repeat(np.arange(len(column)), n_marks)
    texts, sizes, removed = [], np.diff(offsets), np.zeros(len(column), np.int64)
    for a, b in slices(sizes.tolist(), HASH_BYTES):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        mine = slice(ends_of_marks[a] - n_marks[a], ends_of_marks[b - 1])
        starts, ends = word_places(own, off)
        at = np.searchsorted(starts, off)
        n = np.diff(at)
        text, mark = of[mine] - a, flat[mine]
        known = n[text] >= max(shortest, 1)
        text, mark = text[known], mark[known]
        whole = text[mark < 0]
        first = np.where(mark < 0, 0, mark >> 32) + at[text]
        words = np.where(mark < 0, n[text], mark & 0xFFFFFFFF)
        gone = np.cumsum(np.bincount(first, minlength=len(starts) + 1) - np.bincount(first + words, minlength=len(starts) + 1))[:-1] > 0
        # With each word go the bytes from the end of the one before, or where the text begins; with the last of a whole text the rest.
        some = n > 0
        before = np.append(0, ends)[:-1]
        before[at[:-1][some]] = off[:-1][some]
        ends[at[whole + 1] - 1] = off[whole + 1]
        turns = np.zeros(len(own) + 1, np.int8)
        turns[before[gone]] += 1
        turns[ends[gone]] -= 1
        stays = np.cumsum(turns[:-1], dtype=np.int8) == 0
        texts.append(own[stays])
        sizes[a:b] = np.diff(np.append(0, np.cumsum(stays))[off])
        removed[a:b] = np.diff(np.append(0, np.cumsum(gone))[at])
    places = np.zeros(len(column) + 1, np.int32)
    np.cumsum(sizes, out=places[1:])
    out = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(places), pa.py_buffer(np.concatenate([*texts, np.empty(0, np.uint8)]))])
    return pc.if_else(column.is_valid(), out, pa.scalar(None, pa.string())) if column.null_count else out, removed
