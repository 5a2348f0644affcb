"""Best-fit packing of token sequences by exact-complement hashing.

``tokenise`` cuts documents into pieces, ``pack`` places pieces. Packing needs the number of
pieces of each length only: at most ``capacity`` counts reach the driver, whatever the data's
size. The plan made there says, for each length, which sequence and offset the r-th piece of that
length gets; the executors rank pieces within lengths and look the plan up.

Null text is empty (one end id); repeated rows and ids are packed one by one; an empty table gives
no rows; texts of any length are cut, never shortened. Columns beside those named aren't read.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, rank_in_groups, slices, texts_of

END_ID = 1


# The tokenizer's own pre-token pattern (letters, single digits, anything else), for lower-cased texts of Latin-1 characters.
LETTER, DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\x20\x09-\x0d{LETTER}{DIGIT}]+")
#: Texts that this pattern cuts as the tokenizer does; special tokens begin with SPECIAL.
SIMPLE, SPECIAL = re.compile("[\x20\x09-\x0d\x21-\x7e\xa1-\xac\xae-\xff]*"), "<|"
#: Pre-tokens and words that a worker remembers before it starts anew (results don't depend on it), and characters of those that it doesn't.
CACHE_CORES, LONG_CORE = 600_000, 200


class WordIds:
    """Ids of texts as little-endian bytes.

    The tokenizer drops white space and never joins across pre-tokens, so a text's ids are those of
    its pre-tokens in order. These are remembered; new ones are encoded many at once, and told apart
    by the tokens that end one. Texts with other characters than Latin-1 ones, or with a special
    token's mark, are cut at white space, and their words encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        simple = [x for x in parts if SIMPLE.fullmatch(x) and SPECIAL not in x]
        for x in parts.difference(simple):
            self.known[x] = self.encode(x)
        for at in range(0, len(simple), 4000):
            some = simple[at : at + 4000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for x, stop in zip(some, (4 * stops).tolist(), strict=True):
                    self.known[x] = raw[start:stop]
                    start = stop
            else:
                for x in some:
                    self.known[x] = self.encode(x)

    def texts(self, texts: list[bytes]) -> list[bytes]:
        split = []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            if SIMPLE.fullmatch(text) and SPECIAL not in text:
                split.append(PRE_TOKENS.findall(text.lower()))
            else:
                split.append([w.decode("utf-8", "replace") for w in raw.split()])
        if len(self.known) > CACHE_CORES:
            self.known.clear()
        if new := set().union(*split).difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, own)) for own in split]
        for x in new:
            if len(x) > LONG_CORE:
                del self.known[x]
        return out


@lru_cache(maxsize=2)
def _word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def tokenise(docs: DataFrame, tokenizer_file: str, capacity: int, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, with keep_ids, token_ids): each text's ids and one end id, cut every ``capacity``."""
    kept = docs.select(F.col(id_column), F.col(text_column))
    fields = [kept.schema[0], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    schema = T.StructType(fields + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    end, step = struct.pack("<I", END_ID), 4 * capacity

    def cut(batches):
        encoder = _word_ids(tokenizer_file)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices([len(x) for x in texts]):
                rows, ids = [], []
                for i, own in enumerate(encoder.texts(texts[a:b]), a):
                    own += end
                    for piece, at in enumerate(range(0, len(own), step)):
                        part = own[at : at + step]
                        rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                        if keep_ids:
                            ids.append(part)
                row, *columns = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                if keep_ids:
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *columns[2]]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return map_batches(kept, cut, schema)


class Lengths:
    """Counts by length, with an index of single lengths and one of pair sums.

    Both are bit masks over sums: ``ones`` (a length in stock) and ``twos`` (``pairs`` has the lengths
    that make such a sum). They are also kept mirrored, so that the lengths whose complement is in an
    index are one AND: complements of singles make pairs, complements of pairs triples. Stock only
    shrinks, so pair sums that it no longer allows are dropped when they are looked up.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.stock = capacity, dict(counts)
        self.ones = sum(1 << n for n, c in counts.items() if c)
        self.ones_mirrored = sum(1 << (capacity - n) for n, c in counts.items() if c)
        self.pairs = [self._live(s) for s in range(capacity + 1)]
        self.twos_mirrored = sum(1 << (capacity - s) for s, x in enumerate(self.pairs) if x)

    def _live(self, total: int) -> int:
        """Lengths in stock whose complement to total is in stock as well."""
        hits = self.ones & (self.ones_mirrored >> (self.capacity - total)) & ((1 << total) - 1) & ~1
        return hits & ~(1 << (total // 2)) if not total % 2 and self.stock.get(total // 2, 0) == 1 else hits

    def take(self, length: int, count: int = 1) -> None:
        self.stock[length] -= count
        if not self.stock[length]:
            self.ones &= ~(1 << length)
            self.ones_mirrored &= ~(1 << (self.capacity - length))

    def largest(self, most: int) -> int:
        """The longest length in stock up to ``most``; 0 for none: what fits a gap best."""
        return max(0, (self.ones & ((2 << max(most, 0)) - 1)).bit_length() - 1)

    def pair(self, total: int, beside: int = 0) -> list[int]:
        """Two lengths in stock that sum to total, one of ``beside`` being taken already; the longest first."""
        if not self.pairs[total]:
            return []
        hits = self.pairs[total] = self._live(total)
        if not hits:
            self.twos_mirrored &= ~(1 << (self.capacity - total))
        while hits:
            a = hits.bit_length() - 1
            hits ^= 1 << a
            found = [a, total - a]
            if beside not in found or found.count(beside) < self.stock[beside]:
                return found
        return []

    def exact(self, total: int) -> list[int]:
        """One, two or three lengths in stock that sum to total; [] if there are none."""
        if self.ones >> total & 1:
            return [total]
        if found := self.pair(total):
            return found
        hits = self.ones & (self.twos_mirrored >> (self.capacity - total))
        while hits:
            a = hits.bit_length() - 1
            hits ^= 1 << a
            if 3 * a < total:
                break  # the longest of three is no shorter than a third
            if found := self.pair(total - a, a):
                return [a, *found]
        return []


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), which use up all counts.

    The longest length in stock opens a sequence. While it has a gap: lengths that fill it exactly,
    else the length that fits best. A pattern repeats as often as the stock allows.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    left, out = Lengths(counts, capacity), []
    while top := left.largest(capacity):
        pattern, gap = [top], capacity - top
        left.take(top)
        while gap:
            more = left.exact(gap) or [n for n in [left.largest(gap)] if n]
            if not more:
                break
            for n in more:
                left.take(n)
            pattern += more
            gap -= sum(more)
        used = {n: pattern.count(n) for n in set(pattern)}
        again = min(left.stock[n] // c for n, c in used.items())
        for n, c in used.items():
            if again:
                left.take(n, c * again)
        out.append((pattern, 1 + again))
    return out


def placements(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), and for each its first sequence and its offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            first = ranks.get(n, 0)
            rows.append((n << 44 | first, sequence, offset))
            ranks[n] = first + count
            offset += n
        sequence += count
    keys, sequences, offsets = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return keys, sequences, offsets


def pack(pieces: DataFrame, capacity: int, length_column: str = "length", by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset. ``pieces`` is read twice: give a saved table.

    Lengths lie between 1 and capacity. Which of several equally long pieces goes where follows
    from a hash of the ``by`` columns, so reruns agree. Columns sequence_id and offset that pieces
    has already are replaced; all others stay, whatever their names.
    """
    counts = {int(n): int(c) for n, c in pieces.groupBy(length_column).count().collect()}
    keys, sequences, offsets = placements(plan(counts, capacity))
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    order, rank = fresh(pieces.columns, "_order", "_rank")
    ranked = rank_in_groups(pieces.withColumn(order, F.xxhash64(*by)), [length_column], order, list(by), rank).select(*names, rank)
    schema = T.StructType(ranked.schema.fields[:-1] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index(length_column)

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(names)))
            k = np.searchsorted(keys, lengths << 44 | ranks, "right") - 1
            first = keys[k] & ((1 << 44) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequences[k] + ranks - first), pa.array(offsets[k])], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked, place, schema)
