"""N-gram Jaccard join with a token-group matrix, and the classes it links.

A text's set is its distinct shingles of ``words`` successive words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); with fewer words the whole sequence is one shingle; without words the set is empty
and linked with nothing. Two sets link when den * |A & B| >= num * |A | B|. No link is missed or
made up but by a collision of hashes (48 bits within a pair of sets, else 64).

1. Equal sets are one class, found by a hash of the set.
2. All shingles get one order: the most frequent ones (by a sample of classes, into a bit set of
   bounded size) last, then by hash. Linked sets share a shingle among their first
   n - ceil(t n) + 1, their prefixes. Shingles that only one prefix has are set aside.
3. A shingle's rest is what its set holds from it on. At the first shingle that two sets share, they
   share no more than the smaller of their rests; so at each shingle, a set looks for smaller or
   equal sets in a range of sizes that its rest allows, and only early shingles can be found.
4. Similar classes form groups: each is compared with one leader, the class with most copies among
   those it shares most prefix shingles with; the links found make groups, which are connected.
5. The matrix holds, for each prefix shingle and band of sizes, the groups whose union of prefixes
   has it, with their range of sizes and largest rest. It bounds how much of a class any member of
   a group can share; only groups that may reach the threshold are opened, and their members
   compared. The bound is how many prefix shingles of the class the group's union has, and all
   that follows the prefix. A shingle that many groups have late in their order makes no pairs.
   Pairs are compared by prefixes first, which leaves few, and those by whole sets.
6. Links of steps 4 and 5 give the components. Within a group, all links are counted: its classes
   are dealt to cells by bands of sizes, and two cells that may hold linked sizes are compared at
   once, by a product of their class-token matrices. Only counts by class leave a pair of cells.

A class stands for its copies, which are never paired with one another. Null texts are empty. Rows with equal ids are separate rows of one result; null ids are kept and don't name a
component unless it has no others. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_set, bits_for, components, discard, in_bits, lists, map_batches, runs_of, saved, text_slices

#: One class in SAMPLE is sampled for frequent shingles; those that FREQUENT of the sample have come last, HOT of them at most (the most frequent).
SAMPLE, FREQUENT, HOT = 8, 8, 1 << 21
#: Bytes of set data that a Python worker unpacks at once.
PAIR_BYTES = 2 << 20
#: Ratio of the sizes that a band takes in.
BAND = 1.1
#: Classes and bytes of set data that a cell of a group holds, about; tokens that a product of matrices takes at once.
CELL, CELL_BYTES, TOKENS = 256, 1 << 20, 1 << 11


def sets_of(h: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, from the word hashes of all."""
    out, at = [], 0
    all_runs = runs_of(h, k).view(np.int64)
    for n in counts.tolist():
        if n >= k:
            s = np.sort(all_runs[at : at + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(runs_of(h[at : at + n], n).view(np.int64) if n else h[:0].view(np.int64))
        at += n
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int, num: int, den: int) -> int:
    """ceil(t n): shingles that a set of n shares with any linked set at least."""
    return -(-num * n // den)


def _over(docs: DataFrame, columns: list[str], k: int, per_set, schema: T.StructType | str, make) -> DataFrame:
    """mapInArrow over texts: per_set(i, set, id of the set) for each row, ``make`` of each slice's results."""
    kept = docs.select(*columns)

    def f(batches):
        state: dict = {}
        for batch in batches:
            for a, _, h, counts in text_slices(batch.column(batch.num_columns - 1)):
                out = [per_set(i, s, set_id(s), state) for i, s in enumerate(sets_of(h, counts, k), a)]
                yield make(batch, [x for x in out if x is not None])

    return map_batches(kept, f, schema)


def _arrays(rows: list[tuple], n_longs: int) -> list[pa.Array]:
    """Columns of rows: n_longs longs, then one array of longs."""
    columns = list(zip(*rows, strict=True)) or [[]] * (n_longs + 1)
    return [*(pa.array(c, pa.int64()) for c in columns[:n_longs]), lists(np.concatenate(columns[-1]) if rows else np.empty(0, np.int64), [len(x) for x in columns[-1]], pa.int64())]


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame, flat, keep) -> DataFrame:
    """The pairs (a, b) for which keep(n, m, shared) holds; left and right have a node's e, n and sorted data, which ``flat`` unpacks."""
    left, right = (side.select(F.col("e").alias(k), F.col("n").alias(f"n_{k}"), F.col("data").alias(f"data_{k}")) for side, k in ((left, "a"), (right, "b")))
    both = left.join(pairs, "a").join(right, "b").select("a", "b", "n_a", "n_b", "data_a", "data_b")

    def f(batches):
        for batch in batches:
            start = 0
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) * 8 // PAIR_BYTES)) + 1, len(sizes))
            for end in ends.tolist():
                some = batch.slice(start, end - start)
                start = end
                (x, at_x), (y, at_y) = flat(some.column(4)), flat(some.column(5))
                n_m = zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)
                yield some.select([0, 1]).filter(pa.array([keep(n, m, common(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]])) for i, (n, m) in enumerate(n_m)], pa.bool_()))

    return map_batches(both, f, "a long, b long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def flat_list(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(), column.offsets.to_numpy()


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each shingle hash: what sets are compared by."""
    return s.astype("<i8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def flat_packed(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of packed sets end to end (the lower 16 bits are 0), and where each set begins."""
    _, where, what = column.buffers()
    at = np.frombuffer(where, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(what, np.uint8, at[-1] - at[0], at[0]) if what is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<i8").ravel(), (at - at[0]) // 6


def overlaps(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """How many values each set of x shares with each of y, by products of their incidence matrices."""
    n, m = len(at_x) - 1, len(at_y) - 1
    row = np.repeat(np.arange(n + m), np.concatenate([np.diff(at_x), np.diff(at_y)]))
    _, token, count = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[token] > 1)
    row, token = row[some], (np.cumsum(count > 1) - 1)[token[some]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((n, m), np.int64)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS):
        a, b = np.searchsorted(token, (low, low + TOKENS))
        matrix = np.zeros((n + m, TOKENS), np.float32)
        matrix[row[a:b], token[a:b] - low] = 1
        out += (matrix[:n] @ matrix[n:].T).astype(np.int64)
    return out


def _counted(members: DataFrame, num: int, den: int) -> DataFrame:
    """(e, classes, copies): with how many classes of its group, and copies of those, each member (g, e, n, copies, data) links; all pairs of a group are compared."""
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("data")).alias("bytes")).where("c > 1")
    whole = (F.col("c") <= CELL) & (F.col("bytes") <= CELL_BYTES)
    placed = members.select("g", "e", "n", F.length("data").alias("size")).join(groups, "g").withColumn("z", F.when(whole, 0).otherwise(F.floor(F.log("n") / math.log(BAND)).cast("int")))
    parts = placed.groupBy("g", "z").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("size") / CELL_BYTES)).alias("parts"))
    placed = saved(placed.join(parts, ["g", "z"]).select("g", "e", "n", "z", F.pmod(F.xxhash64("e"), "parts").alias("p")))
    cells = saved(placed.groupBy("g", "z", "p").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    one, two = (cells.select("g", *[F.col(c).alias(f"{c}{i}") for c in ("z", "p", "low", "high")]) for i in (1, 2))
    near = one.join(two, "g").where(f"struct(z1, p1) <= struct(z2, p2) and {den} * high1 >= {num} * low2 and {den} * high2 >= {num} * low1")
    key = ["g", "z1", "p1", "z2", "p2"]
    sides = near.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("z1").alias("z"), F.col("p1").alias("p")), F.struct(F.lit(2).alias("side"), F.col("z2").alias("z"), F.col("p2").alias("p")))).alias("s"))
    sides = sides.where("s.side = 1 or z1 <> z2 or p1 <> p2").select(*key, "s.*")
    dealt = placed.select("g", "e", "z", "p").join(sides, ["g", "z", "p"]).join(members.select("e", "n", "copies", "data"), "e").select(*key, "side", "e", "n", "copies", "data")

    def f(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        e, n, copies = (table.column(c).to_numpy() for c in ("e", "n", "copies"))
        side, data = table.column("side").to_numpy(), table.column("data").combine_chunks()
        own = [np.flatnonzero(side == i) for i in (1, 2)]
        same = not len(own[1])
        if same:
            own[1] = own[0]
        (x, at_x), (y, at_y) = (flat_packed(data.take(pa.array(rows))) for rows in own)
        shared = overlaps(x, at_x, y, at_y)
        linked = den * shared >= num * (n[own[0]][:, None] + n[own[1]] - shared)
        if same:
            np.fill_diagonal(linked, False)
        ways = [(own[0], own[1], linked)] if same else [(own[0], own[1], linked), (own[1], own[0], linked.T)]
        columns = [np.concatenate(c) for c in zip(*[(e[a], way.sum(axis=1), way @ copies[b]) for a, b, way in ways], strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["e", "classes", "copies"])

    found = saved(dealt.groupBy(*key).applyInArrow(f, "e long, classes long, copies long").where("classes > 0"))
    discard(placed, cells)
    return found


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, links, class_links, class_id) of each row.

    component_id is the smallest id that links reach; links is the number of other rows that the row
    links with, copies included; class_links that of other classes, which have different sets;
    class_id is the hash of its set.
    """
    # 1. Classes, and the sample's sets.
    def whole(i, s, e, state):
        first = len(s) and e % SAMPLE == 0 and e not in state
        if first:
            state[e] = True
        return i, len(s), e, s if first else s[:0]

    id_field = T.StructField("i", docs.schema[id_column].dataType)
    text = [F.col(id_column).alias("i"), F.col(text_column).alias("t")]
    first_schema = T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("e", T.LongType()), T.StructField("sample", T.ArrayType(T.LongType()))])

    def first_batch(batch, rows):
        places, *others = zip(*rows, strict=True) if rows else ([], [], [], [])
        arrays = _arrays(list(zip(*others, strict=True)), 2)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *arrays], names=["i", "n", "e", "sample"])

    rows = saved(_over(docs, text, words, whole, first_schema, first_batch))
    classes = saved(rows.where("n > 0").groupBy("e").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    copied = saved(classes.where("copies > 1").select("e"))
    twice = bit_set(copied, "e", bits_for(copied.count()))
    hot = _frequent(rows)
    discard(copied)

    def once(found: DataFrame) -> DataFrame:
        """One row a class: only those whose text has copies need to be looked at."""
        return found.where("d = 0").union(found.where("d = 1").dropDuplicates(["e"]))

    # 2. Prefixes, once for each class and task; then without shingles that only one has.
    def prefix(i, s, e, state):
        if not len(s) or e in state:
            return None
        state[e] = True
        order = np.lexsort((s, in_bits(hot, s)))
        return e, len(s), int(in_bits(twice, np.array([e]))[0]), s[order[: len(s) - least_overlap(len(s), num, den) + 1]]

    prefixes = saved(_over(docs, text[1:], words, prefix, "e long, n long, d long, p array<long>", lambda batch, out: pa.RecordBatch.from_arrays(_arrays(out, 3), names=["e", "n", "d", "p"])))
    shared = saved(once(prefixes).select(F.explode("p").alias("k")).groupBy("k").count().where("count > 1").select("k"))
    several = bit_set(shared, "k", bits_for(shared.count()))
    discard(shared)

    def keep(batches):
        for batch in batches:
            out = []
            for e, n, d, p in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                p = p.values.to_numpy()
                at = np.flatnonzero(in_bits(several, p))
                if len(at):
                    at = at[np.argsort(p[at])]
                    out.append((e, n, d, n - at, p[at]))
            rests = [x[3] for x in out]
            a = _arrays([(*x[:3], x[4]) for x in out], 3)
            yield pa.RecordBatch.from_arrays([*a, lists(np.concatenate(rests) if rests else np.empty(0, np.int64), list(map(len, rests)), pa.int64())], names=["e", "n", "d", "p", "r"])

    kept = once(map_batches(prefixes, keep, "e long, n long, d long, p array<long>, r array<long>"))
    nodes = saved(kept.join(classes.select("e", "copies"), "e").select("e", "n", "copies", "p", "r"))
    discard(prefixes)

    def plausible(n: int, m: int, shared: int) -> bool:
        # Beyond common prefix shingles, only what follows the longer prefix can be common.
        rest = max(least_overlap(n, num, den), least_overlap(m, num, den)) - 1
        return (num + den) * (shared + rest) >= num * (n + m)

    def links(n: int, m: int, shared: int) -> bool:
        return den * shared >= num * (n + m - shared)

    def sets(pairs: DataFrame) -> DataFrame:
        """(e, n, data) of the classes in pairs, one row each, by one pass over the texts."""
        named = saved(pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct())
        wanted = bit_set(named, "e", bits_for(named.count()))
        discard(named)

        def full(i, s, e, state):
            if not len(s) or e in state or not in_bits(wanted, np.array([e]))[0]:
                return None
            state[e] = True
            return e, len(s), int(in_bits(twice, np.array([e]))[0]), packed(s)

        def made(batch, out):
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["e", "n", "d", "data"])

        found = saved(_over(docs, text[1:], words, full, "e long, n long, d long, data binary", made))
        out = saved(once(found).drop("d"))
        discard(found)
        return out

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The pairs that link, by their prefixes first, then by the sets of those that are left; and these sets."""
        short = nodes.select("e", "n", F.col("p").alias("data"))
        pairs = saved(_compared(pairs, short, short, flat_list, plausible))
        if not pairs.count():
            return pairs, None
        data = sets(pairs)
        out = saved(_compared(pairs, data, data, flat_packed, links))
        discard(pairs)
        return out, data

    # 4. Groups around leaders.
    posts = nodes.select("e", "n", "copies", F.explode(F.arrays_zip("p", "r")).alias("x")).select("e", "n", "copies", F.col("x.p").alias("k"), F.col("x.r").alias("rest"))
    near_size = f"{den} * m >= {num} * n and {den} * n >= {num} * m"
    lead = posts.groupBy("k").agg(F.max(F.struct("copies", "e", "n")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("k", F.col("top.e").alias("b"), F.col("top.n").alias("m"))
    near = posts.join(lead, "k").where("e <> b").where(near_size).groupBy("e", "b").agg(F.count(F.lit(1)).alias("c"))
    best = near.groupBy("e").agg(F.max(F.struct("c", "b")).alias("x")).select(F.col("e").alias("a"), F.col("x.b").alias("b"))
    stars, data = verified(best)
    groups = saved(components(stars)) if stars.count() else None

    def with_group(df: DataFrame, out: str) -> DataFrame:
        if groups is None:
            return df.withColumn(out, F.col("e"))
        return df.join(groups.select(F.col("node").alias("e"), "root"), "e", "left").withColumn(out, F.coalesce("root", "e")).drop("root")

    # 5. The token-group matrix, the bound, and the members of qualifying groups. A pair is found from its larger set.
    sum_ = num + den

    def band(size: str) -> str:
        return f"cast(floor(ln({size}) / {math.log(BAND)!r}) as int)"

    grouped = saved(with_group(posts.drop("copies"), "g"))
    # |A & B| >= t / (1 + t) (|A| + |B|): at the first shared shingle, both rests reach that.
    index = grouped.where(f"{sum_} * rest >= {2 * num} * n").groupBy("k", F.expr(band("n")).alias("z"), F.col("g").alias("h")).agg(F.min("n").alias("low"), F.max("rest").alias("most"))
    low, high = f"ceil({num} * n / {den})", f"least(n, floor({sum_} * rest / {num}) - n)"
    asked = grouped.withColumns({"low": F.expr(low), "high": F.expr(high)}).where("high >= low")
    asked = asked.select("k", "e", "n", "g", "rest", F.explode(F.expr(f"sequence({band('low')}, {band('high')})")).alias("z"))
    may = f"g <> h and low <= n and {sum_} * least(rest, most) >= {num} * (n + low)"
    opened = asked.join(index, ["k", "z"]).where(may).select("e", "n", "h", "z").distinct()
    # A member can share no more than the shingles that the group's union has of the prefix, and all that follows the prefix.
    matrix = grouped.groupBy("k", F.expr(band("n")).alias("z"), F.col("g").alias("h")).agg(F.min("n").alias("low"))
    matched = opened.join(grouped.select("e", "k"), "e").join(matrix, ["k", "z", "h"]).groupBy("e", "n", "h", "z").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low"))
    opened = saved(matched.withColumn("most", F.expr(f"c + ceil({num} * n / {den}) - 1")).where(f"{sum_} * most >= {num} * (n + low)"))
    members = with_group(nodes.select("e", F.col("n").alias("m")), "h").withColumnRenamed("e", "b").withColumn("z", F.expr(band("m")))
    pairs = opened.join(members, ["h", "z"]).where(f"{near_size} and {sum_} * most >= {num} * (n + m) and (m < n or m = n and b < e)").select(F.col("e").alias("a"), "b")
    across, others = verified(pairs)
    discard(nodes, grouped, opened, others)

    # 6. All links of each class, and components, named by their smallest id.
    found = stars.union(across)
    named = classes.select("e", "first", "copies")
    if found.count():
        roots = saved(components(found))
        # Links across groups are all in ``across``, once each; those within, the stars too, are counted.
        ways = across.union(across.select("b", "a")).toDF("node", "e").join(classes.select("e", "copies"), "e").select(F.col("node").alias("e"), F.lit(1).cast("long").alias("classes"), "copies")
        within = None
        if groups is not None:
            members = saved(data.join(groups.select(F.col("node").alias("e"), F.col("root").alias("g")), "e").join(classes.select("e", "copies"), "e").select("g", "e", "n", "copies", "data"))
            within = _counted(members, num, den)
            discard(members)
            ways = ways.union(within)
        degree = ways.groupBy("e").agg(F.sum("classes").alias("class_links"), F.sum("copies").alias("linked")).withColumnRenamed("e", "node")
        known = roots.join(named.select("e", "first"), F.col("node") == F.col("e")).select("node", "root", "first")
        smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
        # Each root names its component; nodes look it up.
        known = known.join(smallest, "root").join(degree, "node", "left").select(F.col("node").alias("e"), "component_id", "class_links", "linked")
        named = named.join(known, "e", "left")
    else:
        roots = within = None
        named = named.select("*", F.col("first").alias("component_id"), F.lit(0).cast("long").alias("class_links"), F.lit(0).cast("long").alias("linked"))
    own = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    named = saved(named.select("e", F.coalesce("component_id", "first").alias("component_id"), own.alias("links"), F.coalesce("class_links", F.lit(0)).alias("class_links")))
    discard(classes, stars, across, data, *[x for x in (groups, roots, within) if x is not None])
    return rows.select("i", "n", "e").join(named, "e", "left").select(
        F.col("i").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "i")).otherwise(F.col("i")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_links", F.lit(0)).alias("class_links"), F.col("e").alias("class_id"),
    )


def _frequent(rows: DataFrame) -> np.ndarray:
    """A bit set of the sample's most frequent shingles: a fixed number at most, whatever the data."""
    sample = rows.where(F.size("sample") > 0).dropDuplicates(["e"]).select(F.explode("sample").alias("k"))
    counts = saved(sample.groupBy("k").count().where(F.col("count") >= FREQUENT))
    size = F.floor(F.log2("count") * 8)
    least, held = None, 0
    for r in counts.groupBy(size.alias("z")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("z").desc()).collect():
        held += r["c"]
        if held > HOT:
            break
        least = r["z"]
    chosen = counts.where(size >= least) if least is not None else counts.limit(0)
    out = bit_set(chosen, "k", bits_for(min(held, HOT)))
    discard(counts)
    return out
