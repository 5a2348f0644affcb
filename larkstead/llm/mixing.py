"""Mixing sources to target weights by subset-sum budget fitting.

Each source's share of a budget follows its weight, up to a number of repeats of all its words;
the excess goes to the others by weight. A source takes all its documents as often as the target
allows, then, for what remains, documents chosen by length: an even share of the documents of each
length (what rounding leaves goes on to the next shorter one), then a few of the shortest are given
back and a bounded-knapsack program over the leftover counts fits the last words.
Documents of equal length are told apart by a seeded hash, so reruns agree.

Null sources are a source of their own, sorted last; null texts have size 0; documents of size 0
take 0 words; an empty table gives no rows; repeated ids are separate documents. Columns beside
those named aren't read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_in_groups

WEIGHTS = (5, 2, 1)
#: Times a source's words may repeat.
MAX_REPEATS = 3
#: Documents taken, the shortest, that are given back for the knapsack program to choose from.
GIVEN_BACK = 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Target words of each source, in their order: shares of all words by weight, none above ``repeats`` times its own."""
    total = Fraction(sum(sizes))
    out: dict[int, Fraction] = {}
    weight = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while len(out) < len(sizes):
        open_ = [i for i in weight if i not in out]
        per = (total - sum(out.values())) / sum(weight[i] for i in open_)
        full = [i for i in open_ if per * weight[i] > repeats * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(repeats * sizes[i]) if full else per * weight[i]
    return [out[i] for i in range(len(sizes))]


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Length -> count whose sum is as near to the budget from below as counts allow.

    Bounded knapsack: counts are split in powers of two, ``reached`` keeps for each sum the item that
    first made it. Time is budget x items, memory budget.
    """
    reached = np.full(budget + 1, -1, np.int32)
    made = np.zeros(budget + 1, bool)
    made[0] = True
    items = []
    for n, c in sorted(zip(lengths, counts, strict=True), reverse=True):
        c, part = min(c, budget // n), 1
        while c > 0 and not made[budget]:
            part = min(part, c)
            step = n * part
            if step <= budget:
                new = made[: budget + 1 - step] & ~made[step:]
                reached[step:][new] = len(items)
                made[step:] |= new
            items.append((n, part))
            c -= part
            part *= 2
    at = int(np.flatnonzero(made)[-1])
    out: dict[int, int] = {}
    while at:
        n, part = items[reached[at]]
        out[n] = out.get(n, 0) + part
        at -= n * part
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near the budget."""
    total = int(lengths @ counts)
    if not 0 < budget < total:
        return counts * (budget >= total)
    taken = np.zeros(len(lengths), np.int64)
    order = [i for i in np.argsort(-lengths, kind="stable").tolist() if lengths[i] > 0]
    passed = used = 0
    for i in order:
        n, c = int(lengths[i]), int(counts[i])
        passed += n * c
        taken[i] = min(c, (passed * budget // total - used) // n)
        used += n * int(taken[i])
    give = GIVEN_BACK
    for i in reversed(order):
        back = min(give, int(taken[i]))
        taken[i] -= back
        used -= back * int(lengths[i])
        give -= back
    left, spare = budget - used, counts - taken
    use = [i for i in order if lengths[i] <= left and spare[i]]
    for n, c in subset_sum([int(lengths[i]) for i in use], [int(spare[i]) for i in use], left).items():
        taken[np.flatnonzero(lengths == n)[0]] += c
    return taken


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size", weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each document; ``docs`` is read three times: give a saved table.

    The driver gets one row a source; a source's lengths are planned in one task, from one row for
    each distinct length.
    """
    d = docs.select(F.col(id_column), F.col(source_column).alias("_source"), F.col(size_column).cast("long").alias("_size"))
    totals = d.groupBy("_source").agg(F.sum("_size").alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    goal = targets([r["n"] for r in totals], weights, repeats)
    of = {r["_source"]: (int(r["n"]), t) for r, t in zip(totals, goal, strict=True)}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        source = group["_source"].iloc[0]
        size, target = of[None if pd.isna(source) else source]
        copies = int(target // size) if size else 0
        group["_take"] = fit(group["_size"].to_numpy(np.int64), group["_n"].to_numpy(np.int64), round(target - copies * size))
        return group.assign(_copies=copies, _total=size, _target=float(target))[["_source", "_size", "_take", "_copies", "_total", "_target"]]

    lengths = d.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    kind = d.schema["_source"].dataType.simpleString()
    chosen = lengths.groupBy("_source").applyInPandas(choose, f"_source {kind}, _size long, _take long, _copies long, _total long, _target double")
    chosen = chosen.withColumnsRenamed({"_source": "_s", "_size": "_z"})
    ranked = rank_in_groups(d.withColumn("_order", F.xxhash64(F.lit(seed), id_column)), ["_source", "_size"], "_order", [id_column], "_rank")
    copies = F.col("_copies") + (F.col("_rank") < F.col("_take")).cast("long")
    return ranked.join(chosen, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))).select(
        id_column, F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken")
    )
