"""What the training-data operators share: scratch tables, bit sets, words, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Bytes A-Z to a-z; nothing else changes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text that a Python worker holds as word lists, and as arrays of hashes, at once.
SLICE_BYTES, HASH_BYTES = 1 << 20, 1 << 18
#: Entries of a worker's word cache before it starts anew (results don't depend on it).
CACHE_WORDS = 300_000
#: Words of more bytes are computed anew each time rather than remembered.
LONG_KEY = 256
#: Bytes of an Arrow batch that a Python worker gets at once.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, else that of ``setCheckpointDir``; one of our own only in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = set_dir.get() if set_dir.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="larkstead-"))
        shared = _OWN_DIR[0]
    return shared.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a table of the shared folder and reads that: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES; the session's own bound holds if it is lower."""
    conf = df.sparkSession.conf
    bound = conf.get(BATCH_CONF).rstrip("b")
    if bound.isdigit() and int(bound) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to differ from all columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, name: str) -> DataFrame:
    """df without columns of that name, whatever the case: a column that is added takes their place."""
    return df.select(*[c for c in df.columns if c.lower() != name.lower()])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to about ``most``; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    return text.translate(LOWER).split()


def word_column(column: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """(words as in ``words_of`` of all texts, one after the other; words of each text) of a text column; null is empty."""
    column = column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    # Bytes are taken as they are, valid UTF-8 or not.
    text = pa.Array.from_buffers(pa.string(), len(column), column.buffers(), 0, column.offset)
    rows = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words, sizes = rows.flatten().cast(pa.binary()), rows.value_lengths().to_numpy().astype(np.int64)
    ink = pc.greater(pc.binary_length(words), 0)
    if not pc.all(ink).as_py():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ink.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(ink)
    return words, sizes


class Memo(dict):
    """word -> f(word), computed once per worker as long as it fits CACHE_WORDS."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= LONG_KEY:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value

    def many(self, keys: list) -> tuple:
        if len(keys) > 1:
            return itemgetter(*keys)(self)
        return tuple(self[k] for k in keys)


def hash64(word: bytes) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte; A-Z have those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]
#: Terms that polynomial hashes sum at most.
POLYNOMIAL = 256
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    if len(_POWERS.get(base, ((),))[0]) <= n:
        m = max(1 << 16, n + n // 8)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(m + 1, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word ``[^\\x20\\x09-\\x0D]+`` begins, where it ends) of texts that lie end to end in data."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, words of each text) of texts that lie end to end in data."""
    return placed_hashes(data, offsets)[:2]


def placed_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, words of each text, where each word begins) of texts that lie end to end in data.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Prefix sums of a polynomial over all bytes
    give each word's hash at once. Modulo 2**64 such polynomials collide by structure from 1024
    terms on (the Thue-Morse sequence), so words of more than POLYNOMIAL bytes are hashed by xxh3.
    """
    starts, ends = word_places(data, offsets)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), starts
    up, down = _powers(0x9E3779B97F4A7C15 | 1, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    for i in np.flatnonzero(ends - starts > POLYNOMIAL).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().translate(LOWER))
    return h, np.diff(np.searchsorted(starts, offsets)), starts


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive values, by prefix sums; len(h) - k + 1 of them. k is at most POLYNOMIAL."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    if k > POLYNOMIAL:
        raise ValueError(f"runs of more than {POLYNOMIAL} words")
    up, down = _powers(0xBF58476D1CE4E5B9, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    n = len(h) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, where each begins and the last ends) of a text column; null is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(what, np.uint8) if what is not None and what.size else np.empty(0, np.uint8), offsets


def text_slices(column: pa.Array, most: int = HASH_BYTES, places: bool = False) -> Iterator[tuple]:
    """(first row, last row + 1, word hashes, words of each row, and with ``places`` the bytes and where each word begins) for runs of rows of about ``most`` bytes."""
    data, offsets = text_bytes(column)
    for a, b in slices(np.diff(offsets).tolist(), most):
        own = data[offsets[a] : offsets[b]]
        h, counts, starts = placed_hashes(own, offsets[a : b + 1] - offsets[a])
        yield (a, b, h, counts, own, starts) if places else (a, b, h, counts)


def bits_for(count: int, least: int = 16, most: int = 28) -> int:
    """log2 of a bit set's size: 32 bits a key, between 8 KB and 32 MB whatever the data."""
    return int(min(most, max(least, np.ceil(np.log2(32 * max(count, 1))))))


#: Words of 64 bits that travel to the driver as one value.
PAGE = 1 << 13


def bit_set(keys: DataFrame, column: str, log2: int) -> np.ndarray:
    """A bit for the low bits of each key: never misses a key, may take in others.

    Built on the executors, in pages; the driver gets 2**log2 bits at most, so its size is bounded.
    """
    low = F.col(column).bitwiseAND((1 << log2) - 1)
    words = (
        keys.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .withColumn("page", F.floor(F.col("w") / PAGE))
    )

    def pages(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            w, m, page = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(page).tolist():
                own = page == p
                made.setdefault(p, np.zeros(PAGE, np.int64))[w[own] % PAGE] = m[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["page", "bits"])

    out = np.zeros(1 << max(log2 - 6, 13), np.int64)
    parts = min(64, max(1, len(out) // PAGE))
    for page, bits in map_batches(words.repartition(parts, "page"), pages, "page long, bits binary").collect():
        out[page * PAGE : (page + 1) * PAGE] = np.frombuffer(bits, np.int64)
    return out[: 1 << max(log2 - 6, 0)].view(np.uint64)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u = keys.view(np.uint64)
    return (bits[(u >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (u & np.uint64(63))) & np.uint64(1) == 1


def lists(values: np.ndarray, counts: np.ndarray | list[int], kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def rank_in_groups(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str = "rank") -> DataFrame:
    """df with its place (from 0) within the group of its keys, by the 64-bit hash column ``order``, then ``ties``.

    A group may hold any share of the rows: it is cut by ranges of ``order`` into buckets, places are
    counted within buckets, and the sizes of earlier buckets are added. Rows in all respects equal
    get places in any order.
    """
    n = 4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shift = 64 - int(np.ceil(np.log2(n)))
    names = df.columns
    bucket, within, other, before, size, *same_keys = fresh([*names, out], "_bucket", "_within", "_other", "_before", "_size", *[f"_key{i}" for i in range(len(keys))])
    df = df.withColumn(bucket, F.shiftright(F.coalesce(order, F.lit(0)), shift))
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(size))
    earlier = W.Window.partitionBy(*keys).orderBy(bucket).rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(s) for k, s in zip(keys, same_keys, strict=True)], F.col(bucket).alias(other), F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    same = F.col(bucket) == F.col(other)
    for k, s in zip(keys, same_keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(s))
    placed = df.withColumn(within, F.row_number().over(W.Window.partitionBy(*keys, bucket).orderBy(order, *ties)) - 1)
    return placed.join(sizes, same).select(*names, (F.col(within) + F.col(before)).alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the component's smallest node.

    Large-star and small-star turns: rows never outgrow the edges, turns grow with the
    logarithm of a path's length. Each turn's edges are a saved table.
    """
    e = saved(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct())
    nodes = saved(e.selectExpr("explode(array(a, b)) as node").distinct())
    last = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "k")
        linked = large.join(least, large.b == least.k)
        small = linked.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select("m", "k")).where("a <> b").distinct()
        new = saved(small)
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(e)
        e = new
        if state == last:
            return nodes.join(e.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        last = state
