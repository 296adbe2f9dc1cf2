"""What the operators share: shared-folder tables, raw bytes of Arrow text columns, labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that split words in the contracts: space and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
#: Bytes that split words of letters and digits: every other ASCII byte.
IS_MARK = np.ones(256, dtype=bool)
IS_MARK[48:58] = IS_MARK[65:91] = IS_MARK[97:123] = IS_MARK[128:] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset on one machine (tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/quillstream-shared"
    spark.sparkContext.setCheckpointDir(root) if not spark.sparkContext.getCheckpointDir() else None
    return f"{root.rstrip('/')}/qs-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder, read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstream_path = path  # noqa: SLF001
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_quillstream_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)  # noqa: SLF001


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers live on from task to task, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind until no column of the frame has them, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def doc_fold(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that the frame's plan reads, which costs no job; where it has none to speak of (rows from the
    driver, products of joins), the bytes of the texts, counted."""
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    if told < 1 << 50:
        return told
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return int(df.agg(F.sum(sum(texts, F.lit(8).cast("long")))).first()[0] or 0)


def shards_for(df: DataFrame, bytes_a_shard: int = 16 << 20) -> int:
    """Shards in proportion to the input, and no fewer than the shuffle has partitions."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(conf, min(1 << 20, input_bytes(df) // bytes_a_shard)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a text column: its UTF-8 bytes end to end, and n + 1 offsets. Null counts as empty; nothing is copied otherwise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, most: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts documents into runs of at most ``most`` bytes a piece (pieces of one document overlap by ``overlap``),
    and groups pieces until they hold ``most`` bytes. Yields (document, start, end) arrays; empty documents have none."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    step = max(1, most - overlap)
    parts = np.where(sizes > most, -(-np.maximum(sizes - overlap, 1) // step), np.minimum(sizes, 1))
    doc = np.repeat(np.arange(n), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[doc] + nth * step
    end = np.minimum(start + most, offsets[doc + 1])
    if not len(doc):
        return
    group = (np.cumsum(end - start) - 1) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
        yield doc[a:b], start[a:b], end[a:b]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most about ``most`` bytes: the first, and the one behind the last."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1 << 12, dtype=np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.cumprod(np.full(len(_POWERS) - 1, 0x9E3779B97F4A7C15, dtype=np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, splits: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each document (lower-cased A-Z, split at SPACES, or at what ``splits`` marks), in order, and
    each word's document.

    The hash of a word is a polynomial in its bytes plus its length, mixed; equal words, equal hashes anywhere.
    """
    low = LOWER[raw]
    word = ~splits[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[bounds] = word[bounds]  # a document begins anew
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = bounds[1:] - 1
    last[ends] = word[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = stop - start
    with np.errstate(over="ignore"):
        index = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else None
        if index is None:
            index = np.arange(len(raw)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(raw))))])
        np.minimum(index, (1 << 40), out=index)
        term = (low.astype(np.uint64) + np.uint64(1)) * _POWERS[index & (len(_POWERS) - 1)]
        long = index >= len(_POWERS)
        if long.any():
            term[long] = mix64(term[long] + (index[long].astype(np.uint64) >> np.uint64(12)) * np.uint64(0xD1342543DE82EF95))
        term[~word] = 0
        h = mix64(np.add.reduceat(term, start) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return h, doc


def sample_hash(seed: int, *keys: str | Column) -> Column:
    """A hash of 62 bits that deals rows into samples."""
    x = F.xxhash64(F.lit(seed), *keys)
    return F.pmod(x, F.lit(1 << 30)) * F.lit(1 << 32) + F.pmod(F.shiftright(x, 30), F.lit(1 << 32))


def row_hash(seed: int) -> Column:
    """sample_hash of the id, or of the text where there is no id, which would tell no rows apart."""
    return F.when(F.col("doc_id").isNull(), sample_hash(seed, "text")).otherwise(sample_hash(seed, "doc_id"))


def sample_limit(part: float) -> int:
    """The value of sample_hash below which that part of all rows lies."""
    return int(min(1.0, part) * (1 << 62))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, seed: int) -> DataFrame:
    """About ``rows`` labelled documents, chosen by a hash of the id, and at most ``most_bytes`` bytes of text (see ``within``).

    Returns (doc_id, text, label), a row for each id. Rows whose id or label is null are not labelled. The ids to fetch are
    bounded by ``rows``, so they may be broadcast.
    """
    kept = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    kept = kept.withColumn("_h", sample_hash(seed, "doc_id"))
    total = kept.count()
    kept = kept.where(F.col("_h") < sample_limit(rows / max(total, 1)))
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(kept), "doc_id")
    return within(got, most_bytes).select("doc_id", "text", "label")


def within(got: DataFrame, most_bytes: int) -> DataFrame:
    """Rows of a sample (text, and their hash _h) in the order of their hash, as far as their texts hold ``most_bytes`` bytes in all: the bound
    holds whatever single texts there are. To learn from, a text of more than a thirty-second of that is cut to a piece of that size, at a
    place that its hash tells. Of rows of one hash the least is taken, so repeated ids and texts count once. Only hashes and
    sizes of the sample come to the driver."""
    most = max(most_bytes // 32, 4)
    chars = most // 4  # of four bytes at most
    at = F.pmod(F.col("_h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    got = got.withColumn("text", F.when(F.octet_length("text") > most, F.substr("text", at.cast("int"), F.lit(chars))).otherwise(F.col("text")))
    rest = [c for c in got.columns if c != "_h"]
    got = got.groupBy("_h").agg(F.min(F.struct(*rest)).alias("_row")).select("_h", *(F.col(f"_row.{c}").alias(c) for c in rest))
    total, last = 0, -1
    for h, size in sorted(map(tuple, got.select("_h", F.octet_length("text")).collect())):
        total += size
        if total > most_bytes:
            break
        last = h
    return got.where(F.col("_h") <= last)


def sent(spark: SparkSession, value):
    """Broadcasts a value of bounded size, and returns what loads it in a task. Its classes travel with it (a plain broadcast
    names them only), so executors need no copy of this library."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def with_text_scores(df: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """The frame plus a double column ``out``: model.score(bytes, offsets) of the whole texts of each Arrow batch.

    Every other column passes unchanged; one already named ``out`` is replaced.
    """
    df = df.drop(out)
    place = df.columns.index(text)
    load = sent(df.sparkSession, model)

    def run(batches):
        model = load()
        for b in batches:
            raw, off = text_bytes(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(raw, off), pa.float64())], [*b.schema.names, out])
            give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def arrow_rows(df: DataFrame) -> pa.Table:
    """A bounded sample as an Arrow table on the driver, in the order of doc_id."""
    t = df.toArrow()
    return t.sort_by("doc_id") if "doc_id" in t.column_names and t.num_rows else t


class Adam:
    """Adam over a dict of float32 arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate * fix) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
