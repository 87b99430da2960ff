"""What several operators share: scratch tables, text batches, word hashing and the bucket exchange.

Scratch data goes to the folder in ``spark.checkpoint.dir``; only where that is unset in a local session (tests) is a
temporary folder made. Nothing here uses the executors' own disks. ``sweep`` deletes what is no longer needed.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Raw text bytes in one packed batch: bounds the memory of a Python worker.
BATCH_BYTES = 2 << 20
#: Text bytes whose keys meet in one bucket, and so one task, of an exchange; and table bytes that are dealt to one task.
EXCHANGE_BYTES, DEAL_BYTES = 16 << 20, 64 << 20
#: Scratch folders and tables that this session has made.
MADE: list[tuple[str, str]] = []
#: Sides of a join are broadcast up to this many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="verbena-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(("path", path))
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, made: list[tuple[str, str]]) -> None:
    """Delete the scratch folders and tables in ``made``, which is left empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for kind, name in made:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    gone = set(made)
    MADE[:] = [x for x in MADE if x not in gone]
    made.clear()


def trimmed(run):
    """A worker's function that hands freed memory back when its part is done: workers stay alive beside the JVM in one budget."""

    def run_and_trim(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        give_back_memory()

    return run_and_trim


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, fit; a count reads a written table's footers only."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def give_back_memory() -> None:
    """Hand freed memory back to the system: the driver's Python and JVM share one budget."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents_of(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty: extra columns never reach an operator's shuffle."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each string of an Arrow column as UTF-8 bytes, without decoding."""
    for x in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield x.as_py()


# --- packed batches -----------------------------------------------------------------------------

BATCH_SCHEMA = "batch long, size long, ids binary, lens binary, body binary, carry binary"


def pack_rows(parts: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, further columns) rows in order to rows of about ``batch_bytes``.

    ``batch`` rises with the rows' order over all partitions, since the partitions are ranges of it. A doc_id that many rows
    share goes on over several batches and partitions.
    """
    from pyspark import TaskContext

    pid, seq = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    carried: list[pa.RecordBatch] = []
    size = 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def out() -> pa.RecordBatch:
        nonlocal ids, texts, carried, size, seq
        row = pa.RecordBatch.from_pydict({
            "batch": pa.array([(pid << 32) | seq], pa.int64()),
            "size": pa.array([size], pa.int64()),
            "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
            "lens": pa.array([np.array([len(x) for x in texts], np.int64).tobytes()], pa.binary()),
            "body": pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
            "carry": pa.array([packed(pa.Table.from_batches(carried)) if carried and carried[0].num_columns else None], pa.binary()),
        })
        ids, texts, carried, size, seq = [], [], [], 0, seq + 1
        return row

    for part in parts:
        more, begin = part.select(range(2, part.num_columns)), 0
        for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True)):
            if size >= batch_bytes:
                carried.append(more.slice(begin, i - begin))
                begin = i
                yield out()
            ids.append(NULL_ID if doc is None else doc)
            texts.append(text)
            size += len(text)
        carried.append(more.slice(begin))
    if ids:
        yield out()


#: Stands for a null doc_id in packed batches.
NULL_ID = -(1 << 63)


def packed(table: pa.Table) -> bytes:
    """A table as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpack(ids: bytes, lens: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64), zstandard.ZstdDecompressor().decompress(body)


def batch_table(docs: DataFrame, name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """All documents as packed batches in order of doc_id, then a hash of the text: a table bucketed by ``batch``; ``carry``
    names columns to take along.

    The one shuffle of texts: later joins on ``batch`` read the buckets in place and shuffle only their small side.
    """
    spark = docs.sparkSession
    n = deal_tasks(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.coalesce(F.col("text"), F.lit("")).alias("__text"), *[F.col(f"`{c}`") for c in carry])
    order = [F.col("__doc"), F.xxhash64("__text")]
    ordered = own.repartitionByRange(n, *order).sortWithinPartitions(*order, "__text")
    table = f"verbena_{name}_{uuid.uuid4().hex}"
    (ordered.mapInArrow(trimmed(partial(pack_rows, batch_bytes=BATCH_BYTES)), BATCH_SCHEMA).write.format("parquet").option("compression", "none").option("path", f"{scratch_dir(spark)}/{table}")
     .bucketBy(n, "batch").saveAsTable(table))
    MADE.extend([("table", table), ("path", f"{scratch_dir(spark)}/{table}")])
    return spark.table(table)


def deal_tasks(docs: DataFrame) -> int:
    """How many tasks the texts are dealt to: the session's shuffle partitions, more where the planner knows the table to be large."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 55 else 0  # the planner's word for an unknown size is far above
    return max(shuffle_partitions(docs.sparkSession), -(-known // DEAL_BYTES))


def exchange_tasks(batches: DataFrame) -> int:
    """How many buckets, one to a task, an exchange of the batches' keys takes: their number grows with the texts, not the share of each."""
    size = batches.agg(F.sum("size").alias("n")).first()["n"] or 0
    return max(1, -(-size // EXCHANGE_BYTES))


def answers_by_batch(batches: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Each packed batch with its answers ``struct(bucket, answer)`` as an array (null if it has none)."""
    grouped = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return batches.join(grouped.hint("shuffle_hash"), "batch", "left")


# --- hashing ------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = -(-n // (1 << 16)) << 16
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(m, b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


#: Two independent families: bytes in a word, words in a window.
FAMILIES = [(Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03)), (Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB))]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hashes of ``values[s:e]`` for all spans at once (mod 2**64), mixed with the length."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


#: Bytes that are hashed in one go: bounds the tables of powers that a worker keeps.
HASH_BYTES = 1 << 19


def rising_spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """``spans_hash`` of spans whose starts and ends rise, in slices; a longer span gets a slice of its own."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + HASH_BYTES, side="right")))
        out[i:j] = spans_hash(values[low : int(ends[j - 1])], starts[i:j] - low, ends[i:j] - low, powers)
        i = j
    return out


def word_spans(body: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of every word ``[^\\x20\\x09-\\x0D]+``; words never cross documents."""
    space = (body == 32) | ((body >= 9) & (body <= 13))
    before = np.ones(len(body), bool)
    before[1:] = space[:-1]
    edges = doc_ends[(doc_ends > 0) & (doc_ends < len(body))]
    before[edges] = True
    starts = np.flatnonzero(before & ~space)
    after = np.ones(len(body), bool)
    after[:-1] = space[1:]
    after[edges - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(doc_ends, starts, side="right")


# --- sorted 64-bit keys as bytes -----------------------------------------------------------------

def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as deltas in byte planes (leading planes are zeros, which the shuffle's codec removes)."""
    delta = np.diff(keys, prepend=U64(0))
    return np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()


def expand_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel())


def bucket_bounds(n: int) -> np.ndarray:
    """Lower bounds of ``n`` equal ranges of the 64-bit keys."""
    return np.array([(i << 64) // n for i in range(n)], U64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


# --- groups of whole texts in a worker -----------------------------------------------------------

def text_groups(column: pa.Array, group_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts): runs of whole texts of about ``group_bytes``; a longer text stands alone."""
    at, size, group = 0, 0, []
    for i, x in enumerate(text_bytes(column)):
        if group and size + len(x) > group_bytes:
            yield at, group
            at, size, group = i, 0, []
        group.append(x)
        size += len(x)
    if group:
        yield at, group


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and where each ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def word_codes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """Exact codes of the words at ``starts``..``ends`` of ``body``."""
    inside = np.zeros(len(body) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = body[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def sums_by(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the consecutive spans that end at ``ends``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[ends]
    return np.diff(total, prepend=0)


# --- questions to buckets, answers to batches -----------------------------------------------------

def bucket_slices(keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, place of its keys) for each bucket that has any of the sorted keys: the work follows the keys, not the buckets."""
    owner = np.searchsorted(bounds, keys, side="right") - 1
    cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(owner[a]), slice(a, b)


def bucket_place(keys: np.ndarray, bounds: np.ndarray, bucket: int) -> slice:
    """Where a bucket's keys lie among the sorted keys."""
    low = int(np.searchsorted(keys, bounds[bucket]))
    return slice(low, int(np.searchsorted(keys, bounds[bucket + 1])) if bucket + 1 < len(bounds) else len(keys))


def ask(batches: DataFrame, fn, answer_columns: int = 0) -> DataFrame:
    """(bucket, batch, payload): what ``fn(ids, lens, body, *answers)`` has to ask for each packed batch.

    ``answers`` are dicts from bucket to bytes, one for each of the columns ``answers``, ``answers2``, ...
    """
    names = [f"answers{i or ''}" for i in range(answer_columns)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                rows = list(fn(*unpack(row["ids"], row["lens"], row["body"]), *({a["bucket"]: a["answer"] for a in row[n] or ()} for n in names)))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([row["batch"]] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "batch", "payload"])

    return batches.mapInArrow(trimmed(run), "bucket int, batch long, payload binary")


def answer(asked: DataFrame, tasks: int, fn) -> DataFrame:
    """(batch, bucket, answer): ``fn(payloads, batches)`` gives an answer for each payload of a bucket, in batch order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        out = fn(table.column("payload").to_pylist(), table.column("batch").to_numpy())
        give_back_memory()
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())})

    return asked.repartitionById(tasks, F.col("bucket")).groupBy("bucket").applyInArrow(run, "batch long, bucket int, answer binary")
