"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps.

Documents and gaps are whole numbers from 1 to the capacity, so documents of one length are alike and so are gaps
of one size. A sweep works on the range-sorted lengths (longest first) and gaps: each length's documents take the
smallest gaps that hold them (the successor in the sorted gaps), in rank order; documents left over go on to the next
gap size or open sequences; the gaps shrink; the next length follows. Both sides are run-length coded: the histogram
of lengths has at most ``capacity`` rows, whatever the number of documents, and so has the list of gap sizes.
The ranks of single documents within their length come from distributed range-sorted partitions with
offsets, and each document finds its place in the sweeps' plan by its length and rank.

Defined cases: a null or empty text is the end token alone; repeated rows are packed apiece; ties in length
go by doc_id, then piece; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm.shared import documents_of, materialize, shuffle_partitions, trimmed
from verbena.llm.word_tokens import WordTokenizer

CAPACITY = 4096
END_TOKEN = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """The pieces of every whole text's tokens: only texts of over ``capacity`` tokens are cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for part in parts:
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids_of(part.column(1), end_token), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc, k, at, len(own), zlib.crc32(own)))
            doc_id, piece, start, length, crc = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents_of(docs).mapInArrow(trimmed(run), PIECES)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan for ``counts`` documents of each length: (length, first rank, documents, first sequence, offset).

    ``open_runs`` holds, for each gap size, runs of sequences with that gap; a run is taken whole or cut once, so the plan's
    size follows the number of lengths and of gap sizes, not of documents.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in open_runs:
                open_runs[gap] = []
                insort(gaps, gap)
            open_runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no gap holds this length: open sequences, each for as many as fit
                fit = capacity // length
                whole, rest = divmod(left, fit)
                for n, each in ((whole, fit), (1, rest)):
                    if n and each:
                        for slot in range(each):
                            plan.append((length, rank, n, opened, slot * length))
                            rank += n
                        put(capacity - each * length, opened, n)
                        opened += n
                break
            gap = gaps[at]
            first, n = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(at)
            take = min(n, left)
            if take < n:
                put(gap, first + take, n - take)
            plan.append((length, rank, take, first, capacity - gap))
            put(gap - length, first, take)
            left, rank = left - take, rank + take
    return plan


def place(ranked: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Each ranked piece at the place that the plan has for its length and rank."""
    steps = np.array(sorted(plan), np.int64).reshape(-1, 5)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (steps[:, 0] << 48) + steps[:, 1]
        for part in parts:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            kept = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(run), PIECES + ", sequence_id long, offset long")


def with_rank(found: DataFrame) -> DataFrame:
    """``rank``: the place of a piece among those of its length, without one task for any length.

    Pieces are range-sorted by (length, doc_id, piece); a partition's rows of one length are numbered in order, and
    earlier partitions' counts of that length (one small row for each partition and length) are added.
    """
    order = ["length", "doc_id", "piece", "ids_crc32"]
    n = shuffle_partitions(found.sparkSession)
    dealt = found.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), {}
        for part in parts:
            length = part.column(part.schema.get_field_index("length")).to_numpy()
            starts = np.flatnonzero(np.append(True, length[1:] != length[:-1])) if len(length) else np.empty(0, int)
            sizes = np.diff(np.append(starts, len(length)))
            base = np.array([seen.get(x, 0) for x in length[starts].tolist()], np.int64)
            for x, c in zip(length[starts].tolist(), sizes.tolist(), strict=True):
                seen[x] = seen.get(x, 0) + c
            local = np.arange(len(length)) - np.repeat(starts, sizes) + np.repeat(base, sizes)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(length), pid)), pa.array(local)], [*part.schema.names, "part", "local"])

    numbered = materialize(dealt.mapInArrow(trimmed(number), PIECES + ", part long, local long"), "numbered-pieces")
    from pyspark.sql import Window

    own = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    return numbered.join(before, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """Every piece of every document with its sequence and its offset there, gapless from 0."""
    found = materialize(pieces(docs, tokenizer_path, capacity, end_token), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return place(with_rank(found), sweep(counts, capacity))
