"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two
bits, one segment differs in at most one bit; so they share a signature: a segment with one bit wiped out.
The signatures (64 for each distinct fingerprint) are counted, those of one fingerprint alone go, and the others'
fingerprints are equality-joined on the signature and verified by their differing bits.

A signature of more than ``CROWD`` fingerprints would give pairs that grow with its square. Its members are linked by the
variants of both segments at once: the exact codes within one bit of a fingerprint. Two fingerprints share a code if and only
if they differ in two bits or fewer, so each code links its fingerprints to its smallest one; no link is lost, and links grow
with the rows.

Defined cases: null or empty texts have fingerprint zero and link like any other; a text of one or two words
is hashed whole; repeated rows each get a row; a null ``doc_id`` takes part but never names a component unless
all of it is null; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.components import connected_components
from verbena.llm.shared import broadcast_if_small, documents_of, materialize, text_bytes, trimmed

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints of one signature that are compared in pairs; larger groups are split by their exact codes.
CROWD = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the XXH64 hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(h, np.uint64))


def majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer; ``hash`` of the text if asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp = np.array([fingerprint(x, shingle, seed) for x in text_bytes(part.column(1))], np.uint64)
            more = [part.column(2)] if with_hash else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *more], ["doc_id", "fp", "hash"][: 2 + with_hash])

    own = documents_of(docs)
    if with_hash:
        own = own.withColumn("hash", text_hash(F.col("text")))
    return own.mapInArrow(trimmed(run), "doc_id long, fp long" + ", hash long" * with_hash)


def signatures(fp: str) -> F.Column:
    """The 64 signatures of a fingerprint: (segment, wiped bit) above the segment's other bits."""
    out = []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned(F.col(fp), s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        out += [segment.bitwiseAND(F.lit(~(1 << b) & 0xFFFFFFFF)).bitwiseOR(F.lit((s * SEGMENT_BITS + b) << SEGMENT_BITS)) for b in range(SEGMENT_BITS)]
    return F.array(*out)


def codes(fp: str) -> F.Column:
    """A fingerprint and the 64 values that differ from it in one bit."""
    signed = [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]
    return F.array(F.col(fp), *[F.col(fp).bitwiseXOR(F.lit(b)) for b in signed])


def signature_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the fingerprints that share a signature and differ in ``MAX_BITS`` bits at most, by an equality join."""
    other = members.select("sig", F.col("fp").alias("b"))
    both = members.select("sig", F.col("fp").alias("a")).hint("merge").join(other, "sig")
    return both.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")


def hot_stars(members: DataFrame) -> DataFrame:
    """(a, b) for fingerprints of crowded signatures: the other segment's variants are wiped too, which leaves the exact codes
    within one bit. All fingerprints of a code are within ``MAX_BITS`` of each other, so each is linked to the code's least one."""
    coded = members.select("fp").distinct().select("fp", F.explode(codes("fp")).alias("code"))
    least = materialize(coded.groupBy("code").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("code", "a"), "code-stars")
    # merge joins, here and above: their hot keys are split, and exploded rows are not taken for as small as their source
    return coded.hint("merge").join(least, "code").filter("fp != a").select("a", F.col("fp").alias("b"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different fingerprints within two bits, enough to connect all that are connected."""
    dealt = distinct.select("fp", F.explode(signatures("fp")).alias("sig"))
    shared = materialize(dealt.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"), "shared-signatures")
    members = materialize(dealt.hint("merge").join(shared, "sig").select("sig", "fp", "n"), "signature-groups")
    return signature_pairs(members.filter(F.col("n") <= crowd)).unionByName(hot_stars(members.filter(F.col("n") > crowd))).distinct()


def placed_fingerprints(prints: DataFrame, least: F.Column) -> DataFrame:
    """(fp, root, least): every distinct fingerprint with its component's root and the least of its rows."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(least).alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp")))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that is reachable over links of at most two bits."""
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    placed = placed_fingerprints(prints, F.col("doc_id"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id (then the least text hash).

    A null doc_id stands only for components that have no other. Rows that repeat the chosen one wholly are dropped too.
    """
    prints = materialize(fingerprints(docs, shingle, seed, with_hash=True), "fingerprints")
    placed = placed_fingerprints(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    best = placed.groupBy("root").agg(F.min("least").alias("least"))
    return rows_of_least(docs, prints, best)


def rows_of_least(docs: DataFrame, prints: DataFrame, best: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``least`` (doc_id and text hash) of ``best``; ``prints`` has both of every row.

    The rows to leave out are joined against the documents: these are not shuffled as long as those are few enough to broadcast.
    """
    chosen = best.select(F.col("least.doc_id").alias("__d"), F.col("least.hash").alias("__h")).withColumn("__chosen", F.lit(True))
    times = prints.groupBy(F.col("doc_id").alias("__d"), F.col("hash").alias("__h")).agg(F.count("*").alias("__times"))
    same = times["__d"].eqNullSafe(chosen["__d"]) & (times["__h"] == chosen["__h"])
    keys = times.join(chosen, same, "left").select(times["__d"], times["__h"], "__times", F.col("__chosen").isNotNull().alias("__stays"))
    marked = materialize(keys.filter(~F.col("__stays") | (F.col("__times") > 1)), "marked-rows")
    own = docs.withColumn("__hash", text_hash(F.col("text")))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h"))
    kept = own.join(broadcast_if_small(marked, 32), match, "left_anti").select(*docs.columns)
    repeated = marked.filter("__stays")
    if repeated.isEmpty():
        return kept
    once = own.join(broadcast_if_small(materialize(repeated, "repeated-rows"), 32), match).dropDuplicates(["__d", "__h"]).select(*docs.columns)
    return kept.unionByName(once)


def text_hash(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
