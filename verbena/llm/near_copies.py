"""Near copies by the Jaccard similarity of their word shingles: MinHash bands find candidates, whole sets decide.

A text's shingles are its runs of ``SHINGLE`` lower-case words (a shorter text is one shingle). Two texts are linked if
their sets' Jaccard similarity is ``LEAST`` or more. Texts that agree in all ``ROWS`` minima of one of ``BANDS`` bands are
candidates: a pair of similarity 0.8 has none in common with odds of (1 - 0.8**5)**32, three in a million, and
fewer above. Every candidate is decided by the texts' whole sets, so no link is wrong.

First each text is held against the least one of its band value: in a large group of copies this links all. What is left are
texts of band values with several components, often many that are alike but below 0.8. Of these, pairs are made by an
exact filter, which loses none of 0.8 or more. A text's shingles are ordered from rare to frequent. Two texts x and y, x not the
larger, can only be linked if a shingle is among the first ninth of x and the first fifth of y, what follows it is long enough
in both, and their bit sketches (a bit flips for each shingle) differ in at most a ninth of both sizes. All this is
the condition of one equality join on the shingle, so only pairs close to 0.8 leave it.

Defined cases: texts without words link to each other; equal texts are one node; a null ``doc_id`` stands only for components
that have no other; an empty table gives an empty table; further columns are kept as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.components import connected_components
from verbena.llm.shared import FAMILIES, MADE, U64, documents_of, materialize, mix, scratch_dir, shuffle_partitions, spans_hash, text_bytes, trimmed, word_spans
from verbena.llm.simhash import rows_of_least, text_hash

SHINGLE = 5
#: The least similarity as a fraction, so that the filters count in whole numbers.
UP, DOWN = 4, 5
LEAST = UP / DOWN
BANDS, ROWS = 32, 5
#: Shingles whose minima are taken in one go.
SLICE = 1 << 12
#: Words of 64 bits in a text's bit sketch.
SKETCH = 8
#: Texts whose sets a worker keeps.
KNOWN = 200
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's word shingles, rising."""
    body = np.frombuffer(text.lower(), np.uint8)
    starts, ends, _ = word_spans(body, np.array([len(body)]))
    if not len(starts):
        return np.empty(0, U64)
    words = spans_hash(body, starts, ends, FAMILIES[0][0])
    n = max(1, len(words) - shingle + 1)
    at = np.arange(n)
    return np.unique(spans_hash(words, at, np.minimum(at + shingle, len(words)), FAMILIES[0][1]))


def bands(own: np.ndarray) -> np.ndarray:
    """A value for each band, from the minima of a set under ``BANDS * ROWS`` orders."""
    least = np.full(BANDS * ROWS, ~U64(0), U64)
    for i in range(0, len(own), SLICE):
        x = own[i : i + SLICE, None] * FACTORS
        np.minimum(least, (x ^ (x >> U64(29))).min(axis=0), out=least)
    at = np.arange(BANDS) * ROWS
    return spans_hash(least, at, at + ROWS, FAMILIES[1][1]) ^ mix(at.astype(U64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(texts: DataFrame) -> DataFrame:
    """(node, size, values) of (node, text): how many shingles a text has, and its band values."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(x) for x in text_bytes(part.column(1))]
            values = [bands(x).view(np.int64) for x in sets]
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * BANDS, pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), lists], ["node", "size", "values"])

    return texts.mapInArrow(trimmed(run), "node long, size long, values array<long>")


def bit_sketch(own: np.ndarray) -> np.ndarray:
    """``SKETCH`` words in which each shingle flips one bit: two sketches differ in no more bits than the sets in shingles."""
    flips = np.bincount((own % U64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, bits, shingles) of (node, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, text in enumerate(text_bytes(part.column(1))):
                own = shingles(text)
                bits, words = (pa.array([x], pa.list_(pa.int64())) for x in (bit_sketch(own), own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), bits, words], ["node", "bits", "shingles"])

    return texts.mapInArrow(trimmed(run), "node long, bits array<long>, shingles array<long>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, shingle, at): the shingles in the first fifth of each text, in order from rare to frequent, that another text has too.

    Shingles of one text alone come first and are only counted: they never meet another.
    """
    single = sets.select("node", "size", F.explode("shingles").alias("shingle"))
    often = materialize(single.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    shared = single.hint("merge").join(often, "shingle")
    text = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(text) + F.row_number().over(text.orderBy("n", "shingle")) - 1
    return shared.select("node", "shingle", place.alias("at"), "size").filter(DOWN * F.col("at") <= (DOWN - UP) * F.col("size")).drop("size")


def close_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, size, root) of different roots; each of the least similarity or more is among them."""
    own = texts.join(nodes.select("node"), "node", "left_semi").select("node", "text")
    sets = materialize(shingle_sets(own).join(nodes, "node"), "open-sets")
    placed = prefixes(sets).join(sets.select("node", "size", "root", "bits"), "node")
    placed = materialize(placed.select("node", "shingle", "at", "size", "root", *[F.col("bits")[i].alias(f"bits{i}") for i in range(SKETCH)]), "open-prefixes")
    x = placed.filter((DOWN + UP) * F.col("at") <= (DOWN - UP) * F.col("size")).select(*[F.col(c).alias(f"x_{c}") for c in placed.columns])
    y = placed.select(*[F.col(c).alias(f"y_{c}") for c in placed.columns])
    sizes = F.col("x_size") + F.col("y_size")
    after = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    differing = sum((F.bit_count(F.col(f"x_bits{i}").bitwiseXOR(F.col(f"y_bits{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("x_bits0").bitwiseXOR(F.col("y_bits0"))))
    close = (
        (F.col("x_root") != F.col("y_root"))
        & ((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node"))))
        & (DOWN * F.col("x_size") >= UP * F.col("y_size"))
        & ((DOWN + UP) * after >= UP * sizes)
        & ((DOWN + UP) * differing <= (DOWN - UP) * sizes)
    )
    # a merge join of plain shuffles: its hot keys are split
    return y.hint("merge").join(x, (F.col("x_shingle") == F.col("y_shingle")) & close).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def decided(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose sets have the least similarity or more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: bytes) -> np.ndarray:
            if node not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[node] = shingles(text)
            return known[node]

        for part in parts:
            sides = [zip(part.column(k).to_pylist(), text_bytes(part.column(k + 2)), strict=True) for k in (0, 1)]
            good = [jaccard(of(*x), of(*y)) >= LEAST for x, y in zip(*sides, strict=True)]
            yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # the texts lie bucketed by node: only pairs, their second texts and the first texts of pairs are shuffled
    firsts = texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    seconds = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = seconds.hint("merge").join(materialize(firsts, "first-texts"), "a")  # a merge join: its hot keys are split
    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), "a long, b long")


def text_table(own: DataFrame) -> DataFrame:
    """(node, text): the different texts, a table bucketed by node."""
    spark = own.sparkSession
    n, table = shuffle_partitions(spark), f"verbena_texts_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{table}"
    one = own.repartition(n, "node").groupBy("node").agg(F.first("text").alias("text"))
    one.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "node").saveAsTable(table)
    MADE.extend([("table", table), ("path", path)])
    return spark.table(table)


def links(texts: DataFrame) -> DataFrame:
    """(a, b): links between different texts (node, text), enough to connect all that are connected."""
    dealt = materialize(sketches(texts).select("node", "size", F.explode("values").alias("value")), "bands")
    least = dealt.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("value", "a")
    company = materialize(dealt.hint("merge").join(least, "value"), "band-company")
    first = materialize(decided(company.filter("node != a").select("a", F.col("node").alias("b")).distinct(), texts), "first-links")
    roots = connected_components(first)
    placed = company.join(roots, "node", "left").select("value", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("value").agg(F.min("root").alias("r"), F.max("root").alias("z")).filter("r < z").select("value")
    open_ = materialize(placed.join(mixed, "value").select("node", "size", "root").distinct(), "open-texts")
    return first.unionByName(decided(materialize(close_pairs(open_, texts), "close-pairs"), texts))


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id (then the least text hash)."""
    own = documents_of(docs).withColumn("node", text_hash(F.col("text")))
    texts = text_table(own)
    roots = connected_components(links(texts))
    ids = own.select("doc_id", F.col("node").alias("hash"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    best = ids.join(roots, ids.hash == roots.node, "left").groupBy(F.coalesce("root", "hash").alias("root")).agg(least)
    return rows_of_least(docs, ids, best)
