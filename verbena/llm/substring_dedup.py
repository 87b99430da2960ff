"""Long repeated spans by De Bruijn compaction.

Every window of ``WINDOW`` consecutive words is an edge of a De Bruijn graph from its first words' node to its last words'. Each
batch of texts sends its distinct edges, as 64-bit keys with the words before and after them in short, to buckets. A bucket
tells for each edge whether other batches have it, the first batch that does (its source; the batches lie in document order),
and whether its nodes branch: more than one word stands before or after the edge, a document's end counted as one.

Consecutive repeated edges with one source and no branch between them compact to a path, named by its first edge's key and its
length. Since nothing branches inside, all places of a path run through the whole of it. A batch writes each of its paths once,
with its words and coordinates, as source or as copy; a Spark join brings copies to the source's path and compares the words.
Every copy that meets equal words at its source goes. A path that does not (the short forms hid a branch) is split into its
edges, whose words are looked up in the source batch's text; an edge that fails there too shares its key with an unlike one, and the
first place of its words is found by a pass over all batches for those keys. So nothing rests on a hash.

A passage that a third of all documents share costs a batch its edges and one path.

Defined cases: a null or empty text has no words; texts of fewer words than a window lose nothing; rows with one
doc_id are ordered by a hash of their texts, then the texts; a null doc_id comes before all others; a very long text is one batch; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from verbena.llm.shared import FAMILIES, NULL_ID, U64, answer, answers_by_batch, ask, batch_table, bucket_bounds, bucket_place, bucket_slices, exchange_tasks, expand_sorted, materialize, rising_spans_hash, spans_hash, squeeze_sorted, trimmed, unpack, word_spans

WINDOW = 20
#: What a short form of a neighbouring word says: none, or several; else a number from 1 to 254.
NONE, SEVERAL = 0, 255
#: Keys that all batches are searched for in one go.
SEARCHED_KEYS = 1 << 20


# --- edges ----------------------------------------------------------------------------------------

@dataclass
class Edges:
    """A batch's words, and its edges by their first word; ``before`` and ``after`` are the neighbouring words' hashes, 0 for none."""

    starts: np.ndarray
    stops: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    key: np.ndarray
    before: np.ndarray
    after: np.ndarray


def edges(lens: np.ndarray, body: bytes, key_bits: int = 64) -> Edges:
    data = np.frombuffer(body, np.uint8)
    starts, stops, doc = word_spans(data, np.cumsum(lens))
    n = max(0, len(starts) - WINDOW + 1)
    at = np.flatnonzero(doc[:n] == doc[len(doc) - n :]) if n else np.empty(0, np.int64)
    words = rising_spans_hash(data, starts, stops, FAMILIES[0][0])
    key = spans_hash(words, at, at + WINDOW, FAMILIES[0][1])
    if key_bits < 64:  # tests force collisions
        key = key >> U64(64 - key_bits) << U64(64 - key_bits)
    near = np.concatenate((np.zeros(1, U64), words | U64(1), np.zeros(1, U64)))
    owner = np.concatenate((np.full(1, -1), doc, np.full(1, -1)))
    before = np.where(owner[at] == doc[at], near[at], U64(0)) if len(at) else np.empty(0, U64)
    after = np.where(owner[at + WINDOW + 1] == doc[at], near[at + WINDOW + 1], U64(0)) if len(at) else np.empty(0, U64)
    return Edges(starts, stops, doc, at, key, before, after)


def short_forms(words: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """For each distinct edge the short form of the one word that stands beside it, or ``SEVERAL``."""
    one = words[first]
    short = np.where(one == 0, NONE, 1 + (one >> U64(40)) % U64(254)).astype(np.uint8)
    short[inverse[words != one[inverse]]] = SEVERAL
    return short


def ask_edges(bounds: np.ndarray, key_bits: int):
    def run(ids: np.ndarray, lens: np.ndarray, body: bytes) -> Iterator[tuple[int, bytes]]:
        e = edges(lens, body, key_bits)
        keys, first, inverse = np.unique(e.key, return_index=True, return_inverse=True)
        before, after = short_forms(e.before, first, inverse), short_forms(e.after, first, inverse)
        for b, own in bucket_slices(keys, bounds):
            yield b, squeeze_sorted(keys[own]) + before[own].tobytes() + after[own].tobytes()

    return run


def degrees(payloads: list[bytes], batches: np.ndarray) -> list[bytes]:
    """For each batch and edge four bits (other batches have it, an earlier one does, its first node branches, its last one
    does), then the source batches of those that an earlier batch has."""
    sizes = np.array([len(p) // 10 for p in payloads])
    keys = np.concatenate([expand_sorted(p[: 8 * n]) for p, n in zip(payloads, sizes.tolist(), strict=True)])
    before, after = (np.concatenate([np.frombuffer(p, np.uint8, n, k * n) for p, n in zip(payloads, sizes.tolist(), strict=True)]) for k in (8, 9))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, keys))
    k = keys[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))
    lead = np.repeat(order[start], size)

    def back(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), x.dtype)
        out[order] = x
        return out

    def branches(short: np.ndarray) -> np.ndarray:
        own = short[order]
        return back(np.repeat(np.logical_or.reduceat((own == SEVERAL) | (own != short[lead]), start), size))

    source, other, into, out_of = back(owner[lead]), back(np.repeat(size > 1, size)), branches(before), branches(after)
    result, at = [], 0
    for i, n in enumerate(sizes.tolist()):
        p = slice(at, at + n)
        at += n
        earlier = source[p] < i
        known, code = np.unique(batches[source[p][earlier]], return_inverse=True)
        wide = np.uint16 if len(known) < 1 << 16 else np.uint32
        bits = b"".join(np.packbits(x).tobytes() for x in (other[p], earlier, into[p], out_of[p]))
        result.append(np.array([len(known), wide().itemsize], np.int64).tobytes() + bits + known.astype(np.int64).tobytes() + code.astype(wide).tobytes())
    return result


@dataclass
class Marks:
    """What the buckets say of a batch's distinct edges; ``source`` is -1 where no earlier batch has the edge."""

    other: np.ndarray
    source: np.ndarray
    into: np.ndarray
    out_of: np.ndarray


def marks_of(keys: np.ndarray, bounds: np.ndarray, answers: dict[int, bytes]) -> Marks:
    flags, source = np.zeros((4, len(keys)), bool), np.full(len(keys), -1, np.int64)
    for b, data in answers.items():
        own = bucket_place(keys, bounds, b)
        n = own.stop - own.start
        step = -(-n // 8)
        count, wide = np.frombuffer(data, np.int64, 2).tolist()
        for i in range(4):
            flags[i, own] = np.unpackbits(np.frombuffer(data, np.uint8, step, 16 + i * step), count=n).astype(bool)
        at = 16 + 4 * step
        known = np.frombuffer(data, np.int64, count, at)
        code = np.frombuffer(data, np.uint16 if wide == 2 else np.uint32, int(flags[1, own].sum()), at + 8 * count)
        source[own][flags[1, own]] = known[code]
    return Marks(flags[0], source, flags[2], flags[3])


# --- paths ----------------------------------------------------------------------------------------

def words_between(body: bytes, e: Edges, first: int, n: int) -> bytes:
    """``n`` words, joined by one space."""
    return b" ".join(body[e.starts[first] : e.stops[first + n - 1]].split())


PATHS = "batch long, item int, role int, source long, head long, n int, doc_id long, place long, words binary"
#: Roles of a path in its batch: the source's own, a copy, or no path but the batch's list of copies.
OWN, COPY, LIST = 0, 1, 2


def path_rows(marked: DataFrame, bounds: np.ndarray, key_bits: int) -> DataFrame:
    """The distinct paths of all batches that other batches have too, and a row for each batch that lists the places of all
    copies: first word, edges, and the path that speaks for them (-1: an equal path stands before in the batch itself)."""

    def rows_of(batch: int, ids: np.ndarray, lens: np.ndarray, body: bytes, answers: dict[int, bytes]) -> list[tuple]:
        e = edges(lens, body, key_bits)
        keys, inverse, times = np.unique(e.key, return_inverse=True, return_counts=True)
        m = marks_of(keys, bounds, answers)
        on = (m.other | (times > 1))[inverse]
        source, other = m.source[inverse], m.other[inverse]
        link = on[1:] & on[:-1] & (e.at[1:] == e.at[:-1] + 1) & (source[1:] == source[:-1]) & (other[1:] == other[:-1]) & ~m.out_of[inverse[:-1]] & ~m.into[inverse[1:]]
        head = np.flatnonzero(on & ~np.append(False, link)) if len(on) else np.empty(0, np.int64)
        tail = np.flatnonzero(on & ~np.append(link, False)) if len(on) else np.empty(0, np.int64)
        first_word = np.searchsorted(e.doc, np.arange(len(ids)))
        seen: dict[tuple, int] = {}
        rows: list[tuple] = []
        copies: list[tuple[int, int, int]] = []
        items = 0
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            n, at = b - a + 1, int(e.at[a])
            own, key = int(source[a]), int(e.key[a].view(np.int64))
            text = words_between(body, e, at, n + WINDOW - 1)
            item = seen.get((own, key, text))
            if item is None:
                item = seen[own, key, text] = items
                items += 1
                if other[a]:
                    doc = int(e.doc[at])
                    rows.append((batch, item, COPY if own >= 0 else OWN, own if own >= 0 else batch, key, n, int(ids[doc]), at - int(first_word[doc]), text))
                if own < 0:
                    continue
            copies.append((at, n, item if own >= 0 else -1))
        if copies:
            rows.append((batch, -1, LIST, None, None, None, None, None, np.array(copies, np.int32).tobytes()))
        return rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in PATHS.split(", ")]
        for part in parts:
            for row in part.select(["batch", "ids", "lens", "body", "answers"]).to_pylist():
                rows = rows_of(row["batch"], *unpack(row["ids"], row["lens"], row["body"]), {a["bucket"]: a["answer"] for a in row["answers"] or ()})
                columns = zip(*rows, strict=True) if rows else ([] for _ in names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return marked.mapInArrow(trimmed(run), PATHS)


PATH_KEY = ["source", "head", "n", "words"]


def unverified(paths: DataFrame) -> DataFrame:
    """The copies whose words do not stand as one path at their source. Merge joins: a path that very many batches copy is split."""
    own = paths.filter(F.col("role") == OWN).select(*PATH_KEY)
    return paths.filter(F.col("role") == COPY).hint("merge").join(own, PATH_KEY, "left_anti").select("batch", "item", *PATH_KEY)


def repeated_paths(paths: DataFrame) -> DataFrame:
    """(doc_id, place, n_words, batches): the compacted paths with their source's coordinates, and how many later batches copy them."""
    copies = paths.filter(F.col("role") == COPY).groupBy(*PATH_KEY).agg(F.count("*").alias("batches"))
    own = paths.filter(F.col("role") == OWN).select(*PATH_KEY, F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "place")
    return own.join(copies, PATH_KEY).select("doc_id", "place", (F.col("n") + WINDOW - 1).alias("n_words"), "batches")


# --- edges of paths that were not verified ---------------------------------------------------------

def single_edges(paths: DataFrame, key_bits: int) -> DataFrame:
    """(batch, item, k, source, key, words) for each edge of the paths."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                e = edges(np.array([len(row["words"])]), row["words"], key_bits)
                n = len(e.at)
                words = [words_between(row["words"], e, i, WINDOW) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * n, pa.int64()), pa.array([row["item"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([row["source"]] * n, pa.int64()), pa.array(e.key.view(np.int64)), pa.array(words, pa.binary())], ["batch", "item", "k", "source", "key", "words"])

    return paths.select("batch", "item", "source", "words").mapInArrow(trimmed(run), "batch long, item int, k int, source long, key long, words binary")


def found_at_source(batches: DataFrame, singles: DataFrame, key_bits: int) -> DataFrame:
    """The distinct (source, key, words) whose words stand in the source batch. A batch gets its own edges' questions at most."""
    wanted = singles.select("source", "key", "words").distinct().groupBy(F.col("source").alias("batch")).agg(F.collect_list(F.struct("key", "words")).alias("wanted"))
    asked = batches.select("batch", "ids", "lens", "body").join(wanted.hint("shuffle_hash"), "batch")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                _, lens, body = unpack(row["ids"], row["lens"], row["body"])
                e = edges(lens, body, key_bits)
                want = {(w["key"], w["words"]) for w in row["wanted"]}
                some = np.flatnonzero(np.isin(e.key.view(np.int64), np.array([k for k, _ in want], np.int64)))
                have = {(int(e.key[i].view(np.int64)), words_between(body, e, int(e.at[i]), WINDOW)) for i in some.tolist()} & want
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(have), pa.int64()), pa.array([k for k, _ in have], pa.int64()), pa.array([w for _, w in have], pa.binary())], ["source", "key", "words"])

    return asked.mapInArrow(trimmed(run), "source long, key long, words binary")


def first_places(batches: DataFrame, collided: DataFrame, key_bits: int) -> DataFrame | None:
    """(batch, item, k, at): the edges whose words no earlier batch has, and the first word of their first place in their own.

    All batches are searched for the keys that unlike edges share, ``SEARCHED_KEYS`` at a time; None if there are none.
    """
    spark = batches.sparkSession
    keys = materialize(collided.select("key").distinct(), "shared-keys")
    parts = -(-keys.count() // SEARCHED_KEYS)
    if not parts:
        return None
    found = None
    for i in range(parts):
        own = keys.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i) if parts > 1 else keys
        known = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in own.collect()], np.int64)))  # about SEARCHED_KEYS numbers

        def run(parts: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row in part.to_pylist():
                    _, lens, body = unpack(row["ids"], row["lens"], row["body"])
                    e = edges(lens, body, key_bits)
                    some = np.flatnonzero(np.isin(e.key.view(np.int64), known.value))
                    words = [words_between(body, e, int(e.at[j]), WINDOW) for j in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(e.key[some].view(np.int64)), pa.array(words, pa.binary()), pa.array(np.full(len(some), row["batch"], np.int64)), pa.array(e.at[some].astype(np.int64))], ["key", "words", "b", "at"])

        own_places = batches.select("batch", "ids", "lens", "body").mapInArrow(trimmed(run), "key long, words binary, b long, at long")
        first = materialize(own_places.groupBy("key", "words").agg(F.min(F.struct("b", "at")).alias("first")), "first-places")
        found = first if found is None else found.unionByName(first)
    return collided.join(found, ["key", "words"]).filter("first.b = batch").select("batch", "item", "k", F.col("first.at").alias("at"))


# --- the removed words -----------------------------------------------------------------------------

def lost_words(n_words: int, copies: np.ndarray, spared: dict[tuple[int, int], int]) -> np.ndarray:
    """Which words the copies' windows cover; of a spared edge (path and place in it) the first place stays."""
    edge = np.zeros(n_words + 1, np.int64)
    with_spared = {item for item, _ in spared}
    for at, n, item in copies.tolist():
        if item not in with_spared:
            edge[at] += 1
            edge[at + n + WINDOW - 1] -= 1
            continue
        for k in range(n):
            if spared.get((item, k)) != at + k:
                edge[at + k] += 1
                edge[at + k + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


OUT = [("doc_id", LongType()), ("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())]


def substring_dedup(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), key_bits: int = 64) -> DataFrame:
    """Words removed from each document, and the digest of the words left.

    With ``with_text`` also the text without the removed words: what stood between two kept words stays, runs of
    removed words leave one line break if they held any, else one space; and the columns named by ``carry``, as ``__c0``, ``__c1``, ...
    """
    batches = batch_table(docs, "words", carry)
    tasks = exchange_tasks(batches)
    bounds = bucket_bounds(tasks)
    marked = answers_by_batch(batches, answer(ask(batches, ask_edges(bounds, key_bits)), tasks, degrees))
    paths = materialize(path_rows(marked, bounds, key_bits), "paths")
    lists = paths.filter(F.col("role") == LIST).select("batch", F.col("words").alias("copies"))
    final = batches.join(lists.hint("shuffle_hash"), "batch", "left")
    open_ = materialize(unverified(paths), "unverified-paths")
    spared = None
    if not open_.isEmpty():
        singles = materialize(single_edges(open_, key_bits), "single-edges")
        there = materialize(found_at_source(batches, singles, key_bits), "found-edges")
        collided = materialize(singles.join(there, ["source", "key", "words"], "left_anti"), "collided-edges")
        spared = first_places(batches, collided, key_bits)
    if spared is not None:
        by_batch = spared.groupBy("batch").agg(F.collect_list(F.struct("item", "k", "at")).alias("spared"))
        final = final.join(by_batch.hint("shuffle_hash"), "batch", "left")
    else:
        final = final.withColumn("spared", F.lit(None).cast("array<struct<item: int, k: int, at: long>>"))
    fields = [StructField(k, t) for k, t in OUT]
    if with_text:
        fields += [StructField("text", StringType()), *[StructField(f"__c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verbena.llm.shared import unpacked

        for part in parts:
            for row in part.to_pylist():
                ids, lens, body = unpack(row["ids"], row["lens"], row["body"])
                ends = np.cumsum(lens)
                starts, stops, doc = word_spans(np.frombuffer(body, np.uint8), ends)
                copies = np.frombuffer(row["copies"] or b"", np.int32).reshape(-1, 3)
                lost = lost_words(len(starts), copies, {(x["item"], x["k"]): x["at"] for x in row["spared"] or ()})
                upto = np.searchsorted(doc, np.arange(len(ids) + 1))
                out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "text")}
                for i, name in enumerate(ids.tolist()):
                    at, own = int(ends[i] - lens[i]), lost[upto[i] : upto[i + 1]]
                    text = body[at : int(ends[i])]
                    words = text.split()
                    removed = int(own.sum())
                    kept = [w for w, x in zip(words, own.tolist(), strict=True) if not x] if removed else words
                    left = cut_text(text, starts[upto[i] : upto[i + 1]] - at, stops[upto[i] : upto[i + 1]] - at, own) if with_text and removed else text
                    for c, x in zip(out, (None if name == NULL_ID else name, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), left), strict=True):
                        out[c].append(x)
                cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
                if with_text:
                    cols.append(pa.array(out["text"], pa.binary()).cast(pa.string()))
                    cols += [c.combine_chunks() for c in unpacked(row["carry"]).columns] if carry else []
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return final.select("ids", "lens", "body", "carry", "copies", "spared").mapInArrow(trimmed(run), StructType(fields))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut from ``text`` and ``n_chars`` counted anew; rows left empty by that go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring_dedup(docs, with_text=True, carry=others).filter("n_removed = 0 OR n_removed < n_words")
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")} | {c: F.col(f"__c{i}") for i, c in enumerate(others)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def cut_text(text: bytes, starts: np.ndarray, stops: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that are gone."""
    keep = np.flatnonzero(~gone)
    parts: list[bytes] = []
    before = -1
    for i in keep.tolist():
        if before >= 0:
            space = text[stops[before] : starts[i]]
            parts.append(space if i == before + 1 else b"\n" if b"\n" in space else b" ")
        parts.append(text[starts[i] : stops[i]])
        before = i
    return b"".join(parts)
