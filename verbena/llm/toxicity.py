"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-case words without the punctuation around them. A term weighs (1 + log count) times its inverse document
frequency, which covers all documents, times ``FLOOR`` plus its tie to the label among the examples (the root of what its
chi-squared exceeds chance by, over the number of examples): every term of every example counts, ties only weigh more.
Terms that no example has weigh ``FLOOR`` at the greatest inverse frequency and enter a text's norm alone.

Examples lie in blocks of ``BLOCK``. A query reads the postings of its terms whole but for those in a large share of the examples
(``LONG_SHARE``): of these it first takes the greatest weight in each block. Blocks whose bound (their best sum so far and those
greatest weights) can't reach the k-th best sum are left, in the others the long lists are read, so the neighbours are exact.
Texts are looked up ``BATCH`` at a time, so that a block's lists are read once for all that need it. Neighbours vote with
weights that rise as the distance falls, and isotonic regression on leave-one-out votes of the examples makes the vote a
calibrated probability; the neighbours and heaviest terms are the evidence.

The examples are a bounded sample, ``MAX_EXAMPLES`` for each label in hash order, weighted back to the labels' true
shares; label rows with crc32(doc_id) mod 5 = 0 are held out and never read. The label, language, source
and id are never inputs of a score.

Defined cases: a null or empty text, or one that shares no term with an example, has no neighbour and gets the share of toxic
examples; null labels are ignored; a doc_id labelled more than once counts as toxic if any row says so;
without any example all scores are 0; a null doc_id is scored and not held out; repeated rows are scored apiece; a very long text
is read whole, in one piece; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm.shared import documents_of, give_back_memory, joined, materialize, shuffle_partitions, text_groups, trimmed, word_codes, word_spans

FOLDS = 5
MAX_EXAMPLES = 4000
#: Weight of a term without a tie to the label, and the chi-squared that is put down to chance.
FLOOR, CHANCE = 0.05, 8.0
NEIGHBOURS, BLOCK, LONG_SHARE = 15, 64, 0.125
#: Texts that are looked up together, and bytes of text whose terms are counted together.
BATCH, GROUP_BYTES = 16, 4 << 20
#: Votes that stand for no neighbour: a text with one faint neighbour leans on this.
PRIOR_WEIGHT = 0.05
#: Terms whose counts travel in one row, and different texts' scores that a worker remembers.
CHUNK_TERMS, KNOWN = 1 << 13, 20_000
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»„“”‘’…–—"


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def normal_words(dictionary: pa.Array) -> pa.Array:
    """The terms that words stand for: lower case, without punctuation at the ends; those of punctuation alone are empty."""
    return pc.utf8_lower(pc.utf8_trim(dictionary.cast(pa.string()), characters=EDGE))


def term_counts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, text, term of it, count) of the different terms of each text, texts rising."""
    body, ends = joined(texts)
    starts, stops, doc = word_spans(body, ends)
    coded = word_codes(body, starts, stops)
    normal = normal_words(coded.dictionary).dictionary_encode()
    term = normal.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    none = pc.index(normal.dictionary, "").as_py()
    some = term != none
    key, count = np.unique(doc[some] << 32 | term[some], return_counts=True)
    return normal.dictionary, key >> 32, key & 0xFFFFFFFF, count


class Vectors:
    """Term counts of texts over a vocabulary, and what else the texts hold."""

    def __init__(self, vocabulary: pa.Array):
        self.vocabulary = vocabulary

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """(term, count, strangers) of each text, terms rising; strangers is the sum of (1 + log count)**2 of its other terms."""
        terms, doc, term, count = term_counts(texts)
        place = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
        strange = place < 0
        others = np.bincount(doc[strange], (1 + np.log(count[strange])) ** 2, len(texts))
        doc, place, count = doc[~strange], place[~strange], count[~strange]
        order = np.lexsort((place, doc))
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        place, count = place[order], count[order]
        return [(place[a:b], count[a:b], x) for a, b, x in zip(cut[:-1].tolist(), cut[1:].tolist(), others.tolist(), strict=True)]


def weigh(vector: tuple[np.ndarray, np.ndarray, float], scale: np.ndarray, strange: float) -> tuple[np.ndarray, np.ndarray]:
    """The known part of a text's vector of length one."""
    term, count, others = vector
    w = (1 + np.log(count)) * scale[term]
    return term, w / max(1e-12, np.sqrt(w @ w + others * strange**2))


Vector = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Weighted examples in blocks; long lists lie dense, with their greatest weight in each block."""

    def __init__(self, vectors: list[Vector], n_terms: int, long_share: float = LONG_SHARE):
        n = len(vectors)
        self.n, self.blocks = n, -(-n // BLOCK)
        self.width = self.blocks * BLOCK
        example = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]).astype(np.int32) if n else np.empty(0, np.int32)
        weight = np.concatenate([w for _, w in vectors]) if n else np.empty(0)
        size = np.bincount(term, minlength=n_terms)
        long = np.flatnonzero(size > max(1, long_share * n))
        self.row = np.full(n_terms, -1, np.int32)  # a long list's row in ``dense``
        self.row[long] = np.arange(len(long))
        own = self.row[term] >= 0
        self.dense = np.zeros((len(long), self.width))
        self.dense[self.row[term[own]], example[own]] = weight[own]
        self.most = self.dense.reshape(len(long), self.blocks, BLOCK).max(2) if n else np.zeros((len(long), 0))
        term, example, weight = term[~own], example[~own], weight[~own]
        order = np.argsort(term, kind="stable")  # examples rise
        self.example, self.weight = example[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))

    def nearest(self, queries: list[Vector], k: int, skip: np.ndarray | None = None) -> list[Vector]:
        """For each query the k examples of greatest cosine above 0 (ties: the earlier example), without example ``skip``."""
        out: list[Vector] = []
        for i in range(0, len(queries), BATCH):
            out += self.nearest_of_batch(queries[i : i + BATCH], k, None if skip is None else skip[i : i + BATCH])
        return out

    def nearest_of_batch(self, queries: list[Vector], k: int, skip: np.ndarray | None) -> list[Vector]:
        m, width = len(queries), self.width
        if not self.n:
            return [(np.empty(0, np.int64), np.empty(0))] * m
        query = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        size = self.start[term + 1] - self.start[term]  # none for the long lists
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        total = np.bincount(np.repeat(query * width, size) + self.example[at], np.repeat(weight, size) * self.weight[at], m * width).astype(float, copy=False).reshape(m, width)

        def kth() -> np.ndarray:
            if skip is not None:
                total[np.arange(m), skip] = 0
            return np.partition(total, width - k, axis=1)[:, width - k] if width > k else np.zeros(m)

        own = self.row[term] >= 0
        if own.any():
            long = np.zeros((m, len(self.dense)))
            long[query[own], self.row[term[own]]] = weight[own]
            bound = total.reshape(m, self.blocks, BLOCK).max(2) + long @ self.most
            live = bound + 1e-12 >= kth()[:, None]
            for b in np.flatnonzero(live.any(0)).tolist():
                who, place = np.flatnonzero(live[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                total[who, place] += long[who] @ self.dense[:, place]
        least = kth()
        out = []
        for row, edge in zip(total, least.tolist(), strict=True):
            hit = np.flatnonzero(row + 1e-12 >= edge) if edge > 2e-12 else np.flatnonzero(row > 0)
            best = hit[np.lexsort((hit, -row[hit].round(12)))[:k]]
            out.append((best, row[best]))
        return out


def vote(labels: np.ndarray, got: np.ndarray, cosines: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """Share of toxic votes; a neighbour's vote is its class weight times cosine squared over distance."""
    w = weights[got] * cosines**2 / (1.05 - np.minimum(cosines, 1))
    return float((w @ labels[got] + PRIOR_WEIGHT * prior) / (w.sum() + PRIOR_WEIGHT))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step fit (pool adjacent violators) of y on x, for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of w*y, sum of w, least x, greatest x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[0] / p[1],) * 2])
    return xs, ys


class Model:
    """What the workers need: vocabulary, weights, index, labels and calibration; its size is bounded by the examples' texts."""

    def __init__(self, terms: pa.Array, frequency: np.ndarray, n: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]], class_weight: tuple[float, float]):
        self.terms = terms
        labels = np.array([e[1] for e in examples], float)
        self.strange = FLOOR * float(np.log(n + 1))
        self.scale = np.log((n + 1) / (np.minimum(frequency, n) + 1)) * (FLOOR + ties(len(terms), [e[2] for e in examples], labels))
        vectors = [weigh((t, c, 0.0), self.scale, self.strange) for _, _, t, c in examples]
        # neighbours in the index share their heaviest terms, so that blocks differ and bounds cut
        order = sorted(range(len(examples)), key=lambda i: (examples[i][1], [int(vectors[i][0][j]) for j in np.argsort(-vectors[i][1], kind="stable")[:2]], examples[i][0]))
        self.vectors = [vectors[i] for i in order]
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = labels[order] if order else labels
        self.weights = np.where(self.labels > 0, class_weight[1], class_weight[0])
        self.index = BlockMaxIndex(self.vectors, len(terms))
        give_back_memory()
        w = self.weights
        self.prior = float((w @ self.labels) / w.sum()) if len(w) else 0.0
        got = self.index.nearest(self.vectors, NEIGHBOURS, np.arange(len(examples)))
        votes = np.array([vote(self.labels, a, c, self.weights, self.prior) if len(a) else np.nan for a, c in got])
        self.vectors = []
        seen = ~np.isnan(votes)
        self.curve = isotonic(votes[seen], self.labels[seen], w[seen]) if seen.any() else (np.zeros(1), np.zeros(1))

    def scores(self, counts: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[float, list[int], list[str]]]:
        """(calibrated score, ids of the nearest examples, the text's heaviest terms) of each text."""
        vectors = [weigh(x, self.scale, self.strange) for x in counts]
        out = []
        for (term, weight), (got, cosines) in zip(vectors, self.index.nearest(vectors, NEIGHBOURS), strict=True):
            if not len(got):
                out.append((self.prior, [], []))
                continue
            x = vote(self.labels, got, cosines, self.weights, self.prior)
            top = term[np.argsort(-weight, kind="stable")[:5]]
            out.append((float(np.clip(np.interp(x, *self.curve), 0, 1)), self.ids[got[:5]].tolist(), [self.terms[i].as_py() for i in top.tolist()]))
        return out


def ties(n_terms: int, terms: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How much each term goes with one label, from 0 to 1: the root of its chi-squared beyond chance over the number of examples."""
    n, n1 = len(labels), float(labels.sum())
    n0 = n - n1
    if not n1 or not n0:
        return np.zeros(n_terms)
    flat, owner = np.concatenate(terms), np.repeat(np.arange(n), [len(t) for t in terms])
    both, toxic = np.bincount(flat, minlength=n_terms), np.bincount(flat, labels[owner], n_terms)
    chi2 = n * (toxic * n0 - (both - toxic) * n1) ** 2 / (n1 * n0 * np.maximum(both, 0.5) * np.maximum(n - both, 0.5))
    return np.sqrt(np.minimum(1.0, np.maximum(chi2 - CHANCE, 0) / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, toxic, text) of at most ``bound`` training examples for each label, and what each stands for."""
    train = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    total = {r["toxic"]: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    chosen = None
    for side in (0, 1):
        own = train.filter((F.col("toxic") > 0) == F.lit(bool(side))).select("doc_id", F.lit(side).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = own if chosen is None else chosen.unionByName(own)
    sample = materialize(documents_of(docs).join(F.broadcast(chosen), "doc_id"), "labelled")  # at most 2 * bound ids are broadcast
    return sample, tuple(max(1.0, total.get(side, 0) / bound) for side in (0, 1))


def packed(table: pa.Table) -> bytes:
    """A table as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def examples_of(sample: DataFrame) -> tuple[pa.Array, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """(terms, examples): all terms of the examples' whole texts, sorted, and (doc_id, toxic, terms' places, counts) of each example."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in text_groups(part.column(2), GROUP_BYTES):
                terms, doc, term, count = term_counts(texts)
                ids, toxic = (part.column(c).slice(at, len(texts)) for c in (0, 1))
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                own = pa.table({"doc_id": ids, "toxic": toxic, "n": np.diff(cut)})
                flat = pa.table({"term": terms.take(pa.array(term)), "count": count.astype(np.int32)})
                yield pa.RecordBatch.from_arrays([pa.array([packed(own)], pa.binary()), pa.array([packed(flat)], pa.binary())], ["own", "flat"])

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(trimmed(run), "own binary, flat binary").collect()  # at most 2 * MAX_EXAMPLES texts' terms
    both = [[pa.ipc.open_stream(r[c]).read_all() for r in rows] for c in ("own", "flat")]
    if not rows:
        return pa.array([], pa.string()), []
    own, flat = (pa.concat_tables(x) for x in both)
    terms = flat.column("term").unique()
    terms = terms.take(pc.sort_indices(terms))
    place = pc.index_in(flat.column("term"), value_set=terms).to_numpy().astype(np.int32)
    count, ends = flat.column("count").to_numpy(), np.cumsum(own.column("n").to_numpy())
    del rows, both, flat
    examples = []
    for doc, toxic, n, end in zip(own.column("doc_id").to_pylist(), own.column("toxic").to_pylist(), own.column("n").to_pylist(), ends.tolist(), strict=True):
        at = place[end - n : end]
        order = np.argsort(at)
        examples.append((doc, toxic, at[order], count[end - n : end][order]))
    del place, count
    give_back_memory()
    return terms, sorted(examples, key=lambda e: (e[0], e[1], len(e[2])))


def packed_vectors(vectors: list[tuple[np.ndarray, np.ndarray, float]]) -> pa.Array:
    """Each text's terms, as steps, and counts in a compressed string."""
    squeeze = zstandard.ZstdCompressor(level=1)
    return pa.array([squeeze.compress(np.concatenate((np.diff(t, prepend=0), c)).astype("<i4").tobytes()) for t, c, _ in vectors], pa.binary())


def unpacked(data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The terms and counts of each text."""
    expand = zstandard.ZstdDecompressor()
    both = [np.frombuffer(expand.decompress(x), "<i4").astype(np.int64).reshape(2, -1) for x in data]
    return [(np.cumsum(steps), count) for steps, count in both]


def document_vectors(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, vector, others) of every whole text, written once: frequencies and scores both read it."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the examples' texts

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(shared.value)
        for part in parts:
            for at, texts in text_groups(part.column(1), GROUP_BYTES):
                v = vectors.of(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(v)), packed_vectors(v), pa.array([x for _, _, x in v], pa.float64())], ["doc_id", "vector", "others"])

    return materialize(documents_of(docs).mapInArrow(trimmed(run), "doc_id long, vector binary, others double"), "term-vectors")


def document_frequencies(vectors: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for part in parts:
            for term, _ in unpacked(part.column(0).to_pylist()):
                seen[term] += 1
            seen[-1] += part.num_rows
        if seen[-1]:
            chunks = range(0, n_terms + 1, CHUNK_TERMS)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([seen[i : i + CHUNK_TERMS].tobytes() for i in chunks], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = vectors.select("vector").mapInArrow(trimmed(count), "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary")
    out = np.zeros(n_terms + 1, np.int64)
    for r in rows.collect():  # a number for each term
        out[r["chunk"] : r["chunk"] + CHUNK_TERMS] = np.frombuffer(r["counts"], np.int64)
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the term vectors of all documents."""
    sample, class_weight = labelled_sample(docs, labels, max_examples)
    terms, examples = examples_of(sample)
    everything = document_vectors(docs, terms)
    frequency, n = document_frequencies(everything, len(terms))
    model = Model(terms, frequency, n, examples, class_weight)
    del examples
    give_back_memory()
    return model, everything


def scored(everything: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, neighbours, terms) from the term vectors of every whole text; equal vectors are scored once in a worker."""
    spark = everything.sparkSession
    shared = spark.sparkContext.broadcast(model)
    give_back_memory()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for part in parts:
            keys = list(zip(*(part.column(c).to_pylist() for c in (1, 2)), strict=True))
            new = list(dict.fromkeys(k for k in keys if k not in known))
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(dict.fromkeys(keys))
            vectors = [(*v, x) for v, (_, x) in zip(unpacked([k for k, _ in new]), new, strict=True)]
            known |= zip(new, m.scores(vectors), strict=True)
            out = [known[k] for k in keys]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_id", "score", "neighbours", "terms"])

    # the vector files are small: deal them anew, or a few tasks would do all lookups
    dealt = everything.repartition(max(shuffle_partitions(spark), everything.rdd.getNumPartitions()))
    return dealt.mapInArrow(trimmed(run), "doc_id long, score double, neighbours array<long>, terms array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Scores and verdicts of all documents, with evidence."""
    model, everything = fit(docs, labels, max_examples)
    found = scored(everything, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "terms")


def without_toxic(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples)[0])
    place = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vectors = Vectors(m.terms)
        for part in parts:
            good: list[bool] = []
            for _, texts in text_groups(pc.fill_null(part.column(place), ""), GROUP_BYTES):
                good += [x[0] < 0.5 for x in m.scores(vectors.of(texts))]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
