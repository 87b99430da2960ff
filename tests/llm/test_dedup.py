"""Operators 4, 7 and 9 against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import collect, corpus, frame, odd_frames
from verbena.llm import shared, simhash, substring_dedup, suffix_dedup


def removed_bytes(docs):
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append(gone)
    return out


def test_suffix_dedup_is_exact(spark):
    texts = corpus(1)
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    want = []
    for (i, t), gone in zip(docs, removed_bytes(docs), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = collect(suffix_dedup.suffix_dedup(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want
    assert sum(w[2] for w in want) > 1000


def test_suffix_dedup_equal_ids_and_batches(spark, monkeypatch):
    monkeypatch.setattr(shared, "BATCH_BYTES", 200)
    texts = corpus(2, 20)
    ids = [i // 2 for i in range(len(texts))]
    docs = sorted(((i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)))
    want = sorted((i, int(g.sum())) for (i, _), g in zip(docs, removed_bytes(docs), strict=True))
    assert collect(suffix_dedup.suffix_dedup(frame(spark, texts, ids)), "doc_id", "n_removed") == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=12), min_size=1, max_size=60), st.integers(0, 1))
def test_deep_shallow_sorts(rows, narrow):
    rows = rows + rows[: len(rows) // 2]
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 12)
    if narrow:
        table = table & 1
    order, rank = suffix_dedup.deep_shallow(table, 8)
    text = [r.tobytes() for r in table]
    assert [text[i] for i in order] == sorted(text)
    assert all((rank[i] == rank[j]) == (text[i] == text[j]) for i, j in itertools.combinations(range(len(text)), 2))


def removed_words(docs):
    seen, out = set(), []
    for _, t in docs:
        words = t.split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            w = tuple(words[p : p + 20])
            if w in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(w)
        out.append((words, gone))
    return out


def want_words(docs):
    return [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, _), (w, g) in zip(docs, removed_words(docs), strict=True)]


def test_substring_dedup_is_exact(spark, monkeypatch):
    monkeypatch.setattr(shared, "BATCH_BYTES", 500)
    texts = corpus(3)
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    got = collect(substring_dedup.substring_dedup(frame(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want_words(docs)
    assert sum(r[2] for r in got) > 300


def test_substring_dedup_overlapping_sources(spark, monkeypatch):
    """A path whose edges have their first places in different documents of one batch is verified edge by edge."""
    monkeypatch.setattr(shared, "BATCH_BYTES", 1500)
    w = [f"w{i}" for i in range(80)]
    texts = [" ".join(w[:45]), " ".join(w[25:]), "filler " * 400, " ".join(w), " ".join(w[10:70])]
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    assert collect(substring_dedup.substring_dedup(frame(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == want_words(docs)


@pytest.mark.parametrize("key_bits", [6, 14])
def test_substring_dedup_is_exact_with_key_collisions(spark, monkeypatch, key_bits):
    """With keys of few bits unlike windows share keys: the words decide all the same."""
    monkeypatch.setattr(shared, "BATCH_BYTES", 600)
    texts = corpus(4, 60)
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    got = collect(substring_dedup.substring_dedup(frame(spark, texts), key_bits=key_bits), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want_words(docs)


def test_hidden_branches_are_found(spark, monkeypatch):
    """Branches that the short forms hide: then paths fail at their source and their edges are looked up one by one."""
    monkeypatch.setattr(shared, "BATCH_BYTES", 300)
    rng = np.random.default_rng(8)
    middle = " ".join(f"m{i}" for i in range(40))
    texts = []
    for i in range(60):
        before, after = (" ".join(f"{side}{x}" for x in range(25)) for side in (f"b{i % 20}x", f"a{rng.integers(0, 20)}x"))
        texts.append(f"{before} {middle} {after}")
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    assert collect(substring_dedup.substring_dedup(frame(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == want_words(docs)
    e = substring_dedup.edges(np.array([len(texts[0])]), texts[0].encode())
    assert (substring_dedup.short_forms(e.after, *np.unique(e.key, return_index=True, return_inverse=True)[1:]) == substring_dedup.NONE).sum() == 1


def test_paths_carry_their_sources_place(spark, monkeypatch):
    monkeypatch.setattr(shared, "BATCH_BYTES", 1)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, ["one two " + passage + " end", "x " + passage, passage + " y z", "alone " * 5])
    batches = shared.batch_table(docs, "words")
    bounds = shared.bucket_bounds(4)
    asked = shared.ask(batches, substring_dedup.ask_edges(bounds, 64))
    paths = shared.materialize(substring_dedup.path_rows(shared.answers_by_batch(batches, shared.answer(asked, 1, substring_dedup.degrees)), bounds, 64), "paths")
    assert [tuple(r) for r in substring_dedup.repeated_paths(paths).collect()] == [(0, 2, 30, 2)]
    assert substring_dedup.unverified(paths).isEmpty()


def test_one_id_fills_many_batches(spark, monkeypatch):
    """A table of null ids only: no batch holds more than its share, and the results are those of one batch."""
    monkeypatch.setattr(shared, "BATCH_BYTES", 2000)
    monkeypatch.setattr(shared, "EXCHANGE_BYTES", 3000)
    texts = [t for t in corpus(7, 40) if t is not None]
    docs = frame(spark, texts, [None] * len(texts))
    sizes = [r["size"] for r in shared.batch_table(docs, "test").select("size").collect()]
    assert len(sizes) > 3 and sum(sizes) == sum(len(t.encode()) for t in texts) and max(sizes) < 2000 + max(len(t.encode()) for t in texts)
    assert {r[1] for r in collect(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed")} == {0}
    lost = sum(r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect())
    monkeypatch.setattr(shared, "BATCH_BYTES", 1 << 20)
    assert lost == sum(r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()) > 300


@pytest.mark.parametrize("run", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_very_long_texts(spark, run):
    """Two texts of over a megabyte that share their second half."""
    rng = np.random.default_rng(2)
    half = " ".join(f"h{i}" for i in rng.integers(0, 1 << 20, 100_000))
    texts = [" ".join(f"{c}{i}" for i in rng.integers(0, 1 << 20, 60_000)) + " " + half for c in "ab"]
    got = collect(run(frame(spark, texts)), "doc_id", "n_removed")
    assert got[0] == (0, 0) and got[1] == (1, 100_000 if run is substring_dedup.substring_dedup else len(half) + 1)


def test_without_repeats_keeps_types(spark):
    """All kinds of columns go through unchanged: times to the microsecond, maps with number keys, names that clash."""
    import datetime

    passage = " ".join(f"p{i}" for i in range(30))
    schema = "doc_id int, when timestamp, n_words map<int, array<double>>, text string, raw binary, carry struct<a: date>"
    rows = [(i, datetime.datetime(2024, 1, 1, 0, 0, 0, 123456 + i), {i: [0.5, None]}, f"{i} " * (i % 2) + passage, b"\x00\xff", (datetime.date(2020, 2, 29),)) for i in range(2)]
    docs = spark.createDataFrame(rows, schema)
    out = substring_dedup.without_repeats(docs)
    assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    want = [r.asDict() for r in docs.collect()]
    want[1]["text"] = "1"
    assert [r.asDict() for r in out.orderBy("doc_id").collect()] == want


def test_without_repeats_keeps_rows_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, [passage, "lead\n" + passage + "\ntail", passage, None, "short"])
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    assert set(out) == {0, 1, 3, 4} and list(out[1].asDict()) == docs.columns
    assert out[1]["text"] == "lead\ntail" and out[1]["n_chars"] == 9 and out[1]["source"] == "src1"


def slow_fingerprint(text: str) -> int:
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    parent = dict(prints)
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(prints), 2):
        if (parent[i] ^ parent[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_simhash_is_exact(spark):
    texts = corpus(5)
    prints = {i: slow_fingerprint(t or "") for i, t in enumerate(texts)}
    want = [(i, prints[i], c) for i, c in sorted(components(prints).items())]
    got = [(i, fp % (1 << 64), c) for i, fp, c in collect(simhash.near_duplicates(frame(spark, texts)), "doc_id", "fp", "component_id")]
    assert got == want


def test_simhash_chains_of_links(spark):
    """Fingerprints two bits apart in a chain are one component; three bits apart are none."""
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 62))
    chain = [base]
    for k in range(0, 24, 2):
        chain.append(chain[-1] ^ (0b11 << k) ^ (0b11 << k + 30 if k % 4 else 0) if k % 4 == 0 else chain[-1] ^ (1 << k) ^ (1 << 63 - k))
    fps = sorted(set(chain) | {base ^ (0b111 << 50), *map(int, rng.integers(0, 1 << 62, 50))})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(df)).collect()}
    want = components(dict(zip(signed, fps, strict=True)))
    assert {f: roots.get(f, f) for f in signed} == want


@pytest.mark.parametrize("crowd", [0, 3, 1000])
def test_simhash_crowded_signatures(spark, crowd):
    """Pairs by signature, exact codes of crowded signatures, and both together give the same components."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(40):  # walks of one to three bits a step
            fps.add(at)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))).tolist():
                at ^= 1 << b
    signed = {f - (1 << 64) if f >> 63 else f: f for f in sorted(fps)}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(df, crowd)
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 2 for r in found.collect())
    roots = {r["node"]: r["root"] for r in simhash.connected_components(found).collect()}
    want = components(dict(sorted(signed.items())))
    assert {f: roots.get(f, f) for f in signed} == want and len(set(want.values())) < len(want)


def test_one_of_each(spark):
    texts = corpus(6)
    texts += [texts[12], texts[12]]
    ids = [*range(len(texts) - 2), 900, 900]  # the last two rows are wholly alike
    docs = frame(spark, texts, ids)
    prints = {k: slow_fingerprint(t or "") for k, t in enumerate(texts)}
    keep = {min((ids[j], j) for j, r in components(prints).items() if r == root)[0] for root in set(components(prints).values())}
    got = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert sorted(got) == sorted(keep)


@pytest.mark.parametrize("run", [lambda d: suffix_dedup.suffix_dedup(d), lambda d: substring_dedup.substring_dedup(d), lambda d: simhash.near_duplicates(d)])
def test_odd_tables(spark, run):
    for name, df in odd_frames(spark):
        assert run(df).count() == df.count(), name
    twice = collect(suffix_dedup.suffix_dedup(odd_frames(spark)[2][1]), "doc_id", "n_removed")
    assert twice == [(7, 0)] * 3  # equal ids are not smaller than each other


def near_copy_texts():
    """Texts with one to five words changed, chains of such, copies, shorts and empties."""
    rng = np.random.default_rng(11)
    texts = [*corpus(12), "a b c", "A  b\tc", "a b c d", None, ""]
    for k in range(25):
        words = [f"k{k}x{i}" for i in rng.integers(0, 400, 90)]
        for _ in range(3):
            texts.append(" ".join(words))
            for i in rng.integers(0, len(words), int(rng.integers(1, 4))):
                words[i] = f"new{rng.integers(0, 1 << 30)}"
    return texts


def slow_shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_copies(texts: dict) -> dict:
    """doc_id to the least doc_id that is reachable over pairs of Jaccard similarity 0.8 or more."""
    own = {i: slow_shingles(t) for i, t in texts.items()}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(own), 2):
        a, b = own[i], own[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return {i: find(i) for i in own}


def test_near_copies_are_all_found(spark):
    from verbena.llm import near_copies

    texts = near_copy_texts()
    want = slow_copies(dict(enumerate(texts)))
    docs = frame(spark, texts)
    out = near_copies.one_of_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < simhash.one_of_each(docs).count()  # two bits leave some of them
    for name, df in odd_frames(spark):
        assert near_copies.one_of_near_copies(df).count() <= df.count(), name


def alike_texts(n: int = 160, words: int = 150) -> list[str]:
    """A crowd of edited copies of one text, most of them below 0.8 of each other, some above, of unlike lengths."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 900, words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(words, rng.integers(1, 14), replace=False):
            text[at] = f"edit{k}x{at}"
        out.append(" ".join(text[: words - int(rng.integers(0, 12))]))
    return out + [" ".join(base[:100]), " ".join(base[:125]), " ".join(base[20:])]


def test_alike_texts_lose_no_link_and_give_few_pairs(spark):
    from verbena.llm import near_copies

    texts = alike_texts()
    own = [slow_shingles(t) for t in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(own)), 2) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    nodes = spark.createDataFrame([(i, len(x), i) for i, x in enumerate(own)], "node long, size long, root long")
    pairs = {tuple(sorted(r)) for r in near_copies.close_pairs(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    assert linked <= pairs and len(linked) > 20
    assert len(pairs) < 3 * len(linked) < 0.2 * len(own) ** 2 / 2
    kept = near_copies.one_of_near_copies(frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(slow_copies(dict(enumerate(texts))).values()))


def test_pipeline_keeps_no_near_copies(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    copy = base[:60] + ["changed"] + base[61:]
    docs = frame(spark, [" ".join(base), " ".join(copy), "other words altogether here now"])
    assert simhash.one_of_each(docs).count() == 3  # over two bits apart
    assert sorted(r["doc_id"] for r in p.keep_one_of_each(spark, docs, "").collect()) == [0, 2]
