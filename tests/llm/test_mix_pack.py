"""Operators 6 and 8, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, collect, corpus, frame, odd_frames, prose
from verbena.llm import mixing, packing
from verbena.llm.queries import tokenizer_file
from verbena.llm.toxicity import toxicity
from verbena.llm.word_tokens import WordTokenizer

WORDS = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(WORDS)


def test_word_tokens_match_the_tokeniser(whole):
    import pyarrow as pa

    texts = [t or "" for t in corpus(1)] + ["Don't STOP: it's 3.14, (ok) <|endoftext|>x é́ İ ΑΣ ß y　z", "a\x1cb \x85c", "''' \"q\" 's", "µm ½ ÷×", "!!!? --- a-b_c"]
    got = list(WordTokenizer(WORDS).ids_of(pa.array(texts), 1))
    assert [x.tolist() for x in got] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packing(spark, whole):
    rng = random.Random(1)
    texts = [*corpus(2), prose(rng, 9000), prose(rng, 4095), *[prose(rng, rng.randint(1, 2500)) for _ in range(60)]]
    rows = packing.pack(frame(spark, texts), WORDS).collect()
    docs = defaultdict(dict)
    bins = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(docs[i]) == list(range(-(-len(ids) // 4096)))
        for k, r in docs[i].items():
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * 4096, len(ids[k * 4096 : k * 4096 + 4096]), zlib.crc32(ids[k * 4096 : k * 4096 + 4096].tobytes()))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = [r["length"] for r in rows]
    assert len(bins) == best_fit(lengths, 4096)
    assert -(-sum(lengths) // 4096) <= len(bins) <= 1.2 * -(-sum(lengths) // 4096)


def best_fit(lengths, capacity):
    """Bins that one-by-one best fit, longest first, opens."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_sweeps_are_best_fit():
    rng = random.Random(3)
    for capacity in (7, 20, 64):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            plan = packing.sweep(dict(Counter(lengths)), capacity)
            used = defaultdict(list)
            for length, _, n, first, offset in plan:
                for i in range(n):
                    used[first + i].append((offset, length))
            assert sorted(length for own in used.values() for _, length in own) == sorted(lengths)
            for own in used.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(used) == best_fit(lengths, capacity)


def mixed_rows(seed=0, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 80))
        if i % 9 == 0:
            text = " | ".join(text.split())
        if i % 11 == 0:
            text = text.upper()
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    return [*out, (None, "no id", "en", "a", 5), (n, None, "en", "b", 0), (n, "", "en", "b", 0)]


def test_mixing_equals_sql(spark):
    documents = spark.createDataFrame(mixed_rows(), SCHEMA)
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    want = sorted(con.sql(mixing.mix_sql()).fetchall(), key=str)
    got = mixing.mix_sample(documents).selectExpr("doc_id", "source", "lang", "topic", "n_tokens", "round(rate, 6) AS rate", "copies")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_raking_meets_all_targets(spark):
    cells = spark.createDataFrame([(s, x, t, 10 + 7 * i + 3 * j + k) for i, s in enumerate("abc") for j, x in enumerate("xy") for k, t in enumerate("pq")], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.1, "q": 0.9}}
    frames = {d: spark.createDataFrame(list(v.items()), f"{d} string, target double") for d, v in targets.items()}
    raked = mixing.rake(cells, frames)
    for d, want in targets.items():
        got = {r[d]: r["s"] for r in raked.groupBy(d).agg({"share": "sum"}).withColumnRenamed("sum(share)", "s").collect()}
        assert all(abs(got[k] - x) < 1e-6 for k, x in want.items())


def test_mixing_keeps_columns_and_expectation(spark):
    documents = spark.createDataFrame(mixed_rows(1, 2000), SCHEMA)
    kept = mixing.mix_copies(documents, 0.5)
    assert kept.columns == documents.columns
    tokens = lambda d: d.selectExpr("sum(greatest(regexp_count(coalesce(text, ''), '[^ ]+'), 1)) AS n").first()["n"]
    assert abs(tokens(kept) / tokens(documents) - 0.5) < 0.06
    for df in (kept, mixing.mix_sample(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_copies_meet_the_targets(spark, monkeypatch):
    """The marginals of the sample itself, not only of the raked weights, are the targets."""
    documents = spark.createDataFrame(mixed_rows(2, 6000), SCHEMA)
    cells = mixing.features(documents).groupBy(*mixing.DIMENSIONS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    targets = {d: {r[0]: r[1] for r in t.collect()} for d, t in mixing.tempered_targets(cells).items()}

    def gap(rows):
        total = sum(r["n_tokens"] * r["copies"] for r in rows)
        return max(abs(sum(r["n_tokens"] * r["copies"] for r in rows if r[d] == k) / total - x) for d in targets for k, x in targets[d].items())

    sample = mixing.mix_sample(documents).collect()
    assert gap(sample) < 0.02 and max(r["copies"] for r in sample) > 1
    copied = mixing.mix_copies(documents)
    assert copied.columns == documents.columns
    assert gap(mixing.features(copied).selectExpr("*", "1 AS copies").collect()) < 0.02
    tokens = lambda d: mixing.features(d).agg({"n_tokens": "sum"}).first()[0]
    assert abs(tokens(copied) / tokens(documents) - mixing.KEEP) < 0.04
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)  # the dealt form gives the same
    assert sorted(map(str, mixing.mix_sample(documents).selectExpr("doc_id", "copies", "round(rate, 6)").collect())) == sorted(str(r) for r in spark.createDataFrame(sample).selectExpr("doc_id", "copies", "round(rate, 6)").collect())
    for _, df in odd_frames(spark):
        assert set(mixing.mix_copies(df).collect()) <= set(df.collect())


def test_pipeline_mixing_meets_the_targets(spark):
    import corpus_pipeline as p

    documents = spark.createDataFrame(mixed_rows(2, 3000), SCHEMA)
    assert sorted(p.mix_sources(spark, documents, "").collect(), key=str) == sorted(mixing.mix_copies(documents).collect(), key=str)


def test_odd_tables(spark):
    for name, df in odd_frames(spark):
        assert packing.pack(df, WORDS).select("doc_id").count() == df.count(), name
        assert mixing.mix_sample(df).count() <= df.count()
        assert sum(r["copies"] for r in mixing.mix_sample(df).collect()) == mixing.mix_copies(df).count()


def cut_by_hand(texts):
    """Each text without the words of windows that start earlier; what stood between kept words stays, gaps become a line break or space."""
    import re

    from tests.llm.test_dedup import removed_words

    order = sorted(texts)
    out = {}
    for i, (words, gone) in zip(order, removed_words([(i, (texts[i] or "").encode()) for i in order]), strict=True):
        if all(gone) and words:
            continue
        if not any(gone):
            out[i] = texts[i] or ""
            continue
        text, parts, before = (texts[i] or "").encode(), [], None
        for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
            if not gone[k]:
                if before is not None:
                    gap = text[before[1] : m.start()]
                    parts.append(gap if before[0] == k - 1 else b"\n" if b"\n" in gap else b" ")
                parts.append(m[0])
                before = (k, m.end())
        out[i] = b"".join(parts).decode()
    return out


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows and further columns go through every stage; columns and types stay."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, df in odd_frames(spark):
        for stage_name, stage in p.STAGES:
            out = stage(spark, df, str(tmp_path))
            if stage_name != "packing":
                assert out.dtypes == df.dtypes, (name, stage_name)
            n = out.count()
            assert n == 0 if name == "empty" else n > 0 or stage_name in ("mixing", "toxicity"), (name, stage_name)


def test_scratch_is_swept(spark):
    from verbena.llm import shared

    kept = shared.materialize(spark.range(3), "kept-table")
    since = len(shared.MADE)
    other = shared.materialize(spark.range(3), "other")
    table = shared.batch_table(frame(spark, ["a b", "c"]), "swept")
    assert table.count() > 0 and other.count() == 3
    made = shared.MADE[since:]
    names = [n for k, n in made if k == "table"]
    shared.sweep(spark, made)
    assert kept.count() == 3 and not made and len(names) == 1 and not spark.catalog.tableExists(names[0]) and len(shared.MADE) == since


def test_pipeline(spark):
    import corpus_pipeline as p
    from tests.llm.test_dedup import components, slow_copies, slow_fingerprint

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_dedup", "substring_dedup", "mixing", "packing"]
    now = docs
    results = {}
    for name, stage in p.STAGES:
        out = p.materialize(stage(spark, now, sf), "test")
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        results[name], now = (now, out), out
    before, after = results["simhash_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    heads = set(components({i: slow_fingerprint(t or "") for i, t in texts.items()}).values())
    assert {r["doc_id"] for r in after.collect()} == set(slow_copies({i: texts[i] for i in sorted(heads)}).values())
    before, after = results["substring_dedup"]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == cut_by_hand({r["doc_id"]: r["text"] for r in before.collect()})
    before, after = results["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in toxicity(before, labels).filter("predicted = 0").collect()}
    before, after = results["mixing"]
    assert set(after.collect()) <= set(before.collect())
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in after.collect()}
    assert collect(p.run(spark, sf), "doc_id", "piece", "ids_crc32") == collect(now, "doc_id", "piece", "ids_crc32")
