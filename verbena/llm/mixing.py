"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Token weights are summed to cells of source, language and topic (partial sums first, so a source with a third of all
rows sends a few cells). Raking scales the cells to the target share of each source, language and topic in turn,
``ROUNDS`` times. A cell's rate is its raked share over its tokens, scaled so that the expected sample has ``KEEP`` of all
tokens. A hash of a document's id is a number from 0 to 1; a rate of 0.3 keeps the document if that number lies below 0.3, a
rate of 2.3 gives two copies, and a third if it does. No rate is cut, so the sample meets all targets in expectation.

Defined cases: a null source or language is its own group, named ``unknown``; a null or empty text weighs one token; rows with
one doc_id have one number of copies; a null doc_id hashes like a word; a text's length plays no part beyond its tokens; an empty table gives an
empty table; further columns are kept by ``mix_copies`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.shared import materialize

ROUNDS = 12
#: Rounds in one plan.
ROUNDS_AT_ONCE = 4
#: So many cells are raked in one partition, without shuffles; more are dealt by each dimension in turn.
FEW_CELLS = 20_000
KEEP = 0.8
#: A target share is the present share raised to this power and rescaled: below 1 it evens out.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
DIMENSIONS = ("source", "lang", "topic")
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def token_weight(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long"), F.lit(1).cast("long"))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def topic_of(text: Column, tokens: Column) -> Column:
    """A rough kind of text, by its make-up."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 10, "tabular")
        .when(count_of(t, "[A-Z]") * 4 > F.length(t), "capitals")
        .when(count_of(t, "[#*$%&<>]") * 50 > F.length(t), "symbols")
        .when(tokens > 1000, "long")
        .otherwise("prose")
    )


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "text", token_weight(F.col("text")).alias("n_tokens"))
    return d.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def tempered_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """For each dimension (value, target): the tempered shares."""
    out = {}
    for d in DIMENSIONS:
        share = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER[d])).alias("p"))
        total = share.agg(F.sum("p")).first()[0] or 1.0
        out[d] = share.select(d, (F.col("p") / F.lit(total)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``share``: non-negative, near all targets at once."""
    at = cells
    for d in DIMENSIONS:
        at = at.join(targets[d].withColumnRenamed("target", f"{d}_target"), d)
    at = materialize(at.withColumn("share", F.col("tokens").cast("double")), "cells")
    few = at.count() <= FEW_CELLS
    for k in range(rounds):
        if few and k % ROUNDS_AT_ONCE == 0:
            at = at.coalesce(1)  # one partition serves the windows of all dimensions
        for d in DIMENSIONS:
            at = at.withColumn("share", F.col("share") * F.col(f"{d}_target") / F.sum("share").over(Window.partitionBy(d)))
        if k % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1:
            at = materialize(at, "cells")  # cuts the lineage
    return at.select(*DIMENSIONS, "tokens", "share")


def rates(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """``rate`` of each cell: its raked share over its tokens, scaled to ``keep`` of all tokens."""
    at = raked.withColumn("factor", F.col("share") / F.col("tokens"))
    tokens, share = at.agg(F.sum("tokens"), F.sum("share")).first()
    scale = float(tokens or 0) * keep / share if share else 0.0
    return at.select(*DIMENSIONS, (F.col("factor") * F.lit(scale)).alias("rate"))


def unit_hash(doc_id: str = "doc_id") -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    name = F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sampling_rates(found: DataFrame, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, rate) from the features of all documents."""
    cells = materialize(found.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return materialize(rates(rake(cells, tempered_targets(cells)), keep), "rates")


def copies(rate: str, doc_id: str = "doc_id") -> Column:
    """How often a document comes: the rate's whole part, and once more with its fraction as probability."""
    whole = F.floor(rate)
    return whole + (unit_hash(doc_id) < F.col(rate) - whole).cast("long")


def mix_sample(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, rate, copies) of the documents in the sample."""
    found = materialize(features(docs), "mix-features")
    rated = found.join(sampling_rates(found, keep), list(DIMENSIONS))
    return rated.withColumn("copies", copies("rate")).filter("copies > 0")


def mix_copies(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """As many copies of each document as its rate says, all columns as they are: the sample meets the raked targets."""
    rate = sampling_rates(features(docs), keep).select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("rate").alias("__rate"))
    own = docs.withColumns({"__s": F.coalesce("source", F.lit("unknown")), "__l": F.coalesce("lang", F.lit("unknown")), "__t": topic_of(F.col("text"), token_weight(F.col("text")))})
    rated = own.join(rate, (F.col("__s") == F.col("__source")) & (F.col("__l") == F.col("__lang")) & (F.col("__t") == F.col("__topic")))
    some = rated.select(*docs.columns, copies("__rate").alias("__times")).filter("__times > 0")
    return some.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def mix_sql(keep: float = KEEP, rounds: int = ROUNDS, table: str = "documents") -> str:
    """The same in SQL, the rounds written out."""
    s = [f"""f0 AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS text,
  greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n_tokens FROM {table}),
f AS (SELECT doc_id, source, lang, n_tokens, CASE
  WHEN length(text) - length(replace(text, '|', '')) >= 10 THEN 'tabular'
  WHEN (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) * 4 > length(text) THEN 'capitals'
  WHEN (length(text) - length(regexp_replace(text, '[#*$%&<>]', '', 'g'))) * 50 > length(text) THEN 'symbols'
  WHEN n_tokens > 1000 THEN 'long' ELSE 'prose' END AS topic FROM f0),
c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM f GROUP BY ALL)"""]
    for d in DIMENSIONS:
        s.append(f"t_{d} AS (SELECT {d}, p / sum(p) OVER () AS target FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {TEMPER[d]}) AS p FROM c GROUP BY {d}))")
    s.append("r0 AS (SELECT c.*, t_source.target AS source_target, t_lang.target AS lang_target, t_topic.target AS topic_target, tokens::DOUBLE AS share FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            s.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (share * {d}_target / sum(share) OVER (PARTITION BY {d}) AS share) FROM r{k})")
            k += 1
    s.append(f"q AS (SELECT *, share / tokens AS factor FROM r{k})")
    s.append(f"p AS (SELECT source, lang, topic, factor * (SELECT sum(tokens)::DOUBLE * {keep} / sum(share) FROM q) AS rate FROM q)")
    s.append(f"""h AS (SELECT doc_id, source, lang, topic, n_tokens, rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 AS u FROM f JOIN p USING (source, lang, topic))""")
    return "WITH " + ",\n".join(s) + """
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM h
WHERE floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT > 0"""
