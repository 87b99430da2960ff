"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming carries the best
score and the number of pieces up to there. Ties go to the path whose last piece starts first, as the tokeniser takes a
later candidate only if its score is strictly better. A character that no piece covers costs ten less than the lowest
score and counts as its UTF-8 bytes (byte fallback). No piece has a space after another character, so a text's best
path is that of its segments (a run of spaces and what follows); each distinct segment is solved once for a worker.

The vocabulary's scores are whole numbers, so sums in double precision are exact however long the text is.

Defined cases: a null or empty text has no tokens; repeated rows are counted apiece; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verbena.llm.shared import documents_of, joined, sums_by, text_groups, trimmed

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct segments that a worker remembers, and the longest that is worth it.
CACHE_SEGMENTS, CACHE_LENGTH = 400_000, 64
NORMAL, USER_DEFINED = 1, 4


def vocabulary(model_file: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model file; control, unknown and byte pieces match no text."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(model_file, "rb") as f:
        model = schema.ModelProto.FromString(f.read())
    return {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED)}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        inner = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces with a space inside: {inner[:3]}")
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.cache: dict[bytes, int] = {}

    def solve(self, text: str) -> int:
        """Pieces on the best path through ``text``, whose spaces are ``SPACE`` already."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at = 0
        single, unknown = self.single, self.unknown

        def alone(e: int) -> None:  # no piece ends here, or none that stands alone: the character itself
            c = text[e - 1]
            if c not in single:
                score = best[e - 1] + unknown
                if not count[e] or score > best[e]:
                    best[e], count[e] = score, count[e - 1] + len(c.encode())

        for last, (length, score) in self.automaton.iter(text):
            e = last + 1
            while at < last:
                at += 1
                alone(at)
            s = e - length
            total = best[s] + score
            if not count[e] or total > best[e] or total == best[e] and s < first:
                best[e], count[e], first = total, count[s] + 1, s
        while at < n:
            at += 1
            alone(at)
        return count[n]

    def segment(self, raw: bytes) -> int:
        got = self.cache.get(raw)
        if got is None:
            got = self.solve(raw.decode().replace(" ", SPACE))
            if len(raw) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_SEGMENTS:
                    self.cache.clear()
                self.cache[raw] = got
        return got

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; a leading space is understood unless the text is empty."""
        escaped = SPACE.encode()
        body, ends = joined([b" " + (x.replace(escaped, b" ") if escaped in x else x) if x else x for x in texts])
        if not len(body):
            return np.zeros(len(texts), np.int64)
        space = body == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        begins = np.concatenate(([0], ends[:-1]))
        start[begins[begins < ends]] = True
        at = np.flatnonzero(start)
        offsets = np.append(at, len(body)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        each = np.fromiter(map(self.segment, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        return sums_by(each[words.indices.to_numpy(zero_copy_only=False)], np.searchsorted(at, ends))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes) for every whole text: one narrow pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model_file))
        for part in parts:
            for at, texts in text_groups(part.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), pa.array(counter.counts(texts), pa.int64()), pa.array([len(x) for x in texts], pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

    return documents_of(docs).mapInArrow(trimmed(run), "doc_id long, n_tokens long, n_bytes long")
