"""Token ids of whole texts by a word-level BPE file, each distinct word tokenised once for each worker.

The file's pre-tokeniser never joins what white space parts, so a text's ids are those of its words in a row. Words
are deduplicated in Arrow for each batch of texts and looked up in a bounded cache; plain words go to the model itself,
all others through the whole tokeniser. Texts with characters whose handling spans white space take the slow way.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers.
CACHE_WORDS = 500_000
#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 2 << 20
#: A letter run, lower case, with punctuation around it: what can be split without the tokeniser.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest is numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def part(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token: a run of letters or of punctuation."""
        got = self.parts.get(piece)
        if got is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            form = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            got = self.parts[piece] = tuple(x.id for x in self.model.tokenize(form))
        return got

    def word(self, word: str) -> bytes:
        """A word's ids as unsigned 32-bit numbers."""
        low = word.lower()
        m = PLAIN.fullmatch(low)
        if m and len(low) == len(word) and "<|" not in low:
            ids = self.part(m[2])
            if m[1]:
                ids = self.part(m[1]) + ids
            if m[3]:
                ids += self.part(m[3])
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, texts: pa.Array, end_token: int) -> Iterator[np.ndarray]:
        """The ids of each text and the end token."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_BYTES)))
            yield from self.group(texts.slice(at, n), end_token)
            at += n

    def group(self, texts: pa.Array, end_token: int) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, table = self.cache, []
        for w in known:
            ids = cache.get(w)
            if ids is None:
                ids = cache[w] = self.word(w)
            table.append(ids)
        lens = np.fromiter(map(len, table), np.int64, len(table)) // 4
        pool = np.frombuffer(b"".join(table), "<u4")
        first = np.cumsum(lens) - lens
        code = flat.indices.to_numpy(zero_copy_only=False)
        each = lens[code]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.repeat(first[code] - (ends - each), each) + np.arange(total)
        ids = pool[gather]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))))]
        tail = np.array([end_token], np.uint32)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield np.concatenate((ids[a:b], tail))
