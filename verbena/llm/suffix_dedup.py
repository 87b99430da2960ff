"""Exact substring deduplication over bytes by deep-shallow suffix sorting.

A byte goes if a ``WINDOW``-byte string over it also starts in a document of smaller id. Only suffixes that can
matter are sorted: every window is owned by the least-hashed ``ANCHOR``-byte string in it, so equal windows are owned by
equal anchors at equal places. Round one deals the anchors' hashes into buckets and finds those that more than one
document has. Round two deals the text around just those anchors; in each bucket its suffixes are put in order
by deep-shallow sorting, and neighbours with a common prefix of a whole window are equal. Each comes with the least doc_id that its
batch has it in, and those with a greater one than the least of all lose the window; inside a batch the same sort decides
between documents.

Deep-shallow sorting: multikey quicksort on eight bytes at a time down to ``SHALLOW`` bytes; suffixes still tied there
go to blind tries. A trie round compares each suffix of a group with the group's pivot once, which gives its
branching depth; depth and branching byte place it in the trie, and suffixes at one branch form the next group.

A batch sends each anchor and context once, however often its documents repeat it, so a passage that a third of all
documents share costs one entry for each batch. Hashes only choose candidates; what goes is decided on bytes.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; rows with one doc_id are not "smaller"
than each other, so they lose nothing to each other, however many batches they fill; a null doc_id counts as smaller than all
others; a very long text is one batch of its own; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from verbena.llm.shared import FAMILIES, NULL_ID, U64, answer, answers_by_batch, ask, batch_table, bucket_bounds, bucket_place, bucket_slices, exchange_tasks, expand_sorted, mix, squeeze_sorted, trimmed, unpack

WINDOW, ANCHOR = 50, 25
#: Anchors in a window, bytes around an anchor that its windows can reach.
CHOICES, CONTEXT = WINDOW - ANCHOR + 1, 2 * WINDOW - ANCHOR
BEFORE = WINDOW - ANCHOR
SHALLOW = 24
SLICE_BYTES = 1 << 19


# --- deep-shallow sorting -------------------------------------------------------------------------

def multikey(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the rows by their first ``depth`` bytes, eight at a time; only ties are sorted on."""
    n = len(rows)
    order, rank = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)
    for at in range(0, depth, 8):
        if not len(tied):
            break
        own = order[tied]
        word = np.ascontiguousarray(rows[own, at : at + 8]).view(">u8").ravel().astype(U64)
        again = np.lexsort((word, rank[own]))
        own, word = own[again], word[again]
        order[tied] = own
        group = rank[own]
        new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(own)))
        tied = tied[np.repeat(size, size) > 1]
    return order, rank


def blind_tries(rows: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> None:
    """Put each group of rows that share a rank (and ``depth`` bytes) in order, all groups' tries level by level."""
    width = rows.shape[1]
    place = np.arange(len(order))
    size = np.bincount(rank, minlength=len(order))
    tied = place[size[rank[order]] > 1]
    while len(tied):
        own = order[tied]
        group = rank[own]
        first = np.append(True, group[1:] != group[:-1])
        pivot = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        branch, mine, its = np.empty(len(own), np.int64), np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        for i in range(0, len(own), 1 << 15):  # bounded memory
            part = slice(i, i + (1 << 15))
            a, b = rows[own[part], depth:], rows[pivot[part], depth:]
            differ = a != b
            at = np.where(differ.any(1), differ.argmax(1), width - depth)
            inside = np.minimum(at, width - depth - 1)
            branch[part], mine[part], its[part] = at + depth, a[np.arange(len(a)), inside], b[np.arange(len(a)), inside]
        equal = branch >= width
        less = ~equal & (mine < its)
        side = np.where(less, 0, np.where(equal, 1, 2))
        deep = np.where(less, branch, np.where(equal, 0, width - branch))
        key = (side * (width + 1) + deep) * 256 + np.where(equal, 0, mine)
        again = np.lexsort((key, group))
        own, group, key, equal = own[again], group[again], key[again], equal[again]
        order[tied] = own
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        count = np.diff(np.append(np.flatnonzero(new), len(own)))
        tied = tied[(np.repeat(count, count) > 1) & ~equal]  # equal rows need no more order


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of fixed-width byte rows; equal rows share a rank."""
    shallow = min(shallow, rows.shape[1] // 8 * 8)
    order, rank = multikey(rows, shallow)
    blind_tries(rows, order, rank, shallow)
    return order, rank


# --- anchors and contexts --------------------------------------------------------------------------

@dataclass
class Anchors:
    """Anchors of a batch: place, hash, document, and the first and last window that each owns."""

    at: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(body: np.ndarray, lens: np.ndarray) -> Anchors:
    """The owners of all windows, in slices of whole documents so that work arrays stay small."""
    out: list[Anchors] = []
    ends = np.cumsum(lens)
    low = 0
    while low < len(lens):
        start = int(ends[low] - lens[low])
        high = max(low + 1, int(np.searchsorted(ends, start + SLICE_BYTES, side="right")))
        found = slice_anchors(body[start : int(ends[high - 1])], lens[low:high])
        if found is not None:
            out.append(Anchors(found.at + start, found.key, found.doc + low, found.first + start, found.last + start))
        low = high
    if not out:
        none = np.empty(0, np.int64)
        return Anchors(none, np.empty(0, U64), none, none, none)
    return Anchors(*(np.concatenate([getattr(a, f) for a in out]) for f in ("at", "key", "doc", "first", "last")))


def slice_anchors(body: np.ndarray, lens: np.ndarray) -> Anchors | None:
    n = len(body)
    if n < WINDOW:
        return None
    up, down = FAMILIES[0][0].get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(body * up[:n], out=sums[1:])
    key = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n + 1 - ANCHOR])
    bits = max(1, int(n).bit_length())
    low = (key >> U64(bits) << U64(bits)) | np.arange(len(key), dtype=U64)
    width = 1
    while 2 * width <= CHOICES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < CHOICES:
        low = np.minimum(low[: len(low) - (CHOICES - width)], low[CHOICES - width :])
    owner = (low & U64((1 << bits) - 1)).astype(np.int64)
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(owner))
    valid = np.flatnonzero(at + WINDOW <= ends[doc[: len(owner)]])
    if not len(valid):
        return None
    owner = owner[valid]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1])))
    place = owner[new]
    spread = mix(key[place] ^ U64(0x9E3779B97F4A7C15))  # owners have small hashes; buckets need even ones
    return Anchors(place, spread, doc[place], valid[new], valid[np.append(new[1:], len(valid)) - 1])


def ask_anchors(bounds: np.ndarray):
    def run(ids: np.ndarray, lens: np.ndarray, body: bytes) -> Iterator[tuple[int, bytes]]:
        keys = np.unique(anchors(np.frombuffer(body, np.uint8), lens).key)
        for b, own in bucket_slices(keys, bounds):
            yield b, squeeze_sorted(keys[own])

    return run


def shared_keys(payloads: list[bytes], _: np.ndarray) -> list[bytes]:
    """For each batch one bit for each of its keys: another batch has it too."""
    keys = [expand_sorted(p) for p in payloads]
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    k = flat[order]
    same = k[1:] == k[:-1]
    more = np.zeros(len(flat), bool)
    more[order] = np.append(same, False) | np.append(False, same)
    return [np.packbits(x).tobytes() for x in np.split(more, np.cumsum([len(x) for x in keys])[:-1])]


def candidates(ids: np.ndarray, lens: np.ndarray, body: bytes, bounds: np.ndarray, answers: dict[int, bytes]) -> tuple[Anchors, np.ndarray]:
    """The batch's anchors that occur in another document, and which of them occur in another batch."""
    a = anchors(np.frombuffer(body, np.uint8), lens)
    keys, inverse = np.unique(a.key, return_inverse=True)
    elsewhere = key_flags(keys, bounds, answers)
    doc_id = ids[a.doc]
    least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), NULL_ID)
    np.minimum.at(least, inverse, doc_id)
    np.maximum.at(most, inverse, doc_id)
    keep = (elsewhere | (least < most))[inverse]
    return Anchors(a.at[keep], a.key[keep], a.doc[keep], a.first[keep], a.last[keep]), elsewhere[inverse][keep]


def key_flags(keys: np.ndarray, bounds: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The answers' bits in the order of the batch's sorted keys."""
    out = np.zeros(len(keys), bool)
    for b, data in answers.items():
        own = bucket_place(keys, bounds, b)
        out[own] = np.unpackbits(np.frombuffer(data, np.uint8), count=own.stop - own.start).astype(bool)
    return out


#: A context's row: the text around the anchor (zeros beyond the document), how much of it there is on both sides, and the owned windows.
ROW = CONTEXT + 4


def contexts(body: np.ndarray, ends: np.ndarray, lens: np.ndarray, a: Anchors) -> np.ndarray:
    """Rows of bytes that tell apart what the anchors' windows are."""
    begin, end = (ends - lens)[a.doc], ends[a.doc]
    left, right = np.minimum(BEFORE, a.at - begin), np.minimum(WINDOW, end - a.at)
    rows = np.zeros((len(a.at), ROW), np.uint8)
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), body, np.zeros(WINDOW, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)
    step = np.arange(-BEFORE, WINDOW)
    for i in range(0, len(a.at), 1 << 16):
        p = slice(i, i + (1 << 16))
        inside = (step >= -left[p, None]) & (step < right[p, None])
        rows[p, :CONTEXT] = view[a.at[p]] * inside
    rows[:, CONTEXT], rows[:, CONTEXT + 1] = left, right
    rows[:, CONTEXT + 2], rows[:, CONTEXT + 3] = a.at - a.last, a.at - a.first
    return rows


def distinct_contexts(rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row index for each distinct context in key order, each row's context)."""
    pair = np.lexsort((rank, key))
    new = np.append(True, (key[pair][1:] != key[pair][:-1]) | (rank[pair][1:] != rank[pair][:-1])) if len(pair) else np.empty(0, bool)
    inverse = np.empty(len(rank), np.int64)
    inverse[pair] = np.cumsum(new) - 1
    return pair[new], inverse


def ask_contexts(bounds: np.ndarray):
    def run(ids: np.ndarray, lens: np.ndarray, body: bytes, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        a, elsewhere = candidates(ids, lens, body, bounds, answers)
        a = Anchors(*(getattr(a, f)[elsewhere] for f in ("at", "key", "doc", "first", "last")))
        if not len(a.at):
            return
        rows = contexts(np.frombuffer(body, np.uint8), np.cumsum(lens), lens, a)
        one, inverse = distinct_contexts(deep_shallow(rows)[1], a.key)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids[a.doc])
        keys = a.key[one]
        squeeze = zstandard.ZstdCompressor(level=3)
        for b, own in bucket_slices(keys, bounds):
            yield b, squeeze.compress(keys[own].tobytes() + least[own].tobytes() + rows[one[own]].tobytes())

    return run


def earlier_windows(payloads: list[bytes], _: np.ndarray) -> list[bytes]:
    """For each context of each batch a mask of its windows that also start in a document of smaller id than all that the batch has it in."""
    data = [zstandard.ZstdDecompressor().decompress(p) for p in payloads]
    sizes = [len(d) // (16 + ROW) for d in data]
    key = np.concatenate([np.frombuffer(d, U64, n) for d, n in zip(data, sizes, strict=True)])
    ids = np.concatenate([np.frombuffer(d, np.int64, n, 8 * n) for d, n in zip(data, sizes, strict=True)])
    rows = np.concatenate([np.frombuffer(d, np.uint8, n * ROW, 16 * n).reshape(n, ROW) for d, n in zip(data, sizes, strict=True)])
    mask = lost_windows(rows, deep_shallow(rows)[1], key, ids)
    return [x.tobytes() for x in np.split(mask, np.cumsum(sizes)[:-1])]


def lost_windows(rows: np.ndarray, rank: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each sorted context a mask of its windows that some context of smaller id has too."""
    mask = np.zeros(len(rows), np.uint32)
    # equal contexts: those of the least id keep their windows, the others lose all
    first = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(first, rank, ids)
    owned = owned_mask(rows)
    later = ids > first[rank]
    mask[later] = owned[later]
    # anchors with several contexts: their windows are sorted as suffixes of their own
    keep = np.flatnonzero(~later)
    _, one, which = np.unique(rank[keep], return_index=True, return_inverse=True)
    lead = keep[one]
    lead = lead[np.argsort(key[lead], kind="stable")]
    k = key[lead]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.empty(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(k)))
    lead = lead[np.repeat(size, size) > 1]
    if len(lead):
        for part in same_key_parts(lead, key):
            sort_windows(rows, ids, part, mask)
        mask[keep] = mask[keep[one]][which]
    return mask


def same_key_parts(lead: np.ndarray, key: np.ndarray, most: int = 1 << 15) -> Iterator[np.ndarray]:
    """Runs of about ``most`` contexts that never split an anchor's."""
    edges = np.append(np.flatnonzero(np.append(True, key[lead][1:] != key[lead][:-1])), len(lead))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield lead[edges[at] : edges[to]]
        at = to


def owned_mask(rows: np.ndarray) -> np.ndarray:
    low, high = rows[:, CONTEXT + 2].astype(np.uint64), rows[:, CONTEXT + 3].astype(np.uint64)
    return ((U64(1) << (high + U64(1))) - (U64(1) << low)).astype(np.uint32)


def sort_windows(rows: np.ndarray, ids: np.ndarray, lead: np.ndarray, mask: np.ndarray) -> None:
    """Sort the windows of the ``lead`` contexts as suffixes; a window that a smaller id has too gets its bit."""
    low, high = rows[lead, CONTEXT + 2].astype(np.int64), rows[lead, CONTEXT + 3].astype(np.int64)
    count = high - low + 1
    who = np.repeat(lead, count)
    back = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    view = np.lib.stride_tricks.sliding_window_view(rows[:, :CONTEXT], WINDOW, axis=1)
    windows = view[who, BEFORE - back]
    _, rank = deep_shallow(windows)
    first = np.full(len(who), np.iinfo(np.int64).max)
    np.minimum.at(first, rank, ids[who])
    hit = ids[who] > first[rank]
    np.bitwise_or.at(mask, who[hit], (U64(1) << back[hit].astype(U64)).astype(np.uint32))


# --- the removed bytes -----------------------------------------------------------------------------

def removed_bytes(ids: np.ndarray, lens: np.ndarray, body: bytes, bounds: np.ndarray, answers: dict[int, bytes], masks: dict[int, bytes]) -> np.ndarray:
    """Which bytes of a batch go."""
    data, ends = np.frombuffer(body, np.uint8), np.cumsum(lens)
    gone = np.zeros(len(data) + 1, np.int64)
    a, elsewhere = candidates(ids, lens, body, bounds, answers)
    if not len(a.at):
        return np.zeros(len(data), bool)
    rows = contexts(data, ends, lens, a)
    _, rank = deep_shallow(rows)
    full = lost_windows(rows, rank, a.key, ids[a.doc])
    away = np.flatnonzero(elsewhere)
    if len(away) and masks:
        one, inverse = distinct_contexts(rank[away], a.key[away])
        keys = a.key[away][one]
        bits = np.zeros(len(one), np.uint32)
        for k, x in masks.items():
            bits[bucket_place(keys, bounds, k)] = np.frombuffer(x, np.uint32)
        full[away] |= bits[inverse]
    count = a.last - a.first + 1
    who = np.repeat(np.arange(len(a.at)), count)
    window = np.repeat(a.first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = window[(full[who] >> (a.at[who] - window).astype(np.uint32)) & 1 > 0]
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Bytes removed from each document, and the digest of what is left (with ``with_kept`` those bytes too)."""
    batches = batch_table(docs, "bytes")
    tasks = exchange_tasks(batches)
    bounds = bucket_bounds(tasks)
    one = answers_by_batch(batches, answer(ask(batches, ask_anchors(bounds)), tasks, shared_keys))
    two = answer(ask(one, ask_contexts(bounds), 1), tasks, earlier_windows)
    both = answers_by_batch(one, two, "answers1")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, lens, body = unpack(row["ids"], row["lens"], row["body"])
                first, second = ({a["bucket"]: a["answer"] for a in row[c] or ()} for c in ("answers", "answers1"))
                gone = removed_bytes(ids, lens, body, bounds, first, second)
                out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                at = 0
                for doc, size in zip(ids.tolist(), lens.tolist(), strict=True):
                    text, own = body[at : at + size], gone[at : at + size]
                    at += size
                    removed = int(own.sum())
                    edge = np.diff(own.view(np.int8), prepend=np.int8(0))
                    kept = np.frombuffer(text, np.uint8)[~own].tobytes() if removed else text
                    for c, x in zip(out, (None if doc == NULL_ID else doc, size, removed, int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        out[c].append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                cols = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols if with_kept else cols[:-1], list(out) if with_kept else list(out)[:-1])

    return both.mapInArrow(trimmed(run), OUT + ", kept binary" * with_kept)
