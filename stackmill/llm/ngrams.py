"""Words and word shingles of Arrow text batches as 64-bit hashes, in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters (UTF-8 bytes) of texts that are worked on at once; one text may be longer.
CHUNK_BYTES = 8 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, order kept."""
    with np.errstate(over="ignore"):
        h = left * _ODD[0] + right
        h = (h ^ (h >> np.uint64(30))) * _ODD[1]
        h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of_texts(texts: pa.Array, spaces: bytes, breaks: bytes = b"", seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words (runs of other bytes than spaces and breaks, A-Z lower-cased) of texts without nulls: where each text's words begin
    (one more than texts), and for each word the piece it is in (a number that changes at breaks and between texts) and its
    number in the dictionary; then the hash of each dictionary word, and the dictionary. Separators are ASCII."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    is_word = np.ones(256, bool)
    is_word[list(spaces + breaks)] = False
    word = is_word[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    within = np.searchsorted(starts, offsets)
    compact = _LOWER[data[word]]
    at = np.r_[np.cumsum(word, dtype=np.int32)[starts] - 1, len(compact)].astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(compact)]).dictionary_encode()
    piece = np.repeat(np.arange(len(texts)), np.diff(within))
    if breaks:
        is_break = np.zeros(256, bool)
        is_break[list(breaks)] = True
        piece = piece + np.cumsum(is_break[data], dtype=np.int32)[starts]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return within, piece, coded.indices.to_numpy(), hashes, coded.dictionary


def chunks(batches: Iterable[pa.RecordBatch], text: int, at_once: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (in that column) have about at_once bytes, so that memory does not grow with them."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + at_once, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
