"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; seeds give different hash functions."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and the number of words of each. Words are runs
    of other than ASCII white space; A-Z are lower-cased if ``fold``. Every distinct word is hashed once a call."""
    import xxhash

    # Copied first: casting a slice leaves offsets that do not start at 0, which ascii_lower misreads.
    flat = pa.concat_arrays([texts]).cast(pa.large_string()).fill_null("")
    if fold:
        flat = pc.ascii_lower(flat)
    parts = pc.ascii_split_whitespace(flat)
    values, ends = parts.flatten(), np.diff(parts.offsets.to_numpy())
    coded = values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter((w != "" for w in names), bool, len(names))[codes] if len(names) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(texts)), ends)[real]
    return hashes[codes[real]] if len(names) else np.zeros(0, np.uint64), np.bincount(doc, minlength=len(texts)).astype(np.int64)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each text, sorted, one text after the other, and their number. A text of
    fewer words has one shingle, the whole sequence; without words it has none."""
    words, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    left = np.repeat(first + n, n) - np.arange(len(words))  # words from here to the end of the text
    starts = (left >= k) | (np.arange(len(words)) == first[doc])
    at = np.flatnonzero(starts)
    size = np.minimum(left[at], k)
    h = mix(size.astype(np.uint64), 1)
    for i in range(k):
        on = size > i
        h[on] = mix(h[on] ^ words[at[on] + i], 2 + i)
    of = doc[at]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(n)).astype(np.int64)
