"""Sets of word shingles as 64-bit hashes, computed for many texts at a time with numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case; a text's set holds its distinct
runs of k words, the whole sequence where there are fewer, nothing where there is no word.  A word's hash takes in eight bytes
at a time through a mixing step that is not linear, longer words go to xxh3; so does a shingle's with its words.  Hashes of two
different shingles agree with probability 2**-64: for two texts of a million words each, 2**-24 for any pair among them.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one.
_LONG = 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], "<u8")


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word."""
    n = stops - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(n.astype("<u8"), 5)
    at = np.flatnonzero(n <= _LONG)
    for i in range(0, _LONG, 8):
        at = at[n[at] > i]
        out[at] = mix(out[at] ^ (eight[starts[at] + i] & _MASK[np.minimum(n[at] - i, 8)]), 40 + i)
    for j in np.flatnonzero(n > _LONG).tolist():
        out[j] = xxhash.xxh3_64_intdigest(data[starts[j] : stops[j]].tobytes())
    return out


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie one after another (``ends``: where each ends), and words up to each end."""
    edge = np.zeros(len(data) + 2, bool)
    edge[1:-1] = ~SPACE[data]
    solid = edge[1:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(solid & (~edge[:-2] | cut[:-1]))
    stops = np.flatnonzero(solid & (~edge[2:] | cut[1:])) + 1
    return hash_words(data, starts, stops), np.searchsorted(starts, ends)


def shingle_sets(texts, k: int):
    """For each text (bytes or None) the sorted distinct hashes of its set."""
    held, size = [], 0
    for text in texts:
        held.append((text or b"").lower())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from _sets(held, k)
            held, size = [], 0
    yield from _sets(held, k)


def _sets(texts: list[bytes], k: int):
    ends = np.cumsum([len(t) for t in texts], dtype="int64") if texts else np.zeros(0, "int64")
    words, upto = word_hashes(np.frombuffer(b"".join(texts), np.uint8), ends)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(words) - k + 1), "<u8")
        for i in range(k):
            runs = mix(runs + words[i : i + len(runs)], i)
        at = 0
        for end in upto.tolist():
            n = end - at
            if n >= k:
                own = np.sort(runs[at : end - k + 1])
                if n > k:
                    fresh = np.empty(len(own), bool)
                    fresh[0] = True
                    np.not_equal(own[1:], own[:-1], out=fresh[1:])
                    own = own[fresh]
                yield own
            elif n:
                one = np.zeros(1, "<u8")
                for i in range(at, end):
                    one = mix(one + words[i], i - at)
                yield mix(one, n + 1000)
            else:
                yield np.zeros(0, "<u8")
            at = end
