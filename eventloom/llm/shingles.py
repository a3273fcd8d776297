"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy.

Words are the runs of bytes other than the space characters, with A-Z in lower
case; a shingle is ``k`` words in a row; a text with fewer words is one shingle.
"""

from __future__ import annotations

import numpy as np

K = 5
CHUNK_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters near values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in ``data`` (bytes)."""
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    at = np.flatnonzero(letter)
    if not len(at):
        return at, np.empty(0, np.uint64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _STEP)]).astype(np.uint64))
        words = np.add.reduceat(_BYTE[data[at]] * powers[place], heads)
    return at[heads], mix(words)


def _chunk(raws: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    starts, words = _word_hashes(data)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    out = []
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k if len(grams) else 0):
            grams += words[j : j + len(grams)] * _PLACE[j]
        grams = mix(grams)
        for i in range(len(raws)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for j in range(b - a):
                    whole = whole + words[a + j] * _PLACE[32 + j]
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; none for null or blank."""
    out: list[np.ndarray] = []
    raws: list[bytes] = []
    held = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
        raws.append(raw)
        held += len(raw)
        if held >= CHUNK_BYTES:
            out += _chunk(raws, k)
            raws, held = [], 0
    return out + _chunk(raws, k) if raws else out


def set_identity(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
