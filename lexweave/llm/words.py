"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. All
functions work on whole texts; long ones are hashed in slices cut between
words, so memory does not follow the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\x0b\x0c\r"
_SLICE = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
_BYTE[IS_SEP] = 0
#: Letters and digits of ASCII and all other characters make terms; A to Z count as a to z.
TERM_SEP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TERM_BYTE = mix(np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], _U) * _U(0x2545F4914F6CDD1D))
_TERM_BYTE[TERM_SEP] = 0
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < size:
        for name, base in (("p", _P), ("i", _P_INV)):
            x = np.full(size, _U(base))
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def doc_slices(offs: np.ndarray, limit: int = 2 << 20):
    """Ranges (i, j) of documents of about ``limit`` bytes together; a longer one stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def hash_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``hash_words`` for terms: runs of letters, digits and characters beyond ASCII, in lower case within ASCII."""
    return hash_words(data, offs, TERM_SEP, _TERM_BYTE)


def hash_words(data: np.ndarray, offs: np.ndarray, is_sep: np.ndarray = IS_SEP, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and each document's first word (one more entry at the end)."""
    n = len(data)
    sep = is_sep[data]
    head = np.empty(n, bool)
    if n:
        head[0] = True
        head[1:] = sep[:-1]
        inner = offs[(offs > 0) & (offs < n)]
        head[inner] = True
        tail = np.empty(n, bool)
        tail[-1] = True
        tail[:-1] = sep[1:]
        tail[inner - 1] = True
        starts = np.flatnonzero(head & ~sep)
        ends = np.flatnonzero(tail & ~sep) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    out = np.empty(len(starts), _U)
    w = 0
    while w < len(starts):
        base = starts[w]
        z = max(w + 1, int(np.searchsorted(starts, base + _SLICE, "left")))
        stop = int(starts[z]) if z < len(starts) else n
        p, inv = _table(max(_SLICE + 1, stop - int(base)))
        part = values[data[base:stop]]
        part *= p[: stop - base]
        at = starts[w:z] - base
        out[w:z] = mix(np.add.reduceat(part, at) * inv[at])
        w = z
    return out, starts, ends, np.searchsorted(starts, offs)


def hash_windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; runs over a document's end included (see ``whole``)."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, _U)
    h = np.full(m, _U(0x9AE16A3B2F90404F + 2 * seed))
    k = _U(0xC2B2AE3D27D4EB4F + 2 * seed)
    for i in range(size):
        h ^= words[i : i + m]
        h *= k
        h ^= h >> _U(31)
    return mix(h)


def whole(first: np.ndarray, size: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``m`` windows lie in one document, and the document of each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:m]
    return np.arange(m) + size <= first[1:][doc], doc


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[offs[1:]] - c[offs[:-1]]
