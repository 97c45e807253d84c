"""Byte-level BPE over a file of ranks: texts to ids and back, in time linear in a piece.

A text is cut by a pattern; each piece is encoded by itself. The ids that the
merges give for a piece are the only sequence of tokens covering it in which
every two neighbours are *compatible*: their own merges would not have joined
anything across the border between them. So no merge is simulated. An
Aho-Corasick automaton (pyahocorasick, bytes as Latin-1 letters) holds all
tokens backwards and tells the longest token that starts at each byte; tokens
are put down from the left, longest first, the next shorter one where a token
does not fit its predecessor, and one step is taken back where none fits. The
sequence before a byte is the same whenever that byte is reached, so a byte
from which nothing went on is never tried again. Compatibility of two tokens
follows from how each was merged and is remembered.

Every worker that encodes learns the tables from the file once; pieces met before come from
a cache of two generations.
"""

from __future__ import annotations

import base64
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches

_WORDS = 400_000  # of a generation of the cache
_KEPT = 256  # characters of the longest word that is kept
_SHORT = 64  # bytes of the longest piece that is encoded beside others
_MEMO = 1 << 21  # pairs of tokens remembered
_LONG = 1 << 20
_SOME = 1 << 18
_ODD = re.compile(r" (?:\s|$)")
_codecs: dict[tuple[str, str], "Codec"] = {}
_tokens: dict[str, "Tokens"] = {}

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=False))])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tokens:
    """The bytes of ids: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {k: t for t, k in ranks.items()}
        self.n = max(self.tokens) + 1
        self.blob = np.frombuffer(b"".join(self.tokens.get(k, b"") for k in range(self.n)), np.uint8)
        self.ends = np.cumsum([len(self.tokens.get(k, b"")) for k in range(self.n)])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of lists of ids (``offs``: where each begins, and the end). An id that is no token is an error."""
        ids = ids.astype(np.int64, copy=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n or (np.diff(self.ends, prepend=0)[np.unique(ids)] == 0).any()):
            raise ValueError("there is an id that is no token")
        sizes = np.diff(self.ends, prepend=0)[ids]
        to = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(to[-1]), np.uint8)
        for i in range(0, len(ids), _SOME):
            j = min(i + _SOME, len(ids))
            lead = np.repeat(self.ends[ids[i:j]] - to[i + 1 : j + 1], sizes[i:j])
            out[to[i] : to[j]] = self.blob[lead + np.arange(to[i], to[j])]
        return out, to[offs]


class Codec(Tokens):
    """``ranks``: every single byte among them. ``pattern``: a regular expression (``regex`` syntax) whose matches are the pieces.

    With the public pattern a piece always begins at a space before a character
    that is no white space, whatever stands before it; so texts are cut there
    first and each distinct word is taken to pieces once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import public_tokenizers
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        super().__init__(ranks)
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cuts = regex.compile(r" (?=\S)") if pattern == public_tokenizers.PATTERN else None
        self.parts: dict[int, tuple[int, int]] = {}  # the merge that makes a token; single bytes have none
        self.made: set[int] = set()  # tokens that merges can make
        self.pairs: dict[int, bool] = {}
        for token, k in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._take_apart(token, k):
                self.made.add(k)
        self.size = np.zeros(self.n, np.int64)
        self.shorter = np.full(self.n, -1, np.int64)  # the longest token that begins a token
        self.byte = np.append(np.array([ranks[bytes([b])] for b in range(256)], np.int64), -1)
        self.starts = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in self.made:
            token = self.tokens[k]
            self.size[k] = len(token)
            self.shorter[k] = next((x for i in range(len(token) - 1, 0, -1) if (x := ranks.get(token[:i], -1)) in self.made), -1)
            if len(token) > 1:
                self.starts.add_word(token[::-1].decode("latin-1"), k)
        self.starts.make_automaton()
        self.memo_key = np.full(_MEMO, -1, np.int64)
        self.memo = np.zeros(_MEMO, bool)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _take_apart(self, token: bytes, k: int) -> bool:
        """Finds the two tokens of lower rank that ``k`` is merged from: the compatible ones but for ``k`` itself."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:cut], k), self.ranks.get(token[cut:], k)
            if a < k and b < k and a in self.made and b in self.made and self._compatible(a, b, k):
                self.parts[k] = (a, b)
                return True
        return False

    def _compatible(self, a: int, b: int, later: int = 1 << 62) -> bool:
        """Whether the merges of a rank below ``later`` leave ``a`` before ``b`` as they are.

        Goes back through both tokens' merges, the latest first; ``later`` is
        the rank of the merge that came next after the present state, which a
        merge across the border must not precede.
        """
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        while True:
            if ranks.get(tokens[a] + tokens[b], later) < later:
                return False
            if a in parts and (a > b or b not in parts):
                later, a = a, parts[a][1]
            elif b in parts:
                # of equal merges the left one comes first
                later, b = b + 1, parts[b][0]
            else:
                return True

    def _longest(self, text: np.ndarray) -> np.ndarray:
        """The longest token that starts at each byte of a text; 256 in the text separates pieces (-1 there)."""
        out, n = self.byte[text], len(text)
        found, seen = self.starts.iter(text[::-1].tobytes().decode("utf-16-le")), -1
        while True:
            flat = np.fromiter(chain.from_iterable(islice(found, _SOME)), np.int64)
            if not len(flat):
                return out
            ends, ks = flat[::2], flat[1::2]
            first = np.empty(len(ends), bool)  # of the tokens that end at one character the longest is told first
            first[0] = ends[0] != seen
            np.not_equal(ends[1:], ends[:-1], out=first[1:])
            out[n - 1 - ends[first]] = ks[first]
            seen = ends[-1]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Compatibility of pairs, remembered in a table of fixed size."""
        key = a * self.n + b
        slot = (key * 0x9E3779B1 >> 7) & (_MEMO - 1)
        missing = self.memo_key[slot] != key
        fit = self.memo[slot]
        if missing.any():
            new, back = np.unique(key[missing], return_inverse=True)
            known = np.array([self._compatible(*divmod(k, self.n)) for k in new.tolist()], bool)
            fit[missing] = known[back]
            at = (new * 0x9E3779B1 >> 7) & (_MEMO - 1)
            at, one = np.unique(at, return_index=True)
            self.memo_key[at], self.memo[at] = new[one], known[one]
        return fit

    def _side_by_side(self, longest: np.ndarray, at: np.ndarray, to: np.ndarray, ending: np.ndarray) -> None:
        """Encodes the pieces from ``at`` to ``to``, a step of all at once. ``ending`` gets the token that ends before a byte."""
        stuck = np.zeros(len(ending), bool)
        token = longest[at]
        while len(at):
            back = np.flatnonzero(token < 0)
            if len(back):
                stuck[at[back]] = True
                gone = ending[at[back]]
                ending[at[back]] = -1
                at[back] -= self.size[gone]
                token[back] = self.shorter[gone]
            before, end = ending[at], at + self.size[token]
            fine = (token >= 0) & ~stuck[np.where(token < 0, at, end)]
            ask = np.flatnonzero(fine & (before >= 0))
            if len(ask):
                fine[ask] = self._fit(before[ask], token[ask])
            go = np.flatnonzero(fine)
            ending[end[go]] = token[go]
            token = np.where(token < 0, -1, self.shorter[token])
            at[go] = end[go]
            going = at < to
            token[go] = longest[np.minimum(at[go], len(longest) - 1)]
            at, to, token = at[going], to[going], token[going]

    def _by_itself(self, longest: np.ndarray, at: int, to: int, ending: np.ndarray) -> None:
        """The same for one long piece, a token at a time."""
        size, shorter, pairs = self.size, self.shorter, self.pairs
        out: list[int] = []
        first, stuck, token = at, bytearray(to - at + 1), int(longest[at])
        while at < to:
            while token >= 0:
                end = at + int(size[token])
                if not stuck[end - first]:
                    if not out:
                        break
                    pair = out[-1] * self.n + token
                    fit = pairs.get(pair)
                    if fit is None:
                        if len(pairs) >= _MEMO:
                            pairs.clear()
                        fit = pairs[pair] = self._compatible(out[-1], token)
                    if fit:
                        break
                token = int(shorter[token])
            if token >= 0:
                out.append(token)
                at = end
                token = int(longest[at]) if at < to else -1
            else:
                stuck[at - first] = 1
                token = out.pop()
                at -= int(size[token])
                token = int(shorter[token])
        ending[first + np.cumsum(size[out])] = out

    def _flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many there are up to the end of each piece."""
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        stops = chars[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        text = np.insert(raw.astype("<u2"), stops[:-1], 256)
        to = stops + np.arange(len(pieces))
        at = np.append(0, to[:-1] + 1)
        ending = np.full(len(text) + 1, -1, np.int64)
        longest = self._longest(text)
        apart = to - at > _SHORT
        if len(self.made) < len(self.ranks):  # a piece that is a token is that token, also if no merges make it
            for i, p in enumerate(pieces):
                k = self.ranks.get(p.encode(), -1)
                if k >= 0 and k not in self.made:
                    ending[to[i]], apart[i] = k, True
        for i in np.flatnonzero(apart & (ending[to] < 0)).tolist():
            self._by_itself(longest, int(at[i]), int(to[i]), ending)
        self._side_by_side(longest, at[~apart], to[~apart], ending)
        placed = np.flatnonzero(ending >= 0)
        return ending[placed].astype("<u4"), np.searchsorted(placed, to, "right")

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without the words' cache."""
        out, some, size = [], [], 0

        def flush():
            nonlocal size
            if some:
                split = [self.pattern.findall(t) for t in some]
                pieces = [p for s in split for p in s]
                ids, ends = self._flat(pieces) if pieces else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
                cuts = np.append(0, ends)[np.cumsum([0, *map(len, split)])].tolist()
                out.extend(ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:]))
                some.clear()
                size = 0

        for t in texts:
            if len(t) > _LONG:
                flush()
                found, parts = self.pattern.finditer(t), []
                while pieces := [m.group() for m in islice(found, _SOME)]:
                    parts.append(self._flat(pieces)[0].tobytes())
                out.append(b"".join(parts))
            else:
                some.append(t)
                size += len(t)
                if size > _LONG:
                    flush()
        flush()
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """After it ``young`` has all ``words`` (each stands for itself after a space) but the long ones, which are returned. Words not asked for during a generation are forgotten."""
        if len(self.young) > _WORDS:
            self.old, self.young = self.young, {}
        young, old, long = self.young, self.old, {}
        missing = [w for w in words if w not in young]
        young.update((w, old[w]) for w in missing if w in old)
        new = []
        for w in missing:
            if w not in young:
                if len(w) <= _KEPT:
                    new.append(w)
                else:
                    long[w] = self._encode_whole([" " + w])[0]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            pieces = self.pattern.findall(" " + " ".join(part))
            ids, ends = self._flat(pieces)
            chars = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            last = np.searchsorted(chars, np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1))
            cuts, raw = (4 * np.append(0, ends[last])).tolist(), ids.tobytes()
            young.update((w, raw[i:j]) for w, i, j in zip(part, cuts[:-1], cuts[1:]))
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, none of a null one."""
        texts = [t or "" for t in texts]
        if self.cuts is None:
            return self._encode_whole(texts)
        split = [self.cuts.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        words = set().union(*(s[1:] for s in split))
        long, get = self._learn(words), self.young.__getitem__
        if long:
            get = lambda w: long[w] if w in long else self.young[w]
        heads = self._encode_whole([s[0] for s in split])
        return [head + b"".join(map(get, s[1:])) for head, s in zip(heads, split)]


def codec(path: str, pattern: str) -> Codec:
    """One for each file, pattern and Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def tokens(path: str) -> Tokens:
    """One for each file and Python worker; a codec of the file serves as well."""
    held = next((c for (p, _), c in _codecs.items() if p == path), None) or _tokens.get(path)
    if held is None:
        held = _tokens[path] = Tokens(read_ranks(path))
    return held


def _public(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _encoding(path: str, pattern: str):
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                ids = own.encode(some.column(1).to_pylist())
                offs = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offs), flat, type=kind)], ENCODED.names)

    return run


def _decoding(path: str):
    def run(batches):
        own = tokens(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                lists = some.column(1)
                offs = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))))
                out, cuts = own.decode(lists.flatten().to_numpy(zero_copy_only=False), offs)
                valid = pa.py_buffer(np.packbits(np.asarray(lists.is_valid()), bitorder="little").tobytes()) if lists.null_count else None
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [valid, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([some.column(0), lists, column.cast(pa.binary())], DECODED.names)

    return run


def _digesting(batches):
    from hashlib import sha256

    for b in batches:
        sizes = np.asarray(b.column(1).value_lengths().fill_null(0), np.int64)
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        ids = [sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(cuts[:-1], cuts[1:])]
        decoded = [x if x is None else sha256(x).hexdigest() for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Null and empty texts have no ids (an empty list). Rows of equal or null
    ``doc_id`` are encoded each by itself; an empty table gives no rows. A
    piece may be as long as its text.
    """
    return _texts(docs).mapInArrow(_encoding(*_public(path, pattern)), ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary) to ``doc_id, ids``: the bytes of the ids, empty without ids, null for a null list. A text's bytes come back as they were."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(_public(path, None)[0]), DECODED)


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``decode``."""
    return decoded.select("doc_id", "ids", "decoded").mapInArrow(_digesting, _DIGESTS)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``digest(decode(encode(docs)))`` in one Python worker a task: three would each come to hold the codec and its words."""
    path, pattern = _public(path, pattern)
    encoding, decoding = _encoding(path, pattern), _decoding(path)
    return _texts(docs).mapInArrow(lambda batches: _digesting(decoding(encoding(batches))), _DIGESTS)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
