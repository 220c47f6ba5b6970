"""Byte-level BPE: exact token ids of whole texts in linear time, and back.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds, in one pass over a
piece, the longest token that starts at each byte. A sequence of tokens is what merging by rank makes of its bytes
exactly if every two neighbours are what merging makes of theirs. So the encoder goes from longest match to longest
match, takes a shorter token where two neighbours do not fit, and steps back where none is left; a place it stepped back
from is never entered again. Whether two tokens fit is found by merging their few bytes, and kept.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches

#: Bytes of a vocabulary file up to which it is broadcast; files of public tokenizers have 1 to 4 MB.
VOCABULARY_BYTES = 64 << 20
#: Pieces and pairs of tokens that a worker keeps in mind, and the longest piece that it keeps.
MEMO, MEMO_CHARS = 300_000, 64
#: Characters of a text that are split at once.
CHUNK_CHARS = 1 << 20

_BREAK = regex.compile(r"(?<=\S)(?=\s)")


class _Lazy(dict):
    """Token -> what a function says of it, asked once."""

    def __init__(self, function: Callable[[int], int | None]):
        super().__init__()
        self._function = function

    def __missing__(self, token: int) -> int | None:
        self[token] = found = self._function(token)
        return found


class _Pieces(dict):
    """Piece -> its ids as int32 bytes, filled when asked. When it is full, what it holds is set aside, and what is asked
    for again comes back from there."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self._encode, self._aside = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._aside.get(piece)
        if ids is None:
            ids = array("i", self._encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self._aside = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoding:
    """A vocabulary ``ranks`` (bytes -> id, lower ids merge first) and the pattern that cuts texts into pieces.

    Every single byte must be a token. Tokens that merging never makes are given only for a piece equal to them.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for {len(missing)} single bytes")
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self._split = regex.compile(pattern)
        self._size = {i: len(token) for token, i in ranks.items()}
        self._starts_with, self._shorter = _Lazy(self._longest_made), _Lazy(self.shorter)
        self._fit: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self.encode_piece)
        self._automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), i)
        self._automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank, lowest and leftmost first; quadratic, for a few bytes."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        rank, none = self.ranks.get, len(self.ranks) << 32
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        known = self._fit.get((a, b))
        if known is None:
            known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self._fit) >= MEMO:
                self._fit.clear()
            self._fit[a, b] = known
        return known

    def made(self, token: int) -> bool:
        """Whether merging makes this token of its own bytes."""
        return self.merged(self.bytes_of[token]) == [token]

    def _longest_made(self, token: int) -> int | None:
        """This token if merging makes it, else the longest beginning of it that merging makes."""
        while token is not None and not self.made(token):
            token = self._head(token)
        return token

    def _head(self, token: int) -> int | None:
        own = self.bytes_of[token]
        heads = (own[:k] for k in range(len(own) - 1, 0, -1))
        return next((self.ranks[h] for h in heads if h in self.ranks), None)

    def shorter(self, token: int) -> int | None:
        """The longest other token that this one begins with and that merging makes."""
        head = self._head(token)
        return None if head is None else self._longest_made(head)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        size, size_of, starts_with, shorter, fit = len(piece), self._size, self._starts_with, self._shorter, self._fit
        longest: list[int | None] = [None] * (size + 1)
        for end, token in self._automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size_of[token]] = token  # ends ascend, so the longest comes last
        out: list[int] = []
        left = bytearray(size + 1)  # places stepped back from
        at, token, before = 0, starts_with[longest[0]], None
        while at < size:
            while token is not None:
                end = at + size_of[token]
                if not left[end]:
                    fits = before is None or fit.get((before, token))
                    if fits is None:
                        fits = self.fits(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                left[at] = 1
                token = out.pop()
                at -= size_of[token]
                before = out[-1] if out else None
            else:
                out.append(token)
                at, before = end, token
                token = starts_with[longest[at]] if at < size else None
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Long texts are split in parts that end between a word and white space, where no piece runs on."""
        parts, start = [], 0
        while start < len(text):
            cut = _BREAK.search(text, start + CHUNK_CHARS) if len(text) - start > CHUNK_CHARS else None
            end = cut.start() if cut else len(text)
            parts.append(b"".join(map(self._pieces.__getitem__, self._split.findall(text, start, end))))
            start = end
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[int] | None) -> bytes | None:
        """The bytes of the tokens; None for None, or if an id is null or not in the vocabulary."""
        if ids is None:
            return None
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            return None


_loaded: dict[str, BytePairEncoding] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A file of ranks: in each line a token in base 64 and its id."""
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in data.splitlines() if line.strip())}


def _lists(lists: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of an Arrow array; much faster than asking for each by itself where no id is null."""
    if lists.values.null_count:
        yield from lists.to_pylist()
        return
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    for start, end, there in zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False):
        yield values[start:end].tolist() if there else None


class Tokenizer:
    """Column functions of a vocabulary file; the file (its size is checked) is broadcast and loaded once in a worker."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        """``path`` is read by the driver."""
        with open(path, "rb") as file:
            data = file.read(VOCABULARY_BYTES + 1)
        if len(data) > VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
        bounded_batches(spark)
        self._sent = spark.sparkContext.broadcast(data)
        self._pattern = pattern
        self._key = hashlib.sha256(data + pattern.encode()).hexdigest()

    def _loader(self) -> Callable[[], BytePairEncoding]:
        sent, pattern, key = self._sent, self._pattern, self._key

        def load() -> BytePairEncoding:
            if key not in _loaded:
                _loaded.clear()
                _loaded[key] = BytePairEncoding(parse_ranks(sent.value), pattern)
            return _loaded[key]

        return load

    def encode(self, text: Column) -> Column:
        """Token ids of each whole text, ``array<int>``; a null text has none, and bytes that are no UTF-8 are U+FFFD.

        Texts of any length, empty ones (no ids) and repeated rows are encoded each for itself.
        """
        load = self._loader()

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            coding = load()
            for texts in batches:
                ids = [coding.encode((t.as_py() or b"").decode("utf-8", "replace")) for t in texts]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

        return run(text.cast("binary"))

    def decode(self, ids: Column) -> Column:
        """The bytes of each list of ids; null for a null list or one with an id that is null or not in the vocabulary."""
        load = self._loader()

        @F.arrow_udf("binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            coding = load()
            for lists in batches:
                yield pa.array(list(map(coding.decode, _lists(lists))), pa.binary())

        return run(ids)
