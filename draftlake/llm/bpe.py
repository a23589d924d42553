"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of its encoding. It is found from shorter
prefixes: a token that ends the prefix is the last one if the last token of what stands before it and the token itself
stay two tokens when they are encoded together. Tokens are then read back from the end. Appending bytes only adds
prefixes; after an edit, prefixes are computed again from the edit on until they agree with the old ones over more
bytes than the longest token has.

Texts are split by the pattern of the vocabulary. Encodings of pieces, and of chunks without inner white space, are
kept in bounded dictionaries of the worker.

Defined cases: a null text is an empty one and has no tokens; texts of any length are encoded whole; equal rows give
equal rows; clashing columns of the input become input_<name>.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from draftlake.llm.common import apart
from draftlake.llm.mpegts import _slices

#: Unicode's White_Space, as character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
KEPT = 800_000  # entries of a dictionary


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """A dictionary that computes what it lacks and starts anew when it is full."""

    def __init__(self, compute, limit: int = KEPT):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.pairs = Kept(self._stays, 2_000_000)  # by first << 32 | second
        self.singles = Kept(lambda t: self.merge(self.tokens[t]) == [t])
        self.pieces = Kept(self._piece)
        self.chunks = Kept(lambda chunk: b"".join([self.pieces[p] for p in self.split(chunk)]))

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the adjacent parts of lowest rank until no two can be joined. For single tokens and pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stays(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else PrefixEncoding(self, data).ids()
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text or "")))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoding:
    """The last token of every prefix of some bytes (one piece: the pattern is not applied)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(data[start:end])
            if token is not None and (v.pairs[last[start] << 32 | token] if start else v.singles[token]):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many prefixes were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        tail = start + len(new)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))
            same = same + 1 if end > tail and self.last[end] == old[end - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs without `text`, with n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again), round_trip and, if asked, token_ids."""
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    new += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids
    docs = apart(docs, [f.name for f in new])
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        v = vocabulary(path, pattern)
        for batch in batches:
            for part in _slices(pa.Table.from_batches([batch]), "text"):
                counts, digests, decoded, same, packed = [], [], [], [], []
                for text in part["text"].to_pylist():
                    ids = v.encode(text)
                    back = v.decode(np.frombuffer(ids, dtype="<u4").tolist())
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    same.append(back == (text or "").encode())
                    if with_ids:
                        packed.append(ids)
                out = part.select(names)
                for name, values, kind in (("n_tokens", counts, pa.int64()), ("ids_sha256", digests, pa.string()), ("decoded_sha256", decoded, pa.string()), ("round_trip", same, pa.bool_())):
                    out = out.append_column(name, pa.array(values, kind))
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                    out = out.append_column("token_ids", pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype("int32")), flat))
                yield from out.to_batches()

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in names], *new]))
