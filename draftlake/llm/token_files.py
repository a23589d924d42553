"""Token ids in flat binary files.

Documents go in ascending order of doc_id (nulls first, equal ids by text) to range partitions. Each partition writes
<part>.bin, the ids one after the other as little-endian unsigned integers of 16 or 32 bits, <part>.idx, one 64-bit
offset (in ids) for each document and one for the end, and <part>.doc, their 64-bit doc_ids. A manifest table names
the files of the tasks that ended well, with their counts; prefix sums over it give each partition's base. Readers map
the files into memory where the store is a local or mounted one.

A task writes to names of its own and the manifest is written when it ends, so a task that is run again leaves files
that nobody reads.

Encodings are the tokenizer's own. White space separates its words, so the worker keeps the ids of chunks between
white space, and of the words in chunks of Latin letters, in bounded dictionaries.

Defined cases: a null or empty text has the end id only; a null doc_id is read back as null; equal rows are each
written; other columns are left out; an empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.bpe import KEPT, SPACE
from draftlake.llm.common import new_path, prefix_sums, stored, utf8_size

CHUNK = re.compile(f"[^{SPACE}]+")
#: What str.split() takes for white space and Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: How the tokenizer of word_bpe_49k.json splits lower-cased text (a fixed value of that file).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_ID = -(1 << 63)


class WordTokenizer:
    def __init__(self, path: str, end_id: int):
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = self.pack([end_id])
        self.words_of = regex.compile(WORDS).findall
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.kind.itemsize, "little") for i in ids])

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        """Ids of single words, encoded many to a text: the last token of each word says that it ends there."""
        import numpy as np

        out, size = [], self.kind.itemsize
        parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * size
            if len(ends) == len(part):
                packed = ids.tobytes()
                out += [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += self._each(part)
        return out

    def _cut(self, chunk: str):
        """The words of a chunk of Latin letters and signs, lower-cased; None for others, whose normal form or lower case may depend on
        more than single characters, and where an added token can start."""
        if not (chunk.isascii() or (max(chunk) < "\u0250" and "\u0130" not in chunk)):
            return None
        if chunk.isalpha():
            return (chunk.lower(),)
        if chunk[:-1].isalpha():
            return (chunk[:-1].lower(), chunk[-1])
        return None if "<|" in chunk else self.words_of(chunk.lower())

    def _learn(self, new: list[str]) -> None:
        """Encodings of chunks, by way of their words where they can be cut. What the older half of a dictionary knows is taken from there."""
        plain, rest = {}, []
        older, chunks = self.older_chunks, self.chunks
        for c in new:
            if (known := older.get(c)) is not None:
                chunks[c] = known
            elif (cut := self._cut(c)) is None:
                rest.append(c)
            else:
                plain[c] = cut
        if len(self.words) > KEPT // 2:
            self.older_words, self.words = self.words, {}
        words, older, fresh = self.words, self.older_words, []
        for w in {w for ws in plain.values() for w in ws}:
            if w not in words:
                if (known := older.get(w)) is not None:
                    words[w] = known
                else:
                    fresh.append(w)
        words.update(zip(fresh, self._together(fresh), strict=True))
        for c, ws in plain.items():
            chunks[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        chunks.update(zip(rest, self._each(rest), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, packed."""
        split = [CHUNK.findall(t) if SEPARATORS.search(t) else t.split() for t in (x or "" for x in texts)]
        if len(self.chunks) > KEPT // 2:  # what is in use moves on from the older half
            self.older_chunks, self.chunks = self.chunks, {}
        new = set().union(*[set(s).difference(self.chunks) for s in split])
        if new:
            self._learn(list(new))
        get = self.chunks.__getitem__
        return [b"".join([*map(get, s), self.end]) for s in split]


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path, end_id)


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None, part_bytes: int = 64 << 20) -> tuple[DataFrame, str]:
    """(manifest: part, file, docs, tokens, bytes_per_id; path of the folder)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    size = docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, t = TaskContext.get().partitionId(), None
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{part:08d}-{uuid.uuid4().hex}"
        end, n, t = 0, 0, tokenizer(vocabulary, end_id)
        with store.open_output_stream(f"{folder}/{name}.bin") as ids, store.open_output_stream(f"{folder}/{name}.idx") as idx, store.open_output_stream(f"{folder}/{name}.doc") as doc:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    piece = batch.slice(i, 1000)
                    packed = t.encode(piece.column("text").to_pylist())
                    ends = end + np.cumsum([len(p) // t.kind.itemsize for p in packed])
                    ids.write(b"".join(packed))
                    idx.write(ends.astype("<i8").tobytes())
                    doc.write(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    end, n = int(ends[-1]), n + piece.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "docs": pa.array([n], pa.int64()), "tokens": pa.array([end], pa.int64()), "bytes_per_id": pa.array([t.kind.itemsize], pa.int32())})

    manifest = rows.mapInArrow(run, "part long, file string, docs long, tokens long, bytes_per_id int")
    return stored(manifest, "manifest"), path


def _mapped(store, path: str, kind: str):
    """The numbers in a file, mapped into memory if it is on a mounted store."""
    import numpy as np
    from pyarrow import fs

    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_tokens(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) and, if asked, ids."""
    based = prefix_sums(manifest, "part", "tokens").select("part", "file", "bytes_per_id", F.col("before").alias("base"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        store, folder = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['file']}"
                ids = _mapped(store, f"{name}.bin", f"<u{row['bytes_per_id']}")
                offsets, docs = _mapped(store, f"{name}.idx", "<i8"), _mapped(store, f"{name}.doc", "<i8")
                for i in range(0, len(docs), 1000):
                    ends = offsets[i : i + 1001]
                    wide = [ids[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    own = np.asarray(docs[i : i + 1000])
                    out = {"doc_id": pa.array(own, pa.int64(), mask=own == NO_ID), "start": pa.array(row["base"] + ends[:-1], pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([w.astype(np.int64) for w in wide], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return based.repartition("part").mapInArrow(run, schema)
