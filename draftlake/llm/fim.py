"""Fill-in-middle transformation with a sparse exception index.

Texts are cut as UTF-8 bytes, and lengths are told in code points. Most bytes are ASCII, where both agree, so that only the exceptions are
recorded: the positions of multibyte characters and the bytes that each has in excess of one. A binary search among these turns a cut in
bytes into code points and back; between exceptions it is plain arithmetic, and a text of ASCII has no index at all. Nothing is shuffled: a
row's cuts follow from its doc_id alone, so that a task that runs again gives the same rows.

Cuts fall between units: lines (each with its line feed) or single characters. The smaller cut ends the prefix, the larger the middle.

Defined cases: a null or empty text has no units and stays as it is (plain), as does a text that holds a marker; a text of one unit may have an
empty prefix, middle or suffix; a very long text is cut whole, its index as long as its multibyte characters; a null doc_id counts as no
digits; equal rows, and rows of one doc_id and equally many units, are cut alike; an empty table gives no rows; clashing columns of the
input become input_<name>.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from draftlake.llm.common import apart

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
NEW = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
DIGESTS = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]


class Exceptions:
    """Multibyte characters of UTF-8 bytes: where they start, and how many bytes beyond one they and those before them have."""

    def __init__(self, raw: bytes):
        values = np.frombuffer(b"" if raw.isascii() else raw, np.uint8)
        self.at = np.flatnonzero(values >= 0xC0)
        lead = values[self.at]
        self.excess = np.r_[0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))]
        self.at_char = self.at - self.excess[:-1]

    def to_chars(self, cut: int) -> int:
        """Code points before a cut in bytes."""
        return cut - int(self.excess[np.searchsorted(self.at, cut)])

    def to_bytes(self, cut: int) -> int:
        """Bytes before a cut in code points."""
        return cut + int(self.excess[np.searchsorted(self.at_char, cut)])


class Units:
    """The units of a text: how many there are, and the byte at which each ends."""

    def __init__(self, raw: bytes, unit: str, exceptions: Exceptions):
        if unit not in ("line", "char"):
            raise ValueError(f"unit {unit!r} is neither line nor char")
        self.exceptions, self.ends = exceptions, None
        if unit == "line":
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
            self.ends = ends if not raw or raw.endswith(b"\n") else np.r_[ends, len(raw)]
            self.n = len(self.ends)
        else:
            self.n = exceptions.to_chars(len(raw))

    def cut(self, k: int) -> int:
        """The byte after the first k units."""
        if self.ends is None:
            return self.exceptions.to_bytes(k)
        return int(self.ends[k - 1]) if k else 0


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(raw: bytes, doc_id: int | None, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7):
    """(units, form, code points of the prefix and of the middle, output) of a text."""
    exceptions = Exceptions(raw)
    units = Units(raw, unit, exceptions)
    first, second, chosen, kind = draws(doc_id, seed)
    if not raw or chosen % 100 >= percent or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, raw
    low, high = sorted(units.cut(x % (units.n + 1)) for x in (first, second))
    prefix, middle, suffix = raw[:low], raw[low:high], raw[high:]
    before = exceptions.to_chars(low)
    sizes = before, exceptions.to_chars(high) - before
    if kind % 100 < spm_percent:
        return units.n, "spm", *sizes, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units.n, "psm", *sizes, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that gave the output."""
    if form == "plain":
        return output
    head, last = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + last + suffix


def fill_in_middle(docs: DataFrame, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7, digests: bool = False) -> DataFrame:
    """docs with n, form, prefix_chars and middle_chars, and with the output as their text; with `digests` instead of any text those of the
    output and of what `restore` makes of it."""
    docs = apart(docs, [f.name for f in NEW + DIGESTS])
    kept = [f for f in docs.schema.fields if f.name != "text" or not digests]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, n, form, before, inside, texts, made, back = whole.slice(at, 500), [], [], [], [], [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                    raw = text.as_py()
                    count, kind, prefix, middle, output = transform(raw or b"", doc_id, unit, percent, spm_percent, seed)
                    for column, value in zip((n, form, before, inside), (count, kind, prefix, middle), strict=True):
                        column.append(value)
                    if digests:
                        made.append(hashlib.sha256(output).hexdigest())
                        back.append(hashlib.sha256(restore(output, kind)).hexdigest())
                    else:
                        texts.append(None if raw is None else output)
                arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if f.name == "text" else batch.column(f.name) for f in kept]
                arrays += [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64())]
                arrays += [pa.array(made, pa.string()), pa.array(back, pa.string())] if digests else []
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept + NEW + (DIGESTS if digests else [])])

    return docs.mapInArrow(run, T.StructType(kept + NEW + (DIGESTS if digests else [])))
