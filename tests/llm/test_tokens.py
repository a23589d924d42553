import hashlib
import random
import zlib
from array import array

import pytest

from draftlake.llm import bpe, token_files
from draftlake.llm.queries import op6_prefix_bpe, op8_token_files


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.vocabulary(bpe.vocabulary_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_prefix_encoding(vocabulary, library):
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"aeinrst-=ab\xc3\xa9\x00") for _ in range(rng.randrange(1, 60)))
        want = library._encode_single_piece(data)
        whole = bpe.PrefixEncoding(vocabulary, data)
        if data not in vocabulary.ranks:
            assert whole.ids() == want
        cut = rng.randrange(len(data) + 1)
        grown = bpe.PrefixEncoding(vocabulary, data[:cut])
        grown.append(data[cut:])
        assert grown.last == whole.last
        a, b = sorted((rng.randrange(len(data) + 1), rng.randrange(len(data) + 1)))
        new = bytes(rng.choice(b"xyz e") for _ in range(rng.randrange(5)))
        grown.edit(a, b, new)
        assert grown.data == data[:a] + new + data[b:] and grown.last == bpe.PrefixEncoding(vocabulary, grown.data).last
    long = bpe.PrefixEncoding(vocabulary, b"internationalisation" * 400)
    fresh = bpe.PrefixEncoding(vocabulary, long.data[:1000] + b"X" + long.data[1001:])
    assert long.edit(1000, 1001, b"X") < 2000 and long.last == fresh.last
    assert bpe.PrefixEncoding(vocabulary).ids() == []


def test_chunks_split_like_the_pattern(vocabulary, library):
    rng = random.Random(2)
    alphabet = "ab1 \n\t\r  \x1c\x85'sé東.!  "
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert list(array("I", vocabulary.encode(text))) == library.encode_ordinary(text), repr(text)


def test_bpe_of_all_texts(spark, wide, none, rows, library, tmp_path):
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_prefix_bpe(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    out = bpe.encode(wide)
    assert "input_n_tokens" in out.columns and "input_token_ids" in out.columns
    assert all(r.round_trip and len(r.token_ids) == r.n_tokens for r in out.select("round_trip", "token_ids", "n_tokens").collect())
    assert bpe.encode(none).count() == 0


def test_token_files(spark, docs, wide, none, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_token_files(spark, str(tmp_path)).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    manifest, path = token_files.write_tokens(docs, bpe.vocabulary_path("word_bpe_49k.json"), part_bytes=20_000)
    read = token_files.read_tokens(manifest, path).collect()
    assert all(zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32 for r in read) and len(read) == len(rows)
    manifest, path = token_files.write_tokens(none, bpe.vocabulary_path("word_bpe_49k.json"))
    assert token_files.read_tokens(manifest, path).count() == 0
