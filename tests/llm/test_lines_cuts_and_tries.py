import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.llm import fim, lines, prefix_trie
from draftlake.llm.queries import ORACLE_SQL, op11_bloom_lines, op12_fill_in_middle, op13_prefix_trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute_lines(rows, least_docs=3):
    holders, out = defaultdict(set), []
    holder = lambda d, t: (d is not None, d if d is not None else 0, "" if d is not None else t or "")
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(holder(doc, text))
    for doc, text in rows:
        kept, all_lines = [], (text or "").split("\n")
        for line in all_lines:
            held = holders.get(key_of(line), set())
            if len(held) < least_docs or (holder(doc, text) == max(held) if max(held)[0] else None):
                kept.append(line)
            elif not max(held)[0]:
                kept.append(None)  # of documents without id some one keeps it
        out.append((doc, len(all_lines), len(all_lines) - len(kept), kept))
    return out


def line_rows():
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gämma", "delta", "東京"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "x" * 200_000 + "\n" + pool[0]), (204, "x" * 200_000), (205, "x" * 200_000)]
    rows += [(206, "Nineteen characters\nNineteen characters"), (207, "nineteen characters"), (208, "nineteen characters"), (209, "ÄÖÜ twenty characters\näöü twenty characters"), (210, "ÄÖÜ TWENTY characters"), (211, "ÄÖÜ twenty characters")]
    rows += [(300, "a line of one document id\nb"), (300, "a line of one document id\nc"), (301, "a line of one document id"), (302, "the keeper of a line that is long\n" * 3), (301, "the keeper of a line that is long"), (301, "the keeper of a line that is long"), (15, " The Keeper of a line that is long")]
    return rows


def test_lines_equal_brute_force(spark, tmp_path):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    docs.withColumns({c: F.lit("mine") for c in ("_id", "a", "b", "line", "n_lines")}).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, n, lost, sha("\n".join(kept))) for d, n, lost, kept in brute_lines(rows)]
    assert sum(w[2] for w in want) > 100
    assert sorted(map(str, map(tuple, op11_bloom_lines(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    out = lines.dedup(spark.read.parquet(f"{tmp_path}/documents.parquet"), least_docs=2)
    assert "input__id" in out.columns and "input_n_lines" in out.columns and "a" in out.columns
    for r in out.collect():
        assert sha(r.text or "") == r.kept_sha256 and (r.text is None) == (r.doc_id == 200)
    want = [(d, n, lost, sha("\n".join(kept))) for d, n, lost, kept in brute_lines(rows, 2)]
    assert sorted(map(str, [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()])) == sorted(map(str, want))
    assert lines.dedup(docs.limit(0)).count() == 0


def test_lines_of_documents_without_id(spark):
    line = "a line that all of the documents have"
    rows = [(None, line), (None, line + "\nx"), (None, line + "\ny"), (None, line + "\ny")]
    got = [(r.n_lines, r.n_dropped) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) in ([(1, 0), (2, 1), (2, 1), (2, 1)], [(1, 1), (2, 0), (2, 1), (2, 1)], [(1, 1), (2, 0), (2, 0), (2, 1)])
    with_id = spark.createDataFrame([*rows, (5, line)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.dedup(with_id).collect()} == {None: 1, 5: 0}


def test_line_filters_lose_nothing(spark, monkeypatch):
    """Whatever stands in two arrays is suspected, however many segments a filter has and however often a task sends; most others are not."""
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-(1 << 63), 1 << 63, 40_000), rng.integers(-(1 << 63), 1 << 63, 5_000)
    values = np.concatenate([once, twice, twice])
    rng.shuffle(values)
    arrays = [sorted(set(part.tolist())) for part in np.array_split(values, 300)]
    for held in (1 << 20, 900):
        monkeypatch.setattr(lines, "HELD", held)
        df = spark.createDataFrame([(a,) for a in arrays], "h array<long>").repartition(7)
        seen = lines.seen_twice(df, lines.filter_bits(len(values)))
        assert len(seen) * 8 == 1 << 20
        counts = defaultdict(int)
        for a in arrays:
            for x in a:
                counts[x] += 1
        again = np.array([x for x, n in counts.items() if n > 1])
        assert lines.suspected(again, seen).all() and lines.suspected(once, seen).mean() < 0.01
    assert lines.filter_bits(0) == 1 << 16 and lines.filter_bits(10**12) == 1 << 30


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter that is far too small suspects all lines: nothing changes in the result."""
    rows = line_rows()
    monkeypatch.setattr(lines, "suspected", lambda h, _: np.ones(len(h), bool))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(d, n, lost, sha("\n".join(kept))) for d, n, lost, kept in brute_lines(rows)]))


def brute_fim(doc, text):
    text = text or ""
    units, hexed = re.findall(r"[^\n]*\n|[^\n]+", text), sha(f"7:{'' if doc is None else doc}")
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, sha(text), sha(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 50 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return doc, n, form, len(a), len(b), sha(out), sha(text)


def test_fill_in_middle(spark, wide, none, rows, tmp_path):
    extra = [(500 + i, t) for i, t in enumerate(["a", "\n", "\n\n", "é\n東京🙂\nx", "<P\n<P>\n", "<\nS\n>", "no <M> here\n", "🙂", "a\r\nb c\n", "東京\n" * 400_000, "<P\n<S\n<M\n" * 9])]
    docs = wide.select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("form")).unionByName(spark.createDataFrame([(*r, 1, 2) for r in extra], "doc_id long, text string, n int, form int"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    everything = [(r[0], r[1]) for r in rows] + extra
    got = op12_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, (brute_fim(*r) for r in everything)))
    out = fim.fill_in_middle(docs, unit="char", percent=60, spm_percent=30, seed=1)
    assert {"input_n", "input_form"} <= set(out.columns)
    texts, forms = defaultdict(set), set()
    for d, t in everything:
        texts[d].add(t)
    for r in out.collect():
        forms.add(r.form)
        back = None if r.text is None else fim.restore(r.text.encode(), r.form).decode()
        assert back in texts[r.doc_id]
        if r.form != "plain":
            assert r.n == len(back) and 0 <= r.prefix_chars <= r.prefix_chars + r.middle_chars <= r.n
    assert forms == {"plain", "psm", "spm"} and fim.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        fim.Units(b"x", "word", fim.Exceptions(b"x"))


def test_exceptions_convert_every_cut():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("ab\né東🙂") for _ in range(rng.randrange(0, 40)))
        raw, index = text.encode(), fim.Exceptions(text.encode())
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        for k in range(len(text) + 1):
            cut = len(text[:k].encode())
            assert index.to_chars(cut) == k and index.to_bytes(k) == cut
        assert fim.Units(raw, "char", index).n == len(text)
        lines_ = re.findall(r"[^\n]*\n|[^\n]+", text)
        units = fim.Units(raw, "line", index)
        assert units.n == len(lines_) and [units.cut(k) for k in range(units.n + 1)] == [len("".join(lines_[:k]).encode()) for k in range(units.n + 1)]
    assert len(fim.Exceptions(b"plain ascii" * 1000).at) == 0


def brute_trie(rows):
    def ident(role, text):
        return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), ident(role, text), role or "", text or ""))
    seqs = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(np.fmod(conv, 100))
        head = sorted(own[base])[:h] if base in own else []
        seqs[conv] = [(t[2], t[3]) for t in head + sorted(turns)[h:]]
    members = defaultdict(list)
    for conv, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        kids = children[path]
        leaves = sum(out[k][5] for k in kids) if kids else 1
        saved = (n - 1) * (len(path[-1][1]) if path else 0) + sum(out[k][6] for k in kids)
        ended = ",".join(map(str, sorted(c for c in members[path] if len(seqs[c]) == len(path))))
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, n, len(kids), leaves, saved, sha(ended))
    return list(out.values())


def trie_rows():
    rng = random.Random(11)
    pool = [(rng.choice(["user", "assistant"]), " ".join(rng.choices(["yes", "nö", "maybe", "東京"], k=rng.randrange(1, 4)))) for _ in range(12)]
    rows = []
    for conv in [*range(0, 160), *range(230, 420), 1000, 1001, 5007]:
        rows += [(conv, t, *rng.choice(pool[:3] if t < 3 else pool)) for t in range(rng.randrange(1, 9))]
    rows += [(conv, t, "user", f"the same {t}") for conv in range(600, 680) for t in range(4)]  # copies
    rows += [(conv, t, "user", f"long {t if t < 100 or conv != 702 else 'x'}") for conv in range(700, 704) for t in range(300)]
    rows += [(800, None, "user", "first"), (800, 1, None, None), (800, 1, None, "tie"), (800, 1, "user", "tie"), (801, 5, "user", "a"), (801, 5, "user", "a"), (None, 1, "user", "nobody's"), (901, 0, "user", "perhaps no base"), (903, 0, "", ""), (-7, 0, "user", "below")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [1, 7, 500, 1 << 21])
def test_trie_equals_brute_force(spark, cells):
    rows = trie_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("mine")).repartition(5)
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.nodes(turns, cells=cells).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_trie(rows)))


def test_trie_query(spark, tmp_path):
    rows = [r for r in trie_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path))
    assert {t for _, t in got.dtypes} == {"bigint", "string"} and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_trie(rows)))
    assert prefix_trie.nodes(df.limit(0)).count() == 0


def test_trie_streams_the_ends_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(conv, 0, "user", "same") for conv in range(1, 2000)]
    got = prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6), cells=50).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(rows)))


@pytest.mark.parametrize("name", ["op11_bloom_lines", "op12_fill_in_middle", "op13_prefix_trie"])
def test_new_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from draftlake.llm.queries import QUERIES

    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(str, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(str, want.select(*columns).fetchall()))
