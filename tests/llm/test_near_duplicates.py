import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from draftlake.llm import pq, simhash, substrings
from draftlake.llm.queries import op4_suffix_automaton, op7_simhash_bktree, op9_product_quantisation


def brute_windows(rows, n=13):
    first = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            d = float("inf") if doc_id is None else doc_id
            first[k] = min(first.get(k, d), d)
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        d = float("inf") if doc_id is None else doc_id
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        a = substrings.SuffixAutomaton()
        for i, t in enumerate(texts):
            a.add(t, i)
        query = [rng.choice("abc") for _ in range(12)]
        for n in (1, 3, 4):
            want = [next((i for i, t in enumerate(texts) if any(t[j : j + n] == query[k : k + n] for j in range(len(t) - n + 1))), None) for k in range(len(query) - n + 1)]
            assert a.firsts(query, n) == want


def test_repeated_windows(spark, wide, none, rows, tmp_path, monkeypatch):
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(str, brute_windows(rows)))
    assert sorted(map(str, map(tuple, op4_suffix_automaton(spark, str(tmp_path)).collect()))) == want
    monkeypatch.setattr(substrings, "SHARD_ENTRIES", 3)  # shards of a share of a document's anchors
    assert sorted(map(str, map(tuple, op4_suffix_automaton(spark, str(tmp_path)).collect()))) == want
    monkeypatch.setattr(substrings, "HOT", 2)  # the way of very common anchors
    assert sorted(map(str, map(tuple, op4_suffix_automaton(spark, str(tmp_path)).collect()))) == want
    out = substrings.dedup(wide)
    assert "input__doc" in out.columns and "input_n_words" in out.columns
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    for r in out.collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256
        assert r.n_removed or r.text in texts[r.doc_id]
    assert substrings.dedup(none).count() == 0


def test_windows_of_many_documents_without_id(spark, monkeypatch):
    """Documents without doc_id lose what documents with one have, but nothing to each other, and their work is spread: no list is of all of them."""
    rng = random.Random(1)
    common, own = " ".join(f"c{i}" for i in range(40)), " ".join(f"n{i}" for i in range(40))
    texts = [f"{' '.join(str(rng.random()) for _ in range(20))} {common if i % 2 else own} {i}" for i in range(5000)]
    rows = [(None, t) for t in texts] + [(7, common), (None, texts[0]), (9, f"{common} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for hot in (substrings.HOT, 10**9):
        monkeypatch.setattr(substrings, "HOT", hot)
        began = time.time()
        got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert time.time() - began < 90 and sorted(map(str, map(tuple, got))) == sorted(map(str, brute_windows(rows)))
    keyed = substrings._anchors_of(docs.withColumn("_doc", F.coalesce("doc_id", F.lit(substrings.NO_ID) + F.xxhash64("text").bitwiseAND(F.lit(substrings.NO_ID - 1)))), 13)
    assert substrings._shared(keyed).agg(F.max(F.size("_shared"))).first()[0] < 100


def test_small_alphabet_windows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(5, 120)))) for i in range(60)] + [(70, "a " * 500), (71, "a " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_windows(rows)))


def test_known_reference(spark, docs, rows):
    known = [r[1] for r in rows if r[0] in (100, 120)]
    reference = spark.createDataFrame([(t,) for t in known] + [(None,)], "text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_known(docs, reference).where("doc_id < 140").collect()}
    want = {d: n for d, _, n, _ in brute_windows([(-1 - i, t) for i, t in enumerate(known)] + [(r[0], r[1]) for r in rows if r[0] is not None and r[0] < 140]) if d >= 0}
    assert all(got[d] == want[d] for d in (100, 101, 105, 110, 113)) and got[0] == 0 and got[121] >= 60


def brute_simhash(text, n=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, wide, none, rows, sets, tmp_path):
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_simhash_bktree(spark, str(tmp_path)).collect()
    prints = [brute_simhash(r[1]) for r in rows]
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[sets.find(i)] = min(least.get(sets.find(i), r[0]), r[0])
    want = [(r[0], f"{prints[i]:016x}", least.get(sets.find(i))) for i, r in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.deduplicate(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for d, _, c in want if d is not None})
    assert simhash.classes(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_links_of_dense_fingerprints(spark, sets):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(80)} | {rng.getrandbits(64) for _ in range(100)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    got = type(sets)()
    for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")).collect():
        assert (r.a ^ r.b).bit_count() <= 4 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        got.join(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)
    groups = lambda s: sorted(sorted(v for v in values if s.find(v) == k) for k in {s.find(v) for v in values})
    assert groups(got) == groups(sets)


def test_many_near_fingerprints_are_cheap():
    """Values that are all near each other: searches meet pivots, not all pairs."""
    rng = random.Random(3)
    values = {sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(20_000)}
    found, joined = simhash.Links(4), 0
    began = time.time()
    for x in values:
        for a, b in found.add(x):
            assert (a ^ b).bit_count() <= 4
            joined += 1
    assert joined == len(values) - 1 and time.time() - began < 60
    assert simhash.blocks_for(10**6) == 6 and simhash.blocks_for(10**11) > 6


def test_near_copies_equal_brute_force(spark, sets):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(words) for _ in range(rng.choice([30, 80, 300]))] for _ in range(60)]
    for _ in range(300):  # similarities of 0.6 to 1, many about 0.8
        t = list(rng.choice(texts[:60]))
        for _ in range(rng.randrange(1, max(2, len(t) // 35 + 1))):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t[: rng.choice([len(t), len(t), len(t) * 9 // 10])])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "a b"), (903, "A b"), (None, "a b"), (None, "x y z")]
    shingles = [(lambda w: {tuple(w[j : j + 5]) for j in range(max(len(w) - 5, 0) + 1)} if w else set())((t or "").lower().split()) for _, t in rows]
    near = 0
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                near += x != y and (brute_simhash(rows[i][1], 5) ^ brute_simhash(rows[j][1], 5)).bit_count() > 6
                sets.join(i, j)
    assert near >= 50
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[sets.find(i)] = min(least.get(sets.find(i), d), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((d, least.get(sets.find(i)))) for i, (d, _) in enumerate(rows))
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*least.values(), None, None]))
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_many_near_fingerprints_of_one_band_cost_a_short_search_each():
    rng = random.Random(21)
    found, base, n = simhash.Stars(80), rng.getrandbits(64), 100_000
    began, pairs, to_check = time.time(), 0, 0
    for node in range(n):
        value = base
        for bit in rng.sample(range(64), rng.randrange(12)):  # all within 22 bits of each other
            value ^= 1 << bit
        pair = found.add(value, rng.randrange(100, 110), node)
        pairs += pair is not None
        to_check += pair is not None and pair[2]
    assert time.time() - began < 60
    assert pairs == n - 1 and to_check == n - 1


def test_stars_connect_all_nodes_of_a_shard(sets):
    rng = random.Random(22)
    found = simhash.Stars(80)
    nodes = [(rng.getrandbits(64), rng.choice([1, 5, 40, 50, 4000])) for _ in range(400)]
    for node, (value, size) in enumerate(nodes + nodes):
        if pair := found.add(value, size, node):
            a, b, check = pair
            sets.join(a, b)
            (v, m), (w, k) = nodes[a % 400], nodes[b % 400]
            assert not check or (v ^ w).bit_count() <= simhash.WIDE_RADIUS and min(m, k) * 100 >= max(m, k) * 80
    assert len({sets.find(i) for i in range(800)}) == 1


def test_prefixes_lose_no_pair(sets):
    rng = random.Random(23)
    found, near, lost = [], 0, 0
    for _ in range(40):
        base = rng.sample(range(300), rng.randrange(1, 60))
        for _ in range(6):
            found.append(frozenset(x for x in base if rng.random() > 0.1) | frozenset(rng.sample(range(300), rng.randrange(4))))
    found = [x for x in set(found) if x]
    often = defaultdict(int)
    for x in found:
        for y in x:
            often[y] += 1
    shards = defaultdict(list)
    for i, x in enumerate(found):
        for place, y in enumerate(sorted(x, key=lambda y: (often[y], y))[: simhash.prefix(len(x), 80)]):
            shards[y].append((len(x), i, place))
    pairs, links = set(), set()
    for rows in shards.values():
        every, forest = simhash.Across(80, False), simhash.Across(80, True)
        for size, i, place in sorted(rows):
            pairs |= {frozenset((i, j)) for j in every.add(0, size, i, i, place)}
            links |= {frozenset((i, j)) for j in forest.add(0, size, i, i, place)}
    assert links <= pairs
    for i, x in enumerate(found):
        for j in range(i):
            if 5 * len(x & found[j]) >= 4 * len(x | found[j]):
                near += 1
                lost += frozenset((i, j)) not in pairs
    assert near > 100 and lost == 0 and len(pairs) < len(found) * (len(found) - 1) // 2 // 10


def test_a_common_header_gives_no_pairs_of_all(spark, sets, monkeypatch):
    """600 texts share a header that is 0.7 of each; some are near copies besides. What is checked stays in proportion to the texts."""
    rng = random.Random(24)
    header = [f"h{i}" for i in range(240)]
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [header + own(50) for _ in range(480)]
    for i in range(120):
        t = list(texts[i * 3])
        for _ in range(rng.randrange(1, 7)):  # similarities of 0.8 and more, and less
            t[rng.randrange(240, 290)] = own(1)[0]
        texts.append(t)
    shingles = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                sets.join(i, j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(sets.find(i), i)
    tried, check = [], simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda pairs, *rest: tried.append(pairs.count()) or check(pairs, *rest))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: least[sets.find(i)] for i in range(len(texts))}
    assert len(least) < 590 and len(tried) == 3 and sum(tried) < 20 * len(texts)


def test_product_quantisation(spark, tmp_path, sets):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.08
    dense = base[0] + rng.normal(size=(80, 16)) * 0.1
    x = [v.astype("float32").tolist() for v in np.concatenate([base, near, dense, base[:20], base[:20] * 2])]
    x += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [-0.0] + x[1][1:]]
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = list(zip(ids, x, [0] * len(x), strict=True)) + [(None, x[0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows += [(None, [v * 3 for v in x[1]], 1), (None, x[0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 1)]
    spark.createDataFrame(rows[-4:], "vec_id long, embedding array<float>, label int").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    whole = {at: np.array(v, dtype=np.float64) for at, (_, v, _) in enumerate(rows) if v and len(v) in (2, 16) and None not in v and np.isfinite(v).all() and any(v)}
    keys = sorted(whole)
    u = {k: whole[k] / np.linalg.norm(whole[k]) for k in keys}
    degree = defaultdict(int)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9:
                degree[a] += 1
                degree[b] += 1
                sets.join(a, b)
    least = {}
    for k in keys:
        if rows[k][0] is not None:
            least[sets.find(k)] = min(least.get(sets.find(k), rows[k][0]), rows[k][0])
    component = lambda at: least.get(sets.find(at)) if at in whole else rows[at][0]
    want = [(i, degree.get(at, 0), component(at), i is not None and component(at) == i) for at, (i, _, _) in enumerate(rows)]
    assert [w for w in want if w[0] is None and w[1]] and want[-1] == (None, 1, None, False)
    got = op9_product_quantisation(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    exact = pq.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), probes=1000, list_rows=30).collect()
    assert sorted(map(str, map(tuple, exact))) == sorted(map(str, want))  # all lists searched, in parts: nothing lost
    found, all_links = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.9 * all_links <= found <= all_links
    by = {w[0]: w for w in want if w[0] is not None}
    assert all(r.n_links <= by[r.vec_id][1] for r in got if r.vec_id is not None)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq.near_duplicates(none).count() == 0


def test_vectors_of_all_lengths_and_sizes(spark, sets):
    rng = np.random.default_rng(4)
    rows, of = [], {}
    for dims, n in ((16, 120), (2, 30), (3, 5), (1, 4), (7, 1)):
        base = rng.normal(size=(n, dims))
        for v in np.concatenate([base, base + rng.normal(size=base.shape) * 0.1]):
            rows.append((len(rows), (v * 10.0 ** rng.choice([-200, 0, 200, -307, 300])).tolist()))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, [1e308] * 16), (len(rows) + 2, [5e-324, 0.0]), (7, [3.0, 4.0])]  # a vec_id twice
    u = [np.array(v) / np.abs(v).max() for _, v in rows]
    u = [x / np.linalg.norm(x) for x in u]
    degree = [0] * len(rows)
    for i, a in enumerate(u):
        for j, b in enumerate(u[:i]):
            if len(a) == len(b) and a @ b >= 0.9:
                degree[i] += 1
                degree[j] += 1
                sets.join(i, j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[sets.find(i)] = min(least.get(sets.find(i), k), k)
    want = [(k, degree[i], least[sets.find(i)], k == least[sets.find(i)]) for i, (k, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("mine"))
    got = pq.near_duplicates(df, probes=1000, list_rows=20)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(degree) > 200


def test_recall_of_many_lists():
    """Clusters of near vectors among many lists, found in two levels: of the links, 0.9 at least are found from either side."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4000, 32))
    x = pq.unit(np.repeat(base, 4, axis=0) + rng.normal(size=(16000, 32)) * 0.2)
    index = pq.fit(x[:8000], 1024)
    near, _, _ = pq.encode(x, index)
    found = links = 0
    for i in range(0, len(x), 4):
        for a in range(i, i + 4):
            for b in range(i, a):
                if x[a] @ x[b] >= 0.9:
                    links += 1
                    found += near[a, 0] in near[b] or near[b, 0] in near[a]
    assert len(index.centres) > 900 and links > 10_000 and found >= 0.9 * links
