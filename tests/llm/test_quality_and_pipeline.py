import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from draftlake.llm import kneser_ney as kn

GOOD = "the of and to in for is on that by this with are be as".split()


def clean(rng, n):
    return ". ".join(" ".join(rng.choice(GOOD) + rng.choice(["", "ing", "er", "ed"]) for _ in range(8)).capitalize() for _ in range(n)) + "."


def junk(rng, n):
    return " | ".join(rng.choice(GOOD).upper() + rng.choice(["%%%", "###", "!!"]) for _ in range(8 * n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, junk(rng, 5) if i % 5 == 0 else clean(rng, rng.randrange(1, 12)), "en" if i % 2 else "de", f"src{i % 3}", 0) for i in range(300)]
    rows += [(1000, None, "en", "src0", None), (1001, "", None, None, 0), (None, clean(rng, 3), "en", "src1", 0), (1002, clean(rng, 4000), "en", "src1", 0), (1003, clean(rng, 2), "zz", "src1", 0), (1003, clean(rng, 2), "zz", "src1", 0)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(150)] + [(None, 1, 0), (3, 0, 0), (1000, None, None), (7, 1, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'mine' AS threshold", "'mine' AS kept", "'mine' AS _m").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def brute_model(texts, order=kn.ORDER):
    grams = Counter()
    for t in texts:
        data = b"\n" * (order - 1) + (t or "").encode() + b"\0"
        grams.update(data[i : i + order] for i in range(len(data) - order + 1))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    tables = {}
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == i for c in levels[n].values()) for i in (1, 2, 3, 4))
        d = [0.5] * 3
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = [x if 0 < x < i + 1 else 0.5 for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        total, given = Counter(), defaultdict(float)
        for g, c in levels[n].items():
            total[g[:-1]] += c
            given[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = levels[n], d, total, given

    def p(g):
        if not g:
            return 1 / 256
        counts, d, total, given = tables[len(g)]
        low = p(g[1:])
        if not total[g[:-1]]:
            return low
        c = counts[g]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + given[g[:-1]] / total[g[:-1]] * low

    return p


def brute_score(p, text, order=kn.ORDER):
    data = b"\n" * (order - 1) + (text or "").encode() + b"\0"
    n = len(data) - order + 1
    return -sum(math.log(p(data[i : i + order])) for i in range(n)) / n


def test_model_equals_brute_force(spark, corpus, monkeypatch):
    folder, rows, labels = corpus
    bad = {d for d, q, t in labels if d is not None and not (q == 1 and not t)}
    trusted = {d for d, *_ in labels if d is not None} - bad
    docs, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert {r.doc_id for r in kn.trusted_ids(lab).collect()} == trusted
    folds = {r.text: r.m for r in docs.select("text", kn.fold().alias("m")).collect()}
    models = [brute_model([r[1] for r in rows if r[0] in trusted and folds[r[1]] != m]) for m in (0, 1)]
    model, scores, limits = kn.fit(docs, lab)
    short = [r for r in rows if len(r[1] or "") < 2000]
    want = sorted((str(r[0]), round(brute_score(models[folds[r[1]]], r[1]), 4)) for r in short)
    got = sorted((str(r.doc_id), round(r.log_ppl, 4)) for r in scores.where("doc_id IS NULL OR doc_id <> 1002").collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 2e-4 for g, w in zip(got, want, strict=True))
    here = kn.score(docs, model, broadcast_entries=3_000_000).select("doc_id", "log_ppl").collect()
    key = lambda x: sorted((str(r.doc_id), round(r.log_ppl, 4)) for r in x)
    for chunk, cut in ((kn.CHUNK_BYTES, kn.SLICE), (20_000, 1000)):  # one chunk of each fold, then many, with texts in slices
        monkeypatch.setattr(kn, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(kn, "SLICE", cut)
        joined = kn.score(docs, model).select("doc_id", "log_ppl").collect()
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-4 for a, b in zip(key(joined), key(here), strict=True)) and len(joined) == len(rows)
    monkeypatch.undo()
    assert kn.score(docs.limit(0), model).count() == 0


def test_quality_is_told_apart(spark, corpus, none):
    folder, rows, labels = corpus
    docs, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r.kept for r in kn.classify(docs, lab).where("doc_id < 300").collect()}
    held_out = [i for i in range(150, 300)]
    assert sum(got[i] == (i % 5 != 0) for i in held_out) >= 0.98 * len(held_out)
    kept = kn.keep_good(docs, lab)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} == {"mine"}
    assert kn.classify(docs, lab.limit(0)).where("kept").count() == len(rows)
    assert kn.classify(none, lab).count() == 0


def test_thresholds_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["en", "de", None]) if i % 40 else "few", rng.choice([3, 3, 3, 5, 9]), round(rng.gauss(1.5, 0.2), 6)) for i in range(1000)]
    trusted = {i for i, *_ in rows if i % 3}
    rule = kn.Rule(quantile=0.9, slack=0.25, least_trusted=60)

    def at(group):
        bins = sorted(math.ceil(x * 1000) for x in group)
        return bins[math.ceil(rule.quantile * len(bins)) - 1] / 1000 if len(bins) >= rule.least_trusted else None

    def want(lang, size):
        known = [r for r in rows if r[0] in trusted]
        groups = [x for _, a, b, x in known if (a, b) == (lang, size)], [x for _, a, _, x in known if a == lang], [x for *_, x in known]
        return next(v for v in map(at, groups) if v is not None) + rule.slack

    scores = spark.createDataFrame(rows, "doc_id long, lang string, size_class int, log_ppl double")
    got = kn.thresholds(scores, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), rule).collect()
    assert len(got) == len({(a, b) for _, a, b, _ in rows})
    assert all(r.threshold == pytest.approx(want(r.lang, r.size_class)) for r in got)
    assert [r.threshold for r in kn.thresholds(scores.limit(1), spark.createDataFrame([], "doc_id long")).collect()] == [None]


def test_pipeline(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        before, after = {r.doc_id for r in seen.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "quality classifier":
            assert not {i for i in after if i is not None and i < 300 and i % 5 == 0} and len({i for i in after if i is not None and i < 300}) >= 235
        if name in ("substring dedup", "source mixing"):
            assert after == before
        seen = spark.createDataFrame(out.collect(), out.schema)
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in seen.collect()} and len(final) == seen.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
