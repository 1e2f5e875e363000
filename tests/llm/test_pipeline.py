"""The corpus pipeline against its parts, and mixing against a plain running sum."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F
from spendloom.llm import mixing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(10**9, None, "en", "src1", 0), (10**9 + 1, "12 !", "en", None, 4)], "doc_id long, text string, lang string, source string, n_chars long"))
    held, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, held, sf_dir).persist()
        assert out.columns == docs.columns and out.schema == docs.schema
        seen.append({r.doc_id for r in out.collect()})
        held = out
    every = {r.doc_id for r in docs.collect()}
    assert seen[0] == every - {10**9, 10**9 + 1}
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] <= seen[2]
    texts = [r.text for r in held.collect()]
    assert not any(re.search(r"@mail\d|token = \"[0-9a-f]{40}", t) for t in texts)
    packed = P.STAGES[-1][1](spark, held, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in held.collect())


def test_language_decides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    plain = lambda d: sorted(map(tuple, d.collect()), key=str)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert plain(P.identify_language(spark, unlabelled, sf_dir)) == plain(unlabelled.where(F.col("text").rlike(r"\p{L}")))
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    got = {r.doc_id: r.lang for r in P.identify_language(spark, hidden, sf_dir).collect()}
    want = {r.doc_id: r.lang for r in docs.collect() if r.doc_id in got and len(r.text) > 40}
    filled = [got[i] == want[i] for i in want if i % 4 == 0]
    assert all(got[i] == want[i] for i in want if i % 4) and sum(filled) > 0.95 * len(filled) > 10


def test_redaction_without_counts(spark, sf_dir):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "x"), (2, None, "y")], "doc_id long, text string, kind string")
    assert P.redact_pii(spark, docs, sf_dir).columns == docs.columns


def test_near_copies_at_80(spark, sf_dir):
    words = [f"w{i}" for i in range(104)]
    near = words[:50] + ["x", "y"] + words[52:]  # 94 of 106 shingles
    near2 = words[:30] + ["x"] + words[31:70] + ["y"] + words[71:]  # 90 of 110: 0.818
    far = words[:20] + ["x"] + words[21:50] + ["y"] + words[51:80] + ["z"] + words[81:]  # 85 of 115: 0.739
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in enumerate((words, near, near2, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, sf_dir).collect()) == [0, 3]


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir) if docs.columns[-1] == "n_chars" else docs
        assert docs.collect() == []


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 30))), rnd.choice(["a", "b", "b", "b", "c", "d", None, ""])) for i in range(300)]
    rows += [(400, None, "b"), (401, "x y", "tiny"), (401, "x y", "tiny"), (None, "null id", "c"), (None, "null id too", "c"), (402, "", "none")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size long")
    for width in (3, 5000):
        got = mixing.mix(docs, bucket_rows=width).collect()
        sizes, taken, targets = defaultdict(int), defaultdict(int), {}
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        want = water(sizes)
        for r in got:
            taken[r.source] += r.taken
            targets[r.source] = r.target
            assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert len(got) == len(rows)
        for s in sizes:
            assert abs(targets[s] - want[s]) < 1e-6 and taken[s] == int(want[s])
        if width == 3:
            first = sorted(map(str, got))
    assert sorted(map(str, got)) == first
    out = Counter(r.source for r in mixing.mixture(docs).collect())
    assert out["tiny"] == 6 and out["none"] == 0
    assert mixing.mix(docs.where("false")).collect() == []
