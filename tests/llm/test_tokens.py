"""Token stream (op2) and packing (op4) against plain encoding and brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendloom.llm import packing, token_stream
from spendloom.llm.encoder import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "x\n y", "x \ny", "tab\tb c", "l'été s'en va  fin", "漢字 かな", "a b c", "<|endoftext|> a", "😀 b 😀", "1 2  3", "don't WE'LL", "\n\n", "end. \n\n Next", "a\u0085 b", "\x1c \x1d"]


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(VOCABULARY)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def rows(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, length string")


def test_encoder_equals_plain(plain, sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:80] + ODD
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("ab \n\t'é1.<漢") for _ in range(rnd.randrange(40))) for _ in range(300)]
    enc = Encoder(VOCABULARY)
    for _ in range(2):  # the second time from the memo
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, enc.dtype).tolist() == plain(t), t


def test_long_text_is_cut_safely(plain, monkeypatch):
    monkeypatch.setattr("spendloom.llm.encoder.PLAIN_CHARS", 10)
    text = "one two  three four\n five six seven\teight " * 20
    enc = Encoder(VOCABULARY)
    assert np.frombuffer(enc.plain(text), enc.dtype).tolist() == plain(text)


def test_stream_against_plain(spark, plain, tmp_path):
    texts = [(i * 7 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "null id"), (500, None), (501, "word " * 5000), (502, "same"), (502, "same")]
    path = f"file://{tmp_path}/out"
    shards = token_stream.write_tokens(rows(spark, texts), path, VOCABULARY, sequence=16, batch=4)
    got = sorted(token_stream.read_tokens(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda x: (x is not None, x))
    want = Counter((i, zlib.crc32(np.array(plain(t) + [0], "<u4").tobytes())) for i, t in texts)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    for s in shards:
        f = token_stream.SequenceReader(f"{s.path}.arrows")
        flat = np.concatenate([f.ids(i)[f.mask(i)] for i in range(len(f))])
        assert len(flat) == s.n_tokens and all(len(f.ids(i)) == 16 for i in range(len(f)))
        assert (f.span(3, 40) == flat[3:43]).all()


def test_stream_empty(spark, tmp_path):
    shards = token_stream.write_tokens(rows(spark, []), f"file://{tmp_path}/out", VOCABULARY)
    assert shards == [] and token_stream.read_tokens(spark, shards).collect() == []


def test_fill_is_closest():
    rnd = random.Random(1)
    for _ in range(60):
        counts = Counter({rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(6)})
        room = rnd.randrange(5, 90)
        items = list(counts.elements())
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        use = packing.fill(counts, room)
        assert sum(s * n for s, n in use) == max(s for s in sums if s <= room)
        assert all(n <= counts[s] for s, n in use)


def test_plan_uses_each_length_once():
    histogram = {n: (n * 37) % 50 + 1 for n in range(1, 2048, 3)} | {700: 900}
    made = packing.plan(histogram)
    used = Counter()
    for use, times in made:
        assert sum(s * n for s, n in use) <= 2048
        for s, n in use:
            used[s] += n * times
    assert used == Counter(histogram) and len(made) <= len(histogram)
    total = sum(s * n for s, n in histogram.items())
    assert total / (2048 * sum(t for _, t in made)) > 0.98


def check_pack(plain, texts, got):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array(plain(t) + [1], "<u4")
        ps = sorted(by_doc[i], key=lambda r: r.start)
        assert [p.start for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1] and sum(p.length for p in ps) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in ps)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1] and sum(p.length for p in ps) <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pack_small(spark, plain):
    texts = dict(enumerate([*ODD, None, "word " * 5000, *["same text"] * 9]))
    got = packing.pack(rows(spark, texts.items()), VOCABULARY).collect()
    check_pack(plain, texts, got)
    assert packing.pack(rows(spark, []), VOCABULARY).collect() == []


def test_pack_table(spark, plain, sf_dir):
    got = packing.op4_min_slack_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_pack(plain, {r.doc_id: r.text for r in docs}, got)
    n = len({r.sequence_id for r in got})
    assert sum(r.length for r in got) / (2048 * n) > 0.97
