"""Boosted PII (op1): base spans against plain patterns, added spans, redaction, edge cases."""

import hashlib
import random
import re

import pytest

from spendloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


ODD = ["", None, "a@b.c@d.e", "a@b.com_x@d.e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 12", "4111  1111", "+1 (974) 555-3436", "+12 3", "++1 234567 8901", "+1234567890123456", "é@é a.b@c-d.e-f 漢 😀 z@q.r", "4" * 40, "%@-.-", "a" * 50 + "@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def found(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = pii.find_pii(docs, model).select("doc_id", pii.named("base").alias("base"), pii.named("spans").alias("spans")).collect()
    return [(r.base, r.spans) for r in sorted(got)]


def test_base_spans(spark, model):
    rnd = random.Random(9)
    texts = ODD + ["".join(rnd.choice("0123456789012 .-+@a(") for _ in range(rnd.randrange(60))) for _ in range(400)]
    for t, (base, spans) in zip(texts, found(spark, model, texts)):
        assert base == ",".join(plain(t)), t
        assert set(filter(None, base.split(","))) <= set(spans.split(",")), t


def test_table(spark, model, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = pii.op1_boosted_pii(spark, sf_dir)
    for r in out.collect():
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_added_spans(spark, model):
    yes = {'the token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" of': "secret:13:53", "mente 9807915762804490 raie": "card:6:22", "call (917) 555-0134 now": "phone:5:19", "mail jane.roe (at) example (dot) com please": "email:5:36"}
    no = ["on 2024-03-15 there", "order 1234567890 of", "commit ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e", "pi is 3.14159265", "a sentence, with no numbers at all.", "about 12 of 300 in 1999"]
    got = found(spark, model, [*yes, *no])
    assert [s for _, s in got[: len(yes)]] == list(yes.values())
    assert all(s == "" for _, s in got[len(yes) :]), got


def test_redaction(spark, model):
    texts = {"write a@b.com or +1 (974) 555-3436.": "write [EMAIL] or [PHONE].", "é 10.0.0.1é": "é [IP]é", "nothing": "nothing", "": "", None: None, "4111 1111 1111 1111": "[CARD]"}
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, base long")
    got = pii.redact(docs, model)
    assert got.columns == docs.columns and [r.text for r in sorted(got.collect())] == list(texts.values())
    assert pii.redact(docs.where("false"), model).collect() == []


def test_long_texts(spark, model):
    """Texts of 1 MB: many spans, one endless address, digits without end."""
    many = "write to ab.cd@ef.gh or token = 'ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e', " * 13_000
    texts = {"many": many, "address": "a@" + "b." * 500_000 + "b", "digits": "1234567890 " * 90_000, "dots": "1." * 500_000, "letters": "x" * 1_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs, model).selectExpr("doc_id", "size(base) as b", "size(spans) as s", "try_element_at(base, -1).end as last").collect()}
    assert got["many"].b == 13_000 and got["many"].s == 26_000 and got["many"].last == len(many) - len(" or token = 'ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e', ")
    assert got["address"].b == 1 and got["address"].last == 1_000_003
    clean = pii.redact(docs.where("doc_id in ('many', 'address')"), model).collect()
    assert {r.doc_id: r.text for r in clean} == {"many": "write to [EMAIL] or token = '[SECRET]', " * 13_000, "address": "[EMAIL]"}


def test_tree_expression(spark, model):
    """The trees as an expression against the trees in numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    x = [[rnd.randrange(5), *(rnd.choice([0, 1, 2, 8, 16, 40]) for _ in pii.FEATURES[1:])] for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "i long, " + ", ".join(f"{f} int" for f in pii.FEATURES))
    got = [r.m for r in df.select("i", model.trees.column(F.struct(*pii.FEATURES)).alias("m")).sort("i").collect()]
    assert np.allclose(got, model.trees.margin(np.array(x)), atol=1e-9)


def test_apart_and_joined(spark):
    """Against all pairs, on made-up spans."""
    from pyspark.sql import functions as F

    rnd = random.Random(8)

    def spans(n, most):
        out = []
        for _ in range(n):
            s = rnd.randrange(most)
            out.append((s, rnd.randrange(4), s + rnd.randrange(1, 9), rnd.choice([0.5, 0.75])))
        return sorted(out)

    rows = [(i, spans(rnd.randrange(7), 40), spans(rnd.randrange(12), 40)) for i in range(300)]
    kind = "array<struct<start:int,kind:int,end:int,p:double>>"
    df = spark.createDataFrame(rows, f"i int, base {kind}, found {kind}")
    got = {r.i: r for r in df.select("i", pii.apart(F.col("found"), F.col("base")).alias("a"), pii.joined(F.col("found")).alias("j")).collect()}
    for i, base, found in rows:
        assert [tuple(x) for x in got[i].a] == [c for c in found if not any(c[0] < b[2] and b[0] < c[2] for b in base)]
        groups = []
        for c in found:
            if groups and c[0] < max(x[2] for x in groups[-1]):
                groups[-1].append(c)
            else:
                groups.append([c])
        assert [tuple(x) for x in got[i].j or []] == [(g[0][0], min(g, key=lambda x: (-x[3], x[1]))[1], max(x[2] for x in g)) for g in groups]


def test_redaction_keeps_clashing_columns(spark, model):
    docs = spark.createDataFrame([(1, "to a@b.com", 1, 2, 3, 4)], "doc_id long, text string, base int, spans int, found int, _found int")
    assert [tuple(r) for r in pii.redact(docs, model).collect()] == [(1, "to [EMAIL]", 1, 2, 3, 4)]
    assert pii.find_pii(docs, model).first()["found"] == 3
