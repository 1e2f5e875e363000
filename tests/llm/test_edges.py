"""Nulls, empty texts and tables, ties, repeated rows and clashing columns for line dedup, licences and mixing."""

import string

from spendloom.llm.licence_texts import FILES, LICENCES, NAMES, NOTICES_ONLY, TEMPLATES, TITLES
from spendloom.llm.licences import scan_licences
from spendloom.llm.line_dedup import UNIT, deduplicate_lines, normalised, runs
from spendloom.llm.mixing import mix, mixture

SCHEMA = "doc_id long, text string, source string, row long, key long, taken long, notices string, removed string, salt int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 2, 3, "x", "y", 4) for d, t, s in rows], SCHEMA)


LINE = "One two three four five six, seven eight nine."
#: 45 words in five lines.
PASSAGE = "\n".join(f"{x} " + LINE[4:] for x in ("Alpha", "Beta", "Gamma", "Delta", "Omega"))


def test_line_dedup(spark):
    long = "\n".join(f"{i} " + LINE for i in range(20_000))
    own = "The one who wrote this has words before"
    rows = [(2, f"{own}. {PASSAGE.upper()}\nand after.", "a"), (1, f"first\n{PASSAGE}\nlast", "a"), (3, None, None), (4, "", "a"), (None, PASSAGE, "b"), (5, long, "c"), (6, long, "c"), (7, "Twice. " + PASSAGE, "d"), (7, "Twice. " + PASSAGE, "d"), (12, "other " + PASSAGE, "d")]
    rows += [(8, LINE * 3, "a"), (9, LINE * 3, "a"), (10, "--\n" + PASSAGE.replace("Gamma", "Edited"), "a"), (11, "x " * 100_000 + ". " + PASSAGE, "a")]
    got = deduplicate_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == f"first\n{PASSAGE}\nlast" and by[1][0].removed == ""
    at = len(own) + 1
    assert by[2][0].text == f"{own}.and after." and by[2][0].removed == f"{at}:{at + len(PASSAGE) + 2}"
    assert by[3][0].text is None and by[4][0].text == "" and by[None][0].text == ""
    assert by[5][0].text == long and by[6][0].n_removed == 1 and by[6][0].text == ""
    assert [r.n_removed for r in by[7]] == [1, 1] and by[7][0].text == "Twice."
    assert by[12][0].n_removed == 0  # its first unit differs, and 39 words are left
    assert by[9][0].text == LINE * 3 and by[10][0].n_removed == 0
    assert by[11][0].text == "x " * 100_000 + "."
    assert deduplicate_lines(table(spark, rows).limit(0)).count() == 0


def test_runs_against_all_pairs():
    import random

    r = random.Random(3)
    for _ in range(200):
        units = [" ".join(r.choice(["a", "b", "C", "-"]) for _ in range(r.randrange(0, 5))) + r.choice([".", ",", "!", "\n", ".\n", " \n"]) for _ in range(r.randrange(12))]
        text = "".join(units)
        words = []
        for m in UNIT.finditer(text):
            w = m.group().translate({ord(c): None for c in string.punctuation}).lower().split()
            if w:
                words.append((m.start(), m.end(), w))
        assert [(" ".join(w), s, e) for s, e, w in words] == normalised(text)
        opens = [i == 0 or "\n" in text[words[i - 1][0] : words[i][0]] for i in range(len(words))] + [True]
        want, n = set(), lambda a, b: sum(len(w[2]) for w in words[a : b + 1])
        for i in range(len(words)):
            for j in range(i, len(words)):
                left, right = n(i, j - 1) < 7, n(i + 1, j) < 7
                if n(i, j) >= 7 and (left and right or left and opens[i] or right and opens[j + 1]):
                    want.add((words[i][0], words[j][1]))
        assert {(s, e) for _, s, e in runs(text, 7)} == want
        assert "".join(m.group() for m in UNIT.finditer(text)) == text


def test_licences(spark):
    spdx = sorted(LICENCES)[0]
    whole = f"{TITLES[spdx]}\n\n{LICENCES[spdx]}"
    rows = [(1, whole, "a"), (2, "Copyright (c) 2020 Somebody\n" + whole.upper().replace(",", " ,"), "a"), (3, None, "a"), (4, "", "a"), (5, f"code\nSPDX-License-Identifier: {spdx}\nmore", "a"), (5, f"code\nSPDX-License-Identifier: {spdx}\nmore", "a"), (6, "licence " * 100_000, "a")]
    out = scan_licences(table(spark, rows)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[1].licence == got[2].licence == spdx and got[1].text_sha256 == got[2].text_sha256
    assert got[3].licence is None and got[3].text_sha256 is None and got[3].notices == [] and got[4].licence is None
    assert got[5].notices == [spdx] and got[5].licence is None and got[6].notices == []
    assert scan_licences(table(spark, rows).limit(0)).count() == 0


def test_every_known_notice(spark):
    texts = {t.format(name): spdx for spdx in sorted(NAMES, reverse=True) for name in NAMES[spdx] for t in TEMPLATES}
    texts |= {"CC_BY  4.0": "CC-BY-4.0", "CC0 1.0 Universal Public  Domain Dedication": "CC0-1.0"}
    rows = [(i, f"code\n{x}\nmore", "a") for i, x in enumerate(texts)]
    got = {r.doc_id: r.notices for r in scan_licences(table(spark, rows)).collect()}
    assert [x for i, x in enumerate(texts) if got[i] != [texts[x]]] == []


def test_whole_texts(spark):
    assert FILES.keys() | LICENCES.keys() | set(NOTICES_ONLY) == NAMES.keys() and not FILES.keys() & LICENCES.keys()
    assert NOTICES_ONLY == ["AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0"]
    whole = sorted(FILES.items()) + [(x, "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))) for x, t in sorted(FILES.items())]
    whole += [("Apache-2.0", FILES["Apache-2.0"].partition("   APPENDIX")[0].upper()), ("GPL-3.0", FILES["GPL-3.0"].partition("How to Apply")[0])]
    got = {r.doc_id: r.licence for r in scan_licences(table(spark, [(i, t, "a") for i, (_, t) in enumerate(whole)])).collect()}
    assert [got[i] for i in range(len(whole))] == [x for x, _ in whole]
    assert scan_licences(table(spark, [(1, FILES["GPL-3.0"] + "and more", "a")])).first().licence is None


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 11 else None) for i in range(200)] + [(None, "x y", "a"), (500, None, "a"), (501, "", "only_empty"), (7, "w " * 7, "a"), (7, "w " * 7, "a"), (600, "z " * 50_000, "b")]
    docs = table(spark, rows)
    got = mix(docs, bucket_rows=8).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sorted(map(str, mix(docs, bucket_rows=8).collect())) == sorted(map(str, got))
    assert mixture(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0


def test_mixing_many_sources(spark, monkeypatch):
    from spendloom.llm import mixing

    docs = table(spark, [(i, "w " * (1 + i % 7), f"s{i % 11}" if i % 13 else None) for i in range(300)])
    want, copies = sorted(map(str, mix(docs).collect())), sorted(map(str, mixture(docs).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 0)  # joined, not broadcast
    assert sorted(map(str, mix(docs).collect())) == want and sorted(map(str, mixture(docs).collect())) == copies


def test_mixture_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4, 5)], "doc_id long, text string, source string, key int, whole int, cut int, held int, _of int")
    assert [tuple(r)[3:] for r in mixture(docs).collect()] == [(1, 2, 3, 4, 5)]


def test_licence_punctuation(spark):
    rows = [(1, "Licensed under the “MIT License”.", "a"), (2, "This project is licensed under the terms of the Apache License — Version 2.0.", "a")]
    assert [r.notices for r in sorted(scan_licences(table(spark, rows)).collect())] == [["MIT"], ["Apache-2.0"]]
