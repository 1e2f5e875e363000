"""Licence scans by canonical digests of whole texts, and of the notice lines within them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import FILES, LICENCES, NAMES, TEMPLATES, TITLES, editions

#: Equivalent spellings, in the order they are applied, between single spaces.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("v2", "version 2")]
_COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: ASCII but letters and digits, no-break space, angle quotes, dashes, curly quotes, bullet, ellipsis, ideographic space and stops.
_OTHER = r"[\x01-\x2F\x3A-\x60\x7B-\x7F\u00A0\u00AB\u00BB\u2010-\u2015\u2018-\u201F\u2022\u2026\u3000-\u3002]+".encode().decode("raw_unicode_escape")


def canonical(text: Column) -> Column:
    """Lower case, copyright lines dropped, punctuation (also curly quotes and dashes) and spaces as one space, spellings made equal."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, "\n"), _OTHER, " ")
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for was, now in SPELLINGS:
        x = F.replace(x, F.lit(f" {was} "), F.lit(f" {now} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def canonical_text(text: str) -> str:
    x = re.sub(_OTHER, " ", re.sub(_COPYRIGHT, "\n", text.lower()))
    x = f" {x} "
    for was, now in SPELLINGS:
        x = x.replace(f" {was} ", f" {now} ")
    return re.sub(" +", " ", x).strip(" ")


def known() -> list[tuple[str, str]]:
    """(digest, licence): full texts, and notices made from templates and names. A constant, whatever the corpus."""
    texts = [(x, spdx) for spdx, text in LICENCES.items() for x in (text, f"{TITLES[spdx]}\n\n{text}")]
    texts += [(x, spdx) for spdx, text in FILES.items() for x in editions(text)]
    for spdx, names in NAMES.items():
        texts += [(t.format(name), spdx) for name in names for t in TEMPLATES] + [(f"SPDX-License-Identifier: {spdx}", spdx)]
    out = {}
    for text, spdx in texts:
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), spdx)
    return sorted(out.items())


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs with text_sha256 (of the canonical whole text), licence (of a whole text that is a known one) and notices.

    notices: the sorted distinct licences of lines that are known notices; every
    line is hashed. Whole texts are hash-joined to the digests, a constant table; nothing is shuffled.
    Nulls: a null text has null digest and licence and no notices. An empty text
    has the digest of ''. Repeated rows each get their result; a text that two
    names share goes to the first in code-point order. Other columns stay; ones
    that are named like the results are replaced.
    """
    spark = docs.sparkSession
    pairs = known()
    digests = spark.createDataFrame(pairs, "text_sha256 string, licence string")
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.sha2(canonical(x), 256))
    seen = F.filter(lines, lambda x: x.isin([digest for digest, _ in pairs]))  # a hash set; a map's keys are searched one by one
    found = F.transform(seen, lambda x: F.try_element_at(lookup, x))
    notices = F.coalesce(F.sort_array(F.array_distinct(found)), F.array().cast("array<string>"))
    base = docs.drop("text_sha256", "licence", "notices")
    return base.withColumns({"text_sha256": F.sha2(canonical(F.col("text")), 256), "notices": notices}).join(F.broadcast(digests), "text_sha256", "left")


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text_sha256", "licence", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices"))


def _sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({x}), '{_COPYRIGHT}', chr(10), 'g'), '{_OTHER}', ' ', 'g')"
    x = f"(' ' || {x} || ' ')"
    for was, now in SPELLINGS:
        x = f"replace({x}, ' {was} ', ' {now} ')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"


def op9_sql() -> str:
    values = ", ".join(f"('{d}', '{s}')" for d, s in known())
    return rf"""
WITH known(digest, licence) AS (VALUES {values}), w AS (
  SELECT doc_id, sha256({_sql("text")}) AS text_sha256 FROM documents
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), n AS (
  SELECT l.doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices, count(DISTINCT k.licence) AS n FROM l JOIN known k ON k.digest = sha256({_sql("l.line")})
  GROUP BY l.doc_id
)
SELECT w.doc_id, w.text_sha256, k.licence, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM w LEFT JOIN known k ON k.digest = w.text_sha256 LEFT JOIN n ON n.doc_id = w.doc_id
"""
