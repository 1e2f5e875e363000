"""Line diffs of pairs of texts: the longest common lines, unified hunks, their application, and the choice between diff and rewrite.

A pair is one row and its diff one row, so pairs spread over tasks as they come.
Common ends are set aside first. What is left is compared by dynamic programming
a line at a time over arrays, if its table has at most max_cells; a larger one is
cut at lines that both sides have once (the longest run of them in one order on
both sides), and a stretch between two that is still too large is taken as
replaced. So work is bounded, and applying a diff always gives the new text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import Tokens, quarter

#: Lines of context; cells of a table; share of changed lines from which a rewrite is taken; what a diff may cost of a rewrite.
CONTEXT, MAX_CELLS, CHANGED, SAVING = 3, 25_000_000, 0.5, 0.95
LINE = re.compile(r"[^\n]*\n|[^\n]+")
HEADER = re.compile(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@\n")
NO_END = "\\ No newline at end of file\n"

Pairs = list[tuple[int, int]]


def lines_of(text: str) -> list[str]:
    """Lines with their ends; the last may have none."""
    return LINE.findall(text)


def common(a: np.ndarray, b: np.ndarray) -> Pairs:
    """A longest common subsequence as pairs of places. Where two are as long, the one that leaves out lines of a first."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(b == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def anchors(a: np.ndarray, b: np.ndarray) -> Pairs:
    """Places of lines that both sides have once: the longest run in one order on both."""
    once = lambda x: {v: i for i, v in enumerate(x.tolist()) if counts[v] == 1}
    counts = Counter(a.tolist())
    left = once(a)
    counts = Counter(b.tolist())
    right = once(b)
    both = sorted((i, right[v]) for v, i in left.items() if v in right)
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(both)
    for k, (_, j) in enumerate(both):
        p = bisect_left(tails, j)
        before[k] = at[p - 1] if p else -1
        tails[p : p + 1], at[p : p + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def matched(a: list[str], b: list[str], max_cells: int = MAX_CELLS) -> tuple[Pairs, bool]:
    """Pairs of places whose lines stay, and whether they are a longest common subsequence."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(s, len(ids)) for s in side], np.int64) for side in (a, b))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    exact = len(p) * len(q) <= max_cells
    if exact:
        middle = common(p, q)
    else:
        middle, i, j = [], 0, 0
        for k, m in [*anchors(p, q), (len(p), len(q))]:
            if (k - i) * (m - j) <= max_cells:
                middle += [(i + s, j + t) for s, t in common(p[i:k], q[j:m])]
            if k < len(p):
                middle.append((k, m))
            i, j = k + 1, m + 1
    ends = [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + [(head + s, head + t) for s, t in middle] + ends, exact


def unified(a: list[str], b: list[str], kept: Pairs, context: int = CONTEXT) -> str:
    """Hunks with context lines around changes; changes at most twice the context apart share one."""
    changes, i, j = [], 0, 0
    for k, m in [*kept, (len(a), len(b))]:
        if k > i or m > j:
            changes.append((i, k, j, m))
        i, j = k + 1, m + 1
    out: list[str] = []
    while changes:
        n = 1
        while n < len(changes) and changes[n][0] - changes[n - 1][1] <= 2 * context:
            n += 1
        some, changes = changes[:n], changes[n:]
        lead, trail = min(context, some[0][0], some[0][2]), min(context, len(a) - some[-1][1], len(b) - some[-1][3])
        a0, a1, b0, b1 = some[0][0] - lead, some[-1][1] + trail, some[0][2] - lead, some[-1][3] + trail
        out.append(f"@@ -{a0 + (a1 > a0)},{a1 - a0} +{b0 + (b1 > b0)},{b1 - b0} @@\n")
        at = a0
        for i, k, j, m in some:
            out += [_marked(" ", s) for s in a[at:i]] + [_marked("-", s) for s in a[i:k]] + [_marked("+", s) for s in b[j:m]]
            at = k
        out += [_marked(" ", s) for s in a[at:a1]]
    return "".join(out)


def _marked(mark: str, line: str) -> str:
    return f"{mark}{line}" if line.endswith("\n") else f"{mark}{line}\n{NO_END}"


def applied(text: str, diff: str) -> str | None:
    """The text after a unified diff; None if it doesn't fit."""
    a, out, at, rows = lines_of(text), [], 0, lines_of(diff)
    r = 0
    while r < len(rows):
        if not (m := HEADER.fullmatch(rows[r])):
            return None
        start, n, _, made = map(int, m.groups())
        start -= n > 0
        r += 1
        if start < at or start > len(a):
            return None
        out += a[at:start]
        at, used, written = start, 0, 0
        while used < n or written < made:
            if r >= len(rows) or rows[r][0] not in " +-" or not rows[r].endswith("\n"):
                return None
            mark, line = rows[r][0], rows[r][1:]
            r += 1
            if r < len(rows) and rows[r] == NO_END:
                line, r = line[:-1], r + 1
            if mark != "+":
                if at >= len(a) or a[at] != line:
                    return None
                at, used = at + 1, used + 1
            if mark != "-":
                out.append(line)
                written += 1
    return "".join(out + a[at:])


FIELDS = T.StructType([T.StructField(n, t) for n, t in (("kept", T.LongType()), ("removed", T.LongType()), ("added", T.LongType()), ("change_ratio", T.DoubleType()), ("exact", T.BooleanType()), ("verified", T.BooleanType()), ("diff_tokens", T.LongType()), ("rewrite_tokens", T.LongType()), ("diff", T.StringType()))])


def diffs(pairs: DataFrame, before: str, after: str, max_cells: int = MAX_CELLS, context: int = CONTEXT, tokens: Tokens = quarter) -> DataFrame:
    """pairs with kept, removed, added (lines), change_ratio, exact, verified (the diff, applied, gives the new text), diff_tokens, rewrite_tokens, diff.

    Null texts count as empty. Equal texts have an empty diff. Columns of pairs
    with these names are replaced. Empty table: no rows.
    """
    base = pairs.drop(*FIELDS.names)
    x, y = base.columns.index(before), base.columns.index(after)

    def one(old: str, new: str) -> tuple:
        a, b = lines_of(old), lines_of(new)
        kept, exact = matched(a, b, max_cells)
        diff = unified(a, b, kept, context)
        most = max(len(a), len(b))
        return len(kept), len(a) - len(kept), len(b) - len(kept), 1 - len(kept) / most if most else 0.0, exact, applied(old, diff) == new, tokens(diff), tokens(new), diff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = list(zip(*[one(o or "", n or "") for o, n in zip(some.column(x).to_pylist(), some.column(y).to_pylist())]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([*some.columns, *(pa.array(c, k) for c, k in zip(found, kinds))], names=[*some.schema.names, *FIELDS.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *FIELDS.fields]))


def choices(found: DataFrame, changed: float = CHANGED, saving: float = SAVING) -> DataFrame:
    """diffs with choice, reason, saved_tokens, saved_share: a diff is taken if it is verified and exact, changes less than a share of lines, and costs at most a share of the rewrite."""
    d, r = F.col("diff_tokens"), F.col("rewrite_tokens")
    reason = (
        F.when((F.col("removed") == 0) & (F.col("added") == 0), "identical").when(~F.col("exact"), "too large").when(~F.col("verified"), "unverified")
        .when(F.col("change_ratio") >= changed, "mostly changed").when((d <= r * saving) & (d < r), "cheaper").when(d >= r, "not smaller").otherwise("saves too little")
    )
    taken = F.col("reason") == "cheaper"
    out = found.withColumn("reason", reason).withColumn("choice", F.when(taken, "diff").otherwise("rewrite"))
    return out.withColumns({"saved_tokens": F.when(taken, r - d).otherwise(0), "saved_share": F.when(taken, (r - d) / r).otherwise(0.0)})


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation and the one before it, a word a line."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").select("conv_id", "turn", F.translate("text", " ", "\n").alias("text"))
    last = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return last.join(c.withColumnRenamed("text", "new"), ["conv_id", "turn"])


def t21_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs(_turns(spark, sf_dir), "old", "new").select("conv_id", "turn", "kept", "removed", "added", F.round("change_ratio", 9).alias("change_ratio"), "verified", "rewrite_tokens")


def f40_diff_or_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against what they become with every seventh line dropped and every eleventh said again."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.col("text").alias("old"))
    edited = F.filter(F.transform(F.split("old", "\n"), lambda x, i: F.when(i % 7 == 6, None).when(i % 11 == 10, F.concat(x, F.lit("\n"), x)).otherwise(x)), lambda x: x.isNotNull())
    found = choices(diffs(d.withColumn("new", F.array_join(edited, "\n")), "old", "new"))
    return found.select("doc_id", "choice", "reason", "kept", "removed", "added", "diff_tokens", "rewrite_tokens", "saved_tokens")


QUERIES = {f.__name__: f for f in (t21_line_diff, f40_diff_or_rewrite)}
#: The length of the longest common subsequence by rows of prefixes, from the front; the operator works from the back. f40's token counts need the hunks: it is tested against plain Python.
ORACLE_SQL = {
    "t21_line_diff": """WITH RECURSIVE t AS (SELECT conv_id, turn, string_split(text, ' ') AS words, text FROM conversations WHERE text IS NOT NULL),
        l AS (SELECT conv_id, turn, text, CASE WHEN text = '' THEN [] ELSE list_filter(string_split(replace(replace(text, ' ', chr(10)), chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') END AS lines FROM t),
        p AS (SELECT b.conv_id, b.turn, a.lines AS a, b.lines AS b, b.text FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
        r AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS d FROM p
          UNION ALL SELECT conv_id, turn, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS INTEGER)]), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j[1]] THEN d[j[1]] + 1 ELSE greatest(acc[-1], d[j[1] + 1]) END), [0]) FROM r WHERE i < len(a)),
        k AS (SELECT conv_id, turn, len(a) AS n, len(b) AS m, d[-1] AS kept FROM r WHERE i = len(a))
        SELECT k.conv_id, k.turn, CAST(kept AS BIGINT) AS kept, CAST(n - kept AS BIGINT) AS removed, CAST(m - kept AS BIGINT) AS added, CASE WHEN greatest(n, m) = 0 THEN 0e0 ELSE round(1 - CAST(kept AS DOUBLE) / greatest(n, m), 9) END AS change_ratio, true AS verified, CAST(ceil(length(text) / 4e0) AS BIGINT) AS rewrite_tokens FROM k JOIN p USING (conv_id, turn)""",
}
