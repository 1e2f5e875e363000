"""PII by candidate gradient boosting, in DataFrame functions alone.

Base patterns give spans that always stay. Wider generators propose further,
overlapping spans; boosted trees score them by their format and context, and
those over their kind's calibrated threshold are added. The trees are fitted on
made-up labelled lines (training_lines), their features computed by the same
expressions as the corpus's, and become one SQL expression. Each row is handled
by itself: nothing is shuffled, broadcast or sent to Python. The work on a text
with n spans grows as n log n: places come from running sums of lengths (running),
and context is read from parts of PART code points, not from the text's start.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Possessive and guarded forms of the base patterns; they match the same spans. \G: where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: High-recall generators: pattern, the kind proposed, and what a text must hold for it to be tried.
GENERATORS = [
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?@ ?| ?[(\[] ?[aA][tT] ?[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[] ?[dD][oO][tT] ?[)\]] ?)[A-Za-z0-9-]++)++", "email", r"@|[(\[] ?[aA][tT] ?[)\]]"),
    (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3})(?![0-9A-Za-z:])", "ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9](?: |[(\[])\."),
    (r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){9,24}(?![0-9])", "card", r"[0-9]{4}"),
    (r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])", "phone", r"[0-9]{3}"),
    (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+", "secret", r"[0-9]"),
]
FEATURES = ["kind", "length", "digits", "letters", "upper", "separators", "colons", "groups", "luhn", "hex", "secret_word", "card_word", "phone_word", "mail_word", "other_word", "assigned", "quoted", "word_before", "word_after"]
TREES, DEPTH, RATE = 40, 3, 0.3
#: Share of true spans among those over a threshold, on held-out lines.
PRECISION = 0.99


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(worth(i), F.lit(0)))
    return total % 10 == 0


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_NONE = "array<struct<start:int,kind:int,end:int,m:string>>"
_POWERS = [1 << i for i in range(31)]
#: Code points of a part of a text.
PART = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running op over an array: each of log2(n) passes takes in the element twice as far back."""
    steps = F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < F.size(values))

    def one(s: Column, p: Column) -> Column:
        return F.transform(s, lambda x, i: F.when(i >= p, op(x, F.get(s, i - p))).otherwise(x))

    return F.aggregate(steps, values, one)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start,kind,end,m>>: the matches with their places, from the pieces between them."""

    def placed(m: Column, ends: Column) -> Column:
        return F.zip_with(m, ends, lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("m")))

    def from_matches(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        steps = F.zip_with(gaps, m, lambda g, x: F.length(g) + F.length(x))
        return F.when(F.size(m) > 0, let(steps, lambda s: placed(m, running(s, _plus))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_matches)


def parts_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, from the parts that hold them."""
    start, end = start.cast("int"), F.greatest(start, end).cast("int")
    first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
    head = F.coalesce(F.get(parts, first), F.lit(""))
    at, to = start % PART, end % PART
    inside = F.substring(head, at + 1, end - start)
    middle = F.array_join(F.slice(parts, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    across = F.concat(F.substring(head, at + 1, F.lit(PART)), middle, F.substring(F.coalesce(F.get(parts, last), F.lit("")), F.lit(1), to))
    return F.when(first == last, inside).otherwise(across)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""

    def card(m: Column) -> Column:
        digits = _only_digits(m)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)

    tests = [
        (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        (CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), card),
        (PHONE, text.contains("+"), lambda m: F.length(_only_digits(m)).between(10, 15)),
    ]
    empty = F.array().cast(_NONE)

    def passing(k: int, pattern: str, test) -> Column:
        return F.filter(_found(text, pattern, k), lambda x: test(x["m"]))

    parts = [F.when(has, passing(k, pattern, test)).otherwise(empty) for k, (pattern, has, test) in enumerate(tests)]
    return F.sort_array(F.concat(*[F.coalesce(p, empty) for p in parts]))


def apart(found: Column, base: Column) -> Column:
    """The found spans that overlap no base span, by start."""
    most = F.lit((1 << 31) - 1)
    union = F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), b.alias("span"))), F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"), c.alias("span"))))

    def kept(u: Column) -> Column:
        ended = running(F.transform(u, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(u, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(most))), F.least))

        def free(e: Column) -> Column:
            return let(begins, lambda b: F.filter(u, lambda x, i: (x["own"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(b, i) >= x["end"])))

        return F.sort_array(F.transform(let(ended, free), lambda x: x["span"]))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), F.sort_array(found)).otherwise(let(F.sort_array(union), kept))


def joined(found: Column) -> Column:
    """Overlapping spans (start, kind, end, p), sorted by start, as one: from the first start to the last end, of the likeliest one's kind (ties: the kind listed first)."""

    def from_ends(ends: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["start"] >= F.get(ends, i - 1)))

        def groups(o: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                last = F.coalesce(F.get(o, k + 1), F.size(found)) - 1
                best = F.array_max(F.transform(F.slice(found, at + 1, last - at + 1), lambda x: F.struct(x["p"], (-x["kind"]).alias("least"))))
                return F.struct(F.get(found, at)["start"].alias("start"), (-best["least"]).alias("kind"), F.get(ends, last).alias("end"))

            return F.transform(o, one)

        return let(opens, groups)

    return F.when(F.size(found) > 0, let(running(F.transform(found, lambda x: x["end"]), F.greatest), from_ends))


def candidates(text: Column) -> Column:
    empty = F.array().cast(_NONE)
    parts = [F.when(text.rlike(has), _found(text, pattern, KINDS.index(kind))).otherwise(empty) for pattern, kind, has in GENERATORS]
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _features(parts: Column, c: Column) -> dict[str, Column]:
    m, before = c["m"], F.lower(cut(parts, F.greatest(F.lit(0), c["start"] - 24), c["start"]))
    after = cut(parts, c["end"], c["end"] + 8)
    digits = _only_digits(m)
    has = lambda words: before.rlike(rf"(?:{words})[^a-z0-9]*(?:is|no|number|nr)?[^a-z0-9]*$").cast("int")
    return {
        "kind": c["kind"], "length": F.length(m), "digits": F.length(digits), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "upper": F.length(F.regexp_replace(m, "[^A-Z]", "")),
        "separators": F.length(F.regexp_replace(m, r"[^\x20().\[\]/-]", "")), "colons": F.length(F.regexp_replace(m, "[^:]", "")), "groups": F.size(F.split(m, r"[^0-9]+")),
        "luhn": F.when(F.length(digits).between(12, 19), _luhn(digits).cast("int")).otherwise(0), "hex": m.rlike("^[0-9a-fA-F]+$").cast("int"),
        "secret_word": has("token|secret|password|passwd|api_?key|key|auth|bearer|credential"), "card_word": has("card|visa|account|iban|payment|credit"), "phone_word": has("phone|tel|call|mobile|fax|contact|cell"),
        "mail_word": has("mail|contact|write to|reach"), "other_word": has("commit|sha[0-9]*|md5|hash|version|build|isbn|order|invoice|id|uuid|revision|issue|page|date|ticket|part"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"), "word_before": before.rlike(r"[a-z0-9._]$").cast("int"), "word_after": after.rlike(r"^(?:[A-Za-z0-9_]|\.[0-9])").cast("int"),
    }


def training_lines(n: int = 4200, seed: int = 11) -> list[tuple[str, int, int, int, bool]]:
    """(line, kind, start, end, personal): made-up spans, true ones and look-alikes, each among words."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k - 1)) + "7"
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randrange(2, 9)))

    def grouped(s: str) -> str:
        sep = r.choice(["", "", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    at, dot = lambda: r.choice([" (at) ", "(at)", " [at] ", " [AT] "]), lambda: r.choice([" (dot) ", "(dot)", " [dot] ", "."])
    makers = [
        (2, True, lambda: ("", grouped(num(16)), "")),
        (2, True, lambda: ("", num(16), "")),
        (2, True, lambda: (r.choice(["card ", "card number: ", "visa ", "account "]), grouped(num(r.choice([15, 16, 16, 19]))), "")),
        (2, False, lambda: (r.choice(["order ", "invoice ", "ticket ", "id ", ""]), num(r.choice([10, 11, 12])), "")),
        (2, False, lambda: (r.choice(["isbn ", "part ", "build "]), num(13), "")),
        (2, False, lambda: ("", f"20{num(2)}-0{r.randrange(1, 10)}-1{r.randrange(10)} 1{r.randrange(10)}-{num(2)}-{num(2)}", "")),
        (2, False, lambda: ("", " ".join(num(r.randrange(1, 4)) for _ in range(9)), "")),
        (2, False, lambda: ("", num(r.choice([20, 22, 24])), "")),
        (3, True, lambda: (r.choice(["call ", "phone: ", "tel. ", "mobile ", "fax "]), f"({num(3)}) {num(3)}-{num(4)}", "")),
        (3, True, lambda: (r.choice(["call ", "phone: ", "tel ", "contact "]), f"{num(3)}-{num(3)}-{num(4)}", "")),
        (3, True, lambda: ("", f"({num(3)}) {num(3)}-{num(4)}", "")),
        (3, False, lambda: (r.choice(["", "date ", "page "]), f"{num(2)}.{num(4)}.{num(4)}", "")),
        (3, False, lambda: (r.choice(["", "order ", "part ", "version "]), f"{num(3)} {num(3)} {num(3)}", "")),
        (3, False, lambda: ("", f"{num(4)}/{num(4)}{num(3)}", "")),
        (4, True, lambda: (r.choice(['token = "', 'secret = "', "password: '", 'api_key = "', "TOKEN = \""]), r.choice([hexes(40), hexes(32), mixed(24), mixed(32)]), "\"")),
        (4, True, lambda: (r.choice(["token: ", "key=", "Bearer ", "secret "]), r.choice([hexes(40), mixed(24), mixed(40)]), "")),
        (4, False, lambda: (r.choice(["commit ", "sha256 ", "md5: ", "revision ", "hash "]), hexes(r.choice([32, 40, 64])), "")),
        (4, False, lambda: ("", f"{word()}/{word()}/{num(2)}/{word()}-{word()}-page", "")),
        (4, False, lambda: (r.choice(["", "uuid "]), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", "")),
        (4, False, lambda: (r.choice(["", "id "]), num(r.choice([18, 20, 22])), "")),
        (0, True, lambda: (r.choice(["", "mail ", "contact "]), f"{word()}.{word()}{at()}{word()}{dot()}com".replace("é", "e"), "")),
        (0, True, lambda: ("", f"{word()}{num(2)} @ {word()}.org".replace("é", "e"), "")),
        (0, False, lambda: ("", f"{num(2)} @ {num(2)}.{num(2)}", "")),
        (0, False, lambda: ("", f"{word()} @ {num(1)}.{num(2)}".replace("é", "e"), "")),
        (1, True, lambda: (r.choice(["", "host ", "from "]), ":".join(hexes(r.choice([1, 2, 3, 4, 4, 4])) for _ in range(8)), "")),
        (1, True, lambda: (r.choice(["", "host ", "peer "]), r.choice(["[.]", "(.)"]).join(str(r.randrange(1, 255)) for _ in range(4)), "")),
        (1, False, lambda: (r.choice(["", "mac ", "time "]), ":".join(hexes(2) for _ in range(r.choice([4, 6]))), "")),
        (1, False, lambda: (r.choice(["", "ratio ", "page "]), r.choice([":", " . "]).join(num(r.choice([1, 2])) for _ in range(4)), "")),
    ]
    out = []
    for i in range(n):
        kind, true, make = makers[i % len(makers)]
        lead, span, tail = make()
        head = " ".join(word() for _ in range(r.randrange(1, 6))) + r.choice([" ", " ", ". ", "\n"]) + lead
        line = head + span + tail + r.choice([" ", ".", "###", "!!", ", ", "\n"]) + word()
        out.append((line, kind, len(head), len(head) + len(span), true))
    return out


class Trees:
    """Boosted regression trees for a yes or no, on whole-number features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.bias = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        self.trees: list = []
        f = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += self._one(tree, x)

    def _grow(self, x, g, h, rows, depth):
        leaf = float(RATE * g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None)
        if depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j in range(x.shape[1]):
                order = rows[np.argsort(x[rows, j], kind="stable")]
                v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, int(v[cut[k]])))
        if best[1] is None:
            return leaf
        j, t = best[1]
        left = x[rows, j] <= t
        return j, t, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    def _one(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, t, a, b = tree
        return np.where(x[:, j] <= t, self._one(a, x), self._one(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._one(t, x) for t in self.trees)

    def column(self, at: Column) -> Column:
        """The margin as an expression over a struct of features."""

        def one(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            j, t, a, b = tree
            return F.when(at[FEATURES[j]] <= t, one(a)).otherwise(one(b))

        return reduce(lambda a, b: a + b, map(one, self.trees), F.lit(self.bias))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps."""
    w, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * (w - [1, 0]))
    return float(w[0]), float(w[1])


class Model:
    def __init__(self, trees: Trees, a: float, b: float, thresholds: list[float]):
        self.trees, self.a, self.b, self.thresholds = trees, a, b, thresholds

    def probability(self, at: Column) -> Column:
        return 1 / (1 + F.exp(-(self.trees.column(at) * self.a + self.b)))


_fitted: Model | None = None


def _personal(line: tuple[str, int, int, int, bool], kind: int, start: int, end: int) -> bool:
    """Whether a candidate holds the whole personal span of its line, and at most half as much again."""
    return line[4] and line[1] == kind and start <= line[2] and end >= line[3] and 2 * (end - start) <= 3 * (line[3] - line[2])


def fit(spark: SparkSession) -> Model:
    """Trees on one third of the made-up lines, scaling on the second, each kind's threshold on the last."""
    global _fitted
    if _fitted is None:
        lines = training_lines()
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        made = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {quote(x[0])})" for i, x in enumerate(lines)) + " AS t(i, text)")
        text = F.col("text")
        parts = made.select("i", F.explode(candidates(text)).alias("c"), parts_of(text).alias("parts"))
        rows = parts.select("i", "c.start", "c.end", *[v.cast("int").alias(k) for k, v in _features(F.col("parts"), F.col("c")).items()]).collect()
        x = np.array([[r[k] for k in FEATURES] for r in rows])
        y = np.array([float(_personal(lines[r.i], r.kind, r.start, r.end)) for r in rows])
        third = np.array([r.i // 28 % 3 for r in rows])
        trees = Trees(x[third == 0], y[third == 0])
        margin = trees.margin(x)
        a, b = calibrate(margin[third == 1], y[third == 1])
        p, thresholds = 1 / (1 + np.exp(-(a * margin + b))), []
        for k in range(len(KINDS)):
            mine = (third == 2) & (x[:, 0] == k)
            scores, truth = p[mine], y[mine]
            fit_ = [t for t in np.unique(scores) if truth[scores >= t].mean() >= PRECISION]
            thresholds.append(max(0.5, float(min(fit_))) if fit_ else 2.0)
        _fitted = Model(trees, a, b, thresholds)
    return _fitted


def _with_spans(docs: DataFrame, model: Model, base: str, spans: str) -> DataFrame:
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text, found = F.col("text"), free_name(docs, "found")
    d = docs.withColumns({base: F.coalesce(base_spans(text), F.array().cast(_NONE)), found: F.coalesce(candidates(text), F.array().cast(_NONE))})
    d = d.withColumn(found, apart(F.col(found), F.col(base)))
    limit = F.array(*map(F.lit, model.thresholds))
    feature = lambda parts: lambda c: F.struct(c["start"], c["kind"], c["end"], F.struct(*[v.cast("int").alias(k) for k, v in _features(parts, c).items()]).alias("x"))
    d = d.withColumn(found, F.when(F.size(found) > 0, let(parts_of(text), lambda parts: F.transform(found, feature(parts)))))
    d = d.withColumn(found, F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), model.probability(c["x"]).alias("p"))))
    d = d.withColumn(found, F.filter(found, lambda c: c["p"] >= F.element_at(limit, c["kind"] + 1)))
    d = d.withColumn(base, F.transform(base, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return d.withColumn(spans, F.sort_array(F.concat(base, F.coalesce(joined(F.col(found)), empty)))).drop(found)


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """docs with base and spans: arrays of (start, kind, end), by start, then kind.

    spans holds the base spans and the added ones. A candidate that overlaps a
    base span isn't added; overlapping candidates over their thresholds are one
    span, of the likeliest one's kind (ties: the kind listed first). A null or
    empty text has none. Texts are read whole. Repeated rows and null ids are
    handled alike. Other columns stay; ones named base or spans are replaced.
    Empty table: no rows.
    """
    return _with_spans(docs.drop("base", "spans"), model, "base", "spans")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span of its text replaced by the kind in brackets; overlapping spans fall to one bracket, of the first one's kind.

    A null or empty text stays. Other columns stay as they are, whatever their
    names. Repeated rows are handled alike. Empty table: no rows.
    """
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, base, spans = F.col("text"), free_name(docs, "base"), free_name(docs, "spans")

    def pieces(parts: Column) -> Column:
        def from_ends(ends: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                before = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
                return F.when(x["start"] >= before, F.concat(cut(parts, before, x["start"]), F.element_at(tags, x["kind"] + 1))).otherwise("")

            rest = cut(parts, F.element_at(ends, -1), F.length(text))
            return F.concat(F.array_join(F.transform(spans, one), ""), rest)

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), from_ends)

    found = _with_spans(docs, model, base, spans)
    return found.withColumn("text", F.when(F.size(spans) > 0, let(parts_of(text), pieces)).otherwise(text)).select(*docs.columns)


def named(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), fit(spark))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))
