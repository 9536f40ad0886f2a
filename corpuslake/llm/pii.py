"""Personal data by candidate gradient boosting, with DataFrame operations only.

Generators with high recall propose overlapping spans of four kinds (email, ip, card, phone): the four base patterns, and
wider ones (digits in blocks or groups, phone numbers without a country code). A candidate's start is a running sum over the
pieces between matches, so nothing but the matches and a few characters beside them leaves the scan. Base spans are the
base patterns' matches that pass their checks (octets, Luhn, digits); they always stay.

Boosted trees of depth two learn from all candidates which of them lie in a base span of their kind, from features of format
(generator, digits, separators, check digit) and of context (neighbouring characters, cue words), each of a few values. Of the corpus
they need only how often each vector of features occurs, which `BINS` bounds, so every candidate counts and none is
sampled. Documents of every fourth crc32 of the id are held out: on them Platt's sigmoid makes margins probabilities, and each kind
gets the smallest threshold at which, of the held-out candidates at or above it, at least `PRECISION` lie in base spans. A candidate
outside the base spans of its kind that reaches the threshold is added: the trees see it as they see those that pass.

Null and empty texts have no spans; texts of any length are taken whole; equal spans of several generators count once, and
a span inside a base span isn't added; spans are in order of start, kind and end; repeated rows get equal results each; a null
doc_id is never held out; with an empty table, or one without base spans of a kind, nothing is added; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import fold, materialize

KINDS = ["email", "ip", "card", "phone"]

#: Kind and pattern of each generator; the first four are the base ones. Runs are possessive, as giving
#: characters back can't help them, and begin where no earlier begin is possible, so a search is linear in the text.
GENERATORS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("card", r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
#: A character without which a generator can't match.
NEEDS = ["@", ".", None, "+", None, None, None]
#: Words that announce a kind.
CUES = {"email": ["mail", "contact"], "ip": ["ip", "host", "server", "addr"], "card": ["card", "visa", "credit", "iban"], "phone": ["phone", "tel", "call", "mobile", "fax"]}
#: Characters beside a candidate that its features see.
BESIDE = 24
#: Features and how many values each has: their product bounds the vectors that reach the driver.
BINS = {"gen": 7, "digits": 6, "parts": 5, "check": 3, "before": 5, "after": 5, "cue": 3}
#: Share of held-out candidates at or above a kind's threshold that must lie in base spans.
PRECISION = 0.9
ROUNDS, RATE, SMOOTH = 24, 0.3, 1.0


# ---------------------------------------------------------------- candidates


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda k: F.ascii(F.substring(digits, n - k + 1, F.lit(1))) - 48
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, k: a + F.when(k % 2 == 0, doubled(value(k))).otherwise(value(k))) % 10 == 0


def octets(text: Column) -> Column:
    def small(part: Column) -> Column:
        shown = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(shown) <= 3, F.concat(F.lit("0"), shown).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(text, r"\."), small)


def neighbour(char: Column) -> Column:
    """0 for none, 1 for a letter of any script, 2 a digit, 3 a white space, 4 another."""
    return F.when(char == "", 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).when(char.rlike(r"\s"), 3).otherwise(4)


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found) with the matches of every generator: g, at (its number there), text, skipped (characters since the match before), before, after."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    trigger = F.col("text").rlike("[0-9@]")
    none = F.array().cast("array<string>")
    for g, (_, pattern) in enumerate(GENERATORS):
        able = trigger if NEEDS[g] is None else F.contains("text", F.lit(NEEDS[g]))
        chosen = chosen.withColumn(f"m{g}", F.when(able, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for g, (_, pattern) in enumerate(GENERATORS):
        chosen = chosen.withColumn(f"p{g}", F.when(F.size(f"m{g}") > 0, F.split("text", pattern, -1)).otherwise(none))

    def listed(g: int) -> Column:
        m, p = F.col(f"m{g}"), F.col(f"p{g}")

        def row(i: Column) -> Column:
            return F.struct(F.lit(g).alias("gen"), i.alias("at"), F.get(m, i).alias("text"), F.length(F.get(p, i)).alias("skipped"), F.right(F.get(p, i), F.lit(BESIDE)).alias("before"), F.left(F.get(p, i + 1), F.lit(BESIDE)).alias("after"))

        return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), row))

    every = F.flatten(F.filter(F.array(*map(listed, range(len(GENERATORS)))), lambda x: x.isNotNull()))
    return chosen.select("row", "doc_id", every.alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, kind, start, end, base, inside, features): inside says whether a base span of its kind holds it, held whether one of any kind does."""
    flat = found.select("row", "doc_id", F.inline("found"))
    order = Window.partitionBy("row", "gen").orderBy("at")  # the matches of one text
    ran = F.sum(F.col("skipped") + F.length("text")).over(order)
    digits = F.regexp_replace("text", "[^0-9]", "")
    n = F.length(digits)
    kind = F.get(F.array(*(F.lit(KINDS.index(k)) for k, _ in GENERATORS)), F.col("gen"))
    placed = flat.repartition("row").select("row", "doc_id", "gen", kind.alias("kind"), "text", "before", "after", ran.cast("long").alias("end"), (ran - F.length("text")).cast("long").alias("start"), digits.alias("d"), n.alias("n"))
    is_card, is_ip = F.col("kind") == KINDS.index("card"), F.col("kind") == KINDS.index("ip")
    good = F.when(is_card, F.when(F.col("n").between(12, 19), luhn(F.col("d"))).otherwise(False)).when(is_ip, octets(F.col("text"))).when(F.col("kind") == KINDS.index("phone"), F.col("n").between(9, 15)).otherwise(True)
    checked = placed.withColumn("good", good).withColumn("base", (F.col("gen") < 4) & F.col("good"))
    said = F.lower("before")
    cue = F.lit(0)
    for k, words in CUES.items():
        named = said.rlike("|".join(words))
        cue = F.when(named & (F.col("kind") == KINDS.index(k)), 2).when((cue == 0) & named, 1).otherwise(cue)
    inner = F.regexp_replace("text", "[A-Za-z0-9]", "")
    features = {
        "gen": F.col("gen"),
        "digits": F.when(F.col("n") <= 6, 0).when(F.col("n") <= 9, 1).when(F.col("n") <= 11, 2).when(F.col("n") <= 13, 3).when(F.col("n") <= 16, 4).otherwise(5),
        "parts": F.when(inner == "", 0).when(inner.rlike(r"^\x20+$"), 1).when(inner.rlike("^-+$"), 2).when(inner.rlike(r"^\.+$"), 3).otherwise(4),
        "check": F.when(is_card | is_ip, F.when(F.col("good"), 1).otherwise(2)).otherwise(0),
        "before": neighbour(F.right("before", F.lit(1))),
        "after": neighbour(F.left("after", F.lit(1))),
        "cue": cue,
    }
    # a base span that begins earlier, or here and ends later, comes first
    before = [F.col("start"), F.col("end").desc()]
    own, any_kind = (Window.partitionBy(*by).orderBy(*before) for by in (("row", "kind"), ("row",)))  # equal spans count together
    reach = F.max(F.when(F.col("base"), F.col("end")))
    return checked.select(
        "row", "doc_id", fold("doc_id", 3, 4).alias("held_out"), "kind", "start", "end", "base",
        F.coalesce(reach.over(own) >= F.col("end"), F.lit(False)).alias("inside"), F.coalesce(reach.over(any_kind) >= F.col("end"), F.lit(False)).alias("held"),
        *(c.cast("int").alias(f"f_{k}") for k, c in features.items()),
    )


# ---------------------------------------------------------------- boosted trees


@dataclass
class Model:
    """Trees of (test, (test, leaf, leaf), (test, leaf, leaf)), where a test is a feature and a value to equal."""

    start: float
    trees: list[tuple]
    slope: float
    shift: float
    thresholds: dict[int, float]

    def margin(self, x: dict[str, int]) -> float:
        return self.start + sum(leaf_of(t, x) for t in self.trees)

    def probability(self, x: dict[str, int]) -> float:
        return sigmoid(self.slope * self.margin(x) + self.shift)

    def column(self) -> Column:
        """The calibrated probability of a row with the features f_*."""

        def branch(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(f"f_{t[0][0]}") == t[0][1], branch(t[1])).otherwise(branch(t[2]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + branch(t)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def leaf_of(t, x: dict[str, int]) -> float:
    while isinstance(t, tuple):
        t = t[1] if x[t[0][0]] == t[0][1] else t[2]
    return t


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def counts(found: DataFrame) -> list[tuple[dict[str, int], int, bool, int, int]]:
    """(features, kind, held_out, candidates, of them inside) for each vector that occurs: at most as many rows as BINS has vectors, twice."""
    names = [f"f_{k}" for k in BINS]
    rows = found.groupBy(*names, "kind", "held_out").agg(F.count("*").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("good")).collect()
    return sorted((tuple((k, r[f"f_{k}"]) for k in BINS), r.kind, r.held_out, r.n, r.good) for r in rows)


def best_test(rows: list[tuple]) -> tuple | None:
    """The test (feature, value) that lowers the loss of rows (features, gradient, hessian) most; of ties the first by name."""
    sums: dict[tuple[str, int], list[float]] = {}
    all_g, all_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for x, g, h in rows:
        for test in x.items():
            s = sums.setdefault(test, [0.0, 0.0])
            s[0] += g
            s[1] += h
    gain = lambda g, h: g * g / (h + SMOOTH)
    rated = [(gain(g, h) + gain(all_g - g, all_h - h) - gain(all_g, all_h), test) for test, (g, h) in sums.items()]
    rated = [r for r in rated if r[0] > 1e-9]
    return min(rated, key=lambda r: (-round(r[0], 9), r[1]))[1] if rated else None


def tree(rows: list[tuple], depth: int):
    test = best_test(rows) if depth else None
    if test is None:
        return -RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + SMOOTH)
    yes, no = ([r for r in rows if (r[0][test[0]] == test[1]) == side] for side in (True, False))
    return test, tree(yes, depth - 1), tree(no, depth - 1)


def fitted(table: list[tuple]) -> Model:
    """Trees from the counted vectors that aren't held out, calibrated on those that are; on all where a side has none of a class."""
    def part(held: bool) -> list[tuple[dict[str, int], int, int, int]]:
        return [(dict(x), kind, n, good) for x, kind, out, n, good in table if out == held]

    def mixed(rows: list[tuple]) -> bool:
        return 0 < sum(r[3] for r in rows) < sum(r[2] for r in rows)

    every = part(True) + part(False)
    if not mixed(every):
        return Model(0.0, [], 1.0, 0.0, {})
    learn, hold = (p if mixed(p) else every for p in (part(False), part(True)))
    share = sum(r[3] for r in learn) / sum(r[2] for r in learn)
    model = Model(math.log(share / (1 - share)), [], 1.0, 0.0, {})
    margins = [model.start] * len(learn)
    for _ in range(ROUNDS):
        rows = []
        for (x, _, n, good), m in zip(learn, margins):
            p = sigmoid(m)
            rows.append((x, n * p - good, n * p * (1 - p)))
        t = tree(rows, 2)
        model.trees.append(t)
        margins = [m + leaf_of(t, r[0]) for m, r in zip(margins, learn)]
    model.slope, model.shift = platt([(model.margin(x), n, good) for x, _, n, good in hold])
    for kind in range(len(KINDS)):
        rated = sorted(((model.probability(x), n, good) for x, k, n, good in hold if k == kind), reverse=True)
        n_all = n_good = 0
        for i, (p, n, good) in enumerate(rated):
            n_all, n_good = n_all + n, n_good + good
            if n_good >= PRECISION * n_all and (i + 1 == len(rated) or rated[i + 1][0] < p) and n_good:
                model.thresholds[kind] = p * (1 - 1e-12)
    return model


def platt(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits counts of (margin, candidates, good ones), by Newton's method with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = 1e-3 * (a - 1), 1e-3 * b, 1e-3, 0.0, 1e-3
        for m, n, good in rows:
            p = sigmoid(a * m + b)
            g, h = n * p - good, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + g * m, gb + g, haa + h * m * m, hab + h * m, hbb + h
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))  # no step beyond 1
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


# ---------------------------------------------------------------- the operator


def scored(found: DataFrame, model: Model) -> DataFrame:
    """found with p, the calibrated probability, and chosen: base spans, and others outside of them that reach their kind's threshold."""
    limit = F.get(F.array(*(F.lit(model.thresholds.get(k, 2.0)) for k in range(len(KINDS)))), F.col("kind"))
    rated = found.withColumn("p", model.column())
    return rated.withColumn("chosen", F.col("base") | ((F.col("p") >= limit) & ~F.col("held")))


def spans(found: DataFrame, rated: DataFrame) -> DataFrame:
    """Per row of found: doc_id, numbers of base spans by kind, base_sha256 and spans."""
    name = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "kind", "end")
    per = rated.filter("chosen").groupBy("row").agg(  # the spans of one text
        F.first("doc_id").alias("doc_id"),
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_set(span)).alias("every"),
    )
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    numbers = [f"n_{k}" for k in KINDS]
    with_spans = per.select("row", "doc_id", *numbers, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("every")).alias("spans"))
    zero = F.lit(0).cast("long")
    without = found.join(rated.filter("chosen").select("row").distinct(), "row", "left_anti")
    rest = without.select("row", "doc_id", *(zero.alias(c) for c in numbers), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return with_spans.unionByName(rest).drop("row")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    found = materialize(matches(docs), "matches")
    every = materialize(candidates(found.filter(F.size("found") > 0)), "candidates")
    model = fitted(counts(every))
    return spans(found.select("row", "doc_id"), scored(every, model))

