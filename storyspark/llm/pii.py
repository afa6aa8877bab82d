"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Patterns propose spans of whole texts. On each, four labelers vote for (1), against (-1) or abstain (0): the
strict format with its checks, a gazetteer (domain endings, issuers, reserved networks, country codes, names of
secrets), the words before the span, and its shape. Votes are counted per kind and vote pattern; a pattern is four
votes, so the counts are a few hundred rows at any size, and the driver estimates from them each labeler's
reliability and each pattern's chance of being personal data. A logistic classifier over votes and kind is trained on
these chances and applied to every span as a column expression. Spans of the base kinds that pass their checks stay in
any case; the classifier adds others that do not overlap them.

All of it is done by columns inside a row: one pass to count votes, one to decide. Nothing is shuffled but counts.

Cases: a null text is empty; ties do not arise, since spans of a kind never overlap and kinds have an order; repeated
rows are treated alike; very long texts are scanned whole, each pattern in linear time; an empty table gives no rows;
other columns are carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_phone", "secret", "ssn")
#: Base patterns. A start is tried only where a run begins or the last match ended, and runs are not given back: the same
#: matches as the plain patterns have, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national_phone": r"(?<![0-9+.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_.=-]{8,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]{2}|[0-9][\\x20-][0-9]", "phone": "\\+[0-9]", "national_phone": "[0-9]{4}",
          "secret": "[:=]", "ssn": "-[0-9]{4}"}
CUES = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|pay|credit", "phone": "phone|tel|call|mobile|fax",
    "national_phone": "phone|tel|call|mobile|fax", "secret": "login|user|config|key", "ssn": "ssn|social|security",
}
AGAINST = "(version|release|order|invoice|isbn|page|figure|no\\.|#)\\W*$"
CONTEXT = 24
VOTES = ("format", "gazetteer", "context", "shape")
SPANS = "array<struct<k:int,kind:string,start:int,end:int,base:boolean,votes:struct<format:int,gazetteer:int,context:int,shape:int>>>"
_BLOCK = 64


def _positions(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping, as (start, end, t); the text between them gives their places."""
    made = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def place(m: Column) -> Column:
        sizes = F.transform(m["found"], lambda x, i: F.length(x) + F.length(F.get(m["gaps"], i)))
        # sums over blocks, so that many matches in a text cost little more than their number
        return F.element_at(F.transform(F.array(F.struct(sizes.alias("s"), F.transform(
            F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))).alias("b"))),
            lambda p: F.transform(m["found"], lambda x, i: _span(m, p, x, i))), 1)

    return F.element_at(F.transform(F.array(made), place), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _span(m: Column, p: Column, x: Column, i: Column) -> Column:
    b = F.floor(i / _BLOCK).cast("int")
    start = _sum(F.slice(p["b"], F.lit(1), b)) + _sum(F.slice(p["s"], b * _BLOCK + 1, i % _BLOCK)) + F.length(F.get(m["gaps"], i))
    return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("t"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(
        F.transform(F.array(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)), lambda v: F.when(v > 9, v - 9).otherwise(v)), 1))
    return _sum(doubled) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    """The checks of the base kinds."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "ip":
        return t.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _votes(kind: str, t: Column, before: Column) -> dict[str, Column]:
    """-1, 0 or 1 per labeler."""
    n = F.length(F.regexp_replace(t, "[^0-9]", ""))
    says = lambda yes, no=F.lit(False): F.when(no, -1).when(yes, 1).otherwise(0)
    context = says(before.rlike(f"(?i)({CUES[kind]})"), before.rlike(f"(?i){AGAINST}"))
    valid = _valid(kind, t)
    gazetteer, shape = F.lit(0), F.lit(0)
    if kind == "email":
        gazetteer = says(t.rlike(r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"), t.rlike(r"\.[0-9-]+$"))
        shape = says(F.length(t) < 80, t.rlike(r"\.\.|^\.|\.@"))
    elif kind == "ip":
        gazetteer = says(F.lit(True), t.rlike(r"^(0|10|127|169|192|22[4-9]|2[3-5][0-9])\."))
        shape = says(~t.rlike(r"(^|\.)0[0-9]"), t.rlike(r"(^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = says(t.rlike(r"^(4|5[1-5]|3[47]|6011|65)"), ~t.rlike("^[2-6]"))
        shape = says(n == 16, n < 13)
    elif kind in ("phone", "national_phone"):
        gazetteer = says(t.rlike(r"^\+(1|44|33|49|34|39|31|41|43|46|47|48|52|54|55|61|81|86|91)\D"), t.rlike(r"^\+0"))
        shape = says(n.between(10, 13), n < 8)
    elif kind == "secret":
        value = F.regexp_replace(t, r"^.*[:=]\x20?[\"']?", "")
        gazetteer = F.lit(1)
        valid = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        shape = says(F.size(F.array_distinct(F.split(value, ""))) >= 8, F.size(F.array_distinct(F.split(value, ""))) < 5)
    elif kind == "ssn":
        valid = ~t.rlike("^(000|666|9)|-00-|-0000$")
        shape = F.lit(1)
    return {"format": F.when(valid, 1).otherwise(-1), "gazetteer": gazetteer, "context": context, "shape": shape}


def candidates(text: Column) -> Column:
    """All proposed spans of a text: array of (k, kind, start, end, base, votes)."""
    body = F.coalesce(text, F.lit(""))

    def judged(k: int, kind: str):
        def judge(s: Column) -> Column:
            before = F.substring(body, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            votes = F.struct(*[v.cast("int").alias(name) for name, v in _votes(kind, s["t"], before).items()])
            base = _valid(kind, s["t"]) if kind in BASE else F.lit(False)
            return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), votes.alias("votes"))
        return judge

    parts = []
    for k, kind in enumerate(KINDS):
        spans = F.transform(_positions(body, PATTERNS[kind]), judged(k, kind))
        tried = body.contains("@") if kind == "email" else body.rlike(NEEDED[kind])
        parts.append(F.coalesce(F.when(tried, spans).cast(SPANS), F.array().cast(SPANS)))
    return F.concat(*parts)


@dataclass
class Model:
    #: reliability[kind][labeler][vote] = (chance among personal data, chance among the rest)
    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)

    def logit(self, span: Column) -> Column:
        total = F.lit(0.0)
        for kind, b in self.bias.items():
            total = total + F.when(span["kind"] == kind, F.lit(b)).otherwise(0.0)
        for (name, vote), w in self.weights.items():
            total = total + F.when(span["votes"][name] == vote, F.lit(w)).otherwise(0.0)
        return total


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): reliabilities and, per (kind, votes), the chance of personal data."""
    chance = {(kind, v): (1 + sum(v) / len(v)) / 2 for kind, v, _ in patterns}
    chance = {key: min(0.95, max(0.05, p)) for key, p in chance.items()}
    reliability: dict = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        for _ in range(rounds):
            yes = 1 + sum(chance[kind, v] * n for v, n in own)
            no = 1 + sum((1 - chance[kind, v]) * n for v, n in own)
            table = {}
            for i, name in enumerate(VOTES):
                table[name] = {vote: (
                    (sum(chance[kind, v] * n for v, n in own if v[i] == vote) + (1.0 if vote == 1 else 0.5)) / (yes + 2),
                    (sum((1 - chance[kind, v]) * n for v, n in own if v[i] == vote) + (1.0 if vote == -1 else 0.5)) / (no + 2)) for vote in (-1, 0, 1)}
            for v, _ in own:
                odds = math.log(yes / no) + sum(math.log(table[name][v[i]][0] / table[name][v[i]][1]) for i, name in enumerate(VOTES))
                chance[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        reliability[kind] = table
    return reliability, chance


def train_classifier(patterns: list[tuple[str, tuple[int, ...], int]], chance: dict, rounds: int = 300) -> tuple[dict, dict]:
    """Logistic weights of kinds and votes for the chances found; each pattern weighs the root of its count."""
    kinds = sorted({k for k, _, _ in patterns})
    bias, weights = dict.fromkeys(kinds, 0.0), {(name, vote): 0.0 for name in VOTES for vote in (-1, 1)}
    total = sum(math.sqrt(n) for _, _, n in patterns)
    for _ in range(rounds):
        steps: dict = {}
        for kind, v, n in patterns:
            keys = [kind] + [(name, v[i]) for i, name in enumerate(VOTES) if v[i]]
            z = bias[kind] + sum(weights[x] for x in keys[1:])
            g = math.sqrt(n) / total * (chance[kind, v] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for x in keys:
                steps[x] = steps.get(x, 0.0) + g
        for x, g in steps.items():
            if x in bias:
                bias[x] += 2 * (g - 1e-4 * bias[x])
            else:
                weights[x] += 2 * (g - 1e-4 * weights[x])
    return bias, weights


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts vote patterns over all texts and learns from the counts."""
    rows = docs.select(F.explode(candidates(F.col(f"`{text}`"))).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in rows)
    if not patterns:
        return Model()
    reliability, chance = estimate(patterns)
    return Model(reliability, *train_classifier(patterns, chance))


def detect(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (k, kind, start, end, base), by kind as listed, then start."""
    model = model or fit(docs, text)
    df = docs.drop("spans", "_c", "_base").withColumn("_c", candidates(F.col(f"`{text}`")))
    df = df.withColumn("_base", F.filter("_c", lambda c: c["base"]))
    extra = F.filter("_c", lambda c: ~c["base"] & (model.logit(c) >= 0) & (c["votes"]["format"] > 0) & ~F.exists(
        "_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    plain = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))
    return df.withColumn("spans", F.array_sort(F.transform(F.concat(F.col("_base"), extra), plain))).drop("_c", "_base")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    body = F.coalesce(text, F.lit(""))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
                F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body) - a["at"])))
    return F.when(text.isNotNull() & (F.size(spans) > 0), done).otherwise(text)
