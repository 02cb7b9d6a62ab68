"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
weighs the labelers, and a span classifier trained on the result decides.

Everything that touches rows is columns. Four kinds have a base rule whose spans always
stay. Wider patterns propose candidates; each gets five votes (yes 1, no -1, abstain 0):
form (the base rule), gazetteer (address ranges, card issuers, mail domains), context (a cue
word close before it), surroundings (glued to letters or digits or not) and variety of digits.
Votes are counted per pattern of votes, a table of at most 4 * 3^5 rows. On it a two-class model with
one reliability per kind and labeler is estimated, and a logistic span classifier is trained
on vote and length features with the posteriors as targets. Its weights are literals in the plan.

Null and empty texts hold nothing. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions.binding import let
from lineaudit.llm.common import settle

# The base rules, as possessive patterns of the same language.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
# Candidates beyond the base rules.
WIDE = {
    "email": r"(?i)[a-z0-9._%+-]++\s?[\[(](?:at|@)[\])]\s?[a-z0-9-]++(?:\s?[\[(](?:dot|\.)[\])]\s?[a-z0-9-]++)++",
    "phone": r"(?:\([0-9]{2,4}\)|(?<![0-9+.-])[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|kontakt|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|karte|tarjeta|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|llame|appelez)\b",
}
LABELERS = ("form", "gazetteer", "context", "surroundings", "variety")
_REACH = 40
_ROUNDS = 60


def _located(text: Column, pattern: str) -> Column:
    """Matches of the pattern as array of (s, e, v): code-point positions and the matched text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<s: int, e: int, v: string>>))")

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.char_length(x["v"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

        pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("gap")))
        return F.aggregate(pairs, empty, step, lambda acc: acc["out"])

    none = F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)")
    return let(hits, lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled; the sum ends in 0."""
    def total(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + let(
            F.substring(d, i + 1, F.lit(1)).cast("int") * F.when((F.length(d) - 1 - i) % 2 == 1, 2).otherwise(1),
            lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return total(digits) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: F.when(
            F.length(q) <= 3, F.concat(F.lit("0"), q).cast("int") <= 255).otherwise(False)))
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(v)).between(8, 15)


def _gazetteer(kind: str, v: Column) -> Column:
    """Vote of a short list: mail domains, address ranges in use, card issuers, dialling codes."""
    if kind == "email":
        return F.when(F.lower(v).rlike(r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(v.rlike(r"^(?:0|127|2[4-9][0-9]|22[4-9]|23[0-9])\."), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(v).rlike("^(?:3[47]|3[068]|4|5[1-5]|2[2-7]|6)"), 1).otherwise(-1)
    return F.when(v.rlike(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1246]|9[0-8])"), 1).otherwise(0)


def _sign(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def _candidates(kind: str, text: Column, base: Column, wide: Column | None) -> Column:
    """Candidates of one kind: (kind, s, e, base, votes, long). Wide spans that overlap a base span are left out."""
    def make(x: Column, strict: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - _REACH, F.lit(0)) + 1, F.least(x["s"], F.lit(_REACH)))
        after = F.substring(text, x["e"] + 1, F.lit(1))
        d = _digits(x["v"])
        votes = F.array(
            _sign(strict), _gazetteer(kind, x["v"]), F.when(before.rlike(CUES[kind]), 1).otherwise(0),
            _sign(~(before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"))),
            F.when(F.length(d) < 4, 0).otherwise(_sign(~d.rlike(r"^([0-9])\1*$"))))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), strict.alias("base"),
                        F.transform(votes, lambda w: w.cast("tinyint")).alias("votes"),
                        (F.char_length(x["v"]) >= 15).alias("long"))

    out = F.transform(base, lambda x: let(_valid(kind, x["v"]), lambda ok: make(x, ok)))
    # Runs of under 13 digits are numbers, not cards.
    out = F.filter(out, lambda c: c["base"] | (c["e"] - c["s"] >= 13)) if kind == "card" else out
    if wide is None:
        return out
    free = F.filter(wide, lambda w: ~F.exists(base, lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    return F.concat(out, F.transform(free, lambda x: make(x, F.lit(False))))


def with_candidates(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``_cand``: all candidates of all kinds, each kind by position."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.withColumn("_text", text)
    located = {f"_b_{k}": _located(F.col("_text"), p) for k, p in BASE.items()} | {
        f"_w_{k}": _located(F.col("_text"), p) for k, p in WIDE.items()}
    rows = rows.withColumns(located)
    parts = [_candidates(k, F.col("_text"), F.col(f"_b_{k}"), F.col(f"_w_{k}") if k in WIDE else None) for k in KINDS]
    return rows.withColumn("_cand", F.concat(*parts)).drop("_text", *located)


@dataclass(frozen=True)
class SpanClassifier:
    """Weights per kind: intercept, one per labeler, one for long spans."""
    weights: dict[str, tuple[float, ...]]
    reliability: dict[str, tuple[tuple[float, float, float], ...]]

    def probability(self, c: Column) -> Column:
        def score(w: tuple[float, ...]) -> Column:
            z = F.lit(w[0])
            for i in range(len(LABELERS)):
                z = z + F.lit(w[1 + i]) * c["votes"][i].cast("double")
            return 1 / (1 + F.exp(-(z + F.when(c["long"], w[-1]).otherwise(0.0))))
        out = F.lit(0.0)
        for k, w in self.weights.items():
            out = F.when(c["kind"] == k, score(w)).otherwise(out)
        return out


def _posteriors(cells: list[tuple[tuple[int, ...], int]]) -> tuple[list[float], list[tuple[float, float, float]]]:
    """Expectation-maximisation over vote patterns: P(real) per pattern, and per labeler
    (P(yes | real), P(no | not real), share of abstentions). Labelers vote independently given the truth."""
    n = len(LABELERS)
    q = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in cells]
    sure: list[tuple[float, float]] = []
    for _ in range(_ROUNDS):
        prior = (1 + sum(p * c for p, (_, c) in zip(q, cells))) / (2 + sum(c for _, c in cells))
        sure = []
        for i in range(n):
            # Priors of 4 to 1 for a labeler that is mostly right keep the two classes from swapping.
            yes = (4 + sum(p * c for p, (v, c) in zip(q, cells) if v[i] == 1)) / (5 + sum(p * c for p, (v, c) in zip(q, cells) if v[i]))
            no = (4 + sum((1 - p) * c for p, (v, c) in zip(q, cells) if v[i] == -1)) / (
                5 + sum((1 - p) * c for p, (v, c) in zip(q, cells) if v[i]))
            sure.append((yes, no))
        before, q = q, []
        for v, _ in cells:
            z = math.log(prior / (1 - prior))
            for (yes, no), x in zip(sure, v):
                z += math.log(yes / (1 - no)) if x == 1 else math.log((1 - yes) / no) if x == -1 else 0.0
            q.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        if max((abs(a - b) for a, b in zip(q, before)), default=0) < 1e-9:
            break
    total = sum(c for _, c in cells)
    idle = [sum(c for v, c in cells if v[i] == 0) / total for i in range(n)]
    return q, [(y, m, a) for (y, m), a in zip(sure, idle)]


def _logistic(rows: list[tuple[tuple[float, ...], float, float]]) -> tuple[float, ...]:
    """Weights for (features, target, count) by damped gradient steps with a small ridge."""
    k = len(rows[0][0])
    w, total = [0.0] * k, sum(c for *_, c in rows)
    for _ in range(800):
        g = [-1e-3 * x for x in w]
        for x, y, c in rows:
            z = sum(a * b for a, b in zip(w, x))
            r = (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * c / total
            for i in range(k):
                g[i] += r * x[i]
        w = [a + 1.0 * b for a, b in zip(w, g)]
    return tuple(w)


def fit(rows: DataFrame) -> SpanClassifier:
    """Train on the candidates of ``rows`` (column ``_cand``); all of them are counted."""
    counted = rows.select(F.explode("_cand").alias("c")).groupBy("c.kind", "c.votes", "c.long").agg(F.count("*").alias("n")).collect()
    weights, reliability = {}, {}
    for kind in KINDS:
        cells: dict[tuple[int, ...], int] = {}
        own = [(tuple(r["votes"]), r["long"], r["n"]) for r in sorted(counted, key=str) if r["kind"] == kind]
        if not own:
            continue
        for v, _, n in own:
            cells[v] = cells.get(v, 0) + n
        q, reliability[kind] = _posteriors(list(cells.items()))
        target = dict(zip(cells, q))
        weights[kind] = _logistic([((1.0, *map(float, v), float(long)), target[v], n) for v, long, n in own])
    return SpanClassifier(weights, {k: tuple(v) for k, v in reliability.items()})


def _rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def _is(kind: str):
    return lambda c: c["kind"] == kind


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def decided(rows: DataFrame, model: SpanClassifier, least: float = 0.5) -> DataFrame:
    """``rows`` with ``_spans``: base spans and candidates the classifier accepts, by kind and start."""
    chosen = F.filter("_cand", lambda c: c["base"] | (model.probability(c) >= least))
    ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(
        _rank(c["kind"]).alias("r"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), c["base"].alias("base"))))
    return rows.withColumn("_spans", ordered).drop("_cand")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and digest are those of the base rules; ``spans`` holds the added ones too.
    Candidates are written once, so that training and deciding read the texts a single time.
    """
    rows = settle(with_candidates(docs.select("doc_id", "text")).drop("text"))
    out = decided(rows, fit(rows)).withColumn("_base", F.filter("_spans", lambda c: c["base"]))
    counts = [F.size(F.filter("_base", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_spelled(F.col("_base")), 256).alias("base_sha256"),
                      _spelled(F.col("_spans")).alias("spans"), (F.size("_spans") - F.size("_base")).cast("bigint").alias("n_added"))


def masked(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``count_col``, where present, is set to the new length of changed texts. Null texts stay null. Other
    columns, whatever their names, stay as they are.
    """
    model = fit(with_candidates(docs.select(text_col), text_col))
    # The row rests in one column, so that no column of ``docs`` meets one of the steps'.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = decided(with_candidates(docs.select(row, F.col(f"`{text_col}`").alias("text"))), model)
    text = F.col("text")
    start = F.expr("named_struct('at', 0, 'out', '')")
    by_place = F.array_sort(F.transform("_spans", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), c["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= acc["at"], F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), piece.alias("out"))

    new = F.aggregate(by_place, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text) - acc["at"], F.lit(0)))))
    hit = F.size("_spans") > 0
    rows = rows.withColumn("_new", F.when(hit, new).otherwise(text))

    def column(c: str, kind: str) -> Column:
        if c == text_col:
            return F.col("_new")
        return F.when(hit, F.char_length("_new").cast(kind)).otherwise(F.col("row")[c]) if c == count_col else F.col("row")[c]

    return rows.select(*(column(c, kind).alias(c) for c, kind in docs.dtypes))
