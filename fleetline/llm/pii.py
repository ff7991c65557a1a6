"""Personal data by weak supervision.

Base kinds (e-mail, IP address, payment card, phone) are exact patterns with a
check.  Two further kinds are only candidates at first: ``secret`` (long mixed
tokens) and ``number`` (grouped digits that no base span covers).  Labelers vote
on every candidate: shape patterns, a gazetteer of words before the span, and
its context.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and its posteriors train a logistic
classifier on span features, which decides which candidates become spans.

Everything on the texts is built-in expressions in two narrow passes: one counts
patterns of all documents (at most 2**(votes + features) rows per kind reach the
driver, a fixed bound), one applies the classifier.  Offsets are code points; a
span starts at the lengths of the gaps and matches before it.

Defined results: a null or empty text has no span; repeated rows are each
reported (and counted); without candidates no span is added; an empty table
gives no rows; columns that are not asked for are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# Kinds in the order of results, base kinds first.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number")

# The base patterns; guards and possessive loops only spare hopeless starts, matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter runs of digits fail their check anyway
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![A-Za-z0-9])[0-9(](?:[ ().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
}
SECRET_WORDS = r"(token|secret|api|key|passw|pwd|auth|bearer|credential)"
NUMBER_WORDS = r"(tel|phone|call|fax|mobile|card|iban|account|konto|ssn|passport|nr|no)\b"

# Labelers per kind and features of both; bit i of a pattern is entry i.
VOTES = 5
FEATURES = 8


def _found(text: Column, kind: str, needs: Column) -> Column:
    """Matches of a pattern as array<struct<start,end,value>>, left to right."""
    pattern = PATTERNS[kind]

    def place(parts: Column) -> Column:
        # gap lengths and match lengths alternate up to each match
        step = lambda a, i: F.struct(
            (a["at"] + F.length(F.get(parts["gaps"], i)) + F.length(F.get(parts["hits"], i))).alias("at"),
            F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(F.get(parts["gaps"], i))).alias("start"),
                (a["at"] + F.length(F.get(parts["gaps"], i)) + F.length(F.get(parts["hits"], i))).alias("end"),
                F.get(parts["hits"], i).alias("value")))).alias("spans"))
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.when(F.size(parts["hits"]) == 0, none).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(parts["hits"]) - 1),
            F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"]))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(needs, bind(parts, place)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(
        i % 2 == 1, F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(back, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _placed(kind: str | None = None) -> Callable[[Column], Column]:
    """start and end of a span, with a fixed kind if one is given."""
    named = [F.lit(kind).alias("kind")] if kind else []
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *named)


def _said(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == kind


def _bits(tests: list[Column]) -> Column:
    out = F.lit(0)
    for i, t in enumerate(tests):
        out = out + F.when(t, 1 << i).otherwise(0)
    return out


def _candidates(text: Column, kind: str, found: Column, base: list[Column]) -> Column:
    """Candidates free of base spans as struct(kind, start, end, votes, features)."""
    free = F.filter(found, lambda c: ~F.exists(F.concat(*base), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def judged(c: Column) -> Column:
        def of(x: Column) -> Column:
            v, before, after = x["v"], x["before"], x["after"]
            n, digits = F.length(v), F.length(_digits(v))
            quoted = F.rlike(before, F.lit("[\"'=:] ?$"))
            if kind == "secret":
                named = F.rlike(before, F.lit(SECRET_WORDS))
                votes = [F.rlike(v, F.lit("^[0-9a-fA-F]{24,}$")), F.rlike(v, F.lit("([a-zA-Z][0-9]|[0-9][a-zA-Z]).*([a-zA-Z][0-9]|[0-9][a-zA-Z])")),
                         named, quoted & F.rlike(after, F.lit("^[\"',;]")), n >= 32]
            else:
                named = F.rlike(before, F.lit(NUMBER_WORDS))
                votes = [F.rlike(v, F.lit(r"^\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}([ .-][0-9]{2,4})+$")), named,
                         quoted | F.rlike(before, F.lit("[+#]$")), digits.between(13, 19), F.rlike(v, F.lit("[ ().-]")) & digits.between(8, 15)]
            features = [n >= 20, n >= 32, digits * 5 >= n, digits * 2 >= n, F.rlike(v, F.lit("[A-Z]")), F.rlike(v, F.lit("[^A-Za-z0-9]")), quoted, named]
            return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                            _bits(votes).alias("votes"), _bits(features).alias("features"))

        near = F.struct(c["value"].alias("v"),
                        F.lower(F.substring(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))).alias("before"),
                        F.substring(text, c["end"] + 1, F.lit(1)).alias("after"))
        return bind(near, of)

    return F.transform(free, judged)


def with_candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the text, one array of spans per base kind, and the candidates."""
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    digit, at, plus = F.rlike("text", F.lit("[0-9]")), F.contains("text", F.lit("@")), F.contains("text", F.lit("+"))
    d = d.withColumn("_digit", digit)
    needs = {"email": at, "phone": plus & F.col("_digit")}
    d = d.select(*keep, "text", *[_found(F.col("text"), k, needs.get(k, F.col("_digit"))).alias(f"_{k}") for k in PATTERNS])
    base = [F.filter(f"_{k}", _passes(k)).alias(f"_{k}") for k in BASE_KINDS]
    d = d.select(*keep, "text", *base, *[f"_{k}" for k in ADDED_KINDS])
    cands = F.concat(*[_candidates(F.col("text"), k, F.col(f"_{k}"), [F.col(f"_{b}") for b in BASE_KINDS]) for k in ADDED_KINDS])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,votes:int,features:int>>")
    some = F.size("_secret") + F.size("_number") > 0
    return d.select(*keep, "text", *[f"_{k}" for k in BASE_KINDS], F.when(some, cands).otherwise(none).alias("_candidates"))


def estimate_reliability(patterns: dict[int, float], votes: int = VOTES, rounds: int = 50) -> dict[int, float]:
    """Expectation-maximisation over counts of vote patterns with conditionally
    independent labelers: the posterior of each pattern.  Weak priors keep a
    labeler better than chance until the counts say otherwise."""
    prior, hit, false = 0.5, [0.8] * votes, [0.2] * votes
    post: dict[int, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for i in range(votes):
                on = p >> i & 1
                yes += math.log(hit[i] if on else 1 - hit[i])
                no += math.log(false[i] if on else 1 - false[i])
            post[p] = 1 / (1 + math.exp(max(min(no - yes, 500), -500)))
        total = sum(patterns.values())
        true = sum(n * post[p] for p, n in patterns.items())
        prior = (true + 5) / (total + 10)
        for i in range(votes):
            on = sum(n * post[p] for p, n in patterns.items() if p >> i & 1)
            off = sum(n * (1 - post[p]) for p, n in patterns.items() if p >> i & 1)
            hit[i], false[i] = (on + 8) / (true + 10), (off + 2) / (total - true + 10)
    return post


def train_classifier(rows: list[tuple[int, float, float]], features: int = FEATURES, rounds: int = 400) -> list[float]:
    """Weights (offset first) of a logistic classifier from rows (feature
    pattern, count, summed posterior), by gradient steps on the mean loss."""
    w, total = [0.0] * (features + 1), sum(r[1] for r in rows)
    for _ in range(rounds):
        g = [0.002 * x for x in w]
        for bits, n, target in rows:
            z = w[0] + sum(w[i + 1] for i in range(features) if bits >> i & 1)
            off = (n / (1 + math.exp(-max(min(z, 30), -30))) - target) / total
            g[0] += off
            for i in range(features):
                if bits >> i & 1:
                    g[i + 1] += off
        w = [x - 2.0 * y for x, y in zip(w, g, strict=True)]
    return w


def fit_span_classifier(docs: DataFrame) -> dict[str, list[float]]:
    """Classifier weights per added kind, from the candidates of all documents."""
    seen = with_candidates(docs).select(F.explode("_candidates").alias("c")).groupBy(
        "c.kind", "c.votes", "c.features").count().collect()
    model = {}
    for kind in ADDED_KINDS:
        rows = [(r["votes"], r["features"], float(r["count"])) for r in seen if r["kind"] == kind]
        if rows:
            patterns: dict[int, float] = {}
            for v, _, n in sorted(rows):
                patterns[v] = patterns.get(v, 0.0) + n
            post = estimate_reliability(patterns)
            model[kind] = train_classifier([(f, n, n * post[v]) for v, f, n in sorted(rows)])
    return model


def find_personal_data(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``text``, one array of spans per base kind (``email`` ...)
    and ``added``: classified candidates as struct(kind, start, end, score)."""
    model = fit_span_classifier(docs)

    def score(c: Column) -> Column:
        z = F.lit(-30.0)
        for kind, w in model.items():
            total = F.lit(w[0])
            for i in range(FEATURES):
                total = total + F.when(c["features"].bitwiseAND(F.lit(1 << i)) != 0, w[i + 1]).otherwise(0.0)
            z = F.when(c["kind"] == kind, total).otherwise(z)
        return 1 / (1 + F.exp(-z))

    added = F.filter(F.transform("_candidates", lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c).alias("score"))),
        lambda c: c["score"] >= 0.5)
    return with_candidates(docs, *keep).select(*keep, "text", *[F.transform(f"_{k}", _placed()).alias(k) for k in BASE_KINDS], added.alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    base = F.concat(*[F.transform(k, _said(k)) for k in BASE_KINDS])
    added = F.concat(*[F.transform(F.filter("added", _is(k)), _said(k)) for k in ADDED_KINDS])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.concat(base, added), ",").alias("spans"))


def redacted(found: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the text with every span replaced by ``[KIND]``;
    overlapping spans become one, named after the one that starts first."""
    spans = F.sort_array(F.concat(
        *[F.transform(k, _placed(k)) for k in BASE_KINDS],
        F.transform("added", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))))
    text = F.col("text")

    def cut(s: Column) -> Column:
        step = lambda a, x: F.when(x["start"] < a["at"], F.struct(
            F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
                x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]),
                                               F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))
        return F.aggregate(s, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    return found.select(*keep, F.when(F.size(spans) == 0, text).otherwise(bind(spans, cut)).alias("text"))
