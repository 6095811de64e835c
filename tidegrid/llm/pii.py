"""Personal data: patterns, gazetteers and contexts vote on candidate spans; their reliabilities are estimated without labels and train a span classifier."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import as_row, text_of, with_text
from tidegrid.session import durable

#: Kinds of spans in the order of the result; the first four are found by fixed rules, the rest are added by the method.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret")
#: Patterns, each the same language as its plain rule. Possessive loops do not recurse, and a match begins where its run of
#: characters or the search does, so long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])(?:[0-9]{2}-[0-9]{4}|[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+_-]*+[0-9])(?=[0-9/+_-]*+[A-Za-z])[A-Za-z0-9/+_-]{12,}+",
}
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words before a span that speak for or against it (fixed lists, lower case).
CUES = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt|from|to",
    "ip": "ip|address|host|server|client|addr|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell|dial|contact|telefon|teléfono|téléphone",
    "number": "phone|tel|call|mobile|fax|ssn|social|security|number|dial",
    "secret": "password|passwd|pwd|secret|token|key|api|apikey|access|bearer|credential|auth|aws",
}
AGAINST = "version|isbn|issn|doi|page|figure|fig|chapter|section|line|year|order|item|part|build|release|http|https|www|sha|md5|commit|hash|uuid"
#: Characters before a span that context labelers see.
REACH = 24
LABELERS = ("pattern", "gazetteer", "context", "shape")
FEATURES = (*(f"{n}_{s}" for n in LABELERS for s in ("for", "against")), *(f"is_{k}" for k in KINDS), "short", "long", "digits")
ROUNDS = 40


def matches(text: Column | str, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as (start, text), by the texts between them."""
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gap"))
    empty = F.array().cast("array<struct<start:int,txt:string>>")
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.length(F.coalesce(x["m"], F.lit("")))).alias("at"),
        F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), x["m"].alias("txt"))))).alias("out"),
    )
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: digits.substr(i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, txt: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(txt, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return luhn(F.regexp_replace(txt, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(txt, "[^0-9]", "")).between(9, 15)
    return F.lit(kind == "email")


def candidates(text: Column | str) -> Column:
    """Spans on which the labelers vote, as an array of structs: kind, start, end, base, votes (-1, 0 or 1 a labeler), size, digits (share in tenths)."""
    text = F.col(text) if isinstance(text, str) else text

    def one(kind: str) -> Column:
        def candidate(m: Column) -> Column:
            txt, start = m["txt"], m["start"]
            ok = valid(kind, txt)
            before = F.lower(text.substr(F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
            edges = F.concat(F.when(start > 0, text.substr(start, F.lit(1))).otherwise(F.lit(" ")), F.lit("~"), text.substr(start + F.length(txt) + 1, F.lit(1)))
            digits = F.length(F.regexp_replace(txt, "[^0-9]", ""))
            strict = {"secret": txt.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9/+_-]{16,}|AKIA[0-9A-Z]{16})$"), "number": F.lit(True)}
            pattern = F.when(ok, 1).otherwise(-1) if kind in BASE else F.when(strict[kind], 1).otherwise(0)
            cue = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[\p{{L}}]{{0,2}}[^\p{{L}}0-9]{{1,6}}$"), 1).when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]{{0,4}}$"), -1).otherwise(0)
            context = F.when(edges.rlike(r"""^[\s"'(<\[=:,;]~(?:[\s"')>\],;.!?]|$)"""), 1).otherwise(-1)
            shape = F.when(txt.rlike(r"^[^0-9]*+([0-9])(?:[^0-9]*+\1)*+[^0-9]*+$") & (digits > 3), -1).when(10 * digits >= 2 * F.length(txt), 1).otherwise(0 if kind == "email" else -1)
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(txt)).alias("end"), ok.alias("base"),
                pattern.alias("pattern"), cue.alias("gazetteer"), context.alias("context"), shape.alias("shape"),
                F.length(txt).alias("size"), F.floor(10 * digits / F.length(txt)).cast("int").alias("digits"),
            )

        found = F.transform(matches(text, PATTERNS[kind]), candidate)
        if kind == "card":
            found = F.filter(found, lambda x: x["size"] >= 8)
        need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        return F.when(need & text.rlike(PATTERNS[kind]), found)

    kinds = [F.coalesce(one(k), F.array().cast(CANDIDATES)) for k in KINDS]
    return F.concat(*kinds)


CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,pattern:int,gazetteer:int,context:int,shape:int,size:int,digits:int>>"


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier; ``reliabilities`` has each labeler's estimated rates (for and against, of true and of false spans)."""

    weights: tuple[float, ...]
    intercept: float
    reliabilities: dict[str, tuple[float, ...]]
    threshold: float = 0.5


def features(c: Column) -> list[Column]:
    """Features of a candidate, in the order of FEATURES, as doubles of 0 and 1."""
    votes = [c[n] == v for n in LABELERS for v in (1, -1)]
    return [x.cast("double") for x in (*votes, *(c["kind"] == k for k in KINDS), c["size"] < 10, c["size"] > 30, c["digits"] >= 5)]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation for independent labelers over (kind, votes, count): the share of true spans of each kind, and for
    each labeler the probability of each vote given a true and a false span. At most a few hundred patterns exist."""
    share = {k: 0.5 for k, _, _ in patterns}
    rates = [{1: (0.7, 0.2), 0: (0.2, 0.4), -1: (0.1, 0.4)} for _ in LABELERS]
    for _ in range(ROUNDS):
        true = []
        for kind, votes, n in patterns:
            yes, no = share[kind], 1 - share[kind]
            for rate, v in zip(rates, votes, strict=True):
                yes, no = yes * rate[v][0], no * rate[v][1]
            true.append((kind, votes, n, yes / (yes + no)))
        for kind in share:
            own = [(n, p) for k, _, n, p in true if k == kind]
            share[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for k, rate in enumerate(rates):
            for side, weight in ((0, lambda p: p), (1, lambda p: 1 - p)):
                total = sum(n * weight(p) for _, _, n, p in true)
                for v in rate:
                    hit = sum(n * weight(p) for _, votes, n, p in true if votes[k] == v)
                    pair = list(rate[v])
                    pair[side] = (1 + hit) / (3 + total)
                    rate[v] = tuple(pair)
    return share, rates


def fit(found: DataFrame) -> Model:
    """A model from a table with an array of candidates in ``spans``: counts of vote patterns, their estimation, and a logistic fit
    to the estimated probabilities. Counts cover all rows and are bounded by the number of patterns. Without candidates nothing is added."""
    each = found.select(F.explode("spans").alias("c"))
    counts = each.groupBy("c.kind", *[f"c.{n}" for n in LABELERS], (F.col("c.size") < 10).alias("short"), (F.col("c.size") > 30).alias("long"), (F.col("c.digits") >= 5).alias("dense")).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts)
    rows = counts.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).orderBy("kind", *LABELERS).collect()
    if not rows:
        return Model((0.0,) * len(FEATURES), -10.0, {})
    share, rates = estimate([(r.kind, tuple(r[n] for n in LABELERS), r.n) for r in rows])
    odds = F.coalesce(*[F.when(F.col("kind") == k, F.lit(math.log(p / (1 - p)))) for k, p in share.items()])
    for name, rate in zip(LABELERS, rates, strict=True):
        odds = odds + F.coalesce(*[F.when(F.col(name) == v, F.lit(math.log(a / b))) for v, (a, b) in rate.items()])
    p = counts.withColumn("p", 1 / (1 + F.exp(-odds)))
    c = F.struct("kind", *LABELERS, F.when(F.col("short"), 1).when(F.col("long"), 40).otherwise(20).alias("size"), F.when(F.col("dense"), 9).otherwise(0).alias("digits"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
    train = p.withColumn("c", c).withColumn("b", both).select(*[x.alias(n) for n, x in zip(FEATURES, features(F.col("c")), strict=True)], F.col("b.label").alias("label"), (F.col("b.w") * F.col("n")).alias("weight"))
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(train)
    told = {n: tuple(x for v in (1, -1) for x in rate[v]) for n, rate in zip(LABELERS, rates, strict=True)}
    return Model(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept), told)


def chosen(spans: Column, model: Model) -> Column:
    """Base spans, and candidates of at least the model's threshold that overlap no base span; by kind, then start."""
    limit = math.log(model.threshold / (1 - model.threshold))
    score = lambda c: sum((x * F.lit(w) for x, w in zip(features(c), model.weights, strict=True)), F.lit(model.intercept))
    base = F.filter(spans, lambda c: c["base"] & c["kind"].isin(*BASE))
    added = F.filter(spans, lambda c: ~(c["base"] & c["kind"].isin(*BASE)) & (score(c) >= limit))
    free = F.filter(added, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    order = F.array_sort(F.transform(F.concat(base, free), lambda c: F.struct(rank(c).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    return order


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def detected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Spans of each row: doc_id, counts and digest of the base spans, all spans. A missing text has none; repeated rows give a row each.

    Candidates are found row by row and stored without the texts; fitting and choosing read that small table.
    """
    found = durable(docs.select("doc_id", text_of().alias("text")).select("doc_id", candidates("text").alias("spans")))
    model = model or fit(found)
    d = found.withColumn("spans", F.when(F.size("spans") > 0, chosen(F.col("spans"), model)).otherwise(F.array().cast("array<struct<rank:bigint,start:int,end:int,kind:string,base:boolean>>")))
    base = F.filter("spans", lambda c: c["base"] & (c["rank"] <= len(BASE)))
    d = d.withColumn("own", base)
    count = lambda kind: F.size(F.filter("own", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return d.select("doc_id", *counts, F.sha2(told(F.col("own")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents with every span replaced by its kind in brackets, as ``<email>``; spans that overlap are one range of the kind of
    the first of them, the longest one where several begin together.

    Other columns are left as they are, except that ``n_chars`` follows a text that changes.
    """
    if model is None:
        model = fit(durable(docs.select(candidates(text_of()).alias("spans"))))
    d = docs.select(as_row(docs), candidates(F.col("text")).alias("spans"), "text")
    order = F.array_sort(F.transform(chosen(F.col("spans"), model), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    order = F.array_sort(order, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(0))
    d = d.withColumn("spans", F.when(F.size("spans") > 0, order))
    last = lambda s: F.element_at(s, -1)
    merge = lambda s, c: F.when((F.size(s) > 0) & (c["start"] < F.get(s, F.size(s) - 1)["end"]), F.concat(
        F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last(s)["start"].alias("start"), F.greatest(last(s)["end"], c["end"]).alias("end"), last(s)["kind"].alias("kind")))
    )).otherwise(F.concat(s, F.array(c)))
    d = d.withColumn("spans", F.aggregate("spans", F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge))
    step = lambda s, c: F.struct(
        c["end"].alias("at"), F.concat(s["out"], F.col("text").substr(s["at"] + 1, c["start"] - s["at"]), F.lit("<"), c["kind"], F.lit(">")).alias("out")
    )
    made = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    d = d.withColumn("made", F.when(F.size("spans") > 0, made))
    return d.select(with_text(docs, F.col("made"), F.col("made").isNotNull())).select("row.*")
