"""Operator 4: personal data by weak supervision (DataFrame functions only).

Base spans (email, ip, card, phone) come from fixed patterns. Further candidates (bank accounts, spelled-out addresses,
secrets, social security numbers, local phone numbers) are judged by labelers that vote 1, 0 or -1: shape (regex),
gazetteer, context before the span, make-up of its characters, its borders, and support (whether gazetteer or context
speaks for it; base spans need none and abstain). Counts of vote patterns over all documents, base spans included, are all
that leaves the executors (a bounded table: kinds x 3^labelers). On them, expectation-maximisation estimates how reliable
each labeler is, and a logistic span classifier is trained on the resulting posteriors. It is applied as a plain
expression and alone decides: candidates that it accepts become spans.

Patterns are written so that no match backtracks over a long run: possessive, and starting only where a run starts.

Edge cases: null or empty text has no spans; rows with equal doc_id are judged each; a null doc_id is kept; an empty
table gives no rows; other columns of the input are ignored. Where spans overlap, masking covers their union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, match_spans

#: The base kinds in order, with their patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds, in order: candidate pattern, strict shape, words that speak for it before it, gazetteer pattern on the value.
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,34}$", "iban|account|konto|compte|cuenta|bank", r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"),
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++", r"[\[(](?:at|AT)[\])].*(?:\.|[\[(](?:dot|DOT)[\])])", "mail|contact|kontakt|correo|courriel|write to", r"(?:com|org|net|edu|de|fr|es|io|info)$"),
    "secret": (r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}", r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])", "token|secret|password|passwd|pwd|api.?key|access.?key|auth|bearer|credential", r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox|eyJ|glpat-|AIza)"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "ssn|social security|taxpayer", r"^[0-8]"),
    "tel": (r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$", "phone|tel|call|mobile|cell|fax|telefon|anruf|appel|llam", r"^\(?[2-9]"),
}
AGAINST = "version|page|isbn|doi|figure|table|sha1|sha256|md5|commit|checksum|hash"
LABELERS = ("shape", "gazetteer", "context", "characters", "borders", "support")
#: Prior counts of a labeler's votes on personal data and on the rest: somewhat better than chance, which also fixes which class is which.
PRIOR = ({1: 7.0, 0: 2.0, -1: 1.0}, {1: 2.0, 0: 3.0, -1: 5.0})
#: Log odds of a support vote. They are given, not estimated: without a labelled span, candidates that nothing speaks for
#: would otherwise be taken for whatever class is the larger one.
SUPPORT = {1: 2.0, 0: 0.0, -1: -8.0}
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Code points before a span that the context labeler sees.
CONTEXT = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    add = lambda acc, i: acc + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str):
    """What a match of a base kind must fulfil besides its pattern."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": lambda m: F.when(F.length(_digits(m["value"])).between(16, 19), _luhn(_digits(m["value"]))).otherwise(False),
        "phone": lambda m: F.length(_digits(m["value"])).between(8, 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(text: Column, kind: str, base: bool):
    """A span with the votes of all labelers."""
    _, shape, words, known = ("", ".", {"email": "mail|contact", "ip": "ip|server|host|address", "card": "card|visa|carte|karte|tarjeta", "phone": ADDED["tel"][2]}[kind], r"(?:com|org|net|edu)$" if kind == "email" else r"^\+1" if kind == "phone" else r"^4" if kind == "card" else "^$") if base else ADDED[kind]

    def of(m: Column) -> Column:
        v = m["value"]
        before = F.lower(F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT))))
        sides = F.concat(F.substring(text, m["start"], F.when(m["start"] > 0, 1).otherwise(0)), F.substring(text, m["end"] + 1, F.lit(1)))
        kinds = F.size(F.array_distinct(F.split(v, "")))
        votes = (
            _vote(v.rlike(shape), ~v.rlike(shape)),
            _vote(v.rlike(known), F.lit(False)),
            _vote(before.rlike(rf"(?:{words})"), before.rlike(rf"(?:{AGAINST})[^a-z]*$")),
            _vote(v.rlike("[0-9]") & (kinds >= 5), (kinds < 4) | v.rlike(r"^[A-Za-z_+/=-]+$")) if not base else _vote(kinds >= 4, kinds < 3),
            _vote(~sides.rlike("[A-Za-z0-9]"), sides.rlike("[A-Za-z0-9_]")),
        )
        spoken = (votes[1] == 1) | (votes[2] == 1)
        votes = (*votes, F.lit(0) if base else _vote(spoken, ~spoken))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[x.alias(n) for n, x in zip(LABELERS, votes)])

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, a span array for each base kind, and ``voted``: base spans and further candidates with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    rows = documents(docs).select("doc_id", text.alias("text"), text.rlike("[0-9]").alias("digits"), F.contains(text, F.lit("@")).alias("at"))
    gate = {"email": F.col("at"), "phone": F.col("digits") & F.contains("text", F.lit("+")), "mail": F.col("text").rlike(r"[\[(](?:at|AT)[\])]"), "secret": F.col("digits") | F.contains("text", F.lit("AKIA")) | F.contains("text", F.lit("ASIA"))}
    text = F.col("text")
    base = {k: F.when(gate.get(k, F.col("digits")), F.filter(match_spans(text, p), _holds(k))).otherwise(none) for k, p in BASE.items()}
    more = {k: F.when(gate.get(k, F.col("digits")), match_spans(text, x[0])).otherwise(none) for k, x in ADDED.items()}
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base.items()], *[c.alias(k) for k, c in more.items()])
    apart = lambda m: ~F.exists(F.concat(*[F.col(k) for k in BASE]), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    own = [F.transform(F.col(k), _votes(text, k, True)) for k in BASE]
    new = [F.when(F.size(k) > 0, F.transform(F.filter(F.col(k), apart), _votes(text, k, False))).otherwise(F.array().cast(VOTED)) for k in ADDED]
    return rows.select("doc_id", "text", *BASE, F.concat(*[x.cast(VOTED) for x in own], *[x.cast(VOTED) for x in new]).alias("voted"))


VOTED = f"array<struct<kind:string,start:int,end:int,{','.join(f'{x}:int' for x in LABELERS)}>>"


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> list[float]:
    """Expectation-maximisation for two classes, equally likely beforehand, and independent labelers; the posterior that each vote pattern is personal data."""
    learned = [j for j, name in enumerate(LABELERS) if name != "support"]
    given = [sum(SUPPORT[v] for name, v in zip(LABELERS, votes) if name == "support") for votes, _ in patterns]
    share = [1 / (1 + math.exp(-0.6 * sum(votes[j] for j in learned if j < len(votes)) - g)) for (votes, _), g in zip(patterns, given)]
    for _ in range(rounds):
        table = [[dict(p) for _ in LABELERS] for p in PRIOR]
        for (votes, n), s in zip(patterns, share):
            for c, part in ((0, s * n), (1, (1 - s) * n)):
                for j, v in enumerate(votes):
                    table[c][j][v] += part
        logs = [[{v: math.log(x / sum(t.values())) for v, x in t.items()} for t in side] for side in table]
        odds = [g + sum(logs[0][j][votes[j]] - logs[1][j][votes[j]] for j in learned if j < len(votes)) for (votes, _), g in zip(patterns, given)]
        share = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]
    return share


def train(rows: list[tuple[str, tuple[int, ...], float]], steps: int = 800) -> dict[str, float]:
    """Weights of the final span classifier: logistic regression on votes and kind, fitted to the posteriors."""
    share = estimate([(v, n) for _, v, n in rows])
    inputs = [[("bias"), f"kind {k}", *(f"{name} {v}" for name, v in zip(LABELERS, votes) if v)] for k, votes, _ in rows]
    weight = [1 + math.log1p(n) for *_, n in rows]
    w, total = {x: 0.0 for i in inputs for x in i} | {"bias": 0.0}, sum(weight) or 1.0
    for _ in range(steps):
        slope = {x: 0.001 * v for x, v in w.items()}
        for x, s, n in zip(inputs, share, weight):
            p = 1 / (1 + math.exp(-sum(w[f] for f in x)))
            for f in x:
                slope[f] += (p - s) * n / total
        w = {x: v - 1.5 * slope[x] for x, v in w.items()}
    return w


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, email, ip, card, phone, and ``more``: the spans that the method adds, as array<struct<kind,start,end>>."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(candidates(docs).drop("text"), "candidates")
    return found.withColumn("more", _accepted(found))


def _accepted(found: DataFrame) -> Column:
    counts = found.select(F.explode("voted").alias("x")).groupBy("x.kind", *[f"x.{n}" for n in LABELERS]).count().collect()  # a row for each vote pattern: (kinds) x 3^5 at most
    w = train(sorted((r[0], tuple(r[1:-1]), float(r[-1])) for r in counts))
    odds = lambda x: sum(
        (F.when(x[n] == 1, w.get(f"{n} 1", 0.0)).when(x[n] == -1, w.get(f"{n} -1", 0.0)).otherwise(0.0) for n in LABELERS),
        F.lit(w["bias"]) + sum((F.when(x["kind"] == k, w.get(f"kind {k}", 0.0)).otherwise(0.0) for k in ADDED), F.lit(0.0)),
    )
    taken = F.filter("voted", lambda x: x["kind"].isin(*ADDED) & (odds(x) > 0))
    return F.transform(F.array_sort(F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))), lambda x: x)


def _spelled(kind: str) -> Column:
    return F.transform(F.col(kind), lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans of the method's own kinds), n_spans (all)."""
    base = F.concat(*[_spelled(k) for k in BASE])
    more = F.transform("more", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return find(docs).select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"), F.size("more").cast("long").alias("n_added"), (F.size(base) + F.size("more")).cast("long").alias("n_spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    scratch = Scratch(docs.sparkSession, "pii-mask")
    keep, (hash_, n_, spans_) = docs.columns, (fresh(docs, x) for x in ("hash", "n", "spans"))
    # Spans depend on the text alone: equal texts share them, and the join is on two hashes of the text.
    key = lambda: [F.xxhash64("text").alias(hash_), F.xxhash64(F.lit(1), "text").alias(n_)]
    own = documents(docs)
    found = scratch.save(candidates(own).filter(F.size("voted") > 0).select(*key(), *BASE, "voted").dropDuplicates([hash_, n_]), "candidates")
    named = lambda kind: lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    spans = F.concat(*[F.transform(F.col(k), named(k)) for k in BASE], F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"), last(acc)["kind"].alias("kind"))))
    merge = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(F.try_element_at(acc, F.lit(-1))["end"] > x["start"], longer(acc, x)).otherwise(F.concat(acc, F.array(x)))
    merged = F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)
    places = found.withColumn("more", _accepted(found)).select(hash_, n_, merged.alias(spans_)).filter(F.size(spans_) > 0)
    text, at = F.col("text"), F.col(spans_)
    since = lambda i: F.coalesce(F.get(at, i - 1)["end"], F.lit(0))
    piece = lambda s, i: F.concat(F.substring(text, since(i) + 1, s["start"] - since(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    tail = F.substring(text, F.element_at(at, -1)["end"] + 1, F.length(text))
    masked = F.when(at.isNull(), text).otherwise(F.concat(F.array_join(F.transform(at, piece), ""), tail))
    joined = docs.select("*", *key()).join(places, [hash_, n_], "left")
    return joined.select(*[masked.alias(c) if c == "text" else F.col(f"`{c}`") for c in keep])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
