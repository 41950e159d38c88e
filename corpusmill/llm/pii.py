"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base spans come from strict patterns: email, ip, card (Luhn), phone. Further candidates (secret, number, name) get the votes of a regex, a
gazetteer, a context and a shape labeler: 1 for personal, 0 for not, -1 for no opinion. How often each pattern of kind, votes and
features occurs over the whole corpus is one small table, at most a few thousand rows however large the corpus is; from it
the driver estimates each labeler's reliability by expectation-maximisation (votes independent given the truth, a prior for each
kind) and fits a logistic classifier to the posteriors. The classifier goes back into the plan as a column expression. All spans are
found with built-in functions: lengths of matches and of the pieces between them, summed up, give the offsets. All work on a text grows with its length (and
the logarithm of its matches), never with the square of its matches.

Patterns are written with \\G, look-behind and possessive quantifiers so that long runs cost linear time; they match what the plain patterns match.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import Scratch, let, quoted, running

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_@.-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_@-])",
    "number": r"(?<![0-9A-Za-z+.-])[0-9(](?:[ ().-]{0,2}[0-9]){6,11}(?![0-9A-Za-z-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,40}+",
}
#: A cheap test that a text may hold the pattern.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: t.rlike(PATTERNS["secret"]),
    "number": lambda t: t.rlike(PATTERNS["number"]),
    "name": lambda t: t.rlike(PATTERNS["name"]),
}
CUES = {
    "secret": "token|secret|passw|api|key|auth|credential|bearer",
    "number": "phone|tel|call|mobile|fax|ssn|social|passport|passeport|iban|account|konto|cuenta|compte|id",
    "name": "dear|contact|attn|signed|regards|sincerely|name|liebe|cher|estimad",
}
ANTI_CUES = {
    "secret": "sha|md5|commit|checksum|hash|http|/|isbn|doi",
    "number": "version|isbn|issn|page|vol|doi|no\\.|year|\\$|€|£|%|=",
    "name": "street|avenue|rue|strasse|calle|university",
}
KEY_PREFIXES = r"^(?:sk-|sk_|pk_|ghp_|gho_|xox[abp]-|AKIA|AIza|eyJ|glpat-)"
COMMON_WORDS = "The|This|That|And|But|Who|Will|Was|Is|Der|Die|Das|Und|Le|La|Les|Et|El|Los|Y|President|President"
ROUNDS, STEPS, RATE, SMOOTH, LEAST = 30, 400, 0.5, 1.0, 0.75
CONTEXT = 40


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _with_matches(rows: DataFrame, kind: str, out: str) -> DataFrame:
    """rows with `out`: array<struct<start, end, text, before>> of the pattern's leftmost matches in __text, in code points; empty where the hint rules it out. before: up to
    CONTEXT characters before a match, back to the beginning of the match before at most. Steps are columns of their own, so that each is taken once."""
    text, pattern = F.col("__text"), PATTERNS[kind]
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match")), lambda p: p["match"].isNotNull())
    rows = rows.withColumn("__pairs", F.when(HINTS[kind](text), pairs).otherwise(F.array().cast("array<struct<gap:string,match:string>>")))
    rows = rows.withColumn("__ends", running(F.transform("__pairs", lambda p: F.length(p["gap"]) + F.length(p["match"]))))
    before = lambda ps, p, i: F.lower(F.right(F.concat(F.coalesce(F.get(ps, i - 1)["match"], F.lit("")), p["gap"]), F.lit(CONTEXT)))
    span = lambda ps, ends, p, i: F.struct((F.get(ends, i) - F.length(p["match"])).alias("start"), F.get(ends, i).alias("end"), p["match"].alias("text"), before(ps, p, i).alias("before"))
    # let: what one lambda alone refers to would be moved into it, and taken for each element.
    spans = let(F.struct(F.col("__pairs").alias("p"), F.col("__ends").alias("e")), lambda x: F.transform(x["p"], lambda p, i: span(x["p"], x["e"], p, i)))
    return rows.withColumn(out, spans).drop("__pairs", "__ends")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m["text"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = _digits(m["text"])
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base(rows: DataFrame) -> DataFrame:
    """rows with `base`: array<struct<kind, start, end>> of the base spans of __text, by kind as listed, then start."""
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    for kind in BASE:
        rows = _with_matches(rows, kind, f"__{kind}")
    each = [F.transform(F.filter(F.col(f"__{kind}"), partial(_passes, kind)), span(kind)) for kind in BASE]
    return rows.withColumn("base", F.concat(*each)).drop(*[f"__{kind}" for kind in BASE])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _candidate(kind: str, m: Column) -> Column:
    """A candidate with its votes and the features that the classifier sees."""
    found, digits, before = m["text"], F.length(_digits(m["text"])), m["before"]
    if kind == "secret":
        # A digest of bare hexadecimal digits may be a secret or a checksum: what stands before it decides.
        digest, mixed = found.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")
        regex = _vote(mixed & ~digest, found.rlike(r"^[a-z]+(?:[-_][a-z0-9]+)+$"))
        gazetteer = _vote(found.rlike(KEY_PREFIXES), F.lit(False))
        shape = _vote(~digest & (5 * digits >= F.length(found)) & (5 * digits <= 4 * F.length(found)), found.rlike("[-_].*[-_]") & (10 * digits < F.length(found)))
    elif kind == "number":
        regex = _vote(found.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|0[0-9](?:[ .-][0-9]{2}){4})$"), found.rlike(r"^[0-9]+$"))
        gazetteer = _vote(F.lit(False), found.rlike(r"^(?:19|20)[0-9]{2}[ .-](?:0?[1-9]|1[0-2])[ .-][0-9]{1,2}") | found.rlike(r"^[0-9]+\.[0-9]+$"))
        shape = _vote(digits.between(9, 11) & found.rlike("[ ().-]"), ~digits.between(9, 11))
    else:
        regex = _vote(found.rlike(r"\. "), F.lit(False))
        gazetteer = _vote(F.lit(False), found.rlike(rf" (?:{COMMON_WORDS})$"))
        shape = _vote(F.lit(False), found.rlike(r" .{1,2}$"))
    context = _vote(before.rlike(rf"(?:{CUES[kind]})[^\n]*$"), before.rlike(rf"(?:{ANTI_CUES[kind]})[^\n]*$"))
    size = F.least(F.floor(F.log2(F.length(found).cast("double"))).cast("int"), F.lit(7))
    fields = {"regex": regex, "gazetteer": gazetteer, "context": context, "shape": shape, "size": size, "quoted": before.rlike("[\"'=:]\\s*$").cast("int")}
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[c.cast("int").alias(k) for k, c in fields.items()])


LABELERS = ("regex", "gazetteer", "context", "shape")
FEATURES = (*LABELERS, "size", "quoted")


def _with_free(rows: DataFrame, out: str) -> DataFrame:
    """rows with `out`: the candidates in __each that overlap none of the spans in __taken. Spans in order of their starts have the farthest end so far, which every candidate
    is held against."""
    starts = F.transform("__taken", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("is_span"), s["end"].alias("end"), F.lit(-1).alias("id")))
    asked = F.transform("__each", lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("is_span"), F.lit(0).alias("end"), i.alias("id")))
    rows = rows.withColumn("__events", F.when((F.size("__taken") > 0) & (F.size("__each") > 0), F.array_sort(F.concat(starts, asked))))
    rows = rows.withColumn("__reach", running(F.transform("__events", lambda e: e["end"]), F.greatest))
    # let: what one lambda alone refers to would be moved into it, and taken for each element.
    told = let(F.col("__reach"), lambda r: F.transform("__events", lambda e, i: F.struct(e["id"].alias("id"), F.get(r, i).alias("reach"))))
    rows = rows.withColumn("__told", F.array_sort(F.filter(told, lambda t: t["id"] >= 0)))
    free = let(F.col("__told"), lambda t: F.filter("__each", lambda c, i: F.get(t, i)["reach"] <= c["start"]))
    return rows.withColumn(out, F.when(F.col("__events").isNull(), F.col("__each")).otherwise(free)).drop("__events", "__reach", "__told")


def with_candidates(rows: DataFrame) -> DataFrame:
    """rows with __candidates, beyond the base spans; those that overlap a base span, or a candidate of an earlier kind, are not listed."""
    spans = lambda cs: F.transform(cs, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    for k, kind in enumerate(ADDED):
        rows = _with_matches(rows, kind, "__found").withColumn("__each", F.transform("__found", partial(_candidate, kind)))
        rows = rows.withColumn("__taken", F.concat("base", *[spans(f"__{done}") for done in ADDED[:k]]))
        rows = _with_free(rows, f"__{kind}")
    kinds = [f"__{kind}" for kind in ADDED]
    return rows.withColumn("__candidates", F.concat(*kinds)).drop(*kinds, "__found", "__each", "__taken")


def fit(patterns: list[dict]) -> dict:
    """Labeler reliabilities, posteriors and classifier weights from rows of (kind, FEATURES, count). Pure arithmetic on a bounded table.

    For each kind and labeler, how often its votes are right is estimated for either truth; silence counts for nothing. A labeler is taken to be right in LEAST of its votes
    at least, which is what one that only ever votes one way is worth. The first posteriors are majority votes.
    """
    prior = dict.fromkeys(ADDED, 0.5)
    posterior = [0.5 + 0.4 * ((s := sum((p[j] == 1) - (p[j] == 0) for j in LABELERS)) > 0) - 0.4 * (s < 0) for p in patterns]
    right: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for k in ADDED:
            mine = [(p, q) for p, q in zip(patterns, posterior, strict=True) if p["kind"] == k]
            total = sum(p["count"] for p, _ in mine)
            prior[k] = min(0.95, max(0.05, (sum(p["count"] * q for p, q in mine) + SMOOTH) / (total + 2 * SMOOTH)))
            for j in LABELERS:
                for y in (0, 1):
                    voted = [(p["count"] * (q if y else 1 - q), p[j] == y) for p, q in mine if p[j] >= 0]
                    # The prior counts as ten votes, eight of them right.
                    right[k, j, y] = min(0.99, max(LEAST, (sum(w for w, hit in voted if hit) + 8 * SMOOTH) / (sum(w for w, _ in voted) + 10 * SMOOTH)))
        for i, p in enumerate(patterns):
            k = p["kind"]
            odds = math.log(prior[k]) - math.log(1 - prior[k])
            for j in LABELERS:
                if p[j] >= 0:
                    odds += math.log(right[k, j, 1]) - math.log(1 - right[k, j, 0]) if p[j] else math.log(1 - right[k, j, 1]) - math.log(right[k, j, 0])
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    says = {}
    for j in LABELERS:
        for y in (0, 1):
            voted = [(p["count"] * (q if y else 1 - q), p[j] == y) for p, q in zip(patterns, posterior, strict=True) if p[j] >= 0]
            says[j, y] = (sum(w for w, hit in voted if hit) + 8 * SMOOTH) / (sum(w for w, _ in voted) + 10 * SMOOTH)
    weights: dict[tuple, float] = {}
    on = [[("kind", p["kind"]), *((f, p[f]) for f in FEATURES)] for p in patterns]
    total = sum(p["count"] for p in patterns) or 1
    for _ in range(STEPS):
        slope: dict[tuple, float] = {}
        for keys, p, q in zip(on, patterns, posterior, strict=True):
            z = sum(weights.get(k, 0.0) for k in keys)
            error = p["count"] / total * (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for k in keys:
                slope[k] = slope.get(k, 0.0) + error
        for k, s in slope.items():
            weights[k] = weights.get(k, 0.0) + RATE * (s - 1e-4 * weights.get(k, 0.0))
    return {"says": says, "right": right, "prior": prior, "posterior": posterior, "weights": weights}


def _chosen(c: Column, weights: dict) -> Column:
    score = F.lit(0.0)
    for (name, value), w in sorted(weights.items(), key=str):
        score = score + F.when(c[name] == value, F.lit(round(w, 6))).otherwise(0.0)
    return score > 0


def find_spans(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry, base and spans: arrays of struct<kind, start, end> in code points, ends exclusive; spans begins with all of base.

    A null text counts as empty and has no spans; very long ones are read whole. One row out for each row in; repeated rows get the same spans. With no candidate in the
    whole table nothing is fitted and spans equal base.
    """
    if {"base", "spans"} & set(carry) or any(name.startswith("__") for name in carry):
        raise ValueError("base, spans and names that begin with __ are taken")
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(*quoted(carry), F.coalesce(F.col(quoted([text_col])[0]).cast("string"), F.lit("")).alias("__text"))
    held = scratch.keep(with_candidates(with_base(rows)).drop("__text"))
    each = held.where(F.size("__candidates") > 0).select(F.explode("__candidates").alias("c"))
    patterns = [r.asDict() for r in each.groupBy(*[F.col(f"c.{k}").alias(k) for k in ("kind", *FEATURES)]).count().collect()]
    added = F.array().cast(SPANS)
    if patterns:
        weights = fit(sorted(patterns, key=str))["weights"]
        added = F.transform(F.filter("__candidates", lambda c: _chosen(c, weights)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return held.select(*quoted(carry), "base", F.concat("base", added).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>. Spans that overlap are one, named after the one that starts first, then the longer."""

    def of(order: Column, reach: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(order, i)["start"] >= F.get(reach, i - 1))
        heads = F.filter(F.transform(order, lambda s, i: F.when(first(i), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: let(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: put(order, reach, h, c)))

    def put(order: Column, reach: Column, heads: Column, letters: Column) -> Column:
        until = lambda k: F.get(reach, F.coalesce(F.get(heads, k), F.size(order)) - 1)
        cut = lambda a, b: F.array_join(F.slice(letters, a + 1, F.greatest(b - a, F.lit(0))), "")
        span = lambda k: F.get(order, F.get(heads, k))
        parts = F.transform(heads, lambda _, k: F.concat(cut(F.when(k == 0, 0).otherwise(until(k)), span(k)["start"]), F.lit("<"), F.upper(span(k)["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(until(F.size(heads)), F.size(letters)))

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    whole = let(order, lambda o: let(running(F.transform(o, lambda s: -s["back"]), F.greatest), lambda r: of(o, r)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
