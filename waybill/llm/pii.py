"""Personal data by weak supervision, in DataFrame functions alone: patterns, lists and contexts vote on candidate spans,
expectation maximisation estimates how far each can be trusted, and a classifier trained on what it makes of them decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import read, table

KINDS = ("email", "ip", "card", "phone")

#: The base spans. Runs are taken whole and searches begin at their start, so that each takes time in proportion to the
#: text; the matches are those of the plain forms with + in place of ++.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|＠|\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20(?:at|@)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)"
#: Further candidates: written otherwise than the base forms, or parts of base matches that failed.
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?:[\x20.-][0-9]{1,3})?|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-]?)[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_QUAD = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

# Word lists: fixed values, plain.
#: Words that stand before such data.
BEFORE = {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel|kontakt|adresse",
    "ip": "ip|host|server|address|addr|client|login|from|ping",
    "card": "card|visa|mastercard|amex|credit|debit|cc|payment|karte|carte|tarjeta|zahlung|pago",
    "phone": "phone|telephone|tel|call|mobile|cell|fax|whatsapp|sms|telefon|handy|anruf|téléphone|teléfono|móvil",
}
#: Words that stand before other numbers and names.
OTHERWISE = "version|ver|v|isbn|issn|doi|order|invoice|build|rev|chapter|section|page|fig|figure|table|sha|hash|token|serial|part|sku|tracking|id"
#: Last labels of common domains, and endings of file names.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|dev|app|eu|uk|us|de|fr|es|it|nl|ch|at|be|ca|au|jp|cn|in|br|mx|ru|se|no|dk|fi|pl"
FILES = "png|jpg|jpeg|gif|svg|js|ts|py|java|cpp|html|css|json|xml|txt|md|pdf|zip"
#: Leading digits of card numbers and of international calling codes.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]|62|50|5[6-8])"
CALLING = r"^(?:\+|00)\x20?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"

#: How often each voter that votes is taken to say 1 of personal data and of other candidates before any is seen. They are
#: better than chance, which tells the two apart.
VOTERS = {"strict": (0.85, 0.15), "form": (0.9, 0.3), "rule": (0.98, 0.4), "listed": (0.9, 0.4), "context": (0.9, 0.2), "edges": (0.95, 0.6), "beside": (0.9, 0.6)}
#: Few numbers that are no card or address keep the rules of their kind.
RARE_RULE = {"card": (0.98, 0.1), "ip": (0.98, 0.1)}
#: Candidates that these rates count as.
BELIEF = 20.0
#: Weight of a voter's word alone in the classifier's training, where all candidates of a kind weigh 1.
ALONE = 0.2
ROUNDS = 25
#: Matches of a text that are folded at a time.
BLOCK = 256
LEAST_CHANCE = 0.5
SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,seen:struct<" + ",".join(f"{n}:tinyint" for n in (*VOTERS, "size", "digits")) + ">>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column, low: int, high: int) -> Column:
    return F.length(digits).between(low, high) & F.call_function("luhn_check", F.when(F.length(digits) <= high, digits))


def valid(kind: str, text: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return text.rlike(_QUAD)
    if kind == "card":
        return F.coalesce(_luhn(_digits(text), 12, 19), F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """1, -1 or 0 (abstains)."""
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("byte")


def votes(kind: str, text: Column, before: Column, after: Column, base: bool) -> list[Column]:
    """What each of VOTERS says to a candidate: 1 personal data, -1 something else, 0 nothing."""
    digits = _digits(text)
    if kind == "email":
        label = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))
        form = _vote(text.rlike(r"[@＠]") | text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]"), text.rlike(r"(?i)\x20at\x20") & ~text.rlike(r"(?i)\x20dot\x20"))
        rule = _vote(label.rlike("^[a-z]{2,24}$"), F.lit(True))
        listed = _vote(label.rlike(f"^(?:{DOMAINS})$"), label.rlike(f"^(?:{FILES})$") | ~label.rlike("[a-z]"))
    elif kind == "ip":
        plain = F.regexp_replace(text, r"[\x20\[\]()]|dot", "")
        quad = text.contains(":") | text.rlike(_QUAD) | F.regexp_replace(F.regexp_replace(text, "dot", "."), r"[\x20\[\]()]", "").rlike(_QUAD)
        form = _vote(text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | text.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | text.rlike(r"[\[(]"), text.rlike(r"(?:^|\.)0[0-9]"))
        rule = _vote(quad, F.lit(True))
        listed = _vote(plain.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])[.\[(]") | plain.rlike("^(?:2[0-9a-fA-F]{3}|fe80|fc|fd)"), plain.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\."))
    elif kind == "card":
        form = _vote(text.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"), F.lit(True))
        rule = _vote(F.coalesce(_luhn(digits, 12, 19), F.lit(False)), F.lit(True))
        listed = _vote(digits.rlike(ISSUERS), F.lit(True))
    else:
        form = _vote(text.rlike(r"^\+") | text.rlike(r"^(?:00|\()") | text.rlike(r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), text.rlike(r"^[0-9]+\.[0-9.]+$"))
        rule = _vote(F.length(digits).between(9, 15), F.lit(True))
        listed = _vote(text.rlike(CALLING), text.rlike(r"^(?:\+|00)"))
    words = lambda x: rf"(?i)(?:^|[^\p{{L}}])(?:{x})[^\p{{L}}]"
    context = _vote(before.rlike(words(BEFORE[kind])), before.rlike(words(OTHERWISE)))
    glued = before.rlike(r"[\p{L}0-9_/#=]$") | after.rlike(r"^[\p{L}0-9_/=]")
    edges = _vote(~glued, glued)
    among = before.rlike(r"[0-9][\x20.,;:/-]{1,2}$") | after.rlike(r"^[\x20.,;:/-]{1,2}[0-9]")
    beside = _vote(~among, among)
    return [F.lit(1 if base else -1).cast("byte"), form, rule, listed, context, edges, beside]


def _placed(pieces: Column, found: Column, kind: str, base: bool) -> Column:
    """Candidates of one pattern in order, from the text between its matches and the matches: their places are sums of lengths."""

    def item(text: Column, i: Column) -> Column:
        gap = F.get(pieces, i)
        before, after = F.substring(gap, -48, 48), F.substring(F.get(pieces, i + 1), 1, 8)
        digits = F.length(_digits(text))
        own = [v.alias(n) for v, n in zip(votes(kind, text, before, after, base), VOTERS, strict=True)]
        size = F.floor(F.least(F.char_length(text), F.lit(39)) / 4).cast("byte").alias("size")
        share = F.floor(digits * 10 / F.char_length(text)).cast("byte").alias("digits")
        ok = valid(kind, text) if base else F.lit(True)
        return F.struct(F.char_length(gap).alias("gap"), F.char_length(text).alias("length"), ok.alias("ok"), F.struct(*own, size, share).alias("seen"))

    none = F.array().cast(SPANS)

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.lit(base).alias("base"), x["seen"].alias("seen"))
        return end, x["ok"], span

    return F.when(F.size(found) > 0, _folded(F.transform(found, item), 0, none, step)).otherwise(none)


def _folded(items: Column, first: int, none: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The items that ``step`` (number so far, item) keeps: it returns the new number, whether to keep and what.

    Items are folded in blocks whose results are appended as wholes, as appending to an array copies it.
    """

    def inner(state: Column, x: Column) -> Column:
        at, stays, out = step(state["at"], x)
        return F.struct(at.cast("int").alias("at"), F.when(stays, F.array_append(state["out"], out)).otherwise(state["out"]).alias("out"))

    def outer(state: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("out")), inner)
        return _once(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(state["outs"], r["out"]).alias("outs")))

    def whole(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(F.lit(first).alias("at"), F.slice(F.array(none), 1, 0).alias("outs")), outer, lambda s: F.flatten(s["outs"]))

    return _once(items, whole)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_start(a: Column, b: Column) -> Column:
    """Order of spans: by start, base ones first, then by kind."""
    sign = lambda x, y, rest: F.when(x < y, -1).when(x > y, 1).otherwise(rest)
    return sign(a["start"], b["start"], sign(~a["base"], ~b["base"], sign(a["kind"], b["kind"], sign(a["end"], b["end"], F.lit(0)))))


def _apart(spans: Column) -> Column:
    """Spans by start without those found loosely that meet a base span, or an earlier loose one that stays."""
    none = F.array().cast(SPANS)

    def ahead(reach: Column, x: Column) -> tuple[Column, Column, Column]:
        stays = x["base"] | (x["start"] >= reach)
        return F.when(stays, F.greatest(reach, x["end"])).otherwise(reach), stays, x

    def behind(following: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.when(x["base"], x["start"]).otherwise(following), x["base"] | (x["end"] <= following), x

    kept = _folded(F.array_sort(spans, _by_start), 0, none, ahead)
    return F.reverse(_folded(F.reverse(kept), 2**31 - 1, none, behind))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``candidates``: base spans and others that may be personal data, by start, with what the voters say.

    Places are code points, ends exclusive. A row's work is its own: nothing is shuffled, and time grows with the text and
    the matches. Null and empty texts have none; an own column of that name is replaced.
    """
    own = docs.drop("candidates")
    text = F.coalesce("text", F.lit(""))
    patterns = {(k, base): p for base, of in ((True, BASE), (False, LOOSE)) for k, p in of.items()}
    name = lambda k, base, what: f"_pii_{what}_{k}_{base}"
    own = own.withColumns({name(k, b, "found"): F.regexp_extract_all(text, F.lit(p), F.lit(0)) for (k, b), p in patterns.items()})
    # texts are cut only where there is something
    own = own.withColumns({name(k, b, "cut"): F.when(F.size(name(k, b, "found")) > 0, F.split(text, p, -1)) for (k, b), p in patterns.items()})
    own = own.withColumns({name(k, b, "at"): _placed(F.col(name(k, b, "cut")), F.col(name(k, b, "found")), k, b) for k, b in patterns})
    own = own.withColumn("_pii_all", F.concat(*[F.col(name(k, b, "at")) for k, b in patterns]))
    loose = reduce(lambda a, b: a | b, [F.size(name(k, False, "at")) > 0 for k in LOOSE])
    return own.select(*[F.col(f"`{c}`") for c in docs.columns if c != "candidates"], F.when(loose, _apart(F.col("_pii_all"))).otherwise(F.array_sort(F.col("_pii_all"), _by_start)).alias("candidates"))


# ---------------------------------------------------------------- reliabilities


@dataclass
class Reliability:
    """Of one kind: the share of candidates that are personal data, and how often each voter that votes says 1 of them and of others."""

    share: float
    on: dict[str, float]
    off: dict[str, float]


def _says(rates: dict[str, float], voter: str, vote: int) -> float:
    return rates[voter] if vote == 1 else 1 - rates[voter]


def _posterior(model: dict[int, Reliability]) -> Column:
    def logit(r: Reliability) -> Column:
        z = F.lit(log(r.share / (1 - r.share)))
        for v in VOTERS:
            z = z + F.when(F.col(v) == 1, log(r.on[v] / r.off[v])).when(F.col(v) == -1, log((1 - r.on[v]) / (1 - r.off[v]))).otherwise(0.0)
        return z

    z = reduce(lambda done, k: done.when(F.col("kind") == k, logit(model[k])), list(model)[1:], F.when(F.col("kind") == list(model)[0], logit(model[list(model)[0]])))
    return 1 / (1 + F.exp(-z))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict[int, Reliability]:
    """Estimates by kind from ``patterns`` (kind, VOTERS, n), by expectation maximisation; no candidate's truth is seen.

    A candidate is personal data or not; each voter that votes says 1 at its own rate under either. A round is one
    aggregate over the patterns, which are few however many candidates there are; a row a kind comes back.
    """
    belief = {k: VOTERS | ({"rule": RARE_RULE[name]} if name in RARE_RULE else {}) for k, name in enumerate(KINDS)}
    model = {k: Reliability(0.5, {v: on for v, (on, _) in b.items()}, {v: off for v, (_, off) in b.items()}) for k, b in belief.items()}
    sums = [F.sum("n").alias("n"), F.sum("on").alias("on")]
    for v in VOTERS:
        says = lambda vote, c: F.sum(F.when(F.col(v) == vote, F.col(c)).otherwise(0.0))  # noqa: B023, E731
        sums += [says(1, "on").alias(f"{v}_11"), says(-1, "on").alias(f"{v}_01"), says(1, "off").alias(f"{v}_10"), says(-1, "off").alias(f"{v}_00")]
    for _ in range(rounds):
        moved = 0.0
        weighed = patterns.withColumn("on", F.col("n") * _posterior(model)).withColumn("off", F.col("n") - F.col("on"))
        for r in weighed.groupBy("kind").agg(*sums).collect():
            rate = lambda yes, no, before: (yes + before * BELIEF) / (yes + no + BELIEF)
            new = Reliability(
                rate(r.on, r.n - r.on, 0.5),
                {v: rate(r[f"{v}_11"], r[f"{v}_01"], on) for v, (on, _) in belief[r.kind].items()},
                {v: rate(r[f"{v}_10"], r[f"{v}_00"], off) for v, (_, off) in belief[r.kind].items()},
            )
            moved = max(moved, abs(new.share - model[r.kind].share), *(abs(new.on[v] - model[r.kind].on[v]) for v in VOTERS))
            model[r.kind] = new
        if moved < 1e-4:
            break
    return model


# ---------------------------------------------------------------- classifier

_FEATURES = (*VOTERS, "size", "digits")


def _features(field: Callable[[str], Column]) -> list[Column]:
    return [F.lit(1.0), *[field(v).cast("double") for v in VOTERS], field("size") / 5.0 - 1.0, field("digits") / 5.0 - 1.0]


@dataclass
class Model:
    """Weights of the span classifier by kind."""

    weights: dict[int, list[float]]
    voters: dict[int, Reliability]

    def margin(self, kind: Column, field: Callable[[str], Column]) -> Column:
        out = F.lit(-1.0)
        for k, w in self.weights.items():
            z = reduce(lambda a, b: a + b, [F.lit(c) * x for c, x in zip(w, _features(field), strict=True)])
            out = F.when(kind == k, z).otherwise(out)
        return out


def train(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """A span classifier from the candidates of ``found``: a logistic regression of what the label model makes of them on
    the votes and the form. Candidates that look alike count as one with a weight, and each kind's weights make one in all."""
    c = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.seen.*")
    alike = table(c.groupBy("kind", *_FEATURES).agg(F.count("*").alias("n")).coalesce(1))
    kinds = sorted(r.kind for r in alike.select("kind").distinct().collect())
    if not kinds:
        return Model({}, {})
    voters = reliabilities(alike, rounds)
    total = alike.groupBy("kind").agg(F.sum("n").alias("total"))
    rows = alike.join(F.broadcast(total), "kind").withColumn("weight", F.col("n") / F.col("total")).withColumn("on", _posterior(voters))
    # what each voter's word alone is worth: keeps the weights of voters that the candidates at hand hardly try
    alone = [(k, *[vote * (v == w) for w in VOTERS], 5, 5, ALONE, 1 / (1 + (_says(r.off, v, vote) / _says(r.on, v, vote)))) for k, r in voters.items() if k in kinds for v in VOTERS for vote in (1, -1)]
    names = ["kind", *_FEATURES, "weight", "on"]
    rows = rows.select(*names).unionByName(found.sparkSession.createDataFrame(alone, ", ".join(f"{c} {'double' if c in names[-2:] else 'int'}" for c in names)))
    rows = rows.withColumn("on", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("on"))))
    zero = [F.lit(0.0)] * len(_features(F.col))
    wide = F.concat(*[F.when(F.col("kind") == k, F.array(*_features(F.col))).otherwise(F.array(*zero)) for k in kinds])
    both = F.inline(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("weight") * F.col("on")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("weight") * (1 - F.col("on"))).alias("weight"))))
    rows = rows.select(array_to_vector(wide).alias("features"), both).coalesce(1)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, fitIntercept=False, standardization=False, maxIter=60).fit(rows)
    w = [float(x) for x in fitted.coefficients]
    n = len(zero)
    return Model({k: w[i * n : i * n + n] for i, k in enumerate(kinds)}, voters)


def personal_data(found: DataFrame, model: Model, least: float = LEAST_CHANCE) -> DataFrame:
    """``found`` with ``spans``, array of (kind, start, end, base), in place of its candidates: all base spans, and others whose chance is ``least`` or more."""
    bar = log(least / (1 - least))
    stay = F.filter("candidates", lambda c: c["base"] | (model.margin(c["kind"], lambda f: c["seen"][f]) >= bar))
    kind = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(stay, lambda c: F.struct(F.get(kind, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return found.withColumn("spans", spans).drop("candidates")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    found = table(candidates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    spans = personal_data(found, train(found))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
