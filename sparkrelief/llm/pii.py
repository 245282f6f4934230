"""Operator 2: personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers exactly as defined; wider patterns propose more candidates: written-out
addresses, numbers that fail a check, unprefixed phone numbers, and keys and
tokens, a kind without a base pattern. Labelers vote for, against or not at all:
the pattern, a check of the form, a gazetteer, the words before a span, and what
it touches. Expectation-maximisation over the counts of vote patterns (a table of
bounded size) estimates without labels how often each labeler votes how on true
and on other spans; its posteriors train a logistic span classifier on the
votes. Base spans always stay; the classifier alone decides on others.

Matches carry code-point offsets: splitting at a pattern gives the texts
between matches, and running sums of lengths give the places. All texts are
matched once; candidates and votes are staged, and learned from and judged there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, staged

#: Kinds in the order of the results; the last has no base pattern.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Base patterns. Possessive forms of the stated ones: a run that fails from its start fails from any place in it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT, _AT = r" ?(?:\(dot\)|\[dot\]|\[\.\]|(?<= )dot(?= )) ?", r" ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?"
#: Patterns of further candidates.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z]{{2,24}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?|\[\.\])[0-9]{1,3}(?: ?\. ?|\[\.\])[0-9]{1,3}(?: ?\. ?|\[\.\])[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])(?<![0-9][ ._-])[0-9](?:[ ._-]?[0-9]){11,18}+(?![ ._-]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9.-])[0-9]{9,11}+(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?:[A-Za-z]{2,4}[_-])?[A-Za-z0-9_/+-]{20,}+={0,2}+(?![A-Za-z0-9_/+=-])",
}
#: What a wide candidate may have for the pattern labeler not to vote against it.
STRICT = {
    "email": r"[\[(]",
    "ip": r"\[\.\]| ",
    "card": r"^[0-9]{4}([ ._-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[47][0-9]{13}$|^3[47][0-9]{2}[ ._-][0-9]{6}[ ._-][0-9]{5}$",
    "phone": r"^\([0-9]{3}\) ?[0-9]{3}[ .-]|^[0-9]{3}([ .-])[0-9]{3}\1",
    "secret": r"^[0-9a-fA-F]{32,}$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*$",
}
#: Cheap tests that every match passes.
_NEEDS = {"email": "@", "phone": "+"}
#: Words of the gazetteer: ends of addresses, first octets in use, first digits of card issuers, area and country codes, beginnings of keys.
GAZETTEER = {
    "email": r"(?i)[. )\]](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[ .\[]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|33|34|44|49)|\(?[2-9])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|xox[abp]-|eyJ)",
}
#: Words that announce a kind, and words that announce something else, in the 40 characters before a span.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|correo|courriel|kontakt)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|server|host|adresse|direcci)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|konto)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobil|rufen|appel|llam)\w*\W*(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:token|secret|passw\w*|api.?key|access.?key|bearer|credential)\W*$",
}
AGAINST = {
    "email": r"(?i)(?:look|meet|arrive|stay)\w*\W*$",
    "ip": r"(?i)(?:version|release|section|chapter|v)\W*$",
    "card": r"(?i)(?:order|invoice|serial|isbn|id|nr|no|number|ref)\W*$",
    "phone": r"(?i)(?:order|invoice|serial|isbn|id|ref|total|sum|population)\W*$",
    "secret": r"(?i)(?:sha\d*|md5|commit|checksum|digest|hash|https?:)\W*$",
}
LABELERS = ("pattern", "form", "gazetteer", "context", "free")
#: A further span is added from this probability on.
ACCEPT = 0.5
EM_ROUNDS = 30
#: How often a labeler is held to vote against, not at all and for, on true spans and on others, before any data are seen; as numbers of spans.
PRIOR_VOTES = ((2.0, 6.0, 12.0), (10.0, 8.0, 2.0))
_PIECE = 256
_SPAN = "array<struct<start:int,end:int,match:string>>"


def _running(values: Column, zero: Column, add) -> Column:
    """``add`` over all entries before each; in pieces, so that long arrays cost little more than short ones."""
    begin = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(begin, lambda i: F.slice(values, i, F.lit(_PIECE)))
    step = lambda a, x: F.struct(add(a.s, x).alias("s"), F.concat(a.l, F.array(a.s)).alias("l"))
    start = F.struct(zero.alias("s"), F.array().cast("array<int>").alias("l"))
    before = lambda x: F.aggregate(x, start, step, lambda a: a.l)
    ahead = before(F.transform(cut, lambda c: F.aggregate(c, zero, add)))
    return F.flatten(F.zip_with(cut, ahead, lambda c, b: F.transform(before(c), lambda x: add(b, x))))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that don't overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda s: F.length(s))
    sizes = F.transform(found, lambda s: F.length(s))
    ahead = _running(F.zip_with(between, sizes, lambda a, b: a + b), F.lit(0), lambda a, x: a + x)
    starts = F.zip_with(ahead, between, lambda a, b: a + b)
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) + 1)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _form(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, match>> of one kind, by the base pattern and its check."""
    has = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(BASE[kind])
    return F.when(has, F.filter(_matches(text, BASE[kind]), lambda m: _form(kind, m.match))).otherwise(F.array().cast(_SPAN))


def _wide_form(kind: str, m: Column) -> Column:
    """The labeler of form, for any candidate."""
    if kind == "ip":
        return _form("ip", F.regexp_replace(m, r"[ \[\]]", ""))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z].*[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 9)
    return ~m.rlike(r"\.\.|^[.]")


def _votes(kind: str, text: Column, m: Column, base: bool) -> Column:
    """The labelers' votes on a candidate, 1 for, -1 against, 0 none: a struct."""
    before = F.substring(text, F.greatest(m.start - 39, F.lit(1)), F.least(m.start, F.lit(40)))
    after = F.substring(text, m.end + 1, F.lit(1))
    sure = lambda c: F.when(c, 1).otherwise(-1)
    # a key stands after an equals sign or a colon; elsewhere that is part of something longer
    left = r"[\p{L}\p{N}_/#]$" if kind == "secret" else r"[\p{L}\p{N}_=/#:]$"
    made = {
        "pattern": F.lit(1) if base else F.when(m.match.rlike(STRICT[kind]), 0).otherwise(-1),
        "form": sure(_wide_form(kind, m.match)),
        "gazetteer": F.when(m.match.rlike(GAZETTEER[kind]), 1).otherwise(0),
        "context": F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(AGAINST[kind]), -1).otherwise(0),
        "free": sure(~before.rlike(left) & ~after.rlike(r"[\p{L}\p{N}_=/#@]")),
    }
    return F.struct(*[made[k].cast("tinyint").alias(k) for k in LABELERS])


def candidates(docs: DataFrame, row: Column, name: str = "candidates") -> DataFrame:
    """``row`` and, for each kind, ``base`` spans and the wider candidates that don't touch any, ``more``, with votes; staged."""
    own = docs.select(row.alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    own = own.withColumns({f"base_{k}": base_spans(F.col("text"), k) for k in BASE_KINDS})
    taken = F.concat(*[F.col(f"base_{k}") for k in BASE_KINDS])
    wide = lambda k: F.when(F.col("text").rlike(WIDE[k]), _matches(F.col("text"), WIDE[k])).otherwise(F.array().cast(_SPAN))
    own = own.withColumns({f"more_{k}": F.filter(wide(k), lambda m: ~F.exists(taken, lambda b: (m.start < b.end) & (b.start < m.end))) for k in KINDS})
    voted = lambda k, side: F.transform(F.col(f"{side}_{k}"), lambda m: F.struct(F.lit(k).alias("kind"), m.start.alias("start"), m.end.alias("end"), _votes(k, F.col("text"), m, side == "base").alias("v")))
    return staged(own.select("row", F.concat(*[voted(k, "base") for k in BASE_KINDS]).alias("base"), F.concat(*[voted(k, "more") for k in KINDS]).alias("more")), name)


def learn(found: DataFrame) -> dict[str, list[float]]:
    """For each kind the weights of the span classifier: a constant, then for each labeler one of a vote for and one of a vote against.

    What reaches the driver is a count for each kind and pattern of five votes, 1215 rows at most.
    """
    counts = found.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.kind", "x.v").count().collect()
    return {k: _trained([(tuple(r["v"][f] for f in LABELERS), r["count"]) for r in counts if r["kind"] == k]) for k in KINDS}


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]], list[float]]:
    """EM on vote patterns: the share of true spans, each labeler's rates of votes (-1, 0, 1) on true spans and on others, posteriors."""
    prior = 0.5
    shares = lambda c: tuple(x / sum(c) for x in c)
    rates = [(shares(PRIOR_VOTES[0]), shares(PRIOR_VOTES[1]))] * len(LABELERS)
    total = sum(c for _, c in patterns)
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for v, _ in patterns:
            t, f = prior, 1 - prior
            for j, x in enumerate(v):
                t *= rates[j][0][x + 1]
                f *= rates[j][1][x + 1]
            post.append(t / (t + f))
        yes = sum(p * c for p, (_, c) in zip(post, patterns, strict=True))
        prior = (yes + 1) / (total + 2)
        seen = lambda j, x, side: PRIOR_VOTES[side][x + 1] + sum((1 - p if side else p) * c for p, (v, c) in zip(post, patterns, strict=True) if v[j] == x)
        rates = [tuple(shares([seen(j, x, side) for x in (-1, 0, 1)]) for side in (0, 1)) for j in range(len(LABELERS))]
    return prior, rates, post


def _features(v: tuple[int, ...]) -> list[int]:
    return [1, *[int(x == sign) for x in v for sign in (1, -1)]]


def _trained(patterns: list[tuple[tuple[int, ...], int]], steps: int = 400) -> list[float]:
    """Logistic regression on the posteriors, weighted by counts, with a small penalty; gradient descent over patterns."""
    w = [0.0] * (2 * len(LABELERS) + 1)
    if not patterns:
        return w
    patterns = sorted(patterns)
    post = reliabilities(patterns)[2]
    total = sum(c for _, c in patterns)
    for _ in range(steps):
        g = [0.001 * x for x in w]
        for p, (v, c) in zip(post, patterns, strict=True):
            x = _features(v)
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p
            g = [a + e * b * c / total for a, b in zip(g, x, strict=True)]
        w = [x - 1.0 * y for x, y in zip(w, g, strict=True)]
    return w


def _accepted(m: Column, weights: dict[str, list[float]]) -> Column:
    """Whether the classifier of the span's kind gives at least ``ACCEPT``."""
    out = F.lit(False)
    for kind, w in weights.items():
        s = F.lit(float(w[0]))
        for i, f in enumerate(LABELERS):
            s = s + F.when(m.v[f] == 1, float(w[2 * i + 1])).when(m.v[f] == -1, float(w[2 * i + 2])).otherwise(0.0)
        out = F.when(m.kind == kind, s >= math.log(ACCEPT / (1 - ACCEPT))).otherwise(out)
    return out


def find(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``row`` (by default all columns, as a struct), and ``base`` and ``spans``: array<struct<kind, start, end>> by kind as listed, then start.

    Null and empty texts have none. Offsets count code points, the end is exclusive. Texts may be of any length.
    Repeated rows get equal results; extra columns may have any names; an empty table gives an empty result. Of
    spans of one kind none overlap; spans of different kinds may.
    """
    found = candidates(docs, F.struct("*") if row is None else row)
    weights = learn(found)
    plain = lambda x: F.transform(x, lambda m: F.struct(m.kind.alias("kind"), m.start.alias("start"), m.end.alias("end")))
    every = F.concat("base", F.filter("more", lambda m: _accepted(m, weights)))
    of_kind = lambda k: lambda m: m.kind == k
    spans = F.concat(*[F.array_sort(plain(F.filter(every, of_kind(k)))) for k in KINDS])
    return found.select("row", plain(F.col("base")).alias("base"), spans.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document with its columns, each span replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, by the kind that starts first (of those, by the longest). ``n_chars``, if
    there, follows the text; null texts stay, with their ``n_chars``. Repeated rows are all kept; an empty table
    gives an empty one.
    """
    found = find(docs)
    ends = lambda x: F.transform(x, lambda s: -s.back)
    most = lambda a, x: F.greatest(a, x)
    found = found.withColumn("order", F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.kind.alias("kind")))))
    found = found.withColumn("ahead", _running(ends(F.col("order")), F.lit(0), most))
    # a span that starts where all before it have ended begins a stretch, which ends with what came before the next one
    found = found.withColumn("heads", F.filter(F.zip_with("order", "ahead", lambda s, a: F.struct(s.start.alias("start"), s.kind.alias("kind"), a.alias("done"))), lambda h: h.start >= h.done))
    found = found.withColumn("done", F.concat(F.transform("heads", lambda h: h.done), F.array(F.array_max(ends(F.col("order"))))))
    text = F.col("row.text")
    pieces = F.transform("heads", lambda h, i: F.concat(F.substring(text, F.get("done", i) + 1, h.start - F.get("done", i)), F.lit("<"), h.kind, F.lit(">")))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at("done", -1) + 1, F.length(text)))
    made = {"text": F.when(F.size("heads") == 0, text).otherwise(clean)}
    done = found.select("row", made["text"].alias("text"))
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("text"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[F.col("text") if c == "text" else made[c].alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    out = find(read(spark, sf_dir, "documents", "doc_id", "text"), F.struct("doc_id"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return out.select("row.doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
