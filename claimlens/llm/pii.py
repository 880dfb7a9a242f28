"""Personal data by weak supervision, in column expressions only.

Spans that four base patterns find are always returned.  Wider patterns propose
further spans (spelled-out e-mail addresses, telephone numbers without a plus,
IPv6 addresses, card numbers with other separators).  Every span, base or
proposed, gets votes from labelers: 1 (personal), 0 (not), null (no opinion).

* ``form`` (regex): the base pattern or a strict form of the wider one;
* ``check`` (regex): checksum or range checks;
* ``list`` (gazetteer): known top-level domains, card issuers, area codes, reserved networks;
* ``edges`` (context): clean characters on both sides;
* ``cue`` (context): a cue word shortly before, for or against.

Expectation-maximisation over the table of vote patterns (at most 3^5 rows a
kind, counted over all spans) estimates how reliable each labeler is.  Its
probabilities are the soft labels of the final span classifier, a logistic
regression over the votes and over the span's shape and context (length, share
of digits, capitals, the characters on both sides), which no labeler sees in
full.  It is trained on the distinct combinations, counted over all spans and
weighted by the logarithm of their counts; their number has a fixed bound.
Proposed spans that it accepts and that overlap no base span are added.

Defined results: null text is the empty text and has no spans; rows are judged
one by one, so null or repeated ids and repeated rows are kept as they are; an
empty table gives no rows (and trains nothing); columns beside the two named
ones are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm import spans as S
from claimlens.session import materialize

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["form", "check", "list", "edges", "cue"]
THRESHOLD = 0.5

# Possessive quantifiers and look-behinds keep the searches linear; they change no match:
# a run is entered at its start, or where the match before ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z]{2,24}+)++",
    # eight groups; or fewer around "::", or before it if the first is long, with a digit (IPv4 tails are base spans)
    "ip": r"(?<![0-9A-Za-z:._])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
          r"|(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:){1,5}:)"
          r")(?![0-9A-Za-z:_]|\.[0-9])",
    "card": r"(?<![0-9./_-])[0-9]{4}(?:([._/])[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9./_-])",
    "phone": r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: A literal or class without which a text is not searched.
NEEDS = {"email": "@", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{11}",
         "wide_email": r"[(\[{]at[)\]}]", "wide_ip": "[0-9A-Fa-f]::?[0-9A-Fa-f]", "wide_card": "[0-9][._/][0-9]{4}[._/]",
         "wide_phone": "[0-9][ .-][0-9]{4}"}

# Cue words, domains, issuers.
CUES = {"email": "mail|contact|write|reach", "ip": "ip|host|address|server|from|login",
        "card": "card|visa|master|amex|credit|debit|payment", "phone": "phone|tel|call|mobile|fax|contact|cell"}
COUNTER_CUES = "version|release|isbn|issn|order|invoice|serial|part|model|ticket|build|section"
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pl|br|in|jp|cn|ru|au"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\..*"


def _searched(text: Column, need: str) -> Column:
    return F.when(text.contains(need) if need == "@" else text.rlike(need), text)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0 or null; a null condition is no opinion."""
    v = F.when(yes, 1)
    return v.when(no, 0) if no is not None else v.otherwise(0)


def _votes(kind: str, base: bool, s: Column) -> Column:
    digits = S.digits(s["match"])
    n = F.length(digits)
    form = F.lit(1) if base else F.lit(None).cast("int")
    if kind == "email":
        tld = F.lower(F.regexp_extract(s["match"], r"([A-Za-z0-9-]+)$", 1))
        check = _vote(F.length(tld).between(2, 24) & tld.rlike("^[a-z]+$"))
        listed = F.when(tld.rlike(f"^(?:{DOMAINS})$"), 1)
    elif kind == "ip":
        check = F.lit(1) if base else _vote(~s["match"].rlike("^[0:]*$"))
        listed = _vote(F.lit(False), s["match"].rlike(RESERVED)) if base else F.lit(None).cast("int")
    elif kind == "card":
        check = _vote(S.luhn(digits))
        listed = _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9]|2))"))
    else:
        area = F.substring(digits, -10, 3)
        check = _vote(n.between(9, 15))
        listed = _vote(F.substring(area, 1, 1).isin(*"23456789") & (n >= 10), F.substring(area, 1, 1).isin("0", "1") & (n >= 10))
    left, right = F.substring(s["before"], -1, 1), F.substring(s["after"], 1, 1)
    joins = r"[\p{L}\p{N}_@/=&#%-]"
    edges = _vote(~(left.rlike(joins) | right.rlike(joins)))
    near = F.lower(F.substring(s["before"], -24, 24))
    cue = _vote(near.rlike(rf"(?:^|[^a-z])(?:{CUES[kind]})"), near.rlike(rf"(?:^|[^a-z])(?:{COUNTER_CUES})"))
    return F.struct(*[v.cast("int").alias(k) for k, v in zip(LABELERS, (form, check, listed, edges, cue))])


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return S.ip_parts_ok(s["match"])
    digits = S.digits(s["match"])
    if kind == "card":
        # the checksum is worked out for strings of a card's length only
        return F.when(F.length(digits).between(12, 19), S.luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Shape and context of a span: each a small class number, with the number of classes.
SHAPE = {"size": 4, "numeric": 4, "capital": 2, "left": 5, "right": 5}


def _beside(c: Column) -> Column:
    """0 nothing, 1 blank, 2 letter, 3 digit, 4 other."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2) \
        .when(c.rlike(r"^\p{N}"), 3).otherwise(4)


def _shape(s: Column) -> Column:
    n = F.length(s["match"])
    values = {"size": F.least(F.floor(n / 8), F.lit(3)), "numeric": F.floor(F.length(S.digits(s["match"])) * 3 / n),
              "capital": s["match"].rlike("[A-Z]"), "left": _beside(F.substring(s["before"], -1, 1)),
              "right": _beside(F.substring(s["after"], 1, 1))}
    return F.struct(*[values[k].cast("int").alias(k) for k in SHAPE])


def _plausible(kind: str, s: Column) -> Column:
    """Of the spans that the wide pattern finds: addresses of at most eight groups."""
    return F.size(F.split(s["match"], ":+")) <= 8 if kind == "ip" else F.lit(True)


SPAN = ("struct<start:int,kind:int,end:int,votes:struct<" + ",".join(f"{k}:int" for k in LABELERS)
        + ">,shape:struct<" + ",".join(f"{k}:int" for k in SHAPE) + ">>")
NO_SPANS = f"array<{SPAN}>"


def _spans(kind: str, raw: Column, base: bool) -> Column:
    k = KINDS.index(kind)
    ok = F.filter(raw, lambda s: _valid(kind, s) if base else _plausible(kind, s))
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"),
                                              _votes(kind, base, s).alias("votes"), _shape(s).alias("shape")))


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, proposed): the kept columns as a struct, and sorted arrays of spans with votes;
    proposed ones overlap no base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(
        F.struct(*(keep or ["doc_id"])).alias("row"),
        *[S.raw_spans(_searched(t, NEEDS[k]), BASE[k]).alias(f"b_{k}") for k in KINDS],
        *[S.raw_spans(_searched(t, NEEDS[f"wide_{k}"]), WIDE[k]).alias(f"w_{k}") for k in KINDS])
    none = F.array().cast(NO_SPANS)

    def union(prefix: str, base: bool) -> Column:
        return F.array_sort(F.concat(*[F.coalesce(_spans(k, F.col(f"{prefix}_{k}"), base), none) for k in KINDS]))

    both = raw.select("row", union("b", True).alias("base"), union("w", False).alias("wide"))
    return both.select("row", "base", S.apart(F.col("wide"), F.col("base")).alias("proposed"))


# ---------------------------------------------------------------- label model

def estimate(patterns: list[tuple[int, tuple, int]], rounds: int = 50) -> list[float]:
    """Probability that a span of each (kind, votes, count) pattern is personal.

    EM for labelers that are independent given the truth, each with its own hit and false-alarm
    rate for every kind; add-one smoothing.  The table is bounded by 3^labelers rows a kind.
    """
    p = [sum(v or 0 for v in votes) / max(1, sum(v is not None for v in votes)) for _, votes, _ in patterns]
    p = [0.1 + 0.8 * x for x in p]
    for _ in range(rounds):
        prior: dict = {}
        rate: dict = {}
        for (kind, votes, n), q in zip(patterns, p):
            a, b = prior.get(kind, (1.0, 1.0))
            prior[kind] = (a + n * q, b + n * (1 - q))
            for j, v in enumerate(votes):
                if v is not None:
                    # pseudo-counts: a labeler is taken to be right more often than not
                    h1, h, f1, f = rate.get((kind, j), (3.0, 4.0, 1.0, 4.0))
                    rate[kind, j] = (h1 + n * q * v, h + n * q, f1 + n * (1 - q) * v, f + n * (1 - q))
        new = []
        for kind, votes, _ in patterns:
            a, b = prior[kind]
            score = math.log(a / b)
            for j, v in enumerate(votes):
                if v is not None:
                    h1, h, f1, f = rate[kind, j]
                    hit, false = h1 / h, f1 / f
                    score += math.log(hit / false) if v else math.log((1 - hit) / (1 - false))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
        p = new
    return p


def features(kind: Column, votes: Column, shape: Column) -> list[Column]:
    """Kind indicators, a for and an against indicator for each labeler, indicators of the shape's classes."""
    on = [(kind == i).cast("double") for i in range(len(KINDS))]
    for j in LABELERS:
        on += [F.coalesce((votes[j] == v).cast("double"), F.lit(0.0)) for v in (1, 0)]
    return on + [(shape[k] == v).cast("double") for k, n in SHAPE.items() for v in range(n)]


def _pattern(kind: Column, votes: Column) -> Column:
    """A number for each kind and vote pattern."""
    code = kind
    for j in LABELERS:
        code = code * 3 + F.coalesce(votes[j], F.lit(2))
    return code


def train(cands: DataFrame) -> list[float] | None:
    """Weights of the final classifier (intercept first); None if there is no span at all.

    The counted combinations of kind, votes and shape stay a table (of at most 4 x 3^5 x 800 rows, whatever
    the input); only vote patterns with their counts reach the driver, and go back with their probabilities."""
    spans = cands.select(F.explode(F.concat("base", "proposed")).alias("s"))
    counts = materialize(spans.groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")), "pii-patterns")
    by_votes = counts.groupBy("kind", *[F.col(f"votes.{j}").alias(j) for j in LABELERS]).agg(F.sum("n").alias("n"))
    patterns = [(r["kind"], tuple(r[j] for j in LABELERS), r["n"]) for r in by_votes.collect()]  # bounded: 4 x 3^5
    if not patterns:
        return None
    patterns.sort(key=lambda x: (x[0], [(-1 if v is None else v) for v in x[1]]))
    rows = [{"kind": k, **dict(zip(LABELERS, votes)), "q": q} for (k, votes, _), q in zip(patterns, estimate(patterns))]
    schema = "array<struct<kind:int," + "".join(f"{j}:int," for j in LABELERS) + "q:double>>"
    soft = cands.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema))) \
        .select(_pattern(F.col("kind"), F.struct(*LABELERS)).alias("pattern"), "q")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    # every combination counts as both classes, by its probability; logarithmic counts keep rare ones heard
    classes = F.array(F.struct(F.lit(1.0).alias("label"), F.col("q").alias("part")),
                      F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("part")))
    x = counts.withColumn("pattern", _pattern(F.col("kind"), F.col("votes"))).join(F.broadcast(soft), "pattern") \
        .select("n", array_to_vector(F.array(*features(F.col("kind"), F.col("votes"), F.col("shape")))).alias("features"),
                F.explode(classes).alias("c")) \
        .select("features", "c.label", (F.log1p("n") * F.col("c.part")).alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50, standardization=False).fit(x)
    return [float(model.intercept), *map(float, model.coefficients.toArray())]


def detect(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, spans): the kept columns (doc_id) as a struct; spans are the base ones and
    the accepted proposed ones, sorted."""
    cands = materialize(candidates(docs, text, keep), "pii-candidates")
    weights = train(cands)
    if weights is None:
        return cands.select("row", "base", F.col("base").alias("spans"))

    def accepted(s: Column) -> Column:
        z = F.lit(weights[0])
        for w, x in zip(weights[1:], features(s["kind"], s["votes"], s["shape"])):
            z = z + F.lit(w) * x
        return 1 / (1 + F.exp(-z)) >= threshold

    added = F.filter("proposed", accepted)
    return cands.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The rows of op1."""
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return found.select("row.doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(S.joined(F.col("base"), KINDS), 256).alias("base_sha256"), S.joined(F.col("spans"), KINDS).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one mark."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    return S.replaced(text, spans, lambda s: F.get(names, s["kind"]))
