"""Operator 3: personal data by weakly supervised span labelling, in SQL functions only.

One pass over each text finds strict (base) and loose candidates. A text is split at a pattern and the
parts are zipped with the matches, so that one running sum gives each match its place. Labelers vote on
every candidate: a format check, a gazetteer, the words before it, and its variety of characters. EM
estimates, for each kind, how far each labeler can be trusted, from the histogram of vote patterns (at
most 81 rows a kind); its posteriors are the labels on which a logistic span classifier is trained, again
over a histogram. Base spans stay; loose ones are added if the classifier says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribespark.functions.let import let
from scribespark.llm import weak
from scribespark.llm.shared import text_of, written

# The base kinds' patterns, with possessive repeats and, where a failed start would be tried
# again inside the same run, a look behind; both find what the plain patterns find, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # fewer than 16 digits fail the check of the kind: such runs needn't be listed first
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms, each a candidate that the classifier may turn down; the last kind is ours.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}+){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z._/-])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9A-Za-z]|[._/-][0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<![0-9+.)-] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:password|passwd|token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_-]{8,}+\"?|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": ["@"], "phone": ["+"]}
LOOSE_NEEDS = {"email": ["[at]", "(at)"], "ip": [".]", ".)", "dot]", "dot)"], "secret": ["=", ":", "AKIA"]}
KINDS = ("email", "ip", "card", "phone", "secret")

# Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca")
CARD_STARTS = "^(?:4|5[1-5]|2[2-7]|6011|65|62|35)"
DIAL_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRET_STARTS = r"^(?:AKIA|password|passwd|token|secret|api_key)"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|from|to)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|contact|reach)\b",
    "secret": r"(?i)\b(?:key|login|credential|access|auth|secret|config)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|ver|isbn|issn|order|item|page|section|chapter|total|sum|serial|example)\b[^A-Za-z]*$"

LABELERS = ("format", "gazetteer", "context", "variety")
#: Code points before a match that the context labeler sees.
CONTEXT = 40

_MATCH = "array<struct<s:int,e:int,m:string,before:string>>"


def _holds(text: Column, needs: list[str] | None) -> Column:
    found = text.rlike("[0-9]")
    if needs:
        found = F.lit(False)
        for x in needs:
            found = found | F.contains(text, F.lit(x))
    return found


def _running(sizes: Column) -> Column:
    """Running sums of an array: each turn adds what stands 1, 2, 4 ... places before."""

    def turn(done: Column, step: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(0), step), done), F.lit(1), F.size(done))
        return F.zip_with(done, before, lambda a, b: a + b)

    # steps below the array's size
    turns = F.when(F.size(sizes) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(turns, lambda k: F.call_function("shiftleft", F.lit(1), k)), sizes, turn)


def matches(text: Column, pattern: str, needs: list[str] | None = None) -> Column:
    """Leftmost matches that don't overlap: s, e (code points, end exclusive), m, and what is before."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def placed(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda x: F.char_length(x["part"]) + F.char_length(x["match"])))
        return F.zip_with(parts, ends, lambda x, e: F.struct((e - F.char_length(x["match"])).alias("s"), e.alias("e"), x["match"].alias("m"), F.right(x["part"], F.lit(CONTEXT)).alias("before")))

    # the part after the last match has none
    found = let(F.filter(zipped, lambda x: x["match"].isNotNull()), placed)
    return F.when(_holds(text, needs), found).otherwise(F.array().cast(_MATCH))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The base kinds' checks of a match."""
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda x: ~x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.char_length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(8, 15)
    return F.lit(True)


def _said(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def votes(kind: str, strict: bool, x: Column) -> Column:
    """The LABELERS' votes on a candidate, as an array."""
    m, none = x["m"], F.lit(False)
    if kind == "ip":
        m = F.regexp_replace(m, r" ?[\[(](?:\.|dot)[\])] ?", ".")
    known = {
        "email": _said(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(*DOMAINS), none),
        "ip": _said(~m.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\."), m.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")),
        "card": _said(m.rlike(CARD_STARTS), ~m.rlike(CARD_STARTS)),
        "phone": _said(m.rlike(DIAL_CODES), m.rlike(r"^\+") & ~m.rlike(DIAL_CODES)),
        "secret": _said(m.rlike(SECRET_STARTS), none),
    }[kind]
    # a loose secret needs letters and digits, a loose ip or card the check of its kind; others are right in shape only
    right = m.rlike("[0-9]") & m.rlike("[A-Za-z]") if kind == "secret" else valid(kind, m)
    form = F.lit(1) if strict else _said(right, ~right) if kind in ("secret", "ip", "card") else F.lit(0)
    context = _said(x["before"].rlike(CUES[kind]), x["before"].rlike(COUNTER_CUES))
    # few different characters: a made-up or placeholder value
    chars = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^0-9A-Za-z]", ""), "")))
    return F.array(form.cast("int"), known, context, _said(chars >= 5, chars < 4))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (by kind: spans that pass their checks) and loose (by kind); both with votes."""
    text = text_of(text_col)

    def found(kind: str, pattern: str, needs: list[str] | None, strict: bool) -> Column:
        spans = matches(F.col("text"), pattern, needs)
        spans = F.filter(spans, lambda x: valid(kind, x["m"])) if strict else spans
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), votes(kind, strict, x).alias("v")))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = [found(k, p, NEEDS.get(k), True).alias(f"base_{k}") for k, p in BASE.items()]
    loose = [found(k, p, LOOSE_NEEDS.get(k), False).alias(f"loose_{k}") for k, p in LOOSE.items()]
    return rows.select("doc_id", *base, *loose)


def histogram(found: DataFrame) -> DataFrame:
    """kind, v, n: how often each pattern of votes occurs among all candidates; at most 81 rows a kind."""
    def of(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["v"].alias("v")))

    each = F.concat(*(of(f"base_{k}", k) for k in BASE), *(of(f"loose_{k}", k) for k in LOOSE))
    return found.select(F.explode(each).alias("x")).groupBy("x.kind", "x.v").agg(F.count("*").alias("n"))


def train(counts: list[tuple[str, tuple[int, ...], int]]) -> list[float]:
    """The span classifier's weights: a bias by kind, a weight for each labeler's yes and no."""
    rows = []
    for kind in KINDS:
        own = {tuple(v): n for k, v, n in counts if k == kind}
        model = weak.estimate(own, len(LABELERS), prior=0.5)
        rows += [(features(kind, v), model.posterior(v), float(n)) for v, n in own.items()]
    return weak.logistic(rows, len(KINDS) + 2 * len(LABELERS)) if rows else [0.0] * (len(KINDS) + 2 * len(LABELERS)) + [0.0]


def features(kind: str, v: tuple[int, ...]) -> list[float]:
    return [float(k == kind) for k in KINDS] + [float(x == 1) for x in v] + [float(x == -1) for x in v]


def _probability(weights: list[float], kind: str, v: Column) -> Column:
    n = len(KINDS)
    logit = F.lit(weights[KINDS.index(kind)] + weights[-1])
    for j in range(len(LABELERS)):
        logit = logit + F.when(v[j] == 1, weights[n + j]).when(v[j] == -1, weights[n + len(LABELERS) + j]).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


SPAN = "array<struct<kind:string,s:int,e:int,p:double>>"


def find(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, base and spans, arrays of (kind, s, e, p) by kind, then start.

    ``spans`` has all base spans and the loose candidates to which the classifier gives a probability
    of ``least`` or more. Null texts have none; repeated rows are searched each; extra columns are left
    out; an empty table gives no rows. Places count code points, ends are exclusive.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    weights = train([(r.kind, tuple(r.v), r.n) for r in histogram(found).collect()])

    def spans(name: str, kind: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _probability(weights, kind, x["v"]).alias("p")))

    base = {k: spans(f"base_{k}", k) for k in BASE}
    more = {k: F.filter(spans(f"loose_{k}", k), lambda x: x["p"] >= least) for k in LOOSE}
    everything = [F.array_sort(F.concat(*(x[k] for x in (base, more) if k in x)), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["e"] - b["e"])) for k in KINDS]
    return found.select("doc_id", F.concat(*base.values()).alias("base"), F.concat(*everything).alias("spans"))


def listed(spans: Column | str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
