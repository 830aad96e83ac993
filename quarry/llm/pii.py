"""Personal data by weak supervision, in DataFrame operations only.

Four kinds with a fixed form (email, ip, card, phone) are found by their patterns and always reported.
Candidates of further kinds (secrets, account and identity numbers, names) are proposed loosely;
labelers vote on each: strict patterns, gazetteers, and words in the context. Expectation-maximisation over all
candidates estimates freely which share of each labeler's votes is right, and the share of personal data among the candidates;
its posteriors train the final span classifier, a naive
Bayes over the votes and the shape and surroundings of a span, which decides.

Positions are code points, ends exclusive. They come from the texts between the matches, so no Python runs.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows each have
theirs; a candidate that overlaps a fixed span is dropped; other columns are kept by `redact`,
whatever their names; an empty table gives an empty result (and untrained labelers, as they start).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import cut, documents
from .weak import Voters, fit

# The four patterns. A last group is possessive, as nothing follows that it could give back to.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

SIGNED = r"eyJ[A-Za-z0-9_-]++(?:\.{1,2}[A-Za-z0-9_-]++){1,4}+"

# Loose patterns of further kinds, and the strict ones.
LOOSE = {
    # signed tokens of segments with dots; other long tokens, with further segments that are long themselves
    "secret": r"(?<![A-Za-z0-9_/+=.-])(?:" + SIGNED + r"|[A-Za-z0-9_/+=-]{20,}+(?:\.[A-Za-z0-9_/+=-]{16,}+)*+)",
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?<=[Mm]y name is |contact |Contact |Signed, )\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+",
}
STRICT = {
    "secret": r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|xox[bap]|glpat)[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|" + SIGNED + ")$",
    "account": r"^(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{12,30}|[0-8][0-9]{2}-[0-9]{2}-[0-9]{4})$",
    "name": r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
}
CONTEXT = {
    "secret": r"(?i)(?:token|secret|passwo?r?d|pwd|api.?key|access.?key|private.?key|bearer|credential)\W{0,6}$",
    "account": r"(?i)(?:iban|ssn|social security|account|passport|insurance|tax id)\W{0,6}(?:no|number|nr)?\W{0,4}$",
    "name": r"(?i)(?:name is|contact|signed|dear|regards|sincerely|by|from)\W{0,3}$",
}
#: A name and a sign that stand in the candidate itself, as loose patterns take both.
KEYED = r"(?i)^[a-z0-9_-]*(?:token|secret|passwo?r?d|pwd|api_?-?key|access_?-?key|private_?-?key|credential)[a-z0-9_-]*="
_COUNTRIES = """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV
    LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK"""
_PREFIXES = "sk pk rk ghp gho ghu ghs ghr github_pat glpat xoxa xoxb xoxp xoxr xoxs AKIA ASIA AIza ya29 eyJ npm_ pypi- SG dop_v1 hf_ sq0 shpat EAAC whsec_ AGE-SECRET-KEY"
_NAMES = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
    Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth
    Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Laura Ryan Cynthia Jacob Kathleen
    Anna Maria Jean Pierre Marie Louis Nicolas Camille Julien Sophie Antoine Claire Luc Chantal Hans Peter Klaus Ursula Wolfgang Monika Jürgen Petra Stefan
    Sabine Heinrich Greta Juan Carlos José Carmen Antonio Isabel Manuel Pilar Francisco Lucía Miguel Elena Javier Dolores Pedro Teresa Luis Rosa Giovanni
    Giulia Marco Francesca Luca Chiara Paolo Wei Li Ming Yuki Hiroshi Kenji Sakura Ahmed Fatima Mohammed Aisha Omar Leila Ivan Olga Dmitri Natasha Raj Priya
    Arjun Anita Sven Ingrid Lars Astrid"""
GAZETTEER = {
    "secret": rf"^(?:{'|'.join(_PREFIXES.split())})",
    "account": rf"^(?:{'|'.join(_COUNTRIES.split())})[0-9]{{2}}",
    "name": rf"(?:{'|'.join(_NAMES.split())})\b",
}
#: Labelers' shares of right votes, and the share of personal data among candidates, where the estimate starts.
START = Voters(0.5, {"v_strict": 0.85, "v_context": 0.9, "v_gazetteer": 0.8, "v_shape": 0.75, "v_frame": 0.7})
FEATURES = ("kind", *START.accuracy, "f_length", "f_before", "f_after")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that is worked out once and used often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Of every place what the ints before it come to (0: nothing), in blocks of the square root of their number, so that nothing is built up element by element."""
    fold = lambda a: F.aggregate(a, F.lit(0), merge)

    def of(v: Column) -> Column:
        return _let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda size: in_blocks(v, size))

    def in_blocks(v: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.greatest(F.size(v), F.lit(1)) - 1) / size).cast("int")), lambda k: fold(F.slice(v, k * size + 1, size)))
        before = _let(blocks, lambda b: F.transform(b, lambda _, k: fold(F.slice(b, F.lit(1), k))))
        return _let(before, lambda b: F.transform(v, lambda _, i: merge(F.get(b, (i / size).cast("int")), fold(F.slice(v, i - i % size + 1, i % size)))))

    return _let(values, of)


def spans(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, value>> of the matches of a pattern, from the matches and what stands between them."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, g: g + F.length(v))
    starts = F.zip_with(running(steps, lambda a, x: a + x), F.slice(between, 1, F.size(found)), lambda a, g: a + g)
    return F.when(F.size(found) > 0, F.zip_with(starts, found, lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.cast("int") <= 255)


PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A character without which a pattern can't match.
NEEDS = {"email": "@", "phone": "+"}


def found_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct), `__base` (kind -> spans, as a struct) and `__loose` (candidates with votes and features, without what they hold); no shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    df = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    t = F.col("__t")
    every = lambda p, need: F.when(t.contains(need) if need else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({f"__m_{k}": every(p, NEEDS.get(k)) for k, p in PATTERNS.items()} | {f"__m_{k}": every(p, None) for k, p in LOOSE.items()})
    # most numbers are no cards: where none passes, their places needn't be told
    none = lambda k: F.when(F.exists(f"__m_{k}", PASSES[k]), F.col(f"__m_{k}")).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({f"__m_{k}": none(k) for k in BASE} | {"__m_secret": F.when(F.exists("__m_secret", lambda v: v.rlike("[0-9]")), F.col("__m_secret")).otherwise(F.array().cast("array<string>"))})
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def passing(k: str) -> Column:
        passed = F.filter(F.coalesce(spans(t, PATTERNS[k], F.col(f"__m_{k}")), empty), lambda x: PASSES[k](x["value"]))
        return F.transform(passed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k)

    def candidates(of_kind: Column, k: str) -> Column:
        return F.transform(of_kind, lambda x: _candidate(x, t, k))

    base = [passing(k) for k in BASE]
    df = df.withColumn("__base", F.struct(*base))
    loose = []
    for k, p in LOOSE.items():
        of_kind = F.coalesce(spans(t, p, F.col(f"__m_{k}")), empty)
        if k == "secret":
            of_kind = F.filter(of_kind, lambda x: x["value"].rlike("[0-9]"))
        loose.append(candidates(of_kind, k))
    df = df.withColumn("__loose", F.concat(*loose))
    known = F.concat(*(F.col(f"__base.{k}") for k in BASE))
    free = F.filter("__loose", lambda c: ~F.exists(known, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.select("row", "__base", free.alias("__loose"))


def _candidate(x: Column, text: Column, kind: str) -> Column:
    """A span with the labelers' votes and the classifier's features."""
    value, size = x["value"], F.length(x["value"])
    before = F.substr(text, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40)))
    after = F.substr(text, x["end"] + 1, F.lit(1))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")
    mixed = value.rlike("[0-9]") & value.rlike(r"\p{L}")
    plain = value.rlike(r"^[\p{L}_/+=.-]*[0-9]{0,2}$|^[0-9_/+=.-]+$")
    keyed = value.rlike(KEYED) if kind == "secret" else F.lit(False)
    quoted = before.rlike("[\"'`]$") & after.isin('"', "'", "`")
    side = lambda c: F.when(c.rlike(r"[\"'`]$"), "quote").when(c.rlike("[=:]$"), "sign").when(c.rlike(r"\s$"), "space").when(c == "", "end").otherwise("other")
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        vote(value.rlike(STRICT[kind]), plain if kind == "secret" else F.lit(False)).alias("v_strict"),
        vote(before.rlike(CONTEXT[kind]) | keyed, F.lit(False)).alias("v_context"),
        vote(value.rlike(GAZETTEER[kind]), F.lit(False)).alias("v_gazetteer"),
        (vote(mixed, plain) if kind != "name" else vote(F.lit(False), F.lit(False))).alias("v_shape"),
        vote(quoted | keyed | before.rlike(r"[=:]\s*$"), before.rlike(r"[./\\]$") | after.isin("/", "\\")).alias("v_frame"),
        F.when(size < 24, "short").when(size < 33, "middle").when(size < 65, "long").otherwise("very long").alias("f_length"),
        side(before).alias("f_before"), side(after).alias("f_after"),
    )


class Classifier:
    """Naive Bayes over a span's votes and features: log-odds per value, a fixed number of values."""

    def __init__(self, prior: float, odds: dict[tuple[str, str], float]) -> None:
        self.prior, self.odds = prior, odds

    def log_odds(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for f in FEATURES:
            per = [(v, w) for (name, v), w in self.odds.items() if name == f]
            term = F.lit(0.0)
            for v, w in per:
                term = F.when(c[f].cast("string") == v, w).otherwise(term)
            total += term
        return total


def train(candidates: DataFrame, smooth: float = 2.0) -> Classifier:
    """The span classifier, from the posteriors of the labelers' model. candidates: columns FEATURES.

    Both fits see counts by pattern only; the driver gets a row per feature value.
    """
    voters = fit(candidates.select(*START.accuracy), START)
    known = candidates.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).withColumn("p", voters.posterior())
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in FEATURES)))
    rows = known.select("n", "p", values.alias("f")).groupBy("f.name", "f.value").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    if not rows:  # nothing seen: the labelers as they start
        odds = {(r, str(v)): v * math.log(a / (1 - a)) for r, a in START.accuracy.items() for v in (-1, 1)}
        return Classifier(0.0, odds)
    yes, no = (sum(r[k] for r in rows if r["name"] == "kind") for k in ("yes", "no"))
    n = {f: sum(r["name"] == f for r in rows) for f in FEATURES}
    odds = {
        (r["name"], r["value"]): math.log((r["yes"] + smooth) / (yes + smooth * n[r["name"]])) - math.log((r["no"] + smooth) / (no + smooth * n[r["name"]]))
        for r in rows
    }
    return Classifier(math.log((yes + smooth) / (no + smooth)), odds)


def learn(found: DataFrame) -> Classifier:
    return train(found.select(F.explode("__loose").alias("c")).select(*(F.col(f"c.{f}") for f in FEATURES)))


def all_spans(model: Classifier) -> Column:
    """array<struct<kind, start, end>>: the fixed kinds as listed, then the further ones, each by start."""
    plain = lambda k: F.transform(F.col(f"__base.{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    more = F.filter("__loose", lambda c: model.log_odds(c) >= 0)
    more = F.array_sort(F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.concat(*(plain(k) for k in BASE), more)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets, and the lengths that follow from it. A span that begins within another goes with it."""
    found = cut(found_spans(docs, text_col), "found")
    text = F.col(f"row.`{text_col}`")
    ordered = F.array_sort(F.transform(all_spans(learn(found)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def rewritten(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        return _let(reach, lambda r: join(F.filter(F.zip_with(all_, r, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda p: p["x"]["start"] >= p["at"]), F.array_max(F.transform(all_, lambda x: x["end"]))))

    def join(own: Column, last: Column) -> Column:
        parts = F.transform(own, lambda p: F.concat(F.substr(text, p["at"] + 1, p["x"]["start"] - p["at"]), F.lit("["), F.upper(p["x"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substr(text, last + 1, F.length(text)))

    fresh = F.when(F.size("__all") > 0, rewritten(F.col("__all"))).otherwise(text)
    done = found.select("row", ordered.alias("__all")).select("row", F.size("__all").alias("__n"), fresh.alias("__fresh"))
    out = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            old = F.col("__fresh")
        elif c == length_col:
            old = F.when(F.col("__n") > 0, F.length("__fresh").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return done.select(*out)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "__base", "__loose")
    found = cut(found, "found")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    every = found.withColumn("__all", all_spans(learn(found)))
    return every.select(
        "doc_id",
        *(F.size(f"__base.{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.filter("__all", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed("__all").alias("spans"),
    )
