"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes that a text is good (1) or bad (-1) or abstains (0); expectation-maximisation over
all documents estimates how often each rule votes how in good and in bad texts, and how many are good; nothing but the
start is given. The posterior probability of good quality replaces a filter that all rules must pass: no rule decides
alone unless its votes are found to go with those of others.

Defined cases: a null text has no words, fails the base rules and isn't kept; so does an empty
one; rows are judged one by one, repeated rows alike; other columns are kept by `keep_good`,
whatever their names; an empty table gives an empty result (and the starting accuracies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import cut, documents
from .weak import Rates, fit_rates

WHITE = r"[\x20\x09-\x0D]+"
#: Least posterior of a document that is kept.
KEEP = 0.5
#: The rules. What measures much the same makes one rule: symbols and pipes, repeated words and lines, exclamation marks and capitals.
RULES = ("markup", "letters", "repetition", "shouting", "word_length", "sentences")
#: Where the estimate starts, alike for all rules: shares of votes (against, none, for) in good texts and in bad ones.
START = Rates(0.9, {r: ((0.02, 0.18, 0.8), (0.3, 0.3, 0.4)) for r in RULES})


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct) and q (a text's measures, as a struct) of every row; no shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    df = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    at = lambda a, i: F.get(a, i)
    df = df.withColumn("__w", F.array_remove(F.split(text, WHITE), ""))
    # three consecutive words as one hash; repeats of it are looked for in sorted order
    grams = F.transform("__w", lambda x, i: F.xxhash64(x, at(F.col("__w"), i + 1), at(F.col("__w"), i + 2)))
    df = df.withColumn("__g", F.slice(grams, 1, F.greatest(F.size("__w") - 2, F.lit(0))))
    repeats = F.size(F.array_distinct("__g")) < F.size("__g")
    df = df.withColumn("__s", F.when(repeats, F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, at(s, i + 1)) | ((i > 0) & same(x, at(s, F.greatest(i - 1, F.lit(0))))))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(at(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    q = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _removed(text, "[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.length(text).cast("long").alias("n_chars"),
        _removed(text, r"\p{Lu}+").cast("long").alias("n_capitals"),
        _removed(text, r"\p{L}+").cast("long").alias("n_letters"),
        _removed(text, "!+").cast("long").alias("n_exclaims"),
        _removed(text, r"\|+").cast("long").alias("n_pipes"),
        _removed(text, "[.!?]+").cast("long").alias("n_stops"),
    )
    return df.select("row", q.alias("q"))


def base_failed() -> Column:
    q = F.col("q")
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def votes() -> dict[str, Column]:
    """The rules' votes on a text's measures: 1 (good), -1 (bad) or 0 (abstains, between the two)."""
    q = F.col("q")
    per = lambda a, b: q[a] / F.greatest(q[b], F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")
    symbols, pipes, letters = per("n_symbols", "n_words"), per("n_pipes", "n_words"), per("n_letters", "word_chars")
    words, lines = per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines")
    exclaims, capitals = per("n_exclaims", "n_words"), per("n_capitals", "n_letters")
    length, stops = per("word_chars", "n_words"), per("n_stops", "n_words")
    return {
        "markup": vote((symbols > 0.2) | (pipes > 0.15), (symbols < 0.05) & (pipes < 0.05)),
        "letters": vote(letters < 0.75, letters > 0.9),
        "repetition": vote((words > 0.3) | (lines > 0.3), (words < 0.1) & (lines < 0.1)),
        "shouting": vote((exclaims > 0.3) | (capitals > 0.5), (exclaims < 0.05) & (capitals < 0.2)),
        "word_length": vote((length < 2.5) | (length > 14), (length > 3.5) & (length < 8)),
        "sentences": vote((q["n_stops"] == 0) & (q["n_words"] >= 50), (stops > 0.02) & (stops < 0.4)),
    }


def learn(measured: DataFrame) -> Rates:
    """The rules' rates over all measured documents with a word."""
    return fit_rates(measured.where(F.col("q.n_words") > 0).select(*(v.alias(r) for r, v in votes().items())), START)


def score(measured: DataFrame, rates: Rates) -> DataFrame:
    """measured with `quality` (the posterior) and `kept`."""
    own = votes()
    scored = measured.withColumn("quality", rates.posterior(own.__getitem__))
    return scored.withColumn("kept", ~base_failed() & (F.col("quality") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are."""
    measured = cut(measures(docs), "measured")
    return score(measured, learn(measured)).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measures(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "q")
    measured = cut(measured, "measured")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return score(measured, learn(measured)).select("doc_id", *(f"q.{n}" for n in names), base_failed().alias("base_failed"), "kept", "quality")
