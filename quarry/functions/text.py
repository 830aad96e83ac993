"""Column expressions over text, terms and lookup paths; all run inside the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from quarry.operators.counting import LETTER, MARK, SEPARATOR, Spaced

# Words that are no search terms.
STOPWORDS = (
    "a after an and are as asked at be before by did do does for from give given how i in is it its me my of on or our "
    "that the their them they this to up us was we were what when where which who why with you your"
).split()
# Predicates of facts and the substrings of a query that ask for them.
PREDICATES = {
    "phone": ["phone", "telephone", "mobile", "cell", "number"],
    "email": ["email", "e-mail", "mail"],
    "ssid": ["ssid", "wifi", "wi-fi", "wireless"],
    "follow_up_preference": ["follow-up", "followup", "follow", "preference", "availability"],
    "company": ["company", "organization", "org"],
    "title": ["title", "role", "position"],
}
# Typographic characters and what stands for them.
REPLACED = {"→": "->", "←": "<-", "—": "-", "–": "-", "“": '"', "”": '"', "’": "'", "…": "..."}
# Price of a token.
PRICES = {"claude_opus": 5.0 / 1_000_000, "gpt5_latest": 1.75 / 1_000_000}

#: Capitalised words in a row, between word boundaries as ASCII has them.
NAME = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])"
LABEL = r"(?m)^\s*[-*]\s*([^:\n]{2,48})\s*:"
MAX_LEVELS = 6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_text(text: str) -> str:
    """A text with plain characters for typographic ones, in compatibility decomposition."""
    for a, b in REPLACED.items():
        text = text.replace(a, b)
    return unicodedata.normalize("NFKD", text)


def folded(text: str) -> str:
    """A query's plain text without accents, as the full-text index has it."""
    return "".join(c for c in safe_text(text) if not unicodedata.combining(c))


@F.arrow_udf(StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    for a, b in REPLACED.items():
        texts = pc.replace_substring(texts, a, b)
    return pc.utf8_normalize(texts, "NFKD")


def nfkd(text: Column | str) -> Column:
    """safe_text of a column: Spark has no compatibility decomposition of its own. Plain ASCII is its own."""
    text = _c(text)
    return F.coalesce(_nfkd(F.when(F.length(text) != F.octet_length(text), text)), text)


def folded_text(text: Column | str) -> Column:
    """A column of queries without accents, as the full-text index has its words."""
    return F.regexp_replace(nfkd(text), r"\p{M}+", "")


def token_count(text: Column | str) -> Column:
    """A quarter of the characters, rounded up; 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(_c(text)) + 3) / 4)).cast("long")


def bytes_to_tokens(n: Column | str) -> Column:
    return F.greatest(F.lit(0), F.floor((_c(n) + 3) / 4)).cast("long")


def tokens_saved(raw: Column | str, response: Column | str) -> Column:
    return F.greatest(F.lit(0), F.floor((_c(raw) - _c(response)) / 4)).cast("long")


def cost_avoided(tokens: Column | str, prices: dict[str, float] = PRICES) -> Column:
    """map of price name -> cost of the tokens, to 4 places."""
    return F.map_from_arrays(F.array(*map(F.lit, prices)), F.array(*(F.round(_c(tokens) * F.lit(p), 4) for p in prices.values())))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def slug(text: Column | str) -> Column:
    s = _squeezed(_c(text))
    return F.when(s == "", "untitled").otherwise(s)


def predicate_name(text: Column | str) -> Column:
    """Like a slug, but nothing stays nothing."""
    return _squeezed(_c(text))


def safe_term(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]", "")
    return F.when(F.length(t) >= 2, t)


def lookup_path(text: Column | str) -> Column:
    """A dotted path as it is if it is well formed, else with every part as a slug; blank: untitled."""
    bare = F.lower(F.trim(_c(text)))
    path = F.regexp_replace(F.regexp_replace(bare, r"\.+", "."), r"^\.+|\.+$", "")
    parts = F.transform(F.filter(F.split(bare, r"\."), lambda p: F.trim(p) != ""), slug)
    return F.when(bare == "", "untitled").when(path.rlike(r"^[a-z0-9._-]+$"), path).when(F.size(parts) == 0, "untitled").otherwise(F.array_join(parts, "."))


def build_lookup_path(file: Column | str, headings: Column | str, levels: int = MAX_LEVELS) -> Column:
    """Folders, file stem and headings as slugs, neighbours that are equal once, so many levels at most."""
    parts = F.split(F.regexp_replace(_c(file), r"(?i)\.md$", ""), "/")
    parts = F.transform(F.filter(F.concat(parts, _c(headings)), lambda p: p != ""), slug)
    none = F.array().cast("array<string>")
    once = F.aggregate(parts, none, lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == p), acc).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(F.slice(once, 1, levels), ".")


def parent_path(path: Column | str) -> Column:
    return F.when(_c(path).contains("."), F.regexp_replace(_c(path), r"\.[^.]*$", ""))


def depth(path: Column | str) -> Column:
    return F.size(F.split(_c(path), r"\."))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def runs_of_letters(text: Column | str) -> Column:
    return _all(F.lower(_c(text)), r"[a-z0-9]+")


def is_term(t: Column) -> Column:
    """Whether a word has three letters or digits at least and is no stopword."""
    return (F.length(t) >= 3) & ~t.isin(STOPWORDS)


def terms(text: Column | str) -> Column:
    """Lower-case words of three letters or digits at least that aren't stopwords; repeats stay."""
    return F.filter(runs_of_letters(text), is_term)


def significant_terms(text: Column | str) -> Column:
    """The like with underscores, each once, in order."""
    return F.array_distinct(F.filter(_all(F.lower(_c(text)), r"[a-z0-9_]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS)))


def query_tokens(text: Column | str) -> Column:
    """White-space separated words without other characters; no stopwords, no bare numbers; repeats stay."""
    bare = F.transform(F.split(F.trim(_c(text)), r"\s+"), lambda t: F.regexp_replace(F.lower(t), r"[^a-z0-9]", ""))
    return F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS) & ~t.rlike(r"^[0-9]+$"))


def asked_predicates(text: Column | str) -> Column:
    """Names of the predicates that a query asks for, by substrings."""
    low = F.lower(_c(text))
    fires = [F.when(low.rlike("|".join(w)), F.lit(p)) for p, w in PREDICATES.items()]
    return F.array_compact(F.array(*fires))


def subject_tokens(text: Column | str) -> Column:
    """Words of the first two capitalised phrases, lower-cased, each once, four at most."""
    phrases = F.slice(_all(_c(text), NAME), 1, 2)
    words = F.flatten(F.transform(phrases, lambda p: F.filter(_all(F.lower(p), r"[a-z0-9]+"), lambda t: F.length(t) >= 2)))
    return F.slice(F.array_distinct(words), 1, 4)


def overlap(content: Column | str, of: Column | str) -> Column:
    """Share of the terms that are substrings of the lower-cased content; 0 without terms."""
    of = _c(of)
    # the content is lower-cased once, as the element of an array, not once per term
    hit = F.get(F.transform(F.array(F.lower(_c(content))), lambda low: F.size(F.filter(of, lambda t: F.contains(low, t)))), F.lit(0))
    return F.when(F.size(of) > 0, hit / F.size(of)).otherwise(0.0)


_RUN = re.compile("[a-z0-9_]+")


def words_within(text: Column | str, words: list[str]) -> Column:
    """array<int>: the places in `words` (of a-z, 0-9 and _, each once) of those that are substrings of the lower-cased text; null of a null text.

    A word lies in one run of such characters, so a text's distinct runs are looked at, each once per task, by their parts of the words' lengths.
    """
    place, lengths, known = {w: i for i, w in enumerate(words)}, sorted({len(w) for w in words}), {}

    def of(run: str) -> set[int]:
        return {place[x] for n in lengths for i in range(len(run) - n + 1) if (x := run[i : i + n]) in place}

    def within(text: str) -> list[int]:
        met = set()
        for run in set(_RUN.findall(text)):
            at = known.get(run)
            if at is None:
                at = of(run)
                if len(run) <= 40 and len(known) < 500_000:
                    known[run] = at
            met |= at
        return sorted(met)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else within(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return found(F.lower(_c(text)))


def activation(accesses: Column | str, last: Column | str, now: Column) -> Column:
    """1 / (days since the last access + 1), 0 if there was none, plus log(1 + accesses)."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(_c(last).cast("timestamp"))) / 86_400_000_000.0)
    return F.coalesce(1.0 / (days + 1.0), F.lit(0.0)) + F.log1p(F.coalesce(_c(accesses), F.lit(0)))


def query_variants(query: Column | str) -> Column:
    """array<struct<ord, label, op, terms>>: all words; significant words; any of them; each of up to two names."""
    query = _c(query)
    every = _all(F.lower(query), r"[a-z0-9_]+")
    main = F.slice(significant_terms(query), 1, 8)
    one = lambda n, label, op, t: F.struct(F.lit(n).alias("ord"), F.lit(label).alias("label"), F.lit(op).alias("op"), t.alias("terms"))
    names = F.transform(F.slice(_all(query, NAME), 1, 2), lambda p: _all(F.lower(p), r"[a-z0-9]+"))
    named = F.transform(names, lambda t, i: F.struct((i + 4).cast("int").alias("ord"), F.lit("fts_name").alias("label"), F.lit("and").alias("op"), t.alias("terms")))
    fixed = F.array_compact(
        F.array(
            F.when(F.size(every) > 0, one(1, "fts_exact", "and", every)),
            F.when((F.size(main) > 0) & (main != every), one(2, "fts_keywords", "and", main)),
            F.when(F.size(main) > 1, one(3, "fts_or", "or", main)),
        )
    )
    return F.concat(fixed, named)


def fts_tokens(text: Column | str) -> Column:
    """Tokens of the full-text index: letters and digits of the folded text. Accents, which decomposition leaves as marks, are dropped before words are taken."""
    return _all(F.regexp_replace(F.lower(_c(text)), r"\p{M}+", ""), r"[\p{L}\p{N}]+")


@functools.cache
def _character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Where from U+0080 on another class of characters begins, and these classes: letters and digits, marks, or neither, as the patterns of `fts_tokens` have them."""
    spark = SparkSession.active()
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    of = F.when(character.rlike(r"\p{M}"), MARK).when(character.rlike(r"[\p{L}\p{N}]"), LETTER).otherwise(SEPARATOR).cast("byte")
    points = spark.range(0x80, 0x110000).where("id NOT BETWEEN 55296 AND 57343")  # halves of pairs are no characters
    found = points.select(F.col("id").cast("int").alias("id"), of.alias("of")).where(F.col("of") != SEPARATOR).toArrow()
    classes = np.zeros(0x110000 - 0x80, np.uint8)
    classes[found["id"].to_numpy() - 0x80] = found["of"].to_numpy()
    begins = np.append(0, np.flatnonzero(np.diff(classes)) + 1)
    return begins + 0x80, classes[begins]


def fts_words(low: Column | str) -> tuple[Column, Column]:
    """The tokens of the full-text index between single spaces, in one text, and their number; of a text in lower case."""
    spaced = Spaced(*_character_classes())

    @F.arrow_udf("string")
    def words(texts: pa.Array) -> pa.Array:
        return spaced.texts(texts)

    @F.arrow_udf("int")
    def number(texts: pa.Array) -> pa.Array:
        return spaced.counts(texts)

    return words(_c(low)), number(_c(low))
