"""Index tables from chunks: paths, terms, facts and the full-text postings, each one DataFrame job.

A chunk has chunk_id, lookup_path, parent_path, chunk_order, source, content, token_count,
source_file, start_line and end_line.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions.text import LABEL, NAME, STOPWORDS, depth, fts_tokens, fts_words, parent_path, predicate_name, runs_of_letters, safe_term
from quarry.operators import counting
from quarry.tables import cut, held, sized

#: Content terms of a path that count, terms that a path keeps, characters of a fact's object.
CONTENT_TERMS, PATH_TERMS, OBJECT_CHARS = 120, 140, 280
#: Chunks whose terms one task counts, about.
TASK_CHUNKS = 10_000
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def path_tree(chunks: DataFrame) -> DataFrame:
    """lookup_path, parent_path, depth, chunk_count, child_count of all paths and their ancestors.

    Chunks are counted per path before ancestors are told, so the second shuffle has a row per path and level.
    """
    own = chunks.groupBy("lookup_path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("lookup_path", r"\.")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), ".").alias("path"), F.when(i == F.size(parts), F.col("n")).otherwise(0).alias("n")))
    paths = own.select(F.explode(levels).alias("x")).groupBy("x.path").agg(F.sum("x.n").alias("chunk_count")).withColumnRenamed("path", "lookup_path")
    children = paths.where(F.col("lookup_path").contains(".")).groupBy(parent_path("lookup_path").alias("of")).agg(F.count(F.lit(1)).alias("child_count"))
    return paths.join(children, F.col("lookup_path") == F.col("of"), "left").select(
        "lookup_path", parent_path("lookup_path").alias("parent_path"), depth("lookup_path").alias("depth"), "chunk_count", F.coalesce("child_count", F.lit(0)).alias("child_count")
    )


def by_path(chunks: DataFrame) -> DataFrame:
    """Chunks dealt by their paths to tasks of about TASK_CHUNKS, so that a task's tables of terms don't grow with the input and no grouping by path moves rows again."""
    n = -(-chunks.count() // TASK_CHUNKS)
    return chunks.repartition(max(n, chunks.sparkSession.sparkContext.defaultParallelism), "lookup_path")


def term_frequencies(chunks: DataFrame, top: int = CONTENT_TERMS) -> DataFrame:
    """lookup_path, term, n: the most frequent terms of each path's contents (ties by term)."""
    return _frequencies(by_path(chunks.select("lookup_path", "content")), top)


def _frequencies(dealt: DataFrame, top: int) -> DataFrame:
    """Of chunks dealt by path; words are those of `is_term`. A path's chunks follow each other in one task, which counts their words."""
    words = dealt.select("lookup_path", runs_of_letters("content").alias("words")).sortWithinPartitions("lookup_path")
    return words.mapInArrow(counting.Frequent(top, 3, STOPWORDS), "lookup_path string, term string, n long")


def labels(content: Column | str) -> Column:
    """Labels of bullets: what stands before their colon. A text without a colon isn't searched."""
    content = F.col(content) if isinstance(content, str) else content
    return F.when(content.contains(":"), F.regexp_extract_all(content, F.lit(LABEL), F.lit(1))).when(content.isNotNull(), F.array().cast("array<string>"))


def term_index(chunks: DataFrame) -> DataFrame:
    """term, lookup_path, weight: what a path is called, holds, and labels, weighted; the heaviest of each path.

    Weights: a part of the path 1 + 0.2 per level from its end, the words of a part of several 0.7 + 0.1 per
    level, the path in one word 0.8; a content term 0.2 + 0.07 per time, 0.65 at most; a bullet's label 1.1; a name in one word
    0.9 and each of its words 0.5. A path's chunks follow each other in one task, which sums in hundredths and ranks: no term is moved.
    """
    chunks = by_path(chunks.select("lookup_path", "content"))
    parts = F.split("lookup_path", r"\.")
    size = F.size(parts)
    entry = lambda t, w: F.struct(t.alias("term"), (F.lit(w) if isinstance(w, int) else w).cast("int").alias("hundredths"))
    level = lambda i: size - i
    words = lambda p: F.filter(F.split(p, "_"), lambda w: F.length(w) >= 3)
    named = F.concat(
        F.transform(parts, lambda p, i: entry(safe_term(p), level(i) * 20 + 100)),
        F.flatten(F.transform(parts, lambda p, i: F.when(F.size(words(p)) > 1, F.transform(words(p), lambda w: entry(w, level(i) * 10 + 70))).otherwise(F.array().cast("array<struct<term:string,hundredths:int>>")))),
        F.array(entry(safe_term(F.array_join(parts, "")), 80)),
    )
    phrase = lambda p: F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0))
    told = F.concat(
        F.transform(labels("content"), lambda x: entry(safe_term(x), 110)),
        F.transform("__names", lambda p: entry(safe_term(F.array_join(phrase(p), "")), 90)),
        F.flatten(F.transform("__names", lambda p: F.transform(phrase(p), lambda w: entry(safe_term(w), 50)))),
    )
    rows = chunks.withColumn("__names", F.regexp_extract_all("content", F.lit(NAME), F.lit(0)))
    rows = rows.select("lookup_path", F.lower("content").alias("text"), named.alias("named"), told.alias("told")).sortWithinPartitions("lookup_path")
    return rows.mapInArrow(counting.Weighed(CONTENT_TERMS, PATH_TERMS, 3, STOPWORDS), "term string, lookup_path string, weight double")


def facts(chunks: DataFrame) -> DataFrame:
    """chunk_id, lookup_path, subject, predicate, object, weight of bullets `- key: value`; the first value of a key counts.

    A chunk's lines stay in one row, so that nothing is moved. A text without a colon isn't taken into lines.
    """
    content = F.when(F.col("content").contains(":"), F.col("content"))
    line = r"^[-*]\s*([^:\n]{2,48})\s*:\s*(.+)$"
    trimmed = F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))
    pairs = F.transform(
        F.filter(trimmed, lambda x: x.rlike(line)),
        lambda x: F.struct(predicate_name(F.regexp_extract(x, line, 1)).alias("predicate"), F.trim(F.regexp_extract(x, line, 2)).alias("object")),
    )
    pairs = F.filter(pairs, lambda x: (x["predicate"] != "") & (x["object"] != ""))
    df = chunks.where(content.rlike(r"(?m)^\s*[-*][^:\n]{2,}:")).select("chunk_id", "lookup_path", pairs.alias("__kv"))
    kv = F.col("__kv")
    first = F.filter(kv, lambda x, i: F.array_position(F.transform(kv, lambda y: y["predicate"]), x["predicate"]) == i + 1)
    value = lambda key: F.get(F.filter(kv, lambda x: x["predicate"] == key), F.lit(0))["object"]
    df = df.withColumn("__first", first).withColumn("subject", F.coalesce(value("name"), value("person"), value("contact")))
    # of an outer explode no filter is inferred, which would take the lines apart twice
    return df.select("chunk_id", "lookup_path", "subject", F.explode_outer("__first").alias("x")).where("x IS NOT NULL").select(
        "chunk_id", "lookup_path", "subject", "x.predicate", F.substring("x.object", 1, OBJECT_CHARS).alias("object"), F.lit(1.0).alias("weight")
    )


#: Characters of the runs by which facts are met; a shorter word is met by all of its letters.
RUN = 3


def runs(word: Column, n: int = RUN) -> Column:
    """All runs of n characters; a shorter word is its own only run."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: word.substr(i, F.lit(n))))


def fact_text(subject: Column | str = "subject", object_: Column | str = "object") -> Column:
    """What the words of a person's name are looked for in."""
    return F.lower(F.concat_ws("\n", F.coalesce(subject, F.lit("")), object_))


def gram_index(facts: DataFrame) -> DataFrame:
    """gram, chunk_id: the runs of two and three letters or digits in a chunk's facts, each once; in ranges of runs, so that a scan reads those it wants.

    Both columns give the ranges: a run that most chunks have lies in several.
    """
    low = fact_text()
    both = F.concat(*(runs(low, n) for n in range(2, RUN + 1)))
    found = facts.select("chunk_id", F.explode(F.filter(both, lambda g: g.rlike("^[a-z0-9]{2,}$"))).alias("gram"))
    return found.select("gram", "chunk_id").distinct().repartitionByRange("gram", "chunk_id").sortWithinPartitions("gram", "chunk_id")


#: Chunks that a block's zone has, about; terms of a batch of queries that are pushed to the scan, in groups that a scan takes as equalities.
ZONE_CHUNKS, PUSHED_TERMS, PUSHED_TOGETHER = 128, 500, 10
BLOCK = "term string, zone int, n int, most_tf int, least_dl int, chunk_ids array<long>, tfs array<int>, dls array<int>, positions array<array<int>>"


def wanted_tokens(chunks: DataFrame, wanted: DataFrame, *more: str | Column) -> DataFrame:
    """chunk_id, dl (tokens of the chunk), `found`, its tokens among the wanted terms with their places, and more columns: written, as each text is cut into tokens once."""
    terms = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS * 20 + 1).collect()]
    tokens = chunks.select("chunk_id", *more, fts_tokens("content").alias("__t"))
    placed = F.transform("__t", lambda x, i: F.struct(x.alias("term"), i.alias("at")))
    if len(terms) <= PUSHED_TERMS * 20:  # beyond, all tokens go on and meet the wanted terms in a join
        placed = F.filter(placed, lambda x: x["term"].isin(terms))
    return cut(tokens.withColumn("dl", F.size("__t")).withColumn("found", placed).drop("__t"), "tokens")


def postings(chunks: DataFrame, wanted: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """term, chunk_id, tf, dl (tokens of the chunk), positions; one row per term and chunk.

    wanted (term): only postings of these are made, so that other tokens aren't moved; tokens: those of `wanted_tokens`, if they are there.
    """
    if wanted is not None:
        each = (wanted_tokens(chunks, wanted) if tokens is None else tokens).select("chunk_id", "dl", F.inline("found"))
        each = each.join(sized(cut(wanted.select("term").distinct(), "wanted"), 64), "term", "left_semi")
    else:
        each = chunks.select("chunk_id", fts_tokens("content").alias("t")).select("chunk_id", F.size("t").alias("dl"), F.posexplode("t").alias("at", "term"))
    return each.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))


def reblocked(rows: DataFrame, n_chunks: int) -> DataFrame:
    """Postings as blocks: one row per term and zone, with the most times and the least length in it, from which its largest impact follows.

    A zone is a group of about ZONE_CHUNKS chunks by the hash of their id, the same for all terms, so that what several terms can
    come to in a zone is a sum over its blocks; a frequent term has many blocks, none larger than its zone. Blocks lie in ranges of terms and zones, in order.
    """
    zone = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n_chunks // ZONE_CHUNKS)))).cast("int")
    rows = rows.withColumn("zone", zone).repartitionByRange("term", "zone")
    each = F.sort_array(F.collect_list(F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), "dl", "positions")))
    blocks = rows.groupBy("term", "zone").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").cast("int").alias("most_tf"), F.min("dl").alias("least_dl"), each.alias("x"))
    take = lambda c: F.transform("x", lambda e: e[c])
    blocks = blocks.select("term", "zone", "n", "most_tf", "least_dl", take("chunk_id").alias("chunk_ids"), take("tf").alias("tfs"), take("dl").alias("dls"), take("positions").alias("positions"))
    return blocks.sortWithinPartitions("term", "zone")


def with_words(chunks: DataFrame) -> DataFrame:
    """Chunks with `tokens`, their tokens between spaces, and dl, the number of these."""
    tokens, dl = fts_words(F.lower("content"))
    return chunks.withColumns({"tokens": tokens, "dl": dl})


def with_lengths(chunks: DataFrame) -> DataFrame:
    """Chunks with dl, the number of their tokens. The tokens aren't kept: it takes less to find them again than to write and read them."""
    return chunks.withColumn("dl", fts_words(F.lower("content"))[1])


def zoned(tokens: DataFrame, n_chunks: int) -> DataFrame:
    """Blocks of chunks (chunk_id, tokens: a list, or a text of words between spaces): chunks are dealt by their zones, and zones are cut into blocks where they lie.

    Blocks lie in runs of some zones, each in order of terms and zones, so that scans leave out what they don't want by the pages' least and greatest terms;
    no block is moved. A merge of segments (`reblocked`) lays them in ranges.
    """
    zone = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n_chunks // ZONE_CHUNKS)))).cast("int")
    return tokens.select(zone.alias("zone"), "chunk_id", "tokens").repartition("zone").sortWithinPartitions("zone", "chunk_id").mapInArrow(counting.blocks, BLOCK)


def unblocked(blocks: DataFrame, *more: str, positions: bool = True) -> DataFrame:
    """The postings of blocks, and more of their columns: term, chunk_id, tf, dl, positions (if asked for: they are the most bytes).

    Ids are exploded and the rest looked up by place: arrays zipped before would be zipped for each block that a filter or join behind leaves out, too.
    """
    columns = [(c, a) for c, a in (("tfs", "tf"), ("dls", "dl"), ("positions", "positions")) if positions or c != "positions"]
    each = blocks.select("term", *more, *(c for c, _ in columns), F.posexplode("chunk_ids").alias("__at", "chunk_id"))
    return each.select("term", *more, "chunk_id", *(F.get(c, "__at").alias(a) for c, a in columns))


def vocabulary(blocks: DataFrame) -> DataFrame:
    """term, n: the chunks that have it."""
    return blocks.groupBy("term").agg(F.sum("n").alias("n"))


def chunks_per_term(tokens: DataFrame) -> DataFrame:
    """term, n of chunks with their tokens between spaces: as their blocks' vocabulary, without the blocks."""
    return vocabulary(tokens.select("tokens").mapInArrow(counting.chunks_per_word, "term string, n long"))


def in_use(rows: DataFrame, dead: DataFrame, key: str, n_dead: int) -> DataFrame:
    """Rows (key, seq) whose key no later seq put out of use; without a join where none was. dead: key, seq."""
    if not n_dead:
        return rows
    last = dead.groupBy(key).agg(F.max("seq").alias("dead_at"))
    return rows.join(sized(last, 64, n_dead), key, "left").where(F.col("dead_at").isNull() | (F.col("seq") >= F.col("dead_at"))).select(*rows.columns)


@dataclass
class Index:
    """All tables that queries need; blocks, vocab (term, df), sizes (n, avgdl) and dead (chunk_id, seq, with their number) where the index is kept in segments.

    grams (gram, chunk_id) tells where facts may be; it may name chunks that are out of use or have other facts by now, as what it finds is compared.
    """

    chunks: DataFrame
    paths: DataFrame
    terms: DataFrame
    facts: DataFrame
    postings: DataFrame
    access: DataFrame
    relations: DataFrame
    blocks: DataFrame | None = None
    vocab: DataFrame | None = None
    sizes: DataFrame | None = None
    dead: tuple[DataFrame, int] | None = None
    version: object = None
    grams: DataFrame | None = None

    def of(self, wanted: DataFrame, columns: list[str]) -> DataFrame:
        """Blocks of the wanted terms (term): a scan of the files and row groups that have them, if the terms are few; no other block is taken apart in any case."""
        terms, n = held(wanted.select("term").distinct(), "wanted")
        return self.blocks.where(_any_of(terms)).join(sized(terms, 64, n), "term", "left_semi").select(*columns)

    def alive(self, rows: DataFrame) -> DataFrame:
        return in_use(rows, self.dead[0], "chunk_id", self.dead[1]) if self.dead else rows


def _any_of(wanted: DataFrame, column: str = "term") -> Column:
    """A condition on the term that scans can use; all terms pass where too many are wanted for one.

    The groups are for the scan. A row meets the set of all terms first, so that no row is compared with each of them.
    """
    terms = sorted(r[column] for r in wanted.select(column).distinct().limit(PUSHED_TERMS + 1).collect())
    if len(terms) > PUSHED_TERMS:
        return F.lit(True)
    groups = [F.col(column).isin(terms[k : k + PUSHED_TOGETHER]) for k in range(0, len(terms), PUSHED_TOGETHER)]
    return F.col(column).isin(terms) & functools.reduce(Column.__or__, groups, F.lit(False))


#: Runs of a query that are met, its rarest ones; the words themselves are compared afterwards.
RAREST = 2


def counts_of(grams: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """gram, __often: the chunks that have each of the n wanted runs (gram)."""
    there = grams.where(_any_of(wanted, "gram"))
    return there.join(sized(wanted.select("gram").distinct(), 40, n), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("__often"))


def words_met(grams: DataFrame, asked: DataFrame, words: str = "subjects") -> tuple[DataFrame, DataFrame]:
    """asked (query_id, words) -> query_id, word: of each query the word with the rarest run; and word, chunk_id: the chunks that have the rarest runs of these words.

    A word that many queries have is met once, not once for each of them.
    """
    each, _ = held(asked.select("query_id", F.explode(F.array_distinct(words)).alias("word")), "words")
    wanted, n = held(each.select("word").distinct().select("word", F.explode(runs(F.col("word"))).alias("gram")), "runs")
    often, _ = held(counts_of(grams, wanted, n), "often")
    least = wanted.join(often, "gram", "left").groupBy("word").agg(F.min(F.coalesce("__often", F.lit(0))).alias("__least"))
    chosen, _ = held(each.join(least, "word").groupBy("query_id").agg(F.min_by("word", F.struct("__least", "word")).alias("word")), "chosen")
    one = chosen.select("word").distinct().select(F.col("word").alias("query_id"), F.array("word").alias(words))
    return chosen, chunks_with(grams, one, words, often).withColumnRenamed("query_id", "word")


def words_scanned(texts: DataFrame, asked: DataFrame, words: str = "subjects") -> tuple[DataFrame, DataFrame]:
    """asked (query_id, words) -> query_id, word: of each query the word that the fewest texts (`low`) have; and the texts with each of these words that they have, a row for each.

    For batches of so many words that a table of runs would be read whole: each text is cut into its parts of the words' lengths, which meet all words at once.
    """
    each, _ = held(asked.select("query_id", F.explode(F.array_distinct(words)).alias("word")), "words")
    wanted, n = held(each.select("word").distinct(), "wanted")
    often = cut(_holding(texts, wanted, n).groupBy("word").agg(F.count(F.lit(1)).alias("__often")), "often")
    there = each.join(sized(often, 48, n), "word", "left")
    chosen = cut(there.groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("__often", F.lit(0)), "word")).alias("word")), "chosen")
    keys, n = held(chosen.select("word").distinct(), "keys")
    return chosen, _holding(texts, keys, n)


def _holding(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The texts (`low`) with each of the n wanted words (word) that they have. No filter is inferred from an outer explode, which would make the parts twice."""
    lengths = sorted(r["n"] for r in wanted.select(F.length("word").alias("n")).distinct().collect())
    parts = F.array_distinct(F.concat(F.array().cast("array<string>"), *(runs(F.col("low"), k) for k in lengths)))
    return texts.withColumn("word", F.explode_outer(parts)).join(sized(wanted, 40, n), "word", "left_semi")


def chunks_with(grams: DataFrame, asked: DataFrame, words: str = "subjects", often: DataFrame | None = None) -> DataFrame:
    """asked (query_id, words) -> query_id, chunk_id: chunks that have the rarest runs of the words, each once; they may still not have the words.

    Runs that are wanted are told to the scan. They are counted first, so that a run that most chunks have is met by no query that has rarer ones.
    """
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(words, lambda t: runs(t))))).alias("gram"))
    wanted, n = held(wanted, "runs")
    there = grams.where(_any_of(wanted, "gram"))
    often = counts_of(grams, wanted, n) if often is None else often
    by = W.partitionBy("query_id")
    ranked = wanted.join(often, "gram", "left").withColumn("__k", F.row_number().over(by.orderBy(F.coalesce("__often", F.lit(0)), "gram")))
    rare, n = held(ranked.where(F.col("__k") <= RAREST).select("query_id", "gram", F.count(F.lit(1)).over(by).alias("__n")), "rare")
    met = there.join(sized(rare, 60, n), "gram").groupBy("query_id", "__n", "chunk_id")
    return met.agg(F.count_distinct("gram").alias("__got")).where(F.col("__got") == F.col("__n")).select("query_id", "chunk_id")


def build(chunks: DataFrame, access: DataFrame, relations: DataFrame) -> Index:
    """access: chunk_id, access_count, last_accessed. relations: subject, predicate, object (paths).

    The index tables are written once in the shared folder; postings in runs of zones, sorted by their terms.
    """
    chunks = cut(with_lengths(chunks), "chunks")
    sizes = cut(chunks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "sizes")
    n = sizes.first()["n"]
    made = {"paths": path_tree(chunks), "terms": term_index(chunks), "facts": facts(chunks), "blocks": zoned(with_words(chunks), n).withColumn("seq", F.lit(1).cast("long")), "access": access, "relations": relations}
    made = {k: cut(v, k) for k, v in made.items()}
    made["grams"] = cut(gram_index(made["facts"]), "grams")
    vocab = made["blocks"].groupBy("term").agg(F.sum("n").alias("df"))
    return Index(chunks.drop("dl"), postings=unblocked(made["blocks"]), vocab=vocab, sizes=sizes, **made)


def idf(n: Column, df: Column) -> Column:
    """Of a term that df of n chunks have; a little where most have it."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's times in a chunk of so many tokens count: more with the times, less with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _asked(wanted: DataFrame) -> DataFrame:
    """The phrases of the queries, each with its words; without words it is none."""
    phrases = wanted.select("query_id", "variant", "op", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("slot", "phrase"))
    return phrases.withColumn("words", F.filter(F.split("phrase", "_"), lambda w: w != "")).where(F.size("words") > 0)


def bm25(index: Index, wanted: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """wanted (query_id, variant, op, terms) -> query_id, variant, chunk_id, bm25 (higher is better).

    A term with underscores is a phrase of adjacent words. A term that a query names twice counts twice. Document frequencies are those of all chunks.
    """
    phrases, n_phrases = held(_asked(wanted), "asked")
    distinct = phrases.select("phrase", "words").distinct()
    each = distinct.select("phrase", F.size("words").alias("k"), F.posexplode("words").alias("slot", "term"))
    rows = index.postings if index.blocks is None else index.alive(unblocked(index.of(each, index.blocks.columns), "seq")).drop("seq")
    found = rows.join(sized(each, 64), "term")
    # one word: as it is; several: starts that every word of the phrase has
    single = found.where("k = 1").select("phrase", "chunk_id", "dl", F.size("positions").alias("tf"))
    several = found.where("k > 1").groupBy("phrase", "chunk_id").agg(
        F.first("k").alias("k"), F.first("dl").alias("dl"), F.count(F.lit(1)).alias("got"), F.collect_list(F.transform("positions", lambda p: p - F.col("slot"))).alias("starts")
    )
    common = F.aggregate(F.slice("starts", 2, 1_000), F.get("starts", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    several = several.where(F.col("got") == F.col("k")).select("phrase", "chunk_id", "dl", F.size(common).alias("tf")).where("tf > 0")
    # read twice: counted, and weighed; sizes are told for whole tables, whose hits are many
    found = single.unionByName(several)
    found = held(found, "met")[0] if sizes is None else cut(found, "met")
    if sizes is None:
        sizes = index.sizes if index.sizes is not None else index.chunks.select(F.size(fts_tokens("content")).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sizes))  # one row of totals
    weighted = found.join(sized(df, 64, n_phrases), "phrase").select("phrase", "chunk_id", (idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("score"))
    scored = weighted.join(sized(phrases, 100, n_phrases), "phrase").groupBy("query_id", "variant", "op", "n_terms", "chunk_id").agg(F.sum("score").alias("bm25"), F.count(F.lit(1)).alias("got"))
    return scored.where((F.col("op") == "or") | (F.col("got") == F.col("n_terms"))).select("query_id", "variant", "chunk_id", "bm25")


def bm25_top(index: Index, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, variant, op, terms, k) -> query_id, variant, chunk_id, bm25: all hits from the k-th best on, and maybe some below it.

    Blocks tell the most that each zone can come to for a query. The rarest terms' postings give k chunks' scores in part, so the
    k-th best is no less than the k-th of these; zones that can't come to that are left out before their blocks are taken apart.
    Of queries that ask for all terms, zones without one of them are left out. Queries with phrases are scored in full.
    """
    by = ["query_id", "variant"]
    wanted, _ = held(wanted, "asked")
    several = F.exists("terms", lambda t: t.contains("_"))
    phrased = wanted.where(several).drop("k")
    plain = wanted.where(~several)
    asked = plain.select(*by, "op", "k", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy(*by, "op", "k", "n_terms", "term").agg(F.count(F.lit(1)).alias("times"))
    asked, n_asked = held(asked, "terms")
    if not n_asked:
        return bm25(index, phrased)
    weighed = sized(asked, 100, n_asked).join(index.vocab.where(_any_of(asked)), "term").crossJoin(F.broadcast(index.sizes))
    weighed, _ = held(weighed.withColumn("weight", F.col("times") * idf(F.col("n"), F.col("df"))).drop("n"), "weighed")
    weighed_side = sized(weighed, 120, n_asked)
    # what each zone can come to; a bound is rounded up, so that no rounding of sums passes it
    heads = index.of(asked, ["term", "seq", "zone", "most_tf", "least_dl"]).join(weighed_side, "term")
    bound = F.col("weight") * impact(F.col("most_tf"), F.col("least_dl"), F.col("avgdl")) * (1 + 1e-9)
    zones = heads.groupBy(*by, "op", "n_terms", "seq", "zone").agg(F.sum(bound).alias("most"), F.sum("times").alias("got"))
    # a floor for the k-th best: the rarest terms, as many as have k chunks
    rare = W.partitionBy(*by).orderBy("df", "term")
    seeds = weighed.where("op = 'or'").withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < F.col("k"))
    score = F.col("weight") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))
    seeds, _ = held(seeds, "seeds")
    rows = index.alive(unblocked(index.of(seeds, ["term", "seq", "chunk_ids", "tfs", "dls"]), "seq", positions=False))
    parts = rows.join(sized(seeds, 120, n_asked), "term").groupBy(*by, "k", "chunk_id").agg(F.sum(score).alias("part"))
    floor = parts.withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("part")))).where(F.col("at") == F.col("k")).select(*by, (F.col("part") * (1 - 1e-9)).alias("floor"))
    floor, _ = held(floor, "floor")
    open_ = zones.join(sized(floor, 40, n_asked), by, "left").where(F.when(F.col("op") == "or", F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).otherwise(F.col("got") == F.col("n_terms")))
    open_, n_open = held(open_.select(*by, "op", "n_terms", "seq", "zone"), "zones")
    wide = weighed.drop("op", "n_terms").join(sized(open_, 60, n_open), by)  # (query, term, zone): the blocks that are taken apart
    wide, n_wide = held(wide, "open")
    blocks = index.of(asked, ["term", "seq", "zone", "chunk_ids", "tfs", "dls"]).join(sized(wide, 140, n_wide), ["term", "seq", "zone"])
    rows = index.alive(unblocked(blocks, "seq", *by, "op", "n_terms", "times", "weight", "avgdl", positions=False))
    found = rows.groupBy(*by, "op", "n_terms", "chunk_id").agg(F.sum(score).alias("bm25"), F.sum("times").alias("got"))
    found = found.where((F.col("op") == "or") | (F.col("got") == F.col("n_terms"))).select(*by, "chunk_id", "bm25")
    return found if phrased.isEmpty() else found.unionByName(bm25(index, phrased))
