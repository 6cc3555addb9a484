"""Full-text search over chunks: postings, BM25, a query grammar, snippets, boosts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.functions.porter import porter
from trailhead.functions.porter import stem as stem_of
from trailhead.operators.graph import written

#: Repeated chunk ids, and tokens looked for, up to which they are broadcast, counted before; beyond, the join shuffles.
SMALL = 100_000
K1, B = 1.2, 0.75


#: The indexed columns, as far as chunks have them.
FIELDS = ("file_path", "symbol_name", "content", "symbol_kind")


def field_tokens(chunks: DataFrame) -> dict[str, Column]:
    return {f: X.index_tokens(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS if f in chunks.columns}


def all_tokens(chunks: DataFrame) -> Column:
    return F.concat(*field_tokens(chunks).values())


def postings(chunks: DataFrame) -> DataFrame:
    """(term, field, chunk_id, tf)."""

    def marked(field: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))

    fields = [marked(f, t) for f, t in field_tokens(chunks).items()]
    p = chunks.select("chunk_id", F.explode(F.concat(*fields)).alias("p"))
    return p.groupBy("p.term", "p.field", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def _once_and_again(chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """chunks whose chunk_id is there once, whose terms a row holds whole, and those whose id is repeated, or None. Only ids are shuffled; runs a job."""
    again = written(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "repeated")
    if not again.written_rows:
        return chunks, None
    side = F.broadcast(again) if again.written_rows <= SMALL else again
    same = chunks["chunk_id"].eqNullSafe(side["chunk_id"])
    return chunks.join(side, same, "left_anti"), chunks.join(side, same, "left_semi")


#: Words whose stems a worker keeps.
KEPT_STEMS = 200_000
_stem = lru_cache(KEPT_STEMS)(stem_of)


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, chunks) of each batch of chunks (there, tokens), by stems; chunks are counted where ``there``."""
    for b in batches:
        words = b["tokens"].flatten().dictionary_encode()
        stems, of = np.unique(np.array([_stem(w) for w in words.dictionary.to_pylist()], object), return_inverse=True) if len(words) else (np.zeros(0, object), np.zeros(0, np.int64))
        term = of[words.indices.to_numpy()]
        chunk = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["tokens"]).fill_null(0).to_numpy(zero_copy_only=False))
        once = np.unique(chunk * max(1, len(stems)) + term)
        counted = once[b["there"].to_numpy(zero_copy_only=False)[once // max(1, len(stems))]] % max(1, len(stems))
        columns = [pa.array(stems, pa.string()), *(pa.array(np.bincount(x, minlength=len(stems)).astype(np.int64)) for x in (term, counted))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "occurrences", "chunks"])


def term_totals(chunks: DataFrame) -> DataFrame:
    """(term, occurrences, chunks) of the index's terms: tokens, folded, and Porter's stems of them. A chunk with several words of a stem counts once for it.
    Counted within tasks before anything is shuffled, so what moves grows with the vocabulary."""
    once, again = _once_and_again(chunks)
    tokens = once.select(F.col("chunk_id").isNotNull().alias("there"), all_tokens(once).alias("tokens"))
    total = tokens.mapInArrow(_stem_counts, "term string, occurrences long, chunks long")
    if again is not None:
        p = written(postings(again).groupBy(F.col("term").alias("token"), "chunk_id").agg(F.sum("tf").alias("tf")), "repeated")
        stems = p.select("token").distinct().withColumn("term", porter(F.col("token")))
        p = p.join(stems, "token").groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
        total = total.union(p.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("chunk_id").alias("chunks")))
    return total.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("chunks").alias("chunks"))


def field_sizes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field, terms, tokens, max_tf) of fields with tokens: distinct terms, all, and how often the commonest occurs. A chunk's row is counted on its own."""
    once, again = _once_and_again(chunks)
    fields = field_tokens(once)
    row = once.select("chunk_id", *[F.sort_array(t).alias(f"t_{f}") for f, t in fields.items()])

    def longest(c: str) -> Column:
        def step(a: Column, x: Column) -> Column:
            run = F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1))
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

        return F.aggregate(c, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"])

    def size(f: str) -> Column:
        c = f"t_{f}"
        return F.struct(F.lit(f).alias("field"), F.size(F.array_distinct(c)).cast("long").alias("terms"), F.size(c).cast("long").alias("tokens"), longest(c).cast("long").alias("max_tf"))

    sizes = row.select("chunk_id", F.inline(F.array(*map(size, fields)))).where("tokens > 0")
    if again is None:
        return sizes
    more = postings(again).groupBy("chunk_id", "field").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("max_tf"))
    return sizes.union(more)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, stem: bool = False) -> DataFrame:
    """The k best chunks per query (query_id, terms) that hold all of its terms in any field: query_id, place, chunk_id, score (negative,
    smaller is better). Runs jobs while the plan is built.

    Chunks are split into tokens once: in the pass that counts all chunks and tokens, only tokens that occur in a query leave the row, so nothing like the
    whole index is shuffled; what it finds is written. With stem, terms agree if their stems do: a pass before gives the vocabulary, which is
    stemmed, a row per distinct token, and its tokens that agree with a query's are looked for.
    """
    q = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    sized = chunks.select("chunk_id", all_tokens(chunks).alias("tokens")).withColumn("dl", F.size("tokens"))
    if stem:
        q = written(q.withColumn("term", porter(F.col("term"))), "query-stems")
        asked = q.select("term").distinct()
        if q.written_rows <= SMALL:
            asked = F.broadcast(asked)
        wanted = sized.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct().withColumn("term", porter(F.col("token"))).join(asked, "term")
    else:
        wanted = q.select("term").distinct().withColumn("token", F.col("term"))
    wanted = written(wanted.select("token", "term"), "wanted")
    side = F.broadcast(wanted) if wanted.written_rows <= SMALL else wanted
    counted = Observation()
    tokens = sized.observe(counted, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("all")).select("chunk_id", "dl", F.explode("tokens").alias("token"))
    hits = written(tokens.join(side, "token").groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf")), "hits")
    # without a token to look for Spark leaves the pass out, and nothing is counted or ranked
    n_all, tokens_all = (counted.get["n"], counted.get["all"]) if hits.written_rows else (0, 0)
    avgdl = F.lit(float(tokens_all) / n_all if tokens_all else None).cast("double")
    need = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = hits.join(df, "term")
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(n_all) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    s = s.withColumn("w", idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl)))
    ranked = s.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("have"))
    ranked = ranked.join(need, "query_id").where("have = need").withColumn("score", -F.round("w", 6))
    best = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query_id", "place", "chunk_id", "score")


def retrieval_metadata(results: DataFrame, strategy: str, cache_used: bool = False) -> DataFrame:
    """Per query of results (query_id, quality): the strategy's label, whether a cache answered, and the mean quality (null without results)."""
    return results.groupBy("query_id").agg(F.lit(strategy).alias("strategy"), F.lit(cache_used).alias("cache_used"), F.round(F.avg("quality"), 6).alias("quality_signal"))


def boosted(results: DataFrame, boosts: DataFrame) -> DataFrame:
    """Scores of results (query_id, chunk_id, file_path, score) times 1 + boost of their file, ranked anew."""
    r = results.join(boosts, "file_path", "left").withColumn("score", F.round(F.col("score") * (1 + F.coalesce("boost", F.lit(0.0))), 6))
    best = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return r.select("query_id", "chunk_id", "score", F.row_number().over(best).alias("place"))


def query_words(text: str) -> list[str]:
    """A query's words as the index has them: lower-cased, marks folded away."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO)))


class Parser:
    """The query grammar: terms (all must occur), prefix*, "phrases", AND, OR, NOT, (groups) and column:filters."""

    def __init__(self, query: str):
        self.tokens = re.findall(r"\"[^\"]*\"|[()]|[^\s()\"]+", query)
        self.at = 0

    def parse(self) -> tuple:
        tree = self._or()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r} in the query")
        return tree

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _or(self) -> tuple:
        parts = [self._and()]
        while self._peek() == "OR":
            self.at += 1
            parts.append(self._and())
        return ("or", *parts) if len(parts) > 1 else parts[0]

    def _and(self) -> tuple:
        parts, negative = [], []
        while (t := self._peek()) not in (None, ")", "OR"):
            if t == "AND":
                self.at += 1
                continue
            if t == "NOT":
                self.at += 1
                negative.append(self._leaf())
                continue
            parts.append(self._leaf())
        if not parts:
            raise ValueError("a query needs a term")
        tree = ("and", *parts) if len(parts) > 1 else parts[0]
        return ("not", tree, *negative) if negative else tree

    def _leaf(self, column: str | None = None) -> tuple:
        t = self._peek()
        if t is None or t in (")", "AND", "OR"):
            raise ValueError("a query needs a term")
        self.at += 1
        if t == "(":
            tree = self._or()
            if self._peek() != ")":
                raise ValueError("a group isn't closed")
            self.at += 1
            return ("in", column, tree) if column else tree
        if m := re.fullmatch(r"(\w+):(.*)", t):
            if m[2]:
                self.tokens.insert(self.at, m[2])
            return self._leaf(m[1])
        if t.startswith('"'):
            return ("phrase", column, query_words(t))
        return ("prefix", column, t[:-1].lower()) if t.endswith("*") else ("term", column, t.lower())


def matches(tree: tuple, columns: dict[str, Column]) -> Column:
    """A condition for a parsed query over token arrays by column name; without a filter any column may match."""

    def leaf(test, column):
        over = [columns[column]] if column else list(columns.values())
        out = test(over[0])
        for c in over[1:]:
            out = out | test(c)
        return out

    kind = tree[0]
    if kind in ("and", "or"):
        out = matches(tree[1], columns)
        for t in tree[2:]:
            out = (out & matches(t, columns)) if kind == "and" else (out | matches(t, columns))
        return out
    if kind == "not":
        out = matches(tree[1], columns)
        for t in tree[2:]:
            out = out & ~matches(t, columns)
        return out
    if kind == "in":
        return matches(tree[2], {tree[1]: columns[tree[1]]})
    if kind == "term":
        parts = query_words(tree[2])
        if len(parts) != 1:
            return matches(("phrase", tree[1], parts), columns)
        return leaf(lambda c: F.array_contains(c, parts[0]), tree[1])
    if kind == "prefix":
        return leaf(lambda c: F.exists(c, lambda t: t.startswith(tree[2])), tree[1])
    return leaf(lambda c: F.instr(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), F.lit(f" {' '.join(tree[2])} ")) > 0, tree[1])


def search(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that match a query of the grammar over their indexed columns."""
    return chunks.where(matches(Parser(query).parse(), field_tokens(chunks)))


def snippet(content: Column, terms: Column, size: int = 32) -> Column:
    """size words from a few before the first hit, hits between >>> and <<<, dots where text is left out."""
    w = X.words(content)
    hit = F.transform(w, lambda t: F.arrays_overlap(X.index_tokens(t), terms))
    first = F.greatest(F.lit(1), F.array_position(hit, True).cast("int") - 4)
    part = F.slice(w, first, F.lit(size))
    marked = F.transform(part, lambda t: F.when(F.arrays_overlap(X.index_tokens(t), terms), F.concat(F.lit(">>>"), t, F.lit("<<<"))).otherwise(t))
    return F.concat(F.when(first > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(first + size <= F.size(w), "...").otherwise(""))


def best_snippets(rows: DataFrame, content: str, terms: str, size: int = 32, out: str = "snippet") -> DataFrame:
    """rows plus out: of all stretches of size words that begin with a hit the one with the most distinct terms, the earliest among equals, in the middle
    of size words; hits between >>> and <<<, dots where text is left out. Without hits the text's beginning; null for a null text."""
    names = rows.columns
    r = rows.withColumn("w_", X.words(F.col(content)))
    r = r.withColumn("hit_", F.transform("w_", lambda t: F.array_intersect(X.index_tokens(t), F.col(terms))))
    places = F.when(F.size("w_") > 0, F.sequence(F.lit(1), F.size("w_"))).otherwise(F.array().cast("array<int>"))
    r = r.withColumn("at_", F.filter(places, lambda i: F.size(F.element_at("hit_", i)) > 0))
    r = r.withColumn("score_", F.transform("at_", lambda i: F.size(F.array_distinct(F.flatten(F.slice("hit_", i, F.lit(size)))))))
    r = r.withColumn("start_", F.get("at_", (F.array_position("score_", F.array_max("score_")) - 1).cast("int")))
    r = r.withColumn("last_", F.array_max(F.filter("at_", lambda i: i < F.col("start_") + size)))
    r = r.withColumn("first_", F.coalesce(F.greatest(F.lit(1), F.col("start_") - F.floor((size - (F.col("last_") - F.col("start_") + 1)) / 2).cast("int")), F.lit(1)))
    marked = F.transform(F.slice("w_", F.col("first_"), F.lit(size)), lambda t, i: F.when(F.size(F.element_at("hit_", i + F.col("first_"))) > 0, F.concat(F.lit(">>>"), t, F.lit("<<<"))).otherwise(t))
    text = F.concat(F.when(F.col("first_") > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(F.col("first_") + size <= F.size("w_"), "...").otherwise(""))
    return r.withColumn(out, F.when(F.col(content).isNotNull(), text)).select(*[c for c in names if c != out], out)


def rrf(rankings: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, item, place): the sum of 1 / (constant + place)."""
    s = rankings.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (constant + F.col("place"))), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return s.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
