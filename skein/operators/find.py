"""Finding nodes: by name, by keyword, by BM25, by vector, and all of these together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BM25 parameters of the full-text index whose ranking is matched.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
DEFAULT_LIMIT = 8


def name_find(nodes: DataFrame, query: str, kind: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(id, type, name, score): equal 1.0, prefix or path suffix 0.9, contained 0.8; without external nodes."""
    q = query.strip().lower()
    name = F.lower("name")
    score = F.when(name == q, 1.0).when(name.startswith(q) | name.endswith("/" + q), 0.9).when(name.contains(q), 0.8)
    rows = nodes.where(F.coalesce(F.col("attrs")["external"], F.lit("")) != "true") if "attrs" in nodes.columns else nodes
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.select("id", "type", "name", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "name", "id").limit(limit)


def terms_of(query: str) -> list[str]:
    return query.lower().split()


def term_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms, repeats included, occur in a lower-case text."""
    score = F.lit(0)
    for t in terms:
        score = score + text.contains(t).cast("int")
    return score


def keyword_find(texts: DataFrame, query: str, kind: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(id, type, name, score) by the number of terms within name and text."""
    rows = texts.where(F.col("type") == kind) if kind else texts
    score = term_score(F.lower(F.concat_ws(" ", "name", "text")), terms_of(query))
    return rows.select("id", "type", "name", score.cast("double").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(texts: DataFrame) -> DataFrame:
    """(term, id, tf, positions, dl): the inverted index of (id, text)."""
    words = texts.select("id", word_tokens(F.col("text")).alias("words"))
    placed = words.select("id", F.size("words").alias("dl"), F.posexplode("words").alias("at", "term"))
    return placed.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def bm25(index: DataFrame, sizes: DataFrame, phrases: list[str], limit: int = DEFAULT_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score): sum over quoted phrases of idf and saturated frequency.

    sizes: (id, dl) of all texts. A phrase of several tokens needs them next to
    each other. Only the postings of the query's tokens are read; the length
    statistics are one aggregate. allowed: ids to rank, applied before the limit.
    """
    stats = sizes.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))
    scored = None
    for number, phrase in enumerate(phrases):
        tokens = [t for t in _split(phrase) if t]
        if not tokens:
            continue
        hits = index.where(F.col("term") == tokens[0]).select("id", "dl", "tf", "positions")
        for k, token in enumerate(tokens[1:], 1):
            more = index.where(F.col("term") == token).select("id", F.col("positions").alias("next"))
            hits = hits.join(more, "id").withColumn("positions", F.filter("positions", follows(k))).where(F.size("positions") > 0).drop("next")
        hits = hits.select("id", "dl", (F.size("positions") if len(tokens) > 1 else F.col("tf")).alias("tf"), F.lit(number).alias("phrase"))
        scored = hits if scored is None else scored.unionByName(hits)
    if scored is None:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    df = scored.groupBy("phrase").agg(F.count("*").alias("n"))
    rows = scored.join(F.broadcast(df), "phrase").join(F.broadcast(stats))  # as many rows as the query has phrases, and one
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    ranked = rows.groupBy("id").agg(F.sum(part).alias("score"))
    ranked = ranked if allowed is None else ranked.join(allowed.select("id"), "id", "left_semi")
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def follows(step: int) -> Callable[[Column], Column]:
    """Whether the next token stands so many places behind a position."""
    return lambda p: F.array_contains("next", p + step)


def _split(text: str) -> list[str]:
    import re

    return re.split(r"[\W_]+", text.lower())


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector; null where the dimensions differ or a norm is zero."""
    size = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / size if size else 0.0) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / norm)


def vector_top(vectors: DataFrame, query: list[float], limit: int = DEFAULT_LIMIT, kind: str | None = None, column: str = "vector") -> DataFrame:
    """Rows by cosine with the query, a type filter before the limit; every task keeps its own top."""
    rows = vectors.where(F.col("type") == kind) if kind is not None else vectors
    return rows.withColumn("score", cosine(F.col(column), query)).where("score IS NOT NULL").drop(column).orderBy(F.desc("score"), "id").limit(limit)


def best_of_variants(vectors: DataFrame, queries: list[list[float]], limit: int = DEFAULT_LIMIT, kind: str | None = None, column: str = "vector") -> DataFrame:
    """(id, score, variant): each variant's top, the best score of every id; variant is the first that found it."""
    tops = [vector_top(vectors, q, limit, kind, column).select("id", "score", F.lit(i).alias("variant")) for i, q in enumerate(queries)]
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return found.groupBy("id").agg(F.max("score").alias("score"), F.min("variant").alias("variant")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_merge(semantic: DataFrame, keyword: DataFrame, query: str, limit: int = DEFAULT_LIMIT, reserve: int = 3) -> DataFrame:
    """(id, name, tier, n): semantic hits cut to leave room for name hits, then name hits, then text hits.

    Both inputs have (id, name, n) with n their rank from 1 and hold at most limit rows.
    """
    named = term_score(F.lower("name"), terms_of(query)) > 0
    fresh = keyword.join(semantic.select("id"), "id", "left_anti").withColumn("tier", F.when(named, 1).otherwise(2))
    room = fresh.agg(F.least(F.lit(reserve), F.sum((F.col("tier") == 1).cast("int"))).alias("room"))
    first = semantic.join(F.broadcast(room)).where(F.col("n") <= limit - F.coalesce("room", F.lit(0))).select("id", "name", F.lit(0).alias("tier"), "n")
    return first.unionByName(fresh.select("id", "name", "tier", "n")).orderBy("tier", "n", "id").limit(limit)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def reindex_plan(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action): reused where the stored hash is that of the text, else embedded; stored is (id, hash)."""
    rows = texts.select("id", text_hash(F.col("text")).alias("hash"))
    old = stored.select("id", F.col("hash").alias("old"))
    return rows.join(old, "id", "left").select("id", F.when(F.col("hash") == F.col("old"), "reused").otherwise("embedded").alias("action"))


def quoted_tokens(query: str) -> list[str]:
    """The words of a query as phrases, each of letters and digits between other characters."""
    return [t for t in query.lower().split() if any(_split(t))]


def full_text_find(texts: DataFrame, query: str, kind: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(id, type, name, score) in the order of BM25; the score that is shown is the number of terms within name and text."""
    words = texts.select("id", F.regexp_replace(F.concat_ws(" ", "name", "text"), "_", " ").alias("text"))
    phrases = quoted_tokens(query)
    # Only texts with a word of the query are taken apart; lengths are those of all.
    wanted = F.arrays_overlap("words", F.array(*[F.lit(t) for p in phrases for t in _split(p) if t])) if phrases else F.lit(False)
    counted = words.select("id", word_tokens(F.col("text")).alias("words"))
    placed = counted.where(wanted).select("id", F.size("words").alias("dl"), F.posexplode("words").alias("at", "term"))
    index = placed.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
    allowed = texts.where(F.col("type") == kind).select("id") if kind else None
    ranked = bm25(index, counted.select("id", F.size("words").alias("dl")), phrases, limit, allowed).withColumnRenamed("score", "rank")
    shown = term_score(F.lower(F.concat_ws(" ", "name", "text")), terms_of(query)).cast("double")
    return texts.join(F.broadcast(ranked), "id").orderBy(F.desc("rank"), "id").select("id", "type", "name", shown.alias("score"))


def find(nodes: DataFrame, texts: DataFrame, query: str, kind: str | None = None, limit: int = DEFAULT_LIMIT, embed: Callable[[str], list[float]] | None = None, vectors: DataFrame | None = None, expand: Callable[[str], list[str]] | None = None, full_text: bool = False) -> tuple[str, DataFrame]:
    """Method and hits (id, type, name, score): a bare name first, then vectors with keywords merged in, else full text if asked for, else keywords."""
    limit = limit if limit > 0 else DEFAULT_LIMIT
    query = query.strip()
    if query and not any(c in query for c in " \t"):
        hits = name_find(nodes, query, kind, limit)
        if hits.limit(1).count():
            return "name", hits
    method, keyword = "keyword", keyword_find(texts, query, kind, limit)
    if full_text and (ranked := full_text_find(texts, query, kind, limit)).limit(1).count():
        method, keyword = "keyword-fts", ranked
    if embed is None or vectors is None:
        return method, keyword
    variants = list(dict.fromkeys(v.strip() for v in [query, *(expand(query) if expand else [])] if v.strip()))
    try:
        queries = [embed(v) for v in variants]
    except Exception:  # an embedder that is down leaves the keywords
        return method, keyword
    live = vectors.join(nodes.select("id", "name"), "id") if "name" not in vectors.columns else vectors.join(nodes.select("id"), "id", "left_semi")
    semantic = best_of_variants(live, queries, limit, kind)
    rows = semantic.collect()
    if not rows:
        return method, keyword
    method = "semantic+expanded" if any(r.variant > 0 for r in rows) else "semantic"
    spark = nodes.sparkSession
    ranked = spark.createDataFrame([(r.id, float(r.score), i) for i, r in enumerate(rows, 1)], "id string, score double, n int").join(nodes.select("id", "type", "name"), "id")
    words = spark.createDataFrame([(r.id, r.name, float(r.score), i) for i, r in enumerate(keyword.collect(), 1)], "id string, name string, score double, n int")
    merged = hybrid_merge(ranked, words, query, limit)
    if merged.where("tier > 0").limit(1).count():
        method = method.replace("semantic", "hybrid", 1)
    scores = ranked.select("id", "score").unionByName(words.select("id", "score")).groupBy("id").agg(F.max("score").alias("score"))
    return method, merged.join(scores, "id").join(nodes.select("id", "type"), "id").orderBy("tier", "n", "id").select("id", "type", "name", "score")
