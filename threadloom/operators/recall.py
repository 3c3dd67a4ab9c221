"""Recall: full-text, substring, pattern and vector search, ranked and fused."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import is_cjk, query_terms, snippet, terms
from threadloom.functions.vectors import cosine_to
from threadloom.operators.store import in_range
from threadloom.sources.scratch import saved

K1, B = 1.2, 0.75
#: Characters that the full-text syntax doesn't know: queries with them are searched as substrings.
NO_SYNTAX = re.compile(r"[?.',/@=#%]")


def sanitise(query: str) -> str:
    """The words of a query without full-text syntax; NEAR stays a word."""
    plain = re.sub(r'["*()\-+^:]', " ", query or "")
    plain = re.sub(r"\b(?:NOT|OR|AND)\b", "", plain, flags=re.IGNORECASE)
    return " ".join(plain.split())


def bm25(docs: DataFrame, text_col: str, query: list[str]) -> DataFrame:
    """``docs`` that hold all query terms, with ``score``; the statistics are those of all rows of ``docs``.

    One pass over the texts gives the table's statistics (a single row), a second one the scores. Each pass splits
    a text once: the counts come out of a generator, below which Spark doesn't push (and so repeat) what uses them.
    """
    words = list(dict.fromkeys(query))

    def counted(keep) -> Column:
        tf = lambda t: F.array(*[F.size(F.filter(t, _equals(q))) for q in words]) if words else F.array().cast("array<int>")
        rows = F.transform(F.array(terms(F.col(text_col))), lambda t: F.struct(F.size(t).alias("dl"), tf(t).alias("tf")))
        return F.explode(F.filter(rows, keep)).alias("__s")

    seen = [F.count_if(F.col("__s.tf")[i] > 0).alias(f"n{i}") for i in range(len(words))]
    stats = docs.select(counted(lambda s: F.lit(True))).agg(F.count(F.lit(1)).alias("n"), F.avg("__s.dl").alias("avgdl"), *seen).first()
    held = docs.select("*", counted(lambda s: F.forall(s.tf, lambda f: f > 0)))
    length, score = F.col("__s.dl").cast("double"), F.lit(0.0)
    for q in query:
        i = words.index(q)
        f = F.col("__s.tf")[i]
        idf = F.greatest(F.log((F.lit(float(stats["n"])) - stats[f"n{i}"] + 0.5) / (F.lit(float(stats[f"n{i}"])) + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(float(stats["avgdl"] or 1.0))))
    return held.withColumn("score", score).drop("__s")


def _equals(q: str):
    return lambda x: x == F.lit(q)


def like(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows where any column holds the query as a substring, ASCII case aside; % and _ in it are wildcards, a backslash is itself."""
    pattern, found = "%" + query.replace("\\", "\\\\") + "%", F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(pattern)
    return rows.where(found)


def regex(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in which a Python pattern is found; a pattern that isn't one raises re.error here.

    Named groups and references to them are rewritten for Java, classes are Unicode. What Java doesn't take (a
    name with an underscore, a conditional) is matched by Python, in Arrow batches.
    """
    compiled = re.compile(pattern)
    java = "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    if _java_takes(rows, java):
        return rows.where(F.col(column).rlike(java))

    @F.pandas_udf("boolean")
    def found(texts):
        return texts.map(lambda t: t is not None and compiled.search(t) is not None).astype(bool)

    return rows.where(found(F.col(column)))


def _java_takes(rows: DataFrame, pattern: str) -> bool:
    """Spark folds the constant when it plans, and so tells without a job."""
    try:
        rows.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as e:
        if "INVALID_PARAMETER_VALUE.PATTERN" in str(e) or "PatternSyntaxException" in str(e):
            return False
        raise
    return True


def hits(rows: DataFrame, kind: str, order: int) -> DataFrame:
    """Result rows of messages or summaries in the common shape."""
    names = ("role", "seq") if kind == "message" else ("kind", "depth")
    meta = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    key = "id" if kind == "message" else "summary_id"
    score = F.col("score") if "score" in rows.columns else F.lit(0.0)
    return rows.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), snippet(F.col("content")).alias("content_snippet"), "conversation_id", meta.alias("metadata"), "created_at", score.alias("score"), F.lit(order).alias("src"))


def search(rows: DataFrame, query: str, kind: str, conversation_id=None, since=None, before=None, mode: str = "full_text", index_path: str | None = None, grams_path: str | None = None) -> DataFrame:
    """Messages or summaries that match, not yet limited: the plan is chosen from the query text alone.

    With ``index_path``, full text is searched in an index of all ``rows`` (see ``operators.index``) instead of the texts;
    with ``grams_path``, substrings and patterns are looked for in the rows that an index of trigrams (``operators.grams``) names.
    """
    from threadloom.operators import grams, index

    key = "id" if kind == "message" else "summary_id"

    def within(x: DataFrame) -> DataFrame:
        return in_range(x if conversation_id is None else x.where(F.col("conversation_id") == conversation_id), since, before)

    def substring(x: DataFrame, text: str) -> DataFrame:
        return like(x, ["content"], text) if grams_path is None else grams.like(x, key, "content", text, grams_path)

    order = 0 if kind == "message" else 1
    if mode == "regex":
        found = regex(within(rows), "content", query) if grams_path is None else grams.regex(within(rows), key, "content", query, grams_path)
        return hits(found, kind, order)
    clean = sanitise(query)
    if is_cjk(query):
        parts = [w for w in clean.split() if len(w) >= 3] if kind == "summary" else []
        found = within(rows)
        for w in parts or [query]:
            found = substring(found, w)
        return hits(found, kind, order)
    if not clean:
        return hits(substring(within(rows), query) if kind == "message" else rows.limit(0), kind, order)
    if NO_SYNTAX.search(query):
        return hits(substring(within(rows), query), kind, order)
    if index_path is None:
        return hits(within(bm25(rows, "content", query_terms(clean))), kind, order)
    found = index.search(rows.sparkSession, index_path, query_terms(clean)).withColumnRenamed("id", key)
    return hits(within(rows.join(found, key)), kind, order)


def grep(messages: DataFrame, summaries: DataFrame, query: str, scope: str = "all", conversation_id=None, limit: int = 20, mode: str = "full_text", since=None, before=None, offset: int = 0, indexes: dict[str, str] | None = None, grams: dict[str, str] | None = None) -> DataFrame:
    """Message hits, then summary hits, each the best ``limit``; then offset and limit over both.

    ``indexes`` names the places of full-text indexes by kind (message, summary), ``grams`` those of trigram indexes;
    without one, the texts are read.
    """
    parts = []
    for kind, table in (("message", messages), ("summary", summaries)):
        if scope in ("all", {"message": "messages", "summary": "summaries"}[kind]):
            found = search(table, query, kind, conversation_id, since, before, mode, (indexes or {}).get(kind), (grams or {}).get(kind))
            parts.append(found.orderBy(F.desc(F.round("score", 9)), "id").limit(limit))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.orderBy("src", F.desc(F.round("score", 9)), "id")
    return (out if mode == "regex" or not offset else out.offset(offset)).limit(limit)


def grouped(found: DataFrame, covering: DataFrame) -> DataFrame:
    """Hits by the summary that covers them (summary hits by themselves), first-seen order in ``rank``.

    ``covering`` is (message_id, summary_id), one row for each message; uncovered hits have a null summary_id.
    """
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("src", F.desc(F.round("score", 9)), "id")))  # at most the limit of a search
    c = covering.select(F.col("message_id").cast("string").alias("id"), F.col("summary_id").alias("covers"))
    joined = ranked.join(c, "id", "left").withColumn("summary_id", F.when(F.col("type") == "summary", F.col("id")).otherwise(F.col("covers")))
    return joined.groupBy("summary_id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("matches"))


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """Of rows with one key (such as the beginning of a content) the first, in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def vector_top(rows: DataFrame, query: list[float], k: int, id_col: str, exclude=None, conversation_ids: list | None = None, min_score: float | None = None) -> DataFrame:
    """The k most similar rows; a threshold and filters hold before the limit."""
    scored = rows.withColumn("score", cosine_to(F.col("embedding"), query)).where("score is not null")
    if exclude is not None:
        scored = scored.where(F.col("conversation_id") != exclude)
    if conversation_ids is not None:
        scored = scored.where(F.col("conversation_id").isin(*conversation_ids) if conversation_ids else F.lit(False))
    if min_score is not None and min_score > 0:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, rank from 0) lists: id, score, first (place of first insertion)."""
    both = None
    for i, x in enumerate(lists):
        x = x.select("id", "rank", F.lit(i).alias("list"))
        both = x if both is None else both.unionByName(x)
    return both.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def hybrid(by_text: DataFrame, by_vector: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """The best ``limit`` of two ranked lists (id, rank from 0) by reciprocal rank fusion; without vector hits, the text hits.

    Ties go to the first of the first list. Both lists are the tops of searches, so they are short.
    """
    fused = fuse([by_text, by_vector], k).withColumn("score", F.round("score", 9))
    return fused.orderBy(F.desc("score"), "first").limit(limit)


def append_summaries(found: DataFrame, hits: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """``found`` (id, place), then the summaries among the vector hits (id, score) that it lacks, best first, up to ``limit``."""
    more = hits.join(found.select("id"), "id", "left_anti").join(summaries.select(F.col("summary_id").alias("id")), "id", "left_semi")
    after = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # a top-k list
    both = found.select("id", F.lit(0).alias("part"), F.col("place").cast("long").alias("place")).unionByName(more.select("id", F.lit(1).alias("part"), after.cast("long").alias("place")))
    return both.orderBy("part", "place").limit(limit)


def hybrid_grep(messages: DataFrame, summaries: DataFrame, query: str, vector: list[float], message_vectors: DataFrame, summary_vectors: DataFrame | None = None, scope: str = "all", conversation_id=None, limit: int = 20, top_k: int = 20, min_score: float = 0.35, since=None, before=None, k: int = 60, indexes: dict[str, str] | None = None) -> DataFrame:
    """Result rows of a search by words and by vectors, with their ``place``.

    Text hits (see ``grep``) and the nearest messages are fused by their ranks; then come the nearest summaries that
    are not there yet, up to ``limit``. All filters hold for all hits. Hits that only a vector found have ``vector``
    as the source in their metadata. Vectors (id, conversation_id, embedding) whose row is gone are left out.
    """
    only = None if conversation_id is None else [conversation_id]
    place = lambda *order: (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")  # noqa: E731  over the tops of searches, which limits bound
    text = grep(messages, summaries, query, scope, conversation_id, limit, since=since, before=before, indexes=indexes)
    text = saved(text.withColumn("rank", place("src", F.desc(F.round("score", 9)), "id")), "hits")  # the best of a search, read several times

    def nearest(vectors: DataFrame, rows: DataFrame, key: str, kind: str) -> DataFrame:
        top = vector_top(vectors.withColumn("id", F.col("id").cast("string")), vector, top_k, "id", conversation_ids=only, min_score=min_score).select("id", F.col("score").alias("near"))
        own = in_range(rows if conversation_id is None else rows.where(F.col("conversation_id") == conversation_id), since, before)
        found = own.join(F.broadcast(top.withColumnRenamed("id", "__id")), F.col(key).cast("string") == F.col("__id")).drop("__id")  # at most top_k rows
        shown = hits(found.withColumn("score", F.col("near")), kind, 0 if kind == "message" else 1)
        return shown.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("source"), F.lit("vector"))))

    order = [F.desc(F.round("score", 9)), "id"]
    columns = [c for c in text.columns if c != "rank"]
    ranked = text
    if scope in ("all", "messages"):
        near = saved(nearest(message_vectors, messages, "id", "message").withColumn("rank", place(*order)), "near")
        fused = hybrid(text.select("id", "rank"), near.select("id", "rank"), limit, k).withColumn("fused", F.col("score")).drop("score")
        both = text.select(*columns).unionByName(near.join(text.select("id"), "id", "left_anti").select(*columns))
        ranked = both.join(fused, "id").withColumn("rank", place(F.desc("fused"), "first"))
    ranked = ranked.select(*columns, F.lit(0).alias("part"), "rank")
    if summary_vectors is not None and scope in ("all", "summaries"):
        near = nearest(summary_vectors, summaries, "summary_id", "summary").withColumn("rank", place(*order))
        more = near.join(ranked.select("id"), "id", "left_anti")
        ranked = ranked.unionByName(more.select(*columns, F.lit(1).alias("part"), "rank"))
    return ranked.withColumn("place", place("part", "rank")).where(F.col("place") < limit).select(*columns, "place")


def any_keyword(rows: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Relaxed search: rows by how many keywords they hold, where each keyword brings its ``2 * limit`` best only."""
    t = rows.withColumn("__t", terms(F.col("content")))
    one = t.withColumn("word", F.explode(F.array(*[F.lit(w) for w in words]))).where(F.array_contains("__t", F.col("word")))
    best = [F.desc("score"), "id"] if "score" in rows.columns else ["id"]
    near = one.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(*best))).where(F.col("n") <= 2 * limit)
    place = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    seen = F.min(F.struct(place[F.col("word")].alias("word"), "n")).alias("first")  # ties: first seen, word by word
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("matches"), seen).orderBy(F.desc("matches"), "first").limit(limit)
