"""Keyword, semantic and hybrid ranking (inventory R1-R18, J19, P3, P20, P24, P30-P32, F27).

Scores are columns over one scan of the documents, so a search is filter -> project -> top-k: no
join, no shuffle beyond the final merge of each task's k best rows. Ties are broken by id.

Keyword score (the engine's own definition): sum over query tokens and fields of
field weight * term frequency * idf, with idf = ln(1 + N / df). It is mapped to [0, 1) by s/(1+s) so
that it can be mixed with the semantic score (1 + cosine) / 2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.functions import similarity as S
from codegrove.functions import text as T
from codegrove.functions import vectors as V
from codegrove.operators.filters import SearchFilter, SearchQuery, page

# Searchable fields, most important first, with the weights used here.
FIELD_WEIGHTS = {
    "content": 5.0, "name": 4.0, "qualified_name": 3.0, "signature": 2.0, "docstring": 1.0,
}
HIT_COLUMNS = (
    "id", "name", "qualified_name", "code_type", "file_path", "line_start", "line_end", "content",
    "language", "score",
)
HIGHLIGHTED_FIELDS = ("content", "name", "qualified_name")
FUNCTION_WORDS = ("def", "function", "method")
CLASS_WORDS = ("class", "type")


def query_tokens(text: str) -> list[str]:
    """Query words split like indexed text, each once, in order."""
    return list(dict.fromkeys(T.tokens_local(text)))


def _present_fields(docs: DataFrame) -> dict[str, float]:
    return {f: w for f, w in FIELD_WEIGHTS.items() if f in docs.columns}


def contains_search(docs: DataFrame, query: SearchQuery) -> DataFrame:
    """Case-insensitive substring of content or name; every hit scores 1."""
    needle = F.lit(query.text.lower())
    hit = F.lower(F.coalesce("content", F.lit(""))).contains(needle) | F.lower(
        F.coalesce("name", F.lit(""))
    ).contains(needle)
    found = query.filters.apply(docs).filter(hit).withColumn("score", F.lit(1.0))
    return page(found, query.limit, query.offset, F.desc("score"), "id")


def _typo_budget(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _is_term(token: Column, term: str, typos: bool) -> Column:
    budget = _typo_budget(term) if typos else 0
    if budget == 0:
        return token == term
    return F.levenshtein(token, F.lit(term), budget) >= 0


def _term_test(term: str, typos: bool):
    return lambda token: _is_term(token, term, typos)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and projections refer to but never repeat.

    The optimizer pushes a filter on a computed column below its projection and evaluates the expression
    again there. The output of a generator is left alone, so costly scores go through a one-row ``inline``.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def term_frequencies(docs: DataFrame, terms: list[str], typos: bool = False) -> Column:
    """Per term the field-weighted number of occurrences, each field tokenized once."""
    fields = _present_fields(docs)

    def count(token_lists: Column) -> Column:
        counts = []
        for term in terms:
            parts = [
                F.size(F.filter(token_lists[f], _term_test(term, typos))) * w for f, w in fields.items()
            ]
            counts.append(reduce(lambda a, b: a + b, parts).cast("double"))
        return F.array(*counts)

    lists = F.struct(*[T.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    return V.bound(lists, count)


def mentions(docs: DataFrame, terms: list[str]) -> Column:
    """Cheap necessary condition for an exact term match: the term occurs as a substring."""
    tests = [F.lower(F.coalesce(F.col(f), F.lit(""))).contains(t) for f in _present_fields(docs) for t in terms]
    return reduce(lambda a, b: a | b, tests)


def inverse_ratios(docs: DataFrame, terms: list[str], typos: bool) -> Column:
    """N / df per term as one scalar subquery (a single row of ``len(terms)`` numbers)."""
    # documents and hits are counted in one scan; texts without a query word are not tokenized
    counts = term_frequencies(docs, terms, typos)
    rows = computed_once(docs, _tf=counts if typos else F.when(mentions(docs, terms), counts))
    total = F.count(F.lit(1)).cast("double")
    df = [F.sum((F.get("_tf", F.lit(i)) > 0).cast("double")) for i in range(len(terms))]
    ratios = F.array(*[F.coalesce(F.try_divide(total, n), F.lit(0.0)) for n in df])
    return rows.agg(ratios.alias("ratio")).scalar()


def keyword_scores(
    docs: DataFrame, found: DataFrame, terms: list[str], typos: bool = False, only_hits: bool = False
) -> DataFrame:
    """R2: adds ``keyword_score`` to ``found``; idf comes from all ``docs``."""
    if not terms:
        return found.withColumn("keyword_score", F.lit(0.0))
    if only_hits and not typos:
        found = found.filter(mentions(docs, terms))
    rows = computed_once(
        found, _tf=term_frequencies(docs, terms, typos), _ratio=inverse_ratios(docs, terms, typos)
    )
    parts = [F.get("_tf", F.lit(i)) * F.log1p(F.get("_ratio", F.lit(i))) for i in range(len(terms))]
    return rows.withColumn("keyword_score", reduce(lambda a, b: a + b, parts)).drop("_tf", "_ratio")


def postings(docs: DataFrame) -> DataFrame:
    """Inverted index: (term, id, field, tf). ``WordIndex`` keeps it, with positions, by parts of the terms' hashes."""
    fields = _present_fields(docs)
    token_lists = F.array(
        *[
            F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(f), F.lit(""))).alias("t"))
            for f in fields
        ]
    )
    per_field = docs.select("id", F.inline(token_lists))
    return (
        per_field.select("id", "field", F.explode("t").alias("term"))
        .groupBy("term", "id", "field")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def postings_scores(index: DataFrame, n_documents: Column, terms: list[str], typos: bool = False) -> DataFrame:
    """R2 over the inverted index: (id, keyword_score) of the documents with a query term.

    The term filter reaches the scan; document frequencies come from the filtered rows only.
    """
    if not terms:
        return index.select("id", F.lit(0.0).alias("keyword_score")).limit(0)
    test = reduce(lambda a, b: a | b, [_is_term(F.col("term"), t, typos) for t in terms])
    names = F.filter(
        F.array(*[F.when(_is_term(F.col("term"), t, typos), F.lit(t)) for t in terms]),
        lambda x: x.isNotNull(),
    )
    weights = F.create_map(*[F.lit(x) for item in FIELD_WEIGHTS.items() for x in item])
    hits = index.filter(test).select(
        "id", F.explode(names).alias("q"), (F.col("tf") * weights[F.col("field")]).alias("wtf")
    )
    per_doc = hits.groupBy("q", "id").agg(F.sum("wtf").alias("wtf"))
    # one row per query word: bounded by the length of the query
    frequency = per_doc.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    return (
        per_doc.join(F.broadcast(frequency), "q")
        .groupBy("id")
        .agg(F.sum(F.col("wtf") * F.log1p(n_documents / F.col("df"))).alias("keyword_score"))
    )


def semantic_scores(docs: DataFrame, vector: list[float], embedding: str = "embedding") -> DataFrame:
    """Adds ``semantic_score`` = cosine with the query vector."""
    length = sum(v * v for v in vector) ** 0.5
    return computed_once(docs, semantic_score=V.cosine(F.col(embedding), V.literal(vector), length))


def boost(query: SearchQuery) -> Column:
    """Factors for exact names, qualified names and type words in the query."""
    words = query.words
    factor = F.when(F.lower("name").isin(*words), 2.0).otherwise(1.0) if words else F.lit(1.0)
    factor = factor * F.when(
        F.lower("qualified_name").contains(F.lit(query.text.lower())), 1.5
    ).otherwise(1.0)
    if any(w in words for w in FUNCTION_WORDS):
        factor = factor * F.when(F.col("code_type").isin("function", "method"), 1.3).otherwise(1.0)
    if any(w in words for w in CLASS_WORDS):
        factor = factor * F.when(F.col("code_type") == "class", 1.3).otherwise(1.0)
    return factor


def reranked(hits: DataFrame, query: SearchQuery) -> DataFrame:
    """base_score keeps the first ranking, score is boosted."""
    return hits.withColumn("base_score", F.col("score")).withColumn(
        "score", F.col("score") * boost(query)
    )


def with_highlights(hits: DataFrame, query: SearchQuery) -> DataFrame:
    """map field -> text with the query words marked."""
    words = query.text.split()
    parts = []
    for field in HIGHLIGHTED_FIELDS:
        parts += [F.lit(field), F.array(T.highlighted(F.col(field), words))]
    return hits.withColumn("highlights", F.create_map(*parts))


def score_documents(
    docs: DataFrame, query: SearchQuery, vector: list[float] | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Filtered documents with ``score`` for the query's mode.

    With an inverted index the keyword part reads only matching postings and is joined by id;
    without one it is computed in the same scan as the rest.
    """
    terms = query_tokens(query.text)
    keyword_share, semantic_share = query.weights()
    if query.mode == "semantic" or (query.mode == "hybrid" and not terms):
        found = semantic_scores(query.filters.apply(docs), vector)
        return found.withColumn("score", F.col("semantic_score"))
    if index is None:
        # idf is that of the whole collection, whatever the filter
        found = query.filters.apply(docs)
        scored = keyword_scores(docs, found, terms, query.max_typos, query.mode == "keyword")
    else:
        total = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
        kw = postings_scores(index, total, terms, query.max_typos)
        how = "inner" if query.mode == "keyword" else "left"
        scored = query.filters.apply(docs).join(kw, "id", how).fillna(0.0, ["keyword_score"])
    keyword = F.col("keyword_score") / (F.col("keyword_score") + 1.0)
    if query.mode == "keyword":
        return scored.filter(F.col("keyword_score") > 0).withColumn("score", keyword)
    scored = semantic_scores(scored, vector)
    mixed = keyword * keyword_share + (F.col("semantic_score") + 1.0) / 2.0 * semantic_share
    return scored.withColumn("score", mixed)


def search(
    docs: DataFrame, query: SearchQuery, vector: list[float] | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """One plan: filter -> score -> boost -> threshold -> order -> offset/limit -> highlight.

    With an index the documents are ranked without their texts; the texts of the hits are fetched afterwards.
    """
    texts = docs.select("id", "content") if index is not None and "content" in docs.columns and not query.dedup else None
    hits = score_documents(docs if texts is None else docs.drop("content"), query, vector, index)
    if query.mode == "hybrid" and query.rerank:
        hits = reranked(hits, query)
    if query.min_score > 0:
        hits = above(hits, query.min_score)
    if query.dedup:
        hits = best_hits(hits)
    keep = [c for c in (*HIT_COLUMNS, "base_score") if c in hits.columns]
    if not query.include_content:
        keep.remove("content")
    order = {
        "relevance": ["score"], "file_path": ["file_path"], "line_number": ["line_start"],
        "name": ["name"],
    }[query.sort_by]
    keys = [F.desc(c) if query.descending else F.asc(c) for c in order]
    hits = page(hits.select(*keep), query.limit, query.offset, *keys, "id")
    if texts is not None and query.include_content:
        # at most ``limit`` rows are sent to the tasks that read the texts
        fetched = texts.join(F.broadcast(hits), "id")
        hits = fetched.select(*[c for c in (*HIT_COLUMNS, "base_score") if c in fetched.columns]).orderBy(*keys, "id")
    return with_highlights(hits, query) if query.highlight and query.include_content else hits


def above(hits: DataFrame, minimum: float) -> DataFrame:
    """Hits at or above a score; their number is the new total."""
    return hits.filter(F.col("score") >= minimum)


def best_hits(hits: DataFrame) -> DataFrame:
    """One row per id, the best score wins. Duplicates are cut down before the shuffle."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "file_path")
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_group(hits: DataFrame, group: str, k: int, order: list | None = None) -> DataFrame:
    """The k best rows of each group; each task keeps k per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*(order or [F.desc("score"), F.col("id")]))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar(
    docs: DataFrame, vector: list[float], limit: int = 10, exclude_ids: list[str] | None = None,
    embedding: str = "embedding",
) -> DataFrame:
    """Nearest documents; exclusions are removed before the top-k, so none are lost."""
    found = docs.filter(~F.col("id").isin(*exclude_ids)) if exclude_ids else docs
    found = semantic_scores(found, vector, embedding).withColumn("score", F.col("semantic_score"))
    return page(found, limit, 0, F.desc("score"), "id")


def duplicates(
    docs: DataFrame, code_id: str, vector: list[float], threshold: float = 0.8, limit: int = 10,
    embedding: str = "embedding",
) -> DataFrame:
    """Other documents at least ``threshold`` similar to one document."""
    found = semantic_scores(docs.filter(F.col("id") != code_id), vector, embedding)
    found = found.withColumn("similarity", F.col("semantic_score")).filter(
        F.col("similarity") >= threshold
    )
    return page(found, limit, 0, F.desc("similarity"), "id")


def fuzzy_search(
    symbols: DataFrame, text: str, limit: int = 20, language: str | None = None,
    code_type: str | None = None,
) -> DataFrame:
    """Substring and fuzzy token score over names, qualified names and file names."""
    words = T.tokens_local(text)  # a repeated word scores again
    if language and "language" in symbols.columns:
        symbols = symbols.filter(F.lower("language") == language.lower())
    if code_type:
        symbols = symbols.filter(F.lower("code_type") == code_type.lower())
    needle = F.lit(text.lower())
    name, qualified, path = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "qualified_name", "file_path"))
    score = (
        F.when(F.lower(name).contains(needle), 20.0).otherwise(0.0)
        + F.when(F.lower(qualified).contains(needle), 10.0).otherwise(0.0)
        + F.when(F.lower(path).contains(needle), 5.0).otherwise(0.0)
    )
    if words:
        base = F.element_at(F.split(path, "/"), -1)
        for source, weight in ((name, 8.0), (qualified, 4.0), (base, 2.0)):
            best = S.best_matches(T.tokens(source), words)
            score = score + F.aggregate(best, F.lit(0.0), lambda total, x: total + x) * weight
    found = computed_once(symbols, score=F.round(score, 2)).filter(F.col("score") > 0)
    return page(found, limit, 0, F.desc("score"), "id")


def suggest(docs: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Names matching a partial query."""
    hits = contains_search(docs, SearchQuery(text, "keyword", limit=limit))
    return hits.select("id", "name", "qualified_name", F.col("code_type").alias("type"))


def symbols(docs: DataFrame, text: str, code_type: str | None = None, limit: int = 20) -> DataFrame:
    """P20: symbol search; the type filter comes before the limit."""
    kinds = (code_type,) if code_type else ()
    query = SearchQuery(text, "keyword", SearchFilter(code_types=kinds), limit=limit)
    return contains_search(docs, query).select(
        "id", "name", "qualified_name", "code_type", "file_path", F.col("line_start").alias("line")
    )


def find_function(docs: DataFrame, name: str, language: str | None = None, limit: int = 10) -> DataFrame:
    """Functions and methods by name."""
    flt = SearchFilter([language] if language else (), ("function", "method"))
    return contains_search(docs, SearchQuery(name, "keyword", flt, limit=limit))


def find_class(docs: DataFrame, name: str, language: str | None = None, limit: int = 10) -> DataFrame:
    """Classes by name."""
    flt = SearchFilter([language] if language else (), ("class",))
    return contains_search(docs, SearchQuery(name, "keyword", flt, limit=limit))


def routed_search(
    docs: DataFrame, query: SearchQuery, vector: list[float] | None = None,
    use_ranked: bool = True, index: DataFrame | None = None,
) -> DataFrame:
    """Ranked search when enabled, the name-based fuzzy search otherwise."""
    if use_ranked and (vector is not None or query.mode == "keyword"):
        return search(docs, query, vector, index)
    return fuzzy_search(query.filters.apply(docs), query.text, query.limit)
