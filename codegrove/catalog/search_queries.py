"""Search queries: keyword, semantic, hybrid, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.catalog.carriers import DOC_UNITS, SYMBOLS, mock_vector, tok
from codegrove.catalog.registry import query
from codegrove.functions import text as T
from codegrove.operators import graph_lookup as L
from codegrove.operators import ranking as R
from codegrove.operators import search as S
from codegrove.operators.filters import SearchFilter, SearchQuery
from codegrove.operators import vector_cells as N
from codegrove.sources import tables as D
from codegrove.sources.models import MockEmbedder
from codegrove.sources.word_index import WordIndex, current
from codegrove.staging import Stage

HYBRID_TEXT = "function the and"
HYBRID_DIMS = 64


@query(
    "keyword_contains", "R1 R2 R5 R8 P2 P30",
    f"""WITH {DOC_UNITS} SELECT id, name, file_path, 1.0::DOUBLE AS score FROM doc_units
    WHERE contains(lower(content), 'tion') OR contains(lower(name), 'tion') ORDER BY id LIMIT 40 OFFSET 5""",
)
def keyword_contains(spark, sf):
    q = SearchQuery("tion", "keyword", limit=40, offset=5)
    return S.contains_search(D.document_units(spark, sf), q).select("id", "name", "file_path", "score")


@query(
    "keyword_filtered", "P1 P2 R10 R11 T7 T8 T9",
    f"""WITH {DOC_UNITS} SELECT id, name, language, code_type, line_end FROM doc_units
    WHERE contains(lower(content), 'and') AND language IN ('en', 'de') AND code_type IN ('function', 'class')
      AND line_start >= 1 AND line_end <= 40 AND regexp_full_match(file_path, 'src.*') AND NOT regexp_full_match(file_path, 'src1.*')
    ORDER BY id LIMIT 500""",
)
def keyword_filtered(spark, sf):
    flt = SearchFilter(("en", "de"), ("function", "class"), 1, 40, ("src*",), ("src1*",))
    q = SearchQuery("and", "keyword", flt, limit=500)
    return S.contains_search(D.document_units(spark, sf), q).select(
        "id", "name", "language", "code_type", "line_end"
    )


@query(
    "suggest", "R12",
    f"""WITH {SYMBOLS} SELECT id, name, qualified_name, code_type AS type FROM symbols
    WHERE contains(name, 'wid') ORDER BY id LIMIT 10""",
)
def suggest(spark, sf):
    docs = D.part_symbols(spark, sf).withColumn("content", F.lit(""))
    return S.suggest(docs, "wid", 10)


@query(
    "symbol_search", "P20",
    f"""WITH {SYMBOLS} SELECT id, name, qualified_name, code_type, file_path, line_start AS line FROM symbols
    WHERE contains(name, 'red') AND code_type = 'promo' ORDER BY id LIMIT 20""",
)
def symbol_search(spark, sf):
    docs = D.part_symbols(spark, sf).withColumn("content", F.lit(""))
    return S.symbols(docs, "red", "promo", 20)


@query(
    "find_function_class", "P31 P32",
    f"""WITH {DOC_UNITS}, f AS (SELECT id, code_type FROM doc_units WHERE code_type IN ('function', 'method')
      AND language = 'en' AND contains(lower(content), 'the') ORDER BY id LIMIT 10),
    c AS (SELECT id, code_type FROM doc_units WHERE code_type = 'class' AND contains(lower(content), 'der') ORDER BY id LIMIT 10)
    SELECT * FROM f UNION ALL SELECT * FROM c""",
)
def find_function_class(spark, sf):
    docs = D.document_units(spark, sf)
    found = S.find_function(docs, "the", "en").select("id", "code_type")
    return found.unionByName(S.find_class(docs, "der").select("id", "code_type"))


_KEYWORD_SQL = f"""WITH {DOC_UNITS},
t AS (SELECT id, {tok('content')} AS tc, {tok('name')} AS tn, {tok('qualified_name')} AS tq,
        {tok('signature')} AS ts, {tok('docstring')} AS td FROM doc_units),
q AS (SELECT unnest(['nation', 'doc', 'the']) AS w),
tf AS (SELECT id, w, 5.0 * len(list_filter(tc, lambda x: x = w)) + 4.0 * len(list_filter(tn, lambda x: x = w))
        + 3.0 * len(list_filter(tq, lambda x: x = w)) + 2.0 * len(list_filter(ts, lambda x: x = w))
        + 1.0 * len(list_filter(td, lambda x: x = w)) AS n FROM t, q),
idf AS (SELECT w, ln(1 + count(*)::DOUBLE / count(*) FILTER (n > 0)) AS f FROM tf GROUP BY w HAVING count(*) FILTER (n > 0) > 0),
s AS (SELECT id, sum(n * f)::DOUBLE AS k FROM tf JOIN idf USING (w) GROUP BY id)
SELECT id, round(k / (k + 1), 6) AS score FROM s WHERE k > 0 ORDER BY k DESC, id LIMIT 50"""
_KEYWORD_QUERY = SearchQuery("nation doc The", "keyword", limit=50, highlight=False)


def word_index(spark, sf) -> WordIndex:
    """The index of the documents as they are now; written by the first question that needs it, or before, by a call of this."""
    def build(path: str) -> None:
        WordIndex(spark, path).write(D.document_units(spark, sf), list(S.FIELD_WEIGHTS))

    return WordIndex(spark, current(spark, "words-2", [f"{sf}/documents.parquet"], build))


def _stored(spark, sf, terms: list[str]):
    """Stored postings of the terms, as ``postings`` gives them."""
    return word_index(spark, sf).postings(terms).select("term", "id", "field", F.size("positions").cast("long").alias("tf"))


@query("keyword_ranked", "R1 R2", _KEYWORD_SQL)
def keyword_ranked(spark, sf):
    hits = S.search(D.document_units(spark, sf), _KEYWORD_QUERY)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("keyword_postings", "R2 S26 G19", _KEYWORD_SQL)
def keyword_postings(spark, sf):
    docs = D.document_units(spark, sf)
    hits = S.routed_search(docs, _KEYWORD_QUERY, index=_stored(spark, sf, S.query_tokens(_KEYWORD_QUERY.text)))
    return hits.select("id", F.round("score", 6).alias("score"))


@query(
    "postings_index", "S26",
    f"""WITH {DOC_UNITS}, x AS (
      SELECT id, 'content' AS field, unnest({tok('content')}) AS term FROM doc_units
      UNION ALL SELECT id, 'name', unnest({tok('name')}) FROM doc_units
      UNION ALL SELECT id, 'qualified_name', unnest({tok('qualified_name')}) FROM doc_units
      UNION ALL SELECT id, 'signature', unnest({tok('signature')}) FROM doc_units
      UNION ALL SELECT id, 'docstring', unnest({tok('docstring')}) FROM doc_units)
    SELECT term, field, count(DISTINCT id) AS documents, count(*) AS occurrences FROM x GROUP BY ALL""",
)
def postings_index(spark, sf):
    index = S.postings(D.document_units(spark, sf))
    return index.groupBy("term", "field").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")
    )


_FIELD_NAMES = list(S.FIELD_WEIGHTS)
_PLACES = f"""{DOC_UNITS}, lists AS (
  """ + " UNION ALL ".join(
    f"SELECT id, {i} AS field_rank, '{f}' AS field, {tok(f)} AS t FROM doc_units" for i, f in enumerate(_FIELD_NAMES)
) + """),
places AS (SELECT id, field_rank, field, len(t) AS length, unnest(t) AS term, unnest(range(len(t))) AS pos FROM lists)"""


def _rules_sql(words: list[str], test: str, edits: str) -> str:
    """Ranking by rules; ``test`` and ``edits`` compare a term with a word w of the question."""
    last = [
        f"max(CASE WHEN nth = {i} THEN pos END) OVER (PARTITION BY id, field_rank ORDER BY pos RANGE UNBOUNDED PRECEDING)"
        for i in range(len(words))
    ]
    known = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(words)))
    least = ", ".join(f"l{i}" for i in range(len(words)))
    return f"""WITH {_PLACES},
    asked AS (SELECT unnest({words}) AS w, unnest(range({len(words)})) AS nth),
    met AS (SELECT p.*, nth, {edits} AS edits FROM places p JOIN asked ON {test}),
    lasts AS (SELECT *, {", ".join(f"{x} AS l{i}" for i, x in enumerate(last))} FROM met),
    windows AS (SELECT *, CASE WHEN {known} THEN pos - least({least}) + 1 END AS win FROM lasts),
    fields AS (SELECT id, field_rank, length, min(win) AS win FROM windows GROUP BY ALL),
    docs AS (SELECT id, min(win) AS proximity, min(field_rank) AS field_rank,
               coalesce(max(length = {len(words)} AND win = {len(words)}), false) AS exact FROM fields GROUP BY id),
    per_word AS (SELECT id, nth, min(edits) AS edits FROM met GROUP BY id, nth),
    counted AS (SELECT id, CAST(count(*) AS INTEGER) AS words, CAST(sum(edits) AS INTEGER) AS typos FROM per_word GROUP BY id)
    SELECT id, words, typos, CAST(proximity AS INTEGER) AS proximity, field_rank, exact FROM docs JOIN counted USING (id)"""


_NEAR_TEST = "levenshtein(term, w) <= CASE WHEN len(w) < 5 THEN 0 WHEN len(w) < 9 THEN 1 ELSE 2 END"
_NEAR_WORDS = ["thimg", "wortless", "disgustinng", "the"]


@query("keyword_proximity", "R2 S26", _rules_sql(["thing", "the", "ertion"], "term = w", "0"))
def keyword_proximity(spark, sf):
    words = S.query_tokens("thing The ertion")
    return R.best(word_index(spark, sf).matching(words, typos=False), len(words))


@query(
    "keyword_phrase_first", "R2",
    f"""SELECT * FROM ({_rules_sql(["nation", "doc", "the"], "term = w", "0")})
    ORDER BY words DESC, typos, proximity NULLS LAST, field_rank, exact DESC, id LIMIT 25""",
)
def keyword_phrase_first(spark, sf):
    words = S.query_tokens("nation doc The")
    return R.best(word_index(spark, sf).matching(words, typos=False), len(words), 25)


@query("keyword_rules_typos", "R2 P2", _rules_sql(_NEAR_WORDS, _NEAR_TEST, "levenshtein(term, w)"))
def keyword_rules_typos(spark, sf):
    return R.best(word_index(spark, sf).matching(_NEAR_WORDS), len(_NEAR_WORDS))


@query(
    "keyword_typos", "R2 P2",
    f"""WITH {_PLACES}, asked AS (SELECT unnest({_NEAR_WORDS}) AS w),
    weights AS (SELECT unnest({_FIELD_NAMES}) AS field, unnest({list(S.FIELD_WEIGHTS.values())})::DOUBLE AS weight),
    tf AS (SELECT id, w, sum(weight) AS n FROM places JOIN weights USING (field) JOIN asked ON {_NEAR_TEST} GROUP BY id, w),
    idf AS (SELECT w, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS f FROM tf GROUP BY w)
    SELECT id, round(sum(n * f), 6) AS keyword_score FROM tf JOIN idf USING (w) GROUP BY id""",
)
def keyword_typos(spark, sf):
    total = D.document_units(spark, sf).agg(F.count(F.lit(1)).cast("double")).scalar()
    scores = R.typo_scores(word_index(spark, sf).matching(_NEAR_WORDS), total)
    return scores.select("id", F.round("keyword_score", 6).alias("keyword_score"))


@query(
    "near_terms", "R2",
    f"""WITH {_PLACES}, asked AS (SELECT unnest({_NEAR_WORDS}) AS word)
    SELECT DISTINCT word, term, CAST(levenshtein(term, word) AS INTEGER) AS edits FROM places JOIN asked ON {_NEAR_TEST.replace("w)", "word)")}""",
)
def near_terms(spark, sf):
    return word_index(spark, sf).near_terms(_NEAR_WORDS).select("word", "term", "edits")


_FILE_ROWS = "SELECT file_path, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, count(*) AS units, max(line_end) AS lines FROM doc_units"


@query("indexed_files", "P21", f"WITH {DOC_UNITS} {_FILE_ROWS} WHERE regexp_full_match(file_path, 'src1.*') AND language IN ('en') GROUP BY file_path")
def indexed_files(spark, sf):
    return L.indexed_files(D.document_units(spark, sf), "src1*", "en")


@query("file_info", "P22", f"WITH {DOC_UNITS} {_FILE_ROWS} WHERE file_path = (SELECT min(file_path) FROM doc_units) GROUP BY file_path")
def file_info(spark, sf):
    docs = D.document_units(spark, sf)
    return L.file_info(docs, docs.agg(F.min("file_path")).first()[0])


_PREFIXES = ["t", "ert", "ontio", ""]


@query(
    "suggest_prefix", "R12",
    f"""WITH {_PLACES}, asked AS (SELECT unnest({_PREFIXES}) AS prefix),
    counts AS (SELECT prefix, term, count(DISTINCT id) AS documents FROM places JOIN asked ON starts_with(term, prefix) GROUP BY ALL)
    SELECT prefix, term, documents FROM
      (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY documents DESC, term) AS n FROM counts) WHERE n <= 12""",
)
def suggest_prefix(spark, sf):
    index = word_index(spark, sf)
    found = [index.suggestions(p, 12).select(F.lit(p).alias("prefix"), "term", "documents") for p in _PREFIXES]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    "term_dictionary", "R12 S26",
    f"""WITH {_PLACES} SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM places GROUP BY term""",
)
def term_dictionary(spark, sf):
    return word_index(spark, sf).terms_from("")


def _vectors(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("label")
    )


def _vector_of(spark, sf, vec_id):
    row = D.table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(
    "semantic_topk", "R3 R16 F30",
    f"""SELECT CAST(vec_id AS VARCHAR) AS id, label, round({_COS}, 6) AS score FROM embeddings
    ORDER BY {_COS} DESC, id LIMIT 10""",
)
def semantic_topk(spark, sf):
    hits = S.semantic_scores(_vectors(spark, sf), _vector_of(spark, sf, 0))
    hits = hits.orderBy(F.desc("semantic_score"), "id").limit(10)
    return hits.select("id", "label", F.round("semantic_score", 6).alias("score"))


@query(
    "cosine_all", "F30",
    f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings",
)
def cosine_all(spark, sf):
    hits = S.semantic_scores(_vectors(spark, sf), _vector_of(spark, sf, 0))
    return hits.select(F.col("id").cast("bigint").alias("vec_id"), F.round("semantic_score", 6).alias("cosine"))


@query(
    "similar_exclude", "J19 R13 G4",
    f"""SELECT CAST(vec_id AS VARCHAR) AS id, round({_COS}, 6) AS score FROM embeddings
    WHERE vec_id NOT IN (0, 1, 2) ORDER BY {_COS} DESC, id LIMIT 10""",
)
def similar_exclude(spark, sf):
    hits = S.similar(_vectors(spark, sf), _vector_of(spark, sf, 0), 10, ["0", "1", "2"])
    return hits.select("id", F.round("score", 6).alias("score"))


@query(
    "duplicates_threshold", "R14",
    f"""SELECT CAST(vec_id AS VARCHAR) AS id, round({_COS}, 6) AS similarity FROM embeddings
    WHERE vec_id <> 0 AND {_COS} >= 0.1 ORDER BY {_COS} DESC, id LIMIT 50""",
)
def duplicates_threshold(spark, sf):
    hits = S.duplicates(_vectors(spark, sf), "0", _vector_of(spark, sf, 0), 0.1, 50)
    return hits.select("id", F.round("similarity", 6).alias("similarity"))


@query("nearest_quantised", "J19 R13 R14")
def nearest_quantised(spark, sf):
    """The ten nearest of every twentieth vector, by cells and quantised residuals of all of them."""
    vectors = Stage(spark, "unit-vectors").table(N.usable(D.table(spark, sf, "embeddings"), "vec_id", "embedding"))
    codes = N.fit(vectors)
    if codes is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    stored = Stage(spark, "codes").table(N.encode(vectors, codes))
    questions = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return N.neighbours(stored, vectors, questions, codes)


_HYBRID_SQL = f"""WITH {DOC_UNITS},
t AS (SELECT *, {tok('content')} AS tc, {tok('name')} AS tn, {tok('qualified_name')} AS tq,
        {tok('signature')} AS ts, {tok('docstring')} AS td, sha256(content) AS h FROM doc_units),
q AS (SELECT unnest(['function', 'the', 'and']) AS w),
tf AS (SELECT id, w, 5.0 * len(list_filter(tc, lambda x: x = w)) + 4.0 * len(list_filter(tn, lambda x: x = w))
        + 3.0 * len(list_filter(tq, lambda x: x = w)) + 2.0 * len(list_filter(ts, lambda x: x = w))
        + 1.0 * len(list_filter(td, lambda x: x = w)) AS n FROM t, q),
idf AS (SELECT w, CASE WHEN count(*) FILTER (n > 0) = 0 THEN 0 ELSE ln(1 + count(*)::DOUBLE / count(*) FILTER (n > 0)) END AS f FROM tf GROUP BY w),
kw AS (SELECT id, sum(n * f)::DOUBLE AS k FROM tf JOIN idf USING (w) GROUP BY id),
sem AS (SELECT id, list_cosine_similarity({mock_vector('h', HYBRID_DIMS)}, (SELECT {mock_vector("sha256('" + HYBRID_TEXT + "')", HYBRID_DIMS)})) AS c FROM t),
b AS (SELECT d.id, d.name, d.code_type, 0.5 * (k / (k + 1)) + 0.5 * ((c + 1) / 2) AS base FROM doc_units d JOIN kw USING (id) JOIN sem USING (id)),
s AS (SELECT *, base * CASE WHEN code_type IN ('function', 'method') THEN 1.3 ELSE 1.0 END AS score FROM b)
SELECT id, name, code_type, round(base, 6) AS base_score, round(score, 6) AS score FROM s WHERE score >= 0.3
ORDER BY s.score DESC, id LIMIT 20"""


def _hybrid(spark, sf, index=False):
    embedder = MockEmbedder(HYBRID_DIMS)
    docs = D.document_units(spark, sf).withColumn("embedding", embedder.column(F.col("content")))
    q = SearchQuery(HYBRID_TEXT, "hybrid", limit=20, min_score=0.3, highlight=False)
    vector = embedder.query(q.text)
    if index:
        hits = S.routed_search(docs, q, vector, index=_stored(spark, sf, S.query_tokens(q.text)))
    else:
        hits = S.search(docs, q, vector)
    return hits.select(
        "id", "name", "code_type", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score")
    )


@query("hybrid_search", "R1 R4 R5 R6 P3 F10 T27", _HYBRID_SQL)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)


@query("hybrid_search_indexed", "R4 R9 S26", _HYBRID_SQL)
def hybrid_search_indexed(spark, sf):
    return _hybrid(spark, sf, index=True)


@query(
    "rerank_boost", "R6",
    f"""WITH {SYMBOLS}, b AS (SELECT id, line_start / 10.0::DOUBLE AS base_score,
      (line_start / 10.0::DOUBLE) * (CASE WHEN lower(name) IN ('small', 'red_ring', 'class', 'promo') THEN 2.0 ELSE 1.0 END) *
      (CASE WHEN contains(lower(qualified_name), 'red_ring') THEN 1.5 ELSE 1.0 END) AS score FROM symbols)
    SELECT id, round(base_score, 6) AS base_score, round(score, 6) AS score FROM b""",
)
def rerank_boost(spark, sf):
    hits = D.part_symbols(spark, sf).withColumn("score", F.col("line_start") / 10.0)
    out = S.reranked(hits, SearchQuery("red_ring", "hybrid"))
    return out.select("id", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


@query(
    "fuzzy_search", "R7 R19 F4 F5",
    f"""WITH {SYMBOLS}, t AS (SELECT *, {tok('name')} AS tn, {tok('qualified_name')} AS tq,
        {tok("string_split(file_path, '/')[-1]")} AS tf FROM symbols),
    b AS (SELECT *, (SELECT max(CASE WHEN contains('widgt', x) OR contains(x, 'widgt') THEN 1.0 WHEN x = 'widget' THEN 10.0 / 11 ELSE 0 END) FROM (SELECT unnest(tn) AS x)) AS n1,
      (SELECT max(CASE WHEN contains('red', x) OR contains(x, 'red') THEN 1.0 ELSE 0 END) FROM (SELECT unnest(tn) AS x)) AS n2,
      (SELECT max(CASE WHEN contains('widgt', x) OR contains(x, 'widgt') THEN 1.0 WHEN x = 'widget' THEN 10.0 / 11 ELSE 0 END) FROM (SELECT unnest(tq) AS x)) AS q1,
      (SELECT max(CASE WHEN contains('red', x) OR contains(x, 'red') THEN 1.0 ELSE 0 END) FROM (SELECT unnest(tq) AS x)) AS q2,
      (SELECT max(CASE WHEN contains('widgt', x) OR contains(x, 'widgt') THEN 1.0 WHEN x = 'widget' THEN 10.0 / 11 ELSE 0 END) FROM (SELECT unnest(tf) AS x)) AS f1,
      (SELECT max(CASE WHEN contains('red', x) OR contains(x, 'red') THEN 1.0 ELSE 0 END) FROM (SELECT unnest(tf) AS x)) AS f2
      FROM t)
    SELECT id, name, round(8.0 * (n1 + n2) + 4.0 * (q1 + q2) + 2.0 * (f1 + f2), 2)::DOUBLE AS score FROM b
    WHERE n1 + n2 + q1 + q2 + f1 + f2 > 0 ORDER BY score DESC, id LIMIT 100""",
)
def fuzzy_search(spark, sf):
    hits = S.fuzzy_search(D.part_symbols(spark, sf), "red_widgt", 100)
    return hits.select("id", "name", "score")


@query(
    "top3_per_group", "A20",
    """WITH h AS (SELECT 'order:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id,
        l_suppkey AS file, l_extendedprice AS score FROM lineitem WHERE l_returnflag <> 'R')
    SELECT id, file, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 3""",
)
def top3_per_group(spark, sf):
    return S.top_per_group(_line_hits(spark, sf).filter("l_returnflag <> 'R'"), "file", 3).select(
        "id", "file", "score", "rank"
    )


def _line_hits(spark, sf):
    li = D.table(spark, sf, "lineitem")
    key = F.concat_ws(":", F.lit("order"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        key.alias("id"), F.col("l_suppkey").alias("file"), F.col("l_extendedprice").alias("score"), "l_returnflag",
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"),
    )


@query(
    "dedup_hits", "U7",
    """SELECT CAST(l_partkey AS VARCHAR) AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1""",
)
def dedup_hits(spark, sf):
    hits = _line_hits(spark, sf).select(
        F.col("part").cast("string").alias("id"), "score", F.col("file").cast("string").alias("file_path")
    )
    return S.best_hits(hits).select("id", "score")


@query(
    "topk_scores", "R17",
    """SELECT 'order:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, l_extendedprice AS score
    FROM lineitem ORDER BY score DESC, id LIMIT 100""",
)
def topk_scores(spark, sf):
    return _line_hits(spark, sf).select("id", "score").orderBy(F.desc("score"), "id").limit(100)


@query(
    "filter_sort_top100", "R18",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS score FROM orders
    WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY score DESC, id LIMIT 100""",
)
def filter_sort_top100(spark, sf):
    o = D.table(spark, sf, "orders").filter("o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(100)


@query(
    "min_score_hits", "P3 G2",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_retailprice AS score FROM part WHERE p_retailprice >= 910""",
)
def min_score_hits(spark, sf):
    p = D.table(spark, sf, "part")
    return S.above(p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("score")), 910)


@query(
    "highlight", "F27",
    r"""SELECT doc_id, md5(regexp_replace(text, '(nation|the)', '<mark>\1</mark>', 'gi')) AS marked,
    CAST(len(regexp_extract_all(text, '(nation|the)', 0, 'i')) AS BIGINT) AS hits FROM documents""",
)
def highlight(spark, sf):
    d = D.documents(spark, sf)
    marked = T.highlighted(F.col("text"), ["the", "nation"])
    return d.select("doc_id", F.md5(marked).alias("marked"), F.regexp_count(marked, F.lit("<mark>")).cast("bigint").alias("hits"))
