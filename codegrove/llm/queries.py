"""Registered queries of this folder: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.llm import bag_minhash, language_codes, line_dedup, packing, passage_chains, phrase_mining, prefix_bpe, quality_model, quality_rules, sampling, spelling_variants, suffix_buckets, topk_search, toxicity_crf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bag_minhash.classify(table(spark, sf_dir, "documents"))


@query
def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned outside the fold that is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = sampling.fold("doc_id", 5) != 0
    model = quality_model.train(docs.filter(learn), labels.filter(learn), "quality")
    return quality_model.score(docs, model).select(
        "doc_id", sampling.held_out("doc_id", 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay: numbers of lines, and the new text by length and digest."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_kept", F.length("text").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256")
    )


@query
def op4_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document, or an earlier place, has too."""
    return passage_chains.passages(table(spark, sf_dir, "documents")).drop("key")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in their sequences, with a checksum of the ids of each."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        packed = packing.pack(docs, file.read(), public_tokenizers.PATTERN)
    sums = packed.tokens.select("task", "row", F.crc32("ids").alias("ids_crc32"))
    return packed.pieces.join(sums, ["task", "row"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op5_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


@query
def op6_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    found = topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ORACLES["op6_columnar_topk"] = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
           CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query
def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of a decision list learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    import public_tokenizers

    ranks = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = prefix_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = prefix_bpe.decode(tokens, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the fold that is held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_codes.train(docs.filter(sampling.fold("doc_id", 4) != 2))
    return language_codes.predict(docs, model).select(
        "doc_id", sampling.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and toxic spans of every document; learned outside the fold that is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = sampling.fold("doc_id", 4) != 2
    model = toxicity_crf.train(docs.filter(learn), labels.filter(learn), "toxic")
    return toxicity_crf.tag(docs, model).select(
        "doc_id", sampling.held_out("doc_id", 4, 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "spans",
    )


@query
def op11_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start elsewhere too; digest of what is left."""
    cut = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_suffix_buckets"] = """
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, encode(coalesce(text, '')) AS bytes FROM documents
),
sizes AS (SELECT row_id, doc_id, hex(bytes) AS digits, CAST(octet_length(bytes) AS BIGINT) AS n_bytes FROM docs),
strings AS (
  SELECT row_id, p, md5_number(bytes[p + 1 : p + 200]) AS key
  FROM (SELECT row_id, bytes, unnest(range(octet_length(bytes) - 199)) AS p FROM docs WHERE octet_length(bytes) >= 200)
),
twice AS (SELECT key FROM strings GROUP BY key HAVING count(*) > 1),
hits AS (SELECT row_id, p, lag(p) OVER (PARTITION BY row_id ORDER BY p) AS before FROM strings SEMI JOIN twice USING (key)),
groups AS (
  SELECT row_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY p) AS g FROM hits
),
spans AS (SELECT row_id, g, min(p) AS lo, max(p) + 200 AS hi FROM groups GROUP BY row_id, g),
gaps AS (
  SELECT row_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row_id ORDER BY lo), 0) AS from_byte FROM spans
),
kept AS (
  SELECT g.row_id, count(*) AS n_spans, sum(g.hi - g.lo) AS n_removed, max(g.hi) AS last,
         string_agg(substr(s.digits, 2 * g.from_byte + 1, 2 * (g.lo - g.from_byte)), '' ORDER BY g.lo) AS head
  FROM gaps g JOIN sizes s USING (row_id) GROUP BY g.row_id
)
SELECT s.doc_id, s.n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.head, '') || substr(s.digits, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM sizes s LEFT JOIN kept k USING (row_id)
"""


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 most cohesive phrases of every language."""
    return phrase_mining.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op12_phrase_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS m),
f AS (
  SELECT lang, phrase, m, count(*) AS a
  FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
        FROM words, sizes WHERE len(w) >= m)
  GROUP BY lang, phrase, m HAVING count(*) >= 100
),
candidates AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT c.lang, c.a, unnest(list_transform(range(1, c.m - s.m + 2), lambda i: array_to_string(c.w[i : i + s.m - 1], ' '))) AS phrase
        FROM candidates c JOIN sizes s ON s.m > 1 AND s.m < c.m)
  GROUP BY lang, phrase
),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
),
cuts AS (
  SELECT lang, phrase, a, w, m, unnest(range(1, m)) AS k FROM kept
),
valued AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
         CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')
),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM valued),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its number of near words, its form and its root."""
    found = spelling_variants.words(table(spark, sf_dir, "documents"))
    return spelling_variants.variants(found).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op13_spelling_variants"] = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY run, coalesce(CAST(doc_id AS VARCHAR), '')
),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(1, strlen(named) + 1), lambda i: CAST('0x' || substr(hex(encode(named)), 2 * i - 1, 2) AS BIGINT))),
           lambda c, x: xor(crc[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) AS h
  FROM counted, bits
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
less AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
steps AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s USING (word) JOIN formed r ON s.root = r.word WHERE r.form IS NULL
"""
