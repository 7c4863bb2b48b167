"""A positional word index at a path (inventory R2, R12, S26): postings with positions, the dictionary of terms, prefixes and near terms.

Four tables, each laid out for its question, which therefore reads a few files only:

* ``postings``: term, id, field, positions, length; in ``parts`` folders by a hash of the term, each in ``spread`` files by a hash of the id, so
  that a frequent word is neither one task nor one file;
* ``terms``: term, documents, occurrences; sorted and dealt out by ranges of the term, so that a prefix is a range of keys that prunes files;
* ``prefixes``: the first terms of every short prefix, best first;
* ``near``: segment, term: the parts of a term, by its length and their number; one part more than a near word may have edits, so that it holds
  a part unchanged, moved by as many letters at most. Near terms are found by key, without comparing the question with every term; the few
  words of a question have the many keys, a term has three at most.

The index is written once, by ``write``; ``current`` keeps one for each state of the source files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.functions import text as T
from codegrove.sources.graph_store import _fs, delete_path
from codegrove.staging import checkpoint_root

#: Letters of a term whose deletions ``variants`` lists: enough for any term, as words within t edits have beginnings that share what t deletions leave.
HEAD = 12
#: Prefixes of up to so many letters have a list of their first terms, of this length.
SHORT, LISTED = 3, 50
#: A word of so many letters may have one typing error, or two.
ONE_TYPO, TWO_TYPOS = 5, 9


def typo_budget(length: Column) -> Column:
    return F.when(length < ONE_TYPO, 0).when(length < TWO_TYPOS, 1).otherwise(2)


def less_one(words: Column) -> Column:
    """The words themselves and all that one deletion leaves of them."""

    def shorter(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word))
        cut = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
        return F.when(F.length(word) > 1, F.concat(F.array(word), cut)).otherwise(F.array(word))

    return F.array_distinct(F.flatten(F.transform(words, shorter)))


def variants(word: Column, deletions: Column) -> Column:
    """Keys of a word under which words within ``deletions`` edits are found; up to 79, so the index stores ``segments`` instead."""
    head = F.array(F.substring(word, 1, HEAD))
    return F.when(deletions == 0, head).when(deletions == 1, less_one(head)).otherwise(less_one(less_one(head)))


def _segments(length: int) -> list[tuple[int, int]]:
    """Borders of the parts of a term of so many letters: a part more than the edits of the words that may ask for it."""
    n = 1 if length < ONE_TYPO - 1 else 2 if length < TWO_TYPOS - 2 else 3
    return [(i * length // n, (i + 1) * length // n) for i in range(n)]


def segments(term: Column) -> Column:
    """Keys of a term: its length, and number and letters of each part."""
    size = F.length(term)
    n = F.when(size < ONE_TYPO - 1, 1).when(size < TWO_TYPOS - 2, 2).otherwise(3)

    def border(i: Column) -> Column:
        return F.floor(i * size / n).cast("int")

    def key(i: Column) -> Column:
        return F.concat_ws(":", size, i, F.substring(term, border(i) + 1, border(i + 1) - border(i)))

    return F.transform(F.sequence(F.lit(0), n - 1), key)


def asked_segments(word: str, edits: int) -> set[str]:
    """All keys under which a term within ``edits`` edits of a word has a part unchanged."""
    found = set()
    for size in range(max(1, len(word) - edits), len(word) + edits + 1):
        for i, (a, b) in enumerate(_segments(size)):
            starts = range(max(0, a - edits), min(a + edits, len(word) - (b - a)) + 1)
            found.update(f"{size}:{i}:{word[at : at + b - a]}" for at in starts)
    return found


#: Words of which a task works out the postings at once.
_AT_ONCE = 1_000_000


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, field, positions, length from (id, field, words of the field)."""
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _AT_ONCE, "right")) - 1)
            rows = batch.slice(lo, hi - lo)
            lo = hi
            size = np.diff(rows.column(2).offsets.to_numpy())
            words = rows.column(2).flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            code = row * np.int64(len(words.dictionary)) + words.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            at = order[head]
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            of = pa.array(row[at])
            terms = words.dictionary.take(words.indices.take(pa.array(at)))
            length = pa.array(size[row[at]].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [terms, rows.column(0).take(of), rows.column(1).take(of), lists, length], ["term", "id", "field", "positions", "length"]
            )


def positional_postings(documents: DataFrame, fields: list[str]) -> DataFrame:
    """term, id, field, positions (from 0, ascending), length (words of the field); a field of a row gives a row for each of its words, so rows of
    one id are not put together. Nothing is shuffled."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])
    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", F.inline(lists)).mapInArrow(
        _postings_of, f"term string, id {kind}, field string, positions array<int>, length int"
    )


class WordIndex:
    """Index of documents (id and text fields) at a path."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def write(self, documents: DataFrame, fields: list[str], spread: int = 4) -> None:
        rows = positional_postings(documents, fields).withColumn("part", self._part(F.col("term")))
        # one shuffle and one sort: rows of an id meet where they are written
        key = ["part", "deal", "term", "id"]
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(spread))).repartition("part", "deal")
        same = Window.partitionBy(*key, "field", "length")
        merged = (
            dealt.withColumn("nth", F.row_number().over(same.orderBy("length"))).withColumn("all", F.collect_list("positions").over(same))
            .withColumn("head", (F.row_number().over(Window.partitionBy(*key).orderBy("field", "length")) == 1).cast("int"))
            .filter(F.col("nth") == 1)
        )
        positions = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sort_array(F.flatten("all")))
        merged = merged.select("term", "id", "field", positions.alias("positions"), "length", "head", "part")
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings")
        # the first row of a term and an id counts the document
        terms = self._read("postings").groupBy("term").agg(F.sum("head").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms")
        terms = self._read("terms")
        begins = terms.select("term", "documents", F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(SHORT)))).alias("n"))
        begins = begins.select(F.expr("substring(term, 1, n)").alias("prefix"), "term", "documents")
        order = Window.partitionBy("prefix").orderBy(F.desc("documents"), "term")
        first = begins.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LISTED)
        first.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank").write.mode("overwrite").parquet(f"{self.path}/prefixes")
        keys = terms.select("term", F.explode(segments(F.col("term"))).alias("segment")).withColumn("part", self._part(F.col("segment")))
        keys.repartition("part").sortWithinPartitions("part", "segment").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/near")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of_parts(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows whose key is in ``keys``, from the folders of these keys only. ``keys``: bounded by the question's words."""
        numbers = sorted({r.p for r in keys.select(self._part(F.col(key)).alias("p")).distinct().collect()})
        return self._read(name).filter(F.col("part").isin(*numbers)).join(F.broadcast(keys), key)

    def postings(self, terms: list[str]) -> DataFrame:
        """term, id, field, positions, length of exactly these terms."""
        numbers = sorted({r.p for r in self._words(terms).select(self._part(F.col("word")).alias("p")).collect()})
        rows = self._read("postings").filter(F.col("part").isin(*numbers) & F.col("term").isin(*terms))
        return rows.select("term", "id", "field", "positions", "length")

    def _words(self, words: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, nth int")

    def near_terms(self, words: list[str]) -> DataFrame:
        """word, nth, term, edits: the terms within each word's typing errors, itself included (0 edits)."""
        budget = [0 if len(w) < ONE_TYPO else 1 if len(w) < TWO_TYPOS else 2 for w in words]
        rows = [(w, i, most, key) for i, (w, most) in enumerate(zip(words, budget)) for key in sorted(asked_segments(w, most))]
        asked = self.spark.createDataFrame(rows, "word string, nth int, most int, segment string")
        pairs = self._of_parts("near", asked, "segment").select("word", "nth", "most", "term").distinct()
        edits = F.levenshtein("word", "term")
        return pairs.filter(edits <= F.col("most")).select("word", "nth", "term", edits.alias("edits"))

    def matching(self, words: list[str], typos: bool = True) -> DataFrame:
        """nth, edits, term, id, field, positions, length: postings of the question's words, with typing errors if asked."""
        if not typos:
            return self.postings(words).join(F.broadcast(self._words(words)), F.col("term") == F.col("word")).drop("word").withColumn("edits", F.lit(0))
        near = self.near_terms(words)
        # the terms near a word are few, and known by name before postings are read: their number is checked, not assumed
        named = [r.term for r in near.select("term").distinct().limit(2001).collect()]
        if len(named) <= 2000:
            return self.postings(named).join(near, "term").drop("word")
        return self._read("postings").join(near, "term").drop("word", "part", "head")

    def terms_from(self, prefix: str) -> DataFrame:
        """term, documents, occurrences of the terms that begin with ``prefix``: one range of keys."""
        found = self._read("terms").filter(F.col("term") >= prefix)
        if prefix:
            # the first string after all that begin with the prefix
            found = found.filter(F.col("term") < prefix[:-1] + chr(ord(prefix[-1]) + 1))
        return found

    def suggestions(self, prefix: str, limit: int = 10) -> DataFrame:
        """term, documents of the most frequent terms that begin with ``prefix``; from the stored lists where these are long enough."""
        if 0 < len(prefix) <= SHORT and limit <= LISTED:
            found = self._read("prefixes").filter(F.col("prefix") == prefix)
        else:
            found = self.terms_from(prefix)
        return found.select("term", "documents").orderBy(F.desc("documents"), "term").limit(limit)


def current(spark: SparkSession, label: str, sources: list[str], build: Callable[[str], None]) -> str:
    """Folder of what ``build(path)`` writes from these source folders or files, built once for each state of them.

    The state is the names, sizes and times of the files. A build is complete when its folder has its final name.
    """
    state = hashlib.sha256()
    for source in sources:
        fs, path = _fs(spark, source)
        if fs.getFileStatus(path).isDirectory():
            found = list(fs.listStatus(path))
        else:
            found = [fs.getFileStatus(path)]
        for s in sorted(found, key=lambda s: s.getPath().toString()):
            state.update(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}\n".encode())
    root = f"{checkpoint_root(spark)}/codegrove/built"
    final = f"{root}/{label}-{state.hexdigest()[:24]}"
    fs, target = _fs(spark, final)
    if not fs.exists(target):
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        build(draft)
        _, made = _fs(spark, draft)
        if not fs.exists(target):
            fs.rename(made, target)
        # another session may have been faster, and a rename into an existing folder must not stay
        for extra in (draft, f"{final}/{draft.rpartition('/')[2]}"):
            delete_path(spark, extra)
    return final
