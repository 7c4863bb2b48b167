"""Frequent phrases and their cohesion, mined shard by shard (SON) and counted exactly afterwards.

The rows are dealt into ``shards`` by the file block they lie in; a shard is a fixed share of the data, whatever its size, and is mined by many
tasks together. A phrase that reaches the support in all data reaches the proportional share of it in one shard at least (by words of its
language), so mining every shard completely at that lower support finds every frequent phrase:

1. Words are counted; phrases with a word below the support cannot be frequent.
2. Every shard's word pairs are counted and those that reach the shard's support are kept.
3. Every shard's phrases of three words and more, all of whose pairs are frequent in that shard, are counted and held to its support too.
   After steps 2 and 3, phrases go that cannot reach the support in all data: in a shard whose share of it they miss they come
   once less than that share at most, so what they have beyond the shares elsewhere must make up for all that is missing.
4. The union of what is left is counted over all shards, by language and text: only these counts, which are exact, decide.

Tasks count before they send, a million words at a time. What passes from one step to the next is a Bloom filter of at most 2**27 bits (16 MB),
whatever the data; a wrong yes costs a row that the next count drops, and nothing is lost. Counting keys are 64-bit hashes; two phrases of one key
are only counted together in steps 1 to 3, which can only let more pass.

A phrase lies within a piece of text (pieces end at . , ; : ! ? and at line breaks); words are anything between blanks and tabs, A-Z in lower case. A phrase's score is
that of its weakest cut into two parts, floor(1000 * a * n / (l * r)) in exact decimals. Phrases inside a longer one of as many occurrences are left out.

Null texts count as empty, null languages as ``und``; null ids and repeated rows count like others; ties of scores go to the more frequent and then
to the smaller phrase; empty tables give an empty result. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.staging import Stage

#: Words counted together in a task.
UNIT = 1 << 20
#: Rows sent on together.
SENT = 1 << 15
PIECE = np.zeros(256, dtype=bool)
PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shards fit into the low bits of a row's code, the local support into the next, what must be had beyond it into the rest.
SHARD_BITS, NEED_BITS = 6, 26
MAX_BITS = 27


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to ``longest`` words seen ``support`` times; one goes if a longer one has ``percent`` % of its occurrences; first ``top`` a language."""

    support: int = 100
    longest: int = 5
    percent: int = 100
    top: int = 2000
    shards: int = 24

    def __post_init__(self):
        if not 0 < self.shards <= 1 << SHARD_BITS or self.longest < 2 or not 0 < self.support < 1 << NEED_BITS:
            raise ValueError("1 to 64 shards, phrases of two words at least, a positive support below 2**26")


def shard_salt(shard: np.ndarray | int) -> np.ndarray:
    return A.mix(np.atleast_1d(shard).astype(np.uint64) + np.uint64(77))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Filter:
    """Bloom filter with two places a key."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for place in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def of(keys: DataFrame, rows: int) -> Broadcast:
        """Filter of the column ``key``, sized by its number of rows up to the bound, sent to all tasks."""
        bits = 1 << min(max((16 * rows).bit_length(), 10), MAX_BITS)
        places = F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1)
        first, second = (keys.select(p.alias("place")) for p in places)
        at = first.unionByName(second)
        one = F.expr("shiftleft(1L, cast(place & 63L as int))")
        table = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        return keys.sparkSession.sparkContext.broadcast(words)


@dataclass
class Unit:
    """Some rows' words: hash, whether a piece starts, code and language of the row, place in ``data``."""

    word: np.ndarray
    new: np.ndarray
    code: np.ndarray
    lang_key: np.ndarray
    lang: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: the keys of all places (with language), and which places begin a phrase."""
        n = len(self.word)
        sums, ok, base = self.word.copy(), np.ones(n, dtype=bool), self.lang_key * _ODD
        for m in range(1, longest + 1):
            if m > 1:
                room = max(n - m + 1, 0)
                sums *= np.uint64(0x2545F4914F6CDD1D)
                sums[:room] += self.word[m - 1 :]
                ok[:room] &= ~self.new[m - 1 :]
                ok[room:] = False
            yield m, A.mix(sums + base + np.uint64(m)), ok.copy()

    @property
    def shard(self) -> np.ndarray:
        return self.code & ((1 << SHARD_BITS) - 1)

    def texts(self, at: np.ndarray, m: int) -> pa.Array:
        """The phrases of ``m`` words that begin at these words, joined by blanks."""
        w = (at[:, None] + np.arange(m)).ravel()
        size = self.ends[w] - self.starts[w]
        step = size + 1
        step[m - 1 :: m] -= 1
        begin = np.cumsum(step) - step
        total = int(step.sum())
        out = np.full(total, 32, dtype=np.uint8)
        source = np.repeat(self.starts[w] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        target = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(source))
        out[target] = self.data[source]
        offsets = np.append(begin[::m], total).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit, list[str]]]:
    """Words of text, lang, shard, need, a million or more at a time, and the names of the languages met so far."""
    held, size, names, number = [], 0, [], {}

    def unit() -> Unit:
        base = np.cumsum([0, *(len(h[-1]) for h in held[:-1])])
        for h, b in zip(held, base.tolist()):
            h[5], h[6] = h[5] + b, h[6] + b
        columns = [list(c) for c in zip(*held)]
        # the parts go as they are joined: they would else lie beside the unit for as long as it is worked on
        held.clear()
        return Unit(*(np.concatenate(columns.pop(0)) for _ in range(len(columns))))

    for batch in batches:
        langs = batch.column(1)
        lang_keys = A.whole(langs.cast(pa.large_string()))
        lang_keys = lang_keys.hashes(lang_keys.offsets[:-1], lang_keys.offsets[1:])
        codes = []
        for name in langs.to_pylist():
            if name not in number:
                number[name] = len(names)
                names.append(name)
            codes.append(number[name])
        codes = np.array(codes, dtype=np.int32)
        row_code = batch.column(2).to_numpy().astype(np.int64) | (batch.column(3).to_numpy().astype(np.int64) << SHARD_BITS)
        for chunk in A.chunks(A.text_column(batch)):
            upper = (chunk.data >= 65) & (chunk.data <= 90)
            own = A.Chunk(chunk.lo, chunk.hi, np.where(upper, chunk.data + np.uint8(32), chunk.data), chunk.offsets)
            cut = PIECE[own.data]
            starts, ends = A.runs(~(cut | BLANK[own.data]), own.offsets)
            if not len(starts):
                continue
            cuts = np.append(0, np.cumsum(cut))
            row = own.row_of(starts)
            new = np.append(True, (cuts[starts[1:]] != cuts[ends[:-1]]) | (row[1:] != row[:-1]))
            at = row + chunk.lo
            held.append([own.hashes(starts, ends), new, row_code[at], lang_keys[at], codes[at], starts, ends, own.data])
            size += len(starts)
            if size >= UNIT:
                size = 0
                yield unit(), names
    if held:
        yield unit(), names


def _each_unit(batches: Iterator[pa.RecordBatch], rows: Callable[[Unit, list[str]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The rows of every unit, in small batches. No name outlives its unit, so that one is gone before the words of the next are gathered."""

    def sent(own: tuple[Unit, list[str]]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(i, SENT) for batch in rows(*own) for i in range(0, batch.num_rows, SENT))

    return chain.from_iterable(map(sent, _units(batches)))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is met first, and how often."""
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    return first, n


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, tag, n: words; with a tag, words of a language (tag) in a shard (key)."""

    def rows(unit: Unit, names: list[str]) -> Iterator[pa.RecordBatch]:
        _, keys, _ = next(unit.grams(1))
        first, n = _counted(keys)
        both, m = np.unique(unit.lang.astype(np.int64) << SHARD_BITS | unit.shard, return_counts=True)
        tags = [None] * len(first) + [names[i] for i in (both >> SHARD_BITS).tolist()]
        key = np.append(keys[first].view(np.int64), both & ((1 << SHARD_BITS) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tags, pa.string()), pa.array(np.append(n, m))], ["key", "tag", "n"])

    return _each_unit(batches, rows)


def _local_rows(unit: Unit, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    first, n = _counted(keys[at] ^ shard_salt(unit.shard[at]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[at[first]].view(np.int64)), pa.array(unit.code[at[first]]), pa.array(n)], ["key", "code", "n"]
    )


def _pair_rows(words: Broadcast):
    """key, code, n: pairs of frequent words in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Filter(words.value)

        def rows(unit: Unit, _: list[str]) -> Iterator[pa.RecordBatch]:
            (_, single, _), (_, pair, ok) = unit.grams(2)
            known = frequent.has(single)
            ok[:-1] &= known[:-1] & known[1:]
            yield _local_rows(unit, pair, np.flatnonzero(ok))

        return _each_unit(batches, rows)

    return run


def _longer_rows(pairs: Broadcast, longest: int):
    """key, code, n: longer phrases of pairs that are frequent in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Filter(pairs.value)

        def rows(unit: Unit, _: list[str]) -> Iterator[pa.RecordBatch]:
            known = None
            for m, keys, ok in unit.grams(longest):
                if m == 2:
                    known = first_pair = ok & frequent.has(keys ^ shard_salt(unit.shard))
                elif m > 2:
                    # the last pair of the phrase
                    last = np.zeros(len(ok), dtype=bool)
                    last[: max(len(ok) - m + 2, 0)] = first_pair[m - 2 :]
                    known = known & last
                    yield _local_rows(unit, keys, np.flatnonzero(ok & known))

        return _each_unit(batches, rows)

    return run


def _phrase_rows(words: Broadcast, phrases: Broadcast, longest: int):
    """lang, phrase, n: frequent words and candidates, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, several = Filter(words.value), Filter(phrases.value)

        def rows(unit: Unit, names: list[str]) -> Iterator[pa.RecordBatch]:
            for m, keys, ok in unit.grams(longest):
                at = np.flatnonzero(ok)
                at = at[(single if m == 1 else several).has(keys[at])]
                first, n = _counted(keys[at])
                for i in range(0, len(first), SENT):
                    own = at[first[i : i + SENT]]
                    lang = pa.DictionaryArray.from_arrays(pa.array(unit.lang[own]), pa.array(names, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang, unit.texts(own, m), pa.array(n[i : i + SENT])], ["lang", "phrase", "n"])

        return _each_unit(batches, rows)

    return run


def counts(docs: DataFrame, s: Settings = Settings(), shard: Column | None = None, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all words and phrases of up to ``longest`` words that come ``support`` times, and (lang, n) of the words of all
    languages. ``shard``: the shard of a row, 0 to ``shards`` - 1; by its file block where none is given."""
    stage = stage or Stage(docs.sparkSession, "phrase-counts")
    if shard is None:
        shard = F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(s.shards))
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"), shard.cast("int").alias("shard"))
    plain = texts.withColumn("need", F.lit(0))
    counted = plain.mapInArrow(_word_rows, "key long, tag string, n long").groupBy("tag", "key").agg(F.sum("n").alias("n"))
    counted, seen = stage.put(counted.filter((F.col("n") >= s.support) | F.col("tag").isNotNull()), words=F.count_if(F.col("tag").isNull()))
    words = Filter.of(counted.filter("tag is null").select("key"), seen["words"])
    by_shard = counted.filter("tag is not null").select(F.col("tag").alias("lang"), F.col("key").cast("int").alias("shard"), "n")
    totals = stage.table(by_shard.groupBy("lang").agg(F.sum("n").alias("n")))
    share = by_shard.join(totals.withColumnRenamed("n", "all"), "lang")
    needs = share.select("lang", "shard", F.expr(f"({s.support} * n + all - 1) div all").alias("need"))
    # a phrase that just misses every share lacks this much of the support
    lacks = needs.groupBy("lang").agg((s.support - F.sum(F.col("need") - 1)).alias("lack"))
    code_of = F.col("need").bitwiseOR(F.shiftleft("lack", NEED_BITS))
    needs = stage.table(needs.join(lacks, "lang").select("lang", "shard", code_of.alias("need")))
    dealt = texts.join(needs, ["lang", "shard"]).select("text", "lang", "shard", "need")

    def local(rows: DataFrame) -> tuple[DataFrame, dict]:
        need = F.shiftright("code", SHARD_BITS).bitwiseAND((1 << NEED_BITS) - 1)
        sums = rows.groupBy("key", "code").agg(F.sum("n").alias("n")).filter(F.col("n") >= need)
        over, lack = F.sum(F.col("n") - need + 1), F.min(F.shiftright("code", SHARD_BITS + NEED_BITS))
        able = sums.groupBy("key").agg(over.alias("over"), lack.alias("lack"), F.collect_list("code").alias("codes")).filter("over >= lack")
        return stage.put(able.select("key", F.explode("codes").alias("code")))

    kind = "key long, code long, n long"
    pairs, n_pairs = local(dealt.mapInArrow(_pair_rows(words), kind))
    salts = F.array(*(F.lit(_signed(int(shard_salt(i)[0]))) for i in range(1 << SHARD_BITS)))
    salted = F.col("key").bitwiseXOR(F.element_at(salts, (F.col("code").bitwiseAND((1 << SHARD_BITS) - 1) + 1).cast("int")))
    phrases, n_phrases = pairs, n_pairs["rows"]
    if s.longest > 2:
        in_shard = Filter.of(pairs.select(salted.alias("key")), n_pairs["rows"])
        longer, n_longer = local(dealt.mapInArrow(_longer_rows(in_shard, s.longest), kind))
        phrases, n_phrases = pairs.unionByName(longer), n_phrases + n_longer["rows"]
    candidates = Filter.of(phrases.select("key"), n_phrases)
    exact = plain.mapInArrow(_phrase_rows(words, candidates, s.longest), "lang string, phrase string, n long")
    exact = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= s.support)
    return stage.table(exact.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("m"), "f")), totals


def collocations(docs: DataFrame, s: Settings = Settings(), shard: Column | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of ``docs`` (text, lang)."""
    stage = Stage(docs.sparkSession, "collocations")
    found, totals = counts(docs, s, shard, stage)
    several = found.filter("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def joined(begin: str, size: str) -> Column:
        return F.array_join(F.expr(f"slice(words, {begin}, {size})"), " ")

    inner = several.filter("m > 2").select("lang", "words", "a", F.explode(F.expr("sequence(2, m - 1)")).alias("size"), "m")
    inner = inner.select("lang", "words", "a", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("begin"))
    inside = inner.select("lang", joined("begin", "size").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * s.percent)
    )
    cuts = kept.select("lang", "phrase", "a", "words", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    # written first: the frequent words are in many cuts, and a join of plain scans is one whose skewed partitions Spark can split
    cuts = stage.table(cuts.select("lang", "phrase", "a", "k", joined("1", "k").alias("first"), joined("k + 1", "m - k").alias("rest")))
    parts = found.select("lang", "phrase", "f")
    left, right = (parts.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    valued = stage.table(cuts.join(left, ["lang", "first"])).join(right, ["lang", "rest"]).join(totals, "lang")
    a, n, l, r = (F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r"))
    valued = valued.withColumn("top", a * n * 1000).withColumn("bottom", l * r).withColumn("score", F.expr("top div bottom"))
    weakest = valued.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
