"""Near-duplicate documents by BagMinHash of word shingles.

A document is a bag of five-word shingles; a shingle that occurs w times has weight w. Similarity is the weighted Jaccard index: the sum
of smaller counts over the sum of larger ones.

For the signature, the weight axis is cut into whole steps, and into blocks that double in length: (0,1], (1,2], (2,4], (4,8] and so on.
Every shingle has a Poisson process of points in time on each block, of a rate equal to the block's length, so a large weight costs
only a few processes. Each point falls, by halving its block again and again, on one step of weight, and on one of ``size``
components; it counts if the step is within the shingle's weight. A component's value is its first point. Two documents agree in a component with a
probability equal to their weighted Jaccard index, as all points of the union are equally likely to be first.

Points are drawn in order of time, up to the time at which a bag of the document's total weight has filled all components almost surely; a
document that has not is drawn again for longer. So a document costs about ``size * (ln size + 6)`` points, however long it is.

Components are banded; what shares a band is verified by exact overlap of the bags (``neighbours``).

Defined results: words are runs of anything but ASCII white space, in lower case. A text of one to four words is one shingle. Null, empty and
blank texts are alone in their class. Exact copies are one text from the start, so groups of copies cost one row per task. A class is named by
its least doc_id; repeated rows are of one class. Rows with a null id get the class of their text. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.llm import neighbours
from codegrove.staging import Stage


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    band: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.band


def bags(chunk: A.Chunk, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of all distinct shingles of each row, ordered by row and shingle."""
    starts, ends = chunk.words()
    found, own = A.shingles(chunk.hashes(starts, ends), chunk.counts(starts), words)
    row = np.repeat(np.arange(chunk.rows), own)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (found[1:] != found[:-1]))) if len(row) else np.zeros(0, dtype=int)
    return row[first], found[first], np.diff(np.append(first, len(row)))


def _processes(shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, block number, block start, block length) of the blocks that reach into each element's weight."""
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(weight)), levels)
    block = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    return element, block, start, np.maximum(start, 1)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """rows x size identities of the first points; rows without a shingle are zero."""
    out = np.zeros((rows, size), dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    open_rows = total > 0
    # a component is empty at time t with probability exp(-t * total / size)
    limit = size * (math.log(size) + 6) / np.maximum(total, 1)
    while open_rows.any():
        use = open_rows[row]
        drawn = _first_points(row[use], shingle[use], weight[use], rows, size, limit)
        full = open_rows & (drawn != 0).all(1)
        out[full] = drawn[full]
        open_rows &= ~full
        limit = limit * 2
    return out


def _first_points(row, shingle, weight, rows, size, limit) -> np.ndarray:
    element, block, start, length = _processes(shingle, weight)
    of, most = row[element], weight[element]
    seed = A.mix(shingle[element] + block.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    time = np.zeros(len(seed))
    number = np.zeros(len(seed), dtype=np.uint64)
    cells, times, names = [], [], []
    step = 1
    while len(seed):
        # the next ``step`` points of every process that is not yet past its row's limit
        count = number[:, None] + np.arange(1, step + 1, dtype=np.uint64)
        drawn = A.mix(seed[:, None] ^ (count * np.uint64(0xD1342543DE82EF95)))
        at = time[:, None] - np.cumsum(np.log(A.unit(drawn)), axis=1) / length[:, None]
        place = A.mix(drawn + np.uint64(0x632BE59BD9B4E019))
        # halving the block by the leading bits of ``place`` ends at this step of weight
        level = start[:, None] + ((place >> np.uint64(40)).astype(np.int64) * length[:, None] >> 24) + 1
        inside = (at <= limit[of][:, None]) & (level <= most[:, None])
        r, c = np.nonzero(inside)
        component = (place[r, c] & np.uint64(0xFFFFFFFF)).astype(np.int64) * size >> 32
        cells.append(of[r] * size + component)
        times.append(at[r, c])
        names.append(drawn[r, c])
        live = at[:, -1] <= limit[of]
        seed, of, most, start, length = seed[live], of[live], most[live], start[live], length[live]
        time, number = at[live, -1], number[live] + np.uint64(step)
        step = min(64, step * 2) if len(seed) < 50_000 else step
    cell, time, name = np.concatenate(cells), np.concatenate(times), np.concatenate(names)
    order = np.lexsort((time, cell))
    cell, name = cell[order], name[order]
    first = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, dtype=bool)
    out = np.zeros(rows * size, dtype=np.uint64)
    out[cell[first]] = name[first] | np.uint64(1)
    return out.reshape(rows, size)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands hashes of the bands, each band with a name of its own."""
    rows, size = signature.shape
    parts = signature.reshape(rows, bands, size // bands)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), (rows, 1))
    for k in range(parts.shape[2]):
        out = A.mix(out ^ parts[:, :, k]) * np.uint64(0x2545F4914F6CDD1D)
    return out


def overlaps(left: pa.Array, right: pa.Array, words: int) -> np.ndarray:
    """Weighted Jaccard index of each pair of (lower-case) texts."""
    sides = []
    for texts in (left, right):
        # a run of equal texts, as a hub of many pairs gives, is read once
        coded = pc.dictionary_encode(texts)
        bag: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in A.chunks(coded.dictionary):
            row, shingle, count = bags(chunk, words)
            cuts = np.searchsorted(row, np.arange(chunk.rows + 1))
            bag += [(shingle[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]
        sides.append((np.asarray(coded.indices), bag))
    (li, lb), (ri, rb) = sides
    out = np.zeros(len(li))
    for i, (x, y) in enumerate(zip(li.tolist(), ri.tolist())):
        (a, n), (b, m) = lb[x], rb[y]
        if len(a) and len(b):
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = b[at] == a
            both = np.minimum(n[common], m[at[common]]).sum()
            out[i] = both / (n.sum() + m.sum() - both)
    return out


def text_key(column: str = "text"):
    """64-bit key of a text; equal texts have equal keys."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def _bucket_rows(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for chunk in A.chunks(A.text_column(batch, lower=True), A.CHUNK_BYTES):
                row, shingle, count = bags(chunk, s.words)
                bands = band_hashes(signatures(row, shingle, count, chunk.rows, s.size), s.bands)
                full = np.zeros(chunk.rows, dtype=bool)
                full[row] = True
                yield from neighbours.bucket_rows(keys[chunk.lo : chunk.hi][full].view(np.uint64), bands[full])

    return docs.select(text_key().alias("key"), "text").mapInArrow(run, neighbours.BUCKETS)


def near_classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``key`` (``text_key``), ``class_id`` (least doc_id), ``keeper_rows`` (rows of that id and text) for every text of ``docs``."""
    stage = Stage(docs.sparkSession, "bag-minhash")
    # one row a text: its least id, and how many rows have both
    ids = docs.select(text_key().alias("key"), "doc_id", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    per_id = ids.groupBy("key", "doc_id", "worded").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")).alias("first")
    texts = stage.table(per_id.groupBy("key", "worded").agg(first).select("key", "worded", "first"))

    def texts_of(keys: DataFrame, n: int) -> DataFrame:
        wanted = F.broadcast(keys) if n <= neighbours.SENT_KEYS else keys
        rows = docs.select(text_key().alias("key"), F.lower("text").alias("text"), "doc_id").join(wanted, "key", "left_semi")
        own = texts.select("key", F.col("first.doc_id").alias("id"))
        own = own.join(wanted, "key", "left_semi")
        return rows.join(own, "key").filter(F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text").dropDuplicates(["key"])

    def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
        return overlaps(left, right, s.words) >= s.similarity

    def counts(texts: pa.Array) -> np.ndarray:
        chunk = A.whole(texts)
        return neighbours.count_places(chunk.rows, *bags(chunk, s.words))

    roots = neighbours.classes(stage, _bucket_rows(docs, s), texts_of, similar, counts, s.similarity)
    # a text without words is its own class row by row, and is left out here
    rooted = texts.filter("worded").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first")
    heads = stage.table(rooted.groupBy("root").agg(F.min("first").alias("head")))
    rooted = stage.table(rooted)
    return rooted.join(heads, "root").select(
        "key", F.col("head.doc_id").alias("class_id"), (F.col("first") == F.col("head")).alias("keeps"), F.col("head.n").alias("keeper_rows")
    )


def classify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row of ``docs`` (doc_id, text)."""
    found = near_classes(docs, s).select("key", "class_id", F.lit(True).alias("known"))
    rows = docs.select("doc_id", text_key().alias("key")).join(found, "key", "left")
    return rows.select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class, the one of the least id; texts without words all stay."""
    columns = docs.columns
    key, owner, keeps, rows = (A.unused(columns, n) for n in ("near_key", "near_class", "near_keeps", "near_rows"))
    found = near_classes(docs, s).select(
        F.col("key").alias(key), F.col("class_id").alias(owner), F.col("keeps").alias(keeps), F.col("keeper_rows").alias(rows)
    )
    marked = docs.withColumn(key, text_key()).join(found, key, "left")
    stay = marked.filter(F.col(keeps).isNull() | (F.col(keeps) & F.col("doc_id").eqNullSafe(F.col(owner))))
    single = F.coalesce(rows, F.lit(1)) == 1
    # of rows repeated with id and text, one stays
    return stay.filter(single).select(*columns).unionByName(stay.filter(~single).dropDuplicates([key]).select(*columns))
