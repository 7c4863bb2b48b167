"""Classes of similar texts from hashed buckets: candidates, exact verification and union-find, all as distributed tables.

A text is a 64-bit key (a hash of its normal form, so that equal texts are one key). Every text is in some buckets; texts that share one are
candidates. Buckets may be huge, so pairs are not simply formed:

1. Within a chunk of a task, a bucket of more than ``SMALL`` keys sends on only its first key, links of the others to it and to their
   neighbours, and the list of its keys as a "wide" bucket.
2. The rest is dealt out by bucket and sorted. Small buckets give all their pairs. Others give pairs with the first and the neighbouring keys,
   and are wide.
3. Pairs are verified exactly; verified links are joined by union-find.
4. Wide buckets whose keys are not all in one component meet again: with a few drawn keys at first, as these unite most of what belongs together, and
   finally every key outside the bucket's largest component with every key of another component. These meet in blocks: a task compares
   hashed counts of two blocks of texts, which bound their overlap from above, and gives only the pairs that can be similar. So no
   candidate pair of two components is left out, and pairs within a component, which can add nothing, are not formed.

Two different texts of one 64-bit key would pass as equal; among n texts that is expected n * n / 2**65 times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.staging import Stage

SMALL = 4
#: Kinds of rows: keys of wide buckets of a chunk come before those of small ones when sorted.
HOT, MEMBER, PAIR, WIDE = 0, 1, 2, 3
BUCKETS = "kind int, bucket long, a long, b long"
#: Key tables of at most this many rows (16 bytes each) are sent to all tasks; larger ones are joined by shuffle.
SENT_KEYS = 1_000_000

#: Places of the hashed counts, and keys in a block of a wide bucket.
PLACES, BLOCK = 512, 128
MANY = 65_535
#: Texts -> hashed counts of their features, texts x PLACES; the sums of the smaller counts bound the overlap of two texts.
Counts = Callable[[pa.Array], np.ndarray]
#: (texts of the left sides, texts of the right sides) -> which pairs are similar; runs inside tasks.
Similar = Callable[[pa.Array, pa.Array], np.ndarray]


def _batch(kind: int | np.ndarray, bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, dtype=np.int32), len(a))
    columns = [pa.array(np.ascontiguousarray(kinds)), *(pa.array(x.view(np.int64)) for x in (bucket, a, b))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "a", "b"])


def bucket_rows(keys: np.ndarray, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to be dealt out, from the keys of a chunk and their buckets (key x band)."""
    keys, first = np.unique(keys, return_index=True)
    bucket = buckets[first].ravel()
    key = np.repeat(keys, buckets.shape[1])
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    if not len(key):
        return
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(start, len(key)))
    nth = np.arange(len(key)) - np.repeat(start, size)
    wide = np.repeat(size > SMALL, size)
    sent = ~wide | (nth == 0)
    yield _batch(np.where(wide[sent], HOT, MEMBER), bucket[sent], key[sent], key[sent])
    if wide.any():
        yield _batch(WIDE, bucket[wide], key[wide], key[wide])
        a, b = _near_pairs(key, np.repeat(key[start], size), nth, wide)
        yield _batch(PAIR, a, a, b)


def _near_pairs(key: np.ndarray, rep: np.ndarray, nth: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with the first and the ``SMALL - 1`` keys before it in its run."""
    lefts, rights = [rep[of & (nth >= SMALL)]], [key[of & (nth >= SMALL)]]
    for back in range(1, SMALL):
        at = np.flatnonzero(of & (nth >= back))
        lefts.append(key[at - back])
        rights.append(key[at])
    a, b = np.concatenate(lefts), np.concatenate(rights)
    return np.minimum(a, b), np.maximum(a, b)


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and wide buckets from rows sorted by bucket, hot ones first, and key; a run may span batches.

    The end of the run in progress is carried into the next batch: its last keys, their places in the run, whether it is hot, its first key.
    """
    none = np.zeros(0, dtype=np.int64)
    bucket, key, nth, hot, rep = none, none, none, none.astype(bool), none
    for batch in batches:
        kind = batch.column(0).to_numpy()
        member = kind <= MEMBER
        if not member.all():
            yield batch.filter(pa.array(~member))
        own = [batch.column(1).to_numpy()[member], batch.column(2).to_numpy()[member], kind[member] == HOT]
        old = len(key)
        bucket, key, hot = np.append(bucket, own[0]), np.append(key, own[1]), np.append(hot, own[2])
        again = np.append(False, (bucket[1:] == bucket[:-1]) & (key[1:] == key[:-1]))[: len(key)]
        keep = ~again | (np.arange(len(key)) < old)
        bucket, key, hot = bucket[keep], key[keep], hot[keep]
        if not len(key):
            continue
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(start, len(key)))
        before, first = np.zeros(len(start), dtype=np.int64), key[start].copy()
        if old:
            before[0], first[0] = nth[0], rep[0]
        nth = np.arange(len(key)) - np.repeat(start - before, size)
        rep = np.repeat(first, size)
        hot = np.repeat(np.maximum.reduceat(hot, start), size)
        fresh = np.arange(len(key)) >= old
        a, b = _near_pairs(key, rep, nth, fresh)
        if len(a):
            yield _batch(PAIR, a, a, b)
        # a run that turns out to be wide gives its first keys late
        turned = np.flatnonzero(fresh & (nth == SMALL) & ~hot)
        late = [turned - back for back in range(1, SMALL + 1)]
        rows = np.concatenate([np.flatnonzero(fresh & (hot | (nth >= SMALL))), *late])
        if len(rows):
            yield _batch(WIDE, bucket[rows], key[rows], key[rows])
        tail = slice(max(int(start[-1]), len(key) - SMALL - 1), None)
        bucket, key, nth, hot, rep = bucket[tail], key[tail], nth[tail], hot[tail], rep[tail]


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs and wide buckets from ``bucket_rows``."""
    dealt = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind", "a")
    return dealt.mapInArrow(_pair_up, BUCKETS)


def verified(pairs: DataFrame, texts: DataFrame, similar: Similar) -> DataFrame:
    """The pairs (a, b) whose texts are similar. ``texts``: key, text, one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                left, right = (part.column(i).cast(pa.large_string()) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(similar(left, right)))

    left = texts.select(F.col("key").alias("b"), F.col("text").alias("b_text"))
    right = texts.select(F.col("key").alias("a"), F.col("text").alias("a_text"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def count_places(rows: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hashed counts from (row, 64-bit feature, weight)."""
    at = row * PLACES + (feature % np.uint64(PLACES)).astype(np.int64)
    return np.bincount(at, weights=weight, minlength=rows * PLACES).reshape(rows, PLACES)


def _counted(texts: DataFrame, counts: Counts) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                grid = np.minimum(counts(part.column(1).cast(pa.large_string())), MANY).astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tobytes() for g in grid], pa.binary())], ["key", "counts"])

    return texts.select("key", "text").mapInArrow(run, "key long, counts binary")


def _possible(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of two components in a wide bucket whose counts allow for the similarity. ``members``: bucket, main, size, key, root, counts."""
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).alias("block")
    rows = F.collect_list(F.struct("key", "root", "counts"))
    outside = members.filter("root <> main").groupBy("bucket", block).agg(rows.alias("outside")).select("bucket", "outside")
    others = members.groupBy("bucket", "main", block).agg(rows.alias("others")).select("bucket", "main", "others")

    def side(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grid = np.frombuffer(b"".join(r["counts"] for r in rows), dtype="<u2").reshape(len(rows), -1).astype(np.int64)
        return np.array([r["key"] for r in rows]), np.array([r["root"] for r in rows]), grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                main = batch.column(1)[r].as_py()
                a, a_root, x = side(batch.column(0)[r].as_py())
                b, b_root, y = side(batch.column(2)[r].as_py())
                x_all, y_all = x.sum(1), y.sum(1)
                # a count that did not fit bounds nothing
                x_over, y_over = (x == MANY).any(1), (y == MANY).any(1)
                left, right = [], []
                for i in range(len(a)):
                    most = np.minimum(x[i], y).sum(1)
                    fits = (most >= similarity * (x_all[i] + y_all - most)) | x_over[i] | y_over
                    own = fits & (b_root != a_root[i]) & ((b_root == main) | (a[i] < b))
                    right.append(b[own])
                    left.append(np.full(int(own.sum()), a[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return outside.join(others, "bucket").select("outside", "main", "others").mapInArrow(run, "a long, b long")


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """As many partitions as ``rows`` (a bound known from an earlier count) fill: small tables are not written as hundreds of files."""
    return df.coalesce(max(1, -(-rows // each)))


def connected(stage: Stage, links: DataFrame, rows: int | None = None) -> DataFrame:
    """(key, root) of every key in ``links`` (a, b; ``rows`` of them, if known), root the least key of its component.

    Every node hangs itself below its least neighbour, paths are halved until all reach a root, links are drawn between roots, and so on until
    none is left. Links of a hub are aggregated in the tasks before they are sent; the tables joined are plain scans, whose skewed
    partitions Spark can split.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    labels = None
    while True:
        edges, seen = stage.put(edges if rows is None else sized(edges, rows))
        rows = seen["rows"]
        if not rows:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "key")
        parents, own = stage.put(sized(parents, 2 * rows))
        while True:
            up = parents.select(F.col("key").alias("root"), F.col("root").alias("above"))
            above = parents.join(up, "root").select("key", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            parents, seen = stage.put(
                sized(above, own["rows"]),
                moved=F.count_if(F.col("moved")),
            )
            parents = parents.select("key", "root")
            if not seen["moved"]:
                break
        to = parents.select(F.col("key").alias("at"), "root")
        if labels is None:
            labels, all_rows = parents, own["rows"]
        else:
            moved = labels.join(to.withColumnRenamed("root", "above"), labels["root"] == F.col("at"), "left")
            labels = stage.table(sized(moved.select("key", F.coalesce("above", "root").alias("root")), all_rows))
        a, b = (to.select(F.col("at").alias(s), F.col("root").alias(f"{s}_root")) for s in "ab")
        drawn = edges.join(a, "a").join(b, "b").filter("a_root <> b_root")
        edges = drawn.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
    if labels is None:
        return links.select(F.col("a").alias("key"), F.col("b").alias("root")).limit(0)
    return labels


def classes(
    stage: Stage, rows: DataFrame, texts_of: Callable[[DataFrame, int], DataFrame], similar: Similar, counts: Counts, similarity: float,
    rounds: int = 1,
) -> DataFrame:
    """(key, root) of every key that is similar to another.

    ``rows``: from ``bucket_rows``. ``texts_of(keys, n)``: the texts (key, text) of ``n`` keys (key).
    """
    found, n = stage.put(candidates(rows))
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").filter("a <> b").distinct()
    pairs, seen = stage.put(sized(pairs, n["rows"]))
    wide = found.filter(F.col("kind") == WIDE).select("bucket", F.col("a").alias("key")).distinct()
    wide, some = stage.put(sized(wide, n["rows"]))
    sides = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(wide.select("key"))
    keys, count = stage.put(sized(sides.distinct(), 2 * seen["rows"] + some["rows"]))
    texts = stage.table(sized(texts_of(keys, count["rows"]), count["rows"], 5_000))
    links, linked = stage.put(sized(verified(pairs, texts, similar), seen["rows"], 10_000))
    roots = connected(stage, links, linked["rows"])
    last = not some["rows"]
    drawn = 0
    while not last:
        own = wide.join(roots, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
        sizes = own.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size"))
        mixed = mixed.filter("roots > 1").select("bucket", F.col("main.root").alias("main"), "size")
        mixed, open_buckets = stage.put(sized(mixed, some["rows"]))
        if not open_buckets["rows"]:
            break
        members = stage.table(sized(own.join(mixed, "bucket"), some["rows"]))
        last = drawn >= rounds
        if last:
            counted = _counted(texts.join(members.select("key").distinct(), "key", "left_semi"), counts)
            counted = stage.table(sized(counted, count["rows"], 5_000))
            new = _possible(members.join(counted, "key"), similarity)
        else:
            pick = F.min(F.struct(F.xxhash64("key", F.lit(drawn)).alias("h"), F.col("key"), F.col("root"))).alias("pick")
            picks = members.groupBy("bucket").agg(pick).select("bucket", F.col("pick.key").alias("a"), F.col("pick.root").alias("a_root"))
            picks = stage.table(sized(picks, open_buckets["rows"]))
            new = members.join(picks, "bucket").filter("a_root <> root").select("a", F.col("key").alias("b"))
        new = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new, tried = stage.put(new if last else sized(new, some["rows"]))
        more, gained = stage.put(sized(verified(new, texts, similar), tried["rows"], 10_000))
        drawn = drawn + 1 if gained["rows"] else rounds
        if gained["rows"]:
            links = links.unionByName(more)
            linked["rows"] += gained["rows"]
            roots = connected(stage, links, linked["rows"])
    return roots
