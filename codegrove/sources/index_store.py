"""The search index as an append-only table (inventory S26-S31, I10, I28).

Every write adds one folder ``seq=<n>`` with upserted rows and deletion marks; readers take the newest
row per id and drop what a later mark deleted. Steps have numbers of their own; a writer that may repeat a
step (a streaming batch) names it, and the name is kept in a row of the step: the same name replaces the same
folder, or does nothing if the step is folded already. ``compact`` folds the history into a folder ``base=<n>``.
Readers take the newest complete base and the steps after it, so old folders may stay, go or be half deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from codegrove.schemas import DOCUMENTS
from codegrove.sources.graph_store import conform, delete_path, list_children

class DocumentIndex:
    """An index at a path, created on first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str = DOCUMENTS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.log_schema = f"{schema}, _op string, _file string"

    def recreate(self) -> None:
        delete_path(self.spark, self.path)

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the completed folders of a kind: one without a success marker does not count."""
        found = []
        for name in list_children(self.spark, self.path):
            if name.startswith(f"{kind}=") and "_SUCCESS" in list_children(self.spark, f"{self.path}/{name}"):
                found.append(int(name.partition("=")[2]))
        return sorted(found)

    def base(self) -> int:
        """The newest complete fold of the history, -1 if there is none."""
        return max(self._complete("base"), default=-1)

    def versions(self) -> list[int]:
        """The steps after the base."""
        base = self.base()
        return [v for v in self._complete("seq") if v > base]

    def next_seq(self) -> int:
        return max([*self._complete("seq"), *self._complete("base")], default=-1) + 1

    def _step_of(self, name: str) -> tuple[bool, int]:
        """Whether a named step is folded into the base, and the number it has, or would get."""
        log = self._log()
        seen = None
        if log is not None:
            seen = log.filter((F.col("_op") == "step") & (F.col("_file") == name)).agg(F.max("seq").alias("seq")).first().seq
        if seen is None:
            return False, self.next_seq()
        return seen <= self.base(), seen

    def _write(self, rows: DataFrame, seq: int | None = None, kind: str = "seq") -> int:
        seq = self.next_seq() if seq is None else seq
        conform(rows, self.log_schema).write.mode("overwrite").parquet(f"{self.path}/{kind}={seq}")
        return seq

    def change(
        self, upserts: DataFrame | None = None, deleted_ids: DataFrame | None = None,
        deleted_files: DataFrame | None = None, step: str | None = None,
    ) -> int:
        """One atomic step. Deletions of a step act on earlier steps, then rows come in.

        A step with a name is applied once, however often it is written.
        """
        frames, seq = [], None
        if step is not None:
            folded, seq = self._step_of(step)
            if folded:
                return seq
            mark = self.spark.range(1).select(F.lit("step").alias("_op"), F.lit(step).alias("_file"))
            frames.append(conform(mark, self.log_schema))
        if upserts is not None:
            frames.append(conform(upserts.withColumn("_op", F.lit("put")), self.log_schema))
        if deleted_ids is not None:
            frames.append(conform(deleted_ids.select("id").withColumn("_op", F.lit("drop")), self.log_schema))
        if deleted_files is not None:
            gone = deleted_files.select(F.col("file_path").alias("_file"), F.lit("drop_file").alias("_op"))
            frames.append(conform(gone, self.log_schema))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return self._write(out, seq)

    def update(self, changes: DataFrame) -> int:
        """Partial rows: given columns replace, others keep their current value."""
        from codegrove.operators.snapshots import merge_columns

        current = self.documents().join(changes.select("id"), "id", "left_semi")
        merged = merge_columns(conform(current, self.schema), changes)
        return self._write(merged.withColumn("_op", F.lit("put")))

    def delete_where(self, predicate: Column) -> int:
        """Delete by any condition."""
        return self.change(deleted_ids=self.documents().filter(predicate).select("id"))

    def _log(self) -> DataFrame | None:
        base = self.base()
        paths = [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/seq={v}" for v in self.versions()]
        if not paths:
            return None
        rows = self.spark.read.schema(ST._parse_datatype_string(self.log_schema)).parquet(*paths)
        return rows.withColumn("seq", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:seq|base)=(\d+)/", 1).cast("long"))

    def documents(self) -> DataFrame:
        """The current rows: newest step per id, minus later deletions.

        The newest step of each id is found without the documents' texts; the winners are joined afterwards.
        """
        log = self._log()
        names = [f.name for f in ST._parse_datatype_string(self.schema)]
        if log is None:
            return self.spark.createDataFrame([], self.schema)
        # within one step a row put in wins over a deletion of its id
        rank = F.struct("seq", (F.col("_op") == "put").alias("is_put"))
        newest = (
            log.filter(F.col("_op").isin("put", "drop")).groupBy("id").agg(F.max(rank).alias("r"))
            .filter("r.is_put").select("id", F.col("r.seq").alias("seq"))
        )
        rows = log.filter(F.col("_op") == "put").join(newest, ["id", "seq"])
        files = log.filter(F.col("_op") == "drop_file").groupBy(F.col("_file").alias("file_path")).agg(
            F.max("seq").alias("dropped")
        )
        kept = rows.join(files, "file_path", "left").filter(
            F.col("dropped").isNull() | (F.col("dropped") <= F.col("seq"))
        )
        return kept.select(*names)

    def get(self, doc_id: str) -> DataFrame:
        """At most one row."""
        return self.documents().filter(F.col("id") == doc_id).limit(1)

    def compact(self) -> int:
        """Fold all steps into a new base; what the base replaces is deleted once it is complete."""
        log = self._log()
        if log is None:
            return -1
        old = [("seq", v) for v in self._complete("seq")] + [("base", v) for v in self._complete("base")]
        steps = log.filter(F.col("_op") == "step").select("_op", "_file").distinct()
        rows = conform(self.documents().withColumn("_op", F.lit("put")), self.log_schema)
        seq = self._write(rows.unionByName(conform(steps, self.log_schema)), kind="base")
        for kind, version in old:
            delete_path(self.spark, f"{self.path}/{kind}={version}")
        return seq
