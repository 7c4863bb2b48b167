"""Symbol definitions and references (inventory J13-J15, J24, J29, A10, U9, X10, T12)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.functions import text as T
from codegrove.operators.filters import page
from codegrove.staging import Stage


def definitions_of(units: DataFrame) -> DataFrame:
    """Definition rows of code units; ``seq`` is the ingest order."""
    return units.select(
        "name", "qualified_name", F.col("type").alias("symbol_type"), "file_path", "line_start",
        "line_end", F.struct("file_path", "line_start", "id").alias("seq"),
    )


def references_of(units: DataFrame) -> DataFrame:
    """Reference rows of the calls of code units."""
    return units.select(
        F.explode("calls").alias("symbol"), "file_path", F.col("line_start").alias("line"),
        F.lit(0).alias("column"), F.lit("call").alias("ref_type"),
        F.concat(F.lit("call in "), F.col("qualified_name")).alias("context"),
        F.struct("file_path", "line_start", "id").alias("seq"),
    )


def current_definitions(definitions: DataFrame) -> DataFrame:
    """One row per qualified name: the last one added replaces the others."""
    row = F.struct("name", "qualified_name", "symbol_type", "file_path", "line_start", "line_end")
    return definitions.groupBy("qualified_name").agg(
        F.max_by(row, "seq").alias("d"), F.min("seq").alias("first_seq")
    ).select("d.*", "first_seq")


def lookup_definitions(definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each ``symbol``: the definition of that qualified name, else the first of that name.

    "First" is the order in which qualified names were first added. Both candidates are resolved in
    one grouped pass over (key, preference, order).
    """
    current = current_definitions(definitions)
    row = F.struct("name", "qualified_name", "symbol_type", "file_path", "line_start", "line_end")
    keyed = current.select(
        F.inline(
            F.array(
                F.struct(F.col("qualified_name").alias("symbol"), F.lit(0).alias("preference")),
                F.struct(F.col("name").alias("symbol"), F.lit(1).alias("preference")),
            )
        ),
        row.alias("d"), "first_seq",
    )
    best = keyed.groupBy("symbol").agg(
        F.min_by("d", F.struct("preference", "first_seq")).alias("d")
    )
    return symbols.select("symbol").distinct().join(best, "symbol").select("symbol", "d.*")


def references_to(
    references: DataFrame, definitions: DataFrame, symbol: str, include_definition: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """References of a symbol in the order added, its definition in front when asked for."""
    rows = references.filter(F.col("symbol") == symbol).select(
        F.lit(1).alias("ord"), "seq", "file_path", "line", "ref_type", "context"
    )
    if include_definition:
        wanted = references.sparkSession.createDataFrame([(symbol,)], "symbol string")
        found = lookup_definitions(definitions, wanted)
        head = found.select(
            F.lit(0).alias("ord"), F.lit(None).cast(references.schema["seq"].dataType).alias("seq"),
            "file_path", F.col("line_start").alias("line"), F.lit("unknown").alias("ref_type"),
            F.concat(F.lit("Definition of "), F.col("name")).alias("context"),
        )
        rows = head.unionByName(rows)
    return page(rows, limit, 0, "ord", "seq").drop("seq")


def without_file(definitions: DataFrame, references: DataFrame, file_path: str) -> tuple[DataFrame, DataFrame]:
    """Drop what one file contributed."""
    keep = F.col("file_path") != file_path
    return definitions.filter(keep), references.filter(keep)


def removed_count(definitions: DataFrame, references: DataFrame, file_path: str) -> DataFrame:
    """How many definitions and references a file removal takes away."""
    gone = F.col("file_path") == file_path
    rows = definitions.filter(gone).select("qualified_name").distinct().select(F.lit(1).alias("n"))
    rows = rows.unionByName(references.filter(gone).select(F.lit(1).alias("n")))
    return rows.agg(F.count(F.lit(1)).alias("removed"))


def reference_stats(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """A10: the five counters of the index."""
    refs = references.agg(
        F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("file_path").alias("files_with_refs"),
        F.count(F.lit(1)).alias("total_refs"),
    )
    defs = definitions.agg(
        F.countDistinct("qualified_name").alias("definitions"),
        F.countDistinct("file_path").alias("files_with_defs"),
    )
    return refs.select(
        "symbols", defs.select("definitions").scalar().alias("definitions"), "files_with_refs",
        defs.select("files_with_defs").scalar().alias("files_with_defs"), "total_refs",
    )


def symbols(references: DataFrame) -> DataFrame:
    """U9."""
    return references.select("symbol").distinct()


def _import_patterns(file_name: str) -> dict[str, list[str]]:
    """What counts as an include (PHP) or an import (Python) of a file."""
    base = re.escape(file_name.rsplit("/", 1)[-1])
    stem = re.escape(re.sub(r"(.)\.[^.]*$", r"\1", file_name.rsplit("/", 1)[-1]))
    return {
        "php": [
            rf"(?i)require\s*\(?['\"].*{base}['\"]",
            rf"(?i)require_once\s*\(?['\"].*{base}['\"]",
            rf"(?i)include\s*\(?['\"].*{base}['\"]",
            rf"(?i)include_once\s*\(?['\"].*{base}['\"]",
            rf"(?i)['\"].*{base}['\"]",
        ],
        "other": [rf"(?i)from\s+{stem}\s+import", rf"(?i)import\s+{stem}"],
    }


def _hits(line: Column, patterns: list[str]) -> Column:
    total = F.regexp_count(line, F.lit(patterns[0]))
    for p in patterns[1:]:
        total = total + F.regexp_count(line, F.lit(p))
    return total


#: Up to so many names of the target are looked for in whole files before these are moved and cut into lines.
FEW_NAMES = 100


def scan_references(
    files: DataFrame, nodes: DataFrame, file_name: str, limit: int | None = None, shown: int | None = None, chars: int | None = None
) -> DataFrame:
    """Files that include the target or call one of its units, with scores and matches; on request the best ``limit`` files, the first
    ``shown`` matches of each, the first ``chars`` characters of a line.

    Lines that can match are exploded; include patterns are counted by regular expressions and unit usages
    come from an equi-join of the called names on a line with the target's names, instead of trying
    every name on every file. The names are written first, so that their size is known and few of them are sent to the lines; with ``FEW_NAMES`` or
    fewer, files that hold neither one of them nor the target's stem are left out first. The lines are read once, what they match is written. 10 points per include match, 5 per distinct usage line. Patterns are
    matched line by line. Long lines (over 200 characters) are never treated as repeats.
    """
    base = file_name.rsplit("/", 1)[-1]
    patterns = _import_patterns(file_name)
    candidates = files.filter(~F.col("file_path").contains(base)).withColumn(
        "language", F.coalesce(T.parse_language(F.col("file_path")), F.lit("unknown"))
    )
    own = F.coalesce("file_path", F.lit(""))
    targets = (
        nodes.filter(
            (own.contains(base) | F.lower(own).contains(file_name.lower()))
            & (F.length("name") > 2)
        )
        .select("name").distinct()
    )
    stage = Stage(files.sparkSession, "scan")
    targets, seen = stage.put(targets.withColumn("is_target", F.lit(True)))
    if seen["rows"] <= FEW_NAMES:
        # a called name is made of word characters only, others can't be met
        wanted = sorted(n for (n,) in targets.select("name").collect() if re.fullmatch(r"[A-Za-z0-9_]+", n))
        short = "(?i:" + re.escape(base.rsplit(".", 1)[0]) + ")"
        candidates = candidates.filter(F.col("content").rlike("|".join([short, *wanted])))
    # cheap substring tests inside the array: only such lines can match one of the patterns below, and only they become rows
    stem = base.rsplit(".", 1)[0].lower()
    numbered = F.transform(T.lines(F.col("content")), lambda raw, at: F.struct(at.alias("at"), raw.alias("raw")))
    possible = F.filter(numbered, lambda x: x["raw"].contains("(") | F.lower(x["raw"]).contains(stem))
    lines = candidates.hint("rebalance").select("file_path", "language", F.inline(possible))
    php = F.col("language") == "php"
    includes = F.when(php, _hits(F.col("raw"), patterns["php"])).otherwise(_hits(F.col("raw"), patterns["other"]))
    includes = F.when(F.lower("raw").contains(stem), includes).otherwise(0)
    called = F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\b(\w+)\s*\("), F.lit(1)))
    found = lines.select(
        "file_path", "language", (F.col("at") + 1).alias("line"), T.strip(F.col("raw")).alias("text"),
        includes.alias("n"), called.alias("called"),
    ).filter((F.col("n") > 0) | (F.size("called") > 0))
    # a line that includes the target is a row without a name, besides those of the names called on it
    names = F.concat(F.when(F.col("n") > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")), F.col("called"))
    named = found.select("file_path", "language", "line", "text", "n", F.explode(names).alias("name"))
    found = stage.table(named.join(targets, "name", "left").filter(F.col("name").isNull() | F.col("is_target")))
    imports = found.filter(F.col("name").isNull()).select(
        "file_path", "language", F.lit(0).alias("phase"), F.lit("").alias("unit"), "line",
        "text", "n", F.lit(10).alias("points"),
        F.lit("include/require").alias("type"),
    )
    usages = (
        found.filter(F.col("name").isNotNull())
        .select(
            "file_path", "language", F.lit(1).alias("phase"), F.col("name").alias("unit"), "line",
            "text", F.lit(1).alias("n"), F.lit(5).alias("points"),
            F.concat(F.lit("uses "), F.col("name")).alias("type"),
        )
    )
    # a usage line counts once per file, and not at all when an include match already shows it
    key = F.when(F.length("text") > 200, F.concat_ws(":", "line", "unit")).otherwise(F.lit(""))
    once = (
        usages.withColumn("key", key)
        .join(imports.select("file_path", "text").distinct(), ["file_path", "text"], "left_anti")
        .groupBy("file_path", "language", "text", "key")
        .agg(F.min(F.struct("phase", "unit", "line", "n", "points", "type")).alias("m"))
        .select(
            "file_path", "language", "m.phase", "m.unit", "m.line", "text",
            "m.n", "m.points", "m.type",
        )
    )
    matches = imports.unionByName(once)
    w = Window.partitionBy("file_path").orderBy("phase", "unit", "line", "text")
    first = (
        matches.withColumn("rn", F.row_number().over(w)).filter(F.lit(True) if shown is None else F.col("rn") <= shown)
        .withColumn("text", F.col("text") if chars is None else F.substring("text", 1, chars))
        .groupBy("file_path")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "line", "text", "type"))).alias("m"))
    )
    totals = matches.groupBy("file_path", "language").agg(
        F.sum("n").alias("match_count"), F.sum(F.col("n") * F.col("points")).alias("score")
    )
    best = page(totals, limit, 0, F.desc("score"), "file_path")
    return best.join(first, "file_path").select(
        "file_path", "language", "match_count", "score",
        F.transform("m", lambda s: F.struct(s["line"], s["text"], s["type"])).alias("matches"),
    )
