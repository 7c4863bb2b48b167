"""Query parameters and predicates (inventory P1, P2, P15-P18, P21, P27, P28, T9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T

# Path parts that an incremental scan skips, and those a directory hash skips.
SKIPPED_PARTS = (
    "__pycache__", ".git", ".venv", "venv", "node_modules", ".pytest_cache", ".mypy_cache",
)
HASH_SKIPPED_PARTS = ("__pycache__", ".git", ".venv", "venv", "node_modules", ".pytest_cache")
HASH_SKIPPED_GLOBS = ("*.pyc", "*.pyo")
WATCH_SKIPPED_PARTS = ("__pycache__", ".git", ".venv", "node_modules")


@dataclass(frozen=True)
class SearchFilter:
    """Declarative restrictions; only what is set ends up in the plan."""

    languages: Sequence[str] = ()
    code_types: Sequence[str] = ()
    min_line: int | None = None
    max_line: int | None = None
    file_patterns: Sequence[str] = ()
    exclude_patterns: Sequence[str] = ()

    def predicate(self) -> Column | None:
        """Conjunction of the set restrictions, or None. Simple comparisons reach the scan."""
        tests: list[Column] = []
        if self.languages:
            tests.append(F.col("language").isin(*self.languages))
        if self.code_types:
            tests.append(F.col("code_type").isin(*self.code_types))
        if self.min_line is not None:
            tests.append(F.col("line_start") >= self.min_line)
        if self.max_line is not None:
            tests.append(F.col("line_end") <= self.max_line)
        if self.file_patterns:
            tests.append(any_glob(F.col("file_path"), self.file_patterns))
        if self.exclude_patterns:
            tests.append(~any_glob(F.col("file_path"), self.exclude_patterns))
        if not tests:
            return None
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        predicate = self.predicate()
        return df if predicate is None else df.filter(predicate)


@dataclass(frozen=True)
class SearchQuery:
    """A request; the limit is what the caller asks for, at least 1, and the offset 0 or more."""

    text: str
    mode: str = "hybrid"  # keyword | semantic | hybrid
    filters: SearchFilter = field(default_factory=SearchFilter)
    limit: int = 20
    offset: int = 0
    sort_by: str = "relevance"  # relevance | file_path | line_number | name
    descending: bool = True
    highlight: bool = True
    include_content: bool = True
    semantic_weight: float = 0.5
    keyword_weight: float = 0.5
    rerank: bool = True
    min_score: float = 0.0
    dedup: bool = False
    max_typos: bool = False

    def __post_init__(self):
        object.__setattr__(self, "limit", max(self.limit, 1))
        object.__setattr__(self, "offset", max(self.offset, 0))

    @property
    def words(self) -> list[str]:
        """Lower-cased query words, each once."""
        return sorted(set(self.text.lower().split()))

    def weights(self) -> tuple[float, float]:
        """(keyword, semantic) shares, summing to one."""
        total = self.keyword_weight + self.semantic_weight
        if total <= 0:
            return 0.5, 0.5
        return self.keyword_weight / total, self.semantic_weight / total


def any_glob(path: Column, patterns: Sequence[str]) -> Column:
    out = T.matches_glob(path, patterns[0])
    for pattern in patterns[1:]:
        out = out | T.matches_glob(path, pattern)
    return out


def any_name(path: Column, patterns: Sequence[str]) -> Column:
    out = T.matches_name(path, patterns[0])
    for pattern in patterns[1:]:
        out = out | T.matches_name(path, pattern)
    return out


def skipped_in_index(path: Column) -> Column:
    """Paths an incremental scan ignores."""
    return T.mentions_any(path, SKIPPED_PARTS)


def skipped_in_hash(path: Column, extra: Sequence[str] = ()) -> Column:
    """Paths a directory hash ignores (substring or name glob)."""
    globs = [*HASH_SKIPPED_GLOBS, *extra]
    return T.mentions_any(path, [*HASH_SKIPPED_PARTS, *extra]) | any_name(path, globs)


def watched(
    path: Column,
    patterns: Sequence[str] = ("*.py",),
    excluded: Sequence[str] = WATCH_SKIPPED_PARTS,
) -> Column:
    """Exclusions first, then one of the name globs."""
    return ~T.mentions_any(path, excluded) & any_name(path, patterns)


def page(df: DataFrame, limit: int | None, offset: int = 0, *order) -> DataFrame:
    """Filter-then-limit pagination in a fixed order (TakeOrderedAndProject); no limit: all rows."""
    ordered = df.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def validate_path(path: str, base_paths: Sequence[str] = ()) -> bool:
    """No parent steps, and inside one of the allowed bases when any are given."""
    from pathlib import PurePosixPath

    parts = PurePosixPath(path)
    if ".." in parts.parts:
        return False
    return not base_paths or any(parts.is_relative_to(base) for base in base_paths)
