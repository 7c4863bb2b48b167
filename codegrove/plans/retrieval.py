"""Graph-augmented retrieval (inventory G1-G12, J20-J22, U5, U6, F32).

Retrieval is composed of DataFrame operators; only final top-k lists (at most the configured number of
contexts, relationships and communities) are staged, because later steps use them several times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions import prompts as P
from codegrove.operators import components as C
from codegrove.operators import graph_lookup as L
from codegrove.operators import search as S
from codegrove.operators import traversal as V
from codegrove.operators.filters import SearchFilter, SearchQuery
from codegrove.plans import prompting
from codegrove.sources.models import CachedGenerator, Embedder, Generator, MockEmbedder, mock_generator
from codegrove.staging import Stage

CONTEXT_COLUMNS = (
    "code_id", "name", "qualified_name", "code_type", "file_path", "line_start", "line_end", "content",
    "language", "docstring", "relevance_score",
)


@dataclass(frozen=True)
class RetrievalSettings:
    """Defaults of the retriever."""

    max_vector_results: int = 20
    max_context_items: int = 10
    semantic_threshold: float = 0.5
    related_per_node: int | None = None
    related_score: float = 0.8
    include_callers: bool = True
    include_callees: bool = True


@dataclass
class Retrieved:
    query: str
    query_type: str
    contexts: DataFrame
    relationships: DataFrame
    communities: DataFrame
    context_ids: list[str] = field(default_factory=list)


@dataclass
class Answer:
    query: str
    mode: str
    retrieval: Retrieved
    response: str
    iterations: int = 1

    @property
    def citations(self) -> list[str]:
        """F32: qualified names of the contexts used (a bounded list)."""
        rows = self.retrieval.contexts.select("qualified_name", "relevance_score", "code_id")
        return [r.qualified_name for r in rows.orderBy(F.desc("relevance_score"), "code_id").collect()]


def to_contexts(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits at or above the threshold as contexts."""
    doc = F.col("docstring") if "docstring" in hits.columns else F.lit(None).cast("string")
    rows = hits.filter(F.col("score") >= threshold).withColumn("docstring", doc)
    return rows.select(
        F.col("id").alias("code_id"), *CONTEXT_COLUMNS[1:-1], F.col("score").alias("relevance_score")
    )


class CodeRetriever:
    """Search, graph expansion and community lookup over one set of tables."""

    def __init__(
        self, documents: DataFrame, nodes: DataFrame, edges: DataFrame,
        communities: DataFrame | None = None, embedder: Embedder | None = None,
        settings: RetrievalSettings = RetrievalSettings(), index: DataFrame | None = None,
    ):
        self.documents, self.nodes, self.edges = documents, nodes, edges
        self.memberships = communities
        self.embedder = embedder or MockEmbedder()
        self.settings, self.index = settings, index

    def _members(self) -> DataFrame:
        if self.memberships is None:
            self.memberships = Stage(self.nodes.sparkSession, "communities").table(
                C.weak_components(self.nodes, self.edges)
            )
        return self.memberships

    def hits(self, text: str, filters: SearchFilter | None = None) -> DataFrame:
        query = SearchQuery(
            text, "hybrid", filters or SearchFilter(), limit=self.settings.max_vector_results, highlight=False
        )
        found = S.search(self.documents, query, self.embedder.query(text), self.index)
        extra = [c for c in ("docstring",) if c in self.documents.columns]
        return found.join(self.documents.select("id", *extra), "id") if extra else found

    def retrieve(self, text: str, query_type: str = "local", filters: SearchFilter | None = None) -> Retrieved:
        """G1: search, then relationships (local), communities (global) or both (drift)."""
        stage = Stage(self.nodes.sparkSession, "retrieve")
        found = stage.table(to_contexts(self.hits(text, filters), self.settings.semantic_threshold))
        ids = found.select(F.col("code_id").alias("id"))
        relationships = self.relationships(ids) if query_type in ("local", "drift") else self.relationships(ids.limit(0))
        communities = self.community_summaries(ids) if query_type in ("global", "drift") else None
        if communities is None:
            communities = found.limit(0).select(
                F.col("code_id").alias("community_id"), "name", F.col("name").alias("description"),
                F.array("name").alias("key_components"), F.lit(0).cast("long").alias("size"),
            )
        contexts = stage.table(
            found.orderBy(F.desc("relevance_score"), "code_id").limit(self.settings.max_context_items)
        )
        kept = [r.code_id for r in contexts.select("code_id").collect()]
        return Retrieved(text, query_type, contexts, relationships, communities, kept)

    def relationships(self, ids: DataFrame) -> DataFrame:
        """J20, restricted to the configured directions."""
        rows = L.related(ids, self.edges, self.settings.related_per_node)
        if self.settings.include_callers and self.settings.include_callees:
            return rows
        side = "target" if self.settings.include_callers else "source"
        return rows.join(ids.withColumnRenamed("id", side), side, "left_semi")

    def community_summaries(self, ids: DataFrame) -> DataFrame:
        """Summaries of the communities the contexts belong to, each once."""
        members = self._members()
        wanted = members.join(ids, "id", "left_semi").select("component").distinct()
        return C.community_summary(members.join(wanted, "component", "left_semi"), self.nodes)

    def _as_contexts(self, ids: DataFrame) -> DataFrame:
        docs = self.documents.join(ids.select("id").distinct(), "id", "left_semi")
        return to_contexts(docs.withColumn("score", F.lit(self.settings.related_score)), 0.0)

    def by_relationship(self, code_id: str, relationship: str, depth: int = 1) -> DataFrame:
        """Contexts of callers, callees, ancestors, descendants, siblings, or the unit itself."""
        one = self.nodes.sparkSession.createDataFrame([(code_id,)], "id string")
        if relationship == "self":
            return self._as_contexts(one)
        if relationship == "siblings":
            return self._as_contexts(L.siblings(self.edges, one).select(F.col("sibling").alias("id")))
        walk = {
            "callers": V.callers, "callees": V.callees, "ancestors": V.ancestors, "descendants": V.descendants,
        }
        if relationship not in walk:
            return self._as_contexts(one.limit(0))
        return self._as_contexts(walk[relationship](self.nodes, self.edges, code_id, depth))

    def similar(self, content: str, limit: int = 10, exclude_ids: list[str] | None = None) -> DataFrame:
        """G4."""
        hits = S.similar(self.documents, self.embedder.query(content), limit, exclude_ids)
        return to_contexts(hits, -1.0)


class CodeAssistant:
    """Answers questions with one of four retrieval modes and a pluggable generator."""

    def __init__(
        self, retriever: CodeRetriever, generator: Generator = mock_generator, max_tokens: int = 8000,
        max_iterations: int = 3, drift_threshold: float = 0.8,
    ):
        self.retriever = retriever
        self.generator = generator if isinstance(generator, CachedGenerator) else CachedGenerator(generator)
        self.max_tokens, self.max_iterations = max_tokens, max_iterations
        self.drift_threshold = drift_threshold

    def prompt(self, found: Retrieved) -> dict[str, str]:
        """System and user prompt, cut to the token budget."""
        items = prompting.prompt_items(found.contexts, found.relationships, found.communities)
        kept = prompting.within_budget(items, len(found.query), self.max_tokens)
        row = prompting.user_prompt(kept, found.query, found.query_type).first()
        return {"system": P.SYSTEM_PROMPTS[found.query_type], "user": row.user}

    def _generate(self, found: Retrieved) -> str:
        key = self.generator.key(found.query, found.query_type, found.context_ids)
        return self.generator(self.prompt(found), key)

    def ask(self, text: str, mode: str = "local", filters: SearchFilter | None = None) -> Answer:
        """G5/G12."""
        if mode in ("local", "global"):
            found = self.retriever.retrieve(text, mode, filters)
        elif mode == "hybrid":  # U5: contexts and relationships of local, communities of global
            found = self.retriever.retrieve(text, "drift", filters)
        elif mode == "drift":
            return self._drift(text, filters)
        else:
            raise ValueError(f"Unknown mode: {mode}")
        return Answer(text, mode, found, self._generate(found))

    def _drift(self, text: str, filters: SearchFilter | None) -> Answer:
        """Refine the question until the contexts repeat; the richest retrieval is answered."""
        best: tuple[Retrieved, str] | None = None
        seen: set[str] = set()
        current, rounds = text, 0
        spark = self.retriever.nodes.sparkSession
        while rounds < self.max_iterations:
            rounds += 1
            found = self.retriever.retrieve(current, "drift", filters)
            fresh = set(found.context_ids)
            overlap = len(seen & fresh) / max(len(fresh), 1)
            seen |= fresh
            response = self._generate(found)
            if best is None or len(found.context_ids) > len(best[0].context_ids):
                best = (found, response)
            if overlap >= self.drift_threshold:
                break
            row = spark.range(1).select(P.refined_query(F.lit(text), F.lit(response)).alias("q")).first()
            current = row.q
        return Answer(text, "drift", best[0], best[1], rounds)

    def explain(self, code_id: str, question: str | None = None) -> str:
        """An answer about one unit."""
        row = self.retriever.by_relationship(code_id, "self").first()
        if row is None:
            return "Code not found."
        question = question or f"What does {row['name']} do?"
        return self.generator({"system": P.SYSTEM_PROMPTS["local"], "user": f"{question}\n\n{row.content}"})

    def summarise_file(self, file_path: str, units: int = 10, characters: int = 500) -> tuple[str, DataFrame]:
        """Answer over the first units of a file, and all its components."""
        docs = self.retriever.documents.filter(F.col("file_path") == file_path)
        first = docs.orderBy("line_start", "id").limit(units).select(
            "name", F.substring("content", 1, characters).alias("content")
        ).collect()
        components = docs.select("name", F.col("code_type").alias("type"), "line_start")
        if not first:
            return "No code units found in file.", components
        body = "\n\n".join(f"{r['name']}\n{r.content}" for r in first)
        return self.generator({"system": P.SYSTEM_PROMPTS["global"], "user": body}), components
