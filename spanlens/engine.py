"""The engine's front: index files once, answer batches of prompts, look names up.

An `Engine` holds the index tables of one set of chunks; every answer is one lazy plan over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.config import RetrieverConfig
from spanlens.functions import paths
from spanlens.functions import text as T
from spanlens.operators import ast_chunk, expand, index, lookup, retrieve, shape
from spanlens.operators.score import LexicalScorer, Scorer
from spanlens.sources.store import stored

PER_TERM = 200


@dataclass(frozen=True)
class Engine:
    chunks: DataFrame
    index: index.Index
    defs: DataFrame
    refs: DataFrame
    config: RetrieverConfig = RetrieverConfig()

    @classmethod
    def from_files(cls, files: DataFrame, config: RetrieverConfig = RetrieverConfig()) -> Engine:
        """Chunks files (path, lang, text) and indexes path, symbol and text of each chunk."""
        chunks = ast_chunk.chunk_files(files, config.chunks)
        body = F.concat_ws(" ", "path", "symbol", "text")
        refs = chunks.select("chunk_id", F.posexplode("refs").alias("pos", "ident"))
        return cls(chunks, index.build(chunks, "chunk_id", body, config.max_tf), index.inverted(chunks, "defines"), refs, config)

    def written(self) -> Engine:
        """The engine with chunks and postings written to the shared folder once; every later answer reads those."""
        chunks = stored(self.chunks, "chunks")
        refs = chunks.select("chunk_id", F.posexplode("refs").alias("pos", "ident"))
        return Engine(chunks, index.written(self.index), index.inverted(chunks, "defines"), refs, self.config)

    def candidates(self, prompts: DataFrame, query: str = "query_id", prompt: str = "prompt") -> DataFrame:
        """(query, chunk_id, path, fused, rank): three ranked lists of each prompt, fused and capped per file."""
        c = self.config
        asked = prompts.select(query, T.content_terms(T.task_focus(F.col(prompt))).alias("terms"))
        chosen = retrieve.select_terms(retrieve.prepare_terms(asked, query, "terms"), self.index.term_df, query, c.max_terms, c.df_budget)
        limit = 2 * c.k_candidates
        lexical = retrieve.bm25(chosen, self.index, query, "chunk_id", limit, per_term=max(limit, PER_TERM))
        named = prompts.select(query, F.posexplode(T.explicit_identifiers(F.col(prompt))).alias("pos", "ident"))
        defined = retrieve.by_names(self.defs, named, query, "chunk_id", limit=2 * c.k_candidates)
        fused = retrieve.rrf([lexical, defined, self.mentioned(prompts, query, prompt, limit)], query, "chunk_id", c.rrf_k).join(self.chunks.select("chunk_id", "path", "kind"), "chunk_id")
        capped = retrieve.cap_per_file(fused, query, "path", c.per_file, c.k_candidates).drop("rank").withColumnRenamed("place", "rank")
        moved = retrieve.demote_prose(capped.withColumn("is_prose", F.col("kind") == "window"), query)
        return moved.drop("rank", "is_prose", "kind").withColumnRenamed("place", "rank")

    def mentioned(self, prompts: DataFrame, query: str, prompt: str, limit: int) -> DataFrame:
        """(query, chunk_id, rank): what a search for the terms of the paths that a prompt mentions finds."""
        said = prompts.select(query, F.explode(T.path_mentions(F.col(prompt))).alias("mention"))
        return retrieve.path_signal(self.chunks, said, self.index, query, "chunk_id", limit, max(limit, PER_TERM)).select(query, "chunk_id", "rank")

    def search(self, prompts: DataFrame, query: str = "query_id", prompt: str = "prompt", scorer: Scorer | None = None) -> DataFrame:
        """(query, path, start, end, score): merged spans within the budgets, re-ranked by a scorer if there is one."""
        c = self.config.clamped()
        found = self.candidates(prompts, query, prompt).join(self.chunks.select("chunk_id", "start_line", "end_line", "text"), "chunk_id")
        score = F.col("fused")
        if scorer is not None:
            scored = scorer.score(found.withColumn("score", F.col("fused")).join(prompts.select(query, prompt), query), prompt, "text")
            found = retrieve.gate(retrieve.blend(scored, query, weight=c.weight), query, threshold=c.threshold, min_keep=c.min_keep)
            score = F.col("blend")
        spans = found.select(query, "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), score.alias("score"))
        return shape.shape_spans(spans, query, n=c.top_n, budget=c.line_budget, gap=c.gap, max_lines=c.max_span)

    def related(self, prompts: DataFrame, query: str = "query_id", prompt: str = "prompt", seeds: int = 3) -> DataFrame:
        """(query, ident, chunk_id, relation): one hop from the first chunks of each prompt."""
        first = self.candidates(prompts, query, prompt).filter(F.col("rank") < seeds).select(query, "chunk_id", "rank")
        down = expand.callees(first, self.refs, self.defs, query).withColumn("relation", F.lit("defines"))
        return down.unionByName(expand.callers(first, self.refs, self.defs, query).withColumn("relation", F.lit("uses")))

    def find(self, name: str) -> DataFrame:
        """(chunk_id, line, body, in_file): lines of chunks that hold a name."""
        return lookup.name_lines(self.chunks, "chunk_id", name)


DEFAULT_SCORER = LexicalScorer()
