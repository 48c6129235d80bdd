"""Table functions for SQL: ``SELECT * FROM documents, LATERAL split_blocks(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="idx int, block_id string, char_start int, char_end int, block string")
class SplitBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        from lakeweave.operators.segments import block_id, block_spans

        for n, (s, e) in enumerate(block_spans(text or ""), 1):
            yield n, block_id(n, text[s:e]), s, e, text[s:e]


@udtf(returnType="idx int, paragraph string")
class Paragraphs:
    def eval(self, text: str) -> Iterator[tuple]:
        from lakeweave.operators.segments import paragraphs

        yield from enumerate(paragraphs(text or ""))


@udtf(returnType="idx int, char_start int, char_end int, chunk string")
class Chunks:
    def eval(self, text: str) -> Iterator[tuple]:
        from lakeweave.operators.documents import chunk_spans

        for n, (_, _, start, body) in enumerate(chunk_spans(text or "")):
            yield n, start, start + len(body), body


@udtf(returnType="json_path string, member string, kind string")
class JsonNodes:
    def eval(self, text: str) -> Iterator[tuple]:
        from lakeweave.operators.nested import kind_of, parse_object, walk

        root = parse_object(text)
        for node in walk(root) if root is not None else ():
            yield node.path(), node.member, kind_of(node.value) or "null"


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, f in (("split_blocks", SplitBlocks), ("paragraphs", Paragraphs), ("chunks", Chunks), ("json_nodes", JsonNodes)):
        spark.udtf.register(name, f)
