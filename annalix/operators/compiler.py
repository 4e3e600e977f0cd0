"""The compiler backend as a table function: spans of a session in order go in, capsules come out one after the other."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


class Quotes:
    """Capsules of one session. A task holds the capsule that is being read and no more.

    A span counts if its event says it word for word. Null texts quote nothing; a capsule without a quote comes out with none.
    """

    def __init__(self):
        self.now: list | None = None

    def eval(self, span: Row) -> Iterator[tuple]:
        if self.now is not None and self.now[0] != span["capsule_id"]:
            yield tuple(self.now)
            self.now = None
        if self.now is None:
            self.now = [span["capsule_id"], span["session"], span["sequence"], span["sequence"], 0]
        self.now[3] = span["sequence"]
        self.now[4] += span["text"] is not None and span["content"] is not None and span["text"] in span["content"]

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield tuple(self.now)


quotes = udtf(Quotes, returnType="capsule_id string, session long, first long, last long, quotes long")


def compile_spans(spans: DataFrame) -> DataFrame:
    """(capsule_id, session, first, last, quotes) of spans (session, sequence, capsule_id, text, content), whose capsules follow each other in a session."""
    return quotes(spans.select("session", "sequence", "capsule_id", "text", "content").asTable().partitionBy("session").orderBy("sequence"))
