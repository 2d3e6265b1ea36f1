"""Table functions that SQL text calls: what a keyword is searched as, and clusters of candidate queries.

Both take a table argument, of any columns, and say their result's columns when a query is analyzed, so a wrong column is an error of the query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType


def _column(table: AnalyzeArgument, name: AnalyzeArgument) -> str:
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    if not isinstance(name.value, str) or name.value not in table.dataType.fieldNames():
        raise ValueError(f"no column {name.value!r} in {', '.join(table.dataType.fieldNames())}")
    return name.value


def search_texts(text: str) -> Iterator[str]:
    """The text, the value of "column = value", and both sides of every space, each once and none empty."""
    whole = text.strip(" ")
    found = [whole, *([text.split("=", 1)[1].strip(" ")] if "=" in text else [])]
    for i, c in enumerate(whole):
        if c == " ":
            found += [whole[:i].strip(" "), whole[i + 1 :].strip(" ")]
    yield from (x for x in dict.fromkeys(found) if x)


class SearchPackets:
    """search_packets(TABLE(...), 'column') -> keyword, substring."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        _column(table, column)
        return AnalyzeResult(StructType().add("keyword", StringType()).add("substring", StringType()))

    def eval(self, table: Row, column: str):
        if table[column] is not None:
            for part in search_texts(table[column]):
                yield table[column], part


class ResultClusters:
    """result_clusters(TABLE(...), 'question', 'ord', 'digest') -> question, ord, cluster_size, cluster_first of the candidates of each question, as texts and
    numbers: those of one digest are a cluster, and so are those without one. A question's candidates are few; each is one partition."""

    @staticmethod
    def analyze(table: AnalyzeArgument, question: AnalyzeArgument, ord: AnalyzeArgument, digest: AnalyzeArgument) -> AnalyzeResult:
        by, _, _ = (_column(table, x) for x in (question, ord, digest))
        schema = StructType().add("question", StringType()).add("ord", IntegerType()).add("cluster_size", IntegerType()).add("cluster_first", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(by)])

    def __init__(self) -> None:
        self.held: list[tuple[str, int, str | None]] = []

    def eval(self, table: Row, question: str, ord: str, digest: str) -> None:
        self.held.append((str(table[question]), int(table[ord]), table[digest]))

    def terminate(self):
        sizes = Counter(d for _, _, d in self.held)
        first: dict[str | None, int] = {}
        for _, place, d in self.held:
            first[d] = min(place, first.get(d, place))
        for name, place, d in self.held:
            yield name, place, sizes[d], first[d]


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL text of the session."""
    spark.udtf.register("search_packets", udtf(SearchPackets))
    spark.udtf.register("result_clusters", udtf(ResultClusters))
