"""Table functions for SQL: spans of a pattern, and spans of a detector of the user's. They are called with LATERAL.

`register(spark)` makes `scan_spans(text, pattern)` known; `register_detector(spark, name, detect)` makes a function of that name from a
detector. In plans, the column functions (sluier.functions.spans.scan, sluier.operators.names.model_spans) do the same without a Python row each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SPAN = "start int, end int, text string"


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


class _ScanSpans:
    """(start, end, text) of all matches of a pattern in a text, leftmost first, not overlapping; groups with names are columns of their own.

    The pattern must be the same for all rows, since it tells the columns. A null text has no matches.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if pattern.value is None:
            raise ValueError("the pattern must be a constant")
        named = [T.StructField(name, T.StringType()) for name in re.compile(pattern.value).groupindex]
        return AnalyzeResult(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), *named]))

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        for m in _compiled(pattern).finditer(text or ""):
            if m[0]:
                yield (m.start(), m.end(), m[0], *(m[name] for name in m.re.groupindex))


def register(spark: SparkSession) -> None:
    spark.udtf.register("scan_spans", udtf(_ScanSpans, useArrow=True))


def register_detector(spark: SparkSession, name: str, load: Callable[[], Callable[[str], Iterable[dict]]]) -> None:
    """A table function name(text) with (start, end, label) of a detector. load() makes the detector, once for each task: a model is loaded there."""

    class Detector:
        def __init__(self) -> None:
            self.detect = load()

        def eval(self, text: str) -> Iterator[tuple]:
            for s in self.detect(text or ""):
                yield s["start"], s["end"], s["label"]

    spark.udtf.register(name, udtf(Detector, returnType="start int, end int, label string", useArrow=True))
