"""Long arrays in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluier.functions.spans import blocks, let


def stretches(text: Column, spans: Column) -> Column:
    """The parts of a text at spans (start, end), which are sorted and don't overlap. Each block's stretch is taken from the text once."""

    def of(b: Column) -> Column:
        first = b[0]["start"]
        own = F.substring(text, first + 1, F.element_at(b, -1)["end"] - first)
        return let(own, lambda o: F.transform(b, lambda s: F.substring(o, s["start"] - first + 1, s["end"] - s["start"])))

    return F.flatten(F.transform(blocks(spans), of))
