"""Fixed-width text by a layout table, as one projection over the lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = ("TEXTO", "INTEIRO")


@dataclass(frozen=True)
class Field:
    name: str
    start: int
    end: int
    kind: str = "TEXTO"
    declared: int | None = None

    @property
    def size(self) -> int:
        return self.end - self.start + 1


def check_layout(layout: list[Field]) -> int:
    """The record's width; positions must be contiguous from 1, sizes and types as declared."""
    at = 1
    for f in layout:
        if f.kind not in KINDS:
            raise ValueError(f"{f.name} has the unknown type {f.kind}")
        if f.declared is not None and f.declared != f.size:
            raise ValueError(f"{f.name} is said to have {f.declared} characters but has {f.size}")
        if f.start != at or f.end < f.start:
            raise ValueError(f"the layout isn't contiguous at {f.name}")
        at = f.end + 1
    return at - 1


def slice_lines(lines: DataFrame, layout: list[Field], column: str = "value") -> DataFrame:
    """The fields of each line and ``problema``: LARGURA for a line of another width, TRUNCADO if it is
    shorter and the last of its file (``ultima``, where that is known), TIPO for text other than
    digits in a number's field."""
    width = check_layout(layout)
    value = F.regexp_replace(column, r"\r\z", "")
    part = {f.name: F.substring(value, f.start, f.size) for f in layout}
    short = (F.length(value) < width) & (F.col("ultima") if "ultima" in lines.columns else F.lit(False))
    wrong = F.lit(False)
    for f in layout:
        if f.kind == "INTEIRO":
            wrong = wrong | ~part[f.name].rlike(r"\A *[0-9]* *\z")
    why = F.when(short, "TRUNCADO").when(F.length(value) != width, "LARGURA").when(wrong, "TIPO")
    return lines.select(*[c.alias(n) for n, c in part.items()], why.alias("problema"))


def read_fixed_width(spark: SparkSession, path: str, layout: list[Field], encoding: str = "ISO-8859-1") -> DataFrame:
    """Reads a file through the CSV source (for its encodings) without splitting lines."""
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("value string").csv(path)
    return slice_lines(lines, layout)
