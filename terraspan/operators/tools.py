"""The tools as functions that SQL knows by name.

Measures of columns are SQL functions, which the optimiser takes apart; what
has to look into files is a table function over any table with ``content``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: name: (parameters, type, expression, tasks, modalities).
MEASURES = {
    "normalised_difference": (
        "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a + b > 1e-6 AND (a - b) / (a + b) BETWEEN -1 AND 1 THEN (a - b) / (a + b) END", {"SCENE_INTERPRETATION"}, {"MULTISPECTRAL", "OPTICAL"},
    ),
    "luminance": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b", {"SCENE_INTERPRETATION", "BI_TEMPORAL_ANALYSIS"}, {"OPTICAL"}),
    "equivalent_looks": ("mean DOUBLE, deviation DOUBLE", "DOUBLE", "CASE WHEN deviation > 0 THEN pow(mean / deviation, 2) ELSE 1 END", {"SAR_ANALYSIS"}, {"SAR"}),
}


def _others(table: AnalyzeArgument) -> StructType:
    """The columns of a table argument besides ``content``."""
    if not table.isTable or "content" not in table.dataType.names:
        raise ValueError("a table with a column content is asked for")
    return StructType([f for f in table.dataType if f.name != "content"])


class ValidateRaster:
    """Each row with what its file's header says, instead of the content."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        out = StructType(list(_others(files)))
        for name, kind in (("format", StringType()), ("width", IntegerType()), ("height", IntegerType()), ("samples", IntegerType())):
            out = out.add(name, kind)
        return AnalyzeResult(out)

    def eval(self, row) -> Iterator[tuple]:
        from terraspan.sources.rasters import header

        h = header(None if row["content"] is None else bytes(row["content"]))
        yield *[row[c] for c in row.asDict() if c != "content"], h["kind"], h.get("width"), h.get("height"), h.get("samples")


class ReadPixels:
    """A row per pixel and band of each row's file; what can't be decoded gives
    one row with a problem."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        out = StructType(list(_others(files)))
        for name, kind in (("x", IntegerType()), ("y", IntegerType()), ("band", IntegerType()), ("value", DoubleType()), ("problem", StringType())):
            out = out.add(name, kind)
        return AnalyzeResult(out)

    def eval(self, row) -> Iterator[tuple]:
        from terraspan.sources.pixels import PART_NAMES, file_parts, part_rows

        own = [row[c] for c in row.asDict() if c != "content"]
        for part in file_parts(None if row["content"] is None else bytes(row["content"])):
            part = dict.fromkeys(PART_NAMES) | part
            for found in part_rows(part):
                if isinstance(found, str):
                    yield *own, None, None, None, None, found
                    continue
                y, x0, step, values = found
                for k, pixel in enumerate(values.tolist()):
                    for b, value in enumerate(pixel):
                        yield *own, x0 + k * step, y, (part["band"] or 0) + b, float(value), None


#: name: (table function, tasks, modalities).
TABLES = {
    "validate_raster": (ValidateRaster, {"METADATA_PROVENANCE", "SCENE_INTERPRETATION", "BI_TEMPORAL_ANALYSIS", "SAR_ANALYSIS", "OPTICAL_SAR_ANALYSIS"}, {"ALL"}),
    "read_pixels": (ReadPixels, {"SCENE_INTERPRETATION", "BI_TEMPORAL_ANALYSIS"}, {"ALL"}),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all tools known to the session; returns their names."""
    for name, (parameters, kind, body, _, _) in MEASURES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (function, _, _) in TABLES.items():
        spark.udtf.register(name, udtf(function))
    return sorted([*MEASURES, *TABLES])


def tools_for(spark: SparkSession, task: str | None = None, modality: str | None = None) -> DataFrame:
    """name, kind, tasks, modalities of the tools that serve a task and take a
    modality."""
    every = [(n, "measure", sorted(m[3]), sorted(m[4])) for n, m in MEASURES.items()] + [(n, "table", sorted(t), sorted(k)) for n, (_, t, k) in TABLES.items()]
    every = [r for r in sorted(every) if (task is None or task in r[2]) and (modality is None or modality in r[3] or "ALL" in r[3])]
    return spark.createDataFrame(every, "name string, kind string, tasks array<string>, modalities array<string>")
