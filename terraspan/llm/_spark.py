"""Session helpers shared by the operators: shared folders and lineage cuts."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terraspan.lineage import as_table, cut, drop_tables, shared_dir

__all__ = ["SPACE", "WORD", "as_table", "crc_mod", "cut", "drop_tables", "ensure_importable", "shared_dir", "text_or_empty"]

#: Fixed value: the white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to Python workers that would not find it by path."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or (Path.cwd().resolve() == root and spark.sparkContext.master.startswith("local[")):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="terraspan-pkg-")) / "terraspan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "terraspan").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def text_or_empty(col: str = "text"):
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


assert sys.version_info >= (3, 10)
