"""Bounded samples of labelled documents for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, y): at most per_class documents of each label, those with the least hashed ids.

    Only rows whose crc32(id as text) mod 5 is not 0 and whose label is 0 or 1. The ids are
    chosen from the label table alone (2 * per_class rows at most, which may be broadcast).
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col(label).isin(0, 1)).select(id_col, F.col(label).cast("int").alias("y"))
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    return docs.select(id_col, text_col).join(F.broadcast(parts[0].unionByName(parts[1])), id_col)
