"""One-hot features without a width limit: sparse vectors from joined code tables.

The categories of a column are numbered by ``fit_ordinal`` (a table, never collected); a row joins its code, and its vector
holds the numeric features first, then one place per category of each column. Width is counted, not spelled out: no
column, attribute name or driver object per category. The first sorted category, unseen values and NULL have no place (all
zeros), as in the dense form.

Vectors are written once under the shared checkpoint folder, as the struct they consist of, and read back as ML vectors:
every later fit reads that table. NULL numeric features count as 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fitloom.functions.joins import lookup_join
from fitloom.operators.encode import fit_ordinal
from fitloom.session import checkpoint_dir, keep_for_reuse

SPARSE = 0      # the type byte of a sparse vector in Spark's vector struct


class SparseOneHot:
    """Fitted code tables of ``categories`` and the places that each column takes in the vector."""

    def __init__(self, numeric: Sequence[str], tables: dict[str, tuple[DataFrame, int, int]], width: int):
        self.numeric, self.tables, self.width = list(numeric), tables, width

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the place of each category column in the vector, as ``__place0`` and so on (NULL: none)."""
        out = df
        for i, (col, (table, first, _)) in enumerate(self.tables.items()):
            code = table.select(F.col(col), F.col("code").alias(f"__code{i}"))
            out = lookup_join(out, code, col, "left")
            place = F.when(F.col(f"__code{i}") > 0, F.col(f"__code{i}") - 1 + F.lit(first)).cast("int")
            out = out.withColumn(f"__place{i}", place).drop(f"__code{i}")
        return out

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``indices`` and ``values`` of its vectors (in place of columns of these names)."""
        out = self.placed(df.drop("indices", "values"))
        places = [F.col(f"__place{i}") for i in range(len(self.tables))]
        fixed: list[Column] = [F.lit(i) for i in range(len(self.numeric))]
        hot = F.filter(F.array(*places), lambda p: p.isNotNull()) if places else F.array().cast("array<int>")
        indices = F.concat(F.array(*fixed), hot) if fixed else hot
        values = F.concat(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numeric]).cast("array<double>"),
                          F.array_repeat(F.lit(1.0), F.size(hot)))
        return out.withColumns({"indices": indices, "values": values}).drop(*[f"__place{i}" for i in range(len(self.tables))])

    def vectors(self, df: DataFrame, keep: Sequence[str], out: str = "features") -> DataFrame:
        """``keep`` and the vector column ``out`` of every row of ``df``, as a written table."""
        spark = df.sparkSession
        vector = F.struct(F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(self.width).alias("size"), "indices", "values")
        rows = self.indexed(df).select(*keep, vector.alias(out))
        path = f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        schema = StructType([*[f for f in rows.schema.fields if f.name != out], StructField(out, VectorUDT())])
        return spark.read.schema(schema).parquet(path)


def fit_sparse_one_hot(train: DataFrame, categories: Sequence[str], numeric: Sequence[str] = (), drop_first: bool = True) -> SparseOneHot:
    """Number the distinct values of each category column of ``train`` and lay out the vector."""
    tables, first = {}, len(numeric)
    for col in categories:
        codes = fit_ordinal(train, col)
        if not drop_first:
            codes = codes.withColumn("code", F.col("code") + 1)
        codes = keep_for_reuse(codes)
        n = codes.count() - (1 if drop_first else 0)
        tables[col] = (codes, first, max(n, 0))
        first += max(n, 0)
    return SparseOneHot(numeric, tables, first)
