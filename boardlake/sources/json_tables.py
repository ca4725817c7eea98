"""Nested JSON -> flat columns and relational child tables.

Only the *schema* is walked on the driver; all rows stay in Spark.  Lists are exploded for
every row (not just the first one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, explode_lists: bool = True, sep: str = "_") -> DataFrame:
    """Spread structs into ``parent_field`` columns until none remain; explode arrays of structs."""
    while True:
        fields = df.schema.fields
        struct_cols = [f for f in fields if isinstance(f.dataType, T.StructType)]
        list_cols = [f for f in fields if explode_lists and isinstance(f.dataType, T.ArrayType)
                     and isinstance(f.dataType.elementType, T.StructType)]
        if not struct_cols and not list_cols:
            return df
        if list_cols:
            f = list_cols[0]
            df = df.withColumn(f.name, F.explode_outer(f.name))
            continue
        cols = []
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{c.name}`").alias(f"{f.name}{sep}{c.name}") for c in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)


def json_to_relational(df: DataFrame, json_col: str, schema: str | T.StructType, id_field: str) -> dict[str, DataFrame]:
    """Parse a JSON column and split it into one table per nested level.

    The root table keeps the scalar fields and ``id_field``.  Every array becomes a child table with the root id, the
    path of positions of its parents (``_path``; a child's own position is its last element and ``_pos``) and the
    child's scalar fields, or ``value`` for an array of scalars.  Empty and null arrays give no rows.
    """
    parsed = df.select(F.col(id_field).alias("_parent_id"), F.array().cast("array<int>").alias("_path"), F.from_json(F.col(json_col), schema).alias("_j"))
    st = parsed.schema["_j"].dataType
    tables: dict[str, DataFrame] = {}

    def walk(frame: DataFrame, stype: T.StructType, name: str, prefix: str) -> None:
        scalars = [f for f in stype.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
        place = ["_path", "_pos"] if "_pos" in frame.columns else []
        tables[name] = frame.select("_parent_id", *place, *[F.col(f"{prefix}.`{f.name}`").alias(f.name) for f in scalars])
        for f in stype.fields:
            if isinstance(f.dataType, T.ArrayType):
                child = (frame.select("_parent_id", "_path", F.posexplode(F.col(f"{prefix}.`{f.name}`")).alias("_pos", "_c"))
                         .withColumn("_path", F.concat("_path", F.array("_pos"))))
                if isinstance(f.dataType.elementType, T.StructType):
                    walk(child, f.dataType.elementType, f"{name}_{f.name}", "_c")
                else:
                    tables[f"{name}_{f.name}"] = child.withColumnRenamed("_c", "value")
            elif isinstance(f.dataType, T.StructType):
                walk(frame, f.dataType, f"{name}_{f.name}", f"{prefix}.`{f.name}`")

    walk(parsed, st, "root", "_j")
    return tables
