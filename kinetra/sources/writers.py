"""Sinks: metric tables, JSON forms, partitioned layouts, annotation sets, split lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ORIENTS = ("records", "split", "index", "columns", "values", "table")
# Top-level keys that a result document may have.
DOCUMENT_KEYS = ("frame_count", "dimension", "skeleton_rows", "skeleton_columns", "debug", "metrics", "stgcn_inference")


def metric_csv(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per metric; missing values are empty."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/metric={name}")


def records_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def oriented(df: DataFrame, keys: list[str], order: str, cols: list[str], orient: str = "records", block: int = 4096) -> DataFrame:
    """JSON text of each table in a pandas orientation, as (keys, text): one valid document per key.

    Texts of `block` rows each are made by many tasks and then joined up. `order` is the dense row number of a table.
    """
    if orient not in ORIENTS:
        raise ValueError(f"unsupported orient: {orient}")
    if orient == "columns":
        return _columns(df, keys, order, cols, block)
    js = {"ignoreNullFields": "false"}
    value = F.struct(*cols)
    array = F.concat(F.lit("["), F.concat_ws(",", *[_scalar(F.col(c)) for c in cols]), F.lit("]"))
    names = "[" + ",".join(f'"{c}"' for c in cols) + "]"
    at = F.col(order)
    if orient == "records":
        entry, head, tail = F.to_json(value, js), "[", "]"
    elif orient == "index":
        entry, head, tail = F.concat(F.lit('"'), at.cast("string"), F.lit('":'), F.to_json(value, js)), "{", "}"
    elif orient == "values":
        entry, head, tail = array, "[", "]"
    elif orient == "split":
        entry, head, tail = array, '{"columns":' + names + ',"data":[', "]}"
    else:
        fields = ",".join([f'{{"name":"{c}","type":"{_table_type(t)}"}}' for c, t in df.select(*cols).dtypes])
        entry, head, tail = F.to_json(value, js), '{"schema":{"fields":[' + fields + ']},"data":[', "]}"
    return _parts(df.select(*keys, at.alias("_o"), entry.alias("_e")), keys, head, tail, block)


def _scalar(c: Column) -> Column:
    """JSON text of one value."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)


def _table_type(t: str) -> str:
    return "integer" if t in ("int", "bigint", "smallint", "tinyint") else "number" if t in ("double", "float") else \
        "boolean" if t == "boolean" else "string"


def _joined(name: str) -> Column:
    """Texts of the collected (_o, name) entries in order, separated by commas."""
    return F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("_o", name))), lambda r: r[name]))


def _parts(entries: DataFrame, keys: list[str], head: str, tail: str, block: int) -> DataFrame:
    blocks = entries.groupBy(*keys, F.floor(F.col("_o") / block).alias("_b")).agg(_joined("_e").alias("_t")).withColumnRenamed("_b", "_o")
    return blocks.groupBy(*keys).agg(F.concat(F.lit(head), _joined("_t"), F.lit(tail)).alias("text"))


def _columns(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int) -> DataFrame:
    """{"col": {"row": value}}: blocks of rows of a column, then columns, then the document."""
    tall = df.select(*keys, F.col(order).alias("_o"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.lit(c).alias("_name"), _scalar(F.col(c)).alias("_v")) for i, c in enumerate(cols)])))
    entry = F.concat(F.lit('"'), F.col("_o").cast("string"), F.lit('":'), F.col("_v"))
    blocks = (tall.withColumn("_e", entry).groupBy(*keys, "_c", "_name", F.floor(F.col("_o") / block).alias("_b"))
              .agg(_joined("_e").alias("_t")).withColumnRenamed("_b", "_o"))
    columns = blocks.groupBy(*keys, "_c", "_name").agg(_joined("_t").alias("_t"))
    columns = columns.select(*keys, F.col("_c").alias("_o"), F.concat(F.lit('"'), "_name", F.lit('":{'), "_t", F.lit("}")).alias("_t"))
    return columns.groupBy(*keys).agg(F.concat(F.lit("{"), _joined("_t"), F.lit("}")).alias("text"))


def with_source(df: DataFrame, source: Column) -> DataFrame:
    """Add the source only where the rows do not have one."""
    return df if "source" in df.columns else df.withColumn("source", source)


def merged_json(parts: dict[str, DataFrame], path: str, mode: str = "by-file") -> None:
    """concat: all records with their source; by-file: one folder of records per source."""
    out = None
    for name, df in parts.items():
        df = with_source(df, F.lit(name)) if mode == "concat" else df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    w = out.write.mode("overwrite").option("ignoreNullFields", "false")
    (w if mode == "concat" else w.partitionBy("source")).json(path)


def label_layout(docs: DataFrame, path: str, evaluation: Column, fmt: str = "parquet") -> None:
    """Documents below tf=<true|false|unknown|other>/evaluation=<text>."""
    from kinetra.functions.rules import evaluation_class

    df = docs.withColumns({"tf": evaluation_class(evaluation), "evaluation": F.lower(F.coalesce(evaluation, F.lit("")))})
    df = df.withColumn("evaluation", F.when(F.col("tf").isin("true", "false"), F.col("evaluation")).otherwise(F.col("tf")))
    df.write.mode("overwrite").partitionBy("tf", "evaluation").format(fmt).save(path)


def annotation_set(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split", "label").parquet(path)


def split_lists(samples: DataFrame, path: str, rejects: DataFrame | None = None, id_: str = "id") -> None:
    """Ids per split as text, without rejected ones."""
    ids = samples.select(F.col(id_).cast("string").alias("id"), "split")
    if rejects is not None:
        ids = ids.join(rejects.select(F.col(id_).cast("string").alias("id")), "id", "left_anti")
    ids.select("id", "split").write.mode("overwrite").partitionBy("split").text(path)


def result_documents(docs: DataFrame, path: str, keys: list[str] = ()) -> None:
    """Result rows with only the allowed top-level fields."""
    docs.select(*keys, *[c for c in DOCUMENT_KEYS if c in docs.columns]).write.mode("overwrite").json(path)


def evaluation_rows(rows: DataFrame, path: str) -> None:
    rows.select("id", "gt", "pred").write.mode("overwrite").option("header", True).csv(path)
