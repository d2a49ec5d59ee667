"""Readers and writers of the layers: CSV with declared columns, files of many kinds with their origin, JSON of web services,
exports, appends and resumable sinks. Every path is one that Spark reads and writes; nothing is opened on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from windrose.functions.clean import no_missing_words

# What stands for missing in exported text, and the words that readers of the layers take as missing.
EXPORTED_NULL = "N/A"
EXPORT_WORDS, REPORT_WORDS = ("", "N/A", "nan"), ("N/A", "NA", "", "nan", "None")
BOM = "﻿"


def as_text(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | Sequence[str], words: Sequence[str] = (), header: bool = True, many_lines: bool = False) -> DataFrame:
    """CSV by a declared schema (names alone: all text); fields that are one of ``words`` are null, malformed ones too.

    Columns go by place, so a byte order mark before the first name does no harm. ``many_lines``: fields hold line ends; such
    files cannot be split among tasks.
    """
    wanted = schema if isinstance(schema, StructType) else as_text(schema)
    text = spark.read.schema(as_text(wanted.fieldNames())).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("multiLine", many_lines).option("escape", '"').csv(path if isinstance(path, str) else list(path))
    known = [F.when(F.col(f"`{f.name}`").isin(*words), None).otherwise(F.col(f"`{f.name}`")) if words else F.col(f"`{f.name}`") for f in wanted.fields]
    return text.select(*(c.alias(f.name) if isinstance(f.dataType, StringType) else c.try_cast(f.dataType).alias(f.name) for c, f in zip(known, wanted.fields, strict=True)))


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, CSV or JSON by the ending of the path."""
    ending = path.rstrip("/*").rpartition(".")[2].lower()
    if ending not in ("parquet", "csv", "json"):
        raise ValueError(f"no reader for {path}")
    if ending == "csv" and schema is not None:
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).csv(path) if ending == "csv" else reader.format(ending).load(path)


def with_origin(df: DataFrame) -> DataFrame:
    """``df``, read from files, with ``source_file``: the name of the file that each row comes from."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist, in whatever store they lie; raises if any is missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return list(paths)


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts, each with the columns of all; what a part lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def hourly_rows(body: Column, columns: Sequence[str]) -> Column:
    """An array of structs from a weather answer, an object of arrays under ``hourly``: time and the columns, by place."""
    kinds = ", ".join(["time: array<string>", *(f"{c}: array<double>" for c in columns)])
    hourly = F.from_json(body, f"struct<hourly: struct<{kinds}>>")["hourly"]
    return F.arrays_zip(*(hourly[c].alias(c) for c in ("time", *columns)))


def cached_schedule(body: Column) -> Column:
    """The map of a schedule cache: flight to its route, aircraft and the times of each date."""
    leg = "struct<std: string, atd: string, dest: string, iata: string, aircraft: string>"
    return F.from_json(body, f"map<string, struct<type: string, is_fixed: int, std: string, dest: string, iata: string, airline: string, aircraft: string, schedule: map<string, array<{leg}>>>>")


def for_export(df: DataFrame, minutes: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """``df`` as text for people: times to the minute, nulls of text and times as N/A, helper columns dropped."""
    kept = [(c, kind) for c, kind in df.dtypes if c not in drop]
    shown = [(F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd HH:mm") if c in minutes else F.col(f"`{c}`"), c, kind) for c, kind in kept]
    return df.select(*(F.coalesce(x.cast("string"), F.lit(EXPORTED_NULL)).alias(c) if kind == "string" or kind.startswith(("timestamp", "date")) else x.alias(c) for x, c, kind in shown))


def dropped(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` without the named columns, and an audit: each name in order, whether it was there, and how many values went."""
    there = [c for c in dict.fromkeys(names) if c in df.columns]
    entries = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(c in there).alias("was_there"), (F.count(f"`{c}`") if c in there else F.lit(0).cast("bigint")).alias("n_values")) for i, c in enumerate(dict.fromkeys(names))]
    audit = df.agg(F.array(*entries).alias("x")).select(F.inline("x")) if entries else df.sparkSession.createDataFrame([], "place int, column string, was_there boolean, n_values bigint")
    return df.drop(*there), audit


def first_match(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Of each pattern of paths the first that exists, by name; raises where a pattern has none."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = sorted(s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or [])
        if not found:
            raise FileNotFoundError(pattern)
        out.append(found[0])
    return out


def with_rows(df: DataFrame) -> DataFrame:
    """``df``, read from Parquet, with ``source_file`` and ``source_row``, each row's number in its file."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def write_in_order(df: DataFrame, path: str, order: Sequence[Column]) -> DataFrame:
    """Write ``df`` in one order over all its files, and read it with ``place``, each row's number in that order from 0.

    Rows are sorted by ranges, so no task holds all; a place is the number within the file after those of the files before.
    """
    df.orderBy(*order).write.parquet(path)
    rows = with_rows(df.sparkSession.read.schema(df.schema).parquet(path))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    #: One row for each file.
    files = rows.groupBy("source_file").agg(F.count("*").alias("n")).select("source_file", before.alias("_before"))
    return rows.join(files, "source_file").select(*df.columns, (F.col("source_row") + F.col("_before")).alias("place"))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header, also where there is no row; ``mark`` puts a byte order mark before the first name."""
    named = df.toDF(BOM + df.columns[0], *df.columns[1:]) if mark else df
    empty = df.isEmpty()
    (named.coalesce(1) if empty else named).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_layer(df: DataFrame, path: str, by: Sequence[str] = ("mode", "airport")) -> None:
    """Parquet in one folder for each value of ``by``; other values' folders stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def resumed(df: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], done: DataFrame | None) -> DataFrame:
    """Work on the rows whose keys the table at ``path`` has not got yet (``done``: that table), and append the results."""
    todo = df if done is None else df.join(done.select(*keys).distinct(), list(keys), "left_anti")
    append(work(todo), path)
    return df.sparkSession.read.parquet(path)


def without_words(df: DataFrame, words: Sequence[str] = EXPORT_WORDS) -> DataFrame:
    return df.select(*(no_missing_words(F.col(f"`{c}`"), [w.lower() for w in words]).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))
