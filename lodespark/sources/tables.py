"""Readers and writers of the engine's files: TSV dialects, Parquet, JSON lines, band folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A"]
QUOTED = {"sep": "\t", "header": True, "multiLine": True, "quote": '"', "escape": '"'}
BARE = {"sep": "\t", "header": True, "quote": "", "escape": "\\"}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, na: bool = True, quoted: bool = True) -> DataFrame:
    """A TSV with a header. Fields may be quoted, with line ends and doubled quotes inside; or bare, with backslash
    escapes. With na, the usual spellings of a missing value are NULL; without, blanks are empty text.

    Columns are matched by the header's names; typed values that can't be parsed are NULL."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.options(**(QUOTED if quoted else BARE)).csv(path)
    have = {c.lower(): c for c in raw.columns}
    cols = []
    for f in want.fields:
        c = raw[f"`{have[f.name.lower()]}`"] if f.name.lower() in have else F.lit(None).cast("string")
        if not quoted:
            c = F.regexp_replace(c, r"\\(.)", "$1")
        if na:
            c = F.when(~c.isin(NA), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        if not isinstance(f.dataType, T.StringType):
            c = F.trim(c)
            c = F.lower(c).try_cast(f.dataType) if isinstance(f.dataType, T.BooleanType) else c.try_cast("double").cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV with all values as text and blanks as empty text."""
    return read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]), na=False)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a file, for tolerant parsing."""
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """By fmt, or else by the path's ending: .csv and .tsv as TSV, .jsonl and .json as JSON lines, others Parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    fmt = fmt or {"csv": "tsv", "tsv": "tsv", "json": "jsonl", "jsonl": "jsonl"}.get(end, "parquet")
    return {"tsv": lambda: read_tsv(spark, path, schema), "jsonl": lambda: read_jsonl(spark, path, schema), "parquet": lambda: read_parquet(spark, path)}[fmt]()


def read_bands(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All group{i}_train.tsv and group{i}_test.tsv of a folder, with band and split taken from the names. Each file's
    columns are matched by its own header's names, as by read_tsv. A folder without such files gives no rows."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "group*_t*.tsv").load(folder).select("path").collect()  # two for each band
    out = spark.createDataFrame([], T.StructType([*want.fields, T.StructField("band", T.IntegerType()), T.StructField("split", T.StringType())]))
    for path in sorted(r["path"] for r in files):
        found = re.search(r"group(\d+)_(train|test)\.tsv$", path)
        if found:
            out = out.unionByName(read_tsv(spark, path, want).withColumns({"band": F.lit(int(found[1])), "split": F.lit(found[2])}))
    return out


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep="\t", header=True, escape='"', quote='"').csv(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def append_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds files; what is there isn't read or written again."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_bands(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("band", "split").parquet(path)


def convert_jsonl(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> None:
    write_parquet(read_jsonl(spark, source, schema), target)


def last_checkpoint(names: DataFrame, numeric: bool = True) -> DataFrame:
    """The last checkpoint of (name): by the number in its name, or in alphabetical order."""
    if not numeric:
        return names.agg(F.max("name").alias("name"))
    return names.agg(F.max_by("name", F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")).alias("name"))


def layout(df: DataFrame) -> list[tuple[str, str]]:
    """(dotted name, type) of all columns and the fields nested in them, arrays of structs included."""
    def walk(t, name):
        yield name, t.simpleString()
        while isinstance(t, T.ArrayType):
            t = t.elementType
        for f in t.fields if isinstance(t, T.StructType) else []:
            yield from walk(f.dataType, f"{name}.{f.name}")

    return [x for f in df.schema.fields for x in walk(f.dataType, f.name)]
