"""Readers and writers of the file formats (S1-S8, S11-S15 of the survey). Schemas are given, never guessed."""

from __future__ import annotations

import io
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Strict: a line that isn't an object of the schema fails the read,
    else such lines come with their text in _corrupt and their file in _path."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField("_corrupt", StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_path", F.col("_metadata.file_path"))


def read_numbered_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON lines of files that fit into a task each; a line that isn't a JSON object fails the read with path:line. Blank lines are skipped."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.inline(F.transform(F.split("value", r"\r?\n"), lambda x, i: F.struct(i.alias("_line"), x.alias("_text")))))
    rows = files.where(F.trim("_text") != "")
    bad = F.try_parse_json("_text").isNull() | ~F.ltrim("_text").startswith("{")
    message = F.concat(F.col("_path"), F.lit(":"), (F.col("_line") + 1).cast("string"), F.lit(" is no JSON object"))
    text = F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("_text"))
    return rows.select(F.from_json(text, schema).alias("_row")).select(*[F.col("_row").getField(f.name).alias(f.name) for f in schema])


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file with one JSON object or array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], required: Sequence[str] = (), nonempty: bool = False) -> DataFrame:
    """CSV with a header as strings; quoted cells may hold line ends; a byte-order mark is skipped.

    The header must be the columns in order, required ones among them; nonempty refuses a file without rows.
    """
    lacking = [x for x in required if x not in columns]
    if lacking:
        raise ValueError(f"columns lack {lacking}")
    schema = StructType([StructField(x, StringType()) for x in columns])
    got = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    if nonempty and got.isEmpty():
        raise ValueError(f"no rows: {path}")
    return got


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Files of a folder and its folders as path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def read_predictions(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """All prediction files under a folder, JSON lines and CSV alike, with their path; rows without a method are skipped.

    A method, evaluation, variant and rank that occurs twice is an error, raised here: only the keys are read and counted for it.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"recursiveFileLookup": True}
    lines = spark.read.schema(schema).options(**options).option("pathGlobFilter", "*.jsonl").json(root)
    cells = spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema])).options(**options).option("pathGlobFilter", "*.csv").option("header", True).option("multiLine", True).option("escape", '"').csv(root)
    typed = cells.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if not f.dataType.simpleString().startswith("array") else F.from_json(f.name, f.dataType.simpleString()).alias(f.name) for f in schema], F.col("_metadata.file_path").alias("source_path"))
    both = lines.withColumn("source_path", F.col("_metadata.file_path")).unionByName(typed).where(F.coalesce("method", F.lit("")) != "")
    keys = [x for x in ("method", "evaluation", "variant", "search_rank") if x in schema.names]
    twice = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if found := twice.limit(1).collect():
        raise ValueError(f"a prediction occurs twice: {found[0].asDict()}")
    return both


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, null_text: str = "N/A") -> None:
    """CSV with a header, nulls as text; the commit protocol makes the job all or nothing."""
    names = list(columns or df.columns)
    flat = [F.coalesce(F.col(x).cast("string") if not t.startswith(("array", "struct", "map")) else F.to_json(x), F.lit(null_text)).alias(x) for x, t in df.select(*names).dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def compare_outputs(spark: SparkSession, expected: DataFrame, path: str) -> str:
    """MISSING, UNCHANGED or CONFLICT_DIFFERENT: a parquet output against the rows expected, repeats counted."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return "MISSING"
    there = spark.read.parquet(path)
    if sorted(there.dtypes) != sorted(expected.dtypes):
        return "CONFLICT_DIFFERENT"
    there = there.select(*expected.columns)
    return "UNCHANGED" if there.exceptAll(expected).isEmpty() and expected.exceptAll(there).isEmpty() else "CONFLICT_DIFFERENT"


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file, all of it or none: written beside its place under another name, then renamed. A file that is there is replaced."""
    fs, where = _files(spark, path)
    _, part = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(data)
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(part, where):
        fs.delete(part, False)
        raise OSError(f"could not write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file that fits into memory."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_arrays(spark: SparkSession, arrays: Mapping[str, np.ndarray], path: str) -> None:
    """Named arrays, such as a fitted model's weights, as one npz file."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    write_bytes(spark, out.getvalue(), path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False) as got:
        return {k: got[k] for k in got.files}


def inspect_outputs(spark: SparkSession, expected: Mapping[str, bytes]) -> dict[str, str]:
    """Per path of a few small outputs: MISSING, UNCHANGED, CONFLICT_DIFFERENT, or CONFLICT_NOT_FILE where something else has its name."""
    out = {}
    for path, data in expected.items():
        fs, where = _files(spark, path)
        if not fs.exists(where):
            out[path] = "MISSING"
        elif not fs.getFileStatus(where).isFile():
            out[path] = "CONFLICT_NOT_FILE"
        else:
            same = fs.getFileStatus(where).getLen() == len(data) and read_bytes(spark, path) == data
            out[path] = "UNCHANGED" if same else "CONFLICT_DIFFERENT"
    return out
