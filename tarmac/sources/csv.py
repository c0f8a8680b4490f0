"""Raw on-time CSV ingest.

* Discovery is Spark's own recursive file listing (``recursiveFileLookup`` +
  ``pathGlobFilter``); nothing lists files on the driver's local disk.
* Files whose headers differ are read in separate groups and unioned by
  name: a single CSV read maps columns by position, so mixed header orders
  would swap values (D15).
* Every column is read as text, then NA tokens -> null, strip, and guarded
  casts; bad values become null instead of failing the job.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import nullcontext
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.coerce import integral, no_na_token, not_integral, strip, stripped_to_date, to_double
from ..schemas import COLUMN_ALIASES, RAW_COLUMNS
from ..session import materialize


#: Bytes of a file read at once for its header.
HEADER_BLOCK = 1 << 16
_LINE_ENDS = re.compile(rb"\r\n|\n|\r(?!\Z)")


class IngestError(ValueError):
    pass


def _below(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Every ``*.csv`` below ``root`` (S1) by one of Spark's file sources; error if the root is missing."""
    try:
        return spark.read.format(source).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise IngestError(f"CSV root not found: {root}") from e
        raise


def csv_lines(spark: SparkSession, root: str) -> DataFrame:
    return _below(spark, root, "text")


def csv_files(spark: SparkSession, root: str) -> DataFrame:
    """The files themselves; only columns that are selected are read, so ``path`` costs a listing."""
    return _below(spark, root, "binaryFile")


def normalize_header(name: str) -> str:
    """Strip + upper (S3)."""
    return name.strip().upper()


def first_line(stream, block: int = HEADER_BLOCK) -> str | None:
    """The first line with text of a byte stream, without its end and a byte order mark; reads blocks only up to its end."""
    text, more = b"", True
    while more:
        got = stream.read(block)
        text, more = text + got, bool(got)
        lines = _LINE_ENDS.split(text)
        for line in lines if not more else lines[:-1]:
            line = line.decode("utf-8", "replace").removeprefix("\ufeff").rstrip()
            if line.strip():
                return line
        text = lines[-1]
    return None


def open_file(path: str):
    """A byte stream of a file as Spark names it (``file:/a b``, ``s3a://bucket/key``); None for a scheme that Arrow does not know."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    try:
        files, at = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@=+,"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    return files.open_input_stream(at, compression=None)


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, headers, opened = b.column("path").to_pylist(), [], []
        for p in paths:
            stream = open_file(p)
            opened.append(stream is not None)
            with stream or nullcontext():
                headers.append(first_line(stream) if stream else None)
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "header": pa.array(headers, pa.string()), "opened": pa.array(opened, pa.bool_())})


def header_lines(spark: SparkSession, root: str) -> DataFrame:
    """``path, header`` of every file that has a line with text, written once.

    The files are listed without their content, and a task reads the first block of each of its files (S2): the bytes read do not grow with
    the files' length.  Where Arrow cannot open the scheme, the lines are scanned by Spark instead.
    """
    files = csv_files(spark, root).select("path")
    found = materialize(files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_read_headers, "path string, header string, opened boolean"), "csv-headers")
    if found.where("NOT opened").isEmpty():
        return found.where("header IS NOT NULL").select("path", "header")
    first = (csv_lines(spark, root).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
             .select(F.col("_metadata.file_path").alias("path"), F.struct(F.monotonically_increasing_id().alias("at"), "value").alias("line"))
             .groupBy("path").agg(F.min("line").getField("value").alias("header")))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return materialize(first.select(path.alias("path"), F.rtrim(F.regexp_replace("header", "\r$|^\ufeff", "")).alias("header")), "csv-headers")


def header_groups(spark: SparkSession, root: str) -> dict[str, list[str] | None]:
    """Distinct header lines with the files that have each (D15); error if there is no file.

    A single header gives no file list, as the root is then read as it is; the paths of files reach
    the driver only where layouts differ.
    """
    first = header_lines(spark, root)
    headers = [r["header"] for r in first.select("header").distinct().orderBy("header").collect()]
    if not headers:
        raise IngestError(f"No CSV files under {root}")
    if len(headers) == 1:
        return {headers[0]: None}
    return {h: [r["path"] for r in first.where(F.col("header") == h).orderBy("path").collect()] for h in headers}


def _rename(df: DataFrame) -> DataFrame:
    """Normalised headers + alias renames when the canonical name is absent."""
    df = df.toDF(*[normalize_header(c) for c in df.columns])
    aliases = {normalize_header(k): v for k, v in COLUMN_ALIASES.items()}
    for src, dst in aliases.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def ensure_columns(df: DataFrame, source: str = "") -> DataFrame:
    """Require, add null optionals, drop extras, fix order."""
    missing = [c for c, (req, _) in RAW_COLUMNS.items() if req and c not in df.columns]
    if missing:
        raise IngestError(f"{source}: missing required columns {missing}")
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS]
    extra = ["SOURCE_FILE"] if "SOURCE_FILE" in df.columns else []
    return df.select(*cols, *extra)


_NUMBERS = [c for c, (_, t) in RAW_COLUMNS.items() if not isinstance(t, (T.StringType, T.DateType))]
_INTEGERS = [c for c in _NUMBERS if isinstance(RAW_COLUMNS[c][1], (T.ByteType, T.ShortType, T.IntegerType))]


def _parsed(df: DataFrame) -> DataFrame:
    """Text -> NA tokens null, stripped; numbers as doubles of any width.

    Each step is a projection of its own, as the next one reads a value several times: in one expression the copies of a
    copy made code that Java could not compile.
    """
    text = [c for c in RAW_COLUMNS if c in df.columns]
    df = df.withColumns({c: strip(c) for c in text})
    df = df.withColumns({c: no_na_token(F.col(c)) for c in text})
    return df.withColumns({c: to_double(c) for c in _NUMBERS if c in df.columns})


def _typed(parsed: DataFrame) -> DataFrame:
    """:func:`_parsed` rows -> declared types."""
    cols = []
    for c, (_, t) in RAW_COLUMNS.items():
        if isinstance(t, T.DateType):
            cols.append(stripped_to_date(F.col(c)).alias(c))
        elif c in _INTEGERS:
            cols.append(integral(F.col(c), t).alias(c))
        else:
            cols.append(F.col(c))          # flight numbers stay raw text (D10)
    rest = [c for c in parsed.columns if c not in RAW_COLUMNS]
    return parsed.select(*cols, *rest)


def coerce_types(df: DataFrame) -> DataFrame:
    """Text -> declared types with NA tokens -> null, strip, guarded casts."""
    return _typed(_parsed(df))


def _violations(parsed: DataFrame) -> list[Column]:
    return [F.count_if(not_integral(F.col(c))).alias(c) for c in _INTEGERS if c in parsed.columns]


def integral_violations(df_text: DataFrame) -> DataFrame:
    """Per integer column: count of numeric but non-integral values."""
    parsed = _parsed(df_text)
    return parsed.agg(*_violations(parsed))


def read_raw_csv(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Raw CSV tree -> typed rows with ``SOURCE_FILE``.

    ``strict`` raises on non-integral values in integer columns (D7): the typed rows are written, and counted in the job that writes
    them, so that the text is read and parsed once.
    """
    frames = []
    for header, paths in header_groups(spark, root).items():
        names = next(csv.reader([header]))
        schema = T.StructType([T.StructField(h, T.StringType()) for h in names])
        reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", True).schema(schema)
        if paths is None:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        df = reader.csv(root if paths is None else paths).withColumn("SOURCE_FILE", F.col("_metadata.file_name"))
        frames.append(ensure_columns(_rename(df), source=f"files with header {names[:4]}..."))
    text = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not strict:
        return coerce_types(text)
    parsed, seen = _parsed(text), Observation("violations")
    typed = materialize(_typed(parsed.observe(seen, *_violations(parsed))), "typed")
    bad = {k: v for k, v in seen.get.items() if v}
    if bad:
        raise IngestError(f"non-integral values in integer columns: {bad}")
    return typed
