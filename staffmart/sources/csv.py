"""CSV batches in, ranked lists out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staffmart.schema import CSV_NA_TOKENS
from staffmart.session import filesystem


TORN = "quoted line break, read with multiline=True: "
HEADER_CHARS = 1 << 20  # of a header at most
READERS = 16  # files whose first bytes are read at the same time


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The files Spark would read under a file, folder or pattern, in order."""
    fs, pattern = filesystem(spark, path)
    found = []

    def visible(name: str) -> bool:
        return not name.startswith(("_", "."))

    for status in fs.globStatus(pattern) or []:
        if not status.isDirectory():
            found.append(status.getPath().toString())
            continue
        listing = fs.listFiles(status.getPath(), True)
        depth = len(status.getPath().toUri().getPath().rstrip("/").split("/"))
        while listing.hasNext():
            file = listing.next().getPath()
            if all(visible(part) for part in file.toUri().getPath().split("/")[depth:]):
                found.append(file.toString())
    return sorted(found)


def header_of(spark: SparkSession, file: str) -> str:
    """The first record of a file, read from its first bytes; line breaks inside quotes belong to it."""
    jvm = spark._jvm
    fs, path = filesystem(spark, file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(path)
    stream = fs.open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        header = reader.readLine() or ""
        while header.count('"') % 2 and len(header) < HEADER_CHARS:
            line = reader.readLine()
            if line is None:
                break
            header += "\n" + line
        return header.removeprefix("\ufeff")
    finally:
        reader.close()


def read_batch(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read a batch as text columns with the header kept verbatim; missing-value tokens become NULL.

    Files with different headers are read apart and put together by column name; a column that a file
    lacks is NULL there. Of each file the first bytes are read to know its header, then every file is scanned once. Files stay
    splittable unless ``multiline`` is set, which quoted line breaks need: without it the scan stops with ``TORN`` at a
    line that leaves a quote open. In a file of one column such a line can't be told, so those are always read whole.
    """
    files = csv_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no CSV files under {path}")
    by_header: dict[str, list[str]] = {}
    with ThreadPoolExecutor(READERS) as pool:
        for file, header in zip(files, pool.map(inheritable_thread_target(spark)(lambda f: header_of(spark, f)), files)):
            by_header.setdefault(header, []).append(file)
    parts = [read_alike(spark, group, multiline) for _, group in sorted(by_header.items(), key=lambda item: item[1])]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    return as_read(raw)


def read_alike(spark: SparkSession, files: list[str], multiline: bool) -> DataFrame:
    """Files with one header, every column as text."""
    # All headers are equal, so names go by position (Spark gives unnamed columns a name that no header has).
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("enforceSchema", True)
    names = reader.option("multiLine", True).csv(files[0]).columns  # looks at the first record of one file
    if multiline or len(names) < 2:
        return reader.option("multiLine", True).schema(StructType([StructField(n, StringType()) for n in names])).csv(files)
    # A line with too few values is handed over as a whole as well: with an open quote it is one half of a torn row.
    whole = "_line" + "_" * sum(name.startswith("_line") for name in names)
    schema = StructType([StructField(n, StringType()) for n in (*names, whole)])
    rows = reader.option("multiLine", False).option("columnNameOfCorruptRecord", whole).option("columnPruning", False).schema(schema).csv(files)
    quotes = F.length(whole) - F.length(F.replace(F.col(whole), F.lit('"'), F.lit("")))
    # The first column is named because Spark refuses to read the whole line alone.
    torn = (quotes % 2 == 1) & (F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0)
    return rows.where(F.when(torn, F.raise_error(F.concat(F.lit(TORN), F.col(whole)))).otherwise(F.lit(True))).drop(whole)


def as_read(raw: DataFrame) -> DataFrame:
    """Missing-value tokens become NULL."""
    tokens = list(CSV_NA_TOKENS)
    columns = [F.col(f"`{name}`") for name in raw.columns]
    return raw.select(
        *[F.when(~col.isin(tokens), col).alias(name) for name, col in zip(raw.columns, columns)]
    )


def write_ranked(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the whole ranked list in its order."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
