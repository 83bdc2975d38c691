"""Readers and writers for expression, survival and result tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from salience.functions.expressions import int_array
from salience.operators.scan import scan
from salience.session import cut_lineage

#: Characters of one record at most.
RECORD_CHARACTERS = 1 << 26
SURVIVAL_SCHEMA = (
    "sampleName string, survival_day double, survival_event int, ki67_status int"
)


def _fields_of(header: str) -> list[str]:
    return next(csv.reader(io.StringIO(header, newline="")))


def _fields(line: Column) -> Column:
    """Fields of a CSV line; quoted ones may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*(?:""[^"]*)*"|[^,]*)'), 1)
    plain = F.transform(found, lambda x: F.when(
        x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(x))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ","))


def _quoted(field: Column) -> Column:
    """A field as it is, or in quotes if a reader would take it apart otherwise."""
    whole = F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(field.rlike('[,"\\r\\n]'), whole).otherwise(field)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, line, value)``: the records of CSV text, which may hold line breaks in quotes.

    The text is read once and written as a table.  A line with an odd number of quotes
    opens or closes a field that goes on; how many such lines come before a line tells
    whether it lies in one.  Counts of earlier blocks of a file come through a join on
    (file, block), so no task holds a whole file.  Lines of one record are joined by a
    line feed; one of over ``RECORD_CHARACTERS`` raises an error, as its quote is not closed.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = cut_lineage(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), "value", (quotes % 2).cast("bigint").alias("odd")))
    if lines.where("odd = 1").isEmpty():
        return lines.drop("odd")
    earlier = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "at").agg(F.sum("odd").alias("n")).select(  # a row for each block
        "file", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("file", "at").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    upto = lines.join(blocks, ["file", "at"]).withColumn("upto", F.col("before") + F.sum("odd").over(inside))
    # The k-th field that goes on: its first line makes the count odd, its last one even.
    span = F.when(F.col("upto") % 2 == 1, (F.col("upto") + 1) / 2).when(F.col("odd") == 1, F.col("upto") / 2)
    placed = upto.withColumn("span", span.cast("bigint"))
    parts = F.sort_array(F.collect_list(F.struct("at", "line", "value")))
    size = F.sum(F.length("value"))
    joined = placed.where("span IS NOT NULL").groupBy("file", "span").agg(
        F.when(size > RECORD_CHARACTERS, F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))))
        .otherwise(parts).alias("parts"))
    return placed.where("span IS NULL").select("file", "at", "line", "value").unionByName(joined.select(
        "file", F.get("parts", F.lit(0))["at"].alias("at"), F.get("parts", F.lit(0))["line"].alias("line"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))


def _parse(records: DataFrame, slots: Column) -> DataFrame:
    """Records to samples; ``slots`` tells for each feature its place among the cells, or -1."""
    fields = F.col("_fields")
    cells = records.select(_fields(F.col("value")).alias("_fields"), slots.alias("_slots")).select(
        F.get(fields, F.lit(0)).alias("sample_id"),
        F.get(fields, F.lit(1)).cast("double").cast("int").alias("output"),
        F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(1))).alias("_cells"), "_slots",
    )
    return cells.select(
        "sample_id",
        "output",
        F.transform(
            "_slots",
            lambda i: F.when(i >= 0, F.nullif(F.get(F.col("_cells"), i), F.lit(""))).cast("double"),
        ).alias("features"),
    )


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [(i, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature_id int, feature_name string")


def read_wide_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One wide CSV: ``(samples, features_dim)``.

    The first column is the sample id and the next the label, whatever it is
    called.  Fields may be quoted and then hold commas, quotes and line breaks.
    Records are split into an array, so a header with many thousand columns never
    becomes a schema.
    """
    return read_csv_folder(spark, path)


def read_csv_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Folder of CSV chunks, united by column name; missing cells are null.

    The first record of a file is its header.  Only the different headers come to
    the driver; with several, each file's places of the features come through a join
    on the file.
    """
    records = _records(spark, folder).where(F.length("value") > 0)
    heads = cut_lineage(records.where(F.col("at") == 0).groupBy("file").agg(
        F.min_by("value", F.struct("at", "line")).alias("header")))
    headers = [r[0] for r in heads.select("header").distinct().orderBy("header").collect()]
    own = {h: {n: i for i, n in enumerate(_fields_of(h)[2:])} for h in headers}
    names = list(dict.fromkeys(n for h in headers for n in _fields_of(h)[2:]))
    places = {h: [own[h].get(n, -1) for n in names] for h in headers}
    if len(headers) == 1:
        data = records.where(F.col("value") != headers[0])
        return _parse(data, int_array(places[headers[0]])), _names(spark, names)
    table = spark.createDataFrame(list(places.items()), "header string, slots array<int>")
    data = records.join(heads, "file").where(F.col("value") != F.col("header"))
    return _parse(data.join(table, "header"), F.col("slots")), _names(spark, names)


def write_wide_csv(samples: DataFrame, names: list[str], path: str) -> None:
    """Samples back to CSV text with a header in every file."""
    line = F.concat_ws(
        ",",
        _quoted(F.col("sample_id").cast("string")),
        F.col("output").cast("string"),
        F.array_join(F.transform("features", lambda v: v.cast("string")), ",", ""),
    )
    text = io.StringIO()
    csv.writer(text, lineterminator="").writerow(["sampleID", "output", *names])
    header = text.getvalue()

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        schema = pa.schema([("value", pa.string())]) if first is None else first.schema
        yield pa.RecordBatch.from_arrays([pa.array([header], schema.field(0).type)], schema=schema)
        if first is not None:
            yield first
            yield from batches

    # As plain text: a CSV writer would quote once more.
    samples.select(line.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def with_chunk_ids(df: DataFrame, order: str, size: Column, limit: int) -> DataFrame:
    """Add ``chunk_id``: rows in order, cut at every multiple of ``limit``.

    ``size`` is the row's character count.  A row belongs to the chunk its
    first character falls into.
    """
    sized = df.select("*", size.cast("bigint").alias("_size"))
    placed = scan(sized, [], order, {"_upto": ("sum", F.col("_size"))})
    before = F.col("_upto") - F.col("_size")
    return placed.withColumn("chunk_id", F.floor(before / F.lit(limit))).drop("_upto", "_size")


def field_characters(columns: list[str]) -> Column:
    """Characters of all fields of a row, separators not counted."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
    return total


def split_csv(df: DataFrame, order: str, folder: str, max_size: float = 15) -> None:
    """Write ``chunk_id=<n>`` folders of at most about ``max_size`` MiB each."""
    limit = int(max_size * 1024 * 1024)
    chunks = with_chunk_ids(df, order, field_characters(df.columns), limit)
    chunks.write.mode("overwrite").partitionBy("chunk_id").option("header", True).csv(folder)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def read_survival(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SURVIVAL_SCHEMA).option("header", True).csv(path)


def write_sweep(sweep: DataFrame, path: str) -> None:
    """Sweep curves ``(model, num_features, auroc, auprc)``, one folder per model."""
    sweep.write.mode("overwrite").partitionBy("model").parquet(path)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Typed sink: csv, json (maps and structs) or parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported table format {kind!r}")
    writer = df.write.mode("overwrite").format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(path)


def load_table(
    spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None
) -> DataFrame:
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported table format {kind!r}")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def store_observed(samples: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write samples as Parquet together with each row's number of features, and count them.

    Returns the written table and ``n_rows`` and ``n_columns`` (0 without rows).  The
    input is read once; the counts read one run-length encoded column of what was
    written.  (An ``Observation`` would leave the session in a state in which closures of
    MLlib models can no longer be shipped, so none is used.)
    """
    samples.withColumn("_width", F.size("features")).write.parquet(path)
    written = samples.sparkSession.read.parquet(path)
    seen = written.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max("_width"), F.lit(0)).alias("n_columns")).first()
    return written.drop("_width"), seen.asDict()


def _create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty marker; False if it is there already.  One of several callers gets True.

    A file system decides this itself on creation without overwriting; for local
    folders, whose Hadoop wrapper looks first and creates later, the operating system
    does.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    if files.getScheme() == "file":
        return jvm.java.io.File(place.toUri().getPath()).createNewFile()
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def claim_run(spark: SparkSession, path: str, model: str) -> int:
    """A run number of a model that no other writer of the store gets.

    The first number that neither stored runs nor markers hold is claimed by creating
    its marker; whoever comes second takes the next one.  Markers lie in a folder that
    readers of the store do not see.  A claimed number that is never written stays unused.
    """
    name = quote(model, safe="")
    number = next_run_id(spark, path, model)
    while not _create_new(spark, f"{path}/_claims/{name}/{number}"):
        number += 1
    return number


def next_run_id(spark: SparkSession, path: str, model: str) -> int:
    """First unused run number of a model in the run store."""
    from pyspark.errors import AnalysisException

    try:
        used = spark.read.parquet(path).where(F.col("model") == model)
    except AnalysisException:
        return 1
    last = used.agg(F.max("run_id")).first()[0]
    return 1 if last is None else int(last) + 1


def append_runs(importance: DataFrame, path: str) -> None:
    """Append importance runs; one folder per (model, run, metric)."""
    keys = ["model", "run_id", "metric"]
    importance.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("model", "run_id", "metric", "feature_id", "diff")
