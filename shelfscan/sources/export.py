"""Scan a long-format survey export and prepare it.

The export arrives as CSV or Parquet files (the binary spreadsheet is
converted upstream).  Everything is read as text, the header is trimmed and
lower-cased, and the row order of the file becomes ``src_ordinal`` because
"first row wins" / "last answer wins" semantics depend on it.

A CSV field in quotes may hold line feeds.  Where a file has such fields, its
lines are put together to records before they are parsed: the number of quotes
before a line tells whether it begins inside a field.  That number is added up
over the cluster (see ``operators.scan``), so that a large file stays split.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clean_float, clean_text, excel_serial_of, parse_dateid, parse_excel_serial
from ..operators.scan import prefix_count
from .schema import EXPORT_HEADER, SOURCE_SCHEMA

FILE_SLOT = 1 << 40  # room for row positions inside one file
BROADCAST_FILES = 100_000  # files whose ranks are broadcast; those of more are joined as Spark sees fit
_EMPTY_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*):///"
_NO_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)"
LINES_AT_ONCE = 1 << 16  # lines of a file whose quotes are added up in one group


def norm_header(df: DataFrame) -> DataFrame:
    """Trim + lower-case column names (metadata only)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _with_ordinal(spark: SparkSession, df: DataFrame, fmt: str, ordinal_col: str | None) -> DataFrame:
    """Attach ``src_ordinal`` = file rank * 2^40 + position in file.

    Position is the Parquet row index, or for text formats the byte offset of
    the split plus the row number inside the split (monotone and unique within
    a file).  File rank follows the sorted file names; the file list is
    metadata, bounded by the number of files of one export.
    """
    if ordinal_col and ordinal_col in df.columns:
        return df.withColumn("src_ordinal", F.col(ordinal_col).try_cast("bigint"))
    # inputFiles() and _metadata.file_path spell empty URI authorities
    # differently (file:///x vs file:/x): each file is listed in both spellings.
    files = sorted(re.sub(_EMPTY_AUTHORITY, r"\1:/", f) for f in df.inputFiles())
    ranks = spark.createDataFrame([(s, i) for i, f in enumerate(files) for s in {f, re.sub(_NO_AUTHORITY, r"\1:///", f)}],
                                  "file_path string, file_rank bigint")
    if fmt == "parquet":
        pos = F.col("_metadata.row_index")
    else:
        local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
        pos = F.col("_metadata.file_block_start") + local
    tagged = df.select("*", F.col("_metadata.file_path").alias("file_path"), pos.alias("_pos"))
    # two rows at most per input file: broadcast while that is known to be small
    tagged = tagged.join(F.broadcast(ranks) if len(files) <= BROADCAST_FILES else ranks, "file_path", "left")
    return (tagged.withColumn("src_ordinal", F.col("file_rank") * F.lit(FILE_SLOT) + F.col("_pos"))
            .drop("file_path", "file_rank", "_pos"))


def balance_partitions(df: DataFrame) -> DataFrame:
    """Spread an under-split input over the cluster.

    A delivery can arrive as one unsplittable file (a gzipped CSV, a Parquet
    file with a single row group): then one task would carry every step of the
    run.  When the scan has fewer partitions than the default parallelism the
    rows are spread round-robin; row order is carried by ``src_ordinal``, so
    nothing depends on partition order afterwards.  A large input already has
    more splits than cores and is left as it is (no extra shuffle).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def _inside_quotes(line: str, quote: str, escape: str) -> F.Column:
    """Whether a line has an odd number of quotes: it opens or closes a field that goes on over lines.

    A doubled quote counts twice; one after an escape character of another
    kind does not count.  Quotes stand only around and, escaped, in fields.
    """
    text = F.col(line)
    if escape and escape != quote:
        text = F.when(F.contains(text, F.lit(escape)), F.regexp_replace(text, re.escape(escape) + "(?s:.)", "")).otherwise(text)
    return (F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))) % 2 == 1


def _csv_records(spark: SparkSession, path, options: dict) -> DataFrame | None:
    """Whole records of CSV files, without each file's first, and ``src_ordinal`` of their first lines.

    None if every record is one line.  Only the lines of longer records are
    grouped.
    """
    quote, escape = options.get("quote", '"'), options.get("escape", "\\")
    if not quote:
        return None
    text = spark.read.format("text").option("lineSep", "\n")
    for k in ("encoding", "pathGlobFilter", "recursiveFileLookup"):
        if k in options:
            text = text.option(k, options[k])
    source = text.load(path)
    lines = _with_ordinal(spark, source, "text", None).withColumn("_odd", _inside_quotes("value", quote, escape))
    if not lines.select("_odd").filter("_odd").limit(1).count():
        return None
    # an ordinal's upper part is its file
    lines = lines.withColumn("_file", F.shiftright("src_ordinal", FILE_SLOT.bit_length() - 1))
    firsts = lines.groupBy("_file").agg(F.min("src_ordinal").alias("_first"))
    ended = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    lines = prefix_count(lines, ["_file"], "src_ordinal", "_odd", "_quotes", LINES_AT_ONCE).withColumn("value", ended)
    alone = ~F.col("_odd") & (F.col("_quotes") % 2 == 0)
    # a record of several lines opens with an odd line after an even number of
    # such, and goes on to the next odd one
    longer = (lines.filter(~alone).groupBy("_file", F.floor(F.col("_quotes") / 2))
              .agg(F.sort_array(F.collect_list(F.struct("src_ordinal", "value"))).alias("l")))
    records = lines.filter(alone).select("_file", "src_ordinal", "value").unionByName(
        longer.select("_file", F.element_at("l", 1)["src_ordinal"].alias("src_ordinal"), F.array_join("l.value", "\n").alias("value")))
    few = len(source.inputFiles()) <= BROADCAST_FILES
    return records.join(F.broadcast(firsts) if few else firsts, "_file").filter(F.col("src_ordinal") > F.col("_first"))


def _parsed_records(spark: SparkSession, records: DataFrame, header: list[str], options: dict) -> DataFrame:
    """Fields of the records by the header."""
    known = {k: v for k, v in options.items() if k in ("sep", "delimiter", "quote", "escape", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace",
                                                     "ignoreTrailingWhiteSpace", "charToEscapeQuoteEscaping")}
    body = records.filter(F.trim("value") != "")
    fields = F.from_csv("value", _ddl(header), {k: str(v) for k, v in known.items()})
    return body.select("src_ordinal", fields.alias("f")).select("src_ordinal", "f.*")


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def scan_export(spark: SparkSession, path: str | list[str], fmt: str = "csv",
                options: dict | None = None, ordinal_col: str | None = None) -> DataFrame:
    """Read the export once, all columns as text, plus ``src_ordinal``."""
    options = dict(options or {})
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false").option("multiLine", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    records = _csv_records(spark, path, options) if fmt == "csv" else None
    if records is not None:
        df = _parsed_records(spark, records, df.columns, options)
        if ordinal_col and ordinal_col in df.columns:
            df = df.withColumn("src_ordinal", F.col(ordinal_col).try_cast("bigint"))
    else:
        df = balance_partitions(_with_ordinal(spark, df, fmt, ordinal_col))  # needs the scan's own partitions
    return prepare_source(norm_header(df))


def prepare_source(df: DataFrame) -> DataFrame:
    """Raw export columns -> canonical prepared source (see SOURCE_SCHEMA).

    Text stays raw (each builder cleans what it uses); ``dateid`` and the
    ``responsedate`` day serial are parsed, bad values become null; GPS text
    becomes DECIMAL(10,6).
    """
    types = dict(df.dtypes)
    cols = []
    for raw, canon in EXPORT_HEADER.items():
        target = next(f.dataType for f in SOURCE_SCHEMA.fields if f.name == canon)
        if raw not in types:
            cols.append(F.lit(None).cast(target).alias(canon))
            continue
        c, t = F.col(raw), types[raw]
        if raw == "dateid":
            if t == "date":
                v = c
            elif t in ("double", "float") or t.startswith("decimal"):
                v = parse_dateid(c.try_cast("bigint").cast("string"))
            else:
                v = parse_dateid(c.cast("string"))
        elif raw == "responsedate":
            if t.startswith("timestamp"):
                v = c.cast("timestamp_ntz")
            else:
                v = parse_excel_serial(c.cast("string"))
        elif raw in ("latitude", "longitude"):
            v = (c if t != "string" else clean_float(c)).try_cast(target)
        elif raw == "year":
            v = (clean_text(c) if t == "string" else c).try_cast("int")
        else:
            v = c.cast("string")
        cols.append(v.alias(canon))
    return df.select(F.col("src_ordinal").cast("bigint").alias("src_ordinal"), *cols).select(*SOURCE_SCHEMA.names)


def export_rows(src: DataFrame) -> DataFrame:
    """Prepared rows as an export's texts under its header, with ``src_ordinal``."""
    texts = {"visit_date": F.date_format("visit_date", "yyyyMMdd"), "responsedate": F.format_string("%.12f", excel_serial_of("responsedate"))}
    return src.select("src_ordinal", *[texts.get(canon, F.col(canon).cast("string")).alias(raw) for raw, canon in EXPORT_HEADER.items()])
