"""Raw export files -> prepared source: header, ordinal, parsing."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfscan.functions import excel_serial_of
from shelfscan.sources import events_source, scan_export
from shelfscan.sources.schema import EXPORT_HEADER

RAW_NAMES = {v: k for k, v in EXPORT_HEADER.items()}


def raw_export(src):
    """Render prepared rows back into the text export the field tool delivers."""
    cols = []
    for canon, raw in RAW_NAMES.items():
        name = f" {raw.upper()} "  # untidy header: padded, upper case
        if canon == "visit_date":
            cols.append(F.date_format("visit_date", "yyyyMMdd").alias(name))
        elif canon == "responsedate":
            cols.append(F.format_string("%.12f", excel_serial_of("responsedate")).alias(name))
        else:
            cols.append(F.col(canon).cast("string").alias(name))
    return src.orderBy("src_ordinal").select(*cols)


def test_csv_and_parquet_export_round_trip(spark, tmp_root):
    src = events_source(spark, SF_SMALL)
    raw = raw_export(src)
    for fmt in ("csv", "parquet"):
        path = f"{tmp_root}/export_{fmt}"
        (raw.coalesce(1).write.mode("overwrite").option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .format(fmt).save(path))
        got = scan_export(spark, path, fmt)
        assert got.count() == src.count()
        # file order is kept: ordinals increase with the event id
        pairs = got.select("src_ordinal", "employee_code", "question", "response", "visit_date",
                           "latitude", "responsedate").orderBy("src_ordinal").collect()
        exp = src.select("src_ordinal", "employee_code", "question", "response", "visit_date",
                         "latitude", "responsedate").orderBy("src_ordinal").collect()
        for a, b in zip(pairs, exp):
            assert (a.employee_code, a.question, a.response, a.visit_date) == \
                (b.employee_code, b.question, b.response, b.visit_date)
            assert a.latitude == b.latitude
            assert abs((a.responsedate - b.responsedate).total_seconds()) < 1e-3
        ords = [r.src_ordinal for r in pairs]
        assert len(set(ords)) == len(ords)


def test_ordinals_follow_file_order(spark, tmp_root):
    """Rows of a later file (by name) come after every row of an earlier file."""
    src = events_source(spark, SF_SMALL)
    raw = raw_export(src)
    parts = [raw.filter(F.col(" EMPLOYEECODE ").isin("E0", "E1")), raw.filter(~F.col(" EMPLOYEECODE ").isin("E0", "E1"))]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{tmp_root}/p{i}")
        fs = jvm.org.apache.hadoop.fs.Path(tmp_root).getFileSystem(conf)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/multi"))
        f = [x for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/p{i}")) if x.getPath().getName().endswith(".csv")][0]
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/multi/export_{i}.csv"))
    got = scan_export(spark, f"{tmp_root}/multi", "csv")
    first = got.filter(F.col("employee_code").isin("E0", "E1")).agg(F.max("src_ordinal")).first()[0]
    second = got.filter(~F.col("employee_code").isin("E0", "E1")).agg(F.min("src_ordinal")).first()[0]
    assert first < second
    assert got.select("src_ordinal").distinct().count() == got.count() == src.count()


def test_answers_over_several_lines(spark, tmp_root):
    """Records whose quoted fields hold line feeds keep their order and stay one row, over files and splits."""
    src = events_source(spark, SF_SMALL)
    wrapped = src.withColumn("response", F.when(F.col("src_ordinal") % 7 == 0, F.concat(F.lit('say "yes",\n\n then '), F.col("response"), F.lit("\n")))
                             .otherwise(F.col("response")))
    path = f"{tmp_root}/lines"
    (raw_export(wrapped).repartitionByRange(3, " QUESTION ").sortWithinPartitions(" QUESTION ").write.option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    want = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits, some within a field
    try:
        got = scan_export(spark, path, "csv").cache()
        assert got.count() == want.count() == src.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    key = ["employee_code", "store_code", "question", "response", "task"]
    raw = [f" {RAW_NAMES[k].upper()} " for k in key]
    texts = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert texts(got.select(*key)) == texts(want.select(*[F.col(f"`{c}`") for c in raw]))
    assert got.filter(F.col("response").contains("\n\n then ")).count() == src.filter((F.col("src_ordinal") % 7 == 0) & F.col("response").isNotNull()).count() > 0
    assert got.select("src_ordinal").distinct().count() == src.count()
    # order: in each file rows come sorted by question
    by_file = got.withColumn("f", F.floor(F.col("src_ordinal") / (1 << 40))).select("f", "src_ordinal", "question").orderBy("src_ordinal").collect()
    for f in {r.f for r in by_file}:
        asked = [r.question or "" for r in by_file if r.f == f]
        assert asked == sorted(asked)


def test_doubled_quotes_and_lines_of_another_writer(spark, tmp_root):
    import os

    os.makedirs(f"{tmp_root}/in")
    with open(f"{tmp_root}/in/a.csv", "w", newline="") as f:
        f.write('EmployeeCode,Question,Response\r\nE1,q1,"two\r\nlines, ""quoted"""\r\nE2,q2,plain\r\nE3,"q\n3",""\r\n')
    got = scan_export(spark, f"{tmp_root}/in", "csv", {"escape": '"'}).orderBy("src_ordinal").select("employee_code", "question", "response").collect()
    assert [tuple(r) for r in got] == [("E1", "q1", 'two\nlines, "quoted"'), ("E2", "q2", "plain"), ("E3", "q\n3", None)]


def test_records_over_lines_are_put_together_once(spark, tmp_root, monkeypatch):
    """A scan plans its records without running them, and groups of few lines give the same records."""
    from shelfscan.sources import export

    import os
    os.makedirs(f"{tmp_root}/in")
    want = []
    for name in ("a", "b"):
        with open(f"{tmp_root}/in/{name}.csv", "w", newline="") as f:
            f.write("EmployeeCode,Response\r\n")
            for i in range(60):
                answer = {0: "plain", 1: 'two\r\nlines, "quoted"', 2: "\r\n\r\nmany\r\n\r\n", 3: "a \\ in it"}[i % 4]
                f.write(f'{name}{i},"' + answer.replace('"', '""') + '"\r\n')
                want.append((f"{name}{i}", answer.replace("\r\n", "\n")))
    monkeypatch.setattr(export, "LINES_AT_ONCE", 8)
    sc = spark.sparkContext
    sc.setJobGroup("scan-once", "scan")
    try:
        scanned = scan_export(spark, f"{tmp_root}/in", "csv", {"escape": '"'})
        jobs = sc.statusTracker().getJobIdsForGroup("scan-once")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4  # the header, and whether a field goes on over a line
    assert [tuple(r) for r in scanned.orderBy("src_ordinal").select("employee_code", "response").collect()] == want


def test_a_longer_export_has_more_files(spark, monkeypatch):
    """The written export grows by files, not by rows a file; its rows keep their places."""
    from shelfscan.plans import catalog

    read = []
    monkeypatch.setattr(catalog, "EXPORT_ROWS", 50)
    monkeypatch.setattr(catalog, "scan_export", lambda s, path, fmt: read.append(len(s.read.text(path).inputFiles())) or scan_export(s, path, fmt))
    rows = catalog.QUERIES["scan_export"](spark, SF_SMALL).orderBy("src_ordinal").select("src_ordinal", "employee_code").collect()
    want = events_source(spark, SF_SMALL).orderBy("src_ordinal").select("employee_code").collect()
    assert read[0] > 4
    assert [tuple(r) for r in rows] == [(i, w[0]) for i, w in enumerate(want, 1)]
