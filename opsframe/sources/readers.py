"""Batch readers: declared schemas, provenance columns, lazy scans."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.scalars import set_digest


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_split_csv(spark: SparkSession, files: Mapping[str, str], schema: str | T.StructType, drop: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """One headered CSV per split, tagged and unioned; columns are taken by header name and cast.

    A declared column or label that a header lacks, and an empty split, are errors; values that do not cast are null.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    parts = []
    for split, path in files.items():
        raw = spark.read.csv(path, header=True)
        absent = [c for c in [f.name for f in fields] + ([label] if label else []) if c not in raw.columns]
        if absent:
            raise ValueError(f"columns {absent} not found in {path}")
        d = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
        if d.isEmpty():
            raise ValueError(f"no rows in {path}")
        parts.append(d.drop(*drop).withColumn("split", F.lit(split)))
    return _union(parts)


def read_headerless_csv(spark: SparkSession, files: Mapping[str, str], schema: str | T.StructType, drop: Sequence[str] = ()) -> DataFrame:
    """Headerless CSV with declared columns; a row with another field count fails any read, whatever columns it uses."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    parts = []
    for split, path in files.items():
        lines = spark.read.text(path).where(F.trim("value") != "")
        row = lines.select("value", F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), {"escape": "\""}).alias("r"))
        n = F.size(F.split(F.regexp_replace("value", '"(?:[^"]|"")*"', "q"), ",", -1))
        bad = F.concat(F.lit(f"expected {len(fields)} fields: "), "value")
        # the generated row keeps the check from being pruned with unused columns
        kept = row.select(F.explode(F.array(F.when(n == len(fields), F.col("r")).otherwise(F.raise_error(bad).cast(text)))).alias("r"))
        parts.append(kept.select(*[F.col(f"r.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields]).drop(*drop).withColumn("split", F.lit(split)))
    return _union(parts)


def read_capture_csvs(spark: SparkSession, paths: Sequence[str], schema_ddl: Mapping[str, str] | None = None) -> DataFrame:
    """Many CSV captures: header names stripped, each row tagged with its file name."""
    parts = []
    for path in paths:
        d = spark.read.csv(path, header=True)
        clean = d.toDF(*[c.strip() for c in d.columns]).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        parts.append(clean.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (schema_ddl or {}).items() if c in clean.columns}))
    return _union(parts)


def read_telemetry(spark: SparkSession, path: str, devices: Sequence[str] | None = None, device_column: str = "device_id") -> DataFrame:
    """Telemetry CSV, one file or a directory, with an optional device allow-list."""
    d = spark.read.csv(path, header=True)
    if devices is None:
        return d
    if device_column not in d.columns:
        raise ValueError(f"device column '{device_column}' not found")
    return d.where(F.col(device_column).cast("string").isin(*devices))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").format(fmt).load(path)


def read_events_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) of JSON-lines files; the text is scanned, so both sides stay lazy."""
    parsed = spark.read.text(path).withColumn("j", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j._bad").isNotNull() | F.col("j").isNull()
    lines = parsed.where(F.trim("value") != "")
    return lines.where(~bad).select("j.*").drop("_bad"), lines.where(bad).select(F.col("value").alias("line"))


def read_log_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source, ord, line) of text logs, split like any text scan.

    ``ord`` is (block offset in the file, line order inside the scan), so large files are read by many
    tasks and the order of lines in each file is still explicit and repeatable.
    """
    ordinal = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("source"), ordinal.alias("ord"), F.regexp_replace("value", r"\r$", "").alias("line"))


def _path_parts() -> Column:
    """Names on the way to a row's file, as ``p``; Spark gives paths URI-encoded, where a plus sign stays one."""
    names = F.split(F.col("_metadata.file_path"), "/")
    return F.transform(names, lambda n: F.url_decode(F.replace(n, F.lit("+"), F.lit("%2B")))).alias("p")


def read_captures(spark: SparkSession, root: str, expected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(captures, missing) under ``root/<snapshot>/<device>/<command>.txt``."""
    whole = spark.read.text(f"{root}/*/*/*.txt", wholetext=True).select(_path_parts(), "value")
    part = lambda i: F.element_at("p", i)
    named = whole.select(part(-3).alias("snapshot_id"), part(-2).alias("device"), F.regexp_replace(part(-1), r"\.txt$", "").alias("command"), "value")
    captures = named.select("snapshot_id", "device", "command", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    have = named.select("snapshot_id", "device", "command")
    want = have.select("snapshot_id", "device").distinct().select("*", F.explode(F.array(*[F.lit(c) for c in expected])).alias("command"))
    return captures, want.join(have, ["snapshot_id", "device", "command"], "left_anti")


def read_manifests(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """Run manifests under ``root/<dataset>/<model>/<run>/manifest.json``; unreadable files are skipped."""
    whole = spark.read.text(f"{root}/*/*/*/manifest.json", wholetext=True).select(_path_parts(), F.from_json("value", schema).alias("m"))
    part = lambda i: F.element_at("p", i)
    return whole.where("m is not null").select(part(-4).alias("dataset"), part(-3).alias("model_type"), part(-2).alias("run_dir"), "m.*")


def fingerprint(df: DataFrame, source: str | None = None) -> DataFrame:
    """Order-free content digest, rows and columns, per source value and in total.

    Row digests are summed, so no file or group is ever held whole.
    """
    # the separator and the escape are escaped, so that no two rows of cells read alike
    plain = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    cells = [F.coalesce(plain(F.col(f"`{c}`").cast("string")), F.lit("\x00")) for c in df.columns if c != source]
    d = df.select(F.col(source).cast("string").alias("source") if source else F.lit("all").alias("source"), F.concat_ws("|", *cells).alias("_row"))
    per = d.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), set_digest("_row").alias("digest"))
    total = per.agg(F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest")).select(F.lit("__all__").alias("source"), "rows", "digest")
    return per.unionByName(total).withColumn("columns", F.lit(len(cells)))


#: Spark holds a file's content in one value, which has this many bytes at most.
WHOLE_FILE = (1 << 31) - 64


def file_fingerprint(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, bytes, kind, digest`` of every file, and a row ``__all__`` that doesn't depend on the files' order.

    A file's digest is the SHA-256 of its bytes; the total is that of all sorted digests one after the other, which puts one
    digest a file into one row. Empty files have no row, as Spark reads none of them. Files too large for one value (kind ``lines``) get the order-free digest of their lines.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    # filters on the length are answered by the source, which then never opens the larger files
    small = files.where(F.col("length") <= WHOLE_FILE).select("path", F.col("length").alias("bytes"), F.lit("sha256").alias("kind"), F.sha2("content", 256).alias("digest"))
    large = [r["path"] for r in files.where(F.col("length") > WHOLE_FILE).select("path").collect()]  # one path a file
    every = small
    if large:
        rows = spark.read.text(large).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "value")
        lines = rows.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n"), set_digest("value").alias("d"))
        every = small.unionByName(lines.select("path", "bytes", F.lit("lines").alias("kind"), F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("d").cast("string")), 256).alias("digest")))
    total = every.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.array_join(F.array_sort(F.collect_list("digest")), "").alias("joined"))
    return every.unionByName(total.select(
        F.lit("__all__").alias("path"), "bytes", F.lit("total").alias("kind"), F.when(F.col("joined") == "", "").otherwise(F.sha2("joined", 256)).alias("digest")))
