"""Import and export of files: CSV, PSV, JSON, JSON lines, Parquet, XLSX, SQL dumps, with inference and mapping."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import diff, patch, schema

FORMATS = {"csv": "csv", "psv": "psv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "xlsx": "xlsx", "sql": "sql"}
#: Stands for an empty text in quotes while CSV is read, since an empty field without quotes is null.
_EMPTY = "\x00empty\x00"


def format_of(path: str, given: str | None = None) -> str:
    kind = (given or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    return kind


def _odd_quotes(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted field goes on over a line's end. The file is read in
    splits, and the search ends with the first such line."""
    lines = spark.read.text(path)
    odd = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not lines.filter(odd % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, columns: Sequence[str] = (), types: T.StructType | None = None, quote: str = '"', escape: str = '"', skip: int = 0, comment: str | None = None, multiline: bool | None = None) -> DataFrame:
    """A field without characters is null, "" in quotes is empty text; quoted fields may hold line ends; a byte order mark
    is left out. All columns are text unless types are given; `infer` finds some. `skip` leaves out first lines of data.

    A file is read by many tasks unless a field goes on over a line's end, which only one task can tell: `multiline` says so,
    or is found out."""
    multiline = _odd_quotes(spark, path, quote) if multiline is None else multiline
    reader = spark.read.options(sep=sep, header=header, multiLine=multiline, quote=quote, escape=escape, nullValue="", emptyValue=_EMPTY, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    df = df.toDF(*(columns or [c.removeprefix("﻿") if header else f"c{i}" for i, c in enumerate(df.columns)]))
    df = df.select(*[F.when(F.col(f"`{c}`") == _EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if skip:
        df = diff.numbered(df).filter(F.col("row_no") > skip).drop("row_no")
    return schema.conform(df, types) if types else df


def read_json(spark: SparkSession, path: str, types: T.StructType | None = None) -> DataFrame:
    """A document {"rows": [...]}."""
    reader = spark.read.option("multiLine", True)
    if types:
        reader = reader.schema(T.StructType([T.StructField("rows", T.ArrayType(types))]))
    return reader.json(path).select(F.inline("rows"))


def read_jsonl(spark: SparkSession, path: str, types: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(types) if types else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str, types: T.StructType | None = None) -> DataFrame:
    """Columns that the file lacks are null; a repeated field becomes JSON text where the table wants text."""
    df = spark.read.parquet(path)
    if types is None:
        return df
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    text = {f.name for f in types.fields if isinstance(f.dataType, T.StringType)}
    return schema.conform(df.withColumns({c: F.to_json(c) for c in nested & text}), types)


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet whose first row names the columns, as text. Workbooks are small: the driver unpacks them."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    content = spark.read.format("binaryFile").load(path).first()["content"]
    import io

    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(f"{{{ns['r']}}}id") for s in book.find("m:sheets", ns)}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet}; the sheets are {', '.join(ids)}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        rows = []
        for r in ElementTree.fromstring(z.read("xl/" + rels[ids[sheet]].removeprefix("/xl/"))).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in r:
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r"))[0]:
                    at = at * 26 + ord(letter) - 64
                v = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text if v is not None else inline or None
            rows.append(cells)
    names = [rows[0].get(i) or f"c{i}" for i in range(max(rows[0]) + 1)]
    return spark.createDataFrame([tuple(r.get(i) for i in range(len(names))) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_any(spark: SparkSession, path: str, kind: str | None = None, table: str | None = None, types: T.StructType | None = None, **options) -> DataFrame:
    kind = format_of(path, kind)
    if kind in ("csv", "psv"):
        return read_csv(spark, path, options.pop("sep", "|" if kind == "psv" else ","), types=types, **options)
    if kind == "xlsx":
        return read_xlsx(spark, path, table or re.sub(r".*/|\..*", "", path))
    if kind == "sql":
        raise ValueError("SQL text is run, not read: see sql.run_script")
    return {"json": read_json, "jsonl": read_jsonl, "parquet": read_parquet}[kind](spark, path, types)


# --- inference

_INT, _FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def infer(df: DataFrame, float_threshold: float = 0.0) -> T.StructType:
    """The narrowest types that all values of each text column fit: one aggregate over the data.

    Numbers with leading zeros are text; a number is an integer if its fraction is under the threshold; times at midnight
    alone are dates; a column of nulls is text.
    """
    def facts(c: str) -> Column:
        v = F.col(f"`{c}`")
        zero = v.rlike(r"^[+-]?0\d")
        whole = v.rlike(_INT) & ~zero
        small = v.rlike(_FLOAT) & ~zero & (F.abs(v.try_cast("double") % 1) <= float_threshold) if float_threshold else whole
        day, time = v.try_cast("date"), v.try_cast("timestamp_ntz")
        fits = {
            "boolean": F.lower(v).isin("true", "false"), "int": (whole | small) & v.try_cast("double").cast("decimal(38,0)").between(-(2**31), 2**31 - 1), "bigint": whole & v.try_cast("bigint").isNotNull(),
            "double": v.rlike(_FLOAT) & ~zero, "date": v.rlike(r"^\d{4}-\d\d?-\d\d?") & time.isNotNull() & (day.cast("timestamp_ntz") == time), "timestamp_ntz": v.rlike(r"^\d{4}-\d\d?-\d\d?") & time.isNotNull(),
        }
        return F.struct(F.count(v).alias("n"), *[F.min(F.when(v.isNotNull(), F.coalesce(f, F.lit(False)).cast("int"))).alias(k) for k, f in fits.items()]).alias(c)

    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = df.agg(*[facts(c) for c in names]).first() if names else {}
    kinds = {"boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}
    fields = []
    for f in df.schema.fields:
        r = found[f.name] if f.name in names else None
        kind = f.dataType if r is None else next((t for k, t in kinds.items() if r["n"] and r[k]), T.StringType())
        fields.append(T.StructField(f.name, kind))
    return T.StructType(fields)


def typed(df: DataFrame, types: T.StructType, strict: bool = True) -> DataFrame:
    """df with the types; without strict, rows with a value that doesn't fit are left out (as a skipped row of an import)."""
    if strict:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in types.fields])
    fits = F.lit(True)
    for f in types.fields:
        fits = fits & (F.col(f"`{f.name}`").isNull() | F.col(f"`{f.name}`").try_cast(f.dataType).isNotNull())
    return schema.conform(df.filter(fits), types)


def load(repo, table: str, path: str, mode: str = "create", keys: Sequence[str] = (), kind: str | None = None, mapping: dict[str, str] | None = None, types: T.StructType | None = None, all_text: bool = False, keep_going: bool = False, **options) -> str:
    """Import a file into a table. mode: create, replace (the rows of a table that there is), append, or update (by key)."""
    raw = read_any(repo.spark, path, kind, table, **options).withColumnsRenamed(mapping or {})
    there = table in repo.manifest("WORKING")
    if mode != "create" and there:
        types = types or repo.table(table).schema
    types = types or (raw.schema if all_text else infer(raw))
    df = typed(raw.select(*[c for c in raw.columns if c in types.names]), T.StructType([f for f in types.fields if f.name in raw.columns]), strict=not keep_going)
    if mode in ("create", "replace") or not there:
        return repo.write_table(table, df, keys)
    own = repo.keys(repo.manifest("WORKING")[table])
    kept = [c for c in types.names if c not in df.columns]
    if mode == "update" and own and kept and {*own} <= {*df.columns}:  # columns that the file lacks keep their values
        df = df.join(repo.table(table).select(*own, *kept), own, "left").select(*types.names)
    return repo.insert(table, df, {"append": "error", "update": "replace"}[mode])


# --- LOAD DATA, INTO OUTFILE


def field_options(items: list) -> dict[str, str]:
    """FIELDS TERMINATED BY, [OPTIONALLY] ENCLOSED BY, ESCAPED BY and LINES TERMINATED BY of a statement's tokens."""
    from palimpsest.plans.dialect import find, is_string, value

    out = {"sep": "\t", "quote": "", "escape": "\\", "line": "\n"}
    lines = find(items, "lines")
    for key, words, start in (("sep", ("terminated", "by"), 0), ("quote", ("enclosed", "by"), 0), ("escape", ("escaped", "by"), 0), ("line", ("terminated", "by"), max(lines, 0))):
        at = find(items, *words, start=start)
        if at >= 0 and is_string(items[at + 2]) and (key != "sep" or lines < 0 or at < lines) and (key != "line" or lines >= 0):
            out[key] = value(items[at + 2])
    return out


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], skip: int = 0, sep: str = "\t", quote: str = "", escape: str = "\\", line: str = "\n") -> DataFrame:
    """A file as LOAD DATA reads it: text columns by place, \\N is null, first lines may be left out."""
    options = {"sep": sep, "quote": quote, "escape": escape, "nullValue": "\\N", "emptyValue": "", "header": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if line not in ("\n", "\r\n"):
        options["lineSep"] = line
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.options(**options).schema(kinds).csv(path)
    return diff.numbered(df).filter(F.col("row_no") > skip).drop("row_no") if skip else df


def write_delimited(df: DataFrame, path: str, sep: str = "\t", quote: str = "", escape: str = "\\", line: str = "\n") -> None:
    """A folder of part files as INTO OUTFILE writes them: no header, null as \\N."""
    plain = df.select(*[(F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])
    options = {"sep": sep, "quote": quote, "escape": escape, "nullValue": "\\N", "emptyValue": "", "header": False}
    if quote:
        options["quoteAll"] = True
    plain.write.options(**options).csv(path)


# --- export


def write_any(df: DataFrame, path: str, kind: str | None = None, table: str = "t", keys: Sequence[str] = (), batch: int = 1) -> None:
    """A folder of part files in the format (one row of the table in none is split over lines except in quotes)."""
    kind = format_of(path, kind)
    if kind in ("csv", "psv"):
        plain = df.select(*[(F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
        plain.write.options(header=True, sep="|" if kind == "psv" else ",", quote='"', escape='"', nullValue="", emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    elif kind == "jsonl":
        df.write.json(path, ignoreNullFields=False)
    elif kind == "json":
        _write_document(df, path)
    elif kind == "parquet":
        df.write.parquet(path)
    elif kind == "sql":
        spark = df.sparkSession
        head = spark.createDataFrame([(f"DROP TABLE IF EXISTS `{table}`;",), (schema.create_statement(table, df.schema, keys),)], "statement string").coalesce(1)
        head.union(patch.dump(table, df, keys, batch)).write.text(path)
    else:
        raise ValueError(f"{kind} can only be read")


def _write_document(df: DataFrame, path: str) -> None:
    """One document {"rows": [...]}: the rows are written by all tasks as part files, whose bytes the file system then puts after
    each other, with the commas between; no row passes through the driver's Python."""
    spark, parts = df.sparkSession, f"{path}.parts"
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    df.select(F.concat(F.lit(","), row).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (parts, path))
    fs = source.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        out.write(bytearray(b'{"rows": ['))
        first = True
        for status in sorted(fs.listStatus(source), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-") and status.getLen():
                stream = fs.open(status.getPath())
                if first:
                    stream.read()  # the comma before the first row
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
        out.write(bytearray(b"]}"))
    finally:
        out.close()
    fs.delete(source, True)


def dump_database(repo, path: str, kind: str = "sql", as_of: str = "WORKING") -> None:
    for name, h in sorted(repo.manifest(as_of).items()):
        write_any(repo.snapshot(h), f"{path}/{name}.{kind}", kind, name, repo.keys(h), batch=100)


def read_lines(spark: SparkSession, lines: Iterable[str], kind: str = "csv", **options) -> DataFrame:
    """What comes through a pipe, as read_any reads a file: the driver passes the lines on, since a pipe has one reader."""
    import tempfile

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='palimpsest-')}/lines-{uuid.uuid4().hex}.{kind}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    for line in lines:
        out.write(bytearray((line.rstrip("\n") + "\n").encode()))
    out.close()
    return read_any(spark, path, kind, **options)


def render(df: DataFrame, kind: str = "tabular", limit: int = 1000) -> str:
    """A result as text, `limit` rows of it: tabular, vertical, csv, json or sql."""
    import csv
    import io

    if kind in ("tabular", "vertical"):
        return tabular(df, limit, kind == "vertical")
    if kind == "sql":
        return "\n".join(r[0] for r in patch.dump("t", df.limit(limit)).collect())
    if kind == "json":
        return '{"rows": [' + ",".join(r[0] for r in df.limit(limit).select(F.to_json(F.struct("*"))).collect()) + "]}"
    if kind != "csv":
        raise ValueError(f"unknown format {kind}")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for r in df.limit(limit).select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).collect():
        writer.writerow(["" if v is None else v for v in r])
    return out.getvalue()


def tabular(df: DataFrame, limit: int = 20, vertical: bool = False) -> str:
    return df._jdf.showString(limit, 0, vertical)


def load_file(spark: SparkSession, path: str) -> bytes | None:
    row = spark.read.format("binaryFile").load(path).first()
    return bytes(row["content"]) if row else None
