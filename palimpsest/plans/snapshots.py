"""Snapshots of tables: bucketed Parquet pieces, shared between versions, and manifests that say which pieces a version has.

Under the root: tables/<table>/vc_part=<folder>/vc_bucket=<k>/*.parquet, and manifests/<hash>.json. A row's bucket follows from a
hash of its key, and the number of buckets from the table's size, always a power of two: bucket k of n is what buckets k, k + n,
k + 2n, ... of more are together, and the digests add up the same way. So versions are compared, and pieces skipped, whatever
their numbers of buckets are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.digest import digests, place

#: Rows that a bucket is meant to hold, and the most buckets that a table has.
ROWS_PER_BUCKET, MOST_BUCKETS = 1 << 18, 1 << 17
#: Up to so many bytes, as Spark estimates them, a new table is one bucket; above them its rows are counted.
SMALL_BYTES = 16 << 20
#: Files of a table of one bucket, at most.
FILES = 8
#: A table of pieces from more folders than this is written anew as a whole by its next change.
MOST_FOLDERS = 64

def total(digests_: Iterable[Sequence[int]]) -> list[int]:
    return [sum(x) for x in zip(*digests_, strict=True)] or [0] * 5


def _free(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, which is what Parquet gives back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _free(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_free(kind.elementType))
    return T.MapType(_free(kind.keyType), _free(kind.valueType)) if isinstance(kind, T.MapType) else kind


class Files:
    """Text files in any file system that Spark's Hadoop client knows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, once: bool = False) -> bool:
        """Write a file whole; with `once`, only if nobody has it yet (False if someone has): it appears by one rename."""
        fs, target = self.at(path)
        _, fresh = self.at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark._sc._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE if once else rename.OVERWRITE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, kinds)
        except Exception as e:
            fs.delete(fresh, False)
            if once and "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


class Snapshots:
    """The snapshots of a database. Manifests are read when asked for; rows stay in DataFrames."""

    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.root, self.files, self.rows_per_bucket = spark, root, Files(spark), rows_per_bucket
        self._metas: dict[str, dict] = {}
        self._frames: dict[str, DataFrame] = {}

    def meta(self, h: str) -> dict:
        if h not in self._metas:
            self._metas[h] = json.loads(self.files.read(f"{self.root}/manifests/{h}.json"))
        return self._metas[h]

    def schema(self, h: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.meta(h)["schema"]))

    def keys(self, h: str) -> list[str]:
        return self.meta(h)["keys"]

    def facts(self, h: str) -> dict:
        """What a table has beside rows: defaults, not_null, auto, rules, indexes, generated, json."""
        return self.meta(h)["facts"]

    def count(self, h: str) -> int:
        """Rows, from the manifest alone."""
        return total(p[1:] for p in self.meta(h)["pieces"].values())[0]

    def read(self, h: str, buckets: Iterable[int] | None = None, of: int | None = None) -> DataFrame:
        """A snapshot's rows, or those of some buckets, of as many as the table has or of fewer."""
        m = self.meta(h)
        if buckets is None and h in self._frames:
            return self._frames[h]
        wanted = None if buckets is None else {*buckets}
        pieces = {int(k): p[0] for k, p in m["pieces"].items() if wanted is None or int(k) % (of or m["buckets"]) in wanted}
        frame = self._of(m["table"], self.schema(h), pieces, m["buckets"])
        if buckets is None:
            self._frames[h] = frame
        return frame

    def _of(self, table: str, schema: T.StructType, pieces: dict[int, str], buckets: int, with_bucket: bool = False) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("vc_part", T.StringType()), T.StructField("vc_bucket", T.IntegerType())])
        if not pieces:
            empty = self.spark.createDataFrame([], full)
            return empty.drop("vc_part") if with_bucket else empty.drop("vc_part", "vc_bucket")
        by: dict[str, list[int]] = {}
        for k, folder in pieces.items():
            by.setdefault(folder, []).append(k)
        base = f"{self.root}/tables/{table}"
        df = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/vc_part={folder}" for folder in by])
        keep = F.lit(False)
        for folder, ks in by.items():
            others = [k for k in range(buckets) if k not in set(ks)] if len(ks) > buckets // 2 else None
            inside = F.lit(True) if others == [] else ~F.col("vc_bucket").isin(others) if others is not None else F.col("vc_bucket").isin(ks)
            keep = keep | ((F.col("vc_part") == folder) & inside)
        if not (len(by) == 1 and len(pieces) == buckets):
            df = df.filter(keep)
        return df.drop("vc_part") if with_bucket else df.drop("vc_part", "vc_bucket")

    def buckets_for(self, df: DataFrame, before: str | None = None) -> int:
        """A power of two by the number of rows; a table that there is keeps its buckets while they are about right."""
        if before is not None:
            now, n = self.meta(before)["buckets"], self.count(before)
            if now > 1 or n > self.rows_per_bucket:
                return now if self.rows_per_bucket // 8 <= n // now <= 4 * self.rows_per_bucket else self._power(n)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return 1 if size <= SMALL_BYTES and self.rows_per_bucket >= ROWS_PER_BUCKET else self._power(df.count())

    def _power(self, n: int) -> int:
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * self.rows_per_bucket < n:
            buckets *= 2
        return buckets

    def write(self, table: str, df: DataFrame, keys: Sequence[str], facts: dict, before: str | None = None, touched: Iterable[int] | None = None, taken: dict[int, list] | None = None) -> str:
        """The hash of a snapshot with df's rows. With `touched`, df has the rows of these buckets of `before`, and all other
        pieces are those of `before`, by reference; `taken` are pieces of another version to put in as they are.

        AQE splits a large bucket over tasks and joins small ones to files of a fair size. The digests are taken from what was
        written. A snapshot whose content there is already is not kept twice.
        """
        schema = T.StructType([T.StructField(f.name, _free(f.dataType)) for f in df.schema.fields])
        m = self.meta(before) if before and touched is not None else None
        buckets = m["buckets"] if m else self.buckets_for(df, before)
        pieces = {k: v for k, v in m["pieces"].items() if int(k) not in {*touched}} if m else {}
        pieces.update({str(k): v for k, v in (taken or {}).items() if v is not None})
        for k in [k for k, v in (taken or {}).items() if v is None]:
            pieces.pop(str(k), None)
        home = m["table"] if m else table
        if touched is None or touched:
            folder = "p" + uuid.uuid4().hex
            path = f"{self.root}/tables/{home}/vc_part={folder}"
            order = [F.col(f"`{f.name}`") for f in ([schema[k] for k in keys] or schema.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
            placed = df.withColumn("vc_bucket", place(schema, keys, buckets))
            placed = placed.hint("rebalance", "vc_bucket") if buckets > 1 else placed.coalesce(FILES)  # one bucket is small: no shuffle
            placed.sortWithinPartitions("vc_bucket", *order).write.partitionBy("vc_bucket").parquet(path)
            mine = {k: folder for k in (touched if m else range(buckets))}
            for r in digests(self._of(home, schema, mine, buckets, with_bucket=True), "vc_bucket").collect():
                pieces[str(r["vc_bucket"])] = [folder, r["n"], r["a"], r["b"], r["c"], r["d"]]
            if not any(p[0] == folder for p in pieces.values()):
                self.files.delete(path)
        facts = {k: v for k, v in sorted(facts.items()) if v}
        content = json.dumps([schema.json(), [*keys], facts, total(p[1:] for p in pieces.values())], sort_keys=True)
        h = hashlib.sha256(content.encode()).hexdigest()[:32]
        if h in self._metas or self.files.exists(f"{self.root}/manifests/{h}.json"):
            if touched is None or touched:
                self.files.delete(path)
            return h
        meta = {"table": home, "schema": schema.json(), "keys": [*keys], "facts": facts, "buckets": buckets, "pieces": pieces}
        self.files.write(f"{self.root}/manifests/{h}.json", json.dumps(meta))
        self._metas[h] = meta
        return h

    def whole_again(self, h: str) -> bool:
        """Whether a table's pieces lie in so many folders that its next change should write it as a whole."""
        return len({p[0] for p in self.meta(h)["pieces"].values()}) > MOST_FOLDERS

    def same_shape(self, *hashes: str) -> bool:
        """Whether buckets of the versions can be compared: equal columns, types and keys."""
        first = self.meta(hashes[0])
        return all((m["schema"], m["keys"]) == (first["schema"], first["keys"]) for m in map(self.meta, hashes[1:]))

    def coarse(self, h: str | None, buckets: int) -> dict[int, tuple]:
        """Digests of a table's rows by as many buckets, or fewer, than it has."""
        out: dict[int, tuple] = {}
        for k, p in (self.meta(h)["pieces"] if h else {}).items():
            at = int(k) % buckets
            out[at] = tuple(x + y for x, y in zip(out.get(at, (0,) * 5), p[1:], strict=True))
        return out

    def differing(self, a: str, b: str) -> tuple[list[int] | None, int]:
        """(buckets, of how many) in which two versions differ; None if they can't be compared."""
        if not self.same_shape(a, b):
            return None, 0
        n = min(self.meta(a)["buckets"], self.meta(b)["buckets"])
        x, y = self.coarse(a, n), self.coarse(b, n)
        return sorted(k for k in {*x, *y} if x.get(k) != y.get(k)), n

    def both(self, a: str | None, b: str | None) -> tuple[DataFrame, DataFrame]:
        """Rows of two versions, one of which may be missing, without the buckets in which they agree."""
        if a is None or b is None:
            there = self.read(a or b)
            return (there, there.limit(0)) if a else (there.limit(0), there)
        buckets, n = self.differing(a, b)
        return (self.read(a), self.read(b)) if buckets is None else (self.read(a, buckets, n), self.read(b, buckets, n))

    def equal_rows(self, a: str, b: str) -> int:
        """Rows in the buckets that `both` leaves out."""
        buckets, n = self.differing(a, b)
        return 0 if buckets is None else sum(x[0] for k, x in self.coarse(a, n).items() if k not in {*buckets})
