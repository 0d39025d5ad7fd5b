"""A table of bars in committed versions: a manifest, written after its files, says what a version is made of.

Files of a partition (a month, say) stand in a folder of their own and are never
changed. A version is a JSON document ``manifests/<number>.json`` that names the
folder of each partition, and for each source the last batch that is in it. It is
written under a name of its own and renamed without overwriting, so that a number is
given once. Readers take the manifest with the highest number and look at nothing else:
a job that dies between files and manifest leaves files that no version names
(``vacuum`` removes them), compaction never meets a reader, and a batch that runs
again is known by its number and does nothing.

Merges read and write the partitions that a batch touches, no others. The batch is
planned once: it is landed by partition, with its checks in the same pass, and the
names of its partitions are those of the folders that were written.

Defined results: of rows with equal keys in one batch the greatest (by their values)
stays; a null partition value is a partition of its own; an empty batch makes a version
that only knows its number; keys must decide the partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import ChecksFailed, hadoop, remove, write_observed

PART = "part"


class Conflict(RuntimeError):
    """Another writer has published this number first."""


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


class Versions:
    """keys: columns that name a row. part: text of the partition of a row. reason: why a row is not accepted (null: it is)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("series_id", "date"), *, part: Column | None = None, reason: Column | None = None) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.part = month_of() if part is None else part
        self.reason = F.lit(None).cast("string") if reason is None else reason

    # --- manifests ----------------------------------------------------------------

    def numbers(self) -> list[int]:
        fs, folder = hadoop(self.spark, f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict[str, Any]:
        """A version, the latest if no number is given; number 0 is the empty table."""
        there = self.numbers()
        number = (there[-1] if there else 0) if number is None else number
        if not number:
            return {"number": 0, "schema": None, "folders": {}, "applied": {}, "kind": "empty"}
        return json.loads(self._read_text(f"{self.root}/manifests/{number:012d}.json"))

    def _read_text(self, path: str) -> str:
        fs, p = hadoop(self.spark, path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, Any]) -> dict[str, Any]:
        """Writes a manifest whole and gives it its number, which must be free."""
        jvm = self.spark._jvm
        final = f"{self.root}/manifests/{manifest['number']:012d}.json"
        fs, own = hadoop(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        target = hadoop(self.spark, final)[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(own), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(own, False)
            if fs.exists(target):
                raise Conflict(f"version {manifest['number']} is there already") from e
            raise
        return manifest

    def _next(self, known: dict[str, Any], kind: str, **changed: Any) -> dict[str, Any]:
        return self._publish({**known, "number": known["number"] + 1, "kind": kind, **changed})

    # --- reading --------------------------------------------------------------------

    def read(self, number: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, of given partitions if they are named."""
        return self._rows(self.manifest(number), parts)

    def _rows(self, manifest: dict[str, Any], parts: Sequence[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{f}" for p, f in sorted(manifest["folders"].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rejects(self) -> DataFrame:
        """Rows that were not accepted, with reason and batch."""
        return self.spark.read.parquet(f"{self.root}/rejects")

    # --- writing --------------------------------------------------------------------

    def _folders(self, at: str) -> dict[str, str]:
        fs, p = hadoop(self.spark, f"{self.root}/{at}")
        if not fs.exists(p):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {n: f"{at}/{n}" for n in names if n.startswith(f"{PART}=")}

    def merge(self, new: DataFrame, *, batch: int | None = None, source: str = "", whole: bool = False, unit: Sequence[str] = (), overlap_from: Column | None = None, start: Column | None = None, date: str = "date", rejected: str = "keep") -> dict[str, Any]:
        """Puts the rows of a batch in the place of those with their keys, and publishes that as a version.

        Bad rows are left out and written aside. With whole=True a batch that holds a bad row, a
        key twice, lacks a known row from overlap_from on, or begins a series after start is
        rejected whole; with unit, what shares these columns with a bad row or a repeated key is. A rejected
        batch raises ChecksFailed and leaves nothing (rejected="raise"), or makes a version without its rows.
        A batch number (of a source) that a version knows does nothing.
        """
        for _ in range(10):
            known = self.manifest()
            if batch is not None and batch <= known["applied"].get(source, -1):
                return known
            try:
                return self._merge(known, new, batch, source, whole, list(unit), overlap_from, start, date, rejected)
            except Conflict:
                continue  # another writer was first: once more, over its version
        raise Conflict(f"{self.root} changes too fast")

    def _merge(self, known, new, batch, source, whole, unit, overlap_from, start, date, rejected) -> dict[str, Any]:
        name = uuid.uuid4().hex
        applied = {**known["applied"], **({} if batch is None else {source: batch})}
        values = [c for c in new.columns if c not in self.keys]
        incoming, made = f"incoming/{name}", f"data/{name}"
        rows = new.withColumns({"__reason": self.reason, PART: F.coalesce(self.part, F.lit("none"))})
        seen = write_observed(rows, f"{self.root}/{incoming}", {"invalid": F.col("__reason").isNotNull()}, by=[PART])
        touched = list(self._folders(incoming))
        schema = known["schema"] or json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in new.schema]).json())
        if not touched:
            return self._next(known, "merge", schema=schema, applied=applied)
        landed = self.spark.read.schema(rows.schema).option("basePath", f"{self.root}/{incoming}").parquet(f"{self.root}/{incoming}")
        bad = F.col("__reason").isNotNull()
        good, aside = landed.filter(~bad), landed.filter(bad)
        if unit:
            twice = landed.groupBy(*dict.fromkeys([*unit, *self.keys])).agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad")).filter("n > 1 or bad")
            faulty = twice.select(*[F.col(u).alias(f"__{u}") for u in unit]).distinct()
            same = F.lit(True)
            for u in unit:
                same = same & F.col(u).eqNullSafe(F.col(f"__{u}"))
            good, aside = landed.join(faulty, same, "left_anti"), landed.join(faulty, same, "left_semi")
        counts = {"invalid": seen["invalid"]}
        if not (whole and counts["invalid"]):
            old = self._rows({**known, "schema": schema}, touched).select(F.coalesce(self.part, F.lit("none")).alias("__part"), *self.keys, F.struct(*values).alias("o"))
            fresh = good.groupBy(PART, *self.keys).agg(F.max(F.struct(*values)).alias("n"), F.count(F.lit(1)).alias("__k"))
            both = old.join(fresh, self.keys, "full_outer").select(F.coalesce("__part", PART).alias(PART), *self.keys, F.coalesce("n", "o").alias("r"), F.col("o").isNull().alias("__new"), F.col("n").isNull().alias("__kept"), "__k")
            checks = {"repeated": F.col("__k") > 1} | ({} if overlap_from is None else {"lost": F.col("__kept") & (F.col(date) >= overlap_from)})
            rows = both.select(PART, *self.keys, "r.*", "__new", "__kept", "__k")
            found = write_observed(rows, f"{self.root}/{made}", checks, by=[PART], drop=["__kept", "__k", *(["__new"] if start is None else [])])
            counts |= {n: found[n] for n in checks}
            if start is not None:
                counts["cold"] = self._cold(known, made, touched, start, date)
        reject = whole and any(counts.values())
        if reject and rejected == "raise":
            for at in (incoming, made):
                remove(self.spark, f"{self.root}/{at}")
            found = {n: c for n, c in counts.items() if c}
            raise ChecksFailed("batch rejected: " + ", ".join(f"{n} {c}" for n, c in found.items()), found)
        if reject or unit or counts["invalid"]:
            label = f"{source or 'batch'}-{name if batch is None else batch}"  # a batch that runs again writes the same place
            out = (landed if reject else aside).withColumn("reason", F.coalesce("__reason", F.lit("batch_rejected"))).drop("__reason", PART)
            out.write.mode("overwrite").parquet(f"{self.root}/rejects/from={label}")
        remove(self.spark, f"{self.root}/{incoming}")
        if reject:
            remove(self.spark, f"{self.root}/{made}")
            return self._next(known, "rejected", schema=schema, applied=applied)
        return self._next(known, "merge", schema=schema, folders={**known["folders"], **self._folders(made)}, applied=applied)

    def _cold(self, known, made: str, touched: list[str], start: Column, date: str) -> int:
        """Series of the files just written that begin after start and have no row in the version known."""
        series = [k for k in self.keys if k != date]
        written = self.spark.read.parquet(f"{self.root}/{made}")
        first = written.groupBy(*series).agg(F.min(date).alias("first"), F.min("__new").alias("new")).filter(F.col("new") & (F.col("first") > start))
        rest = [p for p in known["folders"] if p not in touched]
        if rest and not first.isEmpty():  # only then are other partitions looked at, and of them the series
            first = first.join(self._rows(known, rest).select(*series).distinct(), series, "left_anti")
        return first.count()

    def compact(self, parts: Sequence[str] | None = None) -> dict[str, Any]:
        """The same rows in files of the size that adaptive execution makes, sorted by key, as a version; batches that it holds stay known."""
        known = self.manifest()
        chosen = [p for p in known["folders"] if parts is None or p in parts]
        if not chosen:
            return known
        made = f"data/{uuid.uuid4().hex}"
        rows = self._rows(known, chosen).withColumn(PART, F.coalesce(self.part, F.lit("none")))
        rows.repartitionByRange(PART, *self.keys).sortWithinPartitions(PART, *self.keys).write.partitionBy(PART).parquet(f"{self.root}/{made}")
        return self._next(known, "compact", folders={**known["folders"], **self._folders(made)})

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions, and files that none of those names; not while another job writes. Gives the number of folders removed."""
        there = self.numbers()
        stay = {f for n in there[-keep:] for f in self.manifest(n)["folders"].values()}
        gone = 0
        fs, data = hadoop(self.spark, f"{self.root}/data")
        for one in [s.getPath() for s in fs.listStatus(data)] if fs.exists(data) else []:
            for p, folder in self._folders(f"data/{one.getName()}").items():
                if folder not in stay:
                    remove(self.spark, f"{self.root}/{folder}")
                    gone += 1
            if not self._folders(f"data/{one.getName()}"):
                fs.delete(one, True)
        remove(self.spark, f"{self.root}/incoming")
        for n in there[:-keep]:
            remove(self.spark, f"{self.root}/manifests/{n:012d}.json")
        return gone


def merge_partitions(path: str, new: DataFrame, keys: Sequence[str], part: str) -> None:
    """Merges new rows into a plain Parquet table partitioned by part: only its partitions that new holds are read and, when all is written, replaced.

    The list of partitions comes from the rows (a value for each, no rows). Readers may meet
    the moment of the replacement; tables that are read meanwhile want Versions.
    """
    spark = new.sparkSession
    parts = [r[0] for r in new.select(part).distinct().collect()]
    values = [c for c in new.columns if c not in keys]
    try:
        there = spark.read.parquet(path)
    except PySparkException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], new.schema)
    old = there.filter(F.col(part).isin(parts)).select(*keys, F.struct(*values).alias("o"))
    fresh = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("n"))
    both = old.join(fresh, list(keys), "full_outer").select(*keys, F.coalesce("n", "o").alias("r")).select(*keys, "r.*")
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
