"""Processing only new or changed records.

Records are spread over partitions by a hash of their key. A partition's *fingerprint* is its row
count and two sums of row hashes under different seeds; sums do not depend on row order, so they
are built with map-side partial aggregation and only a few numbers per partition are shuffled. A
partition whose fingerprints agree on both sides is left alone; the others are compared row by row,
and a target table takes them over one partition at a time through dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamstone import files
from loamstone.session import materialise

#: Sums of 64-bit hashes are kept as exact decimals, so ANSI overflow cannot occur.
_SUM = "decimal(38,0)"


def partition_of(key: Column, partitions: int) -> Column:
    """Partition number of a key; a null key goes to partition 0."""
    return F.coalesce(F.pmod(F.xxhash64(key.cast("string")), F.lit(partitions)), F.lit(0)).cast("int")


def fingerprints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count and two additive row-hash sums for each value of ``by``.

    Nulls are told apart from every value by a flag hashed beside them. An empty table has no
    fingerprints.
    """
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fp_rows"),
        F.sum(F.xxhash64(*parts).cast(_SUM)).alias("fp_sum_a"),
        F.sum(F.xxhash64(F.lit("second seed"), *reversed(parts)).cast(_SUM)).alias("fp_sum_b"),
    )


def changed_partitions(current: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """Values of ``by`` whose fingerprints differ between two fingerprint tables, or exist in one only."""
    a, b = current.alias("a"), stored.alias("b")
    same_key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = a.join(b, on=_all(same_key), how="full_outer")
    same = _all([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("fp_rows", "fp_sum_a", "fp_sum_b")])
    return joined.filter(~same).select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in by])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def changed_records(current: DataFrame, committed: DataFrame, scope: str, key: str, state: list[str], partitions: int | None = None) -> DataFrame:
    """Rows of ``current`` whose ``state`` columns differ from the ``committed`` row of the same
    ``scope`` and ``key``, that have no such row, or for which either side holds a null.

    ``current`` and ``committed`` hold at most one row for each (scope, key); rows without a key or
    a scope are dropped. Partitions are (scope, hash of key): one scope may hold most rows and still
    spread over ``partitions`` tasks. Partitions whose fingerprints agree and that hold no null state
    are skipped; the result does not depend on their number, which follows the rows unless given. Extra columns of ``current``
    pass through; ``committed`` contributes none.
    """
    partitions = partitions or partitions_for(current)
    known = F.col(key).isNotNull() & F.col(scope).isNotNull()
    cur = current.filter(known).withColumn("_part", partition_of(F.col(key), partitions))
    com = committed.filter(known).select(scope, key, *state).withColumn("_part", partition_of(F.col(key), partitions))
    by = [scope, "_part"]
    has_null = F.lit(False)
    for c in state:
        has_null = has_null | F.col(c).isNull()
    differing = changed_partitions(fingerprints(cur, by, [key, *state]), fingerprints(com, by, [key, *state]), by)
    open_state = cur.filter(has_null).select(*by).distinct()
    todo = materialise(differing.union(open_state).distinct())  # as many rows as partitions at most
    cur = cur.join(todo, by, "left_semi")
    com = com.join(todo, by, "left_semi").select(F.col(scope).alias("_s"), F.col(key).alias("_k"), *[F.col(c).alias(f"_was_{c}") for c in state])
    joined = cur.join(com, (F.col(scope) == F.col("_s")) & (F.col(key) == F.col("_k")), "left")
    same = _all([F.coalesce(F.col(c) == F.col(f"_was_{c}"), F.lit(False)) for c in state])
    return joined.filter(~same).select(*current.columns)


class PartitionedTarget:
    """A table that follows a source by recomputing only the partitions that changed.

    ``path`` holds ``data`` (partitioned by ``_part`` and the ``_run`` that wrote it) and fingerprint tables
    under ``prints``; the file ``CURRENT`` names, for every partition, the run whose rows are in force. A run
    writes the changed partitions by dynamic partition overwrite, then their fingerprints, then puts a new
    ``CURRENT`` in place. Readers see all of a run or nothing of it. A run that fails anywhere before that
    leaves ``CURRENT`` alone, so the next one finds the same partitions changed and overwrites what was
    left: no record is skipped and none is doubled. One run may write at a time.
    """

    def __init__(self, path: str, key: str, partitions: int | None = None):
        self.path, self.key, self.partitions = path.rstrip("/"), key, partitions

    def _current(self, spark) -> dict:
        return files.read_json(spark, f"{self.path}/CURRENT") or {"run": 0, "parts": {}}

    def read(self, spark) -> DataFrame:
        """The target's rows as of the last complete run. Before the first there is no table."""
        current = self._current(spark)
        schema = StructType.fromJson(current["schema"])
        paths = [f"{self.path}/data/_part={p}/_run={r}" for p, r in current["parts"].items()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def run(self, source: DataFrame, transform=lambda df: df, fail_before_commit: bool = False) -> int:
        """Bring the target up to ``source``; gives the number of partitions recomputed.

        ``transform`` maps rows of whole partitions and must keep the key column. Map columns are
        hashed as JSON. A partition whose records all vanished, or give no rows any more, is emptied. The
        number of partitions is settled by the first run (unless given, by the rows of the source).
        """
        spark = source.sparkSession
        current = self._current(spark)
        number = current.get("partitions") or self.partitions or partitions_for(source)
        flat = source.withColumn("_part", partition_of(F.col(self.key), number))
        hashed = flat
        for f in source.schema.fields:
            if f.dataType.typeName() in ("map", "array", "struct"):
                hashed = hashed.withColumn(f.name, F.to_json(f.name))
        now = materialise(fingerprints(hashed, ["_part"], list(source.columns)))
        run = current["run"] + 1
        stored = spark.read.schema(now.schema).parquet(f"{self.path}/prints/{current['run']}") if current["run"] else spark.createDataFrame([], now.schema)
        todo = [r[0] for r in changed_partitions(now, stored, ["_part"]).collect()]  # at most the number of partitions
        out = transform(flat.filter(F.col("_part").isin(todo)).drop("_part"))
        parts = {p: r for p, r in current["parts"].items() if int(p) not in set(todo)}
        if todo:
            rows = materialise(out.withColumn("_part", partition_of(F.col(self.key), number)).withColumn("_run", F.lit(run)))
            rows.repartition(len(todo), "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", "_run").parquet(f"{self.path}/data")
            parts |= {str(r[0]): run for r in rows.select("_part").distinct().collect()}
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/prints/{run}")
        files.write_json(spark, f"{self.path}/CURRENT", {"run": run, "partitions": number, "parts": parts, "schema": out.schema.jsonValue()})
        return len(todo)

    def vacuum(self, spark) -> int:
        """Delete what no reader of the current run needs; gives the number of folders deleted. Readers of
        earlier runs must have finished."""
        current, gone = self._current(spark), []
        for part in files.names(spark, f"{self.path}/data"):
            if part.startswith("_part="):
                kept = f"_run={current['parts'].get(part[6:])}"
                gone += [f"data/{part}/{r}" for r in files.names(spark, f"{self.path}/data/{part}") if r.startswith("_run=") and r != kept]
        gone += [f"prints/{r}" for r in files.names(spark, f"{self.path}/prints") if r != str(current["run"])]
        for path in gone:
            files.delete(spark, f"{self.path}/{path}")
        return len(gone)


def partitions_for(df: DataFrame) -> int:
    """Partitions of some ten thousand rows each, 64 at least: so many that a small change leaves most alone."""
    return max(64, df.count() // 20_000)


def open_run_changes(scanned: DataFrame, manifest: DataFrame, sync_runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Files of every source's open run that are new or changed since the last successful run.

    Gives ``run_id, source_id, doc_id, content_hash, index_profile_hash``. A file's state is its row
    with the latest ``mtime`` in the run (ties: the greatest hash); a null hash is computed from text
    and metadata, so texts stay behind the shuffle. The committed state is the manifest row of the
    document's latest run with status ``ok`` (ties: latest ``indexed_at``). Runs that failed leave no
    trace. Rows without a run, document or source are dropped.
    """
    runs = sync_runs.select("run_id", F.col("source_id").alias("run_source"), "status", F.col("index_profile_hash").alias("run_profile"))
    open_runs = runs.filter("status = 'open'").drop("status")
    hashed = scanned.select(
        "run_id",
        "doc_id",
        "mtime",
        F.when(F.col("content_hash").isNotNull(), F.col("content_hash")).otherwise(F.sha2(F.concat("text", F.lit("\n"), "metadata_json"), 256)).alias("content_hash"),
    )
    latest = hashed.join(open_runs, "run_id").groupBy("run_id", "doc_id").agg(
        F.max(F.struct("mtime", "content_hash")).alias("last"), F.first("run_source").alias("source_id"), F.first("run_profile").alias("index_profile_hash")
    )
    current = latest.select("run_id", "source_id", "doc_id", F.col("last.content_hash").alias("content_hash"), "index_profile_hash")
    ok = runs.filter("status = 'ok'").select("run_id", "run_source")
    rows = manifest.select("run_id", "doc_id", "content_hash", "index_profile_hash", "indexed_at").join(ok, "run_id")
    committed = rows.groupBy(F.col("run_source").alias("source_id"), "doc_id").agg(F.max(F.struct("run_id", "indexed_at", "content_hash", "index_profile_hash")).alias("last"))
    committed = committed.select("source_id", "doc_id", F.col("last.content_hash").alias("content_hash"), F.col("last.index_profile_hash").alias("index_profile_hash"))
    return changed_records(materialise(current), materialise(committed), "source_id", "doc_id", ["content_hash", "index_profile_hash"], partitions)
