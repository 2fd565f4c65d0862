"""Tables kept by buckets of their keys, whose upserts rewrite only the buckets that changes fall into."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vellum.storage import discard, stage

BUCKET, BATCH = "_bucket", "_batch"


@dataclass(frozen=True)
class Bucketed:
    """Parquet files in the shared folder ``path``, a partition for each hash of ``keys`` modulo ``buckets``.

    Choose so many buckets that one is some hundred megabytes: it is what a task rewrites. A table that begins without rows
    needs a ``schema``.
    """

    path: str
    keys: list[str] = field(default_factory=list)
    buckets: int = 64
    schema: StructType | None = None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """A table of ``rows``, which have one row a key; there must be none yet."""
        self._written(rows.withColumn(BATCH, F.lit(-1).cast("long")), "errorifexists")

    def _written(self, rows: DataFrame, mode: str) -> None:
        placed = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)

    def _stored(self, spark: SparkSession) -> DataFrame:
        if self.schema is None:
            return spark.read.parquet(self.path)
        return spark.read.schema(StructType([*self.schema.fields, StructField(BATCH, LongType()), StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(BUCKET, BATCH)

    def upsert(self, changes: DataFrame, batch: int, fill: bool = False) -> dict[str, int]:
        """Put ``changes`` (one row a key, null equals null) in place of the rows of their keys, or beside them where there are none.

        Columns that ``changes`` lacks keep their values; with ``fill`` so do those where it has null or an empty string.
        Only buckets that changes fall into are read and written. Rows keep the number of the batch that changed them last,
        and a batch changes only rows of earlier ones: one that runs again, after a loss in the middle or late, changes
        nothing that it or a later one has changed. Counts: rows inserted, updated and skipped for that, and buckets rewritten.
        """
        spark = changes.sparkSession
        own = stage(changes.withColumn(BUCKET, self._bucket()), "changes")
        touched = sorted(r[0] for r in own.select(BUCKET).distinct().collect())
        if not touched:
            discard(own)
            return {"inserted": 0, "updated": 0, "skipped": 0, "buckets": 0}
        target = self._stored(spark)
        kinds, columns = dict(target.dtypes), [c for c in target.columns if c not in (BUCKET, BATCH)]
        named = own.select(*[F.col(c).alias(f"_c_{c}") for c in own.columns], F.lit(True).alias("_new"))
        on = F.col(BUCKET) == F.col(f"_c_{BUCKET}")
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        both = target.where(F.col(BUCKET).isin(touched)).join(named, on, "full")
        new, old = F.col("_new").isNotNull(), F.col(BATCH).isNotNull()
        apply = new & (~old | (F.col(BATCH) < batch))

        def value(c: str) -> Column:
            if c not in changes.columns:
                return F.col(c)
            given = F.col(f"_c_{c}").cast(kinds[c])
            if fill:
                given = F.coalesce(F.when(given.cast("string") != "", given), F.col(c))
            return F.when(apply, given).otherwise(F.col(c)).cast(kinds[c]).alias(c)

        n = lambda x: F.count(F.when(x, 1))
        seen = Observation("upsert")
        both = both.observe(seen, n(new & ~old).alias("inserted"), n(apply & old).alias("updated"), n(new & ~apply).alias("skipped"))
        self._written(both.select(*[value(c) for c in columns], F.when(apply, F.lit(batch)).otherwise(F.col(BATCH)).cast("long").alias(BATCH)), "overwrite")
        discard(own)
        return {**{k: int(v) for k, v in seen.get.items()}, "buckets": len(touched)}
