"""A store of rows by key: a log in buckets, read at a few points without a scan.

Rows are appended; the newest of a key counts.  Each append is written by
bucket, which is a hash of the key, sorted by key and with a bloom filter in
each file.  A look-up goes to the buckets of its keys only; where it asks for
few keys, they are pushed into the scan, where statistics and filters skip the
row groups that do not have them.

Compaction puts the newest row of each key in the place of the folders that it
has read; what others append meanwhile stays, and readers keep their version.

Defined results: a null key is refused (``put`` leaves it out); of equally new
rows of a key the greatest ``tie`` counts; keys that are asked for more than
once come once; an empty store answers with no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import NOT_FOUND, latest
from .snapshots import Snapshots, Version

#: Keys that are written into the filter of the scan, at most.
FEW = 1000
LOG = "log"


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, key: str = "paper_id", by: str = "fetched_at", tie: str = "response_json", buckets: int = 64):
        """``buckets`` is the number of the first run: it is part of the layout."""
        self.spark, self.key, self.by, self.tie, self.buckets = spark, key, by, tie, buckets
        options = {f"parquet.bloom.filter.enabled#{key}": "true"}
        self.log = Snapshots(spark, root, partition_by=("bucket",), options=options)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())
        return rows.repartition("bucket").sortWithinPartitions("bucket", self.key)

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        return self.log.publish(append={LOG: self._laid_out(rows)}, batch=batch)

    def entries(self, keys: DataFrame) -> DataFrame | None:
        """All rows of the asked keys, from the buckets of these keys only; None if nothing was ever put."""
        if LOG not in self.log.version().schemas:
            return None
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        buckets = sorted(r.bucket for r in asked.select(self._bucket().alias("bucket")).distinct().collect())  # a fixed number at most
        rows = self.log.read(LOG).where(F.col("bucket").isin(buckets))
        few = asked.limit(FEW + 1).collect()
        if len(few) <= FEW:
            rows = rows.where(F.col(self.key).isin([r[0] for r in few]))
        else:
            rows = rows.join(asked, self.key, "left_semi")
        return rows.drop("bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """The newest row of each of the asked keys that the store has."""
        rows = self.entries(keys)
        if rows is None:
            return keys.select(self.key).limit(0)
        return latest(rows, self.key, self.by, self.tie)

    def probe(self, keys: DataFrame) -> DataFrame:
        """``status`` of each asked key: ``hit``, ``negative`` (known not to exist) or ``miss``, with its newest row."""
        found = self.get(keys)
        if self.tie not in found.columns:
            return keys.withColumn("status", F.lit("miss"))
        status = F.when(F.col(self.tie).isNull(), "miss").when(F.col(self.tie) == NOT_FOUND, "negative").otherwise("hit")
        return keys.join(found, self.key, "left").withColumn("status", status)

    def compact(self) -> Version:
        """One folder with the newest row of each key, for the folders that are there now."""
        at = self.log.version()
        rows = self.log.read(LOG, at.number).drop("bucket")
        newest = latest(rows, self.key, self.by, self.tie).select(*rows.columns)
        return self.log.publish(swap={LOG: (self._laid_out(newest), at.folders[LOG])})
