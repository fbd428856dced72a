"""A chunk table that is reloaded source by source, with a manifest that readers follow and a feed of changes.

Layout under the table's folder:

* ``data/load=N/slot=S``: what commit N loaded. A slot is a bucket of sources, so that the
  rows of a few sources are found without reading the others.
* ``feed/version=N``: the changes of commit N to sources that were there before, with the
  rows before and after. Rows of new sources are not written twice: they are the load.
* ``manifest/version=N``: the loads that a reader of version N reads, and for each the sources
  that a later load replaced.

Nothing is ever rewritten in place. A commit counts from the moment its manifest has its name;
readers go by the highest one, so they see all of a commit or nothing, and a reader of an
older version is not disturbed. A commit that failed is run again under the same number.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.schemas import CHUNKS
from ledgerlens.session import materialise

SLOTS = 64
BROADCAST_BYTES = 64 << 20
INSERT, BEFORE, AFTER, DELETE = "insert", "update_preimage", "update_postimage", "delete"


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


@dataclass(frozen=True)
class ChunkTable:
    """Chunks with a key of their own (``id``), each of one source."""

    spark: SparkSession
    path: str
    source: str = "source_file"
    key: str = "id"
    schema: StructType = CHUNKS
    slots: int = SLOTS

    # --- versions

    def _folder(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self, name: str, prefix: str) -> list[int]:
        store, place = self._folder(name)
        if not store.exists(place):
            return []
        names = [f.getPath().getName() for f in store.listStatus(place)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Committed versions that a reader may ask for, oldest first."""
        return self._numbers("manifest", "version=")

    def version(self) -> int:
        """The newest committed version; 0 for a table without any."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> DataFrame:
        """(load, source): live loads with no source, and the sources that are dead in a load."""
        fields = f"load bigint, `{self.source}` string"
        if version == 0:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(f"{self.path}/manifest/version={version}")

    # --- reading

    def scan(self, version: int | None = None) -> DataFrame:
        """The chunks of a version, the newest if none is named."""
        return self._live(self.version() if version is None else version).select(*self.schema.names)

    def _live(self, version: int, only: DataFrame | None = None) -> DataFrame:
        """Live rows with their load, all or those of ``only`` some sources."""
        manifest = self._manifest(version)
        # One row per load; compaction leaves one.
        loads = sorted(r[0] for r in manifest.where(F.col(self.source).isNull()).select("load").collect())
        fields = StructType([*self.schema.fields]).add("load", "long").add("slot", "integer")
        if not loads:
            return self.spark.createDataFrame([], fields)
        rows = self.spark.read.schema(fields).option("basePath", f"{self.path}/data").parquet(
            *[f"{self.path}/data/load={n}" for n in loads]
        )
        if only is not None:
            # At most as many slots as the table has.
            slots = [r[0] for r in only.select(self._slot()).distinct().collect()]
            rows = self._meet(rows.where(F.col("slot").isin(slots)), only, [self.source], "left_semi")
        dead = manifest.where(F.col(self.source).isNotNull())
        return rows if dead.isEmpty() else self._meet(rows, dead, ["load", self.source], "left_anti")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(self.source), F.lit(self.slots)).cast("int").alias("slot")

    def _meet(self, rows: DataFrame, names: DataFrame, on: list[str], how: str) -> DataFrame:
        """Chunks stay where they are if the names are measured small."""
        size = names.agg(F.coalesce(F.sum(F.octet_length(self.source) + 48), F.lit(0))).first()[0]
        return rows.join(F.broadcast(names) if size <= BROADCAST_BYTES else names, on, how)

    # --- writing

    def commit(self, chunks: DataFrame, sources: DataFrame | None = None) -> int:
        """Load ``chunks`` in place of all that their sources had; the new version's number.

        ``sources`` names the reloaded sources where some may have no chunks
        any more: those are removed. Every other source stays as it is, in the
        files it is in. Only slots of reloaded sources are read.
        """
        now = self.version()
        number = now + 1
        named = materialise((chunks if sources is None else sources).select(self.source).distinct(), "sources")
        loaded = chunks if sources is None else self._meet(chunks, named, [self.source], "left_semi")
        data = f"{self.path}/data/load={number}"
        # Rows of a slot lie together, in order of their source; a slot with very many is split.
        (
            loaded.select(*self.schema.names, self._slot()).hint("rebalance", "slot").sortWithinPartitions("slot", self.source)
            .write.mode("overwrite").partitionBy("slot").parquet(data)
        )
        old = materialise(self._live(now, named).select(*self.schema.names, "load"), "replaced")
        replaced = old.select("load", self.source).distinct()
        self._write_feed(old, number)
        live = self._manifest(now).unionByName(replaced).unionByName(
            self.spark.createDataFrame([(number, None)], f"load bigint, `{self.source}` string")
        )
        self._publish(live, number)
        return number

    def _write_feed(self, old: DataFrame, number: int) -> None:
        """Changes of sources that were there: rows that differ, before and after."""
        again = materialise(old.select(self.source).distinct(), "again")
        fields = StructType([*self.schema.fields]).add("slot", "integer")
        new = self.spark.read.schema(fields).parquet(f"{self.path}/data/load={number}").select(*self.schema.names)
        new = self._meet(new, again, [self.source], "left_semi")
        image = F.struct(*self.schema.names)
        was = old.select(F.col(self.key).alias("_key"), image.alias("_was"))
        is_ = new.select(F.col(self.key).alias("_key"), image.alias("_is"))
        pair = was.join(is_, "_key", "full_outer").where(~F.col("_was").eqNullSafe(F.col("_is")))
        kind = F.when(F.col("_was").isNull(), F.array(_change(INSERT, "_is"))).when(
            F.col("_is").isNull(), F.array(_change(DELETE, "_was"))
        ).otherwise(F.array(_change(BEFORE, "_was"), _change(AFTER, "_is")))
        feed = pair.select(F.explode(kind).alias("_c")).select("_c.change", "_c.row.*")
        feed.write.mode("overwrite").parquet(f"{self.path}/feed/version={number}")

    def _publish(self, manifest: DataFrame, number: int) -> None:
        """Give the manifest its name, which only the first writer of a version can."""
        draft = f"drafts/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/{draft}")
        store, place = self._folder(draft)
        _, target = self._folder(f"manifest/version={number}")
        store.mkdirs(target.getParent())
        if store.exists(target) or not store.rename(place, target):
            store.delete(place, True)
            raise CommitConflict(f"version {number} of {self.path} is there already")

    # --- changes

    def changes(self, version: int) -> DataFrame:
        """(change, chunk columns, version): the rows that commit ``version`` inserted, updated or deleted.

        An update gives the row before and the row after. A compaction
        changes nothing.
        """
        columns = ["change", *self.schema.names]
        if f"{version}" not in map(str, self._numbers("feed", "version=")):
            return self.spark.createDataFrame([], StructType().add("change", "string")).select(
                "change", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(version).cast("bigint").alias("version")
            )
        fields = StructType().add("change", "string")
        for field in self.schema.fields:
            fields = fields.add(field)
        feed = self.spark.read.schema(fields).parquet(f"{self.path}/feed/version={version}")
        load = self.spark.read.schema(StructType([*self.schema.fields])).parquet(f"{self.path}/data/load={version}")
        dead = self._manifest(version).join(self._manifest(version - 1) if version > 1 else self._manifest(0), ["load", self.source], "left_anti")
        again = dead.where(F.col(self.source).isNotNull()).select(self.source).distinct()
        fresh = load if again.isEmpty() else self._meet(load, again, [self.source], "left_anti")
        inserts = fresh.withColumn("change", F.lit(INSERT)).select(*columns)
        return feed.select(*columns).unionByName(inserts).withColumn("version", F.lit(version).cast("bigint"))

    # --- upkeep

    def compact(self) -> int:
        """All live rows as one load under a new version, for readers to come."""
        now = self.version()
        number = now + 1
        live = self._live(now).select(*self.schema.names, self._slot())
        live.hint("rebalance", "slot").sortWithinPartitions("slot", self.source).write.mode("overwrite").partitionBy("slot").parquet(
            f"{self.path}/data/load={number}"
        )
        self._publish(self.spark.createDataFrame([(number, None)], f"load bigint, `{self.source}` string"), number)
        return number

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove loads that none of the newest ``keep`` versions reads, and older manifests; the loads removed."""
        kept = self.versions()[-keep:]
        live = {r[0] for v in kept for r in self._manifest(v).where(F.col(self.source).isNull()).select("load").collect()}
        gone = [n for n in self._numbers("data", "load=") if n not in live and n <= self.version()]
        for name in [f"manifest/version={v}" for v in self.versions() if v not in kept] + [f"data/load={n}" for n in gone]:
            store, place = self._folder(name)
            store.delete(place, True)
        return gone


def _change(kind: str, row: str) -> Column:
    return F.struct(F.lit(kind).alias("change"), F.col(row).alias("row"))
