"""Which model feeds which class."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from workmart.operators.incremental import after_source_marks, upsert_by_key
from workmart.operators.latest import any_by, latest_by
from workmart.operators.reshape import conform, empty_table, union_all
from workmart.plans.contracts import VERSIONLESS, contract
from workmart.sources.sinks import promote
from workmart.sources.tables import landed
from workmart.session import store


# Classes whose models give stored rows, so that reading them twice is cheap; keys that repeat are sent to
# the rows if there are at most so many.
STORED = ("class_task_field_history",)
FEW = 100_000


@dataclass
class Landed:
    """Landed tables by `schema.table`, the time a run is made at, and the column in which tables without a `source_id` of
    their own name the connection they came through."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    as_of: Column = field(default_factory=F.current_timestamp)
    source_column: str = "source_id"

    def __call__(self, name: str) -> DataFrame:
        return landed(self.tables[name])

    def newest(self, name: str) -> DataFrame:
        """The table with one row per key."""
        return promote(self(name))

    def has(self, *names: str) -> bool:
        return all(n in self.tables for n in names)

    def together(self, *names: str) -> DataFrame:
        """Union of those of the tables that exist (a table and its archive)."""
        return union_all(self(n) for n in names if n in self.tables)


@dataclass(frozen=True)
class Model:
    name: str
    cls: str
    needs: tuple[str, ...]
    build: Callable[[Landed], DataFrame]

    def __call__(self, tables: Landed) -> DataFrame:
        return conform(self.build(tables), contract(self.cls))


MODELS: dict[str, list[Model]] = {}


def feeds(cls: str, name: str, *needs: str):
    """Register a model. It runs only when the tables it needs have landed."""

    def keep(build: Callable[[Landed], DataFrame]) -> Model:
        model = Model(name, cls, needs, build)
        MODELS.setdefault(cls, []).append(model)
        return model

    return keep


def one_per_key(df: DataFrame, cls: str) -> DataFrame:
    if cls in VERSIONLESS:
        return any_by(df, ["unique_key"])
    plain = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    newest = lambda rows: latest_by(rows, ["unique_key"], ["_version"], [F.xxhash64(*plain)])
    if cls not in STORED:
        return newest(df)
    # Eight bytes of each key are shuffled to find those that repeat; a row is, only if its key is among them.
    key = F.xxhash64("unique_key")
    repeated = store(df.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > 1).select("__key"))
    found = repeated.count()
    if found == 0:
        return df
    if found > FEW:
        return newest(df)
    alone = df.join(repeated, key == F.col("__key"), "left_anti")
    return alone.unionByName(newest(df.join(repeated, key == F.col("__key"), "left_semi")))


def union_by_class(spark: SparkSession, cls: str, parts: Iterable[DataFrame]) -> DataFrame:
    """All contributions of a class, one row per key."""
    parts = list(parts)
    if not parts:
        return empty_table(spark, contract(cls))
    return one_per_key(union_all(parts), cls)


def build_class(cls: str, tables: Landed) -> DataFrame:
    ready = [m for m in MODELS.get(cls, []) if tables.has(*m.needs)]
    return union_by_class(tables.spark, cls, (m(tables) for m in ready))


def refresh_class(cls: str, target: DataFrame, tables: Landed) -> DataFrame:
    """Target plus what is newer than each source's own mark (I2, S6). The
    marks are applied before anything is deduplicated."""
    ready = [m for m in MODELS.get(cls, []) if tables.has(*m.needs)]
    if cls in VERSIONLESS or not ready:
        return build_class(cls, tables) if ready else target
    fresh = union_all(m(tables) for m in ready)
    # Git rows are stamped with the run's time; what is new shows in the
    # extraction time.
    mark = "_extracted_at" if "_extracted_at" in fresh.columns else "_version"
    newer = after_source_marks(fresh, target, mark)
    return upsert_by_key(target, newer, ["unique_key"], "_version")
