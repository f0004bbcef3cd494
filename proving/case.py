"""A case is one operator over the given tables and, where SQL can say it, the
same result in SQL. `spec` lists the result columns as name:kind; both sides
are brought to the same plain types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from proving.given import Given, with_derived
from workmart.session import ROWS_PER_FILE_SIZE

# kind -> (Spark expression, SQL expression)
KINDS = {
    "s": ("cast({c} as string)", "cast({c} as varchar)"),
    "i": ("cast({c} as bigint)", "cast({c} as bigint)"),
    "f": ("case when cast({c} as double) = rint({c}) then cast({c} as double) else round(round(cast({c} as double), 12), 4) end + 0.0D", "round(cast({c} as double), 4) + 0.0"),
    "d": ("cast(cast({c} as date) as string)", "cast(cast({c} as date) as varchar)"),
    "t": ("unix_micros({c})", "cast(epoch_us({c}) as bigint)"),
    "b": ("cast({c} as boolean)", "cast({c} as boolean)"),
    "a": ("concat_ws('|', {c})", "coalesce(array_to_string({c}, '|'), '')"),
}


@dataclass(frozen=True)
class Case:
    name: str
    spec: str
    build: Callable[[Given], DataFrame]
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.spec.split()]

    def query(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for name, value in ROWS_PER_FILE_SIZE.items():
            spark.conf.set(name, value)
        df = self.build(Given(spark, folder))
        return df.select(*[F.expr(KINDS[k][0].format(c=f"`{n}`")).alias(n) for n, k in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(f'{KINDS[k][1].format(c=chr(34) + n + chr(34))} AS "{n}"' for n, k in self.columns())
        return with_derived(f"SELECT {picked} FROM ({self.sql}) AS answer")


CASES: dict[str, Case] = {}


def case(name: str, spec: str, sql: str | None = None):
    def keep(build: Callable[[Given], DataFrame]) -> Callable[[Given], DataFrame]:
        if name in CASES:
            raise ValueError(name)
        CASES[name] = Case(name, spec, build, sql)
        return build

    return keep
