"""Query registry: one declared output schema shared by Spark and the SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from contestlake.functions.plan import checkpoint_folder
from workload import views

_SPARK = {"l": "bigint", "s": "string", "d": "double"}
_DUCK = {"l": "BIGINT", "s": "VARCHAR", "d": "DOUBLE"}


def _parse(cols: str) -> list[tuple[str, str, int]]:
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        kind = kind or "l"
        out.append((name, kind[0], int(kind[1:] or 6) if kind[0] == "d" else 0))
    return out


def rounded(col, places: int):
    """Rounding spelled out so both engines agree on halfway values."""
    return F.floor(col.cast("double") * F.lit(10.0 ** places) + F.lit(0.5001)) / F.lit(10.0 ** places)


class Tables:
    """The given tables of one scale factor, and the views derived from them.

    Nearly every view starts from the contests, and a query reads several views: each would deal out and sort all line
    items anew.  So the contests of a query are written once, as Parquet in the shared folder, and reread.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._stored = spark, sf_dir, {}

    def _shape(self, text: str) -> DataFrame:
        if "contest" in views.needed(text) and not self._stored:
            path = f"{checkpoint_folder(self.spark).rstrip('/')}/views-{uuid.uuid4().hex}/contest"
            self.spark.sql(views.spark_text("contest", self.sf_dir)).write.parquet(path)
            self._stored["contest"] = path
        return self.spark.sql(views.spark_wrap(text, self.sf_dir, self._stored))

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in views.VIEWS:
            return self._shape(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Input shaping in plain SQL over the tables and views."""
        return self._shape(text)


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, cols: str, sql: str | None = None):
        spec = _parse(cols)

        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = fn(Tables(spark, sf_dir))
                return out.select(*[
                    rounded(F.col(c), n).alias(c) if k == "d"
                    else F.col(c).cast(_SPARK[k]).alias(c)
                    for c, k, n in spec])

            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = run
            if sql is not None:
                select = ", ".join(
                    f"floor(CAST({c} AS DOUBLE) * 1E{n} + 0.5001E0) / 1E{n} AS {c}" if k == "d"
                    else f"CAST({c} AS {_DUCK[k]}) AS {c}" for c, k, n in spec)
                self.oracles[name] = views.duck_wrap(f"SELECT {select} FROM (\n{sql.strip()}\n) AS q")
            return fn

        return register


REGISTRY = Registry()
query = REGISTRY.add
