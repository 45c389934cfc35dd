"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Add columns that are computed once per row, whatever later steps do with them.

    Long CASE chains that later columns and filters mention several times would be
    copied into each of them when projections are merged.  A one-row generator
    keeps them apart.  ``where`` (over the new columns' struct) drops rows.
    """
    kept = keep if keep is not None else [c for c in df.columns if c not in cols]
    made = F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))
    out = df.select(*kept, F.inline(made))
    return out.filter(where) if where is not None else out


#: Partitions that ``spread`` deals rows to; small ones are put together again by adaptive execution.
SPREAD = 2000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in many partitions, so that a task's sorts do not grow with the input.

    The session's number of shuffle partitions is fixed whatever the input; adaptive execution joins small partitions up
    to its advisory size but does not split those of windows and joins.
    """
    return df.hint("rebalance", SPREAD, *[F.col(k) for k in keys])


def checkpoint_folder(spark) -> str:
    """The shared folder named by the session; one beside the warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder: later passes reread them and survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
