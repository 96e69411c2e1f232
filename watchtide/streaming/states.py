"""Mergeable states of many micro-batches, folded so that a reader opens few folders.

Every batch adds a folder of states. Whenever ``FAN`` folders of one size lie at the end, Spark merges them into one of
the next size, so after n batches fewer than ``FAN`` folders of each of log(n) sizes are live. Which ones are live stands in a
ledger of two slots that are written in turn, each as one small file: if a write breaks off, the other slot still
tells the state before. No folder is changed once a ledger names it, so readers are never disturbed, and a batch that
is handed over again after the ledger knows it is left out. An ``out`` folder belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 16
LEDGER = "upto bigint, level int, folder string"
# Folders are named like partitions and the ledger is hidden, so that ``out`` as a whole reads as one table of states.
FOLDER = "batches="

Folder = tuple[int, str]  # level and name


def begin(spark: SparkSession, out: str) -> None:
    """An empty ledger where there is none."""
    spark.createDataFrame([(-1, None, None)], LEDGER).coalesce(1).write.mode("ignore").parquet(f"{out}/_ledger/slot=1")


def committed(spark: SparkSession, out: str) -> tuple[int, list[Folder]]:
    """The newest batch that counts, and the live folders from the oldest on; their number is bounded by the sizes."""
    rows = spark.read.schema(f"{LEDGER}, slot int").parquet(f"{out}/_ledger").collect()
    upto = max(r.upto for r in rows)
    named = {(r.level, r.folder) for r in rows if r.upto == upto and r.folder is not None}
    return upto, sorted(named, key=lambda f: int(f[1].split("-")[0]))


def folds(live: list[Folder], fan: int = FAN) -> list[tuple[list[Folder], Folder]]:
    """What to merge, in order, until no ``fan`` folders of one size are left at the end; ``live`` is changed to the outcome."""
    steps = []
    while len(live) >= fan and len({level for level, _ in live[-fan:]}) == 1:
        merged = live[-fan:]
        first, last = merged[0][1].split("-")[0], merged[-1][1].split("-")[1]
        live[-fan:] = [(merged[0][0] + 1, f"{first}-{last}")]
        steps.append((merged, live[-1]))
    return steps


def add(states: DataFrame, out: str, number: int, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Store the states of batch ``number`` and fold; ``merge`` gives one state per key, with the same columns."""
    spark = states.sparkSession
    upto, live = committed(spark, out)
    if number <= upto:
        return
    states.write.mode("overwrite").parquet(f"{out}/{FOLDER}{number}-{number}")
    live.append((0, f"{number}-{number}"))
    for merged, (_, name) in folds(live, fan):
        merge(_read(spark, out, merged)).write.mode("overwrite").parquet(f"{out}/{FOLDER}{name}")
    rows = [(number, level, name) for level, name in live]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{out}/_ledger/slot={number % 2}")


def _read(spark: SparkSession, out: str, folders: list[Folder]) -> DataFrame:
    return spark.read.parquet(*[f"{out}/{FOLDER}{name}" for _, name in folders])


def live_states(spark: SparkSession, out: str) -> DataFrame:
    """The states of all batches that count, each row once; those of one key are still to be merged."""
    upto, live = committed(spark, out)
    if not live:
        raise FileNotFoundError(f"no batch has been stored under {out}")
    return _read(spark, out, live)
