"""Tables that grow by micro-batches and are read through few folders.

Every batch has a folder of its own, which a replay overwrites. When ``FAN`` folders of a level are there,
they are merged into one of the next level, so that n batches are read through about FAN folders per
level, and there are log(n) levels. A folder counts once Spark has marked it as complete: readers
take the highest complete folder of a stretch of batches, so a merge that dies, or runs again,
changes nothing that they see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

FAN = 32
Merge = Callable[[DataFrame], DataFrame]


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def _is_complete(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _folder(out: str, level: int, part: int) -> str:
    return f"{out}/level-{level}/{part}"


def chosen(found: Iterable[tuple[int, int]], fan: int) -> list[tuple[int, int]]:
    """Of complete folders (level, part), those that no other one covers."""
    there = set(found)
    top = max((level for level, _ in there), default=0)

    def covered(level: int, part: int) -> bool:
        return any((up, part // fan ** (up - level)) in there for up in range(level + 1, top + 1))

    return sorted(f for f in there if not covered(*f))


def _listed(spark: SparkSession, out: str, before: int | None) -> list[tuple[int, int]]:
    """Folders to read. Whether one is complete is only asked of those that could be read: from the
    highest level down, and not below a complete one."""
    there: set[tuple[int, int]] = set()
    levels = sorted((int(n.removeprefix("level-")) for n in _names(spark, out) if n.startswith("level-")), reverse=True)
    for level in levels:
        for part in sorted(int(n) for n in _names(spark, f"{out}/level-{level}") if n.isdigit()):
            late = before is not None and (part + 1) * FAN**level > before
            above = any((up, part // FAN ** (up - level)) in there for up in levels if up > level)
            if not late and not above and _is_complete(spark, _folder(out, level, part)):
                there.add((level, part))
    return chosen(there, FAN)


def write_batch(rows: DataFrame, out: str, batch_id: int, merge: Merge) -> None:
    """Stores a batch, and merges the folders that it completes."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(_folder(out, 0, batch_id))
    level = 1
    while (batch_id + 1) % FAN**level == 0:
        part = (batch_id + 1) // FAN**level - 1
        below = [_folder(out, level - 1, k) for k in range(part * FAN, (part + 1) * FAN)]
        below = [f for f in below if _is_complete(spark, f)]
        merge(spark.read.parquet(*below)).write.mode("overwrite").parquet(_folder(out, level, part))
        level += 1


def read_batches(spark: SparkSession, out: str, schema: str | None = None, before: int | None = None) -> DataFrame:
    """All rows of the batches, or of those before one. Without any, an empty table of ``schema``."""
    paths = [_folder(out, level, part) for level, part in _listed(spark, out, before)]
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)
