"""Files and folders in whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    system, place = _at(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the visible entries of a folder, by name; none if there is no folder."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    found = [(f.getPath(), f.getLen()) for f in system.listStatus(place)]
    return sorted((p.toString(), size) for p, size in found if p.getName()[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder; nothing happens if it is gone."""
    system, place = _at(spark, path)
    system.delete(place, True)
