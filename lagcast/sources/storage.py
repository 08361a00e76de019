"""Shared storage: files that appear whole, and folders whose content is replaced without a gap.

What a path holds is written as a new version beside the old one; a pointer, an empty
file that names it, is renamed into place last. Readers take the version of the highest
pointer, so at any moment they find the old content or the new one.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_POINTER, _VERSION = "current-", "version-"
KEPT = 3  # versions that stay for readers under way


class Storage:
    """The file system of a session's paths, whichever it is."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place)

    def names(self, pattern: str) -> list[str]:
        """Names that match a pattern, sorted; none where the folder is missing."""
        system, place = self._at(pattern)
        return sorted(found.getPath().getName() for found in system.globStatus(place) or [])

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)

    def rename(self, source: str, target: str) -> None:
        """Moves a file or folder to a path where nothing is."""
        system, place = self._at(source)
        new = self._jvm.org.apache.hadoop.fs.Path(target)
        system.mkdirs(new.getParent())
        if not system.rename(place, new):
            raise OSError(f"could not rename {source} to {target}")

    def mark(self, path: str) -> None:
        """An empty file that is there at once or not at all."""
        folder, _, name = path.rpartition("/")
        hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        system, place = self._at(hidden)
        system.create(place).close()
        self.rename(hidden, path)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace what ``path`` holds by what ``write`` puts into the folder it is given.

    Of two writers at once the one with the higher number counts, or name if they are
    equal. The last ``KEPT`` versions stay.
    """
    storage, path = Storage(spark), path.rstrip("/")
    before = storage.names(f"{path}/{_POINTER}*")
    number = int(before[-1].removeprefix(_POINTER).partition("-")[0]) + 1 if before else 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    write(f"{path}/{_VERSION}{name}")
    storage.mark(f"{path}/{_POINTER}{name}")
    for pointer in [*before, _POINTER + name][:-KEPT]:
        storage.delete(f"{path}/{pointer}")
        storage.delete(f"{path}/{_VERSION}{pointer.removeprefix(_POINTER)}")


def published(spark: SparkSession, path: str) -> str | None:
    """The folder with what ``path`` holds now; None if that is nothing.

    A folder without a pointer, written by something else, holds its own content.
    """
    storage, path = Storage(spark), path.rstrip("/")
    pointers = storage.names(f"{path}/{_POINTER}*")
    if pointers:
        return f"{path}/{_VERSION}{pointers[-1].removeprefix(_POINTER)}"
    unfinished = storage.names(f"{path}/{_VERSION}*")
    return path if storage.exists(path) and not unfinished else None
