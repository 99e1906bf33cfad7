"""Image files as a sink: ``df.write.format("pngfiles")``, all of them or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its own folder under the staging folder, and the names of its files."""

    folder: str
    names: list[str]


class PngWriter(DataSourceWriter):
    """Tasks write to folders of their own beside the target; the driver moves the files when every task has ended well."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def _place(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        # A task that runs again, or beside itself, has another folder; only that of the attempt that ended counts.
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store, at = self._place(folder)
        store.create_dir(at, recursive=True)
        names: list[str] = []
        for row in iterator:
            name, data = row["file"], row["png"]
            if not name or "/" in name or data is None:
                raise ValueError(f"no image file: {name!r}")
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(bytes(data))
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._place(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(every) != len(set(every)):
            self.abort(messages)
            raise ValueError(f"two images of one name: {sorted(n for n in set(every) if every.count(n) > 1)[:5]}")
        for m in done:
            own = self._place(m.folder)[1]
            for n in m.names:
                store.move(f"{own}/{n}", f"{at}/{n}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._place(self.staging)
        if store.get_file_info(at).type.name == "Directory":
            store.delete_dir(at)


class PngFiles(DataSource):
    """Rows (file, png) as files of these names in the folder ``path``; files there of the same names are replaced."""

    @classmethod
    def name(cls) -> str:
        return "pngfiles"

    def schema(self) -> str:
        return "file string, png binary"

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"])


def write_files(images: DataFrame, path: str) -> None:
    """The files of ``images`` (file, png) in a folder that all executors reach: all, or none if any task fails or two have one name.

    No file is seen under its name before all are written. The staging folder goes at the end; what a task that is still running when another
    fails writes later stays in it, under a name (``_staging-``) that readers skip.
    """
    images.sparkSession.dataSource.register(PngFiles)
    images.select("file", "png").write.format("pngfiles").mode("append").option("path", path).save()
