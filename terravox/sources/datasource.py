"""The formats as a Spark data source: spark.read.format("terravox").option("kind", "pset").load(path)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .codecs import FORMATS
from .files import kind_of


@dataclass
class OneFile(InputPartition):
    path: str


class FormatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.kind = options.get("kind") or kind_of(self.path)

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        return [OneFile(f"{scheme}://{f.path}") for f in found if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        from pyarrow import fs

        schema, decode, _ = FORMATS[self.kind]
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(path) as f:
            rows = decode(f.read())[[c.split()[0] for c in schema.split(", ")]]
        yield from rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)


class FormatSource(DataSource):
    """Register with spark.dataSource.register(FormatSource). Files must lie where executors can open them by pyarrow."""

    @classmethod
    def name(cls) -> str:
        return "terravox"

    def schema(self) -> str:
        return FORMATS[self.options.get("kind") or kind_of(self.options["path"])][0]

    def reader(self, schema) -> FormatReader:
        return FormatReader(self.options)
