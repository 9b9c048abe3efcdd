"""A manifest of panels served over HTTP, as a Python data source: one partition per file, pruned by name.

``spark.dataSource.register(RemotePanel)``, then
``spark.read.format("remote_panel").option("index", url).option("panel", name).schema(...).load()``.
Options: ``key`` (sent as a query parameter), ``start`` and ``end``.
"""

from __future__ import annotations

import io
import json
import urllib.request
from urllib.parse import quote, urljoin

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fetch(url: str, key: str | None) -> bytes:
    with urllib.request.urlopen(url + (f"?key={quote(key)}" if key else ""), timeout=60) as r:
        return r.read()


class Part(InputPartition):
    def __init__(self, url: str):
        self.url = url


class RemoteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = [f.name for f in schema.fields], dict(options)

    def partitions(self) -> list[Part]:
        from .catalog import wanted

        panels = json.loads(_fetch(self.options["index"], self.options.get("key")))["panels"]
        files = panels[self.options["panel"]]["files"]
        return [Part(urljoin(self.options["index"], f)) for f in files if wanted(f, self.options.get("start"), self.options.get("end"))]

    def read(self, partition: Part):
        import pyarrow.parquet as pq

        table = pq.read_table(io.BytesIO(_fetch(partition.url, self.options.get("key"))))
        have = [c for c in self.names if c in table.column_names]
        for row in table.select(have).to_pylist():
            yield tuple(row.get(c) for c in self.names)


class RemotePanel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_panel"

    def schema(self) -> str:
        """The columns of the panel's first file."""
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        options = dict(self.options)
        panels = json.loads(_fetch(options["index"], options.get("key")))["panels"]
        first = urljoin(options["index"], panels[options["panel"]]["files"][0])
        return from_arrow_schema(pq.read_schema(io.BytesIO(_fetch(first, options.get("key")))))

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(schema, self.options)
