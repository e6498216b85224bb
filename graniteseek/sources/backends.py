"""Search backends as a Spark data source, asked for the queries that need them; and a writer of run traces.

`spark.dataSource.register(SearchSource)` makes a backend a table (query, status, body) that can only be read by its
query: the filter on `query` is pushed into the source and says what is asked.

    spark.read.format("search").options(backend="ddgs", fetch="my.module:fetch").load().filter(F.col("query").isin(...))

Spark may keep what a loaded frame has pushed, so load afresh for each set of queries; `filterPushdown` of Python sources
has to be enabled in the session.  `fetch(backend, query)` gives (status, body) and is the user's: this library has no network access of its own.  It runs
in the tasks, `per_task` queries each; a failed call is repeated, and one that keeps failing is a response with status
599 and no body, so it can't take down the others.  Queries in a table, however many, are asked by `asked`, a map.

`ask_in_turn` goes through the sources of a configured backend: each is asked only for the queries that none before has
answered, and the later ones not at all when nothing is left.

`TraceSource` writes run records as JSON lines.  Tasks write to a folder of their own run; the files move to their place
when all tasks have succeeded, then a marker is written.  Failed or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .payloads import Backends, backend_errors, parse_results
from .staging import staged

RESPONSE = "query string, status int, body string"
GAVE_UP = 599

Fetch = Callable[[str, str], tuple[int, str | None]]


def resolve(name: str) -> Fetch:
    """The function that `module:function` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def answer(fetch: Fetch, backend: str, query: str, attempts: int) -> tuple[int, str | None]:
    for _ in range(max(1, attempts)):
        try:
            return fetch(backend, query)
        except Exception:  # noqa: BLE001, S112  whatever the user's function raises
            continue
    return GAVE_UP, None


@dataclass
class Questions(InputPartition):
    queries: tuple[str, ...]


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.backend, self.fetch = options["backend"], options["fetch"]
        self.per_task, self.attempts = int(options.get("per_task", 16)), int(options.get("attempts", 3))
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else None
            if values is None or f.attribute != ("query",):
                yield f  # left to Spark
            else:
                own = {v for v in values if v is not None}
                self.asked = own if self.asked is None else self.asked & own

    def partitions(self) -> list[InputPartition]:
        if self.asked is None:
            raise ValueError("a search source is read by its queries: filter on `query`")
        queries = sorted(self.asked)
        return [Questions(tuple(queries[k : k + self.per_task])) for k in range(0, len(queries), self.per_task)] or [Questions(())]

    def read(self, partition: Questions) -> Iterator[tuple]:
        fetch = resolve(self.fetch)
        for query in partition.queries:
            yield query, *answer(fetch, self.backend, query, self.attempts)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> SearchReader:
        missing = {"backend", "fetch"} - {k.lower() for k in self.options}
        if missing:
            raise ValueError(f"options missing: {', '.join(sorted(missing))}")
        return SearchReader(dict(self.options))


def asked(queries: DataFrame, backend: str, fetch: str, attempts: int = 3) -> DataFrame:
    """query_id, query, status, body: the backend's response to every query of a table (query_id, query)."""
    def run(batches):
        call = resolve(fetch)
        for batch in batches:
            found = [answer(call, backend, q, attempts) if q is not None else (GAVE_UP, None) for q in batch.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.string())], names=["query_id", "query", "status", "body"])

    rows = queries.select("query_id", "query")
    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, query string, status int, body string")


def ask_in_turn(sources: dict[str, Callable[[DataFrame], DataFrame]], backends: Backends, queries: DataFrame, limit: int = 10) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Results of the first source that has any for a query, and each asked source's errors (query_id, error_code).

    sources: by backend, a function from the queries to ask to their responses (query_id, body, perhaps status).
    """
    left, found, errors = staged(queries.dropDuplicates(["query_id"]), "unanswered"), None, {}
    for backend in (backends.primary, *backends.fallbacks):
        if backend not in sources:
            continue
        if found is not None and left.isEmpty():
            break
        responses = staged(sources[backend](left), f"responses-{backend}")
        errors[backend] = backend_errors(responses, backend)
        good = responses.join(errors[backend].select("query_id"), "query_id", "left_anti")
        rows = parse_results(good, backend, limit)
        found = rows if found is None else found.unionByName(rows)
        left = staged(left.join(rows.select("query_id").distinct(), "query_id", "left_anti"), "unanswered")
    if found is None:
        raise ValueError("none of the backend's sources is given")
    return found, errors


# --- traces --------------------------------------------------------------------------------------------------------


@dataclass
class TraceFile(WriterCommitMessage):
    name: str
    rows: int


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class TraceWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.run}"

    def write(self, iterator: Iterator) -> TraceFile:
        fs, root = file_system(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}-{task.taskAttemptId()}.json"
        fs.create_dir(self._temporary(root), recursive=True)
        rows = 0
        with fs.open_output_stream(f"{self._temporary(root)}/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                rows += 1
        return TraceFile(name, rows)

    def commit(self, messages: list[TraceFile | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                fs.move(f"{self._temporary(root)}/{m.name}", f"{root}/{m.name}")
        for path in old:
            fs.delete_file(path)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._clear(fs, root)

    def abort(self, messages: list[TraceFile | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._temporary(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._temporary(root))


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def writer(self, schema: StructType, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"], overwrite)


def write_trace(rows: DataFrame, path: str) -> None:
    """Run records as JSON lines under `path`, all or none of them; nothing if the path is empty."""
    if path:
        rows.sparkSession.dataSource.register(TraceSource)
        rows.write.format("trace").mode("overwrite").save(path)
