"""A paged service as a Spark data source; the caller gives the fetch function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


PARAMETERS = ("offset", "limit", "page", "per_page", "cursor", "next_cursor")


def auth_headers(kind: str | None, token: str | None) -> dict[str, str]:
    """Request headers for bearer, basic or api_key."""
    if not kind or not token:
        return {}
    forms = {
        "bearer": ("Authorization", f"Bearer {token}"),
        "basic": ("Authorization", f"Basic {token}"),
        "api_key": ("X-API-Key", token),
    }
    if kind.lower() not in forms:
        raise ValueError(f"unknown auth kind: {kind}")
    name, value = forms[kind.lower()]
    return {name: value}


def answer_items(body) -> list[dict]:
    """Items of one parsed answer."""
    if isinstance(body, list):
        return body
    for key in ("data", "results"):
        if key in body:
            return body[key] if isinstance(body[key], list) else [body[key]]
    return [body]


class _Stride(InputPartition):
    def __init__(self, first: int, step: int, size: int):
        self.first, self.step, self.size = first, step, size


def _fetched(fetch, request):
    body = fetch(request)
    return json.loads(body) if isinstance(body, (str, bytes)) else body


class _PageReader(DataSourceReader):
    """Reads every `partitions`-th page until one is empty.

    Pages are dealt out in strides, so tasks read side by side without the total being
    known. A service may give fewer items per page than asked for: the first page tells how
    many make a window of offsets, and a window that comes up short is asked for the rest,
    so no page in the middle loses items. Numbered pages have no such way out: there the
    service has to keep its page length. A cursor has to be followed in order and is one
    partition.
    """

    def __init__(self, spec: dict, names: list[str]):
        self.spec, self.names = spec, names

    def partitions(self):
        spec = self.spec
        n = 1 if spec["paging"] == "cursor" else spec["partitions"]
        if spec["paging"] == "offset":
            where = {spec["names"]["offset"]: 0, spec["names"]["limit"]: spec["page_size"]}
            base = {"headers": spec["headers"], "params": {**spec["params"], **where}}
            got = len(answer_items(_fetched(spec["fetch"], base)))
            return [_Stride(i, n, min(got, spec["page_size"]) or 1) for i in range(n)]
        return [_Stride(i, n, spec["page_size"]) for i in range(n)]

    def _page(self, number: int, size: int) -> list[dict]:
        """Items of one page. A window of offsets that comes in parts is asked for to its end."""
        spec, name = self.spec, self.spec["names"]

        def asked(where: dict) -> list[dict]:
            base = {"headers": spec["headers"], "params": {**spec["params"], **where}}
            return answer_items(_fetched(spec["fetch"], base))

        if spec["paging"] == "page":
            return asked({name["page"]: number + 1, name["per_page"]: size})
        out: list[dict] = []
        while len(out) < size:
            part = asked({name["offset"]: number * size + len(out), name["limit"]: size - len(out)})
            if not part:
                break
            out += part[: size - len(out)]
        return out

    def _row(self, item: dict) -> tuple:
        return tuple(item.get(n) for n in self.names)

    def read(self, partition: _Stride) -> Iterator[tuple]:
        spec = self.spec
        base = {"headers": spec["headers"], "params": spec["params"]}
        name = spec["names"]
        if spec["paging"] == "cursor":
            cursor = None
            while True:
                params = {**base["params"], name["limit"]: spec["page_size"]}
                if cursor is not None:
                    params[name["cursor"]] = cursor
                body = _fetched(spec["fetch"], {**base, "params": params})
                items = answer_items(body)
                yield from map(self._row, items)
                cursor = body.get(name["next_cursor"]) if isinstance(body, dict) else None
                if not items or not cursor:
                    return
        page = partition.first
        while True:
            items = self._page(page, partition.size)
            if not items:
                return
            yield from map(self._row, items)
            page += partition.step


def paged_source(
    name: str,
    fetch: Callable[[dict], object],
    schema: str,
    paging: str = "offset",
    page_size: int = 100,
    partitions: int = 8,
    auth: str | None = None,
    token: str | None = None,
    params: dict | None = None,
    names: dict | None = None,
) -> type[DataSource]:
    """A data source class for `spark.dataSource.register`.

    `fetch` takes {headers, params} and gives the JSON answer; it runs on executors.
    paging is offset, page or cursor. `names` renames the parameters offset, limit, page,
    per_page and cursor, and the answer's field next_cursor.
    """
    if paging not in ("offset", "page", "cursor"):
        raise ValueError(f"unknown paging: {paging}")
    spec = {
        "fetch": fetch,
        "paging": paging,
        "page_size": page_size,
        "partitions": partitions,
        "headers": auth_headers(auth, token),
        "params": dict(params or {}),
        "names": {k: k for k in PARAMETERS} | dict(names or {}),
    }

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _PageReader(spec, [f.name for f in schema.fields])

    return Paged


def read_pages(spark: SparkSession, name: str, fetch, schema: str, **options) -> DataFrame:
    """Register a paged source and read it."""
    spark.dataSource.register(paged_source(name, fetch, schema, **options))
    return spark.read.format(name).load()
