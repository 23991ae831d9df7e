"""REST endpoints as a Python data source: pages are read by an executor, not on the driver."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.shipping import ship
from millrace.types import schema_of


def dig(document: Any, path: str | None) -> Any:
    """The value at a dotted path, or None."""
    for key in path.split(".") if path else []:
        if isinstance(document, list) and key.isdigit() and int(key) < len(document):
            document = document[int(key)]
        elif isinstance(document, Mapping):
            document = document.get(key)
        else:
            return None
    return document


def records_of(document: Any, path: str | None) -> list[dict]:
    """The records of a page: a list as it is, anything else but None as one."""
    found = dig(document, path)
    return [] if found is None else found if isinstance(found, list) else [found]


def fetch(url: str, spec: Mapping[str, Any], data: bytes | None = None, method: str | None = None) -> bytes:
    """One request with headers and auth (basic: user and password; token; api_key). Tries up to
    max_retries more times, with a delay that doubles; client errors but 429 are final."""
    headers = dict(spec.get("headers") or {})
    auth = spec.get("auth") or {}
    if "user" in auth:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{auth['user']}:{auth.get('password', '')}".encode()).decode()
    elif "token" in auth:
        headers["Authorization"] = f"Bearer {auth['token']}"
    elif "api_key" in auth:
        headers[auth.get("header", "X-API-Key")] = auth["api_key"]
    delay = float(spec.get("retry_delay", 1.0))
    for attempt in range(int(spec.get("max_retries", 3)) + 1):
        try:
            request = urllib.request.Request(url, data=data, headers=headers, method=method or spec.get("method", "GET"))
            with urllib.request.urlopen(request, timeout=float(spec.get("timeout", 30))) as answer:
                return answer.read()
        except (urllib.error.URLError, TimeoutError) as e:
            final = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
            if final or attempt == int(spec.get("max_retries", 3)):
                raise
            time.sleep(delay * 2**attempt)
    raise AssertionError


def pages(spec: Mapping[str, Any]) -> Iterator[Any]:
    """Documents, one after another: pagination.next_page_path leads to the next URL,
    pagination.param_updates {parameter: path} to the next parameters; neither, and it ends."""
    url, params = spec["url"], dict(spec.get("params") or {})
    pagination, rate = spec.get("pagination") or {}, spec.get("rate_limit")
    while url:
        begun = time.monotonic()
        full = url + (("&" if "?" in url else "?") + urllib.parse.urlencode(params) if params else "")
        document = json.loads(fetch(full, spec))
        yield document
        following = None
        if path := pagination.get("next_page_path"):
            following = dig(document, path)
            if following:
                following, params = urllib.parse.urljoin(url, following), {}
        elif updates := pagination.get("param_updates"):
            found = {k: dig(document, p) for k, p in updates.items()}
            if all(v is not None for v in found.values()):
                params, following = params | found, url
        url = following
        if rate and url:
            time.sleep(max(0.0, 1 / float(rate) - (time.monotonic() - begun)))


class RestReader(DataSourceReader):
    def __init__(self, spec: dict, schema: StructType) -> None:
        self.spec, self.schema = spec, schema

    def partitions(self) -> list[InputPartition]:
        """One for each URL of `urls`, or the one URL."""
        return [InputPartition(url) for url in self.spec.get("urls") or [self.spec["url"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for document in pages(self.spec | {"url": partition.value}):
            for record in records_of(document, self.spec.get("records_path")):
                named = record if isinstance(record, dict) else {self.schema[0].name: record}  # a bare value is the first column
                yield tuple(self._value(named.get(f.name), f.dataType.typeName()) for f in self.schema)

    @staticmethod
    def _value(value: Any, kind: str) -> Any:
        if value is None or kind in ("struct", "array", "map"):
            return value
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value)
        return float(value) if kind in ("double", "float") else value


class RestSource(DataSource):
    """Option spec: the source's spec as JSON."""

    @classmethod
    def name(cls) -> str:
        return "millrace_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(json.loads(self.options["spec"]), schema)


def read(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """url or urls, schema; headers, params, auth, records_path, pagination, rate_limit (requests a
    second), max_retries, retry_delay, timeout."""
    if "schema" not in spec:
        raise ValueError("a REST source needs a schema")
    schema = schema_of(spec["schema"]) if isinstance(spec["schema"], Mapping) else spec["schema"]
    ship(spark)
    spark.dataSource.register(RestSource)
    plain = {k: v for k, v in spec.items() if k != "schema"}
    return spark.read.format("millrace_rest").schema(schema).option("spec", json.dumps(plain)).load()
