"""Tells metadata catalogs over their REST interfaces what export.payload says, a field at a time, from the tasks.

A failure on one field, or one aspect of it, is counted and doesn't stop the
others; statistics count what was tried, as planned in the payload.
"""

from __future__ import annotations

import base64
import urllib.parse
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from ..errors import RemoteError
from ..http import Transport, call, over_network

PREFIX = "tessera_"  # of attributes that are ours


def bearer(token: str | None) -> dict[str, str]:
    return {"Authorization": f"Bearer {token}"} if token else {}


def basic(user: str, password: str) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()}


@dataclass
class Emitter:
    """url: the catalog's root. replace: what is there of ours goes first, where the catalog keeps anything."""

    url: str
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    replace: bool = False
    timeout: float = 30.0
    transport: Transport = over_network

    def ask(self, method: str, path: str, body: object = None, query: dict[str, str] | None = None, kind: str = "application/json", missing: bool = False):
        """The answer; None for a missing thing if that may be."""
        status, answer = call(method, self.url.rstrip("/") + path, body, self.headers, query, self.timeout, self.transport, kind)
        if missing and status == 404:
            return None
        if status >= 400:
            raise RemoteError(f"{method} {path}: {status}")
        return answer

    def emit(self, row: Row) -> None:
        raise NotImplementedError


class DataHub(Emitter):
    """Aspects of schema fields, overwritten as wholes (upsert)."""

    def aspect(self, urn: str, name: str, value: dict) -> None:
        import json

        proposal = {"entityType": "schemaField", "changeType": "UPSERT", "entityUrn": urn, "aspectName": name, "aspect": {"contentType": "application/json", "value": json.dumps(value)}}
        self.ask("POST", "/aspects?action=ingestProposal", {"proposal": proposal})

    def emit(self, row: Row) -> None:
        if row.tags:
            self.aspect(row.address, "globalTags", {"tags": [{"tag": f"urn:li:tag:{t}"} for t in row.tags]})
        if row.terms:
            self.aspect(row.address, "glossaryTerms", {"terms": [{"urn": t} for t in row.terms]})
        if row.properties:
            self.aspect(row.address, "schemaFieldProperties", {"customProperties": dict(row.properties)})


class OpenMetadata(Emitter):
    """Columns of a table: missing tags and terms are appended and properties merged, by a JSON patch of the table."""

    def emit(self, row: Row) -> None:
        name = row.address.removesuffix("." + row.key)
        table = self.ask("GET", "/v1/tables/name/" + urllib.parse.quote(name, safe=""), query={"fields": "columns,tags,extension"}, missing=True)
        if table is None:
            raise RemoteError(f"no table {name}")
        at = next((k for k, c in enumerate(table.get("columns") or []) if c.get("name") == row.key), None)
        if at is None:
            raise RemoteError(f"no column {row.key} in {name}")
        column = table["columns"][at]
        there = column.get("tags") or []
        names = {t.get("tagFQN") for t in there}
        new = [{"tagFQN": f, "source": source, "labelType": "Manual", "state": "Suggested"} for source, fs in (("Classification", [f"Tag.{t}" for t in row.tags or []]), ("Glossary", row.terms or [])) for f in fs if f not in names]
        patch = []
        if new:
            patch.append({"op": "add", "path": f"/columns/{at}/tags", "value": there + new})
        old = column.get("extension") or {}
        if row.properties and (merged := {**old, **row.properties}) != old:
            patch.append({"op": "add", "path": f"/columns/{at}/extension", "value": merged})
        if patch:
            self.ask("PATCH", f"/v1/tables/{table['id']}", patch, kind="application/json-patch+json")


@dataclass
class Atlas(Emitter):
    """Column entities by qualified name: classifications that are missing are added, attributes with our prefix merged, or replaced."""

    entity_type: str = "rdbms_column"

    def emit(self, row: Row) -> None:
        found = self.ask("GET", f"/api/atlas/v2/entity/uniqueAttribute/type/{self.entity_type}", query={"attr:qualifiedName": row.address}, missing=True)
        guid = ((found or {}).get("entity") or {}).get("guid")
        if not guid:
            raise RemoteError(f"no column {row.address}")
        if row.tags:
            listed = self.ask("GET", f"/api/atlas/v2/entity/guid/{guid}/classifications", missing=True) or {}
            there = {c.get("typeName") for c in listed.get("list", [])}
            for t in row.tags:
                if t not in there:
                    self.ask("POST", f"/api/atlas/v2/entity/guid/{guid}/classifications", {"classification": {"typeName": t, "attributes": {}}})
        if row.properties:
            entity = self.ask("GET", f"/api/atlas/v2/entity/guid/{guid}")["entity"]
            old = entity.get("attributes") or {}
            if self.replace:
                old = {k: v for k, v in old.items() if not k.startswith(PREFIX)}
            entity["attributes"] = {**old, **{PREFIX + k: v for k, v in row.properties.items()}}
            self.ask("PUT", f"/api/atlas/v2/entity/guid/{guid}", {"entity": entity})


TARGETS = {"datahub": (DataHub, "urn"), "openmetadata": (OpenMetadata, "fqn"), "atlas": (Atlas, "qualified")}


def send(rows: DataFrame, emitter: Emitter) -> dict[str, int]:
    """Emit every payload row from the tasks. Gives what was tried, fields, tags, terms and properties, and errors."""

    def each(part: Iterable[Row]) -> Iterable[tuple]:
        n = [0] * 5
        for r in part:
            n = [a + b for a, b in zip(n, (1, len(r.tags or []), len(r.terms or []), int(r.properties is not None), 0))]
            try:
                emitter.emit(r)
            except Exception as e:  # noqa: BLE001 - whatever a remote catalog raises
                print(f"{r.address}: {e}")
                n[4] += 1
        yield tuple(n)

    total = [sum(x) for x in zip(*rows.rdd.mapPartitions(each).collect())] or [0] * 5  # one row a task; calls have effects, so no plan may repeat them
    return dict(zip(("fields", "tags", "terms", "properties", "errors"), total))
