"""A writer for graph servers that speak Cypher over Bolt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Statements:
    """Upserts as statements; `run` takes a statement and its parameters."""

    def __init__(self, run: Callable[..., Any]):
        self.run = run

    def clear(self) -> None:
        """In portions, as one transaction could not hold a large graph."""
        self.run("MATCH (x) CALL { WITH x DETACH DELETE x } IN TRANSACTIONS OF 10000 ROWS")

    def unique(self, label: str) -> None:
        self.run(f"CREATE CONSTRAINT {quoted('name_of_' + label)} IF NOT EXISTS FOR (x:{quoted(label)}) REQUIRE x.name IS UNIQUE")

    def nodes(self, label: str, rows: list[dict]) -> None:
        given = [{"name": r["name"], "values": {k: v for k, v in r.items() if k != "name"}} for r in rows]
        self.run(f"UNWIND $given AS g MERGE (x:{quoted(label)} {{name: g.name}}) SET x += g.values", given=given)

    def relationships(self, src: str, kind: str, tgt: str, rows: list[dict]) -> None:
        ends = ("source_name", "target_name")
        given = [{"a": r[ends[0]], "b": r[ends[1]], "values": {k: v for k, v in r.items() if k not in ends}} for r in rows]
        self.run(f"UNWIND $given AS g MERGE (x:{quoted(src)} {{name: g.a}}) MERGE (y:{quoted(tgt)} {{name: g.b}}) MERGE (x)-[z:{quoted(kind)}]->(y) SET z += g.values", given=given)


@dataclass(frozen=True)
class Bolt:
    """A server; its driver (the neo4j package) is needed only when a session opens."""

    uri: str
    user: str
    password: str
    database: str

    @contextmanager
    def session(self) -> Iterator[Statements]:
        from neo4j import GraphDatabase

        with GraphDatabase.driver(self.uri, auth=(self.user, self.password)) as driver, driver.session(database=self.database) as session:
            yield Statements(lambda text, **given: session.run(text, **given).consume())
