"""Requests under a session's grants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridlore.model import GridError, Query, Session


@dataclass(frozen=True)
class Ping:
    pass


@dataclass(frozen=True)
class Read:
    query: Query


@dataclass(frozen=True)
class Write:
    space: int
    rows: DataFrame


@dataclass(frozen=True)
class Delete:
    space: int
    points: DataFrame


@dataclass(frozen=True)
class CreateBranch:
    name: str
    parent: str = "main"


@dataclass(frozen=True)
class GetSnapshot:
    space: int


@dataclass(frozen=True)
class Response:
    """``kind``: pong, rows, written, branch, snapshot, unauthorised or internal."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class Handlers:
    read: Callable[[Query], DataFrame]
    write: Callable[[int, DataFrame], int]
    delete: Callable[[int, DataFrame], int]
    branch: Callable[[str, str], int]
    snapshot: Callable[[int], int | None]


def handlers_of(store) -> Handlers:
    """Serves a GridStore."""
    return Handlers(store.read, store.insert, store.delete, store.create_branch, store.current_snapshot)


def dispatch(request, session: Session, handlers: Handlers, *, strict: bool = False) -> Response:
    """Checks the grant, then hands over. Branch and snapshot requests need a grant only if ``strict``."""
    refused = Response("unauthorised")
    try:
        match request:
            case Ping():
                return Response("pong")
            case Read(query):
                return Response("rows", handlers.read(query)) if session.access(query.space) else refused
            case Write(space, rows):
                return Response("written", handlers.write(space, rows)) if session.can_write(space) else refused
            case Delete(space, points):
                return Response("written", handlers.delete(space, points)) if session.can_write(space) else refused
            case CreateBranch(name, parent):
                if strict and not any(session.can_write(g.space) for g in session.grants):
                    return refused
                return Response("branch", handlers.branch(name, parent))
            case GetSnapshot(space):
                return refused if strict and not session.access(space) else Response("snapshot", handlers.snapshot(space))
            case _:
                return Response("internal", f"unknown request {type(request).__name__}")
    except GridError as error:
        return Response("internal", str(error))
