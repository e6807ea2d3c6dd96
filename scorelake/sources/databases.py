"""SQLite databases: catalogue, rows and execution, inside tasks."""

from __future__ import annotations

import os
import sqlite3
import threading

from scorelake.operators.lru import LRUCache


def catalogue(connection: sqlite3.Connection) -> dict[str, list[str]]:
    """table -> columns of a database, in lower case."""
    names = [r[0] for r in connection.execute("select name from sqlite_master where type = 'table'")]
    return {n.lower(): [r[1].lower() for r in connection.execute(f'pragma table_info("{n}")')] for n in names}


class Databases(LRUCache):
    """Open databases of a worker by name. ``sources`` maps a name to a file or to a script that builds it in memory."""

    def __init__(self, sources: dict[str, str], cache_size: int = 8):
        super().__init__(cache_size)
        self.sources = sources

    def create(self, key: str) -> sqlite3.Connection:
        source = self.sources[key]
        if "\n" in source or ";" in source:
            connection = sqlite3.connect(":memory:", check_same_thread=False)
            connection.executescript(source)
            return connection
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        return sqlite3.connect(f"file:{source}?mode=ro", uri=True, check_same_thread=False)

    def cleanup(self, key: str, obj: sqlite3.Connection) -> None:
        obj.close()


def run_query(connection: sqlite3.Connection, sql: str, timeout: float | None = None) -> list[tuple]:
    """All rows of a query; longer than ``timeout`` seconds raises sqlite3.OperationalError (interrupted)."""
    timer = threading.Timer(timeout, connection.interrupt) if timeout else None
    if timer:
        timer.start()
    try:
        cursor = connection.execute(sql)
        return cursor.fetchall()
    finally:
        if timer:
            timer.cancel()
