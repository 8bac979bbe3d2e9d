"""Named queries of the engine's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import advanced, core, files, judging, panels, research, trading

_BOOKS = (core.BOOK, trading.BOOK, judging.BOOK, research.BOOK, panels.BOOK, files.BOOK, advanced.BOOK)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for b in _BOOKS for k, v in b.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for b in _BOOKS for k, v in b.sql.items()}
