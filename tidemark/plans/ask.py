"""Read-only, parameterised SQL over the stored tables, cached for a while."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession

from tidemark.plans.build import Builder

READS = re.compile(r"\s*(select|with)\b", re.IGNORECASE)


class Desk:
    """Answers questions to the core and kpi tables, which are views core_<model> and kpi_<model> of a session of its own."""

    def __init__(self, builder: Builder, seconds: float = 300, most: int = 1_000_000, clock: Callable[[], float] = time.monotonic):
        """seconds: how long an answer is kept. most: rows from which an answer is refused, as it goes to the driver."""
        self.builder, self.seconds, self.most, self.clock = builder, seconds, most, clock
        self.kept: dict[tuple, tuple[float, pd.DataFrame]] = {}

    def _session(self) -> SparkSession:
        session = self.builder.spark.newSession()
        for name, paths in self.builder.paths().items():
            schema, model = name.split(".")
            if schema in ("core", "kpi"):
                session.read.parquet(*paths).createOrReplaceTempView(f"{schema}_{model}")
        return session

    def ask(self, sql: str, **parameters) -> pd.DataFrame:
        """The rows of one select; parameters are bound by name (:name), lists as arrays."""
        if not READS.match(sql) or ";" in sql.rstrip().rstrip(";"):
            raise ValueError("only a single select is answered")
        key = (sql, repr(sorted(parameters.items())))
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < self.seconds:
            return self.kept[key][1]
        found = self._session().sql(sql, args=parameters).limit(self.most + 1).toPandas()
        if len(found) > self.most:
            raise ValueError(f"more than {self.most} rows: aggregate first")
        self.kept = {k: v for k, v in self.kept.items() if now - v[0] < self.seconds} | {key: (now, found)}
        return found
