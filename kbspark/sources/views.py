"""Views: states that are compared and set, and staged operations as tables.

A view's states are numbered files in a folder of its own, each created only if it isn't there, so of two writers that start
from one state one is told and derives its state anew.  A state names the tables of its operations (a folder a writer); tables
are written before the state that names them and never changed, so operations needn't pass the driver.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.merge import OPS, STATES
from kbspark.sources.folder import Folder

#: Operations of a table have numbers below this.
_TABLE = 1 << 40


class ViewMoved(RuntimeError):
    """Another writer was first, again and again."""


@dataclass(frozen=True)
class State:
    name: str
    base: str
    state: str = "CREATED"
    conflict: str = ""
    tables: tuple[str, ...] = ()
    touched: str = ""

    def moved(self, state: str, **more) -> State:
        if state not in STATES[self.state]:
            raise ValueError(f"{self.state} can't become {state}")
        return replace(self, state=state, **more)

    @property
    def open(self) -> bool:
        return bool(STATES[self.state])


class Views:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    @staticmethod
    def _place(name: str) -> str:
        return f"states/{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def _latest(self, place: str) -> tuple[int, State | None]:
        step = max(map(int, self.folder.names(place)), default=0)
        if not step:
            return 0, None
        held = json.loads(self.folder.read(f"{place}/{step:09}"))
        return step, State(**{**held, "tables": tuple(held["tables"])})

    def get(self, name: str) -> State | None:
        return self._latest(self._place(name))[1]

    def all(self) -> list[State]:
        """The latest state of each view, the last touched first."""
        found = [self._latest(f"states/{x}")[1] for x in self.folder.names("states")]
        return sorted((s for s in found if s), key=lambda s: s.touched, reverse=True)

    def change(self, name: str, to: Callable[[State | None], State], tries: int = 100) -> State:
        """Sets to(latest state) if the state is still the latest, else again from the newer one."""
        place = self._place(name)
        self.folder.make(place)
        for _ in range(tries):
            step, now = self._latest(place)
            new = replace(to(now), touched=datetime.datetime.now(datetime.UTC).isoformat())
            if self.folder.create(f"{place}/{step + 1:09}", json.dumps(asdict(new)).encode()):
                return new
        raise ViewMoved(name)

    def put(self, ops: DataFrame) -> str:
        """Writes operations (OPS) as a table of their own, in the order of seq; gives its name."""
        table = uuid.uuid4().hex
        ops.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in OPS.split(", "))).write.parquet(f"{self.path}/operations/{table}")
        return table

    def ops(self, state: State) -> DataFrame:
        """The view's operations in the order in which their tables were staged."""
        out = self.spark.createDataFrame([], OPS)
        for i, table in enumerate(state.tables):
            part = self.spark.read.schema(OPS).parquet(f"{self.path}/operations/{table}")
            out = out.unionByName(part.withColumn("seq", F.col("seq") + i * _TABLE))
        return out
