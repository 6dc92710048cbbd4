"""Knowledge models kept as Parquet tables, each version in a folder of its own."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vectors import is_missing
from weftgraph.models import embed_missing
from weftgraph.operators.vectors import ListIndex
from weftgraph.schema import SCHEMAS, base_name, conform, empty, table_names
from weftgraph.sources import files

TARGETS = {"entities": "description_embedding", "chunks": "embedding", "reports": "embedding"}
SECRETS = ("token", "password")


@dataclass
class Handle:
    """Where a knowledge model is and how it is searched."""

    path: str
    name: str = "model"
    status: str = "empty"
    metric: str = "cosine"
    use_vector_index: bool = True
    lists: int | None = None
    exact_fallback: bool = True
    vector_state: str = "none"
    token: str = ""
    password: str = ""
    message: str = ""
    extra: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> Handle:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    def public_summary(self) -> dict[str, Any]:
        return {k: v for k, v in self.to_dict().items() if k not in SECRETS}

    @property
    def root(self) -> str:
        return f"{self.path.rstrip('/')}/{base_name(self.name)}"


def entity_text() -> F.Column:
    return F.concat(F.col("title"), F.lit(": "), F.col("description"))


def report_text() -> F.Column:
    return F.concat_ws("\n", "title", "summary", "full_content")


TEXTS = {"entities": entity_text, "chunks": lambda: F.col("text"), "reports": report_text}


class Store:
    """Reads and writes the tables of one handle. A manifest names the version that counts; writing ends by replacing it."""

    def __init__(self, spark: SparkSession, handle: Handle) -> None:
        self.spark, self.handle = spark, handle

    @property
    def _manifest(self) -> str:
        return f"{self.handle.root}/manifest.json"

    def manifest(self) -> dict[str, Any]:
        if not files.exists(self.spark, self._manifest):
            raise FileNotFoundError(f"there is no knowledge model at {self.handle.root}")
        return json.loads(files.read_text(self.spark, self._manifest))

    def ensure(self, create: bool = True) -> None:
        """Tables for the handle; without `create`, missing ones are an error."""
        if not files.exists(self.spark, self._manifest):
            if not create:
                raise FileNotFoundError(f"there is no knowledge model at {self.handle.root}")
            self.write({}, status="empty")

    def write(self, model: dict[str, DataFrame], status: str = "ready", **more: Any) -> None:
        """All tables as a new version; what it was computed from may be the version before."""
        version = uuid.uuid4().hex
        for table in SCHEMAS:
            rows = conform(model[table], table) if table in model else empty(self.spark, table)
            rows.write.parquet(f"{self.handle.root}/{version}/{table_names(self.handle.name)[table]}")
        before = json.loads(files.read_text(self.spark, self._manifest)) if files.exists(self.spark, self._manifest) else {}
        files.write_text(self.spark, self._manifest, json.dumps({**before, "version": version, "status": status, "metric": self.handle.metric, **more}))
        self.handle.status = status
        if before.get("version"):
            files.delete(self.spark, f"{self.handle.root}/{before['version']}")

    def note(self, **more: Any) -> None:
        """Add to the manifest."""
        files.write_text(self.spark, self._manifest, json.dumps({**self.manifest(), **more}))

    def load(self) -> dict[str, DataFrame]:
        """All tables, lazily."""
        version = self.manifest()["version"]
        names = table_names(self.handle.name)
        return {t: conform(self.spark.read.schema(SCHEMAS[t]).parquet(f"{self.handle.root}/{version}/{names[t]}"), t) for t in SCHEMAS}

    def persist(self, model: dict[str, DataFrame], embedder: Any = None) -> str:
        """Embed what lacks a vector, write all, and build the vector indexes; returns how the latter ended."""
        full = {t: conform(model[t], t) if t in model else empty(self.spark, t) for t in SCHEMAS}
        if embedder is not None:
            for table, vector in TARGETS.items():
                full[table] = embed_missing(full[table], embedder, TEXTS[table](), vector)
        self.write(full)
        state = "none"
        if self.handle.use_vector_index:
            try:
                loaded, version = self.load(), self.manifest()["version"]
                for table, vector in TARGETS.items():
                    if not loaded[table].filter(~is_missing(F.col(vector))).isEmpty():
                        ListIndex.build(loaded[table], f"{self.handle.root}/{version}/index_{table}", vector=vector, metric=self.handle.metric, lists=self.handle.lists)
                        state = "ready"
            except ValueError:
                if not self.handle.exact_fallback:
                    raise
                state = "failed"
        self.handle.vector_state = state
        return state

    def index(self, table: str) -> ListIndex | None:
        path = f"{self.handle.root}/{self.manifest()['version']}/index_{table}"
        return ListIndex(self.spark, path) if self.handle.use_vector_index and files.exists(self.spark, f"{path}/meta.json") else None

    def clear(self) -> None:
        """Empty tables; the handle's status is empty again."""
        self.write({}, status="empty")
        self.handle.vector_state = "none"
