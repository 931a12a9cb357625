"""Project catalog: registry, versioned dataset snapshots with undo, model metrics,
parameter sets, published models, cascade delete and the image layer stack (operators
O-10..O-17, O-110).

Every table is Parquet under one root on a shared file system, in versions that are
committed atomically (``tessera.sources.commits``). Metadata changes are functions of the
current rows, asked again when another writer commits first, so two writers lose nothing
and ids stay unique.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.commits import Files, VersionedTable

REGISTRY_SCHEMA = "project_id int, name string, type string, status string"
METRICS_SCHEMA = ("project_id int, algorithm string, train_accuracy double, "
                  "test_accuracy double, overall_accuracy double, target string")
PUBLISHED_SCHEMA = "project_id int, algorithm string, model_id string, path string"
LAYER_SCHEMA = "project_id int, index_no int, layer string, params string"
PARAMS_SCHEMA = "project_id int, algorithm string, name string, value string"
DELETED_SCHEMA = "project_id int, done boolean"
# Project types offered by the application.
PROJECT_TYPES = ["Data Processing", "Image Processing", "Cash Forecasting"]


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    # ------------------------------------------------------------ versioned tables

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, os.path.join(self.root, name))

    def save(self, name: str, df: DataFrame) -> int:
        """O-11: write a new version and make it current; the old current becomes the
        one-step-back version. Returns the number of the commit."""
        return self.table(name).save(df).number

    def load(self, name: str, schema: str | None = None) -> DataFrame:
        t = self.table(name)
        now = t.version()
        if now is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return t.read(now.current)

    def undo(self, name: str) -> int | None:
        """O-12: current := one-step-back; one level only (a repeat changes nothing)."""
        now = self.table(name).undo()
        return None if now is None else now.number

    def original(self, name: str) -> DataFrame:
        """O-13: the first version, as ingested."""
        t = self.table(name)
        now = t.version()
        if now is None:
            raise KeyError(name)
        return t.read(now.original)

    def _update(self, name: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.table(name).update(
            lambda t: change(self.spark.createDataFrame([], schema) if t is None else t))

    def _append_numbered(self, name: str, schema: str, column: str, row: Callable[[int], tuple], scope=None) -> int:
        """Add the row with the next number of ``column`` (within the rows of ``scope``); the number is
        the one that was committed."""
        given = []

        def change(t: DataFrame) -> DataFrame:
            rows = t if scope is None else t.filter(scope)
            given.append(int(rows.agg(F.coalesce(F.max(column), F.lit(0)) + 1).first()[0]))
            return t.unionByName(self.spark.createDataFrame([row(given[-1])], schema))
        self._update(name, schema, change)
        return given[-1]

    def _replace(self, name: str, schema: str, match, rows: list[tuple]) -> None:
        self._update(name, schema, lambda t: t.filter(~match).unionByName(self.spark.createDataFrame(rows, schema)))

    # ------------------------------------------------------------ registry (O-10)

    def create_project(self, name: str, ptype: str) -> int:
        if ptype not in PROJECT_TYPES:
            raise ValueError(f"unknown project type {ptype}")
        return self._append_numbered("registry", REGISTRY_SCHEMA, "project_id", lambda n: (n, name, ptype, "active"))

    def dataset(self, project_id: int) -> str:
        """Name of a project's own dataset, for ``save``, ``load``, ``undo`` and ``original``."""
        return os.path.join("datasets", f"project-{int(project_id)}")

    def model_path(self, project_id: int, model_id: str) -> str:
        """Where a project's models are saved."""
        return os.path.join(self.root, "models", f"project-{int(project_id)}", model_id)

    def active_projects(self) -> DataFrame:
        return self.load("registry", REGISTRY_SCHEMA).filter(F.col("status") == "active")

    # ------------------------------------------------------------ models (O-14, O-15, O-21)

    def upsert_metrics(self, project_id: int, algorithm: str, train: float, test: float,
                       overall: float, target: str) -> None:
        """O-14: delete the (project, algorithm) row, insert the new one."""
        self._replace("metrics", METRICS_SCHEMA,
                      (F.col("project_id") == project_id) & (F.col("algorithm") == algorithm),
                      [(int(project_id), algorithm, float(train), float(test), float(overall), target)])

    def publish(self, project_id: int, algorithm: str, model_id: str, path: str) -> None:
        self._replace("published", PUBLISHED_SCHEMA,
                      (F.col("project_id") == project_id) & (F.col("algorithm") == algorithm),
                      [(int(project_id), algorithm, model_id, path)])

    def model_list(self, project_id: int) -> DataFrame:
        """O-15: metrics (2 dp) with the published id, best test accuracy first."""
        m = self.load("metrics", METRICS_SCHEMA).filter(F.col("project_id") == project_id)
        p = self.load("published", PUBLISHED_SCHEMA).select("project_id", "algorithm", "model_id")
        return (m.join(p, ["project_id", "algorithm"], "left")
                .select("algorithm", *[F.round(c, 2).alias(c) for c in
                                       ("train_accuracy", "test_accuracy", "overall_accuracy")],
                        "target", "model_id")
                .orderBy(F.desc("test_accuracy"), "algorithm"))

    # ------------------------------------------------------------ parameter sets (O-110)

    def save_parameters(self, project_id: int, algorithm: str, params: dict) -> None:
        """Replace the project's parameters of an algorithm (values as JSON text)."""
        self._replace("parameters", PARAMS_SCHEMA,
                      (F.col("project_id") == project_id) & (F.col("algorithm") == algorithm),
                      [(int(project_id), algorithm, k, json.dumps(v)) for k, v in sorted(params.items())])

    def edit_parameters(self, project_id: int, algorithm: str, **changes) -> dict:
        """Change some of the saved parameters; the others stay. Returns the whole set."""
        rows = (F.col("project_id") == project_id) & (F.col("algorithm") == algorithm)
        self._replace("parameters", PARAMS_SCHEMA, rows & F.col("name").isin(list(changes)),
                      [(int(project_id), algorithm, k, json.dumps(v)) for k, v in sorted(changes.items())])
        return self.parameters(project_id, algorithm)

    def parameters(self, project_id: int, algorithm: str) -> dict:
        """The saved parameters, ready to be passed to training; empty without any."""
        t = self.load("parameters", PARAMS_SCHEMA)
        rows = t.filter((F.col("project_id") == project_id) & (F.col("algorithm") == algorithm)).collect()
        return {r.name: json.loads(r.value) for r in rows}

    # ------------------------------------------------------------ delete (O-16)

    def delete_project(self, project_id: int) -> None:
        """Remove all of a project (exact id): its rows in every table, its parameters, its saved models
        and its dataset with all versions; the registry keeps it as inactive.

        A tombstone is committed first, and every step can be repeated, so a delete that
        broke off is finished by ``resume_deletes`` or by calling this again. Older versions
        of the tables go too, as they hold the rows."""
        project_id = int(project_id)
        mine = F.col("project_id") == project_id
        self._replace("deleted", DELETED_SCHEMA, mine, [(project_id, False)])
        self._update("registry", REGISTRY_SCHEMA, lambda t: t.withColumn(
            "status", F.when(mine, "inactive").otherwise(F.col("status"))))
        files = Files(self.spark)
        for r in self.load("published", PUBLISHED_SCHEMA).filter(mine).collect():
            files.delete(r.path)
        files.delete(os.path.join(self.root, "models", f"project-{project_id}"))
        self.table(self.dataset(project_id)).drop()
        for name, schema in (("metrics", METRICS_SCHEMA), ("published", PUBLISHED_SCHEMA),
                             ("layers", LAYER_SCHEMA), ("parameters", PARAMS_SCHEMA)):
            if not self.load(name, schema).filter(mine).isEmpty():
                self._update(name, schema, lambda t: t.filter(~mine))
            self.table(name).forget()
        self._replace("deleted", DELETED_SCHEMA, mine, [(project_id, True)])

    def resume_deletes(self) -> list[int]:
        """Finish deletes that broke off; the ids of these projects."""
        left = [r.project_id for r in self.load("deleted", DELETED_SCHEMA).filter(~F.col("done")).collect()]
        for i in left:
            self.delete_project(i)
        return sorted(left)

    # ------------------------------------------------------------ layers (O-17)

    def add_layer(self, project_id: int, layer: str, params: str) -> int:
        return self._append_numbered("layers", LAYER_SCHEMA, "index_no",
                                     lambda n: (int(project_id), n, layer, params), F.col("project_id") == project_id)

    def layers(self, project_id: int) -> DataFrame:
        return self.load("layers", LAYER_SCHEMA).filter(
            F.col("project_id") == project_id).orderBy(F.col("index_no").cast("int"))

    def delete_layer(self, project_id: int, index_no: int) -> None:
        """The first convolution layer is protected."""
        if index_no == 1:
            raise ValueError("the first convolution layer cannot be deleted")
        self._update("layers", LAYER_SCHEMA, lambda t: t.filter(
            ~((F.col("project_id") == project_id) & (F.col("index_no") == index_no))))
