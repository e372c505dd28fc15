"""Versioned training snapshots, manifests and the registry on shared storage.

A version is written under a folder of its own and never overwritten. It exists
for readers once its manifest row is committed, which is written last. It can be
adopted if it has metrics and a model that passes the release check, and if its
manifest names no rule that its rows fail. Each event
of a registry has a path of its own, so of two writers that want the same
sequence number one fails.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslab.functions.identity import fingerprint
from obslab.functions.versions import check_version_id, new_version_id
from obslab.operators import gates
from obslab.operators.models import FittedModel, Variant, score
from obslab.operators.prepare import CONFIRMED, REFERENCE, source_rows
from obslab.operators.release import require_release
from obslab.operators.versions import EVENT_SCHEMA, INITIAL, adopt, roll_back, version_state
from obslab.session import create_once, path_exists, remove_file
from obslab.spec import DatasetSpec


def _golden(stored: DataFrame) -> DataFrame:
    """What a model is checked on: the reference rows, or every row where no reference row was left."""
    reference = source_rows(stored, REFERENCE)
    return stored if reference.isEmpty() else reference


@dataclass(frozen=True)
class SnapshotStore:
    spark: SparkSession
    root: str
    registry: str = "default"

    def _path(self, kind: str, version: str) -> str:
        return f"{self.root}/{kind}/version_id={check_version_id(version)}"

    def save(
        self, data: DataFrame, spec: DatasetSpec, base_version: str = INITIAL, metrics: DataFrame | None = None,
        model: FittedModel | None = None, version: str | None = None,
    ) -> str:
        """Stage and publish in one step."""
        version = check_version_id(version or new_version_id())
        self.stage(data, version)
        return self.publish(version, spec, base_version, metrics, model)

    def stage(self, data: DataFrame, version: str) -> DataFrame:
        """Write the snapshot rows of a version that is not published yet and read them back."""
        data.write.mode("errorifexists").parquet(self._path("training_data", version))
        return self._rows(version)

    def _rows(self, version: str) -> DataFrame:
        return self.spark.read.parquet(self._path("training_data", version))

    def publish(
        self, version: str, spec: DatasetSpec, base_version: str = INITIAL, metrics: DataFrame | None = None,
        model: FittedModel | None = None, partial: bool = False,
    ) -> str:
        """Check the stored rows, write the other parts, and the manifest last.

        A version that fails the gate, or whose model fails the release check,
        never gets a manifest and stays invisible. A ``partial`` one may have no
        row of a label, or none at all: a warning and its manifest name the
        rules that it fails, and it can never be adopted.
        """
        check_version_id(base_version)
        stored = self._rows(version)
        lacking = gates.require(gates.snapshot_gate(stored, spec), gates.coverage_rules(spec) if partial else ())
        if lacking:
            warnings.warn(f"version {version!r} is partial: it fails {lacking}", stacklevel=2)
        if model is not None:
            require_release(model, _golden(stored))
        source_rows(stored, CONFIRMED).select("record_id").write.mode("errorifexists").parquet(
            self._path("confirmed_ids", version)
        )
        if metrics is not None:
            metrics.write.mode("errorifexists").parquet(self._path("metrics", version))
        if model is not None:
            model.save(self._path("model", version))
            known = {"spec": asdict(model.spec), "variant": asdict(model.variant), "ranges": dict(model.ranges)}
            document = self.spark.createDataFrame([(json.dumps(known, allow_nan=False),)], "document string")
            document.write.mode("errorifexists").parquet(self._path("model_document", version))
        manifest = fingerprint(source_rows(stored, REFERENCE), name="reference_fingerprint").select(
            F.lit(base_version).alias("base_version"), "reference_fingerprint", F.current_timestamp().alias("created_at"),
            F.lit(metrics is not None).alias("has_metrics"), F.lit(model is not None).alias("has_model"),
            F.array(*map(F.lit, lacking)).cast("array<string>").alias("lacking"),
        )
        manifest.write.mode("errorifexists").parquet(self._path("manifest", version))
        return version

    def load(self, version: str) -> DataFrame:
        """Snapshot rows of a published version."""
        self.manifest(version)
        return self._rows(version)

    def load_model(self, version: str | None = None) -> FittedModel:
        """The model of a published version, the active one by default, as it was fitted: spec, variant and ranges."""
        version = version or self.state()["active_version"]
        if not self.manifest(version)["has_model"]:
            raise ValueError(f"version {version!r} is incomplete: it has no model")
        known = json.loads(self.spark.read.parquet(self._path("model_document", version)).first()["document"])
        spec, variant = ({k: tuple(v) if isinstance(v, list) else v for k, v in known[part].items()} for part in ("spec", "variant"))
        spec["categories"] = {k: tuple(v) for k, v in spec["categories"].items()}
        ranges = {k: tuple(v) for k, v in known["ranges"].items()}
        return FittedModel.load(self._path("model", version), DatasetSpec(**spec), Variant(**variant), version=version, ranges=ranges)

    def score(self, df: DataFrame, version: str | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
        """``(scored, refused)`` by the model of a version, the active one by default, with its range warnings."""
        return score(df, self.load_model(version), strict)

    def metrics(self, version: str) -> DataFrame:
        if not self.manifest(version)["has_metrics"]:
            raise ValueError(f"version {version!r} is incomplete: it has no metrics")
        return self.spark.read.parquet(self._path("metrics", version))

    def confirmed_ids(self, version: str) -> DataFrame:
        """Ids confirmed in a version; the initial version has none. A table, because it grows with the log."""
        path = self._path("confirmed_ids", version)
        if version == INITIAL and not path_exists(self.spark, path):
            return self.spark.createDataFrame([], "record_id string")
        return self.spark.read.parquet(path)

    def manifest(self, version: str) -> dict:
        path = self._path("manifest", version)
        if not path_exists(self.spark, path):
            raise ValueError(f"version {version!r} is incomplete: it has no manifest")
        return self.spark.read.parquet(path).first().asDict()

    def state(self) -> dict:
        start = {"active_version": INITIAL, "previous_version": None, "seq": 0}
        if not path_exists(self.spark, f"{self._events}/*"):
            return start
        events = self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self._events}/*")
        latest = version_state(events).first()
        return latest.asDict() if latest else start

    def activate(self, version: str) -> dict:
        """Adopt a complete version whose base is still the active one; its stored parts are checked again."""
        manifest, state = self.manifest(version), self.state()
        step = adopt(state, version, manifest["base_version"])
        self._require_complete(version)
        return self._append(state, step)

    def _require_complete(self, version: str) -> None:
        self.metrics(version)
        # Manifests written before there were partial versions do not name what is lacking.
        lacking = self.manifest(version).get("lacking")
        if lacking:
            raise ValueError(f"version {version!r} is incomplete: it fails {lacking}")
        require_release(self.load_model(version), _golden(self.load(version)))

    @property
    def _events(self) -> str:
        return f"{self.root}/events/registry_id={check_version_id(self.registry)}"

    def roll_back(self) -> dict:
        state = self.state()
        step = roll_back(state)
        if step["active_version"] != INITIAL:
            self._require_complete(step["active_version"])
        return self._append(state, step)

    def _append(self, state: dict, step: dict) -> dict:
        """The event after the state that the step was decided on; fails if another writer was faster.

        A claim, created atomically, decides between writers. A writer that fails takes its claim back; the claim of one that
        was killed stays and is named by the error, until it is removed by hand.
        """
        seq = state["seq"] + 1
        claim = f"{self.root}/claims/registry_id={check_version_id(self.registry)}/event-{seq:012d}"
        if not create_once(self.spark, claim):
            raise ValueError(f"event {seq} of {self.registry!r} already exists: another writer has taken it ({claim})")
        try:
            row = (self.registry, seq, step["action"], step["active_version"], step["previous_version"])
            event = self.spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1)
            event.write.mode("errorifexists").parquet(f"{self._events}/event-{seq:012d}")
        except BaseException:
            remove_file(self.spark, claim)
            raise
        return self.state()
