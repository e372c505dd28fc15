"""Column roles of a labelled observation table.

A spec is small driver-side configuration: it names the columns and lists the
allowed labels and categories. Everything whose size follows the data stays in
DataFrames; everything sized by the spec (labels, features) may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class DatasetSpec:
    label: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    fill: str = "unknown"
    confirmed: str = "validated_label"

    def __post_init__(self):
        names = [self.label, *self.numeric, *self.categorical, *self.context]
        if len(set(names)) != len(names):
            raise ValueError(f"a column may play only one role: {sorted(names)}")
        unknown = set(self.categories) - set(self.categorical)
        if unknown:
            raise ValueError(f"allowed values given for non-categorical columns: {sorted(unknown)}")

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    @property
    def role_columns(self) -> tuple[str, ...]:
        return (self.label, *self.features, *self.context)

    @property
    def class_order(self) -> tuple[str, ...]:
        """Classes in ascending order: the order of probabilities and matrix axes."""
        return tuple(sorted(self.labels))

    def with_features(self, numeric=None, categorical=None) -> "DatasetSpec":
        """The same table seen through another feature list (used by the ablation study)."""
        categorical = self.categorical if categorical is None else tuple(categorical)
        numeric = self.numeric if numeric is None else tuple(numeric)
        used = {*numeric, *categorical}
        return replace(
            self,
            numeric=numeric,
            categorical=categorical,
            context=tuple(c for c in self.context if c not in used),
            categories={k: v for k, v in self.categories.items() if k in categorical},
        )


# Roles, labels and categories of the body-measurement table.
BODY_MEASURES = DatasetSpec(
    label="species",
    numeric=("bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g"),
    categorical=("sex",),
    context=("island",),
    labels=("Adelie", "Chinstrap", "Gentoo"),
    categories={"sex": ("female", "male", "unknown")},
    confirmed="validated_species",
)
