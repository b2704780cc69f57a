"""Dataset description: roles and types of the columns of one table.

Support code for the operators, not an operator itself: a small driver-side
object that yields the ``StructType`` used to read sources and the column
lists every stage is configured with.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

NUMERIC = "NUMERIC"
CATEGORICAL = "CATEGORICAL"


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    nullable: bool = False
    categories: tuple = ()
    example: object = None
    description: str = ""


@dataclass(frozen=True)
class DatasetSpec:
    id: str
    target: str
    features: tuple = field(default_factory=tuple)
    target_description: str = ""
    title: str = ""
    id_type: T.DataType = field(default_factory=T.StringType)

    # -- construction -------------------------------------------------------
    @staticmethod
    def from_dict(d: dict, id_type: T.DataType | None = None) -> "DatasetSpec":
        if d.get("modelCategory", "regression") != "regression":
            raise ValueError("modelCategory must be 'regression'")
        if float(d.get("schemaVersion", 1.0)) != 1.0:
            raise ValueError("schemaVersion must be 1.0")
        feats = d.get("features") or []
        if not feats:
            raise ValueError("at least one feature is required")
        t_example = d.get("target", {}).get("example")
        if "example" in d.get("target", {}) and not isinstance(t_example, (int, float)):
            raise ValueError("target example must be a number")
        names = [f["name"] for f in feats]
        if len(set(names)) != len(names):
            raise ValueError("feature names must be unique")
        out = []
        for f in feats:
            kind = f["dataType"].upper()
            if kind not in (NUMERIC, CATEGORICAL):
                raise ValueError(f"unknown dataType {f['dataType']}")
            if kind == NUMERIC and "example" not in f:
                raise ValueError(f"numeric feature {f['name']} needs an example")
            if kind == CATEGORICAL and not f.get("categories"):
                raise ValueError(f"categorical feature {f['name']} needs categories")
            out.append(Feature(f["name"], kind, bool(f.get("nullable", False)),
                               tuple(f.get("categories") or ()), f.get("example"),
                               f.get("description", "")))
        return DatasetSpec(d["id"]["name"], d["target"]["name"], tuple(out),
                           d["target"].get("description", ""), d.get("title", ""),
                           id_type or T.StringType())

    @staticmethod
    def from_json(path: str, id_type: T.DataType | None = None) -> "DatasetSpec":
        with open(path) as fh:
            return DatasetSpec.from_dict(json.load(fh), id_type)

    # -- column lists (numerics first, then categoricals) --------------------
    @property
    def numeric_features(self) -> list[str]:
        return [f.name for f in self.features if f.kind == NUMERIC]

    @property
    def categorical_features(self) -> list[str]:
        return [f.name for f in self.features if f.kind == CATEGORICAL]

    @property
    def feature_names(self) -> list[str]:
        return self.numeric_features + self.categorical_features

    @property
    def nullable_features(self) -> list[str]:
        return [f.name for f in self.features if f.nullable]

    @property
    def non_nullable_features(self) -> list[str]:
        return [f.name for f in self.features if not f.nullable]

    def categories(self, name: str) -> list[str]:
        for f in self.features:
            if f.name == name:
                return [str(c) for c in f.categories]
        raise KeyError(name)

    def is_nullable(self, name: str) -> bool:
        return any(f.name == name and f.nullable for f in self.features)

    # -- Spark schemas ---------------------------------------------------------
    def struct(self, is_train: bool = True, numeric_as_string: bool = False) -> T.StructType:
        """Schema to read a source with: id, features and (when training) target.

        ``numeric_as_string`` reads numerics as text so that ``val_numeric`` can
        report values that are not numbers instead of failing the scan.
        """
        fields = [T.StructField(self.id, self.id_type, False, {"role": "id"})]
        for f in self.features:
            typ = T.DoubleType() if f.kind == NUMERIC and not numeric_as_string else T.StringType()
            meta = {"role": "feature", "kind": f.kind}
            if f.categories:
                meta["categories"] = [str(c) for c in f.categories]
            fields.append(T.StructField(f.name, typ, True, meta))
        if is_train:
            fields.append(T.StructField(self.target, T.DoubleType(), True, {"role": "target"}))
        return T.StructType(fields)

    def request_struct(self) -> T.StructType:
        """Schema of one scoring request: ``{"instances": [{...}, ...]}``."""
        inst = [T.StructField(self.id, T.StringType(), True)]
        for f in self.features:
            inst.append(T.StructField(f.name, T.DoubleType() if f.kind == NUMERIC else T.StringType(), True))
        return T.StructType([T.StructField("instances", T.ArrayType(T.StructType(inst)), True)])
