import pytest

from keelson.spec import DatasetSpec

BASE = {"modelCategory": "regression", "schemaVersion": 1.0, "id": {"name": "id"},
        "target": {"name": "t", "description": "d", "example": 1.5},
        "features": [{"name": "n", "dataType": "NUMERIC", "example": 1, "nullable": True},
                     {"name": "c", "dataType": "CATEGORICAL", "categories": ["A", "B"], "nullable": False}]}


def test_roles_and_order():
    s = DatasetSpec.from_dict(BASE)
    assert s.numeric_features == ["n"] and s.categorical_features == ["c"] and s.feature_names == ["n", "c"]
    assert s.nullable_features == ["n"] and s.non_nullable_features == ["c"] and s.target_description == "d"
    assert [f.name for f in s.struct(is_train=True).fields] == ["id", "n", "c", "t"]
    assert [f.name for f in s.struct(is_train=False).fields] == ["id", "n", "c"]


@pytest.mark.parametrize("change", [
    {"modelCategory": "classification"}, {"schemaVersion": 2.0}, {"features": []},
    {"features": [{"name": "n", "dataType": "NUMERIC", "example": 1}, {"name": "n", "dataType": "NUMERIC", "example": 1}]},
    {"features": [{"name": "n", "dataType": "NUMERIC"}]},
    {"features": [{"name": "c", "dataType": "CATEGORICAL"}]},
    {"target": {"name": "t", "example": "x"}},
])
def test_rules(change):
    with pytest.raises(ValueError):
        DatasetSpec.from_dict({**BASE, **change})
