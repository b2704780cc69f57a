"""Base classes for the stages.

Every fitted stage is a ``pyspark.ml`` Model whose state is plain JSON params
(saved with ``DefaultParamsWritable``) and whose transform is a *column map*:
``apply(cols, types) -> cols`` takes an ordered dict name -> Column and returns
the next one.  ``_transform`` is then a single ``select``; a chain of stages
can be folded into one ``select`` (see ``apply_stages``), and the same map can
run on the fields of a struct inside a higher-order function (streaming
requests are scored without exploding them).
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame

from keelson.functions.exprs import qcol


def param(name: str, doc: str = "") -> Param:
    return Param(Params._dummy(), name, doc or name)


class Configurable(Params):
    """Params with keyword construction and plain attribute-style access."""

    _defaults: dict = {}

    def __init__(self, **kwargs):
        super().__init__()
        if self._defaults:
            self._setDefault(**self._defaults)
        if kwargs:
            self._set(**kwargs)

    def v(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def setParams(self, **kwargs):
        self._set(**kwargs)
        return self


class ColumnMap:
    """Mixin: transform = one ``select`` built from ``apply``."""

    def apply(self, cols: "OrderedDict[str, Column]", types: dict | None = None) -> "OrderedDict[str, Column]":
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return select_map(dataset, self.apply(column_map(dataset), schema_types(dataset)))


def schema_types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def column_map(df: DataFrame) -> "OrderedDict[str, Column]":
    return OrderedDict((c, qcol(c)) for c in df.columns)


def select_map(df: DataFrame, cols: "OrderedDict[str, Column]") -> DataFrame:
    return df.select(*[e.alias(n) for n, e in cols.items()])


def apply_stages(stages, cols: "OrderedDict[str, Column]", types: dict | None = None):
    """Fold a list of ColumnMap stages over a column map."""
    for st in stages:
        cols = st.apply(cols, types)
    return cols


def apply_stages_sql(stages, df: DataFrame) -> "OrderedDict[str, str] | None":
    """The same fold as ``apply_stages`` but on SQL text; None if a stage has no
    SQL rendering (callers then use the Column path)."""
    from keelson.functions.sqltext import ident
    if not all(hasattr(st, "apply_sql") for st in stages):
        return None
    cols = OrderedDict((c, ident(c)) for c in df.columns)
    types = schema_types(df)
    for st in stages:
        cols = st.apply_sql(cols, types)
    return cols


def select_stages(df: DataFrame, stages) -> DataFrame:
    """Apply fitted stages as one projection.  Built as SQL text and parsed in
    one ``selectExpr`` call when every stage can render SQL (one py4j call
    instead of one per operator); otherwise through the Column API."""
    from keelson.functions.sqltext import ident
    sql = apply_stages_sql(stages, df)
    if sql is None:
        return select_map(df, apply_stages(stages, column_map(df), schema_types(df)))
    return df.selectExpr(*[f"{e} AS {ident(n)}" for n, e in sql.items()])


def sql_map(df: DataFrame) -> "OrderedDict[str, str]":
    from keelson.functions.sqltext import ident
    return OrderedDict((c, ident(c)) for c in df.columns)


def apply_stages_sql_map(stages, cols: "OrderedDict[str, str]", types: dict | None = None):
    for st in stages:
        cols = st.apply_sql(cols, types)
    return cols


def select_sql(df: DataFrame, cols: "OrderedDict[str, str]") -> DataFrame:
    from keelson.functions.sqltext import ident
    return df.selectExpr(*[f"{e} AS {ident(n)}" for n, e in cols.items()])


def present(names, cols) -> list[str]:
    return [c for c in (names or []) if c in cols]


# No __init__ of their own: pyspark's Transformer / Model / Estimator define
# none, so construction goes straight to Configurable.__init__(**kwargs).
class StageTransformer(ColumnMap, Transformer, Configurable, DefaultParamsReadable, DefaultParamsWritable):
    pass


class StageModel(ColumnMap, Model, Configurable, DefaultParamsReadable, DefaultParamsWritable):
    pass


class StageEstimator(Estimator, Configurable, DefaultParamsReadable, DefaultParamsWritable):
    pass
