"""File sources and sinks: CSV (and parquet / JSON) tables.

``src_csv`` reads a directory with the dataset spec as schema.  The reference
insists on exactly one ``.csv`` file in the directory; Spark tables are
normally split into many part files, so that strictness is an opt-in flag.
``sink_csv`` writes doubles with 4 decimals, rounded exactly as the
reference's ``'%.4f'`` (C rounding of the binary value, not Java's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import WHOLE_PATTERN, format_fixed, qcol, text_number, to_double, to_whole
from keelson.functions.profile import chunked_aggregate
from keelson.spec import DatasetSpec


# The texts that the usual table library reads as missing.
NULL_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "n/a", "nan", "null")


def _fs_list(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a directory through the Hadoop FileSystem (works for any
    scheme the cluster knows); None when the directory does not exist."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    return [st.getPath().getName() for st in fs.listStatus(hpath)]


def src_csv(spark: SparkSession, path: str, spec: DatasetSpec | None = None, is_train: bool = True,
            numeric_as_string: bool = False, single_file: bool = False, fmt: str = "csv",
            null_values: tuple[str, ...] = NULL_VALUES) -> DataFrame:
    """Scan a table directory.

    Missing directory -> FileNotFoundError.  ``single_file=True`` reproduces
    the reference's rule: zero or several ``.csv`` files -> ValueError.
    Files are matched by header names, so their column orders may differ; a
    column that a file lacks is NULL there.  Empty fields and ``null_values``
    (by default the usual spellings of a missing value) are NULL in every column.
    Without a spec the types follow from all values (``type_bit``), in one more scan.
    """
    names = _fs_list(spark, path)
    if names is None:
        raise FileNotFoundError(f"Directory does not exist: {path}")
    if fmt == "csv":
        csvs = [n for n in names if n.endswith(".csv")]
        if single_file and not csvs:
            raise ValueError(f"No CSV file found in directory {path}")
        if single_file and len(csvs) > 1:
            raise ValueError(f"Multiple CSV files found in directory {path}.")
        files = [f"{path.rstrip('/')}/{n}" for n in sorted(csvs if csvs else names) if not n.startswith(("_", "."))]
        if spec is None:
            return _inferred(_text_by_header(spark, files), null_values)
        return _read_by_header(spark, files, spec, is_train, numeric_as_string, null_values)
    reader = spark.read
    if spec is not None and fmt == "json":
        reader = reader.schema(spec.struct(is_train, numeric_as_string))
    return reader.format(fmt).load(path)


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Header line of each file -> the files that have it (one small job over the first lines)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    groups: dict[str, list[str]] = {}
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(name)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(path.getFileSystem(conf).open(path), "UTF-8"))
        groups.setdefault(lines.readLine() or "", []).append(name)
        lines.close()
    return groups


def _text_by_header(spark: SparkSession, files: list[str]) -> DataFrame | None:
    """One scan for each header, every field as text, united by name; None without any header."""
    reader = lambda: spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    table = None
    for header, own in _headers(spark, files).items():
        if not header:
            continue
        names = spark.read.option("header", True).csv(own[0]).columns
        part = reader().schema(T.StructType([T.StructField(n, T.StringType(), True) for n in names])).csv(own)
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    return table


# what a column has held so far, as bits: their union over rows, tasks and files is the column's state
WHOLE, REAL, BOOLEAN, TEXT = 1, 2, 4, 8


def type_bit(text: Column) -> Column:
    """The least type that holds a text: nothing, a 64-bit whole number, a real number, true / false, any text."""
    whole = text.rlike(WHOLE_PATTERN) & F.trim(text).try_cast("bigint").isNotNull()
    return F.when(text.isNull(), 0).when(whole, WHOLE).when(text_number(text).isNotNull(), REAL) \
        .when(F.lower(F.trim(text)).isin("true", "false"), BOOLEAN).otherwise(TEXT)


def joined_type(bits: int) -> T.DataType:
    """The least type that holds everything a column has held (an empty column counts as real numbers)."""
    if bits & TEXT or (bits & BOOLEAN and bits & (WHOLE | REAL)):
        return T.StringType()
    if bits & BOOLEAN:
        return T.BooleanType()
    return T.LongType() if bits == WHOLE else T.DoubleType()


def _without_missing(name: str, null_values: tuple[str, ...]) -> Column:
    return F.when(~qcol(name).isin(*null_values), qcol(name)) if null_values else qcol(name)


def _as_type(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    return to_whole(text, T.StringType()) if isinstance(kind, T.LongType) else \
        to_double(text, T.StringType()) if isinstance(kind, T.DoubleType) else F.trim(text).cast(kind)


def _inferred(table: DataFrame | None, null_values: tuple[str, ...]) -> DataFrame:
    if table is None:
        raise ValueError("no CSV file with a header, and no description of its columns")
    texts = {name: _without_missing(name, null_values) for name in table.columns}
    bits = chunked_aggregate(table, [(f"t{i}", F.bit_or(type_bit(t)), 1) for i, t in enumerate(texts.values())])
    return table.select(*[_as_type(t, joined_type(bits[f"t{i}"] or 0)).alias(name)
                          for i, (name, t) in enumerate(texts.items())])


def _read_by_header(spark, files: list[str], spec: DatasetSpec, is_train: bool, numeric_as_string: bool,
                    null_values: tuple[str, ...]) -> DataFrame:
    """All files by header names, cast to the spec's types."""
    table = _text_by_header(spark, files)
    known = {f.name: f.dataType for f in spec.struct(is_train, numeric_as_string).fields}
    if not is_train:
        known.setdefault(spec.target, T.DoubleType())
    if table is None:
        return spark.createDataFrame([], spec.struct(is_train, numeric_as_string))
    return table.select(*[_as_type(_without_missing(n, null_values), known.get(n, T.StringType())).alias(n)
                          for n in table.columns])


def format_decimals(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Doubles as text with a fixed number of decimals, rounded as C / Python
    ``'%.4f'`` round (exact binary value, ties to even); NULL and NaN stay empty.

    The scaled value and its exact rounding error are computed in a lower
    projection (referenced several times, so Catalyst keeps it separate): the
    generated code per column stays small, also for many double columns."""
    scale = float(10 ** decimals)
    fields = df.schema.fields
    dbl = [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not dbl:
        return df
    pre = []
    for i, name in enumerate(dbl):
        x = qcol(name).cast("double")
        a = F.abs(x)
        split = F.lit(134217729.0) * a
        ah = split - (split - a)
        pre += [(a * F.lit(scale)).alias(f"__p{i}"), ah.alias(f"__ah{i}"), (a - ah).alias(f"__al{i}")]
    staged = df.select("*", *pre)
    out = []
    for f in fields:
        if f.name in dbl:
            i = dbl.index(f.name)
            c = qcol(f.name)
            text = format_fixed(c, decimals, parts=(F.col(f"__p{i}"), F.col(f"__ah{i}"), F.col(f"__al{i}")))
            out.append(F.when(c.isNotNull() & ~F.isnan(c), text).alias(f.name))
        else:
            out.append(qcol(f.name))
    return staged.select(*out)


def sink_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """Write with a header, no index, doubles with ``decimals`` decimals;
    overwrite mode replaces what was in the directory."""
    format_decimals(df, decimals).write.mode("overwrite").option("header", True).csv(path)
