"""Values of view columns: kinds, dynamic cells, the two equalities and the order.

Typed columns are ordinary Spark columns. A dynamic column holds cells, each with its own storage class:

    struct<c tinyint, i bigint, r double, t string, b binary>   c: 0 NULL, 1 integer, 2 real, 3 text, 4 blob

Two cells are the same row value only if class and value agree (1, 1.0 and '1' differ, 0.0 and -0.0 too: i is 1 for -0.0,
which Spark would otherwise group with 0.0). As group and join keys numbers are canonical: a real that is an integer of 64
bits is that integer. In order NULL comes before numbers (by exact value), text and blobs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, INT, REAL, TEXT, BLOB = range(5)
CELL = T.StructType([T.StructField("c", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType())])
_SPACE = r"[ \t\n\x0B\f\r]*"
_INTEGER = f"^{_SPACE}([+-]?[0-9]+){_SPACE}$"
_NUMBER = rf"^{_SPACE}([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_LOW, _HIGH = -(2.0**63), 2.0**63


def kind_of(data_type: T.DataType) -> str:
    """int, real, decimal, text, blob, bool, time, dyn (a cell) or other (carried along only)."""
    if data_type.simpleString() == CELL.simpleString():
        return "dyn"
    for types, kind in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "real"), (T.DecimalType, "decimal"), (T.StringType, "text"), (T.BinaryType, "blob"), (T.BooleanType, "bool"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time")):
        if isinstance(data_type, types):
            return kind
    return "other"


def nullable(data_type: T.DataType) -> T.DataType:
    """The type with everything inside it nullable, as stored data is read back."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(nullable(data_type.elementType), True)
    if isinstance(data_type, T.MapType):
        return T.MapType(nullable(data_type.keyType), nullable(data_type.valueType), True)
    return data_type


def affinity_of(field: T.StructField) -> str:
    """The affinity a column compares by; a dynamic column names its own in metadata, BLOB (none) by default."""
    kind = kind_of(field.dataType)
    if kind == "dyn":
        return str(field.metadata.get("affinity", "BLOB")).upper()
    return {"int": "INTEGER", "bool": "INTEGER", "real": "REAL", "decimal": "NUMERIC", "time": "NUMERIC", "text": "TEXT", "blob": "BLOB"}.get(kind, "BLOB")


def _cell(c: int, i: Column | None = None, r: Column | None = None, t: Column | None = None, b: Column | None = None) -> Column:
    none = F.lit(None)
    parts = [F.lit(c).cast("tinyint"), (none if i is None else i).cast("bigint"), (none if r is None else r).cast("double"), (none if t is None else t).cast("string"), (none if b is None else b).cast("binary")]
    return F.struct(*[p.alias(n) for p, n in zip(parts, "cirtb")])


def _negative_zero(r: Column) -> Column:
    return (r == 0) & (r.cast("string") == "-0.0")


def real_cell(r: Column) -> Column:
    """A real's cell; NaN is NULL."""
    cell = _cell(REAL, F.when(_negative_zero(r), 1), r)
    return F.when(r.isNull() | F.isnan(r), _cell(NULL)).otherwise(cell)


def int_cell(i: Column) -> Column:
    return F.when(i.isNull(), _cell(NULL)).otherwise(_cell(INT, i))


def text_cell(t: Column) -> Column:
    return F.when(t.isNull(), _cell(NULL)).otherwise(_cell(TEXT, t=t))


def blob_cell(b: Column) -> Column:
    return F.when(b.isNull(), _cell(NULL)).otherwise(_cell(BLOB, b=b))


def clean(column: Column, kind: str) -> Column:
    """A column as it is stored: NaN is NULL, and a missing or ill-formed cell is the NULL cell."""
    if kind == "real":
        return F.when(~F.isnan(column), column)
    if kind != "dyn":
        return column
    by_class = F.when(column["c"] == INT, int_cell(column["i"])).when(column["c"] == REAL, real_cell(column["r"])).when(column["c"] == TEXT, text_cell(column["t"])).when(column["c"] == BLOB, blob_cell(column["b"]))
    return F.coalesce(by_class, _cell(NULL))


def _as_integer(r: Column) -> Column:
    """The integer that a real equals, if there is one of 64 bits; else NULL."""
    inside = (r >= _LOW) & (r < _HIGH)
    return F.when(inside & (r == F.rint(r)), F.when(inside, r).cast("bigint"))


def with_affinity(cell: Column, affinity: str) -> Column:
    """A cell as a column of *affinity* stores it. A real stays a real under TEXT affinity, where renderings differ."""
    text = cell["t"]
    whole_int = F.regexp_extract(text, _INTEGER, 1).try_cast("bigint")
    looks = text.rlike(_NUMBER + _SPACE + "$")
    number = F.trim(text).try_cast("double")
    if affinity in ("INTEGER", "NUMERIC"):
        from_text = F.when(whole_int.isNotNull(), int_cell(whole_int)).when(looks & number.isNotNull(), F.when(_as_integer(number).isNotNull(), int_cell(_as_integer(number))).otherwise(real_cell(number))).otherwise(cell)
        from_real = F.when(_as_integer(cell["r"]).isNotNull(), int_cell(_as_integer(cell["r"]))).otherwise(cell)
        return F.when(cell["c"] == TEXT, from_text).when(cell["c"] == REAL, from_real).otherwise(cell)
    if affinity == "REAL":
        from_text = F.when(looks & number.isNotNull(), real_cell(number)).otherwise(cell)
        return F.when(cell["c"] == TEXT, from_text).when(cell["c"] == INT, real_cell(cell["i"].cast("double"))).otherwise(cell)
    if affinity == "TEXT":
        return F.when(cell["c"] == INT, text_cell(cell["i"].cast("string"))).otherwise(cell)
    return cell


def is_null(column: Column, kind: str) -> Column:
    return (column["c"] == NULL) if kind == "dyn" else column.isNull()


def canonical(column: Column, kind: str) -> Column:
    """The value as a group or join key."""
    if kind == "real":
        return F.when(column == 0, F.lit(0.0)).otherwise(column)
    if kind != "dyn":
        return column
    whole = _as_integer(column["r"])
    return F.when((column["c"] == REAL) & whole.isNotNull(), int_cell(whole)).otherwise(column)


def join_key(column: Column, kind: str) -> Column:
    """The canonical value, NULL for NULL: NULL joins nothing."""
    key = canonical(column, kind)
    return F.when(column["c"] != NULL, key) if kind == "dyn" else key


def key_output(key: Column, kind: str, real_rows: Column) -> Column:
    """A group's key as it is put out: a number that came as a real in any row of the group is a real."""
    if kind != "dyn":
        return key
    return F.when((key["c"] == INT) & (real_rows > 0), real_cell(key["i"].cast("double"))).otherwise(key)


def sort_key(column: Column, kind: str) -> Column:
    """A value that Spark orders as the column's values are ordered; of equal numbers the integer comes first, -0.0 last."""
    if kind != "dyn":
        return column
    number = column["c"].isin(INT, REAL)
    rough = F.when(column["c"] == INT, column["i"].cast("double")).when(column["c"] == REAL, column["r"] + F.lit(0.0))
    tie = F.when(column["c"] == INT, column["i"]).when(column["c"] == REAL, F.coalesce(_as_integer(column["r"]), F.when(column["r"] >= _HIGH, F.lit(2**63 - 1)).otherwise(F.lit(0))))
    entry = F.when(column["c"] == INT, 0).when((column["c"] == REAL) & (column["i"] == 1), 2).otherwise(1)
    text = F.when(column["c"] == TEXT, column["t"].cast("binary")).when(column["c"] == BLOB, column["b"])
    return F.struct(F.when(number, 1).otherwise(column["c"].cast("int")).alias("c"), rough.alias("f"), tie.alias("tie"), F.when(number, entry).alias("e"), text.alias("b"))


def exact_order(column: Column, kind: str) -> Column:
    """sort_key without the preference among equal numbers: equal means equal in value."""
    key = sort_key(column, kind)
    return F.struct(key["c"].alias("c"), key["f"].alias("f"), key["tie"].alias("tie"), key["b"].alias("b")) if kind == "dyn" else key


def number_parts(column: Column, kind: str) -> tuple[Column, Column]:
    """How a value counts in a sum: (integer, real), of which one is not NULL for a value that isn't NULL.

    Text counts as the integer it spells, or else as the real its beginning spells, 0.0 if it spells none; a blob counts as
    its text does, but never as an integer.
    """

    def spelled(text: Column, may_be_int: bool) -> tuple[Column, Column]:
        whole = F.regexp_extract(text, _INTEGER, 1).try_cast("bigint") if may_be_int else F.lit(None).cast("bigint")
        real = F.coalesce(F.regexp_extract(text, _NUMBER, 1).try_cast("double"), F.lit(0.0))
        return whole, F.when(text.isNotNull() & whole.isNull(), real)

    no_int, no_real = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    if kind in ("int", "bool"):
        return column.cast("bigint"), no_real
    if kind in ("real", "decimal"):
        return no_int, column.cast("double")
    if kind == "text":
        return spelled(column, True)
    if kind == "blob":
        return spelled(F.decode(column, "UTF-8"), False)
    text_int, text_real = spelled(column["t"], True)
    _, blob_real = spelled(F.decode(column["b"], "UTF-8"), False)
    c = column["c"]
    return F.when(c == INT, column["i"]).when(c == TEXT, text_int), F.when(c == REAL, column["r"]).when(c == TEXT, text_real).when(c == BLOB, blob_real)
