"""Column expressions: summary extraction, sizes and their texts, labels and classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import CHANGE_KEYS, column_of

BYTES_PER_MB = 1024 * 1024
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
UNPARTITIONED = "<unpartitioned>"

# Marker colours of the snapshot operations, and of any other operation.
OPERATION_COLOURS = {
    "append": "#2ca02c",
    "replace": "#d62728",
    "overwrite": "#ff7f0e",
    "delete": "#9467bd",
}
OTHER_COLOUR = "#1f77b4"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- snapshot summaries ------------------------------------------------------------------------------------------------


def summary_metric(key: str, summary: Column | str = "summary", strict: bool = True) -> Column:
    """One summary value as a BIGINT, 0 when the key is missing.

    Summary values are text. ``strict`` raises on text that is no number; otherwise such a value counts as 0 and
    :func:`metagauge.operators.snapshots.summary_errors` reports it.
    """
    text = F.try_element_at(_col(summary), F.lit(key))
    number = text.cast("bigint") if strict else text.try_cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint")).alias(column_of(key))


def summary_metrics(extra: Iterable[str] = (), strict: bool = True) -> list[Column]:
    """The seven change metrics of a snapshot, and ``extra`` summary keys after them."""
    return [summary_metric(k, strict=strict) for k in (*CHANGE_KEYS, *extra)]


# -- times -------------------------------------------------------------------------------------------------------------


def utc_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time, or of a time without zone taken as UTC, whatever the session's zone."""
    c = _col(ts)
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    plain = (F.unix_date(F.to_date(c)) * F.lit(86_400).cast("bigint") + clock) * 1_000_000 + (
        F.extract(F.lit("SECOND"), c) * 1_000_000
    ).cast("bigint")
    return F.when(F.typeof(c) == "timestamp_ntz", plain).otherwise(F.unix_micros(c.cast("timestamp")))


def utc_text(micros: Column | str, between: str = " ", fraction: bool = True) -> Column:
    """Microseconds since 1970 as UTC text, whatever the session's zone; six fraction digits unless they are all zero."""
    n = _col(micros)
    seconds = F.floor(n / 1_000_000)
    part = F.pmod(n, F.lit(1_000_000))
    of_day = F.pmod(seconds, F.lit(86_400))

    def two(number: Column) -> Column:
        return F.lpad(F.floor(number).cast("string"), 2, "0")

    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    clock = F.concat_ws(":", two(of_day / 3600), two(F.pmod(F.floor(of_day / 60), F.lit(60))), two(F.pmod(of_day, F.lit(60))))
    # concat_ws would skip what a missing time lacks.
    whole = F.when(n.isNotNull(), F.concat(day, F.lit(between), clock))
    if not fraction:
        return whole
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(part.cast("string"), 6, "0")))


def iso_time(ts: Column | str) -> Column:
    """ISO-8601 text in UTC; the six fraction digits appear only when they are not all zero."""
    return utc_text(utc_micros(ts), "T")


def display_time(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, or ``Unknown`` for no time."""
    return F.coalesce(utc_text(utc_micros(ts), fraction=False), F.lit("Unknown"))


# -- sizes -------------------------------------------------------------------------------------------------------------


def megabytes(size: Column | str) -> Column:
    """Bytes as MB, not rounded."""
    return _col(size) / F.lit(BYTES_PER_MB)


def bytes_to_mb(size: Column | str) -> Column:
    """Bytes as MB with two decimals, ties to even (131072 bytes are 0.12)."""
    return F.bround(megabytes(size), 2)


def grouped_text(value: Column | str, decimals: int = 2, suffix: str = "") -> Column:
    """Digit groups separated by commas, with the given number of decimals.

    ``format_number`` rounds the exact binary value, ties to even; ``format_string`` would round its shortest decimal
    spelling, ties up.
    """
    text = F.format_number(_col(value), decimals)
    return F.concat(text, F.lit(suffix)) if suffix else text


def fixed_text(value: Column | str, suffix: str = "") -> Column:
    """Two decimals without digit grouping."""
    text = F.replace(grouped_text(_col(value).cast("double")), F.lit(","), F.lit(""))
    return F.concat(text, F.lit(suffix)) if suffix else text


def format_bytes(size: Column | str) -> Column:
    """Size in the first unit that keeps the number below 1024, with two decimals."""
    size = _col(size).cast("double")
    result = None
    for power, unit in enumerate(BYTE_UNITS):
        scaled = size / F.lit(float(1024**power))
        text = fixed_text(scaled, f" {unit}")
        if power == len(BYTE_UNITS) - 1:
            return result.otherwise(text)
        fits = scaled < 1024.0
        result = F.when(fits, text) if result is None else result.when(fits, text)
    return result


def safe_average(total: Column, count: Column) -> Column:
    """``total / count`` as a double; 0 where there is nothing to average over."""
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def half_even_mean(total: Column, count: Column) -> Column:
    """Mean as a BIGINT, ties to even (a plain cast would truncate)."""
    return F.rint(total / count).cast("bigint")


# -- labels and classes ------------------------------------------------------------------------------------------------


def file_type(content: Column | str = "content") -> Column:
    return F.when(_col(content) == 0, F.lit("DATA_FILES")).otherwise(F.lit("DELETE_FILES"))


def title_words(name: Column | str) -> Column:
    """``added_records`` as ``Added Records``."""
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))


def short_table_name(name: Column | str) -> Column:
    """Text after the last dot."""
    return F.substring_index(_col(name), ".", -1)


def operation_class(operation: Column | str = "operation") -> Column:
    op = _col(operation)
    return F.when(op.isin(*OPERATION_COLOURS), op).otherwise(F.lit("other"))


def operation_colour(operation: Column | str = "operation") -> Column:
    op = _col(operation)
    chain = F
    for name, colour in OPERATION_COLOURS.items():
        chain = chain.when(op == name, F.lit(colour))
    return chain.otherwise(F.lit(OTHER_COLOUR))


def snapshot_option_text(snapshot_id: Column | str, ts: Column | str, operation: Column | str) -> Column:
    # Text of a missing operation, as Python prints it.
    op = F.coalesce(_col(operation), F.lit("None"))
    return F.format_string("Snapshot %s - %s (%s)", _col(snapshot_id).cast("string"), display_time(ts), op)


def skew_class(cv: Column | str) -> Column:
    """Class of a coefficient of variation; an undefined one counts as balanced."""
    cv = _col(cv)
    known = cv.isNotNull() & ~F.isnan(cv)
    return (
        F.when(known & (cv > 0.5), F.lit("skewed"))
        .when(known & (cv > 0.3), F.lit("moderate"))
        .otherwise(F.lit("balanced"))
    )


def gauge_band(cv: Column | str) -> Column:
    """Band of the skew gauge, whose axis ends at 1; each band includes its lower end."""
    shown = F.least(_col(cv), F.lit(1.0))
    return F.when(shown < 0.3, F.lit("low")).when(shown < 0.7, F.lit("medium")).otherwise(F.lit("high"))


# -- partition tuples --------------------------------------------------------------------------------------------------


def _value_text(value: Column, dtype: T.DataType) -> Column:
    text = value.cast("string")
    if isinstance(dtype, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit("None"))


def _is_field_list(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)


def partition_label(df: DataFrame, partition: str = "partition") -> Column:
    """``k=v, k2=v2`` for a struct or a list of (name, value) fields, the text itself for anything else."""
    dtype = df.schema[partition].dataType
    col = F.col(partition)
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return F.lit(UNPARTITIONED)
        parts = [
            F.concat(F.lit(f"{f.name}="), _value_text(col.getField(f.name), f.dataType)) for f in dtype.fields
        ]
        return F.concat_ws(", ", *parts)
    if _is_field_list(dtype):
        pairs = F.transform(
            col, lambda e: F.concat(e["name"], F.lit("="), F.coalesce(e["value"], F.lit("None")))
        )
        return F.when(F.size(col) > 0, F.concat_ws(", ", pairs)).otherwise(F.lit(UNPARTITIONED))
    return F.coalesce(col.cast("string"), F.lit(UNPARTITIONED))


def partition_columns(
    df: DataFrame, partition: str = "partition", names: Iterable[str] | None = None, prefix: str = "partition_"
) -> list[Column]:
    """The partition tuple as columns, one per field.

    A struct brings its field names. A list of fields has none at planning time, so ``names`` gives the fields of the
    table's partition spec; without them, and for every other type, the tuple stays one text column.
    """
    dtype = df.schema[partition].dataType
    if isinstance(dtype, T.StructType) and dtype.fields:
        return [F.col(partition).getField(f.name).alias(prefix + f.name) for f in dtype.fields]
    if _is_field_list(dtype) and names:
        values = F.map_from_entries(partition)
        return [F.try_element_at(values, F.lit(n)).alias(prefix + n) for n in names]
    return [partition_label(df, partition).alias("partition")]


# -- file paths --------------------------------------------------------------------------------------------------------


def normal_path(path: Column | str) -> Column:
    """Path in one spelling, so that a listing and a manifest agree on the same file.

    ``file:/a`` and ``file:///a`` become ``/a``; ``s3a`` and ``s3n`` become ``s3``; an HDFS authority is dropped, since
    one name node has several spellings. Nothing is URL-decoded: names in manifests and listings are raw.
    """
    p = _col(path)
    rest = F.lit(2**31 - 1)

    def after(prefix: str) -> Column:
        return F.substring(p, F.lit(len(prefix) + 1), rest)

    return (
        F.when(p.startswith("file:/"), F.concat(F.lit("/"), F.ltrim(after("file:/"), F.lit("/"))))
        .when(p.startswith("s3a://") | p.startswith("s3n://"), F.concat(F.lit("s3://"), after("s3x://")))
        .when(p.startswith("hdfs://") | p.startswith("viewfs://"), F.regexp_replace(p, r"^\w+://[^/]*/", "/"))
        .otherwise(p)
    )
