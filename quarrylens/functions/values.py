"""Value-level rules shared by profiling, quality and relationship jobs.

These rules are applied to every column of every table, so they are written as
Spark SQL expression text: a table's whole select list is then parsed in one
call instead of being assembled from thousands of Column objects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# Accepted text layouts of a date or time stamp.
DATE_LAYOUTS = (
    "yyyy-M-d[['T'][' ']H:m[:s[.SSSSSSSSS]]][XXX]",
    "yyyy/M/d[ H:m[:s]]",
    "M/d/yyyy[ H:m[:s]]",
    "d/M/yyyy[ H:m[:s]]",
    "M-d-yyyy[ H:m[:s]]",
    "d-M-yyyy[ H:m[:s]]",
    "yyyyMMdd",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)

# Format patterns of the quality checks.
EMAIL_FORMAT = r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"
DATE_FORMAT = (
    r"^\d{4}[-/]\d{2}[-/]\d{2}(?:\s\d{2}:\d{2}:\d{2})?$"
    r"|^\d{2}[-/]\d{2}[-/]\d{4}$"
)

# A text column holds dates where at least this share of its filled cells reads
# as one; what doesn't read as a date there is malformed.
DATE_SHARE = 0.9

# What a text has to look like to be tried in some of the layouts (by position
# in DATE_LAYOUTS). A failed parse is dear, so no cell is tried in more than two.
PLAUSIBLE_DATE = r"^ *(\d{4}[-/]\d{1,2}[-/]\d|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{8} *$|\d{1,2} [A-Z]|[A-Z][a-z]{2,8} \d)"
PLAIN_DATE = r"^\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d)?\z"
DATE_SHAPES = (
    (r"^ *\d{4}-\d{1,2}-\d{1,2}(?!\d)", (0,)),
    (r"^ *\d{4}/\d{1,2}/\d{1,2}(?!\d)", (1,)),
    (r"^ *\d{1,2}/\d{1,2}/\d{4}(?!\d)", (2, 3)),
    (r"^ *\d{1,2}-\d{1,2}-\d{4}(?!\d)", (4, 5)),
    (r"^ *\d{8} *$", (6,)),
    (r"^ *\d{1,2} [A-Z]", (7, 8)),
    (r"^ *[A-Z][a-z]", (9, 10)),
)

# Values this long or longer are compared by their SHA-256 text, which has
# exactly this many characters; shorter values are compared as they are. The
# two sets cannot meet, and a shuffle never carries whole documents.
DIGEST_LENGTH = 64

# The long form keeps values typed: one slot per family instead of a cast to text.
SLOTS = {"v_int": "bigint", "v_num": "double", "v_text": "string", "v_ts": "timestamp_ntz"}
WHOLE_SLOT = "v_int"


def quote(name: str) -> str:
    """A column's exact name as SQL text, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(quote(name))


def literal(text: str) -> str:
    """A string literal as SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean(name: str, dtype: T.DataType) -> str:
    """The column with NaN read as null; other types unchanged."""
    column = quote(name)
    if isinstance(dtype, FRACTIONAL):
        return f"nanvl({column}, CAST(NULL AS {dtype.simpleString()}))"
    return column


def logical_type(dtype: T.DataType) -> str:
    """Five-value logical type of a storage type; strings start as TEXT."""
    if isinstance(dtype, TEMPORAL):
        return "DATETIME"
    if isinstance(dtype, INTEGRAL):
        return "INTEGER"
    if isinstance(dtype, FRACTIONAL + (T.DecimalType,)):
        return "FLOAT"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "TEXT"


def _digested(text: str) -> str:
    return f"CASE WHEN octet_length({text}) >= {DIGEST_LENGTH} THEN sha2({text}, 256) ELSE {text} END"


def equality_key(name: str, dtype: T.DataType) -> str:
    """A groupable, bounded-width stand-in: equal keys if and only if equal values."""
    column = clean(name, dtype)
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return _digested(column)
    if isinstance(dtype, T.BinaryType):
        return _digested(f"base64({column})")
    if isinstance(dtype, COMPLEX):
        return _digested(f"to_json({_canonical(column, dtype)})")
    return column


def fingerprint(fields: Sequence[T.StructField]) -> str:
    """Eight bytes of a row: equal for equal rows, and seldom for others."""
    cells = ["0"]
    for f in fields:
        cell = clean(f.name, f.dataType)
        if isinstance(f.dataType, FRACTIONAL):
            cell = f"({cell} + CAST(0 AS {f.dataType.simpleString()}))"
        elif isinstance(f.dataType, COMPLEX):
            cell = f"to_json({_canonical(cell, f.dataType)})"
        elif isinstance(f.dataType, T.StringType) and f.dataType.simpleString() != "string":
            continue  # texts of another collation may be equal without the same bytes
        cells.append(cell)
    return f"xxhash64({', '.join(cells)})"


def _canonical(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """Equal nested values in one form: map entries sorted, no negative zeros."""
    x = f"x{depth}"
    if isinstance(dtype, FRACTIONAL):
        return f"({value} + CAST(0 AS {dtype.simpleString()}))"
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, COMPLEX + FRACTIONAL):
        return f"transform({value}, {x} -> {_canonical(x, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        pair = f"struct({_canonical(f'{x}.key', dtype.keyType, depth + 1)} AS k, {_canonical(f'{x}.value', dtype.valueType, depth + 1)} AS v)"
        return f"array_sort(transform(map_entries({value}), {x} -> {pair}))"
    if isinstance(dtype, T.StructType) and dtype.fields:
        parts = ", ".join(f"{literal(f.name)}, {_canonical(f'{value}.{quote(f.name)}', f.dataType, depth)}" for f in dtype.fields)
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({parts}) END"
    return value


def no_value(slot_type: str) -> str:
    """What a slot holds that a column doesn't use."""
    return f"CAST(NULL AS {slot_type})"


# Slots of the parts of a column: whole numbers, and values that are compared as they are.
WORDS, NUMBERS, LOCAL_TIMES, TEXTS = "words", "numbers", "local_times", "texts"
DAY, SECOND = 86_400_000_000, 1_000_000  # microseconds


def distinct_parts(name: str, dtype: T.DataType) -> list[tuple[str, str]]:
    """(slot, value) of the parts of a column. A filled cell has a value in exactly one
    part, and values of a part are equal if and only if those of the column are. Doubles
    of two decimal places stand as hundredths, time stamps as days or seconds if whole."""
    column = clean(name, dtype)
    if isinstance(dtype, INTEGRAL + (T.BooleanType,)):
        return [(WORDS, f"CAST({column} AS BIGINT)")]
    if isinstance(dtype, FRACTIONAL):
        number = f"CAST({column} AS DOUBLE)"
        # below 1e13 all hundredths are exact whole numbers
        short = f"(abs({number}) < 1e13D AND rint({number} * 100D) / 100D = {number})"
        return [
            (WORDS, f"CASE WHEN {short} THEN CAST(rint({number} * 100D) AS BIGINT) END"),
            (NUMBERS, f"CASE WHEN NOT {short} THEN {number} END"),
        ]
    if isinstance(dtype, T.TimestampNTZType):
        day = f"CAST({column} AS DATE)"
        midnight = f"{column} = CAST({day} AS TIMESTAMP_NTZ)"
        return [
            (WORDS, f"CASE WHEN {midnight} THEN CAST(unix_date({day}) AS BIGINT) END"),
            (LOCAL_TIMES, f"CASE WHEN NOT ({midnight}) THEN {column} END"),
        ]
    if isinstance(dtype, T.TimestampType):
        micros = f"unix_micros({column})"
        return [
            (WORDS, f"CASE WHEN {micros} % {DAY}L = 0 THEN {micros} DIV {DAY}L END"),
            (WORDS, f"CASE WHEN {micros} % {DAY}L <> 0 AND {micros} % {SECOND} = 0 THEN {micros} DIV {SECOND} END"),
            (WORDS, f"CASE WHEN {micros} % {SECOND} <> 0 THEN {micros} END"),
        ]
    if isinstance(dtype, T.DateType):
        return [(WORDS, f"CAST(unix_date({column}) AS BIGINT)")]
    return [(TEXTS, f"CAST({equality_key(name, dtype)} AS STRING)")]


# Forms in which the keys of two columns can be compared. A form with a colon
# carries the scale or the type it stands for.
INT, WHOLE, EXACT, DOUBLE, DECIMAL, DATE, TIME, LOCAL_TIME, BOOL, TEXT, BINARY, NESTED = (
    "int", "whole", "exact", "double", "decimal", "date", "time", "local_time", "bool", "text", "binary", "nested",
)
MOST_DIGITS = 38


def common_form(a: T.DataType, b: T.DataType) -> str | None:
    """The form in which values of both types are equal if and only if Spark or
    plain arithmetic holds them for equal; None where no value of one can equal
    one of the other."""

    def either(*kinds: type) -> bool:
        return isinstance(a, kinds) or isinstance(b, kinds)

    def both(*kinds: type) -> bool:
        return isinstance(a, kinds) and isinstance(b, kinds)

    if both(*INTEGRAL):
        return INT
    if both(T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        # wider than any decimal: compared without the zeros at the end
        return f"{DECIMAL}:{scale}" if whole + scale <= MOST_DIGITS else EXACT
    if both(*NUMERIC):
        if either(*FRACTIONAL):
            return WHOLE if either(*INTEGRAL) else DOUBLE
        return EXACT
    if both(T.DateType):
        return DATE
    if both(T.TimestampNTZType):
        return LOCAL_TIME
    if both(*TEMPORAL):
        return TIME
    for kind, form in ((T.BooleanType, BOOL), (T.BinaryType, BINARY)):
        if both(kind):
            return form
    texts = (T.StringType, T.VarcharType, T.CharType)
    if both(*texts):
        return TEXT
    if both(*COMPLEX) and a.simpleString() == b.simpleString():
        return f"{NESTED}:{a.simpleString()}"
    return None


def form_values(name: str, dtype: T.DataType, form: str, whole_text: bool = False) -> list[str]:
    """The value of a column in a form, spread over the slots; one slot is used at most."""
    column, slots = clean(name, dtype), dict.fromkeys(SLOTS)
    kind, _, detail = form.partition(":")
    if kind == INT:
        slots["v_int"] = f"CAST({column} AS BIGINT)"
    elif kind == WHOLE and isinstance(dtype, FRACTIONAL):
        # 2^63 is the first double beyond the whole numbers
        number = f"CAST({column} AS DOUBLE)"
        fits = f"{number} = floor({number}) AND {number} >= -9223372036854775808D AND {number} < 9223372036854775808D"
        slots["v_int"] = f"CASE WHEN {fits} THEN try_cast({number} AS BIGINT) END"
        slots["v_num"] = f"CASE WHEN NOT ({fits}) THEN {number} END"
    elif kind in (WHOLE, EXACT) and isinstance(dtype, INTEGRAL):
        slots["v_int" if kind == WHOLE else "v_text"] = f"CAST({column} AS {'BIGINT' if kind == WHOLE else 'STRING'})"
    elif kind == EXACT:
        digits = f"CAST({column} AS STRING)"
        slots["v_text"] = f"CASE WHEN contains({digits}, '.') THEN trim(TRAILING '.' FROM trim(TRAILING '0' FROM {digits})) ELSE {digits} END"
    elif kind == DOUBLE:
        slots["v_num"] = f"(CAST({column} AS DOUBLE) + 0D)"
    elif kind == DECIMAL:
        slots["v_text"] = f"CAST(CAST({column} AS DECIMAL({MOST_DIGITS}, {detail})) AS STRING)"
    elif kind == DATE:
        slots["v_int"] = f"CAST(unix_date({column}) AS BIGINT)"
    elif kind == TIME:
        slots["v_int"] = f"unix_micros(CAST({column} AS TIMESTAMP))"
    elif kind == LOCAL_TIME:
        slots["v_ts"] = column
    elif kind == BOOL:
        slots["v_int"] = f"CAST({column} AS BIGINT)"
    elif kind == TEXT and whole_text:
        slots["v_text"] = f"CAST({column} AS STRING)"
    else:
        slots["v_text"] = equality_key(name, dtype)
    return [slots[s] or no_value(t) for s, t in SLOTS.items()]


def shown_key(form: str) -> str:
    """A key in a form as text, from its slots."""
    kind = form.partition(":")[0]
    if kind == DATE:
        return "CAST(date_from_unix_date(CAST(v_int AS INT)) AS STRING)"
    if kind == TIME:
        return "CAST(timestamp_micros(v_int) AS STRING)"
    if kind == BOOL:
        return "CAST(CAST(v_int AS BOOLEAN) AS STRING)"
    return f"coalesce({', '.join(f'CAST({s} AS STRING)' for s in SLOTS)})"


ANY_SLOT = " OR ".join(f"{s} IS NOT NULL" for s in SLOTS)


def parses_as_date(text: str) -> str:
    """True if the text reads as a date in one of the fixed layouts. Texts of the
    plainest shape are cast, which is as strict and much cheaper than a layout."""
    plain = f"length({text}) IN (10, 19) AND {text} RLIKE r'{PLAIN_DATE}'"
    tried = " ".join(
        f"WHEN {text} RLIKE r'{shape}' THEN coalesce("
        + ", ".join(f"try_to_timestamp(trim({text}), {literal(DATE_LAYOUTS[i])})" for i in layouts)
        + ") IS NOT NULL"
        for shape, layouts in DATE_SHAPES
    )
    return (
        f"CASE WHEN {plain} THEN try_cast({text} AS TIMESTAMP_NTZ) IS NOT NULL "
        f"WHEN {text} RLIKE r'{PLAUSIBLE_DATE}' THEN CASE {tried} ELSE false END ELSE false END"
    )


def maybe_date(text: str) -> str:
    """False only for texts that neither read nor look like a date: all layouts take at
    least eight characters and begin with a digit or a capital letter, spaces aside."""
    first = f"ascii({text})"
    return f"octet_length({text}) >= 8 AND ({first} BETWEEN 48 AND 57 OR {first} BETWEEN 65 AND 90 OR {first} = 32)"


def each_text(texts: list[str], rule: Callable[[str], str]) -> str:
    """A date rule of many branches for several texts, as one array; null in place of the
    array or of an entry where no text, or not that one, may be a date. Written out for every
    column of a wide table it makes very long generated code, which ran slower."""
    if not texts:
        return "array()"
    tried = ", ".join(f"CASE WHEN {maybe_date(t)} THEN {t} END" for t in texts)
    some = " OR ".join(f"({maybe_date(t)})" for t in texts)
    return f"CASE WHEN {some} THEN transform(array({tried}), t -> CASE WHEN t IS NOT NULL THEN {rule('t')} END) END"


def mostly_dates(date_cells: str, filled: str) -> str:
    """Does a text column with so many date cells among its filled ones hold dates?"""
    return f"({filled} > 0 AND {date_cells} >= {DATE_SHARE}D * {filled})"


def bad_email(text: str) -> str:
    return f"NOT ({text} RLIKE r'{EMAIL_FORMAT}')"


# How a cell reads: as a date, as the layout of one only, or as neither.
READS_AS_DATE, LOOKS_LIKE_DATE, NO_DATE = 2, 1, 0


def date_reading(text: str) -> str:
    return (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN {parses_as_date(text)} THEN {READS_AS_DATE} "
        f"WHEN {text} RLIKE r'{DATE_FORMAT}' THEN {LOOKS_LIKE_DATE} ELSE {NO_DATE} END"
    )


def format_rule(name: str, is_datetime: bool) -> str | None:
    """Which format check a column gets: by name first, then by logical type."""
    lowered = name.lower()
    if "email" in lowered:
        return "email"
    if "date" in lowered or is_datetime:
        return "date"
    return None


def cell_text(name: str, dtype: T.DataType) -> str:
    """The text that a format check reads."""
    return f"to_json({quote(name)})" if isinstance(dtype, COMPLEX) else f"CAST({clean(name, dtype)} AS STRING)"
