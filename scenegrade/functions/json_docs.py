"""Strict JSON parsing and leaf access over VARIANT columns.

Leaves are read as JSON text (``leaf``): the first character then carries the
type, so ``true`` and ``"true"`` stay apart. ``canon`` turns that text into a
key under which two leaves are equal exactly when Python's ``==`` says so for
scalars: booleans and numbers share one scale, strings keep their quotes, and
absent and null are both NULL.
"""

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = r"[\s\x1c-\x1f]"  # with (?U): what Python's str.strip() removes

# the same for a JSON string as it is written, quotes and escapes included
BLANK_STRING = r'(?U)^"(?:[\s\x1c-\x1f]|\\[nrtf]|\\u000[Bb]|\\u001[C-Fc-f])*"$'


def col(c):
    return F.col(c) if isinstance(c, str) else c


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that filters above will not duplicate.

    Catalyst copies a column's expression into every filter it pushes below the
    projection. It does not push through a generator, so the value is emitted by
    one that yields exactly one row. The value itself stays in a projection, which
    is compiled; generator expressions are not when they are large.
    """
    ready = df.withColumn("_once", value)
    return ready.select(*df.columns, F.explode_outer(F.array("_once")).alias(name))


def has_key(key: str) -> str:
    """Column of ``parse_documents`` that says whether the object has this top-level key."""
    return f"_has_{key}"


def parse_documents(docs: DataFrame, text: str = "text", present: tuple = ()) -> DataFrame:
    """Add ``json_ok`` (whole text is one JSON value), ``parse_ok`` (that value is an
    object) and ``obj`` (the object as VARIANT, else NULL).

    ``try_parse_json`` stops at the end of the first value, so the text is parsed
    inside an array whose last element is a hash of the text. Anything after the
    value either changes the element count, hides the hash or breaks the parse.

    ``present`` names top-level keys; for each a column (``has_key``) says whether the object has it. They are read from
    the array: taking ``obj`` out of it writes the whole object anew, which a plan that needs no more is spared.
    """
    seal = F.hex(F.xxhash64(text))
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"'), seal, F.lit('"]')))
    sealed = (F.try_variant_get("_wrapped", "$[1]", "string") == seal) & F.try_variant_get(
        "_wrapped", "$[2]", "variant"
    ).isNull()
    return (
        computed_once(docs, "_wrapped", wrapped)
        .withColumn("json_ok", F.coalesce(sealed, F.lit(False)))
        .withColumn("parse_ok", F.col("json_ok") & (F.col(text).startswith("{") | F.col(text).rlike(r"^[ \t\r\n]*\{")))
        .withColumns({has_key(key): F.col("parse_ok") & F.try_variant_get("_wrapped", f"$[0].{key}", "variant").isNotNull() for key in present})
        .withColumn("obj", F.when(F.col("parse_ok"), F.try_variant_get("_wrapped", "$[0]", "variant")))
        .drop("_wrapped")
    )


def json_path(dotted: str) -> str:
    """Dotted names as a literal JSON path; names may hold spaces, not dots."""
    return "$" + "".join(f"['{name}']" if " " in name else f".{name}" for name in dotted.split("."))


def sub(v, dotted: str) -> Column:
    """Sub-variant at a path through objects; NULL when absent."""
    return F.try_variant_get(col(v), json_path(dotted), "variant")


def leaf(v, dotted: str) -> Column:
    """JSON text of the leaf at a path; NULL when absent."""
    return F.to_json(sub(v, dotted))


def is_present(v, dotted: str) -> Column:
    """Key exists, even with a null value."""
    return sub(v, dotted).isNotNull()


def elements(v, dotted: str) -> Column:
    """List at a path as ``array<variant>``; NULL when absent or not a list."""
    return F.try_variant_get(col(v), json_path(dotted), "array<variant>")


def members(v, dotted: str | None = None) -> Column:
    """Object at a path as ``map<string,variant>``; NULL when absent or not an object."""
    return F.try_variant_get(col(v), json_path(dotted) if dotted else "$", "map<string,variant>")


def canon(j: Column) -> Column:
    """Equality key of a leaf given as JSON text: integers by their digits, fractions as doubles."""
    number = j.cast("double")
    whole = (F.rint(number) == number) & (F.abs(number) < 9e18)
    return (
        F.when(j.startswith('"'), j)
        .when(j == "null", F.lit(None).cast("string"))
        .when(j == "true", F.lit("1"))
        .when(j.isin("false", "-0"), F.lit("0"))
        .when(j.rlike("^-?[0-9]+$"), j)
        .when(j.rlike("^[-0-9]"), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")))
        .otherwise(j)
    )


def is_null_leaf(j: Column) -> Column:
    return j.isNull() | (j == "null")


def is_string(j: Column) -> Column:
    """Leaf text is a JSON string; never NULL."""
    return F.coalesce(j.startswith('"'), F.lit(False))


def is_object(j: Column) -> Column:
    return F.coalesce(j.startswith("{"), F.lit(False))


def is_integer(v: Column) -> Column:
    """Variant is a JSON integer (booleans and 3.0 are not); never NULL."""
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def is_number(j: Column) -> Column:
    return F.coalesce(j.rlike("^[-0-9]"), F.lit(False))


def is_bool(j: Column) -> Column:
    return F.coalesce(j.isin("true", "false"), F.lit(False))


def text_of(v: Column) -> Column:
    """Variant string as plain text; NULL for every other type."""
    return F.when(is_string(F.to_json(v)), F.try_variant_get(v, "$", "string"))


def unquote(j: Column) -> Column:
    """JSON string text as plain text."""
    plain = F.substring(j, F.lit(2), F.length(j) - 2)
    return F.when(
        j.contains("\\"),
        F.try_variant_get(F.try_parse_json(j), "$", "string"),
    ).otherwise(plain)


def py_str(j: Column) -> Column:
    """``str(x)`` of a leaf: True/False/None spellings, strings bare, containers as JSON."""
    return (
        F.when(j.isNull() | (j == "null"), F.lit("None"))
        .when(j == "true", F.lit("True"))
        .when(j == "false", F.lit("False"))
        .when(j.startswith('"'), unquote(j))
        .otherwise(j)
    )


def strip(text) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col(text), rf"(?U)^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_word(j: Column) -> Column:
    """Leaf text is a JSON string with something else than whitespace in it."""
    return is_string(j) & ~j.rlike(BLANK_STRING)


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def lenient_number(j: Column) -> Column:
    """Lenient float of leaf text: numbers, numeric strings and booleans; NULL otherwise."""
    return (
        F.when(j == "true", F.lit(1.0)).when(j == "false", F.lit(0.0))
        .when(is_number(j), j.try_cast("double"))
        .when(is_string(j), unquote(j).try_cast("double"))
    )


def numeric(j: Column) -> Column:
    """Number or boolean leaf as double, else NULL (strings do not count)."""
    return F.when(j == "true", F.lit(1.0)).when(j == "false", F.lit(0.0)).when(is_number(j), j.cast("double"))
