"""JSON Schema compiled to columns: the type to parse a body with, and why a body is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names of types in schemas, in SQL, and of variants ---
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
# --- end of fixed values ---


def sql_type(schema: dict) -> str:
    """Type for ``from_json``."""
    if schema["type"] == "object":
        return "struct<" + ", ".join(f"`{k}`: {sql_type(v)}" for k, v in schema["properties"].items()) + ">"
    if schema["type"] == "array":
        return f"array<{sql_type(schema['items'])}>"
    return SQL_TYPES[schema["type"]]


def _value(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _limits(v: Column, schema: dict) -> list[tuple[Column, str]]:
    """What is wrong with a value that has the schema's type, and its text."""
    number, text, found = _value(v, "double"), _value(v, "string"), []
    if "minimum" in schema:
        found.append((number < schema["minimum"], f"below {schema['minimum']}"))
    if "maximum" in schema:
        found.append((number > schema["maximum"], f"above {schema['maximum']}"))
    if "minLength" in schema:
        found.append((F.length(text) < schema["minLength"], f"shorter than {schema['minLength']}"))
    if "maxLength" in schema:
        found.append((F.length(text) > schema["maxLength"], f"longer than {schema['maxLength']}"))
    if "pattern" in schema:
        found.append((~F.rlike(text, F.lit(schema["pattern"])), f"does not match {schema['pattern']}"))
    if "enum" in schema:
        found.append((~text.isin(*map(str, schema["enum"])), "not one of " + ", ".join(map(str, schema["enum"]))))
    items = _value(v, "array<variant>")
    if "minItems" in schema:
        found.append((F.size(items) < schema["minItems"], f"fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        found.append((F.size(items) > schema["maxItems"], f"more than {schema['maxItems']} items"))
    return found


def _reasons(v: Column, schema: dict, path: str) -> Column:
    """Reasons of a value that is there."""
    kind = schema["type"]
    fits = F.coalesce(F.rlike(F.schema_of_variant(v), F.lit(f"^({VARIANT_TYPES[kind]})")), F.lit(False))
    wrong = F.lit(f"{path}: not {'an' if kind[0] in 'aio' else 'a'} {kind}")
    parts = [F.when(bad, F.array(F.lit(f"{path}: {why}"))) for bad, why in _limits(v, schema)]
    if kind == "object":
        for name, below in schema["properties"].items():
            own, at = F.try_variant_get(v, f"$.{name}", "variant"), f"{path}.{name}"
            here = own.isNotNull() & (F.schema_of_variant(own) != "VOID")
            missing = F.array(F.lit(f"{at}: missing")) if name in schema.get("required", ()) else F.array().cast("array<string>")
            parts.append(F.when(here, _reasons(own, below, at)).otherwise(missing))
    if kind == "array":
        parts.append(F.array_distinct(F.flatten(F.transform(_value(v, "array<variant>"), lambda x: _reasons(x, schema["items"], f"{path}[]")))))
    empty = F.array().cast("array<string>")
    inside = F.concat(*[F.coalesce(p, empty) for p in parts]) if parts else empty
    return F.when(fits, inside).otherwise(F.array(wrong))


def reject_reasons(body: Column | str, schema: dict) -> Column:
    """Why a body does not follow the schema, in the schema's order; empty if it does.

    ``type``, ``properties``, ``required``, ``items``, ``enum``, ``pattern`` and
    the limits of numbers, lengths and items are checked on the body's own
    types: a number in quotes is no number. A body that is null or no JSON has
    the one reason ``$: no JSON``. Items of an array give each reason once.
    """
    v = F.try_parse_json(body)
    return F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_reasons(v, schema, "$"))


def parsed(body: Column | str, schema: dict) -> Column:
    """The body as the schema's type; null if it does not follow the schema."""
    return F.when(F.size(reject_reasons(body, schema)) == 0, F.from_json(body, sql_type(schema)))
