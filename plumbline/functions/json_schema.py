"""Structural checks of JSON documents against a schema: the keywords type, const, enum, required,
properties, additionalProperties, items and $ref."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER, WHOLE = (int, float), (int,)
KINDS = {"object": (dict,), "array": (list,), "string": (str,), "boolean": (bool,), "null": (type(None),), "number": NUMBER, "integer": WHOLE}


def is_kind(value, kind: str) -> bool:
    """Booleans are no numbers."""
    return isinstance(value, KINDS[kind]) and not (isinstance(value, bool) and KINDS[kind] in (NUMBER, WHOLE))


def faults(document, schema: dict) -> Iterator[str]:
    """``<place>: <keyword>`` of each rule that is broken, parents first."""
    waiting = [("$", document, schema)]
    while waiting:
        place, value, rule = waiting.pop(0)
        while "$ref" in rule:
            rule = schema["$defs"][rule["$ref"].split("/")[-1]]
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(is_kind(value, k) for k in kinds):
            yield f"{place}: type"
            continue  # nothing else about it means anything
        if "const" in rule and value != rule["const"]:
            yield f"{place}: const"
        if "enum" in rule and value not in rule["enum"]:
            yield f"{place}: enum"
        if isinstance(value, dict):
            yield from (f"{place}.{name}: required" for name in rule.get("required", ()) if name not in value)
            known, others = rule.get("properties", {}), rule.get("additionalProperties", True)
            for name, inner in value.items():
                if name not in known and others is False:
                    yield f"{place}.{name}: additionalProperties"
                elif name in known or isinstance(others, dict):
                    waiting.append((f"{place}.{name}", inner, known.get(name, others)))
        elif isinstance(value, list) and "items" in rule:
            waiting.extend((f"{place}[{i}]", inner, rule["items"]) for i, inner in enumerate(value))


def schema_faults(document: Column | str, schema: dict) -> Column:
    """array<string> of the faults of JSON text; text that is no JSON has the one fault ``$: json``,
    and null gives null."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return list(faults(json.loads(text), schema))
            except ValueError:
                return ["$: json"]

        return texts.map(one, na_action="ignore")

    return check(F.col(document) if isinstance(document, str) else document)
