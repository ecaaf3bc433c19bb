"""Parsing of replies into directions, confidences and components."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: patterns and words of the reply formats
DIRECTION = r"(?i)\bDirection\b[\s\*_:]*([+-]?\d+(?:\.\d+)?)"
DIRECTION_LOOSE = r"(?i)\bDirection\b[^\d\n]{0,30}([+-]?\d+(?:\.\d+)?)"
CONFIDENCE = r"(?i)\bConfidence\b[\s\*_:]*([0-9]*\.?[0-9]+)"
CONFIDENCE_LOOSE = r"(?i)\bConfidence\b[^\d\n]{0,30}([0-9]*\.?[0-9]+)"
PERCENT = r"(?i)\bConfidence\b[^\d\n]{0,30}([0-9]+(?:\.[0-9]+)?)\s*%"
JSON_OBJECT = r"\{[^{}]*\}"
UP_WORDS = ("higher", "rose ", "rises", "rising", "gained", "gains ", "up ", "bullish", "increase", "advanced", "positive close")
DOWN_WORDS = ("lower", "fell ", "falls", "falling", "declined", "decline", "down ", "bearish", "decrease", "negative close")
FLAT_WORDS = ("unchanged", "flat ", "no change", "no movement", "even close")
TAIL_CHARS = 600


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _whole(raw: Column) -> Column:
    """-1, 0 or 1 from a number's text; null for anything else."""
    number = F.trim(raw).try_cast("double")
    return F.when(number.isin(-1.0, 0.0, 1.0), number.cast("int"))


def _share(raw: Column) -> Column:
    number = F.trim(raw).try_cast("double")
    return F.when(number.between(0.0, 1.0), number)


def _json_value(text: Column, name: str, read: Callable[[Column], Column]) -> Column:
    """The first JSON object's value under a name in lower, title or upper case: the first of them that can be read."""
    objects = F.filter(F.regexp_extract_all(text, F.lit(JSON_OBJECT), F.lit(0)), lambda o: F.try_parse_json(o).isNotNull())
    first = F.get(objects, F.lit(0))
    return F.coalesce(*[read(F.get_json_object(first, f"$.{n}")) for n in (name.lower(), name.title(), name.upper())])


def _last_place(tail: Column, words: tuple[str, ...]) -> Column:
    """Where the last of any of the words begins, from 1; 0 where none stands."""
    places = [F.when(F.contains(tail, F.lit(w)), F.length(tail) - F.locate(w[::-1], F.reverse(tail)) - len(w) + 2).otherwise(0) for w in words]
    return F.greatest(*places)


def direction(text: Column) -> Column:
    """-1, 0, 1 or null: a strict line, a JSON key, a loose line (the last of each), then words of the reply's end."""
    tail = F.lower(F.substring(text, -TAIL_CHARS, TAIL_CHARS))
    up, down, flat = (_last_place(tail, w) for w in (UP_WORDS, DOWN_WORDS, FLAT_WORDS))
    best = F.greatest(up, down, flat)
    words = F.when(best == 0, None).when(best == up, 1).when(best == down, -1).otherwise(0)
    return F.coalesce(_whole(_last(text, DIRECTION)), _json_value(text, "direction", _whole), _whole(_last(text, DIRECTION_LOOSE)), words)


def confidence(text: Column) -> Column:
    """A share from 0 to 1 or null: a percentage, a strict line, a JSON key, a loose line (the last of each)."""
    percent = F.try_divide(_last(text, PERCENT).try_cast("double"), F.lit(100.0))
    return F.coalesce(F.when(percent <= 1.0, percent), _share(_last(text, CONFIDENCE)), _json_value(text, "confidence", _share), _share(_last(text, CONFIDENCE_LOOSE)))


# ---- strict JSON: duplicate keys and constants are refused, which Spark's reader does not

_fence = re.compile(r"\A\s*```(?:json)?[ \t]*\n(.*?)\n?```\s*\Z", re.DOTALL)


def strict_numbers(text: str | None) -> tuple[bool, str | None, dict[str, float] | None]:
    """(ok, failure code, values) of a reply that must be one JSON object of finite numbers, at most in one fence."""
    if text is None or not text.strip():
        return False, "empty", None
    found = _fence.match(text)
    body = found[1] if found else text
    duplicates: list[str] = []

    def unique(pairs: list[tuple[str, object]]) -> dict:
        seen = dict(pairs)
        if len(seen) < len(pairs):
            duplicates.append("key")
        return seen

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(body, object_pairs_hook=unique, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, "not_json", None
    if not isinstance(value, dict) or not value:
        return False, "not_object", None
    if duplicates:
        return False, "duplicate_key", None
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in value.values()):
        return False, "not_number", None
    return True, None, {k: float(x) for k, x in value.items()}


# a type object, since a type string can only be read within a session
_COMPONENTS = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("code", T.StringType()), T.StructField("components", T.MapType(T.StringType(), T.DoubleType()))])


@F.pandas_udf(_COMPONENTS)
def parse_components(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strict_numbers(t) for t in text], columns=["ok", "code", "components"])


# fixed values: the checks that a verdict on a rewrite must hold
CHECKS = ("claims", "entities", "dates", "quantities", "units", "uncertainty", "qualifications", "attribution", "instruction_injection")


#: The fields of a verdict, what each has to be, and what each has to be besides for the verdict to pass.
VERDICT = {
    "equivalent": (lambda x: isinstance(x, bool), bool),
    "checks": (lambda x: isinstance(x, dict) and sorted(x) == sorted(CHECKS) and {*map(type, x.values())} == {bool}, lambda x: all(x.values())),
    "discrepancies": (lambda x: isinstance(x, list) and all(isinstance(y, str) and y.strip() for y in x), lambda x: not x),
}


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key stands twice")
    return found


def strict_verdict(text: str | None) -> str:
    """passed, rejected or malformed: a verdict is one JSON object with the fields of VERDICT, no key twice, nothing else."""
    try:
        found = json.loads(text or "", object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return "malformed"
    if not isinstance(found, dict) or sorted(found) != sorted(VERDICT) or not all(sound(found[f]) for f, (sound, _) in VERDICT.items()):
        return "malformed"
    return "passed" if all(passes(found[f]) for f, (_, passes) in VERDICT.items()) else "rejected"


@F.pandas_udf(T.StringType())
def verdict(text: pd.Series) -> pd.Series:
    return text.map(strict_verdict)


def within_bounds(components: Column, bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether a map has exactly the declared components, each finite and inside its bounds."""
    names = F.array(*[F.lit(n) for n in sorted(bounds)])
    inside = F.lit(True)
    for name, (low, high) in bounds.items():
        inside = inside & F.coalesce(F.try_element_at(components, F.lit(name)).between(low, high), F.lit(False))
    return F.coalesce((F.array_sort(F.map_keys(components)) == names) & inside, F.lit(False))


def answer_status(text: Column, name: str) -> Column:
    """'answered', 'abstained' or 'invalid' of a one-field JSON answer."""
    body = F.trim(text)
    shape = body.rlike(r'^\{\s*"' + re.escape(name) + r'"\s*:\s*(null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*\}$')
    return F.when(~F.coalesce(shape, F.lit(False)), "invalid").when(body.rlike(r":\s*null\s*\}$"), "abstained").otherwise("answered")
