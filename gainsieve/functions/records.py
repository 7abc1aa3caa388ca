"""Label and feature extraction from JSON records of unknown layout.

A line is parsed once, into ``map<string, variant>``: the map keeps the key order of
the line and a variant keeps the JSON type of its value. Everything then works on
lambda variables, so no part of the line is parsed a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gainsieve.functions.text import text_to_long

# Keys that may hold the label, in order of precedence.
LABEL_KEYS = ["label", "Label", "class", "Class", "target", "Target", "avclass", "labels", "classes"]

# Keys that may hold the whole feature list, in order of precedence.
FEATURE_KEYS = ["features", "feature", "data", "vector"]

# Lower-cased keys that are never read as a feature.
LABEL_LIKE_KEYS = ["label", "class", "target", "avclass", "labels", "classes"]

# Label words of class 0.
NEGATIVE_WORDS = ["benign", "good", "safe"]

JSON_OPTIONS = {"allowSingleQuotes": "false"}

NUMBER_TYPE = r"^(BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\))$"
NUMBER_LIST_TYPE = r"^ARRAY<(BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\))>$"


# From this many loose values on, reading them together pays.
MANY_VALUES = 32


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def record_maps(line: Column) -> Column:
    """``line`` as an array of one map, empty when it is not exactly one JSON object.

    The line is read as the first element of a two-element array, so that text after
    the object makes it malformed.
    """
    both = F.from_json(
        F.concat(F.lit("["), line, F.lit(',{"":"end"}]')), "array<map<string,variant>>", JSON_OPTIONS
    )
    single = F.transform(
        F.array(both),
        lambda pair: F.when((F.size(pair) == 2) & F.map_contains_key(F.get(pair, F.lit(1)), ""), F.get(pair, F.lit(0))),
    )
    return F.filter(single, lambda record: record.isNotNull())


def record_entries(record: Column) -> Column:
    """Key-value pairs in line order; a repeated key keeps its first place and last value."""

    def last_values(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.transform(
            keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
        )

    repeated = F.size(F.array_distinct(F.map_keys(record))) < F.size(record)
    return F.when(repeated, last_values(F.map_entries(record))).otherwise(F.map_entries(record))


def _by_precedence(entries: Column, keys: list[str]) -> Column:
    """Values of those ``keys`` that occur, ordered as ``keys``."""

    def ordered(present: Column) -> Column:
        slots = F.transform(
            F.array(*[F.lit(k) for k in keys]),
            lambda k: F.get(F.filter(present, lambda e: e["key"] == k), F.lit(0)),
        )
        return F.transform(F.filter(slots, lambda e: e.isNotNull()), lambda e: e["value"])

    return _bound(F.filter(entries, lambda e: e["key"].isin(keys)), ordered)


def _label_value(value: Column, numeric_strings: bool) -> Column:
    """``struct(usable, label)`` of one candidate; an unusable one yields to the next key."""
    text = F.try_variant_get(value, "$", "string")
    word = F.when(F.lower(text).isin(NEGATIVE_WORDS), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    from_text = F.coalesce(text_to_long(text), word)
    if numeric_strings:
        from_text = F.coalesce(text_to_long(text), text.try_cast("double").try_cast("bigint"), word)

    def judged(kind: Column) -> Column:
        is_number = kind.rlike(NUMBER_TYPE) & ~F.isnan(F.try_variant_get(value, "$", "double"))
        return F.struct(
            ((kind == "STRING") | is_number).alias("usable"),
            F.when(kind == "STRING", from_text)
            .when(is_number, F.try_variant_get(value, "$", "bigint"))
            .alias("label"),
        )

    return _bound(F.schema_of_variant(value), judged)


def label_of(entries: Column, numeric_strings: bool = False) -> Column:
    """The label as ``bigint``, null when no key holds a usable one.

    Text that is not a whole number becomes 0 for a negative word and 1 otherwise, also
    ``"0.0"``; ``numeric_strings`` reads such text as the number it shows.
    """
    unwrapped = F.transform(
        _by_precedence(entries, LABEL_KEYS),
        lambda v: F.coalesce(
            F.try_variant_get(v, "$.label", "variant"), F.try_variant_get(v, "$.name", "variant"), v
        ),
    )
    usable = F.filter(
        F.transform(unwrapped, lambda v: _label_value(v, numeric_strings)), lambda c: c["usable"]
    )
    return F.get(usable, F.lit(0))["label"]


def _all_present(numbers: Column) -> Column:
    return F.forall(numbers, lambda x: x.isNotNull())


def _read_doubles(text: Column) -> Column:
    """A JSON list of numbers as doubles; null when some element is not one.

    Going through text is several times faster than casting a variant list, which
    builds a cast for every decimal.
    """
    return _bound(F.from_json(text, "array<double>"), lambda read: F.when(_all_present(read), read))


def _list_doubles(value: Column) -> Column:
    """A list as doubles, where texts and truth values may stand for numbers too."""
    return F.coalesce(_read_doubles(F.to_json(value)), F.try_variant_get(value, "$", "array<double>"))


def _numbers(value: Column) -> Column:
    """The numbers of one loose value: itself, or its elements if all are numbers."""
    nothing = F.array().cast("array<double>")

    def elements(kind: Column) -> Column:
        all_numbers = kind.rlike(NUMBER_LIST_TYPE) | (
            (kind == "ARRAY<VARIANT>")
            & F.forall(
                F.try_variant_get(value, "$", "array<variant>"),
                lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).rlike(NUMBER_TYPE),
            )
        )
        return _bound(
            F.when(all_numbers, _list_doubles(value)),
            lambda list_: F.when(_all_present(list_), list_).otherwise(nothing),
        )

    return _bound(
        F.schema_of_variant(value),
        lambda kind: F.when(kind.rlike(NUMBER_TYPE), F.array(F.try_variant_get(value, "$", "double")))
        .when(kind.startswith("ARRAY"), elements(kind))
        .otherwise(nothing),
    )


def _named_lists(entries: Column) -> Column:
    lists = F.transform(_by_precedence(entries, FEATURE_KEYS), _list_doubles)
    return F.filter(lists, lambda a: F.size(a) > 0)


def _loose_numbers(entries: Column) -> Column:
    """Every loose number in key order; at once when all values are plain numbers."""

    def numbers(values: Column) -> Column:
        at_once = _bound(
            F.when(F.size(values) >= MANY_VALUES, F.to_json(values)),
            lambda text: F.when(~text.contains('"'), _read_doubles(text)),
        )
        return F.coalesce(at_once, F.flatten(F.transform(values, _numbers)))

    feature_entries = F.filter(entries, lambda e: ~F.lower(e["key"]).isin(LABEL_LIKE_KEYS))
    return _bound(F.transform(feature_entries, lambda e: e["value"]), numbers)


def features_of(entries: Column) -> Column:
    """The feature vector as ``array<double>``, null when the record has none.

    The first non-empty list under a feature key, else every loose number in key order.
    A list with an element that is no number makes the record invalid.
    """
    found = _bound(
        _named_lists(entries),
        lambda lists: F.when(F.size(lists) > 0, F.get(lists, F.lit(0))).otherwise(_loose_numbers(entries)),
    )
    return _bound(
        found, lambda v: F.when((F.size(v) > 0) & _all_present(v), v)
    )


def extracted(line: Column, numeric_strings: bool = False, valid_only: bool = True) -> Column:
    """Array of at most one ``struct(label, features)``, for use with ``inline``.

    Dropping invalid records inside the array keeps the parse out of a ``where``, which
    the optimizer would push below the projection and so parse every line twice.
    """
    entries = F.transform(record_maps(line), record_entries)
    found = F.transform(
        entries,
        lambda e: F.struct(label_of(e, numeric_strings).alias("label"), features_of(e).alias("features")),
    )
    if not valid_only:
        return found
    return F.filter(found, lambda r: r["label"].isNotNull() & r["features"].isNotNull())
