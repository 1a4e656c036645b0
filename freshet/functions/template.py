"""``{{ KEY }}`` templates over a map of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a placeholder.
PLACEHOLDER = r"\{\{\s*(\w+)\s*\}\}"


def placeholders(text: Column) -> Column:
    """All placeholder keys in order of appearance, repeats included."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))


def missing_placeholders(text: Column, values: Column) -> Column:
    """Keys without a (non-null) value, in order and with repeats."""
    return F.filter(placeholders(text), lambda k: F.try_element_at(values, k).isNull())


def render_template(text: Column, values: Column) -> Column:
    """The text with every placeholder replaced; null when any key is missing.

    Spacing variants are normalised first, so one literal ``replace`` per distinct key is enough
    and a ``$`` or backslash inside a value stays as it is. Keys are replaced in order of
    appearance, each over the text that the earlier ones produced.
    """
    compact = F.regexp_replace(text, PLACEHOLDER, "{{$1}}")
    rendered = F.aggregate(
        F.array_distinct(placeholders(text)),
        compact,
        lambda acc, k: F.replace(acc, F.concat(F.lit("{{"), k, F.lit("}}")), F.try_element_at(values, k)),
    )
    return F.when(F.size(missing_placeholders(text, values)) == 0, rendered)
