"""What counts as a line and as an event in a trace file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that frame the events of a file.
FRAMING = ["", "[", "]", "{", "}", "]["]


def trimmed(line: Column) -> Column:
    """The line without blanks, tabs and line ends around it."""
    return F.regexp_replace(line, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")


def is_json_line(line: Column) -> Column:
    return F.coalesce(~trimmed(line).isin(FRAMING), F.lit(False))


def is_event_line(line: Column) -> Column:
    """A line that isn't framing and holds more than eight bytes."""
    return is_json_line(line) & (F.octet_length(trimmed(line)) > 8)


def without_comma(line: Column) -> Column:
    """The trimmed line without the comma that may follow its object."""
    return F.regexp_replace(trimmed(line), ",$", "")


_END = "tracelake-end"


def json_value(line: Column) -> Column:
    """The one JSON value that a line is (a comma may follow), as a VARIANT; NULL where it is none, or more than one value.

    The parser itself stops after a value and takes no notice of what follows, so the line is read as the first item
    of an array whose second one must be ours.
    """
    items = F.try_parse_json(F.concat(F.lit("["), without_comma(line), F.lit(f', "{_END}"]')))
    return F.when(F.try_variant_get(items, "$[1]", "string") == _END, F.try_variant_get(items, "$[0]", "variant"))
