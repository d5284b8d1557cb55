"""Column expressions over file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of detector, event and inventory names.
DETECTOR_PATTERN = r"(?i)^[A-Z]-([HLV]1)_"
EVENT_PATTERN = r"(?i)(GW\d{6,})"
INVENTORY_PATTERN = r"(?i)^.*([HLV]1).*?(\d+KHZ).*?-(\d+)\.hdf5$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def detector(path: Column) -> Column:
    """Detector from the anchored name prefix, upper case, else ``UNK``."""
    found = F.upper(F.regexp_extract(basename(path), DETECTOR_PATTERN, 1))
    return F.when(found == "", "UNK").otherwise(found)


def detector_loose(name: Column) -> Column:
    """Detector from any occurrence in the name, in the order H1, L1, V1."""
    return (
        F.when(name.contains("H1"), "H1").when(name.contains("L1"), "L1").when(name.contains("V1"), "V1").otherwise("UNK")
    )


def event_hint(path: Column) -> Column:
    """Event name inside a file name, upper case, else an empty text."""
    return F.upper(F.regexp_extract(basename(path), EVENT_PATTERN, 1))


def with_suffix(name: Column, old: str, new: str) -> Column:
    """Replace a trailing part of a name."""
    return F.regexp_replace(name, old.replace(".", r"\.") + "$", new)


def safe_name(name: Column) -> Column:
    """A name usable as a file name: anything but letters, digits, dot, dash and underscore becomes ``_``."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def template_key(m1: Column, m2: Column, s1: Column, s2: Column) -> Column:
    """Masses and spins with three digits, joined by dashes."""
    return F.format_string("%.3f-%.3f-%.3f-%.3f", m1, m2, s1, s2)


def inventory_parts(name: Column) -> list[Column]:
    """Detector, sample rate and duration of a strain file name; ``UNKNOWN`` without a match."""
    parts = []
    for group, alias in ((1, "detector"), (2, "rate"), (3, "duration")):
        text = F.upper(F.regexp_extract(name, INVENTORY_PATTERN, group))
        parts.append(F.when(text == "", "UNKNOWN").otherwise(text).alias(alias))
    return parts
