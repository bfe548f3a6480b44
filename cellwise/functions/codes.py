"""Code normalisation, roll-up and vintage rules for category and place codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit codes that are published as combined sectors.
COMBINED_SECTORS = {
    "31-33": ("31", "32", "33"),
    "44-45": ("44", "45"),
    "48-49": ("48", "49"),
}

# Classification vintage in force per source, as (first year, vintage).
VINTAGES = {
    "BDS": ((2010, "2017"),),
    "QCEW": ((2010, "2007"), (2011, "2012"), (2017, "2017"), (2022, "2022")),
    "CBP": ((2010, "2007"), (2012, "2012"), (2017, "2017")),
}
TARGET_VINTAGE = "2022"
STUDY_YEARS = (2010, 2023)

# Place type names.
PLACE_TYPES = {
    "Metropolitan Statistical Area": "MSA",
    "Micropolitan Statistical Area": "MICROPOLITAN",
}


def normalize_code(code: Column, width: int) -> Column:
    """Trim and left-pad with zeros; longer codes stay whole."""
    text = F.trim(code)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def place_code(state: Column, county: Column) -> Column:
    return F.concat(normalize_code(state, 2), normalize_code(county, 3))


def sector_of(code: Column) -> Column:
    prefix = F.substring(code, 1, 2)
    result = prefix
    for combined, members in COMBINED_SECTORS.items():
        result = F.when(prefix.isin(*members), F.lit(combined)).otherwise(result)
    return result


def code_level(code: Column) -> Column:
    return F.when(code.contains("-"), F.lit(2)).otherwise(F.length(code))


def is_valid_code(code: Column) -> Column:
    """Two to six digits, or an increasing range of two-digit codes."""
    low = F.substring(code, 1, 2).try_cast("int")
    high = F.substring(code, 4, 2).try_cast("int")
    return code.rlike("^[0-9]{2,6}$") | (code.rlike("^[0-9]{2}-[0-9]{2}$") & (low < high))


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, "T$", ""))


def title_note(title: Column) -> Column:
    return F.when(title.endswith("T"), F.lit("Title carried a marker."))


def code_notes(change: Column, note: Column) -> Column:
    """Change indicator and title note in one text, NULL if neither is present."""
    changed = F.when(F.coalesce(F.trim(change), F.lit("")) != "", F.concat(F.lit("Change indicator: "), F.trim(change), F.lit(".")))
    return F.when(changed.isNotNull() | note.isNotNull(), F.concat_ws(" ", changed, note))


def vintage_of(source: Column, year: Column, first_year: int = STUDY_YEARS[0], last_year: int = STUDY_YEARS[1]) -> Column:
    """Classification vintage; an unknown source or a year outside the window is an error."""
    chain = None
    for name, spans in VINTAGES.items():
        for start, vintage in reversed(spans):
            test = (source == name) & (year >= start) & year.between(first_year, last_year)
            chain = F.when(test, vintage) if chain is None else chain.when(test, vintage)
    return chain.otherwise(
        F.raise_error(F.concat(F.lit("No vintage for "), source, F.lit(" "), year.cast("string")))
    )


def mapping_requirement(vintage: Column) -> Column:
    return F.when(vintage == TARGET_VINTAGE, "none").otherwise("official_concordance_audit")


def place_type(label: Column) -> Column:
    chain = None
    for name, short in PLACE_TYPES.items():
        chain = F.when(label == name, short) if chain is None else chain.when(label == name, short)
    return chain.otherwise(F.raise_error(F.concat(F.lit("Unsupported place type: "), label)))


def row_identifier(tag: str, columns: Sequence[str]) -> Column:
    """``tag|name=value|...``, the stable identity of a source row."""
    parts = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns
    ]
    return F.concat_ws("|", F.lit(tag), *parts)


def hash_bucket(code: Column, buckets: int = 10_000) -> Column:
    """Version-independent bucket from the leading 32 bits of SHA-256."""
    head = F.conv(F.substring(F.sha2(code, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")
