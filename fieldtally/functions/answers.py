"""Text answers: tokens for missing values, multi-selects, free text, code groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally import domains as D


def quoted(values: Iterable[str]) -> str:
    """Texts as SQL literals, for lists too long to hand over one by one."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def text_list(values: Iterable[str]) -> Column:
    return F.expr(f"array({quoted(values)})")


def trimmed(text: Column) -> Column:
    """Without blanks, tabs and line ends at either end."""
    return F.btrim(text, F.lit(" \t\r\n"))


def null_token(text: Column) -> Column:
    """NULL and the empty text become ``null``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(D.NULL_TOKEN))


def blank_token(text: Column) -> Column:
    """The empty text becomes ``null``; NULL stays."""
    return F.when(text == "", F.lit(D.NULL_TOKEN)).otherwise(text)


def list_text(items: Column) -> Column:
    """An array as comma-separated text, missing elements shown as ``NA``."""
    return F.array_join(items, ",", "NA")


def multiselect_text(items: Column) -> Column:
    """An array of chosen codes as text; no choice is ``null``."""
    chosen = items.isNotNull() & (F.size(items) > 0)
    return F.when(chosen, F.array_join(items, ",")).otherwise(F.lit(D.NULL_TOKEN))


def multiselect_json_text(text: Column) -> Column:
    """As `multiselect_text`, for an answer that is plain text or a JSON array of codes."""
    listed = F.ltrim(text).startswith("[")
    codes = F.from_json(F.when(listed, text), "array<string>")
    plain = F.coalesce(text, F.lit(D.NULL_TOKEN))
    return F.when(listed, multiselect_text(codes)).otherwise(plain)


def codes_in(text: Column) -> Column:
    """Every run of digits in a multi-select answer, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def strip_zeros(code: Column) -> Column:
    return F.ltrim(code, F.lit("0"))


def province_group(code: Column, zeros: bool = True) -> Column:
    """Marine or Inland by province code; a missing code is Inland."""
    bare = strip_zeros(code) if zeros else code
    return F.when(bare.isin(*D.MARINE_CODES), F.lit(D.MARINE)).otherwise(F.lit(D.INLAND))


def group_order(group: Column) -> Column:
    return F.when(group == D.MARINE, 0).when(group == D.INLAND, 1)


def facility_words(text: Column) -> Column:
    """Free text as lower-case words; ``_``, ``-`` and blanks part them."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[_\-\s]+", " ")), " ")


def has_facility(text: Column, facility: str) -> Column:
    named = F.arrays_overlap(facility_words(text), text_list(D.FACILITIES[facility]))
    return F.coalesce(named, F.lit(False))


def facilities_in(text: Column) -> Column:
    """The set of facility types named in a free text, each at most once."""
    named = [F.when(has_facility(text, f), F.lit(f)) for f in D.FACILITIES]
    return F.array_compact(F.array(*named))


def recode(code: Column, labels: Mapping[str, str]) -> Column:
    """Code to label by a fixed map; a code that is not in it is NULL."""
    label = F.lit(None).cast("string")
    for known, text in labels.items():
        label = F.when(code == known, F.lit(text)).otherwise(label)
    return label


def position_in(value: Column, ordered: tuple[str, ...]) -> Column:
    """1-based place of a value in an ordered list, NULL where it is not in it."""
    return F.nullif(F.array_position(text_list(ordered), value), F.lit(0).cast("long"))
