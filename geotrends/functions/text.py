"""Text functions for place names and period tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotrends.fixed_values import CANONICAL_STATES, DISTRICT_SUFFIX

# A blank that initcap sees, behind a control character. Where the text itself
# holds that character, another one is put behind it meanwhile.
_WORD, _MARK, _OWN = "\u0001 ", "\u0001", "\u0001\u0002"


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere.

    ``initcap`` only starts a word after a blank, so a marked blank is put
    before each word that follows something else, and taken out again.
    """
    marked = F.replace(F.lower(c), F.lit(_MARK), F.lit(_OWN))
    spread = F.regexp_replace(marked, r"(?<=[^\p{L} ])(?=\p{L})", _WORD)
    return F.replace(F.replace(F.initcap(spread), F.lit(_WORD), F.lit("")), F.lit(_OWN), F.lit(_MARK))


def canonical_state(c: Column) -> Column:
    """State name from a directory name, with the long names put in one form."""
    # Prefixes are compared in lower case, so only other names are title-cased.
    name = F.replace(title_case(c), F.lit("-"), F.lit(" "))
    for prefix, full in CANONICAL_STATES.items():
        name = F.when(F.lower(c).startswith(prefix.lower()), F.lit(full)).otherwise(name)
    return name


def clean_district(c: Column) -> Column:
    """District name without the word "District"."""
    return F.replace(title_case(c), F.lit(DISTRICT_SUFFIX), F.lit(""))


def clean_state_label(c: Column) -> Column:
    """State name from a country-level label, "&" spelt out."""
    spaced = F.replace(title_case(c), F.lit("-"), F.lit(" "))
    return F.replace(spaced, F.lit("&"), F.lit("and"))


def quarter_tag(c: Column) -> Column:
    """``Q`` and the first character of the file name."""
    return F.concat(F.lit("Q"), F.substring(c, 1, 1))


def place_year_label(place: Column, year: Column) -> Column:
    """``<place> - <year>``; null when either part is null."""
    return F.concat(place, F.lit(" - "), year.cast("string"))
