"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def joined_distinct(value: Name, separator: str = "; ") -> Column:
    """Aggregate: distinct values, sorted, in one string."""
    return F.array_join(F.sort_array(F.collect_set(_col(value))), separator)


def squish(text: Name) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"[ \t\n\x0B\f\r]+", " "))


def blank_to_null(text: Name) -> Column:
    return F.nullif(F.trim(_col(text)), F.lit(""))


def first_present(*texts: Name) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def missing_to_null(text: Name) -> Column:
    """The spellings of a missing value as null."""
    return F.when(~F.upper(F.trim(_col(text))).isin("NA", "N/A", ""), _col(text))


def truthy(value: Name) -> Column:
    return F.coalesce(F.lower(F.trim(_col(value).cast("string"))).isin("true", "1", "yes"), F.lit(False))


#: Latin letters with marks and their base letters, for comparisons without a Python hop.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def normalize_for_match(text: Name) -> Column:
    """Lower-cased base letters and digits, '&' as 'and', everything else as one space."""
    t = F.translate(_col(text), ACCENTED, PLAIN)
    t = F.regexp_replace(F.lower(t), "&", " and ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def normalize_for_duplicate(text: Name) -> Column:
    return squish(F.lower(_col(text)))


def place_key(text: Name) -> Column:
    """Comparison key of place names: only u-umlaut loses its mark."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_col(text)), "ü", "u"), "[^a-z0-9]+", " "))


def first_year(text: Name) -> Column:
    """The first year of the 19th or 20th century, or null."""
    return F.nullif(F.regexp_extract(_col(text), "((?:18|19)[0-9][0-9])", 1), F.lit("")).cast("int")


def year_bounds(text: Name) -> tuple[Column, Column]:
    """The smallest and the largest four-digit year of the 19th or 20th century."""
    years = F.transform(F.regexp_extract_all(_col(text), F.lit("((?:18|19)[0-9][0-9])"), 1), lambda y: y.cast("int"))
    return F.array_min(years), F.array_max(years)


def expand_years(text: Name) -> Column:
    """'1880-1882' and '1880-82' as all their years, with the century rolled over where the
    end would come before the start; a single year as itself; anything else as none."""
    t = F.translate(F.trim(_col(text)), "–—", "--")
    start = F.nullif(F.regexp_extract(t, "^([0-9]{4})", 1), F.lit("")).cast("int")
    long = F.nullif(F.regexp_extract(t, "^[0-9]{4} *[-/] *([0-9]{4})$", 1), F.lit("")).cast("int")
    short = F.nullif(F.regexp_extract(t, "^[0-9]{4} *[-/] *([0-9]{2})$", 1), F.lit("")).cast("int")
    century = F.floor(start / 100).cast("int") * 100
    rolled = F.when(century + short < start, century + 100 + short).otherwise(century + short)
    end = F.coalesce(long, rolled, F.when(t.rlike("^[0-9]{4}$"), start))
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def decade_label(year: Name, given: Name | None = None) -> Column:
    """'1850s'; a given label with a decade in it, or one that ends in s, goes first."""
    own = F.when(_col(year).isNotNull(), F.concat((F.floor(_col(year) / 10) * 10).cast("int").cast("string"), F.lit("s")))
    if given is None:
        return own
    g = F.trim(_col(given))
    found = F.nullif(F.regexp_extract(g, "((?:18|19)[0-9]0)", 1), F.lit(""))
    return F.when(found.isNotNull(), F.concat(found, F.lit("s"))).when(g.endswith("s"), g).otherwise(own)


def split_subjects(text: Name, empty: str | None = None) -> Column:
    """Parts between | or ; without blanks and 'unknown'; `empty` alone if there are none."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\||;"), lambda p: F.trim(p)), lambda p: (p != "") & (F.lower(p) != "unknown"))
    return parts if empty is None else F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(empty)))


#: Subjects that are one although they hold a separator.
PROTECTED_SUBJECTS = (
    "associations and institutions",
    "far eastern languages",
    "fine arts",
    "literature and language",
    "political economy",
    "political science",
    "religion of china",
    "science in general",
    "social customs",
)


def subject_parts(text: Name) -> Column:
    """A catalogue subject as its ordered, distinct single subjects; ['unknown'] if none."""
    t = squish(F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), "–—", "--"))
    u = F.regexp_replace(F.regexp_replace(t, r" *, *(?:and|or|&) +", ", "), r" *; *(?:and|or|&) +", "; ")
    parts = F.transform(F.split(u, r" *, *| *; *| *: *| +- +| +and +| *& *"), lambda p: F.trim(F.regexp_replace(p, r"^(?:(?:and|or)(?![a-z0-9_]) *|& *)", "")))
    parts = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return F.when(t == "", F.array(F.lit("unknown"))).when(t.isin(*PROTECTED_SUBJECTS), F.array(t)).when(F.size(parts) == 0, F.array(F.lit("unknown"))).otherwise(parts)


def normalize_author(name: Name) -> Column:
    """White space, translator notes and the blanks around '-', apostrophes and ',' tidied."""
    t = squish(name)
    t = F.regexp_replace(t, r"(?i)^(?:trans\.|translated by) *", "")
    t = F.regexp_replace(F.regexp_replace(t, r" *- *", "-"), r" *' *", "'")
    return F.trim(F.regexp_replace(t, r" *, *", ", "))


def excerpt(text: Name, n: int = 200) -> Column:
    return F.substring(squish(text), 1, n)


def safe_file_name(text: Name) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def min_max(value: Name, over) -> Column:
    """Scaled to 0..1 over the window; all equal: 1 if positive, else 0; null as 0."""
    x = F.coalesce(_col(value).cast("double"), F.lit(0.0))
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((x - low) / (high - low))


def file_name_parts(name: Name) -> Column:
    """struct<volume_label, year_hint, first_year, last_year, suffix> of a file's name: a roman
    numeral or 'v_' number, 'UNKNOWN' without one; the years of the 19th and 20th century in
    it; what follows a prefix of year and number."""
    stem = F.regexp_replace(_col(name), r"\.[A-Za-z0-9]+$", "")
    roman = F.upper(F.nullif(F.regexp_extract(stem, "(?i)_(I{1,3}V?|VI{0,3}|IX|X{1,3}|XL|L)(?:_|$)", 1), F.lit("")))
    number = F.nullif(F.regexp_extract(stem, "(?i)v_([0-9]+)", 1), F.lit(""))
    years = F.transform(F.regexp_extract_all(_col(name), F.lit("((?:18|19)[0-9][0-9])"), 1), lambda y: y.cast("int"))
    low, high = F.array_min(years), F.array_max(years)
    hint = F.when(low.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))
    rest = F.regexp_replace(stem, "(?i)^(?:[A-Z]+_)?(?:18|19)[0-9]{2}(?:-(?:18|19)[0-9]{2})?_[0-9]+_?", "")
    rest = F.regexp_replace(rest, "(?i)^(?:18|19)[0-9]{2}(?:-(?:18|19)[0-9]{2})?_[0-9]+_?", "")
    return F.struct(F.coalesce(roman, number, F.lit("UNKNOWN")).alias("volume_label"), hint.alias("year_hint"), low.alias("first_year"), high.alias("last_year"), F.btrim(rest, F.lit("_ -")).alias("suffix"))


def csv_cells(line: Name, width: int) -> Column:
    """The cells of a CSV line by hand: quotes anywhere, doubled ones inside; a short line gets
    empty cells, a long one's surplus is joined into the last; NA and N/A are null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), _col(line)), F.lit(',((?:[^",]|"(?:[^"]|"")*(?:"|$))*)'), 1)
    cells = F.transform(raw, lambda c: F.replace(F.regexp_replace(c, '"((?:[^"]|"")*)(?:"|$)', "$1"), F.lit('""'), F.lit('"')))
    full = F.concat(F.slice(cells, 1, width - 1), F.array(F.array_join(F.slice(cells, F.lit(width), F.greatest(F.size(cells) - (width - 1), F.lit(0))), ",")))
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.lit(width) - F.size(cells)))
    return F.transform(F.when(F.size(cells) >= width, full).otherwise(padded), lambda c: F.when(~c.isin("NA", "N/A"), c))
