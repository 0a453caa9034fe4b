"""Scalar normalization as Column -> Column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace (the built-in ``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def collapse_whitespace(c: Column) -> Column:
    """One space for every run of whitespace, none at the ends."""
    # single spaces, which are most of the runs, stay and need not be replaced
    space = V.WHITESPACE_CLASS
    return F.btrim(F.regexp_replace(c, f" [{space}]+|[{space}&&[^ ]][{space}]*", " "))


def words(c: Column) -> Column:
    """Lower-cased word tokens, in order, with repeats."""
    between = V.WORD_PATTERN.replace("[", "[^", 1)  # cutting is cheaper than matching
    return F.array_remove(F.split(F.lower(c), between), "")


def normalize_text(c: Column) -> Column:
    """Titles and abstracts: stripped, blank becomes NULL."""
    return blank_to_null(strip(c))


def normalize_authors(c: Column) -> Column:
    """Stripped names without blanks; never NULL."""
    names = F.filter(F.transform(c, strip), lambda name: name != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def normalize_year(c: Column) -> Column:
    """A whole number inside the accepted range, else NULL; accepts INT or STRING input."""
    text = strip(c.cast("string"))
    year = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
    return F.when(year.between(V.MIN_YEAR, V.MAX_YEAR), year)


def normalize_doi(c: Column) -> Column:
    """DOI without one resolver prefix, case kept; NULL when the shape is wrong."""
    bare = F.regexp_replace(strip(c), V.DOI_PREFIX_PATTERN, "")
    return F.when(bare.rlike(V.DOI_PATTERN), bare)


def _url_parts(c: Column, group: int) -> Column:
    # tabs and line breaks inside a URL are ignored by URL parsers
    clean = F.translate(c, "\t\r\n", "")
    return F.regexp_extract(clean, r"^(?i)[a-z][a-z0-9+.\-]*://([^/?#]*)([^?#]*)", group)


def normalize_url(c: Column) -> Column:
    """The stripped URL if it is http(s) with a host, else NULL."""
    url = strip(c)
    host = _url_parts(url, 1)
    unbalanced = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    usable = F.translate(url, "\t\r\n", "").rlike("^(?i)https?://") & (host != "") & ~unbalanced
    return F.when(usable, url)


def url_key(c: Column) -> Column:
    """Host and path, lower-cased, for telling whether two URLs mean the same page."""
    host = _url_parts(c, 1)
    # parameters behind ';' in the last path segment are not part of the path
    path = F.regexp_replace(_url_parts(c, 2), r"^(.*/[^;/]*);[^/]*$", "$1")
    return F.when(host != "", F.lower(F.concat(host, F.rtrim(path, F.lit("/")))))


def content_hash(title: Column, first_author: Column, year: Column) -> Column:
    """SHA-256 of title, first author and year; NULL without title or year."""
    clean_title = collapse_whitespace(F.lower(title))
    author = F.coalesce(F.lower(strip(first_author)), F.lit(""))
    raw = F.concat_ws("|", clean_title, author, year.cast("string"))
    return F.when(blank_to_null(title).isNotNull() & year.isNotNull(), F.sha2(raw, 256))


def json_string(c: Column) -> Column:
    """``c`` as a JSON string literal, NULL for NULL."""
    wrapped = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def quoted(c: Column) -> Column:
    """Python-style ``repr`` of a string, as the prompts show section and title."""
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    mark = F.when(double, F.lit('"')).otherwise(F.lit("'"))
    hidden = r"[\p{C}\p{Z}&&[^ ]]"
    special = rf"[\\'\p{{C}}\p{{Z}}&&[^ ]]"

    def escape(ch: Column) -> Column:
        code = F.lower(F.hex(F.encode(ch, "UTF-32")))
        return (
            F.when(ch == "\\", F.lit("\\\\"))
            .when((ch == "'") & ~double, F.lit("\\'"))
            .when(ch == "\n", F.lit("\\n"))
            .when(ch == "\r", F.lit("\\r"))
            .when(ch == "\t", F.lit("\\t"))
            .when(~ch.rlike(f"^{hidden}$"), ch)
            .when(code < "00000100", F.concat(F.lit("\\x"), F.substring(code, 7, 2)))
            .when(code < "00010000", F.concat(F.lit("\\u"), F.substring(code, 5, 4)))
            .otherwise(F.concat(F.lit("\\U"), code))
        )

    escaped = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1)), escape), "")
    return F.concat(mark, F.when(c.rlike(special), escaped).otherwise(c), mark)


def _rounds_up() -> list[bool]:
    """For k = 0..100: does the double nearest (k + 0.5) / 100 print as (k + 1) / 100?"""
    return [f"{(k + 0.5) / 100:.2f}" == f"{(k + 1) / 100:.2f}" for k in range(101)]


def two_decimals(c: Column) -> Column:
    """A number in [-1, 1] printed with two decimals, rounding the exact binary value.

    The JVM's own formatter rounds the shortest decimal form instead, which differs
    for values such as 0.145 and for exact ties such as 0.125.
    """
    ups = F.array(*[F.lit(up) for up in _rounds_up()])
    x = F.abs(c)
    k = F.floor(x * 100).cast("int")
    below = (k - F.lit(0.5)) / 100
    above = (k + F.lit(0.5)) / 100
    drop = (k > 0) & ((x < below) | ((x == below) & ~F.get(ups, F.greatest(k - 1, F.lit(0)))))
    rise = (x > above) | ((x == above) & F.get(ups, k))
    cents = F.when(rise, k + 1).when(drop, k - 1).otherwise(k)
    digits = F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    return F.when(c < 0, F.concat(F.lit("-"), digits)).otherwise(digits)
