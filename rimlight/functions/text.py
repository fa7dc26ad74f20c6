"""Normalizers and parsers of recognized text, as column functions without UDFs.

Character classes are ASCII throughout, as the readings are; other letters stay, or drop where only ASCII counts.
Missing text is '' and never null: every function turns null into ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = r"[\x20\x09-\x0D]+"
UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# What recognition confuses. Letters become upper-case, then O and Q are 0, I and L are 1, S is 5.
CONFUSED_FROM = "abcdefghijklmnopqrstuvwxyzOQILS"
CONFUSED_TO = "ABCDEFGH1JK1MN0P0R5TUVWXYZ00115"
# The patterns of a size, of a full DOT code and of a week and year at the end of a text's digits.
SIZE = r"(^|[^0-9])([1-3][0-9]{2})\s*[/\\]?\s*([2-9][0-9])\s*([RZ]?)\s*([1-2][0-9])(?:\s*([A-Z]))?([^0-9A-Z]|$)"
DOT = r"DOT([A-Z0-9]{4,24})"
WEEK_YEAR = r"([0-9]{4})[^0-9]*$"
WIDTHS, ASPECTS, RIMS, WEEKS = (125, 395), (20, 95), (10, 24), (1, 53)
# The looser patterns of the batch tools.
LOOSE_SIZE = r"\b([1-3][0-9]{2})\s*[/\\ ]\s*([2-9][0-9])\s*([RZ]?)\s*([1-2][0-9])\b"
LOOSE_FULL = r"\b([1-3][0-9]{2})\s*[/\\ ]\s*([2-9][0-9])\s*([RZ]?)\s*([1-2][0-9])(?:\s*[- ]?\s*([0-9]{2,3}\s*[A-Z]))?\b"
LOOSE_DOT = r"\bDOT\b[\s:-]*([A-Z0-9 ]{3,24})"
LOOSE_WEEK_YEAR = r"\b([0-5][0-9])([0-9]{2})\b"
EXTENSIONS = ("JPG", "JPEG", "PNG", "BMP", "TIFF", "TIF")


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(blank(c), ASCII_SPACE, " "))


def squeeze_unicode(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), UNICODE_SPACE, " "))


def sanitize(c: Column) -> Column:
    """Upper-case with the confused letters as digits, squeezed."""
    return squeeze(F.translate(blank(c), CONFUSED_FROM, CONFUSED_TO))


def key(c: Column) -> Column:
    """The form in which readings are compared: ASCII letters and digits, upper-case."""
    return F.upper(F.regexp_replace(blank(c), "[^A-Za-z0-9]", ""))


def safe_stem(c: Column, default: str = "frame") -> Column:
    """A file stem: other characters than letters, digits, _ and - as _."""
    s = F.regexp_replace(blank(c), "[^A-Za-z0-9_-]", "_")
    return F.when(s == "", default).otherwise(s)


def display_stem(c: Column) -> Column:
    """A file stem that keeps letters and digits of any script."""
    return F.regexp_replace(blank(c), r"[^\p{L}\p{N}]", "_")


def week_ok(c: Column) -> Column:
    """Whether four digits start with a week of the year."""
    return (F.length(c) == 4) & F.coalesce(F.substring(c, 1, 2).try_cast("int").between(*WEEKS), F.lit(False))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is bound to a lambda's variable and so computed once, however often f looks at it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse_size(c: Column) -> Column:
    """struct(found, raw, normalized, quality); only the first match counts, in range or not."""
    match = F.regexp_extract(sanitize(c), SIZE, 0)

    def made(m: Column, raw: Column) -> Column:
        # all groups from one match: width, aspect, construction, rim, speed
        return once(F.split(F.regexp_replace(m, SIZE, "$2|$3|$4|$5|$6"), r"\|", -1), lambda p: read(p, F.contains(m, F.lit("/")), raw))

    def read(p: Column, slash: Column, raw: Column) -> Column:
        width, aspect, letter, rim, speed = (F.element_at(p, i) for i in range(1, 6))
        ok = F.coalesce(width.try_cast("int").between(*WIDTHS) & aspect.try_cast("int").between(*ASPECTS) & rim.try_cast("int").between(*RIMS), F.lit(False))
        text = F.concat(width, F.lit("/"), aspect, F.lit(" "), F.when(letter == "", "R").otherwise(letter), rim, F.when(speed == "", "").otherwise(F.concat(F.lit(" "), speed)))
        quality = F.least(F.lit(1.0), F.when(slash, 1.0).otherwise(0.88) + F.when(speed == "", 0.0).otherwise(0.03))
        return F.when(ok, F.struct(F.lit(True).alias("found"), squeeze(raw).alias("raw"), text.alias("normalized"), quality.alias("quality"))).otherwise(none)

    none = F.struct(F.lit(False).alias("found"), F.lit("").alias("raw"), F.lit("").alias("normalized"), F.lit(0.0).alias("quality"))
    return once(F.struct(match.alias("m"), blank(c).alias("raw")), lambda x: F.when(x["m"] == "", none).otherwise(made(x["m"], x["raw"])))


def parse_dot(c: Column) -> Column:
    """struct(found, raw, normalized, full, full_raw, full_normalized, week_year_found, week_year, quality).

    The code comes from the plain text, the week and year from the sanitized one; either makes it found.
    """

    def read(x: Column) -> Column:
        body, digits = x["body"], x["digits"]
        named, dated = body != "", week_ok(digits)
        full = F.length(body) >= 8
        code, wy = F.concat(F.lit("DOT"), body), F.when(dated, digits).otherwise("")
        quality = F.when(full & dated, 1.0).when(dated, 0.82).when(named, 0.55).otherwise(0.0)
        return F.struct(
            (named | dated).alias("found"), x["raw"].alias("raw"), F.when(named, code).otherwise(wy).alias("normalized"), full.alias("full"),
            F.when(named, F.concat(F.lit("DOT "), body)).otherwise("").alias("full_raw"), F.when(named, code).otherwise("").alias("full_normalized"),
            dated.alias("week_year_found"), wy.alias("week_year"), quality.alias("quality"),
        )

    body, digits = F.regexp_extract(key(c), DOT, 1), F.regexp_extract(key(sanitize(c)), WEEK_YEAR, 1)
    return once(F.struct(body.alias("body"), digits.alias("digits"), squeeze(c).alias("raw")), read)


def _loose(text: Column, i: int, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, i)


def extract_size(c: Column, zr: bool = True) -> Column:
    """struct(base, full) by the batch tools' pattern; zr: ZR counts as R."""
    s = F.replace(F.upper(blank(c)), F.lit("I5"), F.lit("15"))
    s = squeeze_unicode(F.replace(s, F.lit("ZR"), F.lit("R")) if zr else s)

    def normal(pattern: str) -> Column:
        letter = _loose(s, 3, pattern)
        return F.concat(_loose(s, 1, pattern), F.lit("/"), _loose(s, 2, pattern), F.lit(" "), F.when(letter == "", "R").otherwise(letter), _loose(s, 4, pattern))

    base = F.when(_loose(s, 0, LOOSE_SIZE) == "", "").otherwise(normal(LOOSE_SIZE))
    suffix = squeeze_unicode(F.replace(_loose(s, 5, LOOSE_FULL), F.lit("-"), F.lit(" ")))
    full = F.when(_loose(s, 0, LOOSE_FULL) == "", base).otherwise(F.concat(normal(LOOSE_FULL), F.when(suffix == "", "").otherwise(F.concat(F.lit(" "), suffix))))
    return F.struct(base.alias("base"), full.alias("full"))


def extract_dot(c: Column) -> Column:
    """struct(text, week_year) by the batch tools' patterns; only the first four-digit token counts."""
    s = squeeze_unicode(F.upper(blank(c)))
    body, first = _loose(s, 1, LOOSE_DOT), _loose(s, 0, LOOSE_WEEK_YEAR)
    return F.struct(F.when(_loose(s, 0, LOOSE_DOT) == "", "").otherwise(F.concat(F.lit("DOT "), squeeze_unicode(body))).alias("text"), F.when(week_ok(first), first).otherwise("").alias("week_year"))


def path_key(c: Column) -> Column:
    """A path for look-ups: / for \\, no empty or . steps, no step that a .. takes back, lower-case."""
    steps = F.filter(F.split(F.replace(blank(c), F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(steps, empty, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.when(F.trim(blank(c)) == "", "").otherwise(F.lower(F.concat(F.lit("/"), F.array_join(kept, "/"))))


def file_name(c: Column) -> Column:
    return F.regexp_extract(blank(c), r"([^/\\]*)$", 1)


def number_key(c: Column) -> Column:
    """The number behind 'image', 'image-' or 'image(' in a file's name."""
    return F.regexp_extract(F.lower(file_name(c)), r"image[-(]?([0-9]+)", 1)


def is_image(c: Column) -> Column:
    """Whether a path ends in a supported extension, in any case."""
    return key(F.regexp_extract(blank(c), r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS)


def to_wsl(c: Column) -> Column:
    """C:\\x as /mnt/c/x."""
    p = F.replace(blank(c), F.lit("\\"), F.lit("/"))
    return F.when(p.rlike("^[A-Za-z]:"), F.concat(F.lit("/mnt/"), F.lower(F.substring(p, 1, 1)), F.substring(p, 3, 1 << 20))).otherwise(p)


def from_wsl(c: Column) -> Column:
    """/mnt/c/x as C:\\x."""
    p = blank(c)
    tail = F.replace(F.substring(p, 7, 1 << 20), F.lit("/"), F.lit("\\"))
    return F.when(p.startswith("/mnt/") & (F.length(p) > 6), F.concat(F.upper(F.substring(p, 6, 1)), F.lit(":"), tail)).otherwise(p)


def step_name(c: Column) -> Column:
    """A file's name without its last extension, or blank."""
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def step_label(c: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def run_id(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss_SSS")


def shell_quote(c: Column) -> Column:
    """In single quotes, with inner ones as '"'"'."""
    return F.concat(F.lit("'"), F.replace(blank(c), F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def size_confidence(ocr: Column, quality: Column, image: Column, geometry: Column) -> Column:
    return clamp01(0.45 * ocr + 0.30 * quality + 0.15 * image + 0.10 * geometry)


def dot_confidence(ocr: Column, dot: Column, image: Column, geometry: Column) -> Column:
    complete = F.when(dot["week_year_found"] & ~dot["full"], F.greatest(dot["quality"], F.lit(0.72))).otherwise(dot["quality"])
    return clamp01(0.42 * ocr + 0.33 * complete + 0.15 * image + 0.10 * geometry)
