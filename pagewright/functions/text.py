"""String rules of the catalogue as Column expressions."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import lexicons as L

LETTERS, BASES = L.accent_table()
#: Word boundaries that take accented letters as letters.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def trim(x: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$", "")


def spell(x: Column, table: dict[str, str]) -> Column:
    """Each character of the table replaced; one translate() for single ones, and a replace for each longer one."""
    single = {a: b for a, b in table.items() if len(b) <= 1}
    if single:
        full = sorted(single, key=lambda a: not single[a])  # what is deleted comes last
        x = F.translate(x, "".join(full), "".join(single[a] for a in full))
    for a, b in table.items():
        if len(b) > 1:
            x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, LETTERS, BASES), r"[\x{300}-\x{36f}]", "")


def asciiize(x: Column) -> Column:
    return strip_accents(spell(x, L.TRANSLITERATION))


def normalize_section(x: Column) -> Column:
    """Key of a section label: transliterated, without accents, lower-cased, runs of other characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(asciiize(x)), "[^a-z0-9]+", " "))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(spell(x, L.SLUG_TRANSLITERATION))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def match_key(x: Column) -> Column:
    """Accents folded, letters and digits only."""
    return F.regexp_replace(strip_accents(F.lower(x)), "[^a-z0-9]+", "")


def bare_key(x: Column) -> Column:
    """Letters a-z and digits only: accented letters are lost."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def expand_abbreviations(x: Column) -> Column:
    for short, full in L.ABBREVIATIONS:
        x = F.regexp_replace(x, f"(?iu){BEFORE}{short}{AFTER}", full)
    return x


def humanize_key(x: Column, prefix: str = r"^\d{1,4}\s+") -> Column:
    """Column header as a printed key: separators to blanks, numeric prefix gone, abbreviations expanded, upper case and ' :'."""
    k = F.regexp_replace(F.regexp_replace(trim(x), r"[_\-]+", " "), prefix, "")
    k = trim(F.regexp_replace(expand_abbreviations(k), r"(?U)\s+", " "))
    return F.when(k == "", "").otherwise(F.concat(F.upper(k), F.lit(" :")))


def strip_quotes(x: Column) -> Column:
    out = x
    for a, b in reversed(L.QUOTES):
        out = F.when(x.startswith(a) & x.endswith(b) & (F.length(x) >= 2), trim(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(out)
    return out


def is_informative(x: Column) -> Column:
    """Whether a value says something, after closing punctuation is set aside."""
    bare = trim(F.regexp_replace(x, "[.,;:]+$", ""))
    words = "|".join([*map(re.escape, L.NON_INFORMATIVE), *L.NON_INFORMATIVE_PATTERNS])
    return (bare != "") & ~bare.rlike(f"(?iu)^({words})$")


def clean_value(x: Column) -> Column:
    """The trimmed value without quotes around it; null if it says nothing."""
    v = strip_quotes(trim(x))
    return F.when(is_informative(v) & (v != ""), v)


def split_values(x: Column) -> Column:
    """Values of a cell: split at line ends, spaced bars and spaced semicolons; those that say nothing go."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?U)\r?\n|\s+\|\s+|\s+;\s+")
    return F.filter(F.transform(parts, trim), lambda p: (p != "") & is_informative(p))


def has_key_value(x: Column) -> Column:
    return x.rlike(f"[{L.KEY_VALUE_SIGNS}]") | x.rlike(rf"(?U)\s[{L.KEY_VALUE_DASHES}]\s")


def split_key_value(x: Column) -> Column:
    """Struct of key, value and separator (null if there is none: the text is the key)."""
    sign, dash = rf"(?Us)^(.*?)(\s*[{L.KEY_VALUE_SIGNS}]\s*)(.*)$", rf"(?Us)^(.*?)\s([{L.KEY_VALUE_DASHES}])\s(.*)$"
    one_line = ~x.contains("\n")

    def parts(pattern: str) -> Column:
        return F.struct(trim(F.regexp_extract(x, pattern, 1)).alias("key"), trim(F.regexp_extract(x, pattern, 3)).alias("value"), trim(F.regexp_extract(x, pattern, 2)).alias("separator"))

    none = F.struct(x.alias("key"), F.lit("").alias("value"), F.lit(None).cast("string").alias("separator"))
    return F.when(one_line & x.rlike(sign), parts(sign)).when(one_line & x.rlike(dash), parts(dash)).otherwise(none)


def style_key(new: Column, template: Column) -> Column:
    """A key in the case and with the closing separator of a template key."""
    tail = rf"(?U)\s*(?:[{L.KEY_VALUE_SIGNS}]|[{L.KEY_VALUE_DASHES}])\s*$"
    bare = trim(F.regexp_replace(template, tail, ""))
    separator = F.when(template.rlike(tail), F.regexp_extract(template, f"({tail})".replace("((?U)", "(?U)("), 1)).otherwise(" :")
    clean = F.regexp_replace(trim(new), tail, "")
    upper, lower = bare.rlike("[A-ZÀ-ſ]"), bare.rlike("[a-zà-ſ]")
    return F.concat(F.when((bare != "") & upper & ~lower, F.upper(clean)).when((bare != "") & ~upper & lower, F.lower(clean)).otherwise(clean), separator)


def is_colour_code(x: Column) -> Column:
    return trim(x).rlike(f"(?i)^(?:{'|'.join(L.COLOUR_CODES)})$")


def is_common_colour(x: Column) -> Column:
    return F.coalesce(asciiize(F.lower(trim(x))).isin(L.COLOURS) | is_colour_code(x), F.lit(False))


def channel(colour: Column, i: int) -> Column:
    """Red, green or blue (i: 0, 1, 2) of #rrggbb."""
    return F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("int")


def text_colour_on(colour: Column) -> Column:
    """Black on light colours (channels sum to 700 or more), else the colour itself."""
    return F.when(channel(colour, 0) + channel(colour, 1) + channel(colour, 2) >= 700, "#000000").otherwise(colour)


def lighten(colour: Column, share: float) -> Column:
    """Mixed with white."""
    mixed = [F.lpad(F.lower(F.hex(F.floor(channel(colour, i) + (255 - channel(colour, i)) * share + 0.5).cast("long"))), 2, "0") for i in range(3)]
    return F.concat(F.lit("#"), *mixed)


def has_unit(x: Column) -> Column:
    """A number with a unit, or a currency before a number."""
    units = "|".join(map(re.escape, sorted(L.UNITS, key=len, reverse=True)))
    return x.rlike(rf"(?<=\d)\s*(?:{units})(?![A-Za-zÀ-ÿ])") | x.rlike(rf"(?:^|\s)(?:{'|'.join(map(re.escape, L.CURRENCIES))})\s*\d")


def looks_like_barcode(x: Column) -> Column:
    t = trim(x)
    bare = F.regexp_replace(t, r"(?U)\s", "")
    n = F.length(bare)
    letters, digits = F.regexp_count(bare, F.lit("[a-zA-ZÀ-ÿœŒæÆ]")), F.regexp_count(bare, F.lit("[0-9]"))
    return (
        F.when((F.length(t) < 3) | (n == 0), False)
        .when(bare.rlike("^[0-9]+$") & (n >= 5), True)
        .when((n <= 30) & ((letters + digits) / n >= 0.8), False)
        .when((n - letters - digits) / n > 0.3, True)
        .otherwise(letters / n < 0.5)
    )


def looks_like_legal_notice(x: Column) -> Column:
    t = trim(x)
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 1))
    return F.coalesce((t != "") & (t.rlike("[©®™]") | t.rlike(f"(?iu)^({L.LEGAL_OPENINGS})") | ((F.length(t) > 80) & (words >= 8))), F.lit(False))


def page_keyword(x: Column) -> Column:
    """Kind of a page by the phrases in its text: toc, glossaire or tech; null if none."""
    def kind_of(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, phrases in reversed(L.PAGE_KEYWORDS.items()):
            out = F.when(functools.reduce(operator.or_, (F.contains(low, F.lit(p)) for p in phrases)), kind).otherwise(out)
        return out

    # The folded text is bound once, and phrases are sought as plain text.
    return F.transform(F.array(F.lower(strip_accents(x))), kind_of)[0]


def text_width(x: Column, size: Column) -> Column:
    """Estimated width of a text: the sum of its characters' widths times the font size."""
    rest, total = F.length(x), F.lit(0.0)
    for pattern, width in L.WIDTHS:
        n = F.regexp_count(x, F.lit(pattern))
        total, rest = total + n * width, rest - n
    return (total + rest * L.OTHER_WIDTH) * size


def safe_text(x: Column) -> Column:
    return spell(x, L.GLYPHS)


def wrap_words(x: Column, width: float, size: float) -> Column:
    """Greedy wrap into lines of at most `width` points; a longer word is a line of its own. Each word is measured once."""
    words = F.filter(F.split(trim(x), r"(?U)\s+"), lambda w: w != "")
    measured = F.transform(words, lambda w: F.struct(w.alias("x"), text_width(w, F.lit(size)).alias("w")))
    blank = 0.3 * size
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"), F.lit(0.0).alias("w"))

    def step(a: Column, b: Column) -> Column:
        longer = a["w"] + blank + b["w"]
        fits = a["line"].isNotNull() & (longer <= width)
        return F.struct(
            F.when(fits | a["line"].isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))).alias("lines"),
            F.when(fits, F.concat(a["line"], F.lit(" "), b["x"])).otherwise(b["x"]).alias("line"),
            F.when(fits, longer).otherwise(b["w"]).alias("w"),
        )

    return F.aggregate(measured, empty, step, lambda a: F.when(a["line"].isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def spec_category(key: Column) -> Column:
    out = F.lit("AUTRES")
    for name, pattern in reversed(L.SPEC_CATEGORIES):
        out = F.when(trim(key).rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def name_tokens(x: Column) -> Column:
    """Words of a name that carry weight: three letters or more, no stop words; repeats stay."""
    return F.filter(F.split(normalize_section(F.coalesce(x, F.lit(""))), " "), lambda t: (F.length(t) >= 3) & ~t.isin(L.STOP_WORDS))


def url_basename(x: Column) -> Column:
    """Last path segment of a URL or path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(x, r"[?#].*$", ""), r"([^/\\]*)$", 1)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def retry_delay_ms(message: Column) -> Column:
    """Milliseconds that a quota message asks to wait ("retry in 1.5s"), five minutes at most; null if it asks for none."""
    seconds = F.nullif(F.regexp_extract(message, r"(?i)retry in\s+([0-9]+(?:\.[0-9]+)?)\s*s", 1), F.lit("")).cast("double")
    return F.when(seconds > 0, F.least(F.floor(seconds * 1000 + 0.5), F.lit(300_000))).cast("long")
