"""Text columns: patterns of the manuals, all of them expressions inside the JVM.

Patterns avoid look-around and back-references, so that they mean the same to Java and to RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the manuals.
ICODE = r"i\d{8}"
SMCS = r"SMCS Code:\s*([\d\-;,\s]+)"
STEP = r"^(\d+)\.\s*$|^(\d+)\.\s+\S"
TABLE_CAPTION = r"^Table\s+(\d+)"
ILLUSTRATION = r"^Illustration\s+(\d+)"
GRAPHIC = r"\b(g\d{8})\b"
PART_NUMBER = r"\b(\d{3}-\d{4}|\d[A-Z]-\d{4})\b"
MODEL = r"\b(3[59]\d{2}[BC])\b"
CONTROL_MODULE = r"\bADEM\s+(I{1,3}V?)\b"
# A line of a title page for one build, "PREFIX 1-UP (…)": with a model in the brackets, and with anything. Lines end with \n alone.
SERIAL_MODEL = r"(?md)^([A-Z0-9]{3})\s+1-UP\s+\((3\d{3}[A-Z])\)\s*$"
# Codes of publications and serial prefixes of the acceptance gate.
PUBLICATION = r"\b(?:SEBU|SENR|RENR|UENR|KENR|SEBF|REHS|SEHS|PEHP)\d{4}(?:-\d{2})?\b"
PREFIX_UP = r"\b([A-Z0-9]{3})\d?1?\s?-\s?[Uu][Pp]\b"
SERIAL_ANY = r"(?md)^([A-Z0-9]{3})\s+1-UP\s+\([^)]+\)\s*$"
PRODUCT_MODEL = r"\b(3\d{3}[A-Z]|C\d{1,2})\b"
SECTION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Section)\b"
MEASURE = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:kPa|psi|bar|°C|°F|N·?m|lb·?ft|lb·?in|kW|hp|rpm|L|mL|US gal|US qt|gal|qt|mm|cm|m\b|in(?:ch)?)\b"
CITED_PAGE = r"(?:стр\.|p\.)\s*(\d+)"


def generation(model: Column) -> Column:
    """What follows the leading digits of a model: 3512B -> B."""
    return F.regexp_replace(model, r"^[0-9]+", "")


def part_numbers(text: Column) -> Column:
    """Distinct part numbers, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PART_NUMBER), 1)))


def models(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MODEL), 1)))


def control_module(h2: Column, h1: Column) -> Column:
    """The control module, if exactly one is named: in the second-level headings, else in the first-level ones."""
    two = F.regexp_extract_all(F.coalesce(h2, F.lit("")), F.lit(CONTROL_MODULE), 1)
    one = F.regexp_extract_all(F.coalesce(h1, F.lit("")), F.lit(CONTROL_MODULE), 1)
    found = F.array_distinct(F.when(F.size(two) > 0, two).otherwise(one))
    return F.when(F.size(found) == 1, F.concat(F.lit("ADEM "), found[0]))


def smcs_codes(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(text, SMCS, 1), "[;,]"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def measurements(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MEASURE), 0)


def cited_pages(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITED_PAGE), 1), lambda p: p.cast("int"))


def publication_id(filename: Column, missing: str = "unknown source") -> Column:
    """A file's name without its ``.pdf``, in any case; a blank one is ``missing``."""
    stem = F.trim(F.regexp_replace(F.coalesce(filename, F.lit("")), r"(?i)\.pdf$", ""))
    return F.when(stem == "", F.lit(missing)).otherwise(stem)


def citation(start: Column, end: Column, one: str = "p. ", many: str = "pp. ") -> Column:
    """``p. 5`` or ``pp. 5–7``."""
    return F.when(start == end, F.concat(F.lit(one), start.cast("string"))).otherwise(F.concat(F.lit(many), start.cast("string"), F.lit("–"), end.cast("string")))


def cache_key(document: Column, content: Column, version: str = "1") -> Column:
    """Sixteen hexadecimal digits of the document, the content and the version of the prefix's format."""
    return F.substring(F.sha2(F.concat(document, F.lit("\n"), content, F.lit("\n" + version)), 256), 1, 16)


def language(text: Column) -> Column:
    """``ru`` if more than a tenth of the characters is Cyrillic, or the text is empty; else ``en``."""
    n = F.length(text)
    cyrillic = F.length(F.regexp_replace(text, r"[^\x{0400}-\x{04FF}]", ""))
    return F.when(n == 0, "ru").when(cyrillic / n > 0.1, "ru").otherwise("en")


#: What an answer that declines contains.
REFUSALS = ("не содержится в O&M Manual", "is not in the O&M Manual")


def declines(answer: Column, markers: tuple[str, ...] = REFUSALS) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | answer.contains(m)
    return out


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def block_text(lines: Column) -> Column:
    """The text of a layout block: spans end to end, lines with a space between, blanks collapsed, hyphenation undone."""
    joined = F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2"))


def heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"/\s+", "/"))


def tenths(x: Column) -> Column:
    """Rounding to one digit as of the binary value, ties to the even neighbour: 15.95 is stored as 15.9499... and gives 15.9.

    Ten times x is the sum of the exact products by eight and by two; what that sum loses decides where it seems a tie.
    """
    a, b = x * 8, x * 2
    s = a + b
    lost = b - (s - a)
    whole = F.when(s - F.floor(s) != 0.5, F.rint(s)).when(lost > 0, F.ceil(s)).when(lost < 0, F.floor(s)).otherwise(F.rint(s))
    return whole.cast("double") / 10


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clamp: float = 1e-9) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clamp)), F.lit(clamp))
    return F.ln(q / (1 - q))
