"""Scalar text functions: normalisation, field extraction and format sniffing, as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Header markers and the patterns of the fields. The flags make case, blanks, digits and line ends those of Unicode.
HEADER_MARKERS = ("descripcion", "descripción", "item", "ítem", "cantidad", "precio", "unidad", "total", "concepto")
PROVIDER_PATTERNS = (r"(?iUd)(?:raz[oó]n\s+social|proveedor|empresa|emisor)\s*[:\-]\s*(.+)", r"(?iUd)(?:cotizaci[oó]n\s+de|oferta\s+de)\s+(.+)")
CURRENCY_PATTERN = r"(?iUd)\b(PEN|USD|EUR|S/\.?|US\$|\$)\b"
TOTAL_PATTERN = r"(?iUd)(?:total|importe\s+total|monto\s+total)\s*[:\-]?\s*([0-9][0-9.,]*)"
PAYMENT_PATTERN = r"(?iUd)(?:condiciones?\s+de\s+pago|forma\s+de\s+pago|pago)\s*[:\-]\s*(.+)"
#: The three shapes of an item line, tried in this order, and the groups of description, quantity, unit and price.
ITEM_PATTERNS = (
    (r"(?Ud)^\s*(.+?)\s{2,}(\d+[.,]?\d*)\s*([A-Za-z%/]+)?\s+(\d+[.,]\d{2})\s*$", (1, 2, 3, 4)),
    (r"(?Ud)^\s*(.+?)\s+(\d+[.,]?\d*)\s+([A-Za-z%/]+)\s+(\d+[.,]\d{2})\s*$", (1, 2, 3, 4)),
    (r"(?iUd)(.+?)\s+[x×]\s*(\d+[.,]?\d*)\s+(\d+[.,]\d{2})", (1, 2, None, 3)),
)
#: What of a text that normalisation keeps, and what it makes one blank of.
KEPT, BLANK_RUN = r"[^\w\s./-]", r"\s+"
#: The white space of Unicode, which is stripped.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What stands between the groups of a line's shape; no line has it.
_BETWEEN = "\x01\x02\x01"
_FIELDS = ("description", "quantity", "unit", "unit_price")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def nonblank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) != ""


def normalize_ascii(c: Column) -> Column:
    """The normal form of texts in ASCII, with built-in functions only."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return strip(F.regexp_replace(F.regexp_replace(low, KEPT, " "), BLANK_RUN, " "))


def normalize_text(value: str | None) -> str:
    """Compatibility decomposition without marks, lower case, other signs to single blanks."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", (value or "").strip().lower()) if not unicodedata.combining(x))
    return re.sub(BLANK_RUN, " ", re.sub(KEPT, " ", plain)).strip()


def _latin() -> tuple[str, str, str]:
    """Lower-case Latin code points that decompose to one code point, what each is, and the marks, which go."""
    one = {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c.lower() == c and len(plain) == 1:
            one[c] = plain
    return "".join(one), "".join(one.values()), "".join(map(chr, range(0x300, 0x370)))


_FROM, _TO, _MARKS = _latin()
_UPPER = "".join(c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.lower() in _FROM and len(c.lower()) == 1 and c.lower() != c)
_IS_ASCII = r"^\p{ASCII}*$"


def _is_ascii(c: Column) -> Column:
    return c.rlike(_IS_ASCII)


def _is_latin(c: Column) -> Column:
    return _is_ascii(F.translate(c, _FROM + _UPPER + _MARKS, ""))


def normalize_latin(c: Column) -> Column:
    """The normal form of texts of Latin letters and their marks, with built-in functions only."""
    plain = F.translate(F.lower(strip(c)), _FROM + _MARKS, _TO)
    return strip(F.regexp_replace(F.regexp_replace(plain, "(?U)" + KEPT, " "), "(?U)" + BLANK_RUN, " "))


@F.pandas_udf(StringType())
def _normalize_any(values: pd.Series) -> pd.Series:
    return values.map(normalize_text, na_action="ignore")


def normalize(c: Column) -> Column:
    """The normal form of any text: built in for ASCII and Latin letters, Arrow-batched for the rest, which alone goes to Python."""
    text = F.coalesce(c, F.lit(""))
    other = F.when(~_is_ascii(text), F.when(~_is_latin(text), text))
    return F.when(_is_ascii(text), normalize_ascii(text)).when(_is_latin(text), normalize_latin(text)).otherwise(_normalize_any(other))


def clean_text(c: Column) -> Column:
    without = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(" ")), r"[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(without, r"\n{3,}", "\n\n"))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group)


def currency(c: Column) -> Column:
    token = F.replace(F.upper(_first(c, CURRENCY_PATTERN)), F.lit("."), F.lit(""))
    return F.when(token.isin("S/", "S"), "PEN").when(token.isin("US$", "$"), "USD").otherwise(token)


def total(c: Column) -> Column:
    return _first(c, TOTAL_PATTERN)


def payment_terms(c: Column) -> Column:
    return F.substring(strip(_first(c, PAYMENT_PATTERN)), 1, 200)


def provider(text: Column, label: Column, file_name: Column) -> Column:
    named = [F.substring(F.nullif(F.btrim(_first(text, p), F.lit(" .-:\n\r\t")), F.lit("")), 1, 120) for p in PROVIDER_PATTERNS]
    bare = lambda x: strip(F.regexp_replace(x, r"(?iUd)\.pdf$", ""))
    base = bare(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?iUd)^cotizaci[oó]n[\s\-_]*", ""))
    return F.coalesce(*named, F.substring(F.nullif(base, F.lit("")), 1, 120), F.substring(F.nullif(bare(F.coalesce(file_name, F.lit(""))), F.lit("")), 1, 120), F.lit("Proveedor"))


def looks_like_header(line: Column) -> Column:
    low = F.lower(line)
    hits = F.lit(0)
    for m in HEADER_MARKERS:
        hits = hits + F.contains(low, F.lit(m)).cast("int")
    return hits >= 2


def _shape(line: Column, pattern: str, groups: tuple[int | None, ...]) -> Column:
    """The groups of a line that has the shape, in one evaluation of the pattern; null for another."""
    marked = _BETWEEN + _BETWEEN.join("" if g is None else f"${g}" for g in groups) + _BETWEEN
    parts = F.split(F.regexp_replace(line, pattern, marked), _BETWEEN, -1)
    return F.when(F.size(parts) > len(groups) + 1, parts)


def item_fields(line: Column) -> Column:
    """description, quantity, unit and unit_price of an item line; null where no shape fits."""
    # A lambda keeps the shapes out of generated code, which they would outgrow.
    line = strip(F.coalesce(line, F.lit("")))
    first = F.transform(F.array(line), lambda x: F.coalesce(*(_shape(x, p, g) for p, g in ITEM_PATTERNS)))
    named = F.transform(first, lambda x: F.when(x.isNotNull(), F.struct(*(strip(F.get(x, F.lit(i + 1))).alias(k) for i, k in enumerate(_FIELDS)))))
    return F.when((line != "") & ~looks_like_header(line), F.get(named, F.lit(0)))


def text_items(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Items of quotation texts: a row for each line that has the shape of one, named by the line's number."""
    lines = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R", -1)).alias("_n", "_line"))
    found = lines.select(*keys, F.concat(F.lit("item-"), (F.col("_n") + 1).cast("string")).alias("item_id"), item_fields(F.col("_line")).alias("_x"))
    return found.where("_x is not null").select(*keys, "item_id", "_x.*")


def sniff_format(content_type: Column, file_name: Column) -> Column:
    kind, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    has = lambda *xs: F.lit(False) if not xs else kind.rlike("|".join(map(re.escape, xs)))
    ends = lambda *xs: name.rlike("(" + "|".join(map(re.escape, xs)) + ")$")
    return (
        F.when(kind.startswith("text/") | has("text/plain"), "text").when(has("pdf"), "pdf").when(has("word"), "docx").when(has("sheet", "excel"), "xlsx").when(kind.startswith("image/"), "image")
        .when(ends(".pdf"), "pdf").when(ends(".docx", ".doc"), "docx").when(ends(".xlsx", ".xls"), "xlsx").when(ends(".png", ".jpg", ".jpeg", ".webp"), "image").when(ends(".txt"), "text").otherwise("pdf")
    )


def decode_data_url(c: Column) -> Column:
    """Bytes of a data URL (base64 or percent-encoded), else of base64, else the text's own; null where a data URL's base64 is bad."""
    head = F.substring_index(c, ",", 1)
    body = F.substr(c, F.length(head) + 2)
    percent = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))  # a plus sign is no blank in a data URL
    return F.when(c.startswith("data:") & F.contains(F.lower(head), F.lit(";base64")), F.try_to_binary(body, F.lit("base64"))).when(c.startswith("data:"), F.encode(F.coalesce(percent, body), "UTF-8")).otherwise(F.coalesce(F.try_to_binary(c, F.lit("base64")), F.encode(c, "UTF-8")))


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
