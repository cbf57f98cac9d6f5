"""Text functions as Column expressions (survey F01-F23, in part)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters they count as.
ACCENTED = "áàâäãåÁÀÂÄÃÅéèêëÉÈÊËíìîïÍÌÎÏóòôöõÓÒÔÖÕúùûüÚÙÛÜñÑçÇ"
PLAIN = "aaaaaaAAAAAAeeeeEEEEiiiiIIIIoooooOOOOOuuuuUUUUnNcC"

# Departments, and those that are counted within another.
DEPARTMENTS = ("Cocina", "Bar", "Comedor", "Almacén central", "Recepción", "Pisos", "Mantenimiento", "Lavandería", "General")
REGROUPED = {"Almacén central": "Pisos", "Lavandería": "Pisos"}
UNASSIGNED = "Sin asignar"

# Sales channels in order, each with the text that an agency's name must hold.
CHANNELS = (("Directos", "directo"), ("Booking", "booking"), ("Expedia", "expedia"), ("Jet2", "jet2"), ("Sidetours", "sidetours"))

# Words of company names that don't tell companies apart.
LEGAL_FORMS = ("sl", "sa", "slu", "sau", "cb", "scp", "sc", "ltd", "limited", "bv", "gmbh", "ag", "sll", "s", "l", "a", "u", "y", "de", "del", "la", "el")

# Words by which a language is guessed, in order of preference on ties.
STOP_WORDS = {
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "para", "con", "por", "es", "del", "cómo", "qué", "necesito", "quiero"),
    "pt": ("o", "os", "as", "de", "que", "e", "em", "um", "uma", "para", "com", "por", "é", "do", "da", "não", "você", "preciso"),
    "en": ("the", "a", "an", "of", "and", "to", "in", "for", "with", "is", "i", "my", "how", "what", "can", "you"),
}
WORD_LETTERS = "a-záéíóúñãõçê"

# Patterns of what is redacted, and what stands in its place.
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,4})?\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"


def strip_accents(c: Column) -> Column:
    """letters without marks, lower case, trimmed."""
    return F.trim(F.lower(F.translate(c, ACCENTED, PLAIN)))


def compact_key(c: Column) -> Column:
    """only a-z and 0-9 of the unaccented text."""
    return F.regexp_replace(strip_accents(c), "[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """upper case, no marks but for the N with tilde, letters and digits only."""
    kept = F.translate(c, ACCENTED.replace("ñ", "").replace("Ñ", ""), PLAIN.replace("nN", ""))
    return F.regexp_replace(F.upper(kept), "[^A-Z0-9Ñ]", "")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def department(c: Column) -> Column:
    """canonical department; unknown names capitalised, blanks unassigned, some counted within others."""
    key = strip_accents(c)
    canonical = F.create_map(*(x for d in DEPARTMENTS for x in (strip_accents(F.lit(d)), F.lit(REGROUPED.get(d, d)))))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(UNASSIGNED)).otherwise(F.coalesce(F.try_element_at(canonical, key), capitalised(F.trim(c))))


def channel(c: Column) -> Column:
    """The first channel whose text the agency's name holds, else null."""
    key = strip_accents(F.coalesce(c, F.lit("")))
    return reduce(lambda out, rule: out.when(key.contains(rule[1]), F.lit(rule[0])), CHANNELS[1:], F.when(key.contains(CHANNELS[0][1]), F.lit(CHANNELS[0][0])))


def company_tokens(c: Column) -> Column:
    """the significant words of a company's name as a sorted set."""
    words = F.split(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", " "), " +")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*LEGAL_FORMS))))


def squeeze(c: Column) -> Column:
    """white space runs as one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def split_code(c: Column) -> Column:
    """(code, name) at the first " - "; a text without it is all name."""
    at = F.instr(c, " - ")
    return F.when(at > 0, F.struct(F.trim(F.left(c, at - 1)).alias("code"), F.trim(F.substr(c, at + 3)).alias("name"))).otherwise(
        F.struct(F.lit("").alias("code"), F.trim(c).alias("name"))
    )


def clean(c: Column, limit: int) -> Column:
    """squeezed and cut; blank becomes null."""
    return F.nullif(F.left(squeeze(c), F.lit(limit)), F.lit(""))


def invoice_key(c: Column) -> Column:
    """letters and digits of an invoice number, upper case, 100 at most."""
    return F.left(F.regexp_replace(F.upper(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)), "[^0-9A-Z]", ""), F.lit(100))


def function_name(c: Column) -> Column:
    """letters, digits and underscores, 64 at most."""
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), F.lit(64))


def redact(c: Column) -> Column:
    """IBANs, cards that pass the Luhn check, then e-mail addresses."""
    text = F.regexp_replace(c, IBAN, "[IBAN]")
    cards = F.array_distinct(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)))
    valid = F.filter(cards, lambda x: F.call_function("luhn_check", F.regexp_replace(x, "[^0-9]", "")))
    text = F.aggregate(valid, text, lambda acc, x: F.replace(acc, x, F.lit("[TARJETA]")))
    return F.regexp_replace(text, EMAIL, "[EMAIL]")


def language(c: Column) -> Column:
    """F16: the language with most stop words, "?" without any; ties in the table's order."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD_LETTERS}]+")
    hits = lambda stop: F.size(F.filter(words, lambda w: w.isin(*stop)))
    counts = {k: hits(stop) for k, stop in STOP_WORDS.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, F.lit("?"))
    for k, n in counts.items():
        out = out.when(n == best, F.lit(k))
    return out


def spanish_amount(c: Column) -> Column:
    """1.234,56."""
    return F.translate(F.format_number(c.cast("decimal(20,2)"), 2), ",.", ".,")


def evidence_line(text: Column, needle: Column) -> Column:
    """the first line that holds the printed form."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(needle))
    return F.trim(F.try_element_at(lines, F.lit(1)))


def euro_figures(c: Column) -> Column:
    """Amounts printed with a euro sign."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9][0-9.]*,[0-9]{2}) ?€"), F.lit(1))


def invented_figures(answer: Column, results: Column) -> Column:
    """amounts of an answer that no result holds."""
    return F.array_except(euro_figures(answer), euro_figures(results))


def lines_with_prefix(c: Column, rules: dict[str, str], default: str) -> Column:
    """the class of the first prefix that a concept begins with."""
    out = None
    for prefix, name in rules.items():
        hit = F.upper(c).startswith(prefix)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))
