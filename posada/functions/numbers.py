"""Number functions as Column expressions (survey F30-F39, F46-F51).

Amounts are decimals throughout. Where a quotient is needed the product comes first and
the division is made once from a wide type. ``bround`` rounds half to even, ``round`` half
up; each function says which it takes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


# Decimals of a currency's least unit.
MINOR_UNITS = {
    0: ("CLP", "JPY", "KRW", "ISK"),
    2: (
        "EUR", "USD", "GBP", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "RON", "BGN", "CAD", "AUD", "NZD", "MXN", "BRL", "ARS",
        "COP", "PEN", "UYU", "MAD", "TRY", "CNY", "HKD", "SGD", "INR", "ZAR", "AED", "SAR", "ILS",
    ),
    3: ("KWD", "BHD", "OMR", "JOD", "TND"),
}
KNOWN_CURRENCIES = tuple(c for codes in MINOR_UNITS.values() for c in codes)
# Other ways to write currencies and countries.
CURRENCY_ALIASES = {
    "€": "EUR", "EURO": "EUR", "EUROS": "EUR", "EUR.": "EUR", "£": "GBP", "LIBRAS": "GBP", "US$": "USD", "USD$": "USD",
    "DOLARES": "USD", "DÓLARES": "USD", "¥": "JPY", "CHF.": "CHF",
}
COUNTRY_ALIASES = {
    "ESPAÑA": "ES", "ESPANA": "ES", "SPAIN": "ES", "FRANCIA": "FR", "FRANCE": "FR", "PORTUGAL": "PT", "ALEMANIA": "DE", "GERMANY": "DE",
    "ITALIA": "IT", "ITALY": "IT", "REINO UNIDO": "GB", "UNITED KINGDOM": "GB", "IRLANDA": "IE", "IRELAND": "IE",
    "PAISES BAJOS": "NL", "NETHERLANDS": "NL",
}


def money(c: Column, precision: int = 24) -> Column:
    return c.cast(f"decimal({precision},2)")


def zero_if_null(c: Column) -> Column:
    """A51."""
    return F.coalesce(c, F.lit(Decimal("0.00")))


def parse_spanish(c: Column) -> Column:
    """dots are thousands only if there is a comma; rounded half to even; null if blank or not a number."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s€]", "")
    plain = F.when(text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    return F.bround(plain.try_cast("decimal(20,6)"), 2).cast("decimal(18,2)")


def parse_payroll(c: Column) -> Column:
    """dots always go, the comma is the decimal sign, no rounding."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")


def parse_amount(c: Column) -> Column:
    """F32: a tolerant reading of printed amounts; null rather than a guess.

    Currency signs and words go, letters that remain make it null; parentheses, a leading or a
    trailing minus negate; of dot and comma the last one is the decimal sign, a sign that
    stands several times is a thousands sign; amounts from 1e11 are null.
    """
    raw = F.trim(c)
    bare = F.regexp_replace(raw, r"(?i)[€$£¥]|\b(?:eur|euros?|usd|gbp|chf|jpy)\b", "")
    digits = F.regexp_replace(F.regexp_replace(bare, r"[^0-9,.\-()]", ""), r"^[()]+|[()]+$", "")
    negative = raw.rlike(r"^\(.*\)$") | digits.endswith("-") | F.regexp_replace(digits, "-$", "").startswith("-")
    body = F.regexp_replace(F.regexp_replace(digits, "-$", ""), "^-", "")
    commas, dots = F.length(body) - F.length(F.replace(body, F.lit(","), F.lit(""))), F.length(body) - F.length(F.replace(body, F.lit("."), F.lit("")))
    no = lambda x, s: F.replace(x, F.lit(s), F.lit(""))
    last_comma = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(last_comma, F.replace(no(body, "."), F.lit(","), F.lit("."))).otherwise(no(body, ",")))
        .when(commas > 1, no(body, ",")).when(dots > 1, no(body, ".")).otherwise(F.replace(body, F.lit(","), F.lit(".")))
    )
    value = plain.try_cast("decimal(24,6)")
    good = ~bare.rlike(r"\p{L}") & body.rlike(r"^[0-9.,]*[0-9][0-9.,]*$") & (value < Decimal("100000000000"))
    return F.when(good, F.when(negative, -value).otherwise(value))


def round_half_up(c: Column, places: int = 2) -> Column:
    """F34."""
    return F.round(c, places)


def percentage_of(amount: Column, rate: Column) -> Column:
    """amount * rate / 100, half up to the cent."""
    return F.round(amount * rate / F.lit(100), 2)


def vat_split(total: Column, rate: Column) -> Column:
    """(base, quota) of a gross total; the base is rounded half up, the quota is the rest."""
    base = F.round(total.cast("decimal(18,6)") * 100 / (100 + rate), 2).cast("decimal(18,2)")
    return F.struct(base.alias("base"), (total - base).cast("decimal(18,2)").alias("quota"))


def net_of_vat(c: Column, rate_percent: int) -> Column:
    """unrounded net amount of a gross one."""
    return c.cast("decimal(28,12)") * 100 / F.lit(100 + rate_percent)


def base_of_quota(c: Column, rate_percent: int) -> Column:
    """the base that a VAT quota belongs to."""
    return c.cast("decimal(28,12)") * 100 / F.lit(rate_percent)


def percent(part: Column, total: Column) -> Column:
    """null if the total is zero."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


def year_on_year(now: Column, before: Column) -> Column:
    """change in percent of the absolute base, one decimal, half to even; null without a base."""
    change = (now - before).cast("decimal(28,8)") * 100
    return F.bround(F.try_divide(change, F.abs(before).cast("decimal(24,2)")).cast("decimal(28,6)"), 1).cast("decimal(20,1)")


def parse_int(c: Column) -> Column:
    """an integer by way of a number; null if it is none."""
    return F.trim(c).try_cast("double").cast("long")


def side_of_balance(c: Column) -> Column:
    """F47."""
    return F.when(c > 0, F.lit("deudor")).when(c < 0, F.lit("acreedor")).otherwise(F.lit("saldado"))


def currency(c: Column) -> Column:
    """ISO code of a currency, else null."""
    return _alias(c, CURRENCY_ALIASES, "^[A-Z]{3}$")


def country(c: Column) -> Column:
    """ISO code of a country, else null."""
    return _alias(c, COUNTRY_ALIASES, "^[A-Z]{2}$")


def _alias(c: Column, table: dict[str, str], shape: str) -> Column:
    raw = F.upper(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    out = F.coalesce(F.try_element_at(known, raw), raw)
    return F.when(out.rlike(shape), out)


def unit(currency_code: Column) -> Column:
    """the currency's least unit; two decimals for codes that aren't listed."""
    return (
        F.when(currency_code.isin(*MINOR_UNITS[0]), F.lit(Decimal("1.000")))
        .when(currency_code.isin(*MINOR_UNITS[3]), F.lit(Decimal("0.001"))).otherwise(F.lit(Decimal("0.010")))
    )


def snap_rate(base: Column, quota: Column, step: str = "0.5", most: int = 30) -> Column:
    """the rate, a multiple of ``step`` up to ``most``, that gives the quota to the cent; the nearest, else null."""
    count = int(Decimal(most) / Decimal(step))
    rates = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda k: (k * F.lit(Decimal(step))).cast("decimal(6,2)"))
    exact = F.filter(rates, lambda r: F.round(base * r / 100, 2) == F.round(quota, 2))
    errors = F.transform(exact, lambda r: F.struct(F.abs(base * r / 100 - quota).alias("error"), r.alias("rate")))
    return F.array_min(errors)["rate"]


def fit(c: Column, digits: int, places: int) -> Column:
    """null where the value has no room in decimal(digits, places)."""
    return F.when(F.abs(c) < F.lit(Decimal(10) ** (digits - places)), F.round(c, places))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """prices are per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000)


def token_estimate(c: Column) -> Column:
    """F72."""
    return F.floor(F.length(c) / 3) + 1
