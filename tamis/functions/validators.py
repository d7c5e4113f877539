"""Checksum and range tests of identifiers, as column expressions. Each takes a string column and gives a boolean."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Validator = Callable[[Column], Column]

# Fixed values of the published schemes.
IBAN_LENGTHS = {
    "GB": 22, "DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "IE": 22,
    "PT": 25, "AT": 20, "SE": 24, "NO": 15, "DK": 18, "FI": 18, "PL": 28, "LU": 20,
}
VIN_LETTERS, VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
EIN_PREFIXES = ((1, 6), (10, 16), (20, 27), (30, 48), (50, 68), (71, 77), (80, 88), (90, 95), (98, 99))
ITIN_GROUPS = ((50, 65), (70, 88), (90, 92), (94, 99))
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number(s: Column, start: int, length: int) -> Column:
    return F.substring(s, start, length).try_cast("bigint")


def _weighted(s: Column, weights: Sequence[int], start: int = 1) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + _number(s, start + i, 1) * w
    return total


def _within(n: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | n.between(low, high)
    return out


def _only(condition: Column, test: Column) -> Column:
    return F.coalesce(F.when(condition, test).otherwise(False), F.lit(False))


def _tidy(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", ""))


def luhn_check(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) >= 12, F.call_function("luhn_check", d))


def sin_check(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) == 9, F.call_function("luhn_check", d))


def npi_check(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) == 10, F.call_function("luhn_check", F.concat(F.lit("80840"), d)))


def iban_mod97(s: Column) -> Column:
    t = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(t, F.lit(5)), F.substring(t, 1, 4))
    country, known = F.substring(t, 1, 2), F.lit(True)
    for code, n in IBAN_LENGTHS.items():
        known = F.when(country == code, F.length(t) == n).otherwise(known)
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return _only(t.rlike(r"\A[0-9A-Z]{15,34}\z"), known & (rest == 1))


def aba_checksum(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) == 9, _weighted(d, (3, 7, 1) * 3) % 10 == 0)


def vin_check(s: Column) -> Column:
    t = _tidy(s)
    rest = _weighted(F.translate(t, VIN_LETTERS, VIN_VALUES), VIN_WEIGHTS) % 11
    return _only(t.rlike(r"\A[A-HJ-NPR-Z0-9]{17}\z"), F.substring(t, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string")))


def ssn_check(s: Column) -> Column:
    d = digits(s)
    area = _number(d, 1, 3)
    return _only(F.length(d) == 9, (area != 0) & (area != 666) & (area < 900) & (_number(d, 4, 2) != 0) & (_number(d, 6, 4) != 0))


def ein_prefix(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) == 9, _within(_number(d, 1, 2), EIN_PREFIXES))


def itin_check(s: Column) -> Column:
    d = digits(s)
    return _only((F.length(d) == 9) & d.startswith("9"), _within(_number(d, 4, 2), ITIN_GROUPS))


def nir_check(s: Column) -> Column:
    d = digits(s)
    return _only(F.length(d) == 15, F.lit(97) - _number(d, 1, 13) % 97 == _number(d, 14, 2))


def de_tax_check(s: Column) -> Column:
    d = digits(s)

    def step(product: Column, i: Column) -> Column:
        total = (F.substr(d, i, F.lit(1)).try_cast("int") + product) % 10
        return F.when(total == 0, F.lit(10)).otherwise(total) * 2 % 11

    product = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), step)
    return _only(F.length(d) == 11, (F.lit(11) - product) % 10 == _number(d, 11, 1))


def es_dni_check(s: Column) -> Column:
    t = F.upper(F.replace(_tidy(s), F.lit("-"), F.lit("")))
    at = (_number(t, 1, 8) % 23 + 1).cast("int")
    return _only(t.rlike(r"\A[0-9]{8}[A-Z]\z"), F.substr(F.lit(DNI_LETTERS), at, F.lit(1)) == F.substring(t, 9, 1))


def bsn_check(s: Column) -> Column:
    d = digits(s)
    return _only((F.length(d) == 9) & (d != "000000000"), _weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, -1)) % 11 == 0)


def dea_check(s: Column) -> Column:
    t = _tidy(s)
    return _only(t.rlike(r"\A[A-Z][A-Z9][0-9]{7}\z"), _weighted(t, (1, 2, 1, 2, 1, 2), 3) % 10 == _number(t, 9, 1))


VALIDATORS: dict[str, Validator] = {
    f.__name__: f
    for f in (luhn_check, iban_mod97, aba_checksum, vin_check, ssn_check, ein_prefix, npi_check, dea_check, itin_check, sin_check, nir_check, de_tax_check, es_dni_check, bsn_check)
}


def register_validator(name: str, validator: Validator) -> None:
    """Make `validator` known to rules under `name`."""
    VALIDATORS[name] = validator


def run(name: str, s: Column) -> Column:
    """The named test of `s`; a name that is not known never holds."""
    return VALIDATORS[name](s) if name in VALIDATORS else F.lit(False)
