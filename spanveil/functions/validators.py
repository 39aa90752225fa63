"""Check-digit and range predicates over text columns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def alnum(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def digit_at(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1).cast("int")


def weighted(text: Column, weights: list[int]) -> Column:
    """Sum of digit times weight from the left."""
    return sum((digit_at(text, i) * w for i, w in enumerate(weights)), F.lit(0))


def when_digits(text: Column, n: int, verdict: Column) -> Column:
    """verdict where the text is n digits, else false."""
    return F.when(F.regexp_like(text, F.lit(f"^[0-9]{{{n}}}$")), verdict).otherwise(F.lit(False))


def luhn(value: Column) -> Column:
    """13 to 19 digits whose doubled-every-second sum from the right is a multiple of 10."""
    d = digits(value)
    figures = F.transform(F.split(F.reverse(d), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(figures, lambda x, i: F.when(i % 2 == 0, x).when(x < 5, 2 * x).otherwise(2 * x - 9)), F.lit(0), lambda a, x: a + x
    )
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def ssn(value: Column) -> Column:
    """Nine digits; area not 000, 666 or 900 and up; group and serial not zero."""
    d = digits(value)
    area = F.substring(d, 1, 3).cast("int")
    return when_digits(d, 9, ~area.isin(0, 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"))


def ipv4(value: Column) -> Column:
    """Not loopback, broadcast, link-local or 0.x."""
    parts = F.split(value, r"\.")
    first, second = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    return F.coalesce((F.size(parts) == 4) & ~first.isin(0, 127) & (value != "255.255.255.255") & ~((first == 169) & (second == 254)), F.lit(False))


def saudi_id(value: Column) -> Column:
    d = digits(value)
    return when_digits(d, 10, F.substring(d, 1, 1).isin("1", "2"))


def emirates_id(value: Column) -> Column:
    d = digits(value)
    return when_digits(d, 15, d.startswith("784"))


def german_tax_id(value: Column) -> Column:
    """Eleven digits, no leading zero; among the first ten some digit twice or more and none over three times."""
    d = digits(value)
    counts = [F.length(F.regexp_replace(F.substring(d, 1, 10), f"[^{k}]", "")) for k in range(10)]
    return when_digits(d, 11, (F.substring(d, 1, 1) != "0") & (F.greatest(*counts).between(2, 3)))


#: fixed values: the letter for a number's remainder by 23
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(eight: Column, letter: Column) -> Column:
    return F.substring(F.lit(DNI_LETTERS), (eight.cast("long") % 23).cast("int") + 1, F.lit(1)) == F.upper(letter)


def dni(value: Column) -> Column:
    v = F.replace(value, F.lit("-"), F.lit(""))
    return F.when(F.regexp_like(v, F.lit("^[0-9]{8}[A-Za-z]$")), _dni(F.substring(v, 1, 8), F.substring(v, 9, 1))).otherwise(F.lit(False))


def nie(value: Column) -> Column:
    v = F.upper(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(
        F.regexp_like(v, F.lit("^[XYZ][0-9]{7}[A-Z]$")), _dni(F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.substring(v, 2, 7)), F.substring(v, 9, 1))
    ).otherwise(F.lit(False))


def iban(value: Column, country: str, length: int) -> Column:
    """mod 97 = 1 after the first four characters move to the end and letters become 10 to 35."""
    v = alnum(value)
    moved = F.concat(F.substring(v, 5, length), F.substring(v, 1, 4))
    # nine digits at a time, as numbers of nine more digits than a remainder fit a long
    remainder = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda a, c: (a * F.when(F.regexp_like(c, F.lit("[0-9]")), F.lit(10)).otherwise(F.lit(100)) + F.conv(c, 36, 10).cast("long")) % 97,
    )
    return F.when((F.length(v) == length) & v.startswith(country), remainder == 1).otherwise(F.lit(False))


def nir(value: Column) -> Column:
    d = digits(value)
    return when_digits(d, 15, F.lit(97) - F.substring(d, 1, 13).cast("long") % 97 == F.substring(d, 14, 2).cast("long"))


def my_number(value: Column) -> Column:
    d = digits(value)
    rest = weighted(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return when_digits(d, 12, F.when(rest <= 1, 0).otherwise(11 - rest) == digit_at(d, 11))


def rrn(value: Column) -> Column:
    d = digits(value)
    return when_digits(d, 13, (11 - weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == digit_at(d, 12))


def cpf(value: Column) -> Column:
    d = digits(value)
    first = weighted(d, list(range(10, 1, -1))) * 10 % 11 % 10
    second = weighted(d, list(range(11, 1, -1))) * 10 % 11 % 10
    return when_digits(d, 11, (d != F.repeat(F.substring(d, 1, 1), 11)) & (first == digit_at(d, 9)) & (second == digit_at(d, 10)))


def cnpj(value: Column) -> Column:
    d = digits(value)

    def check(weights: list[int]) -> Column:
        rest = weighted(d, weights) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    tail = [9, 8, 7, 6, 5, 4, 3, 2]
    return when_digits(d, 14, (check([5, 4, 3, 2, *tail]) == digit_at(d, 12)) & (check([6, 5, 4, 3, 2, *tail]) == digit_at(d, 13)))


def citizen_id(value: Column) -> Column:
    v = alnum(value)
    total = weighted(v, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
    return F.when(F.regexp_like(v, F.lit("^[0-9]{17}[0-9X]$")), F.substring(F.lit("10X98765432"), (total % 11) + 1, F.lit(1)) == F.substring(v, 18, 1)).otherwise(F.lit(False))


def looks_like_json(value: Column) -> Column:
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    return (v.startswith("{") & v.endswith("}")) | (v.startswith("[") & v.endswith("]"))


def private_ip(value: Column) -> Column:
    """RFC 1918, loopback, link-local, 0.0.0.0, shared 100.64/10; IPv6 loopback, unspecified, unique-local and link-local."""
    parts = F.split(value, r"\.")
    a, b = F.try_to_number(F.get(parts, F.lit(0)), F.lit("999")).cast("int"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999")).cast("int")
    four = F.regexp_like(value, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    low = F.lower(value)
    return F.when(
        four, a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (value == "0.0.0.0")
    ).otherwise(low.isin("::", "::1") | F.regexp_like(low, F.lit("^f[cd]|^fe[89ab]")))


def image_type(head: Column) -> Column:
    """Media type by the first bytes, given in hex; null for others."""
    h = F.upper(head)
    return (
        F.when(h.startswith("89504E47"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("47494638"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


def audio_type(head: Column) -> Column:
    h = F.upper(head)
    mp3 = h.startswith("494433") | F.regexp_like(h, F.lit("^FF[EF]"))
    return (
        F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav").when(mp3, "mp3").when(h.startswith("4F676753"), "ogg").when(h.startswith("1A45DFA3"), "webm")
    )


VALIDATORS = {
    "luhn": luhn, "ssn": ssn, "ipv4": ipv4, "saudi_id": saudi_id, "emirates_id": emirates_id, "german_tax_id": german_tax_id, "dni": dni, "nie": nie,
    "iban_es": lambda v: iban(v, "ES", 24), "iban_de": lambda v: iban(v, "DE", 22), "iban_fr": lambda v: iban(v, "FR", 27),
    "nir": nir, "my_number": my_number, "rrn": rrn, "cpf": cpf, "cnpj": cnpj, "citizen_id": citizen_id,
}
