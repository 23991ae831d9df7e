"""Masks of personal data as native expressions, so filters pass them and nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times(char: str, n: Column) -> Column:
    return F.repeat(F.lit(char), F.when(n > 0, n).when(n <= 0, 0).cast("int"))


def full(value: Column, char: str = "*", length: int = 10, keep_null: bool = False) -> Column:
    """The same mask for every value, null included unless keep_null."""
    mask = F.lit(char * length)
    return F.when(value.isNotNull(), mask) if keep_null else mask


def email(value: Column, char: str = "*") -> Column:
    """Masks the inside of the part before the first @; without one, or empty, the value stays."""
    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    size = at - 1
    inner = F.concat(F.substring(local, 1, 1), _times(char, size - 2), F.right(local, F.lit(1)))
    return F.when(at == 0, value).otherwise(F.concat(F.when(size <= 2, _times(char, size)).otherwise(inner), F.substring(value, at, F.length(value))))


def card(value: Column, visible: int = 4, char: str = "*") -> Column:
    """All but the last digits, in groups of four; shorter numbers as a whole. visible 0 hides all."""
    plain = F.regexp_replace(value, "[ -]", "")
    size = F.length(plain)
    tail = F.right(plain, F.lit(visible)) if visible else F.lit("")
    masked = F.regexp_replace(F.concat(_times(char, size - visible), tail), "(.{4})(?=.)", "$1 ")
    return F.when(F.length(value) == 0, value).when(size < visible, _times(char, size)).otherwise(masked)


def phone(value: Column, char: str = "*") -> Column:
    """Keeps the area code of ten digits, and the country digit of eleven; else masks all digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    rest = F.lit(f"{char * 3}-{char * 4}")
    ten = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), rest)
    eleven = F.concat(F.lit("+"), F.substring(digits, 1, 1), F.lit(" ("), F.substring(digits, 2, 3), F.lit(") "), rest)
    return F.when(F.length(value) == 0, value).when(size == 10, ten).when(size == 11, eleven).otherwise(_times(char, F.length(value)))


def partial(value: Column, start: int = 0, end: int = 0, char: str = "*") -> Column:
    """Keeps so many characters at the start and at the end; values no longer than that stay."""
    size = F.length(value)
    tail = F.right(value, F.lit(end)) if end else F.lit("")
    return F.when(size <= start + end, value).otherwise(F.concat(F.substring(value, 1, start), _times(char, size - start - end), tail))


def hashed(value: Column, algorithm: str = "sha256", salt: str = "") -> Column:
    """Hash of the value as text with the salt behind it; null stays null."""
    text = F.concat(value.cast("string"), F.lit(salt)) if salt else value.cast("string")
    if algorithm == "sha256":
        return F.sha2(text, 256)
    if algorithm == "md5":
        return F.md5(text)
    raise ValueError(f"hash {algorithm!r}: sha256 or md5")


def redacted(value: Column, text: str = "[REDACTED]") -> Column:
    return F.lit(text)


def template(value: Column, pattern: str) -> Column:
    """A pattern such as XXX-XX-$4: $n stands for the last n characters."""
    head, mark, n = pattern.partition("$")
    return F.when(value.isNotNull(), F.concat(F.lit(head), F.right(value, F.lit(int(n)))) if mark else F.lit(head))


def format_preserving(value: Column, key: str = "") -> Column:
    """Digits become digits, letters letters of the same case, by a keyed hash of value and place;
    all else stays. The same value and key give the same mask."""

    def swap(c: Column, i: Column) -> Column:
        draw = lambda n: F.pmod(F.xxhash64(F.lit(key), value, i), F.lit(n)).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), draw(len(letters)) + 1, F.lit(1))
        lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
        return F.when(c.rlike("^[a-z]$"), pick(lower)).when(c.rlike("^[A-Z]$"), pick(upper)).when(c.rlike("^[0-9]$"), pick(digits)).otherwise(c)

    return F.when(value.isNotNull(), F.array_join(F.transform(F.split(value, ""), swap), ""))


def encrypted(value: Column, key: str) -> Column:
    """AES-GCM of the value as text, in base64; the key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(F.encode(value.cast("string"), "utf-8"), F.lit(key)))


def decrypted(value: Column, key: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(value), F.lit(key)), "utf-8")
