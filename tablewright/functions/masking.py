"""Typed masking of personal values. Output forms are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _default(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1)))
    )


def mask_value(c: Column, kind: str = "default") -> Column:
    """Mask an e-mail, phone, ssn or card number; other kinds keep the first and last letter.

    A value that does not have the form its kind asks for is masked by the default rule.
    """
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    last4 = F.right(digits, F.lit(4))
    if kind == "email":
        local = F.substring_index(c, "@", 1)
        n_local = F.length(local)
        hidden = F.when(n_local <= 2, F.concat(F.substring(local, 1, 1), F.lit("*"))).otherwise(
            F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n_local - 2), F.right(local, F.lit(1)))
        )
        domain = F.substring(c, n_local + 2, F.length(c))
        return F.when(c.contains("@"), F.concat(hidden, F.lit("@"), domain)).otherwise(_default(c))
    if kind == "phone":
        return F.when(n >= 10, F.concat(F.left(digits, F.lit(3)), F.lit("-***-"), last4)).otherwise(_default(c))
    if kind == "ssn":
        return F.when(n == 9, F.concat(F.lit("***-**-"), last4)).otherwise(_default(c))
    if kind == "card":
        return F.when(n >= 4, F.concat(F.lit("****-****-****-"), last4)).otherwise(_default(c))
    return _default(c)
