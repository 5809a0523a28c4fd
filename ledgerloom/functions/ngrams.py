"""Plain writing of typed entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they are without.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőŕřśšťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooooorrsstuuuuuuuyyzzz"


def plain(text: Column) -> Column:
    """Lower case without accents, digits that stand for letters put right, other signs as single blanks."""
    s = F.translate(F.lower(text), ACCENTED, PLAIN)
    s = F.replace(s, F.lit("ß"), F.lit("ss"))
    for digit, letter in (("0", "o"), ("1", "l"), ("5", "s")):
        s = F.regexp_replace(s, rf"(?<=[a-z]){digit}|{digit}(?=[a-z])", letter)
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
