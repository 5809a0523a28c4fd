"""What an entry or a sentence says about currency and scale of amounts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ngrams import plain

#: further names and signs of listed currencies.
EXTRA_FORMS = {
    "USD": ["US$", "us", "U.S. dollars", "American dollars"], "EUR": ["eurocent"], "GBP": ["pence", "penny", "British pounds", "sterling"], "CHF": ["Rappen", "SFr.", "centimes suisses"], "CAD": ["CA$", "C$", "Can$"],
    "AUD": ["A$", "AU$"], "INR": ["Rs", "Rs.", "paise", "paisa"], "SEK": ["öre"], "NOK": ["øre"], "PLN": ["grosz", "groszy"], "BRL": ["real"], "MXN": ["MX$"], "KWD": ["fils", "K.D."],
}
#: signs and words that several currencies share, besides symbols listed more than once.
SHARED_WORDS = ("cent", "cents", "dollar", "krone", "kr", "kr.", "franc", "peso", "centavos", "øre/öre")
#: words of scale.
THOUSAND_WORDS = r"\btsd\b\.?|\bthousands?\b|\btausend\b|\bmilliers?\b|\bmille\b|\(?'?\b000s?\)?|\b1[,.]?000\b"
MINOR_WORDS = r"\bcents?\b|\bpence\b|\bpenny\b|\beurocents?\b|\brappen\b|\bpais[ae]\b|(?<!\p{L})[öø]re(?!\p{L})|\bgrosz(?:y|e)?\b|\bfils\b|\bcentavos?\b|\bcentimes?\b|\bminor units?\b"
#: sentences that settle the scale, in the order they are tried.
MAJOR_TEXT = r"(?:full|whole) (?:currency )?units|vollen (?:währungs)?einheiten|unités entières|not in cents|not 1/100"
THOUSAND_TEXT = r"\b(?:in|of|en|x) (?:'000|1[,.]?000\b|thousands?|tausend|milliers)|\bin tsd\b|\btausend\b"
MINOR_TEXT = r"minor units?|smallest unit|in cents|\bin pence|1/100|hundertstel|en centimes"
#: openings of sentences that name the currency of a page.
CURRENCY_OPENINGS = r"(?:amounts?(?: are)?(?: (?:quoted|shown|given|stated))? in|(?:all )?prices(?: are)? in|rechnungswährung:?|settlement currency is|payable in|montants(?: exprimés)? en|beträge in|angaben in|currency:|devise ?:|währung:)"
TOTAL_OPENINGS = r"(?:grand )?total(?: ttc)?|summe|gesamt(?:betrag)?|montant total|amount due"
AMOUNT = r"-?\d[\d.,'  ]*"


def quoted(forms: list[str]) -> str:
    """Alternation of literal texts, the longest first."""
    return "|".join(r"\Q" + f + r"\E" for f in sorted(set(forms), key=lambda x: (-len(x), x)))


class Currencies:
    """The listed currencies, on the driver: a parameter table of fixed size."""

    def __init__(self, table: DataFrame):
        rows = table.select("code", "label", "symbol", "local_names", "minor_digits", "usd_per_unit").collect()
        self.digits = {r["code"]: int(r["minor_digits"]) for r in rows}
        self.rate = {r["code"]: float(r["usd_per_unit"]) for r in rows}
        self.codes = sorted(self.digits)
        names: dict[str, set[str]] = {}
        for r in rows:
            for form in (r["code"], r["label"], r["symbol"], *(r["local_names"] or []), *EXTRA_FORMS.get(r["code"], [])):
                if form:
                    names.setdefault(form.lower(), set()).add(r["code"])
        self.shared = {f for f, codes in names.items() if len(codes) > 1} | set(SHARED_WORDS)
        #: Lower-case form -> code, without the shared ones.
        self.forms = {f: next(iter(codes)) for f, codes in names.items() if f not in self.shared}

    def table(self, spark) -> DataFrame:
        """The forms in plain writing."""
        rows = spark.createDataFrame([(f, c) for f, c in sorted(self.forms.items())], "raw string, code string")
        return rows.select(plain(F.col("raw")).alias("form"), "code").where("length(form) > 1").distinct()

    def ranked(self, text: Column) -> Column:
        """``(d, c)`` of every form, the nearest first: share of letters that differ from a plain text, and code.

        The forms are a parameter table of fixed size, so each text is held
        against all of them where it is.
        """
        forms = F.array(*(F.struct(plain(F.lit(f)).alias("f"), F.lit(c).alias("c")) for f, c in sorted(self.forms.items()) if len(f) > 4))
        return F.array_sort(F.transform(forms, lambda x: F.struct((F.levenshtein(text, x["f"]) / F.greatest(F.length(text), F.length(x["f"]))).alias("d"), x["c"].alias("c"))))

    @staticmethod
    def mistyped(text: Column, ranked: Column) -> Column:
        """The code whose form is nearest to a text, within a quarter of its letters and clearly nearer than any other code's; null for short texts."""
        first = F.get(ranked, F.lit(0))
        other = F.get(F.filter(ranked, lambda x: x["c"] != first["c"]), F.lit(0))
        return F.when((F.length(text) > 4) & (first["d"] <= 0.25) & F.coalesce(other["d"] - first["d"] >= 0.1, F.lit(True)), first["c"])

    def lookup(self, text: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in self.forms.items() for x in kv)), text)

    def by_code(self, values: dict[str, float], code: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), code)

    def is_shared(self, text: Column) -> Column:
        return text.isin(*sorted(self.shared))

    def stripped(self, entry: Column) -> Column:
        """An entry in lower case without brackets, openings and words of scale."""
        codes = "|".join(self.codes).lower()
        s = F.trim(F.lower(entry))
        s = F.regexp_replace(s, rf"^(?:k|t)({codes})$|^({codes})k$", "$1$2")
        s = F.regexp_replace(s, r"^([a-z]) ([a-z]) ([a-z])$", "$1$2$3")
        s = F.regexp_replace(s, rf"(?u){THOUSAND_WORDS}|^currency:|^(?:in|en) |[()\[\]]", " ")
        s = F.regexp_replace(s, r"^[\s .,:;'*-]+|[\s ,:;'*-]+$", "")
        without = F.trim(F.regexp_replace(s, r"(?u)\b(?:cents?|pence)\b", " "))
        return F.when(F.length(without) > 0, without).otherwise(s)

    def exact(self, stripped: Column) -> Column:
        """The code that a stripped entry holds or is a form of."""
        code = F.upper(F.nullif(F.regexp_extract(stripped, rf"\b({'|'.join(self.codes).lower()})\b", 1), F.lit("")))
        return F.coalesce(code, self.lookup(stripped), self.lookup(F.regexp_replace(stripped, r"\.+$", "")))

    def entry_scale(self, entry: Column) -> Column:
        codes = "|".join(self.codes)
        thousand = F.lower(entry).rlike(rf"(?u){THOUSAND_WORDS}") | F.trim(entry).rlike(rf"^(?:[kKT](?:{codes})|(?:{codes})k)$")
        minor = F.lower(entry).rlike(rf"(?u){MINOR_WORDS}") | F.trim(entry).rlike(r"^GBp$")
        return F.when(thousand, "thousand").when(minor, "minor")

    def _named(self, text: Column, before: str, after: str = "") -> Column:
        forms = [f for f in [*self.forms, *self.shared] if not f.isdigit()]
        return F.lower(F.nullif(F.regexp_extract(text, rf"(?iu)(?:{before})\s*({quoted(forms)})(?![\p{{L}}\p{{N}}]){after}", 1), F.lit("")))

    def sentence_currency(self, text: Column) -> Column:
        """The form that a sentence about the currency of the page names."""
        return self._named(text, rf"(?<![\p{{L}}]){CURRENCY_OPENINGS}(?: the| der| dem)?")

    def total_currency(self, text: Column) -> Column:
        """The form that stands beside the total on a page."""
        opening = rf"(?<![^\n])(?:{TOTAL_OPENINGS})[ :]*"
        return F.coalesce(self._named(text, opening + AMOUNT), self._named(text, opening, rf"\s*{AMOUNT}"))


def sentence_scale(text: Column) -> Column:
    """``major``, ``thousand`` or ``minor`` if a sentence of the text says so."""
    s = F.lower(text)
    return F.when(s.rlike(rf"(?u){MAJOR_TEXT}"), "major").when(s.rlike(rf"(?u){THOUSAND_TEXT}"), "thousand").when(s.rlike(rf"(?u){MINOR_TEXT}"), "minor")


