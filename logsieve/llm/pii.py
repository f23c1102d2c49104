"""Personal data by proposal, proof and context, in Spark expressions only.

A regular expression per kind proposes spans; validators confirm them (ranges of address parts, Luhn,
mod 97, digit counts); words near a span that belong to its kind raise its score. Kinds of the base
contract (email, ip, card, phone) are kept whatever their context; the kinds added here (iban, ssn,
phone_local) are kept from a score of :data:`KEEP` on.

Positions come from the regular expression itself: the text is split by the pattern, and the
pieces' lengths are summed (blocks of sums, so that a text with n matches takes n * sqrt(n) steps, not n * n).
Patterns match in linear time: where a run is scanned, it's taken possessively and from its start only
(a match may also start where the last one ended), which changes no leftmost match.

Positions are code points, end exclusive. Defined results: null and empty text have no spans and stay as they
are; rows are judged each on its own, so repeated rows and null ids need no care; an empty table gives an empty
result; columns of the input named like an added one, in any case, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import let, with_starts

KEEP = 0.5
#: Code points on either side of a span in which context words count, and what one adds.
CONTEXT, CONTEXT_ADDS = 40, 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _between(m: Column, low: int, high: int) -> Column:
    return F.length(_digits(m)).between(low, high)


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn checksum."""
    def add(d: Column) -> Column:
        n = F.length(d)

        def step(total: Column, i: Column) -> Column:
            x = F.substr(d, n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0
    return let(_digits(m), add)


def mod97(m: Column) -> Column:
    """Whether ``m``, an account number of two letters and then digits or letters, leaves 1 modulo 97."""
    def add(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
        values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
        return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1
    return let(F.regexp_replace(m, "[^A-Z0-9]", ""), add)


#: Lengths of account numbers by country, so that capitals and digits that follow one are no part of it.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
                26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
                29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_LISTED = "(?:" + "|".join(c for v in IBAN_LENGTHS.values() for c in v.split()) + ")[0-9]{2}"
#: Other countries: any length, up to a listed one's number.
IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
        + "|".join(f"(?:{'|'.join(v.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in IBAN_LENGTHS.items())
        + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]| (?!{_LISTED})[A-Z0-9]){{11,30}})(?![A-Za-z0-9])")
#: kind: (pattern, a string or class the text must have for a match, validator, base kind, score before context, context words)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, True, 0.9,
              "mail email e-mail contact courriel correo"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda m: F.forall(
        F.split(m, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")), True, 0.6, "ip address host server client"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", lambda m: _between(m, 13, 19) & luhn(m), True, 0.7,
             "card credit debit visa mastercard amex carte tarjeta kreditkarte"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda m: _between(m, 9, 15), True, 0.7,
              "phone tel call mobile fax telefon téléphone teléfono"),
    "iban": (IBAN, r"[A-Z]{2}[0-9]{2}", mod97, False, 0.8,
             "iban account bank konto compte cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"), False, 0.3,
            "ssn social security"),
    "phone_local": (r"(?<![0-9+(.-])(?:\([0-9]{3}\) |0[0-9]{1,4}[ /-]|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,6}(?![0-9])", "[0-9][ .-][0-9]",
                    lambda m: _between(m, 9, 13), False, 0.3, "phone tel call mobile fax telefon téléphone teléfono"),
}
BASE = [k for k, v in KINDS.items() if v[3]]
ORDER = list(KINDS)
SPAN = "struct<kind:string,start:bigint,end:bigint,text:string,score:double>"


def spans_of(kind: str, text: Column) -> Column:
    """array of (kind, start, end, text, score) of one kind, in order."""
    pattern, gate, valid, base, score, context = KINDS[kind]
    words = "(?iU)\\b(?:" + "|".join(context.split()) + ")\\b"

    def placed(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            sizes = F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))

            def found(start) -> Column:
                def one(m: Column, i: Column) -> Column:
                    at = start(i) + F.length(F.get(gaps, i))
                    span = let(at, lambda s: F.struct(
                        F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text"),
                        (F.lit(score) + F.when(_near(text, s, F.length(m)).rlike(words), CONTEXT_ADDS).otherwise(0.0)).alias("score")))
                    return F.when(valid(m), span) if valid else span
                kept = F.filter(F.transform(matches, one), lambda s: s.isNotNull())
                return kept if base else F.filter(kept, lambda s: s["score"] >= KEEP)
            return with_starts(sizes, found)
        return let(F.split(text, pattern, -1), with_gaps)

    none = F.array().cast(f"array<{SPAN}>")
    gated = text.contains(gate) if len(gate) == 1 else text.rlike(gate)
    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    return F.when(gated, some.cast(f"array<{SPAN}>")).otherwise(none)


def _near(text: Column, start: Column, size: Column) -> Column:
    low = F.greatest(start - CONTEXT, F.lit(0).cast("long"))
    return F.substr(text, (low + 1).cast("int"), (start - low + size + CONTEXT).cast("int"))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: all spans, by kind in the order of :data:`KINDS`, then by start."""
    text = F.col(f"`{text_col}`").cast("string")
    spans = F.flatten(F.array(*[spans_of(k, text) for k in ORDER]))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii"]
    return docs.select(*own, F.when(text.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(spans).alias("pii"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_col`` with every span of ``pii`` replaced by its kind in brackets; the column ``pii`` goes.

    Overlapping spans are replaced as one, by the kind of the one that starts first (then the longest).
    """
    text = F.col(f"`{text_col}`").cast("string")
    by_start = F.array_sort(F.transform("pii", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))
    # Each span moves the text before it to ``out``; ``rest`` is what comes after the spans so far, from ``at`` on.
    zero = F.struct(F.lit("").alias("out"), text.alias("rest"), F.lit(0).cast("long").alias("at"))

    def add(a: Column, s: Column) -> Column:
        gap, end, overlaps = (s["start"] - a["at"]).cast("int"), F.greatest(-s["neg_end"], a["at"]), s["start"] < a["at"]
        return F.struct(
            F.when(overlaps, a["out"]).otherwise(F.concat(a["out"], F.substr(a["rest"], F.lit(1), gap), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
            F.substr(a["rest"], (end - a["at"] + 1).cast("int")).alias("rest"), end.alias("at"))

    rebuilt = F.aggregate(by_start, zero, add, lambda a: F.concat(a["out"], a["rest"]))
    clean = F.when(text.isNull() | (F.size("pii") == 0), text).otherwise(rebuilt)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in found.columns if c != "pii"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_pii``."""
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("pii")).alias("spans"))
