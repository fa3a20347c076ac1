r"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything runs as column expressions in the scan; there is no shuffle.  The
patterns use possessive quantifiers, so a text is searched in linear time, and a
long run cannot exhaust the stack.

Kinds ``email ip card phone`` are *base* kinds: what passes their check is
reported whatever its score.  ``iban`` (mod-97), ``card_short`` (13 to 15
digits, Luhn) and ``ssn`` (no checksum) are reported from ``threshold`` on.

Defined results: a null text counts as empty; an empty text has no spans; texts
of any length are searched whole; repeated rows each get their spans; an empty
table gives an empty one; columns of the input named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.llm import spans as S
from trustweave.llm.shared import beside, packed, text_of

BASE = ("email", "ip", "card", "phone")
#: Code points before and after a span in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    #: raises the score by ``lift`` when it stands nearby
    context: str
    lift: float = 0.3
    hint: str | None = None
    #: of a match's text
    valid: object = field(default=lambda m: F.lit(True))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right is doubled, less 9 if over 9; the sum is a multiple of 10."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064: four characters moved to the end, letters as 10 to 35, remainder 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

KINDS = (
    # a match starts where a run of its characters does, or where the last match ended
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", hint="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|host|server|address", hint=".",
         valid=lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    # runs of fewer than 16 digits cannot pass and hold no match that could
    Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", 0.7, "card|visa|credit|debit|iban",
         valid=lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m))),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|call|mobile|tel|fax", hint="+",
         valid=lambda m: F.length(digits(m)).between(8, 15)),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: [0-9]{1,3}|[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.8, "iban|account|bank|konto|compte|cuenta",
         valid=lambda m: F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(F.replace(m, F.lit(" ")))),
    Kind("card_short", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", 0.4, "card|visa|amex|credit|debit",
         valid=lambda m: luhn(digits(m))),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax id|taxpayer", lift=0.5),
)
SPAN = "struct<kind:string,start:int,end:int,score:double,text:string>"


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, base: tuple[str, ...] = BASE, threshold: float = 0.6) -> DataFrame:
    """``docs`` with ``pii``: spans ``kind, start, end, score, text`` by kind, then start."""
    rows = packed(docs, text=text_of(docs))
    rows = rows.select("*", *[S.matches(F.col("text"), k.pattern, k.hint).alias(f"_m_{k.name}") for k in kinds])
    rows = rows.select("*", *[S.placed(F.col("text"), k.pattern, F.col(f"_m_{k.name}")).alias(f"_p_{k.name}") for k in kinds])

    def scored(k: Kind) -> Column:
        def near(s: Column, cut: Column) -> Column:
            around = S.between(cut, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
            after = S.between(cut, s["end"], s["end"] + CONTEXT)
            return F.lower(F.concat(around, F.lit(" "), after)).rlike(k.context)

        spans = S.let(S.blocks(F.col("text")), lambda cut: F.transform(F.filter(F.col(f"_p_{k.name}"), lambda s: k.valid(s["text"])), lambda s: F.struct(
            F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(near(s, cut), F.lit(k.score + k.lift)).otherwise(F.lit(k.score)).alias("score"), s["text"].alias("text"))))
        return spans if k.name in base else F.filter(spans, lambda s: s["score"] >= threshold)

    found = F.flatten(F.array(*[F.when(F.size(f"_p_{k.name}") > 0, scored(k)).otherwise(F.array().cast(f"array<{SPAN}>")) for k in kinds]))
    rows = rows.select("_doc", found.alias("pii"))
    return rows.select(*beside(rows, ["pii"]), "pii")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts and digests of its spans."""
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    in_base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(S.digest(in_base), 256).alias("base_sha256"),
                        S.digest(F.col("pii")).alias("spans"), scores.alias("scores"))
