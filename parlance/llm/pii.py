"""Personal data: expressions propose, checksums confirm, whole words within forty code points on either side weigh. DataFrame functions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, span_digest

#: Kinds in their order of listing. The first four are the base; their guards only keep the matcher linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and the whole words that raise it when they stand near it, before or after.
WEIGHTS = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact|reach|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|master|pay|karte|carte|tarjeta",
    "phone": "phone|telephone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax|id",
}
CONTEXT_BONUS, KEEP_SCORE = 0.2, 0.5
_PREFILTER = {"email": "@", "phone": "+"}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn: every second digit from the right doubled, nine taken off above nine, the sum a multiple of ten."""
    def value(c, i):
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97_ok(hit: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35, the number is 1 modulo 97."""
    plain = F.regexp_replace(hit, "\\x20", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def step(acc, c):
        n = F.ascii(c)
        return F.when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn_ok(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97_ok(hit)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    found = F.filter(find_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["hit"]))

    def scored(s):
        near = F.lower(F.concat(s["before"], F.lit(" \x01 "), s["after"])).rlike(rf"(?<![a-z0-9])(?:{CONTEXT[kind]})(?![a-z0-9])")
        return F.struct(
            s["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("value"),
            (F.lit(WEIGHTS[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        )

    spans = F.transform(found, scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP_SCORE)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>")
    return F.when(F.contains(text, F.lit(_PREFILTER[kind])), spans).otherwise(none) if kind in _PREFILTER else spans


def detect_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column `into`: array of (start, rank, end, kind, value, score), by start, then kind as listed.

    Null texts count as empty and give an empty array. Rows are judged one by one: repeated rows and ties of the id keep a
    result each, other columns pass through. A column already named `into` is replaced. Offsets are code points, end
    exclusive. Base kinds stay whatever their score; added kinds need KEEP_SCORE.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, F.sort_array(F.concat(*(_of_kind(whole, k) for k in PATTERNS))))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from detect_pii()."""
    found = detect_pii(docs.select("doc_id", "text"), into="found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in PATTERNS), F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("found")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)), 6).alias("top_score"),
    )
