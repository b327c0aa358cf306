"""Secret scans: strong credentials by form, weak ones only where complementary parts meet. DataFrame functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, let, scan, span_digest, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order of listing; the first three are the base.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{15,}+",
    "ident": r"""(?i)(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""",
    "weak": ASSIGN,
    "endpoint": r"""(?i)(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"'<>]+""",
}
BASE = ("assign", "access", "hex")
#: Parts that complete each other; a weak part needs one of each listed role in its scope.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "weak": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "weak": ("id",), "endpoint": ("id", "secret")}
#: Code points on either side of a part in which its complements count.
SCOPE = 200
STRONG_LENGTH, WEAK_LENGTH = 12, 6
_ROLES = ("id", "secret", "endpoint")
_FIELDS = ("start", "rank", "end", "kind", "value")
_PART = "struct<start:int,rank:int,end:int,kind:string,value:string,links:array<int>>"
_AT = "start:int,rank:int,end:int,kind:string,value:string"
_MET = ",".join(f"{r}_start:int,{r}_end:int" for r in _ROLES)
_NEAR = f"struct<{_AT},{_MET}>"
_BOTH = f"struct<{_AT},{_MET},{','.join(f'{r}_after:int' for r in _ROLES)}>"


def _parts(text: Column, kind: str) -> Column:
    found = find_spans(text, PATTERNS[kind], context=0)
    if kind in ("assign", "weak"):
        size = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2))
        found = F.filter(found, (lambda s: size(s) >= STRONG_LENGTH) if kind == "assign" else (lambda s: size(s).between(WEAK_LENGTH, STRONG_LENGTH - 1)))
    rank = list(PATTERNS).index(kind)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("value")))


def _of_role(x: Column, role: str) -> Column:
    return x["kind"].isin([k for k, r in ROLE.items() if r == role])


def _linked(parts: Column, scope: int) -> Column:
    """Interval join of the parts of one text by two sweeps: the nearest part of each role before and after, by its start."""
    copy = lambda x, names: [x[n].alias(n) for n in names]
    met = [f"{r}_{e}" for r in _ROLES for e in ("start", "end")]
    none = F.struct(*(F.lit(None).cast("int").alias(n) for n in met))

    def before(at, x):
        later = lambda r: _of_role(x, r) & (F.coalesce(at[f"{r}_end"], F.lit(-1)) <= x["end"])
        return F.struct(*(F.when(later(r), x[e]).otherwise(at[f"{r}_{e}"]).alias(f"{r}_{e}") for r in _ROLES for e in ("start", "end")))

    forward = scan(parts, none, before, lambda at, x: F.struct(*copy(x, _FIELDS), *copy(at, met)), _NEAR)
    nothing = F.struct(*(F.lit(None).cast("int").alias(r) for r in _ROLES))
    both = scan(
        F.reverse(forward), nothing, lambda at, x: F.struct(*(F.when(_of_role(x, r), x["start"]).otherwise(at[r]).alias(r) for r in _ROLES)),
        lambda at, x: F.struct(*copy(x, (*_FIELDS, *met)), *(at[r].alias(f"{r}_after") for r in _ROLES)), _BOTH,
    )

    def partner(x, role):
        """Start of the nearer part of a role within the scope; null if there is none. A part that overlaps is at distance zero."""
        left = F.when(x["start"] - x[f"{role}_end"] <= scope, F.greatest(x["start"] - x[f"{role}_end"], F.lit(0)))
        right = F.when(x[f"{role}_after"] - x["end"] <= scope, F.greatest(x[f"{role}_after"] - x["end"], F.lit(0)))
        return F.when(left.isNotNull() & (right.isNull() | (left <= right)), x[f"{role}_start"]).when(right.isNotNull(), x[f"{role}_after"])

    def linked(x):
        asked = {k: NEEDS.get(k, ("secret",) if ROLE[k] == "id" else ("id",)) for k in PATTERNS}
        links = F.lit(None).cast("array<int>")
        for kind, roles in asked.items():
            links = F.when(x["kind"] == kind, F.array(*(partner(x, r) for r in roles))).otherwise(links)
        return F.struct(*copy(x, _FIELDS), links.alias("links"))

    whole = lambda x: x["kind"].isin(list(BASE)) | ~F.exists(x["links"], lambda y: y.isNull())
    return F.transform(F.filter(F.transform(both, linked), whole), lambda x: F.struct(*copy(x, _FIELDS), F.array_compact(x["links"]).alias("links")))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", scope: int = SCOPE) -> DataFrame:
    """docs with a column `into`: array of (start, rank, end, kind, value, links) by start, then kind as listed.

    links holds the starts of the parts that complete it: for a secret or an identifier the nearest of the other kind, for an
    endpoint both. Base kinds (assign, access, hex) are always reported, linked or not. Weak ones - an identifier, a short secret, an endpoint - only when
    their complements stand within `scope` code points in the same text. The interval join sweeps the sorted parts of one
    text, so no pair is emitted and nothing is shuffled. Null texts count as empty; each row, repeated or not, has a result
    of its own; other columns pass through, one named `into` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    weak_kinds = [k for k in PATTERNS if k not in BASE]
    strong, weak = unused(docs, "strong_parts", "weak_parts")
    alone = F.transform(strong, lambda x: F.struct(*(x[n].alias(n) for n in _FIELDS), F.array().cast("array<int>").alias("links")))
    out = docs.withColumns({strong: F.concat(*(_parts(whole, k) for k in BASE)), weak: F.concat(*(_parts(whole, k) for k in weak_kinds))})
    linked = F.sort_array(_linked(F.sort_array(F.concat(strong, weak)), scope))
    some = (F.size(weak) > 0) | F.exists(strong, lambda x: _of_role(x, "id"))
    return out.withColumn(into, F.when(some, linked).otherwise(F.sort_array(alone))).drop(strong, weak)


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs whose reported secrets are replaced by `mark`. Overlapping spans become one mark.

    Texts without a secret, null ones too, stay as they are; all other columns pass through, whatever their names.
    """
    spans, plain = unused(docs, "secret_spans", "plain_text")
    found = scan_secrets(docs, text, into=spans).withColumn(plain, F.coalesce(F.col(text), F.lit("")))
    pieces = scan(
        F.col(spans), F.struct(F.lit(0).alias("pos")), lambda at, x: F.struct(F.greatest(at["pos"], x["end"]).alias("pos")),
        lambda at, x: F.struct(at["pos"].alias("from"), x["start"].alias("to"), F.greatest(at["pos"], x["end"]).alias("end")), "struct<from:int,to:int,end:int>",
    )
    body = let_pieces(pieces, F.col(plain), mark)
    return found.withColumn(text, F.when(F.size(spans) > 0, body).otherwise(F.col(text))).drop(spans, plain)


def let_pieces(pieces: Column, whole: Column, mark: str) -> Column:
    def join(p):
        cut = F.transform(p, lambda x: F.when(x["to"] >= x["from"], F.concat(F.substr(whole, x["from"] + 1, x["to"] - x["from"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(cut, ""), F.substr(whole, F.element_at(p, -1)["end"] + 1))

    return let(pieces, join)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets(), and links: start>start of the parts that complete each other, comma-joined."""
    found = scan_secrets(docs.select("doc_id", "text"), into="found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    pairs = F.flatten(F.transform("found", lambda s: F.transform(s["links"], lambda x: F.concat_ws(">", s["start"].cast("string"), x.cast("string")))))
    return found.select(
        "doc_id", *(count(k) for k in PATTERNS), F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("found")).alias("spans"), F.array_join(pairs, ",").alias("links"))
