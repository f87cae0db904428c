"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm them (Luhn for
cards, mod 97 for bank accounts, number ranges for addresses), and words nearby
raise the score. Email, ip, card and phone spans stand as they are confirmed;
the further kinds need the score of ``KEEP``.

Where the expressions stand next to a plain form below, the plain form says
what they match; they differ in possessive quantifiers and a look-behind, which
match the same but need neither a deep stack nor a second look at a long run.

Positions: a text is split at the matches, and a span starts behind the lengths
of the pieces and matches before it. Sums go by chunks of matches, so texts
with very many matches stay cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import free_name, text_or_empty

KEEP = 0.5
CHUNK = 256
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24

LOCAL = "[A-Za-z0-9._%+-]"
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IP_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
IP_RANGE = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column, least: int, most: int) -> Column:
    digits = _digits(match)
    return F.length(digits).between(least, most) & F.call_function("luhn_check", digits)


def _mod97(match: Column) -> Column:
    """Whether the account number, its first four characters moved to the end and
    letters read as 10 to 35, leaves 1 when divided by 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(
        F.length(c) == 1, step(r, c)).otherwise(r)) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str            # an expression that any text with a match has, cheap to look for
    words: str           # context words
    score: float         # of a confirmed span without context
    confirm: object = None
    base: bool = False


#: In the order in which spans are listed. The base kinds come first.
KINDS = (
    Kind("email", EMAIL, "@", "e-?mail|mail|contact|write", 0.9, None, True),
    Kind("ip", IP, r"[0-9]\.[0-9]", "ip|host|server|address|login", 0.7, lambda m: m.rlike(IP_RANGE), True),
    Kind("card", CARD, "[0-9][ -]?[0-9]", "card|visa|master|credit|debit|pay", 0.8, lambda m: _luhn(m, 16, 19), True),
    Kind("phone", PHONE, r"\+[0-9]", "phone|tel|call|mobile|fax", 0.7, lambda m: F.length(_digits(m)).between(8, 15), True),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", "iban|account|bank|transfer", 0.8, _mod97),
    Kind("short_card", CARD, "[0-9][ -]?[0-9]", "card|visa|amex|credit|debit", 0.3, lambda m: _luhn(m, 13, 15)),
    Kind("ssn", SSN, "[0-9]-[0-9]", "ssn|social security", 0.3,
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$")),
)
CONTEXT_SCORE = 0.25


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _chunk_sums(lengths: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / CHUNK).cast("int")),
                       lambda c: _total(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))


def _sums_before(sums: Column) -> Column:
    return F.transform(sums, lambda _, c: _total(F.slice(sums, F.lit(1), c)))


def _starts(lengths: Column, chunk_starts: Column) -> Column:
    """For each length, the sum of those before it."""
    return F.transform(lengths, lambda _, i: F.get(chunk_starts, (i / CHUNK).cast("int")) +
                       _total(F.slice(lengths, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)))


def _spans(kind: Kind, matches: Column, pieces: Column, lengths: Column, starts: Column) -> Column:
    def span(match: Column, i: Column) -> Column:
        start = F.get(starts, i) + F.length(F.get(pieces, i))
        near = F.concat(F.substring(F.get(pieces, i), -BEFORE, BEFORE), F.lit(" "),
                        F.substring(F.get(pieces, i + 1), 1, AFTER))
        bonus = F.when(F.lower(near).rlike(f"(?:^|[^a-z])(?:{kind.words})"), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        sure = F.lit(True) if kind.confirm is None else kind.confirm(match)
        return F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"),
                        (start + F.length(match)).cast("long").alias("end"),
                        F.round(F.least(F.lit(1.0), F.lit(kind.score) + bonus), 2).alias("score"),
                        F.coalesce(sure, F.lit(False)).alias("sure"))
    found = F.filter(F.transform(matches, span), lambda s: s["sure"] if kind.base else s["sure"] & (s["score"] >= KEEP))
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["score"].alias("score")))


SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def with_spans(df: DataFrame, text: Column, spans: str) -> DataFrame:
    """``df`` with the array column ``spans`` of (kind, start, end, score), by
    kind as listed, then start; positions are code points, the end exclusive.
    ``text`` is a column without nulls."""
    names = {s: free_name(df, f"_pii_{s}") for s in ("text", "m", "p", "l", "c", "b", "s")}
    col = lambda step, k: f"{names[step]}_{k}"
    keep = [df[c] for c in df.columns]
    at = df.select(*keep, text.alias(names["text"]))
    body = F.col(names["text"])
    # each step is a projection of its own, so that no expression is worked out twice
    patterns = list(dict.fromkeys((k.pattern, k.gate) for k in KINDS))
    number = {p: i for i, (p, _) in enumerate(patterns)}
    nothing = F.array().cast("array<string>")

    def gate(g: str) -> Column:
        return F.contains(body, F.lit(g)) if g == "@" else body.rlike(g)

    at = at.select("*", *[F.when(gate(g), F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(nothing)
                          .alias(col("m", i)) for i, (p, g) in enumerate(patterns)])
    at = at.select("*", *[F.when(F.size(col("m", i)) > 0, F.split(body, p, -1)).otherwise(nothing).alias(col("p", i))
                          for i, (p, _) in enumerate(patterns)])

    def lengths(i: int) -> Column:
        return F.transform(col("m", i), lambda m, j: (F.length(F.get(F.col(col("p", i)), j)) + F.length(m)).cast("long"))

    at = at.select("*", *[lengths(i).alias(col("l", i)) for i in range(len(patterns))])
    for made, make in (("c", lambda i: _chunk_sums(F.col(col("l", i)))), ("b", lambda i: _sums_before(F.col(col("c", i)))),
                       ("s", lambda i: _starts(F.col(col("l", i)), F.col(col("b", i))))):
        at = at.select("*", *[F.when(F.size(col("l", i)) > 0, make(i)).otherwise(F.array().cast("array<bigint>"))
                              .alias(col(made, i)) for i in range(len(patterns))])
    every = [F.when(F.size(col("m", number[k.pattern])) > 0, _spans(k, *(F.col(col(s, number[k.pattern])) for s in "mpls")))
             .otherwise(F.array().cast(SPANS_TYPE)).cast(SPANS_TYPE) for k in KINDS]
    return at.select(*[F.col(f"`{c}`") for c in df.columns], F.concat(*every).alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``base_sha256`` (digest of the listed spans of these four kinds), ``spans``
    (all spans, listed), ``found`` (all spans with scores). A null text counts
    as empty and has no spans; null and repeated ids are kept as they are.
    Texts of any length are searched whole; an empty table gives no rows."""
    slim = df.select(df[id_col], text_or_empty(df, text).alias("_text"))
    out = with_spans(slim, slim["_text"], "found")
    base = [k.name for k in KINDS if k.base]
    of_base = F.filter("found", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(id_col, *map(count, base), F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"),
                      listed(F.col("found")).alias("spans"), "found")


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The input with each found span replaced by its kind in angle brackets, and
    ``n_chars`` (if there is such a column) counted anew. Spans that overlap are
    replaced together, under the kind of the one that starts first (of those, the
    longest). Texts without spans, null ones too, stay as they are.
    Rows without id and repeated rows are treated like others; an empty table stays empty."""
    spans = free_name(df, "_spans")
    found = with_spans(df, text_or_empty(df, text), spans)
    body = F.col(f"`{text}`")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("before"),
                                                                 s["kind"].alias("kind"), s["end"].alias("end"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                     F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(ordered, first, step, lambda acc: F.concat(
        acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    clean = F.when(F.size(spans) > 0, whole).otherwise(body)
    out = found.select(*[clean.alias(text) if c == text else F.col(f"`{c}`") for c in df.columns])
    if n_chars not in df.columns:
        return out
    kind = df.schema[n_chars].dataType
    return out.withColumn(n_chars, F.coalesce(F.length(F.col(f"`{text}`")).cast(kind), F.col(f"`{n_chars}`")))
