r"""Personal data: regular expressions propose spans, validators confirm them,
context words adjust the score. Column expressions only.

A kind's spans are the pattern's leftmost non-overlapping matches. Their places
come from the lengths of matches and of the gaps that splitting at the same
pattern leaves, in code points. The patterns are written so that a search is
linear in the text: runs are possessive, and a search starts a run only at its
front or where the last match ended (\G).

Base kinds (always reported once valid): email, ip (parts up to 255), card (12 to
19 digits, Luhn), phone (+, 9 to 15 digits). Added kinds: iban (mod 97), and,
if context words raise their score to `threshold`, ssn, local_phone and secret.

Null text counts as empty; a text without spans gives an empty array. Ties,
repeated rows, empty tables and extra columns, whatever their names, need no care: every row is
judged by itself, by one column expression. Work is near linear in the text and its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.llm.common import let, prefix_fold, prefix_sums

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "secret")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal run of digits with single separators; runs of other lengths can only fail.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,}+(?![A-Za-z0-9_])",
}
#: A text without a match of this, if given, holds no span of the kind.
HINTS = {
    "email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"[0-9]{3}[.-][0-9]{4}", "secret": r"[A-Za-z0-9_]{32}",
}
#: Words near a span, within WINDOW code points, that raise its score.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|server|host|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|llame)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|llame)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key|key|bearer)\b\W{0,6}$",
}
#: Score before context, and what context adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.4, "local_phone": 0.4, "secret": 0.3}
BONUS, WINDOW, THRESHOLD = 0.3, 40, 0.6
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(text: Column) -> Column:
    s = F.replace(text, F.lit(" "), F.lit(""))
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    h = HINTS[kind]
    return F.contains(text, F.lit(h)) if len(h) == 1 else text.rlike(h)


def _spans(kind: str, rank: int, threshold: float, m: Column, g: Column) -> Column:
    """m: the matches; g: the gaps around them, one more. Both are evaluated arrays."""

    def near(i: Column) -> Column:
        left = F.substring(F.get(g, i), -WINDOW, WINDOW)
        # A secret's word stands right before it.
        return left if kind == "secret" else F.concat(left, F.lit(" "), F.substring(F.get(g, i + 1), 1, WINDOW))

    def span(before: Column, i: Column) -> Column:
        start = before + F.length(F.get(g, i))
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (start + F.length(F.get(m, i))).alias("end"),
            (F.lit(SCORES[kind]) + F.when(near(i).rlike(CONTEXT[kind]), BONUS).otherwise(0.0)).alias("score"),
            valid(kind, F.get(m, i)).alias("ok"),
        )

    least = 0.0 if kind in BASE else threshold
    lens = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b))
    keep = F.filter(F.transform(prefix_sums(lens), span), lambda s: s.ok & (s.score >= least))
    return F.transform(keep, lambda s: F.struct(*[s[x].alias(x) for x in SPAN]))


SPAN = ("start", "rank", "kind", "end", "score")


def spans_of(text: Column, kinds=BASE + ADDED, threshold: float = THRESHOLD) -> Column:
    """-> array<struct<start, rank, kind, end, score>> sorted by start, then by kind as
    listed; places in code points, end exclusive."""
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")

    def of_kind(body: Column, rank: int, k: str) -> Column:
        matches = F.when(_hint(k, body), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty)
        build = lambda m: F.when(F.size(m) > 0, let(F.split(body, PATTERNS[k], -1), lambda g: _spans(k, rank, threshold, m, g))).otherwise(none)
        return let(matches, build)

    def every(body: Column) -> Column:
        words = [of_kind(body, r, k) for r, k in enumerate(kinds) if k == "email"]
        numbers = [of_kind(body, r, k) for r, k in enumerate(kinds) if k != "email"]
        found = F.concat(*words, F.when(body.rlike("[0-9]"), F.concat(*numbers)).otherwise(none)) if numbers else F.concat(*words)
        return F.sort_array(found)

    return let(F.coalesce(text, F.lit("")), every)


def detect(df: DataFrame, kinds=BASE + ADDED, text: str = "text", threshold: float = THRESHOLD, column: str = "pii") -> DataFrame:
    """Adds (or replaces) `column`, the spans."""
    return df.withColumn(column, spans_of(F.col(f"`{text}`"), kinds, threshold))


#: Spans that are cut out of one stretch of text together.
STRETCH = 128


def redacted(text: Column, kinds=BASE + ADDED, threshold: float = THRESHOLD) -> Column:
    """The text with every span replaced by <KIND>. Spans that overlap become one,
    named after the first. A null text stays null."""

    def cut(s: Column) -> Column:
        return let(prefix_fold(F.transform(s, lambda x: x.end), lambda a, b: F.greatest(a, b)), lambda reach: masked(s, reach))

    def masked(s: Column, reach: Column) -> Column:
        """reach: how far the spans before each one go; one begins anew where it starts past that."""
        at = F.filter(F.transform(s, lambda x, i: F.when(x.start >= F.get(reach, i), i)), lambda i: i.isNotNull())
        return let(at, lambda heads: joined(s, reach, heads))

    def joined(s: Column, reach: Column, heads: Column) -> Column:
        last = F.array_max(F.transform(s, lambda x: x.end))

        def stretch(b: Column) -> Column:
            own = F.slice(heads, b * STRETCH + 1, F.lit(STRETCH))
            begin = F.get(reach, F.get(own, F.lit(0)))  # the end of the span before
            upto = F.get(s, F.element_at(own, -1)).start
            # Places inside a stretch count from its begin, so no cut walks the whole text.
            part = let(F.substring(text, begin + 1, upto - begin), lambda t: let(begin, lambda z: F.array_join(F.transform(own, lambda i: piece(t, z, i)), "")))
            return part

        def piece(t: Column, z: Column, i: Column) -> Column:
            head = F.get(s, i)
            gap = F.substring(t, F.get(reach, i) - z + 1, head.start - F.get(reach, i))
            return F.concat(gap, F.lit("<"), F.upper(head.kind), F.lit(">"))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(heads) - 1) / STRETCH).cast("int")), stretch)
        return F.concat(F.array_join(parts, ""), let(last, lambda z: F.substring(text, z + 1, F.length(text))))

    return let(spans_of(text, kinds, threshold), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(text))


def redact(df: DataFrame, kinds=BASE + ADDED, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with the column `text` redacted; the other columns stay."""
    body = redacted(F.col(f"`{text}`"), kinds, threshold).alias(text)
    return df.select(*[body if c == text else F.col(f"`{c}`") for c in df.columns])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
