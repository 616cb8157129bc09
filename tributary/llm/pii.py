"""Personal data in text, with DataFrame and SQL functions only.

Method. Regular expressions propose spans; checks confirm them (Luhn for cards, mod 97 for account numbers, ranges for
addresses, digit counts for phones); words near a span raise or lower its score. Spans of the base kinds stay whatever
their score; the added kinds (iban, ssn) must reach THRESHOLD.

A span's start is the sum of what lies before it: the pieces between matches and the matches. Sums run over blocks of
BLOCK matches, so a text with very many matches costs little more than its length. Patterns use possessive
repetition and start only where a match can, so no text makes them backtrack.

Cases. A null text counts as empty: no spans, and redaction leaves it null. Repeated rows give repeated results; an
empty table gives none. Other columns stay as they are; columns that begin with __ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order, with the pattern that proposes each, and what must be in a text for it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score before context, words near a span that raise it, words that lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
NEAR = {
    "email": "mail|contact|write", "ip": "address|host|server|client|login", "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax|contact", "iban": "iban|account|bank|konto|transfer", "ssn": "ssn|social security|tax id|taxpayer",
}
AWAY = "version|release|order|invoice|isbn|serial"
RAISED, LOWERED, THRESHOLD = 0.3, 0.3, 0.5
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24
BLOCK = 256


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x["gap"] + x["length"])


def _confirmed(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(text, F.lit(" "), F.lit(""))
        letters = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
        rest = F.aggregate(letters, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(
            F.when(c <= "9", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97))
        return F.length(plain).between(15, 34) & (rest == 1)
    return F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start - BEFORE, F.lit(0))
    near = F.lower(F.concat(F.substring(text, first + 1, start - first), F.lit(" "), F.substring(text, end + 1, F.lit(AFTER))))
    return F.round(F.lit(SCORES[kind]) + F.when(near.rlike(NEAR[kind]), RAISED).otherwise(0.0) - F.when(near.rlike(AWAY), LOWERED).otherwise(0.0), 3)


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with spans: array of (start, kind number, end, kind, score), sorted; code points, end exclusive."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != "spans"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    out = df.select(*kept, text.alias("__text"))
    any_digit = F.col("__text").rlike("[0-9]")
    asks = {"email": F.contains("__text", F.lit("@")), "phone": F.contains("__text", F.lit("+"))}
    out = out.withColumns({f"__m_{k}": F.when(asks.get(k, any_digit), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    empty = F.array().cast("array<struct<gap: int, length: int, text: string>>")
    out = out.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.zip_with(
        F.slice(F.split("__text", p, -1), F.lit(1), F.size(f"__m_{k}")), f"__m_{k}",
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("length"), m.alias("text")))).otherwise(empty) for k, p in PATTERNS.items()})

    def firsts(name: str) -> Column:
        """Where each block of matches begins."""
        items = F.col(name)
        blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size({name}) - 1) div {BLOCK}").cast("int")), lambda b: _sum(F.slice(items, b * BLOCK + 1, BLOCK)))
        return F.when(F.size(items) > 0, F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))).otherwise(F.array(F.lit(0)))

    out = out.withColumns({f"__b_{k}": firsts(f"__g_{k}") for k in PATTERNS})

    def spans(n: int, kind: str) -> Column:
        items, begins = F.col(f"__g_{kind}"), F.col(f"__b_{kind}")

        def one(item: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(begins, block) + _sum(F.slice(items, block * BLOCK + 1, i % BLOCK)) + item["gap"]
            return F.struct(start.alias("start"), F.lit(n).alias("n"), (start + item["length"]).alias("end"), item["text"].alias("text"))

        placed = F.filter(F.transform(items, one), lambda s: _confirmed(kind, s["text"]))
        scored = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                                                        _score(kind, F.col("__text"), s["start"], s["end"]).alias("score")))
        nothing = F.array().cast("array<struct<start: int, n: int, end: int, kind: string, score: double>>")
        return F.when(F.size(items) > 0, scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= THRESHOLD)).otherwise(nothing)

    return out.select(*kept, F.array_sort(F.concat(*(spans(n, k) for n, k in enumerate(PATTERNS)))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans, and all spans as text."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["n"] < len(BASE))
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with each span of the text replaced by its kind in brackets; spans that overlap become one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def step(a: Column, s: Column) -> Column:
        fresh = F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        piece = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece, fresh)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("spans", first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return find(df, text_col).withColumn(text_col, F.when(F.size("spans") > 0, whole).otherwise(F.col(text_col))).drop("spans")
