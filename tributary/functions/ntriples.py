"""Column functions over N-Triples text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word splitter, by code point.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A run of iri, quoted text, escaped or plain characters up to white space outside of them.
#: Runs are possessive: the regular expressions must not go down one call a character of a long literal.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TOKEN = rf'(?:<[^>\\]*+(?:\\.[^>\\]*+)*+>|{QUOTED}|\\.|[^\s<"\\]++)++'
WORD = rf"[^<>{SPACES}]+"

#: Fixed values of the format.
LONGEST_LINE = 4 << 20
WIKIDATA_PROPERTY = "http://www.wikidata.org/prop/"
WIKIDATA_DIRECT = "http://www.wikidata.org/prop/direct/"


def tokens(line: Column) -> Column:
    """All tokens of a line; iris keep their brackets and literals their quotes."""
    return F.regexp_extract_all(line, F.lit(f"(?U){TOKEN}"), F.lit(0))


def words(line: Column) -> Column:
    """Words between white space and angle brackets."""
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def nth(items: Column, n: int) -> Column:
    """The n-th item from 0, or the empty string."""
    return F.coalesce(F.get(items, F.lit(n)), F.lit(""))


def is_data(line: Column) -> Column:
    """Neither blank, nor a comment, nor too long; null counts as blank."""
    first = nth(words(line), 0)
    return (F.octet_length(line) <= LONGEST_LINE) & (F.length(first) > 0) & ~first.startswith("#")


def lang_literal(token: Column) -> Column:
    """Struct of text and lang; escapes stay as written; no at sign means no language."""
    text = F.regexp_extract(token, f"^({QUOTED})", 1)
    return F.struct(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))).alias("text"), F.regexp_extract(token, f"^{QUOTED}@(.*)$", 1).alias("lang"))


def iri(token: Column) -> Column:
    """The token without its pair of angle brackets."""
    return F.regexp_replace(token, "^<(.*)>$", "$1")


def is_direct(predicate: Column) -> Column:
    """False for Wikidata properties other than direct ones."""
    return ~(predicate.startswith(WIKIDATA_PROPERTY) & ~predicate.startswith(WIKIDATA_DIRECT))


def short_id(iri: Column) -> Column:
    """Without the prefixes of entities and direct properties, and without a type's mark."""
    return F.regexp_replace(iri, r"^(?:t#)?http://www\.wikidata\.org/(?:entity|prop/direct)/", "")


def entity_to_property(predicate: Column) -> Column:
    """The property iri of a property entity, as glossaries need."""
    return F.regexp_replace(predicate, "/entity/P", "/prop/direct/P")


def trim_extensions(name: str) -> str:
    """A file's name without a compression extension, and then without .nt."""
    for ending in (".bz2", ".gz", ".bgz"):
        if name.endswith(ending):
            name = name[: -len(ending)]
            break
    return name.removesuffix(".nt")
