"""Text functions on columns, with the Unicode rules that hashes, tokens and searches depend on."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "\t\n\v\f\r \x85\xa0                　"
#: Combining marks that full text drops inside a word.
MARKS = "".join(chr(0x300 + i) for i in range(50) if ((0x08029FDF >> i) & 1 if i < 32 else (0x000361F8 >> (i - 32)) & 1))
_ODD_FOLDS = {"µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "s"}
_KEPT = "ǣǯǽǿ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_white(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` knows blanks alone)."""
    return F.btrim(c, F.lit(WHITE))


def or_else(c: Column, default: Column) -> Column:
    """Trimmed, or the default where that leaves nothing."""
    t = trim_white(F.coalesce(c, F.lit("")))
    return F.when(t == "", default).otherwise(t)


def _ascii(c: Column) -> Column:
    """Texts in which no letter needs translating, which takes most of the time of splitting one."""
    return F.octet_length(c) == F.length(c)


def lower(c: Column) -> Column:
    """Lower case letter by letter: no final sigma, no dot above of its own."""
    return F.lower(F.when(_ascii(c), c).otherwise(F.translate(c, "İΣ", "iσ")))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and decimal digits."""
    return F.array_remove(F.split(lower(c), r"[^\p{L}\p{Nd}]+"), "")


def words(c: Column) -> Column:
    """Runs between Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def count_words(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


@cache
def _folds() -> tuple[str, str]:
    """Letters whose accent full text ignores, and what they become: Latin ones of exactly one mark."""
    out = dict(_ODD_FOLDS)
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        x = chr(i)
        d = unicodedata.normalize("NFD", x.lower())
        if x == x.lower() and x not in _KEPT and len(d) == 2 and unicodedata.category(d[1]) == "Mn" and unicodedata.name(d[0], "").startswith("LATIN"):
            out[x] = d[0]
    return "".join(out), "".join(out.values())


def search_tokens(c: Column) -> Column:
    """Tokens of the full-text index: letters, numbers of any sort and private characters; lower case, single accents of
    Latin letters dropped."""
    x = F.when(_ascii(c), F.lower(c)).otherwise(F.translate(F.translate(lower(c), *_folds()), MARKS, ""))
    return F.array_remove(F.split(x, r"[^\p{L}\p{N}\p{Co}]+"), "")


def query_tokens(text: str, spark) -> list[str]:
    """The terms of a query, by the same functions as the index: split into letters and digits first, then folded."""
    return spark.range(1).select(F.flatten(F.transform(tokens(F.lit(text)), search_tokens)).alias("t")).first()[0]


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    start = F.lit(2166136261).cast("bigint")

    def fold(h: Column) -> Column:
        byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return F.aggregate(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), start, lambda a, i: (a.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.when(c == "", start).otherwise(let(F.hex(F.encode(c, "UTF-8")), fold))


def bucket(c: Column, dimension: int) -> Column:
    return F.pmod(fnv1a(c), F.lit(dimension)).cast("int")


_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"))


#: Runs of characters that print, or have an escape of their own: most texts are one, and ranges are checked fast.
_PLAIN = r"\A[\x07-\x0D -~\u00A1-\u00AC\u00AE-\u024F\u2010-\u2027\u2030-\u205E]*+\z"


def quoted(c: Column) -> Column:
    """A quoted string with escapes, so that different parts never join to the same text. Characters that don't print are
    written as numbers; rows without any, nearly all, skip that."""
    x = c
    for a, b in _ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    code = F.ascii
    number = lambda ch: F.when(code(ch) < 128, F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code(ch)), 2, "0")))).when(code(ch) < 65536, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code(ch)), 4, "0")))).otherwise(F.concat(F.lit("\\U"), F.lower(F.lpad(F.hex(code(ch)), 8, "0"))))
    rest = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"
    safe = F.when(c.rlike(_PLAIN), x).otherwise(F.array_join(F.transform(F.split(x, ""), lambda ch: F.when(ch.rlike(rest), number(ch)).otherwise(ch)), ""))
    return F.concat(F.lit('"'), safe, F.lit('"'))
