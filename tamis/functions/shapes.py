"""Text as typed tokens. A text is cut into numbers, words, runs of white space and single signs, and each token has one letter for what it is; the
letters in a row are the text's shape. Grammars are short patterns over shapes, and a place in a shape is the place of a token, so that
whatever a pattern finds is read from the tokens by index. A text is scanned once, and nothing is joined or shuffled.

Letters: N whole number, M decimal, V vulgar fraction, S slash, D dash, T "to", X times sign, P plus, H hedge, A "a", Y "up", F "of", U unit, L unit
of length, I "optional", O and Q brackets, ~ , : ; ? as they are, % percent or degree, _ white space, W any other word, . any other sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.dims import ALIASES, HEDGES, VULGAR

TOKEN = r"(?sU)[0-9]+(?:\.[0-9]+)?|\p{L}[\p{L}\p{M}]*\.?|\s+|."
#: A number of any kind: whole with vulgar fraction, mixed, fraction, vulgar fraction, whole, decimal.
NUM = "(?:N_?V|N_N_?S_?N|N_?S_?N|V|N|M)"
#: What stands between the ends of a range.
TO = "_?[DT]_?"

_SIGNS = {"/": "S", "-": "D", "–": "D", "—": "D", "~": "~", "+": "P", "%": "%", "°": "%", ",": ",", ":": ":", ";": ";", "?": "?", "×": "X"} | dict.fromkeys("([【（", "O") | dict.fromkeys(")]】）", "Q")
_WORDS = {"to": "T", "x": "X", "plus": "P", "and": "P", "a": "A", "up": "Y", "of": "F", "optional": "I"}
LETTERS = {a.rstrip("."): "L" if kind == "length" else "U" for a, (_, kind) in ALIASES.items()} | {h: "H" for h in HEDGES if h.isalpha()} | _WORDS | _SIGNS | dict.fromkeys(VULGAR, "V")


def literal_map(pairs: dict[str, str]) -> Column:
    """A map of text to values written in SQL, as one expression: a table of a hundred rows costs one call."""
    quoted = lambda k: "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(f'{quoted(k)}, {v}' for k, v in pairs.items())})")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def shape(t: Column) -> Column:
    """The letters of an array of tokens."""
    table = literal_map({k: f"'{v}'" for k, v in LETTERS.items()})
    digit = lambda x: F.ascii(x).between(48, 57)
    letter = lambda x: F.when(digit(x), F.when(F.contains(x, F.lit(".")), "M").otherwise("N")).when(x == " ", "_").otherwise(F.coalesce(table[F.lower(F.rtrim(x, F.lit(".")))], F.when(x.rlike(r"^\p{L}"), "W").when(x.rlike(r"(?U)^\s"), "_").otherwise(".")))
    return F.array_join(F.transform(t, letter), "")


def groups(z: Column, pattern: str, n: int) -> Column:
    """What the n groups of a pattern at the head of a shape match, as an array; null where it does not match."""
    marked = F.regexp_replace(z, rf"(?s)^{pattern}.*$", "|".join(f"${i}" for i in range(1, n + 1)))
    return F.when(F.contains(marked, F.lit("|")), F.split(marked, r"\|", -1))


def number(t: Column, at: Column, z: Column) -> Column:
    """The number whose tokens begin at a place (from 0) and have the shape z; null without one, and by division by zero."""
    value = lambda i: F.get(t, i).try_cast("double")
    table = literal_map({k: f"{v!r}D" for k, v in VULGAR.items()})
    last = at + F.length(z) - 1
    return (
        F.when(z.isin("N", "M"), value(at))
        .when(z == "V", table[F.get(t, at)])
        .when(z.endswith("V"), value(at) + table[F.get(t, last)])
        .when(z.startswith("N_N"), value(at) + F.try_divide(value(at + 2), value(last)))
        .when(z.endswith("N"), F.try_divide(value(at), value(last)))
    )


def joined(t: Column, first: Column | int = 1, n: Column | None = None) -> Column:
    """The text of some tokens, from the first one on (from 1)."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.array_join(F.slice(t, first, F.size(t) if n is None else F.greatest(n, F.lit(0))), "")
