"""String column expressions. All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkprep.functions.lookup import sql_literal
from sparkprep.schema import NULL_TOKENS

# --- fixed values: the characters Python calls white space, up to U+3000 ---
WHITESPACE = "".join(
    chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
                     0x2029, 0x202F, 0x205F, 0x3000]
)


_WHITESPACE_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"


def name_sql(column: str) -> str:
    """A column name as SQL; raw headers may contain dots or blanks."""
    return "`" + column.replace("`", "``") + "`"


def strip_sql(e: str) -> str:
    """`e` without white space at its ends. Text between visible ASCII characters, the usual case, is
    passed on after two byte comparisons; trimming a set of characters is far dearer."""
    return (
        f"CASE WHEN {e} >= '!' AND {e} < '\\u007f' AND right({e}, 1) BETWEEN '!' AND '~' THEN {e} "
        f"ELSE btrim({e}, {_WHITESPACE_SQL}) END"
    )


def null_token_sql(e: str) -> str:
    """Trimmed text, null for the null spellings (case-sensitive)."""
    return f"if({e} IN ({', '.join(map(sql_literal, NULL_TOKENS))}), NULL, {e})"


def blank_sql(e: str) -> str:
    """Null, empty or nothing but white space; only a value that starts like white space is trimmed."""
    return f"({e} IS NULL OR (({e} < '!' OR {e} >= '\\u007f') AND btrim({e}, {_WHITESPACE_SQL}) = ''))"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lower_strip(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def strip_prefix(c: Column) -> Column:
    """`LOC-001` -> `001`; a value that is all prefix stays as it is."""
    return F.regexp_replace(F.trim(c), r"^[A-Za-z_\-\s]+(?=[^A-Za-z_\-\s])", "")


def normalize_header(c: Column) -> Column:
    h = F.lower(strip(c))
    return F.replace(
        F.replace(F.replace(h, F.lit(" "), F.lit("")), F.lit("-"), F.lit("_")), F.lit("__"), F.lit("_")
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one table row of the recurrence per character of `a`.
    Quadratic in string length: meant for headers, not for texts."""

    def extend(prev: Column, i: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            value = F.when(
                F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1)), F.element_at(prev, j) + 1
            ).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j)))
            return F.concat(cur, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, extend)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(table, -1)).otherwise(F.lit(0))


#: A spelling of up to this many ASCII characters fits one word of bits, with room for the carry.
WORD = 62


def spelling(text: str) -> dict:
    """What the comparisons below need to know of a known text: for each ASCII character the places it stands at, as
    bits (null if the text is too long for that), and which characters it has at least once, twice and three times."""
    masks = None
    if len(text) <= WORD and text.isascii():
        masks = [sum(1 << i for i, c in enumerate(text) if ord(c) == code) for code in range(128)]
    counts = [0] * 64
    for c in text:
        counts[ord(c) % 64] += 1
    levels = [_signed(sum(1 << k for k, n in enumerate(counts) if n >= level)) for level in (1, 2, 3)]
    return {"text": text, "n": len(text), "masks": masks, "levels": levels}


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


SPELLING = "text: string, n: int, masks: array<bigint>, levels: array<bigint>"


def codes(text: Column) -> Column:
    """Code points of a text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))))
    return F.when(F.length(text) > 0, every).otherwise(F.array().cast("array<int>"))


def char_levels(points: Column) -> Column:
    """For code points as classes modulo 64: the classes there at least once, twice and three times, as bits."""
    def add(levels: Column, code: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(64)))
        one, two, three = levels[0], levels[1], levels[2]
        return F.array(one.bitwiseOR(bit), two.bitwiseOR(one.bitwiseAND(bit)), three.bitwiseOR(two.bitwiseAND(bit)))

    return F.aggregate(points, F.array(*[F.lit(0).cast("long")] * 3), add)


def common_at_most(levels: Column, length: Column, known: Column) -> Column:
    """No common subsequence with a known spelling is longer: characters common to both, at most three of a class
    counted each, and all beyond three as common."""
    parts = [F.bit_count(levels[k]) for k in range(3)]
    both = [F.bit_count(levels[k].bitwiseAND(known["levels"][k])) for k in range(3)]
    return both[0] + both[1] + both[2] + length - parts[0] - parts[1] - parts[2]


def lcs_of_codes(points: Column, text: Column, known: Column) -> Column:
    """lcs_length() of a text and a known spelling: all places of the spelling in one word, one step a character."""
    zero = F.lit(0).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), known["n"]) - F.lit(1)

    def step(open_: Column, code: Column) -> Column:
        here = F.coalesce(F.get(known["masks"], code), zero)
        return (open_ + open_.bitwiseAND(here)).bitwiseOR(open_.bitwiseAND(F.bitwise_not(here))).bitwiseAND(full)

    return F.when(known["masks"].isNull(), lcs_length(text, known["text"])).otherwise(known["n"] - F.bit_count(F.aggregate(points, full, step)))
