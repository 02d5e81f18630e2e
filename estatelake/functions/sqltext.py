"""SQL text of expressions for messy listing values.

Cleaning and features touch dozens of columns at a time. Written as SQL text, each column is
one parsed expression; the text goes to ``F.expr``. ``x`` is a quoted column name or another
expression, ``dtype`` the type name of the column.
"""

from __future__ import annotations

# Texts a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts the cleaning step treats as missing (case-sensitive).
BLANK_TOKENS = ["", "nan", "None", "null", "NULL"]
# Texts of flags.
TRUE_TOKENS = ["true", "1", "yes", "y", "t"]
FALSE_TOKENS = ["false", "0", "no", "n", "f"]

# The white space of Unicode.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(tokens: list[str]) -> str:
    return "(" + ", ".join(quoted(t) for t in tokens) + ")"


def strip(x: str) -> str:
    """Without Unicode white space at both ends. Trimming a set of characters needs no regex."""
    return f"btrim({x}, {quoted(WHITE_SPACE)})"


def _solid(x: str) -> str:
    """Whether ``x`` begins with an ASCII character other than white space. Texts compare by their bytes."""
    return f"{x} >= '!' AND {x} < '\u0080'"


def strip_cell(x: str) -> str:
    """``strip`` of a plain name: texts that begin and end with other ASCII characters skip the search through the set."""
    return f"CASE WHEN {_solid(x)} AND {_solid(f'substring({x}, -1)')} THEN {x} ELSE {strip(x)} END"


def plain_spaces_cell(x: str) -> str:
    """Every white space character of a plain name as a blank; texts that have none but blanks are left alone."""
    odd = quoted("[" + WHITE_SPACE.replace(" ", "") + "]")
    return f"CASE WHEN {x} RLIKE {odd} THEN translate({x}, {quoted(WHITE_SPACE)}, '{' ' * len(WHITE_SPACE)}') ELSE {x} END"


def single_spaces(x: str) -> str:
    """Each run of blanks as one; texts without such runs skip the regex."""
    return f"CASE WHEN contains({x}, '  ') THEN regexp_replace({x}, ' +', ' ') ELSE {x} END"


def null_if_in(x: str, tokens: list[str]) -> str:
    return f"CASE WHEN {x} NOT IN {values(tokens)} THEN {x} END"


def finite(x: str) -> str:
    """NULL for NaN and both infinities; other numbers as double."""
    return f"CASE WHEN abs(double({x})) < double('infinity') THEN double({x}) END"


def number(x: str, dtype: str) -> str:
    """Double; NULL where a text is not a plain finite number."""
    if dtype != "string":
        return finite(x)
    text = strip(x)
    parsed = f"try_cast(CASE WHEN {text} RLIKE '^[-+.0-9eE]+$' THEN {text} END AS double)"
    return f"nullif(nullif({parsed}, double('infinity')), double('-infinity'))"


def number_text(x: str) -> str:
    """Double from a stripped text that is a plain number, which may be too large to be finite."""
    return f"try_cast(CASE WHEN {x} RLIKE '^[-+.0-9eE]+$' THEN {x} END AS double)"


def finite_double(x: str) -> str:
    return f"CASE WHEN abs({x}) < double('infinity') THEN {x} END"


def flag_text(x: str) -> str:
    """Boolean from a stripped text in lower case."""
    return f"CASE WHEN {x} IN {values(TRUE_TOKENS)} THEN true WHEN {x} IN {values(FALSE_TOKENS)} THEN false END"


def flag(x: str, dtype: str) -> str:
    """Boolean from flag texts; anything unknown (also the text ``1.0``) is NULL."""
    if dtype == "boolean":
        return x
    return flag_text(f"lower({strip(x if dtype == 'string' else f'string({x})')})")


def indicator(x: str, dtype: str) -> str:
    """0/1 integer form of a flag, a number or a flag text; missing is 0."""
    if dtype == "boolean":
        value = f"int({x})"
    elif dtype == "string":
        value = f"int(lower({strip(x)}) IN {values(TRUE_TOKENS)})"
    else:
        value = f"int({finite(x)})"
    return f"coalesce({value}, 0)"


def utc_timestamp(x: str, dtype: str) -> str:
    return f"try_to_timestamp({strip(x)})" if dtype == "string" else f"timestamp({x})"


def first_number(x: str) -> str:
    """First run of digits (with decimals) in a text, as double."""
    return rf"try_cast(regexp_extract(string({x}), r'(\d+(?:\.\d+)?)', 1) AS double)"


def ratio(a: str, b: str) -> str:
    """a/b, NULL for a zero or missing divisor or a non-finite result."""
    return finite(f"try_divide(double({a}), double({b}))")


def respelled(x: str, spellings: dict[str, list[str]]) -> str:
    """A text in lower case, stripped, with known spellings replaced by their target."""
    cases = " ".join(f"WHEN {x} IN {values(forms)} THEN {quoted(to)}" for to, forms in spellings.items())
    return f"CASE {cases} ELSE {x} END"


def has_text(x: str) -> str:
    return f"coalesce({strip(f'string({x})')} <> '', false)"


def location_path(parts: list[str]) -> str:
    """Levels joined by `` | ``; blanks and bars at the ends are cut off, empty is NULL."""
    filled = ", ".join(f"coalesce(string({p}), '')" for p in parts)
    return f"nullif(btrim(concat_ws(' | ', {filled}), ' |'), '')"


def joined_labels(parts: list[str]) -> str:
    """Levels joined by `` | `` with ``Unknown`` for missing ones."""
    return "concat_ws(' | ', " + ", ".join(f"coalesce(string({p}), 'Unknown')" for p in parts) + ")"


def label_up_to(x: str, edges: list[float], labels: list[str]) -> str:
    """Bin with intervals closed on the right; the last label has no upper edge."""
    cases = " ".join(f"WHEN {x} <= {e} THEN {quoted(n)}" for e, n in zip(edges, labels))
    return f"CASE {cases} WHEN {x} IS NOT NULL THEN {quoted(labels[-1])} END"
