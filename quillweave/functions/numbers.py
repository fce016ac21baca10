"""Equality of number texts with any number of digits, as one SQL lambda over (a, b).

A number is an optional sign and digits, in whole or with commas between groups of three, with
an optional decimal part; a ratio is two numbers around a slash.  Blanks and dollar signs at the
ends, one ``\\boxed{...}`` around it and ``\\frac{a}{b}`` for a/b are read.  Blanks elsewhere, other
commas, mixed numbers (``3 1/2``), exponents (``1e3``) and percentages (``50%``) are no numbers.

Decimals are compared by sign, digits and scale.  Ratios are compared by cross products: as
decimals if they are short; else by residues modulo eight primes, which takes time in proportion
to the digits, and where those agree by the whole products.  Products of more than
``WHOLE_PRODUCT`` limb pairs are taken as equal if all residues agree (a fingerprint of 247 bits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillweave.functions.binding import let_sql

NUMBER = r"[+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)"
#: the largest primes below 2^31
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
#: digits of a limb, and limb pairs that are multiplied out
LIMB, WHOLE_PRODUCT = 6, 4_000_000
_BLANKS = r"' \t\n\u000b\f\r'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _trimmed(t: str) -> str:
    return f"btrim(btrim(btrim({t}, {_BLANKS}), '$'), {_BLANKS})"


def _plain(t: str) -> str:
    """Number text without what may stand around it."""
    unboxed = _let("o", _trimmed(t), rf"if(startswith(o, '\\boxed{{') and endswith(o, '}}'), {_trimmed('substr(o, 8, length(o) - 8)')}, o)")
    return rf"regexp_replace({unboxed}, r'^([+-]?)\\[dt]?frac\{{\s*([^{{}}\s]*)\s*\}}\{{\s*([^{{}}\s]*)\s*\}}$', '$1$2/$3')"


def _number(t: str) -> str:
    """Struct ``neg``, ``digits`` without zeros in front, ``scale``; zero has no digits."""
    decimals = "if(contains(s, '.'), trim(TRAILING '0' FROM substring_index(s, '.', -1)), '')"
    digits = "trim(LEADING '0' FROM concat(substring_index(s, '.', 1), e))"
    fields = f"struct(startswith({t}, '-') and g <> '' as neg, g as digits, if(g = '', 0, length(e)) as scale)"
    return _let("s", f"replace(trim(LEADING '+-' FROM {t}), ',', '')", _let("e", decimals, _let("g", digits, fields)))


def _limbs(digits: str) -> str:
    """The highest first."""
    padded = f"lpad({digits}, {LIMB} * int(ceil(length({digits}) / {LIMB})), '0')"
    return f"transform(regexp_extract_all({padded}, '[0-9]{{{LIMB}}}', 0), l -> bigint(l))"


def _residue(limbs: str) -> str:
    return f"aggregate({limbs}, 0L, (r, l) -> (r * {10**LIMB} + l) % m)"


def _column(x: str, y: str) -> str:
    """What limb pairs add to the k-th limb of a product; limbs with the lowest first."""
    first, last = f"greatest(0, k - size({y}) + 1)", f"least(k, size({x}) - 1)"
    return f"if(k > size({x}) + size({y}) - 2, 0L, aggregate(sequence({first}, {last}), 0L, (s, i) -> s + {x}[i] * {y}[k - i]))"


def _same_products() -> str:
    """a * b = c * d for digit strings in the struct w."""
    short = "length(w.a) <= 19 and length(w.b) <= 18 and length(w.c) <= 19 and length(w.d) <= 18"
    exact = "cast(w.a as decimal(19, 0)) * cast(w.b as decimal(18, 0)) = cast(w.c as decimal(19, 0)) * cast(w.d as decimal(18, 0))"
    residues = f"forall(array({', '.join(f'{p}L' for p in PRIMES)}), m -> {_residue('n.a')} * {_residue('n.b')} % m = {_residue('n.c')} * {_residue('n.d')} % m)"
    carry = f"transform(array(carry + {_column('z.a', 'z.b')} - {_column('z.c', 'z.d')}), t -> if(t % {10**LIMB} = 0, t div {10**LIMB}, null))[0]"
    places = "sequence(0, greatest(size(z.a) + size(z.b), size(z.c) + size(z.d)))"
    whole = _let("z", "struct(" + ", ".join(f"reverse(n.{x}) as {x}" for x in "abcd") + ")", f"coalesce(aggregate({places}, 0L, (carry, k) -> {carry}) = 0, false)")
    long = f"greatest(bigint(size(n.a)) * size(n.b), bigint(size(n.c)) * size(n.d)) > {WHOLE_PRODUCT}"
    by_limbs = _let("n", "struct(" + ", ".join(f"{_limbs(f'w.{x}')} as {x}" for x in "abcd") + ")", f"{residues} and ({long} or {whole})")
    lengths = "abs(length(w.a) + length(w.b) - length(w.c) - length(w.d)) <= 1"
    return f"case when {short} then {exact} when w.a = w.c then w.b = w.d else {lengths} and {by_limbs} end"


def _same_ratios() -> str:
    """p = q for structs of number structs t (top) and b (bottom)."""
    zeros = "concat({0}.t.digits, repeat('0', {1}.t.scale + {0}.b.scale))"
    crossed = f"struct({zeros.format('p', 'q')} as a, q.b.digits as b, {zeros.format('q', 'p')} as c, p.b.digits as d)"
    same = f"((p.t.neg <> p.b.neg) = (q.t.neg <> q.b.neg)) and {_let('w', crossed, _same_products())}"
    nothing = "p.t.digits = '' or q.t.digits = ''"
    return f"p.b.digits <> '' and q.b.digits <> '' and case when {nothing} then p.t.digits = q.t.digits else {same} end"


def _ratio(t: str) -> str:
    bottom = f"if(contains({t}, '/'), substring_index({t}, '/', -1), '1')"
    return f"struct({_number(f'substring_index({t}, {chr(39)}/{chr(39)}, 1)')} as t, {_number(bottom)} as b)"


def _equal() -> str:
    plain, ratio = f"r'^{NUMBER}$'", f"r'^{NUMBER}(?:/{NUMBER})?$'"
    ratios = _let("p", _ratio("x"), _let("q", _ratio("y"), _same_ratios()))
    numbers = f"x rlike {plain} and y rlike {plain} then {_number('x')} = {_number('y')}"
    decided = f"case when {numbers} when x rlike {ratio} and y rlike {ratio} then {ratios} else false end"
    # texts that can't begin a number are told at once
    begins = r"r'^[\s$]*[\\+\-.\d]'"
    return f"if(v.a rlike {begins} and v.b rlike {begins}, {_let('x', _plain('v.a'), _let('y', _plain('v.b'), decided))}, false)"


_EQUAL = f"v -> coalesce({_equal()}, false)"


def numerically_equal(a: Column, b: Column) -> Column:
    """Equal as decimals, or as ratios by cross products, with any number of digits; never null."""
    return let_sql(F.struct(a.alias("a"), b.alias("b")), _EQUAL)
