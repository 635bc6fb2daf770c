"""Column expressions: tokens, hashes, splits, the normal quantile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: A lexical token, in a form that engines without look-around take too; digits alone are numbers and are filtered out.
LEXICAL = "[0-9]*[\\p{L}\\p{M}][\\p{L}\\p{M}\\p{Nd}]*(?:[-'’‑][\\p{L}\\p{M}\\p{Nd}]+)*['’]?|[0-9]+"
#: The same tokens: a run of digits that no letter follows is stepped over as a whole, as nothing of it can begin a token.
_WORDS = f"(?<![0-9])[0-9]*+{LEXICAL.rsplit('|', 1)[0].removeprefix('[0-9]*')}"
_GROUPED = "[0-9]{1,3}+(?:,[0-9]{3})++"
#: A number: groups of three or plain digits, one decimal part unless it is the second of its kind in a row; where the rest
#: is malformed, the leading digits alone.
NUMBER = (
    f"(?<![0-9]\\.)(?:{_GROUPED}|[0-9]++)\\.[0-9]++(?![0-9,])(?!\\.[0-9])|(?<![0-9]\\.){_GROUPED}(?![0-9,])(?!\\.[0-9])|(?<=[0-9]\\.){_GROUPED}(?![0-9,])|[0-9]++"
)
#: Words take their digits, so that a number is only what stands outside of words.
WORD_OR_NUMBER = f"{LEXICAL.rsplit('|', 1)[0]}|{NUMBER}"
SPACES = "\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
URL = f"(?:https?://|www\\.)[^{SPACES}]*"
#: A quote, or the rest of the text from an opening mark that is never closed.
QUOTE = '"[^"]*"|“[^”]*”|["“](?s:.*)'


def extract_all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    return F.filter(extract_all(text, LEXICAL), lambda t: ~t.rlike("^[0-9]+$"))


def words(text: Column) -> Column:
    """The lexical tokens by a pattern that never takes digits alone, so that nothing is filtered out afterwards."""
    return extract_all(text, _WORDS)


def numbers(text: Column) -> Column:
    return F.filter(extract_all(text, WORD_OR_NUMBER), lambda t: t.rlike("^[0-9][0-9.,]*$"))


def count_in(tokens: Column, words) -> Column:
    """How many lower-cased tokens are in a fixed list; the optimiser looks them up in a set."""
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def exact_sum(number: Column) -> Column:
    """The sum of doubles, up to 2^45, with the same bits in whatever order they come: whole 2^-18, whole 2^-44 of the rest and 2^-70 of its rest are added up as whole numbers."""
    out, rest = F.lit(0.0), number * F.lit(2.0**18)
    for unit in (2.0**-18, 2.0**-44, 2.0**-70):
        whole = F.rint(rest)
        out = out + F.sum(whole.cast("long")) * F.lit(unit)
        rest = (rest - whole) * F.lit(2.0**26)
    return out


def framed(*parts: Column) -> Column:
    """length:part for each part, one after another; lengths are in bytes."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def content_id(*parts: Column) -> Column:
    return F.sha2(framed(*parts), 256)


def split_of(content_hash: Column, seed: str = "penstroke-v1", weights=C.SPLIT_WEIGHTS) -> Column:
    """The split from the first 64 bits of a digest, modulo the weights' sum."""
    head = F.conv(F.substring(content_id(F.lit("content-sha256-v1"), F.lit(seed), content_hash), 1, 16), 16, 10).cast("decimal(20,0)")
    bucket = (head % sum(w for _, w in weights)).cast("int")
    upto, out = 0, None
    for name, w in weights:
        upto += w
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out


def contraction(token: Column) -> Column:
    t = F.lower(F.replace(token, F.lit("’"), F.lit("'")))
    tail = reduce(lambda a, b: a | b, [t.endswith(s) for s in C.CONTRACTION_SUFFIXES])
    return ~t.endswith("'") & (tail | (t.endswith("'s") & F.regexp_replace(t, "'s$", "").isin(*C.S_HOSTS)))


def possessive(token: Column) -> Column:
    t = F.lower(F.replace(token, F.lit("’"), F.lit("'")))
    return t.endswith("'") | (t.endswith("'s") & ~F.regexp_replace(t, "'s$", "").isin(*C.S_HOSTS))


def ends_terminal(text: Column) -> Column:
    return F.regexp_replace(F.rtrim(text), "[\"'”’)\\]}*_]+$", "").rlike("[.!?]$")


# --- fixed values: the public rational approximation AS 241 of the normal quantile ---
_CENTRE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
           (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0))
_NEAR = ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
         (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))
_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0))


def _double(c: float) -> str:
    return repr(c) if "e" in repr(c) else f"{c!r}e0"


def _ratio(r: str, table) -> str:
    num, den = ("(" * (len(t) - 1) + _double(t[0]) + "".join(f" * {r} + {_double(c)})" for c in t[1:]) for t in table)
    return f"({num}) / ({den})"


def probit_sql(u: str) -> str:
    """The quantile as SQL text over a name; its literals are doubles in every dialect."""
    q, tail = f"({u} - 0.5e0)", f"sqrt(-ln(least({u}, 1e0 - {u})))"
    centre = f"{q} * " + _ratio(f"(0.180625e0 - {q} * {q})", _CENTRE)
    near, far = _ratio(f"({tail} - 1.6e0)", _NEAR), _ratio(f"({tail} - 5e0)", _FAR)
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE sign({q}) * (CASE WHEN {tail} <= 5e0 THEN {near} ELSE {far} END) END"


def probit(u: str) -> Column:
    return F.expr(probit_sql(u))
