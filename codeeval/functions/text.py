"""Column expressions for cleaning and labelling text.

All of these are built-in Spark expressions, so they run inside whole-stage
codegen, need no Python worker and are evaluated row-locally (no shuffle).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that it names more than once and that is to be evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def ustrip(c: ColumnLike) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip()`` does.

    Spark's one-argument ``trim`` only removes U+0020; the two-argument form
    removes any character of the given set, which is Python's set here.
    """
    return F.trim(_c(c), F.lit(fixed.PY_WHITESPACE))


def is_blank(c: ColumnLike) -> Column:
    """Nothing left by ``ustrip``; a text is read only up to its first other character."""
    return ~_c(c).rlike(f"[^{fixed.PY_WHITESPACE}]")


def clean_code(c: ColumnLike) -> Column:
    """Remove every end-of-text token, strip, and unwrap a ```scala ... ``` block.

    Unwrapping happens only when the stripped text both starts with the
    scala fence and ends with a fence; 8 leading and 3 trailing characters
    are cut and the rest stripped again.
    """
    s = ustrip(F.replace(_c(c), F.lit(fixed.END_OF_TEXT), F.lit("")))
    # characters 9 .. len-3 (1-based) == Python s[8:-3]
    inner = F.substr(s, F.lit(len(fixed.SCALA_FENCE_OPEN) + 1),
                     F.length(s) - (len(fixed.SCALA_FENCE_OPEN) + len(fixed.FENCE)))
    return F.when(s.startswith(fixed.SCALA_FENCE_OPEN) & s.endswith(fixed.FENCE),
                  ustrip(inner)).otherwise(s)


def remove_first(c: ColumnLike, needle: str) -> Column:
    """Remove only the first occurrence of ``needle`` (``str.replace(x, '', 1)``)."""
    s = _c(c)
    pos = F.instr(s, needle)
    return F.when(pos > 0, F.overlay(s, F.lit(""), pos, F.lit(len(needle)))).otherwise(s)


def strip_backticks(c: ColumnLike) -> Column:
    """Prompt-evaluation cleanup: when the response starts with three backticks,
    strip every leading/trailing backtick and then drop the first ``scala\\n``."""
    s = _c(c)
    stripped = F.trim(s, F.lit("`"))
    return F.when(s.startswith(fixed.FENCE), remove_first(stripped, fixed.SCALA_NEWLINE)).otherwise(s)


def after_marker(c: ColumnLike, marker: str = fixed.RESPONSE_MARKER) -> Column:
    """Text after the last ``marker`` (whole text when absent), stripped."""
    return ustrip(F.substring_index(_c(c), marker, -1))


def unescape_code(c: ColumnLike) -> Column:
    """Turn literal backslash-n / backslash-t sequences into newline / tab."""
    s = F.replace(_c(c), F.lit("\\n"), F.lit("\n"))
    return F.replace(s, F.lit("\\t"), F.lit("\t"))


def snippet_hash(prompt: ColumnLike, code: ColumnLike) -> Column:
    """sha256 hex of the UTF-8 bytes of prompt + code (no delimiter)."""
    return F.sha2(F.concat(_c(prompt), _c(code)), 256)


def error_cause(msg: ColumnLike) -> Column:
    """Last newline-separated piece of the message; ``Unknown error`` when empty."""
    m = _c(msg)
    return F.when(m.isNull() | (m == ""), F.lit(fixed.UNKNOWN_ERROR)) \
        .otherwise(F.substring_index(m, "\n", -1))


def error_cause_stripped(msg: ColumnLike) -> Column:
    """Interactive variant: strip first, then take the last line."""
    m = ustrip(F.coalesce(_c(msg), F.lit("")))
    return F.substring_index(m, "\n", -1)


def preview(c: ColumnLike, width: int = 50) -> Column:
    """At most ``width`` characters as is; otherwise the first width-3 plus '...'."""
    s = _c(c)
    return F.when(F.length(s) <= width, s) \
        .otherwise(F.concat(F.substring(s, 1, width - 3), F.lit("...")))


def transcript_prompt(c: ColumnLike) -> Column:
    """Prompt part of a decoded transcript, or the not-found placeholder."""
    x = ustrip(F.regexp_extract(_c(c), "(?is)" + fixed.TRANSCRIPT_PROMPT_PATTERN, 1))
    return F.when(x == "", F.lit(fixed.PROMPT_NOT_FOUND)).otherwise(x)


def transcript_code(c: ColumnLike) -> Column:
    """Code part of a decoded transcript, or the not-found placeholder."""
    x = ustrip(F.regexp_extract(_c(c), "(?is)" + fixed.TRANSCRIPT_CODE_PATTERN, 1))
    return F.when(x == "", F.lit(fixed.CODE_NOT_FOUND)).otherwise(x)


def last_human_turn(prompt: ColumnLike) -> Column:
    """Differential prompt: the text after the last ``Human: ``."""
    return F.substring_index(_c(prompt), fixed.HUMAN_PREFIX, -1)


def safe_rate(ok: ColumnLike, total: ColumnLike) -> Column:
    """ok / total, 0 when total is 0 or missing (ANSI division would raise)."""
    t = _c(total)
    return F.when(t > 0, _c(ok).cast("double") / t).otherwise(F.lit(0.0))


def run_label(rank: ColumnLike, alpha: ColumnLike, size: ColumnLike) -> Column:
    """``llama3.2-r={rank}-alpha={alpha}-training_size={size}``."""
    return F.concat(F.lit("llama3.2-r="), _c(rank).cast("string"),
                    F.lit("-alpha="), _c(alpha).cast("string"),
                    F.lit("-training_size="), _c(size).cast("string"))


def result_prefix(size: ColumnLike) -> Column:
    return F.concat(F.lit("after_finetuning_trainsize"), _c(size).cast("string"))


def normalize_role(c: ColumnLike) -> Column:
    """Map ShareGPT / chat spellings onto human / assistant / system."""
    mapping = F.create_map(*[F.lit(x) for kv in fixed.ROLE_ALIASES.items() for x in kv])
    r = F.lower(_c(c))
    return F.coalesce(mapping[r], r)


def format_fixed(c: ColumnLike, digits: int) -> Column:
    """Python's ``f"{x:.{digits}f}"`` for finite, non-negative doubles.

    Python rounds the exact binary value (ties to even); Spark's
    ``format_string``/``bround`` round its shortest decimal form, which
    differs for values like 0.00015 or 2.675.  Here ``x * 10^digits`` is
    split into its rounded product ``p`` plus the exact error ``err``
    (Dekker's product with a Veltkamp split; ``10^digits`` has few enough
    bits that its own split is exact), and the sign of
    ``(p - floor(p) - 0.5) + err`` -- exact, because the first term is exact
    and rounding never changes a sign -- decides the rounding.
    """
    assert 0 <= digits <= 8
    x = _c(c).cast("double")
    scale = float(10 ** digits)
    p = x * F.lit(scale)
    cx = x * F.lit(134217729.0)                       # 2^27 + 1
    hi = cx - (cx - x)
    lo = x - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)
    f = F.floor(p)
    t = (p - f - F.lit(0.5)) + err
    k = f + F.when(t > 0, 1).when(t < 0, 0).otherwise(f % 2)
    k = k.cast("long")
    if digits == 0:
        return F.format_string("%d", k)
    return F.format_string(f"%d.%0{digits}d", F.floor(k / F.lit(10 ** digits)).cast("long"),
                           (k % F.lit(10 ** digits)).cast("long"))


def word_tokens(c: ColumnLike) -> Column:
    """Word tokens of a text: the ordered rules of the Treebank-style tokenizer
    (quotes, punctuation, the final period, brackets, dashes, endings and
    contractions), then a cut at white space.  Null has none.

    ``a.b`` stays one token; only a period at the end of the text is split off.
    No sentence model is applied: the text counts as one sentence.  Every pattern
    is linear in the text's length.
    """
    text = F.coalesce(_c(c), F.lit(""))

    def applied(t: Column, needs: tuple, pattern: str, replacement: str) -> Column:
        if not needs:
            return F.regexp_replace(t, pattern, replacement)
        return bound(t, lambda x: F.when(reduce(or_, (F.contains(x, F.lit(n)) for n in needs)),
                                         F.regexp_replace(x, pattern, replacement)).otherwise(x))

    def padded(t: Column) -> Column:
        return F.concat(F.lit(" "), t, F.lit(" "))

    plain = F.split(F.regexp_replace(padded(F.regexp_replace(text, *fixed.PLAIN_RULE)), *fixed.PLAIN_END_RULE), " ")
    t = text
    for rule in fixed.WORD_RULES:
        t = applied(t, *rule)
    t = padded(t)
    for rule in fixed.WORD_END_RULES:
        t = applied(t, *rule)
    quoted = F.split(t, f"[{fixed.PY_WHITESPACE}]+")
    return F.array_remove(F.when(text.rlike("[\"'`]"), quoted).otherwise(plain), "")


def json_string(c: ColumnLike, ascii_only: bool = True) -> Column:
    """A text as a JSON string with its quotes, as Python's ``json`` writes it: short
    escapes, ``\\uXXXX`` for other control characters and, with ``ascii_only``, for all
    beyond ``~`` (two of them, a surrogate pair, beyond U+FFFF).  Null is ``null``."""
    t = _c(c)
    for plain, escaped in fixed.JSON_ESCAPES:
        t = F.replace(t, F.lit(plain), F.lit(escaped))

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def char(x: Column) -> Column:
        n = F.ascii(x)
        pair = F.concat(unit(F.shiftright(n - 0x10000, 10) + 0xD800), unit(n.bitwiseAND(0x3FF) + 0xDC00))
        odd = F.when(n < 0x10000, unit(n)).otherwise(pair)
        return F.when((n < 0x20) | (n > 0x7E), odd).otherwise(x) if ascii_only else F.when(n < 0x20, odd).otherwise(x)

    beyond = "[^\x20-\x7e]" if ascii_only else "[\x00-\x1f]"
    t = F.when(t.rlike(beyond), F.array_join(F.transform(F.split(t, ""), char), "")).otherwise(t)
    return F.coalesce(F.concat(F.lit('"'), t, F.lit('"')), F.lit("null"))
