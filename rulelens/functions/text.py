"""Text expressions. All are plain column expressions, so they stay in the JVM."""

from pyspark.sql import functions as F

from rulelens.functions.patterns import any_of
from rulelens.schemas import HASH_CHARS, SNIPPET_CONTEXT_LINES

# What ends a line besides LF (CR, VT, FF, FS, GS, RS, NEL, LS, PS) and what else is blank.
_ODD_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
_BLANKS = (
    "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)


def unify_breaks(content):
    """Every line boundary as LF. Most texts have no other one, which byte searches find out several times
    faster than a regex does."""
    unified = F.regexp_replace(content, "\r\n|[" + "".join(_ODD_BREAKS) + "]", "\n")
    return F.when(any_of([content.contains(b) for b in _ODD_BREAKS]), unified).otherwise(content)


def normalize_text(content):
    """Unify line breaks, strip blanks at line ends and trailing blank lines, end with one newline.

    Lines are trimmed natively one by one: a regex for blanks before a break looks at every blank of a text.
    """
    lines = F.transform(F.split(unify_breaks(content), "\n"), lambda line: F.rtrim(line, F.lit(_BLANKS)))
    return F.concat(F.rtrim(F.array_join(lines, "\n"), F.lit("\n")), F.lit("\n"))


def short_sha(text, chars):
    return F.left(F.sha2(text, 256), F.lit(chars))


def content_hash(content):
    """Hash that ignores line-end style, trailing blanks and trailing blank lines."""
    return short_sha(normalize_text(content), HASH_CHARS)


def rules_hash(rule_ids):
    """Order-independent hash of an array of rule ids; an empty array hashes the empty string."""
    return short_sha(F.array_join(F.array_sort(rule_ids), ","), HASH_CHARS)


def cache_key(content, rule_ids):
    return F.concat_ws(":", content_hash(content), rules_hash(rule_ids))


def line_count(content):
    """Newlines plus one."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def split_lines(content):
    """Array of lines at any line boundary, without an empty last line after a final break."""
    lines = F.split(unify_breaks(content), "\n")
    ended = any_of([content.endswith(b) for b in ["\n", *_ODD_BREAKS]]) | (content == "")
    return F.slice(lines, F.lit(1), F.size(lines) - ended.cast("int"))


def estimate_tokens(text):
    """About four characters per token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def snippet(lines, start_line, end_line=None, context=SNIPPET_CONTEXT_LINES):
    """Numbered lines around a range; `>` marks the lines inside it. End 0 or null means the start.

    `lines` is a column of split_lines, which is worth storing in a column of its own if it is used often.
    """
    end = start_line if end_line is None else F.coalesce(F.nullif(end_line, F.lit(0)), start_line)
    first = F.greatest(F.lit(0), start_line - F.lit(context + 1))
    last = F.least(F.size(lines), end + F.lit(context))

    def numbered(line, offset):
        number = first + offset + 1
        digits = number.cast("string")
        mark = F.when((number >= start_line) & (number <= end), ">").otherwise(" ")
        padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit(" "))
        return F.concat(mark, F.lit(" "), padded, F.lit(" | "), line)

    window = F.slice(lines, first + 1, F.greatest(last - first, F.lit(0)))
    return F.array_join(F.transform(window, numbered), "\n")
