"""Path globs and content regexes as Spark predicates.

They are built as SQL text: a few hundred rules become one expression that is parsed once, where building it
call by call would take seconds on the driver.
"""

import re
from functools import reduce
from operator import or_
from re._constants import LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN
from re._parser import parse

_GLOB_TOKEN = re.compile(r"(?P<star>\*+)|(?P<one>\?)|\[(?P<neg>!?+)(?P<set>\]?[^\]]+|\])\]|(?P<char>.)", re.S)
_MAGIC = re.compile(r"[*?\[]")


def _char_set(negated, body):
    parts = []
    for item in re.findall(r"(?s).-.|.", body):
        if len(item) == 3 and item[0] > item[2]:
            continue  # an empty range matches nothing
        ends = [c if c.isalnum() else "\\" + c for c in (item[0], item[-1])]
        parts.append("-".join(ends) if len(item) == 3 else ends[0])
    if not parts:
        return "." if negated else "(?!)"
    return "[" + ("^" if negated else "") + "".join(parts) + "]"


def glob_to_regex(glob):
    """Shell-style glob as an anchored regex. `*` also crosses `/`, so `**/x` needs one `/`."""

    def one(token):
        if token["star"]:
            return ".*"
        if token["one"]:
            return "."
        if token["set"]:
            return _char_set(token["neg"], token["set"])
        return re.escape(token["char"])

    return r"(?s)\A" + _GLOB_TOKEN.sub(one, glob) + r"\z"


def sql_text(value):
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def glob_match(text, glob):
    """SQL predicate for one glob over the SQL expression `text`. Plain suffix, prefix and literal globs need
    no regex."""
    if not _MAGIC.search(glob):
        return f"{text} = {sql_text(glob)}"
    core = glob.strip("*")
    if _MAGIC.search(core):
        return f"{text} RLIKE {sql_text(glob_to_regex(glob))}"
    if not core:
        return f"{text} IS NOT NULL"
    test = "contains" if glob[0] == glob[-1] == "*" else "endswith" if glob[0] == "*" else "startswith"
    return f"{test}({text}, {sql_text(core)})"


_UNICODE_SENSITIVE = re.compile(r"\\[wWdDsSbB]|\(\?[a-zA-Z]*i")


def _outside_java(pattern):
    """Write what Java reads otherwise in Java's way: `[` and `&&` in a class, `{,n}`, a leading `]`, comments."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        elif inside:
            out.append("\\" + char if char in "[&" else char)
            inside = char != "]"
            at += 1
        elif char == "[":
            start = re.match(r"\[\^?\]?", pattern[at:])[0]
            out.append(start.replace("]", "\\]"))
            at, inside = at + len(start), True
        elif re.match(r"\(\?#[^)]*\)", pattern[at:]):
            at = pattern.index(")", at) + 1
        else:
            short = re.match(r"\{,(\d+)\}", pattern[at:])
            out.append(f"{{0,{short[1]}}}" if short else char)
            at += len(short[0]) if short else 1
    return "".join(out)


def java_pattern(pattern):
    """A Python `re.search` pattern for Spark: only `\\n` ends a line, classes are Unicode-aware."""
    pattern = _outside_java(pattern)
    flags = "(?dU)" if _UNICODE_SENSITIVE.search(pattern) else "(?d)"
    pattern = re.sub(r"(?s)\\(.)", lambda m: r"\z" if m[1] == "Z" else m[0], pattern)
    return flags + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def _literal_runs(items):
    """Texts that every match of a parsed pattern must contain."""
    run = ""
    for op, value in items:
        if op is LITERAL:
            run += chr(value)
            continue
        yield run
        run = ""
        if op is SUBPATTERN and not value[1] & re.IGNORECASE:
            yield from _literal_runs(value[3])
        elif op in (MAX_REPEAT, MIN_REPEAT) and value[0] > 0:
            yield from _literal_runs(value[2])
    yield run


def required_literal(pattern):
    """The longest text every match must contain, or an empty string if there is none to be sure of."""
    try:
        tree = parse(pattern)
    except (re.error, OverflowError):
        return ""
    return "" if tree.state.flags & re.IGNORECASE else max(_literal_runs(tree), key=len)


def regex_match(text, pattern):
    """SQL predicate for `re.search`. A text without the pattern's fixed part is ruled out by a byte search,
    which is far cheaper than decoding the text for the regex engine."""
    found = f"{text} RLIKE {sql_text(java_pattern(pattern))}"
    literal = required_literal(pattern)
    return f"(contains({text}, {sql_text(literal)}) AND {found})" if literal else found


def any_sql(predicates):
    return "(" + " OR ".join(predicates) + ")"


def path_trigger(path, globs):
    """SQL predicate: true for no globs, else if any glob matches the whole path."""
    return any_sql(glob_match(path, g) for g in globs) if globs else "true"


def content_trigger(content, regexes):
    """SQL predicate: true for no regexes, else if any regex is found in the text."""
    return any_sql(regex_match(content, r) for r in regexes) if regexes else "true"


def any_of(predicates):
    return reduce(or_, predicates)
