"""Small builders and plain-Python counterparts the tests compare with."""

import hashlib

from rulelens.functions.findings import with_issue_id
from rulelens.schemas import FINDINGS


def finding(rule_id="a/x", level="major", path="p.txt", line=1, end=None, title="t", confidence=1.0, **more):
    row = dict.fromkeys(FINDINGS.fieldNames())
    row.update(
        rule_id=rule_id, level=level, path=path, start_line=line, end_line=end, title=title, why="w", do=["d"],
        pack="p", source="llm", confidence=confidence, tags=[],
    )
    row.update(more)
    return tuple(row.values())


def findings_df(spark, rows):
    return with_issue_id(spark.createDataFrame(rows, FINDINGS))


def sha(text, chars):
    return hashlib.sha256(text.encode()).hexdigest()[:chars]


def tidy(text):
    """Lines without trailing blanks, no trailing blank lines, one final newline."""
    return "\n".join(line.rstrip() for line in text.splitlines()).rstrip() + "\n"
