import random

from helpers import sha, tidy
from pyspark.sql import functions as F

from rulelens.functions.text import (
    cache_key,
    content_hash,
    estimate_tokens,
    line_count,
    normalize_text,
    rules_hash,
    snippet,
    split_lines,
)

EDGES = [
    "", " ", "\n", "\n\n", "a", "a\n", "a  \n", "a\t \n\n\n", "a\r\nb\rc\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\x1fe \x1f\n",
    "a\x85b c d", "a　\nb​\n", "a \n", "  indented\n", "a \r\n \r\n", "x\n \n y \n", "é ü ñ \n",
]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", "　", "​", "é", "\u1680", "\u2000", "\u2007", "\u200a", "\u202f", "\u205f", "\u2028", "\u180e", "\xa0"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(n)]


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


def test_normalising_equals_plain_python(spark):
    texts = EDGES + random_texts(800)
    assert values(spark, texts, normalize_text(F.col("c"))) == [tidy(t) for t in texts]
    assert values(spark, texts, content_hash(F.col("c"))) == [sha(tidy(t), 32) for t in texts]


def test_long_blank_runs_stay_linear(spark):
    text = "a" + " " * 200_000 + "b" + "\n" * 200_000 + "c"
    assert values(spark, [text], F.length(normalize_text(F.col("c")))) == [400_004]


def test_lines_equal_splitlines(spark):
    texts = EDGES + random_texts(300, 5)
    assert values(spark, texts, split_lines(F.col("c"))) == [t.splitlines() for t in texts]
    assert values(spark, texts, line_count(F.col("c"))) == [t.count("\n") + 1 for t in texts]


def test_rules_hash_ignores_order_and_hashes_empty(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],), ([],)], "ids array<string>")
    got = [r[0] for r in df.select(rules_hash(F.col("ids"))).collect()]
    assert got[0] == got[1] == sha("a,b", 32)
    assert got[2] == sha("", 32)
    key = df.limit(1).select(cache_key(F.lit("x"), F.col("ids"))).first()[0]
    assert key == sha("x\n", 32) + ":" + sha("a,b", 32)


def plain_snippet(text, start, end=None, around=2):
    lines = text.splitlines()
    end = end or start
    out = []
    for number in range(max(1, start - around), min(len(lines), end + around) + 1):
        out.append(f"{'>' if start <= number <= end else ' '} {number:4d} | {lines[number - 1]}")
    return "\n".join(out)


def test_snippet(spark):
    text = "\n".join(f"line {i}" for i in range(1, 12_004)) + "\n"
    cases = [(1, None), (1, 0), (2, 2), (5, 7), (12_002, None), (12_003, 12_009), (13_000, None), (3, None)]
    df = spark.createDataFrame([(i, text, s, e) for i, (s, e) in enumerate(cases)], "i int, c string, s int, e int")
    got = df.select("i", snippet(split_lines(F.col("c")), F.col("s"), F.col("e"))).orderBy("i").collect()
    assert [r[1] for r in got] == [plain_snippet(text, s, e) for s, e in cases]
    assert df.limit(1).select(snippet(split_lines(F.lit("a\nb")), F.lit(2))).first()[0] == "     1 | a\n>    2 | b"


def test_tokens(spark):
    assert values(spark, ["", "abc", "abcd", "éééééééé"], estimate_tokens(F.col("c"))) == [0, 0, 1, 2]
