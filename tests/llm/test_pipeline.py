import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from brute import jaccard_components, phrase_hits, removed, sha, words
from test_bpe import packed
from test_quality import judged

import corpus_pipeline
from rulelens.llm.bpe import parse_ranks
from rulelens.llm.queries import rank_file

PIECE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def expected(docs, items):
    docs = [(i, t) for i, t in docs if judged(t)[-1]]
    component = jaccard_components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if i is None or component[i] == i]
    gone, cut = removed(docs), []
    for at, (i, text) in enumerate(docs):
        if not gone[at]:
            cut.append((i, text))
        elif len(gone[at]) < len(words(text)):
            cut.append((i, "".join(w for k, w in enumerate(PIECE.findall(text)) if k not in gone[at]).lstrip(" \t\n\x0b\x0c\r")))
    out = []
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(rank_file()), special_tokens={})
    for i, text in cut:
        n, hit, _ = phrase_hits(text, items)
        if i is None or not (hit and 20 * len(hit) >= n):
            ids = encoding.encode_ordinary(text)
            out.append((i, text, len(ids), sha(packed(ids)), sha(text)))
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_run_equals_the_definition(spark):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = expected(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = "the words of this text are new and it is read by many of us who like to stay in with a book on long days of june"
    for rows in ([], [(None, None, None, None, None), (1, good, None, None, None), (None, good, "en", "s", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (2 if rows else 0)
