"""Searches over posting tables, budgets and token limits on hand-made rows, against brute force."""

import math

from recall_spark.functions import text as T
from recall_spark.operators import postings as N
from recall_spark.operators import records as R
from recall_spark.operators import search as S

DOCS = [(1, "the cat and the dog"), (2, "The dog, the cat!"), (3, None), (4, ""), (5, "sub-agent of the sub agent"), (6, "dog dog dog cat"), (7, "漢字検索のテスト text"), (8, "検索漢字 Text"), (9, "漢字 検索"), (10, "字"), (11, "a漢b字c")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_postings(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    index = N.index_words(docs, "doc_id", "text")
    queries = spark.createDataFrame([(1, ["the", "cat", "the"]), (2, ["sub", "agent"]), (3, ["dog"]), (4, ["nowhere", "dog"]), (5, [])], "query_id long, terms array<string>")
    found = {(r.query_id, r.doc_id) for r in N.matches(index, queries).collect()}
    assert found == {(1, 1), (1, 2), (2, 5), (3, 1), (3, 2), (3, 6)}
    assert [r.doc_id for r in N.best(N.matches(index, queries), "doc_id", 1).orderBy("query_id").collect()] == [2, 5, 6]
    side_by_side = spark.createDataFrame([(1, ["the", "dog"]), (2, ["sub", "agent"]), (3, ["dog", "dog"]), (4, ["dog"])], "query_id long, terms array<string>")
    assert rows(N.phrases(index, side_by_side)) == [(1, 1, 1), (1, 2, 1), (2, 5, 2), (3, 6, 2), (4, 1, 1), (4, 2, 1), (4, 6, 3)]
    empty = N.index_words(docs.limit(0), "doc_id", "text")
    assert N.matches(empty, queries).collect() == []


def test_cjk(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    grams = N.index_cjk(docs, "doc_id", "text")
    ask = lambda q, size: sorted(r.doc_id for r in N.search_cjk(grams, docs, "doc_id", "text", spark.createDataFrame([(1, q)], "query_id long, text string"), size).collect())
    assert ask("漢字検索", 4) == [7] and ask("字検索の方", 4) == [7]
    assert ask("漢字検索", 2) == [7, 8, 9] and ask("漢字 検索 TEXT", 2) == [7, 8]
    assert ask("字", 2) == [7, 8, 9, 10, 11] and ask("漢字", 4) == [] and ask("no signs", 2) == []
    assert ask("検索漢 漢字検", 4) == [] and ask("%", 2) == []


def test_budget_passes_over_what_is_too_large(spark):
    ranked = [(1, 1, 50), (1, 2, 5000), (1, 3, 20), (2, 1, 9999), (2, 2, 10), (3, 1, 60), (3, 2, 50), (3, 3, 1), (4, 1, None)]
    df = spark.createDataFrame(ranked, "query_id long, rank long, token_count long")
    queries = spark.createDataFrame([(1, 5), (2, 0), (3, 0), (4, 0)], "query_id long, asked long")
    assert rows(R.fit_budget(df, queries, 100).select("query_id", "rank")) == [(1, 1), (1, 3), (2, 2), (3, 1), (4, 1)]


def weight(c):
    o = ord(c)
    cjk = any(a <= o <= b for a, b in T._CJK_POINTS)
    return 1.5 if cjk else 2.0 if o >= 0x10000 else 0.25


def test_token_estimates_and_limits(spark):
    texts = ["plain text", "漢字" * 20, "a漢🙂b" * 9, "🙂" * 10, "", None, "ab" + "𠀀" * 5, "ｆｕｌｌ width", "x" * 1000, "한글 ひらがな カタカナ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r for r in df.select("i", T.estimate_tokens("t").alias("n"), *[T.truncate_to_tokens("t", k).alias(f"k{k}") for k in (0, 1, 10, 13)]).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].n is None and got[i].k10 is None
            continue
        assert got[i].n == math.ceil(sum(map(weight, t)))
        for k in (0, 1, 10, 13):
            best = max(n for n in range(len(t) + 1) if math.ceil(sum(map(weight, t[:n]))) <= k)
            assert got[i][f"k{k}"] == t[:best]


def test_patterns_that_repeat_a_repetition():
    for bad in ("(a+)+", "((a+))+", "(a{1,})+", "(x(a*)y)*", "(?:a|b+)*", "((a+)b){2,}"):
        assert S.repeats_a_repetition(bad), bad
    for good in ("a+b*", "(ab)+", "[(+]+", r"\(a+\)+", "(a|b)+c*", "a{2,3}", "(a+)b+", "(a+)(b)+"):
        assert not S.repeats_a_repetition(good), good


def test_parsed_and_like_terms(spark):
    assert S.parse_query('The "sub-agent  x" the ?! "" cat') == ["the", "sub-agent  x", "cat"]
    assert S.like_terms(["The,", "THE", "?!", "(sub-agent)"]) == ["the", "sub-agent"]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert [r.doc_id for r in S.like_search(docs, "doc_id", "text", ["DOG!", "cat"], 2).collect()] == [6, 2]
    assert S.like_search(docs, "doc_id", "text", ["?"], 5).collect() == []
    queries = spark.createDataFrame([(1, ["dog"])], "query_id long, terms array<string>")
    assert [r.doc_id for r in S.bm25(docs, "doc_id", "text", queries, 1).collect()] == [6]
