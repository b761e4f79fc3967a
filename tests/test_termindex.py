import pytest
from pyspark.sql import functions as F

from palaver.operators import lexical, termindex

LONG = "donaudampfschifffahrtskapitaen"  # 30 letters


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"the {LONG} waves", "a"), (2, f"{LONG[:26]} only", "a"), (3, f"{LONG}s hat and {LONG}", "a"), (4, "waves", f"{LONG}/cap"), (5, "utf8 waves", "a"), (6, "utf 8 waves", "a"), (7, None, None)]
    return lexical.prepare(spark.createDataFrame(rows, "key int, body string, project string").withColumns({"title": F.lit(None).cast("string"), "summary": F.lit(None).cast("string")}))


def keys(found):
    return sorted(r.key for r in found.collect())


def test_words_longer_than_terms(docs):
    index = termindex.terms(docs)
    word = lexical.parse(LONG).words[0]
    assert sorted(map(tuple, termindex.prefix_tf(index, word, docs).collect())) == [(1, 1), (3, 2)]
    assert keys(termindex.candidates(index, [word], docs)) == [1, 3]
    assert keys(termindex.candidates(index, ["waves", word], docs)) == [1]
    assert keys(termindex.prefix_tf(index, word[:24])) == [1, 2, 3]
    assert keys(termindex.candidates(index, ["utf8"], docs)) == [5]
    for look in (lambda: termindex.prefix_tf(index, word), lambda: termindex.candidates(index, [word])):
        with pytest.raises(ValueError):
            look()


def test_candidates_agree_with_the_gate(docs):
    index = termindex.terms(docs, termindex.SEARCHED)
    for words in ([LONG], ["waves", LONG], ["cap"], ["cap", "wave"], ["utf8"], ["waves"]):
        want = docs.where(lexical.gate(tuple(words))[1])
        assert keys(termindex.candidates(index, words, docs, termindex.SEARCHED)) == keys(want), words
