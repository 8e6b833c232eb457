"""The stored index against the texts themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fulltext, stemmers
from siltstone.operators.postings import TextIndex
from siltstone.plans import catalog
from siltstone.sources.shared import Workspace

SEARCHES = ["a", "a b", "a -b", '"a b"', '"a b c" or d', '-"a b"', "-a", "e or -d", 'a "c d" -e or b -"d e" "e a"', "zzz", "", '""', "a zzz", "or", "A B", "a-b", "-zzz"]
WORDS = "a b c d e".split()


def texts(n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts(200, 1)))
    return [*out, (500, None), (501, ""), (502, "A, b! c"), (503, "a " * 3000), (504, "a b")] + [(600 + k, "a a b") for k in range(100)]


@pytest.fixture(scope="module")
def index(spark, rows):
    made = TextIndex(spark, Workspace(spark, "index").root, buckets=4)
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "a b", "x")], "doc_id long, text string, term string")
    made.append(docs.repartition(3), section_bytes=2000)
    return made


def answer(text, search, analyser="simple"):
    """A plain reading of a search: word lists and slices."""
    stop, stem = fulltext.STOP_WORDS[analyser], stemmers.STEMMERS[analyser] or str
    words = [None if w in stop else stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]

    def holds(minus, raw):
        asked = [None if w in stop else stem(w) for w in re.findall(r"[^\W_]+", raw.lower())]
        while asked and asked[0] is None:
            asked = asked[1:]
        while asked and asked[-1] is None:
            asked = asked[:-1]
        if not asked:
            return None
        has = any(all(x is None or x == y for x, y in zip(asked, words[k : k + len(asked)], strict=False)) and len(words[k : k + len(asked)]) == len(asked) for k in range(len(words)))
        return has != bool(minus)

    groups = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', search):
        if word.lower() == "or" and not minus:
            groups.append([])
        else:
            groups[-1].append(holds(minus, phrase or word))
    groups = [[h for h in g if h is not None] for g in groups]
    return any(all(g) for g in groups if g)


@pytest.mark.parametrize("search", SEARCHES)
def test_searches(index, rows, search):
    found = [r["doc_id"] for r in index.search(search).collect()]
    assert sorted(found) == sorted(i for i, t in rows if answer(t, search))


def test_texts_are_not_read(index):
    plan = index.search('a "c d" -e')._jdf.queryExecution().toString()
    assert "postings" in plan and "text" not in plan and "NestedLoop" not in plan
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan) and "PushedFilters: [In(term" in plan


def test_frequent_terms_are_dealt_out(spark, index):
    """Postings of one term lie in many sections' files."""
    from pyspark.sql.functions import input_file_name

    files = index._read("postings", "term string, batch int, bucket int").where("term = 'a'").select(input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) >= 3


def test_ranks_and_lengths(spark, index, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", fulltext.lexemes("text"))
    want = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.round(fulltext.term_rank(F.col("w"), ["a", "d"]), 9).alias("s")).where("s > 0").collect()}
    assert {r["doc_id"]: r["s"] for r in index.term_ranks(["a", "d"]).select("doc_id", F.round("rank", 9).alias("s")).collect()} == want
    want = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.round(fulltext.rank(F.col("w"), ["b"]), 9).alias("s")).where("s > 0").collect()}
    assert {r["doc_id"]: r["s"] for r in index.shares(["b"]).select("doc_id", F.round("share", 9).alias("s")).collect()} == want
    assert index.frequencies(["a", "zzz"]) == {"a": sum("a" in re.findall(r"\w+", (t or "").lower()) for _, t in rows)}


def test_later_batches_are_found_and_replace(spark):
    path = Workspace(spark, "index").root
    first = TextIndex(spark, path, "english", buckets=3)
    assert first.search("run").count() == 0 and first.documents().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first.append(frame([(1, "They were running to the house"), (2, "a run of the mill"), (2, "a walk")]))
    again = TextIndex(spark, path, buckets=99)
    assert (again.analyser, again.buckets) == ("english", 3)
    ids = lambda search: sorted(r["doc_id"] for r in again.search(search).collect())
    assert ids("runs") == [1] and ids("the") == [] and ids('"run to the houses"') == [1] and ids('"run houses"') == []
    again.append(frame([(3, "Runners run; houses stand"), (4, "mills")]))
    assert ids("run") == [1, 3] and ids("house -running") == [] and ids("-house") == [2, 4]
    again.append(frame([(1, "no more of it"), (5, None)]))
    assert ids("run") == [3] and ids("more") == [1] and ids("-house") == [1, 2, 4, 5]
    assert {(r["doc_id"], r["length"]) for r in again.documents().collect()} == {(1, 4), (2, 2), (3, 4), (4, 1), (5, 0)}


def test_a_failed_batch_changes_nothing(spark):
    path = Workspace(spark, "index").root
    index = TextIndex(spark, path)
    index.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    bad = spark.createDataFrame([(2, "a")], "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error("lost")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        index.append(bad)
    assert [r["doc_id"] for r in index.search("a").collect()] == [1]
    assert index.append(spark.createDataFrame([(3, "a")], "doc_id long, text string")) == 2
    assert sorted(r["doc_id"] for r in index.search("a").collect()) == [1, 3]


@pytest.mark.parametrize("analyser", ["english", "french"])
def test_searches_by_stems(spark, analyser):
    rnd = random.Random(3)
    words = {"english": "runs running ran the of house houses housing control controlled controlling nation national".split(), "french": "chevaux cheval les de maison maisons continuer continue nation nationale".split()}[analyser]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for k in range(150)]
    index = TextIndex(spark, Workspace(spark, "index").root, analyser, buckets=4)
    index.append(spark.createDataFrame(rows, "doc_id long, text string"))
    for search in (words[0], f'"{words[0]} {words[5]}"', f'"{words[5]} {words[3]} {words[1]}" or {words[-1]}', f"{words[1]} -{words[6]}"):
        assert sorted(r["doc_id"] for r in index.search(search).collect()) == [i for i, t in rows if answer(t, search, analyser)]


def brute_covers(marks, most):
    """All least runs, by trying every run."""
    distinct = lambda a, b: len({m for m in marks[a : b + 1] if m is not None})
    runs = [(a, b) for a in range(len(marks)) for b in range(a, min(len(marks), a + most))]
    return sorted((distinct(a, b), a, b) for a, b in runs if distinct(a, b) and not any(a <= c and d <= b and (c, d) != (a, b) and distinct(c, d) >= distinct(a, b) for c, d in runs))


def test_covers_equal_brute_force():
    rnd = random.Random(9)
    for _ in range(400):
        marks = [rnd.choice([None, None, 0, 1, 2]) for _ in range(rnd.randint(0, 14))]
        most = rnd.randint(1, 8)
        assert sorted(fulltext.covers(marks, most)) == brute_covers(marks, most), (marks, most)


@pytest.mark.parametrize(
    ("text", "search", "want"),
    [
        ("x a y y b y a b z", "a b", "<b>a</b> y y <b>b</b> … <b>a</b> <b>b</b> z"),
        ("one two three four", "zzz", "one two three"),
        ("a x x x x x x b x x x c a", "a b c", "<b>a</b> x x … x <b>c</b> <b>a</b>"),
        ("", "a", ""),
        (None, "a", None),
        ("the Runners were running, houses!", "run house", "<b>running,</b> <b>houses!</b>"),
        ("a", "a", "<b>a</b>"),
    ],
)
def test_best_fragments(spark, text, search, want):
    column = fulltext.best_fragments(F.lit(text).cast("string"), search, "english" if "run" in search else "simple", words=4, least=2 if "run" in search else 3)
    assert spark.range(1).select(column.alias("h")).first()["h"] == want


@pytest.mark.parametrize(("name", "analyser", "search"), [("english_search", "english", 'things -being or "ends ands" or ering'), ("french_search", "french", '"dans les elle" or ourions -quement or ellement'), ("keyword_search", "simple", 'the "of the" -and or und nicht')])
def test_queries_equal_word_lists(spark, data, name, analyser, search):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = sorted(r["doc_id"] for r in docs if answer(r["text"], search, analyser))
    assert sorted(r["doc_id"] for r in catalog.QUERIES[name](spark, data).collect()) == want and want


def test_headlines_of_a_page(spark, data):
    rows = catalog.QUERIES["search_headlines"](spark, data).collect()
    assert 0 < len(rows) <= 50 and all("<b>" in r["headline"] for r in rows)
    assert all(len(r["headline"].replace(" … ", " ").split()) <= 70 for r in rows)


def test_texts_are_worked_on_in_slices():
    """A batch's words are never all held as numbers at once; terms are remembered, and how many is bounded."""
    import pyarrow as pa

    from siltstone.operators import postings

    words = pa.array([["a"] * 5, None, [], ["b"] * 9, ["c"] * 20, ["d"], ["e"]], pa.list_(pa.string()))
    assert [(s.start, s.stop) for s in postings._slices(words, 10)] == [(0, 3), (3, 4), (4, 5), (5, 7)]
    asked = {}
    for text in (["things", "ends"], ["things"]):
        made = postings._postings_of(pa.array([text]), pa.array([1]), "english", asked, by_term=True)
        assert made.column(0).to_pylist() == [stemmers.STEMMERS["english"](w) for w in text]
    assert set(asked) == {"things", "ends"}


def test_texts_are_split_into_words_once(spark, tmp_path):
    """A batch's texts are read to be counted and to be split; lengths come with the postings."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "c")], "doc_id int, text string").coalesce(1)
    index = TextIndex(spark, str(tmp_path))
    index.append(docs.select("doc_id", read("text").alias("text")))
    assert reads.value == 6
    assert {r["doc_id"]: r["length"] for r in index.documents().collect()} == {1: 3, 2: 0, 3: 1}
    assert index.frequencies(["a", "b", "c"]) == {"a": 1, "b": 1, "c": 1} and index._read("terms", "term string, documents bigint, batch int").count() == 3
