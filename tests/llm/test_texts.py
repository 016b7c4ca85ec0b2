import random

import pytest

from goldenloom.llm import encoding, mixing, residue


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(encoding.read_ranks(encoding.vocabulary_path()), encoding.split_pattern())


def test_same_ids_as_the_library(encoder):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [" ", "\n\n  x", "<|endoftext|>", "étage naïf 日本語の文 👍🏽", "a" * 500, "".join(rng.choices("abc日é", k=700)), "don't  we'll"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == lib.encode_ordinary(t) and lib.decode(ids) == t


def test_scan_and_heap_merge_alike(encoder):
    rng = random.Random(2)
    for n in (1, 2, 30, 200):
        w = bytes(rng.choices(b"abehnot ", k=n))
        assert encoding.merge_scan(w, encoder.ranks) == encoding.merge_heap(w, encoder.ranks)


DOCS = "doc_id bigint, text string, source string, ids string, tokens string"


def test_empty_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None, None, "", ""), (2, "", None, "", ""), (3, "  ", None, "", ""), (3, "  ", None, "", "")], DOCS)
    got = [(r["doc_id"], r["ids"]) for r in encoding.encode_texts(df, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, [220, 220][: len(got[2][1])]), (3, got[2][1])] and got[2][1]
    assert encoding.encode_texts(df.limit(0), ["doc_id"]).count() == 0


def test_water_filling_clamps_and_passes_on():
    given = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert given["a"] == 10 and round(given["b"], 6) == 54 and round(given["c"], 6) == 36
    assert mixing.water_fill({"a": 1.0}, {"a": 0}, 5) == {"a": 0}


def test_mixture_report(spark):
    docs = spark.createDataFrame([(i, "one two three four", "a" if i < 30 else "b", "", "") for i in range(400)] + [(900, "x", None, "", ""), (901, None, "a", "", "")], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["a"]["repeats"] == 2.0 and not rows["a"]["reached"] and rows["none"]["repeats"] == 0.0
    assert abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9
    assert used.where("source = 'b' AND copies > 1").count() == 0 and used.where("source IS NULL").count() == 0


def test_shares_are_met_where_there_is_enough(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(1, 40)), "abc"[i % 3], "", "") for i in range(900)], DOCS)
    targets = spark.createDataFrame([("a", 0.11, 3), ("b", 0.33, 2), ("c", 0.56, 2)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(docs, targets)
    for r in report.collect():
        assert r["reached"] and abs(r["actual_share"] - r["target_share"]) < 0.003 and r["repeats"] <= r["max_repeats"]
    again = mixing.mixture(docs.repartition(7), targets)[0]
    assert {tuple(r) for r in used.collect()} == {tuple(r) for r in again.collect()}
    most = {r["source"]: r["n"] for r in used.selectExpr("source", "copies").groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "n").collect()}
    assert all(most[s] <= cap for s, cap in (("a", 3), ("b", 2), ("c", 2)))


CASES = ["Dear {{name}},\nYour tax number [INSERT TAX NUMBER] was accepted on 2024-01-01.", "Dear ,\nReference  stays valid for all mail from .", "Lorem ipsum dolor sit amet elit.",
         "HTTP 404 - Not Found", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Real sentence about stock.\nYour session has expired.", "qwer asdf jkl qwer"]
FINE = ["Dear Ann Lee,\nYour tax number 123 was accepted on 2024-01-01.", "During the review we removed lorem ipsum from 3 supplier descriptions that a web form had left behind.",
        "Ann reported a 404 Not Found when opening the page of Oak; the link had a trailing blank and works again.", "Release note: the portal needs JavaScript from version 6 on, and stewards in Oslo have been told.", "", " \n", "company"]
PLAIN = [f"The {a} of {b} arrived from the {c} and disagrees with what the register holds since May, so please keep the company and the name for review by {b}."
         for a in ("trust score", "address", "phone", "company", "supplier") for b in ("Oslo", "Rome", "Lima") for c in ("feed", "desk", "portal", "page")]


def test_residue_cases(spark):
    docs = [(i, t, None, "", "") for i, t in enumerate(CASES + FINE + PLAIN * 6)] + [(9999, None, None, "", "")]
    got = {r["doc_id"] for r in residue.classify(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == set(range(len(CASES)))


def test_a_third_of_all_documents_may_hold_one_residue(spark):
    docs = [(i, "Loading...", None, "", "") for i in range(100)] + [(1000 + i, t, None, "", "") for i, t in enumerate(PLAIN)]
    got = {r["doc_id"] for r in residue.classify(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == set(range(100))


def test_gaps_have_no_greatest_length(spark):
    docs = [(1, "Dear {{ " + "customer name or the like " * 9 + "}},", None, "", "")] + [(1000 + i, t, None, "", "") for i, t in enumerate(PLAIN)]
    assert [r["doc_id"] for r in residue.classify(spark.createDataFrame(docs, DOCS)).collect()] == [1]


def test_kept_and_found_share_out_all_documents(spark, tmp_path):
    docs = [(i, t, "s", "", "") for i, t in enumerate(CASES + FINE + PLAIN + [None, ""])]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"] for r in residue.QUERIES["p10_found"](spark, str(tmp_path)).collect()}
    kept = {r["doc_id"] for r in residue.QUERIES["p10_kept"](spark, str(tmp_path)).collect()}
    assert found and not found & kept and found | kept == set(range(len(docs)))


def test_a_very_long_line_is_cut_into_spans(spark):
    long = "the register of the desk holds many words and names " * 3000
    docs = [(1, long, None, "", ""), (2, long + " Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", None, "", "")] + [(1000 + i, t, None, "", "") for i, t in enumerate(PLAIN)]
    assert [r["doc_id"] for r in residue.classify(spark.createDataFrame(docs, DOCS)).collect()] == [2]


def test_residue_of_an_empty_table(spark):
    assert residue.classify(spark.createDataFrame([], DOCS)).count() == 0
