from siltstone.plans import queries

TEXTS = {
    1: "pressure relief valve, and nothing of the kind",
    2: "valves relief pressures",
    3: "relief of pressure by a valve",
    4: "x" * 40 + " Pressure Relief Valve",
    5: "the pressure relief valvelike",
    6: "a calliper gauge",
    7: None,
    8: "gauge for the caliper",
}


def test_the_phrase_and_its_place_count(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Pressure relief valves"), (2, "Caliper gauges"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in queries()["phrase_search"](spark, str(tmp_path)).collect())

    def score(doc, matched, n, phrase):
        at = TEXTS[doc].lower().replace("calliper", "caliper").find(phrase)
        return round(matched / n + (0.5 + 0.25 * (1 - at / len(TEXTS[doc])) if at >= 0 else 0), 6)

    first = [(1, 1, 1, score(1, 3, 3, "pressure relief valve")), (1, 2, 4, score(4, 3, 3, "pressure relief valve")), (1, 3, 5, score(5, 2, 3, "pressure relief valve"))]
    assert got == first + [(2, 1, 6, score(6, 2, 2, "caliper gauge")), (2, 2, 8, 1.0)]


def test_hybrid_ranks_by_the_phrase(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Pressure relief valves")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = [(r.doc_id, r.branch) for r in queries()["hybrid_search"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(1, "lexical"), (4, "lexical"), (5, "lexical")]
