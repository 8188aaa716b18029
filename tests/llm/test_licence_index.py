from skyquilt.llm import licences


def test_plan_does_not_grow_with_templates(spark):
    """Hundreds of templates are one constant: each is found at its place, and the plan has no more lines than with few."""
    many = [(f"l{i}", f"this text number w{i} is given under the terms of licence v{i} only", f"terms of licence v{i}") for i in range(400)]
    docs = spark.createDataFrame([(i, f"x {many[i * 40][1].upper()} y") for i in range(10)] + [(None, "terms of licence v7 and more"), (99, None)], "doc_id long, text string")
    few, all_ = licences.scan_licences(docs), licences.scan_licences(docs, notices=licences.NOTICES + many)
    lines = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert lines(few) == lines(all_)
    got = {r["doc_id"]: r for r in all_.collect()}
    assert [got[i]["labels"] for i in range(10)] == [f"l{i * 40}" for i in range(10)] and all(got[i]["score"] == 1 for i in range(10))
    assert got[None]["labels"] == "" and 0 < got[None]["score"] < 0.8 and got[99]["n_words"] == 0
