from tolparse.plans import queries


def test_a_text_holds_all_suppliers_of_its_nation(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(7,), (8,), (9,)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    for code, own, count in ((queries.csharp_code, "struct S", {7: 2, 8: 1, 9: 0}), (queries.pascal_code, "function Q", {7: 2, 8: 1, 9: 0})):
        assert {r.doc_id: r.text.count(own) for r in code(spark, str(tmp_path)).collect()} == count
    for query in (queries.csharp_entities, queries.csharp_lr_entities, queries.csharp_baseline, queries.by_type_read):
        found = query(spark, str(tmp_path)).collect()
        assert {(r.doc_id, r.value) for r in found if r.type == "method"} == {(7, "M1"), (7, "M2"), (8, "M3")} and {(r.doc_id, r.value) for r in found if r.type == "class"} == {(7, "C7"), (8, "C8"), (9, "C9")}
    for query in (queries.pascal_entities, queries.pascal_baseline):
        assert {(r.doc_id, r.value) for r in query(spark, str(tmp_path)).collect() if r.type == "property"} == {(7, "P1"), (7, "P2"), (8, "P3")}
    lines = {r.doc_id: r.line for r in queries.entity_report(spark, str(tmp_path)).collect()}
    assert lines == {7: "***\nnation/7\nproperty\nP1\nproperty\nP2", 8: "***\nnation/8\nproperty\nP3", 9: "***\nnation/9"}
    assert {(r.doc_id, r.value) for r in queries.table_functions(spark, str(tmp_path)).collect()} == {(7, "C7"), (7, "M1"), (7, "M2"), (8, "C8"), (8, "M3"), (9, "C9")}
