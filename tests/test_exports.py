"""All formats of a document's sentences come from one gathering of them."""

from lectern.registry import QUERIES


def test_sentences_are_gathered_once_for_all_formats(spark, tmp_path):
    spark.createDataFrame([(1, 'A "b" c\\d. Second\nThird', "en", "s", 22), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["SRC13"](spark, str(tmp_path))
    assert {r.format: r.body for r in out.where("doc_id = 1").collect()} == {
        "txt": 'A "b" c\\d\nSecond\nThird',
        "md": '- A "b" c\\d\n- Second\n- Third',
        "csv": '1,"A ""b"" c\\d"\n2,"Second"\n1,"Third"',
        "json": '{"n":1,"text":"A \\"b\\" c\\\\d"}\n{"n":2,"text":"Second"}\n{"n":1,"text":"Third"}',
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
