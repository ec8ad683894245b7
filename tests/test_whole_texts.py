"""Queries that the reference's operators run over whole texts, not over their first characters."""

from plumbline import catalog


def test_words_after_the_first_200_characters(spark, tmp_path):
    rows = [(1, " ".join(f"w{k % 90}" for k in range(400)) + "\n the  end"), (2, "  "), (3, None), (4, "short text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["rebuilt"] for r in catalog.QUERIES["inverted_index_reconstruct"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join((t or "").split()) or None for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in catalog.QUERIES["text_fields"](spark, str(tmp_path)).collect()}
    assert got[1].endswith(" the end")
