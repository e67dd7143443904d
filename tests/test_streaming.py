from ledgerloom.streaming.labelling import label_stream, write_labels


def test_stream_equals_batch(spark, tmp_path):
    schema = "txId long, class_label string, pred_proba double"
    rows = [(1, "Illicit", 0.1), (2, "Unknown", 0.9), (3, "Unknown", 0.1), (4, None, None)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(source)
    write_labels(label_stream(spark.readStream.schema(schema).parquet(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r.txId: r.final_class_label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.txId: r.final_class_label for r in label_stream(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == "Illicit" and got[2] == "Illicit" and got[3] == "Licit"
