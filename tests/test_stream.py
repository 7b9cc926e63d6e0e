from helpers import rows
from kontorium.streaming.phones import stream_contacts, stream_phones


def test_stream_equals_batch(spark, tmp_path):
    data = [(1, "f", 2, "x", "411 ::: n/a", None), (2, "f", 3, "SPAM", "411", None), (3, "f", 4, None, None, "+52 55 1234 5678")]
    schema = "row_id long, source_file string, source_row_number int, first_name string, phone_1_value string, phone_2_value string"
    df = spark.createDataFrame(data, schema)
    df.write.parquet(str(tmp_path / "in"))
    q = stream_phones(stream_contacts(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("phones_out").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("phones_out")) == rows(stream_phones(df))
    assert spark.table("phones_out").count() == 2
