from chronoweave.operators.chunk import chunks
from chronoweave.streaming.follow import follow_documents


def test_stream_gives_the_batch_chunks(spark, tmp_path):
    rows = [(f"s{i}", f"t{i}", " ".join(f"w{i}x{j}" for j in range(200 + i))) for i in range(6)]
    df = spark.createDataFrame(rows, "source_id string, title string, text string")
    for i in range(2):
        df.where(f"substr(source_id, 2) % 2 = {i}").write.mode("append").parquet(f"{tmp_path}/in")
        follow_documents(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.select("chunk_id", "text").collect())) == sorted(map(tuple, chunks(df).select("chunk_id", "text").collect()))
