"""The streaming form agrees with the batch operator."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.streaming import monitor


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_resample_stream(spark, tmp_path):
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=60, freq="10min"), "v": np.arange(60.0)})
    d = spark.createDataFrame(pdf)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = run(monitor.resample_stream(stream, ["k"], "ts", 1800, {"v": F.avg("v")}), "bins").toPandas().sort_values("ts")
    exp = pdf.set_index("ts").v.resample("30min").mean()
    # the last bins stay open until the watermark passes
    assert 0 < len(got) <= len(exp)
    np.testing.assert_allclose(got.v, exp.iloc[: len(got)])
