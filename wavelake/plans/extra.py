"""Queries without SQL: files, generators and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavelake.functions import waveforms
from wavelake.operators import plugins
from wavelake.plans.base import query, table
from wavelake.shared import expire, shared_dir
from wavelake.sources import iq
from wavelake.streaming import audit_log


#: Values of vec_id for each capture of iq_file_roundtrip: 17 MB at 64 floats each, below the reader's limit.
CAPTURE_VECS = 65_536


@query()
def iq_file_roundtrip(spark, sf_dir):
    """The embeddings of a label as captures of 32-sample windows, one for each block of vec_id, written and read back."""
    e = table(spark, sf_dir, "embeddings")
    half = lambda k: F.transform(F.filter("embedding", lambda _, i: i % 2 == k), lambda x: x.cast("float"))
    label = F.coalesce(F.concat(F.lit("label"), F.col("label").cast("string")), F.lit("None"))
    place = F.pmod("vec_id", F.lit(CAPTURE_VECS))
    block = F.coalesce((F.col("vec_id") - place).cast("string"), F.lit("0"))
    rows = e.select(F.concat(label, F.lit("_"), block).alias("name"), place.cast("int").alias("chunk_idx"), half(0).alias("i"), half(1).alias("q"), F.lit("demo").alias("source"), F.lit("mod").alias("block_name"), F.lit("FM").alias("expected_family"), F.lit("NBFM_25").alias("expected_order"), F.lit(48000).alias("sample_rate_hz"))
    path = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    expire(spark, path)
    iq.write_captures(rows, path)
    back = iq.read_captures(spark, path, size=32)
    power = F.aggregate(F.zip_with("i", "q", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x.cast("double")) / 32
    return back.groupBy(F.regexp_extract("path", "([^/]+)_-?\\d+\\.iq$", 1).alias("name")).agg(F.count("i").alias("windows"), F.round(F.avg(power), 4).alias("power"), F.max("error").alias("error"))


@query()
def synth_grid(spark, sf_dir):
    """Synthetic windows at high SNR: envelope variation by class."""
    x = waveforms.generate(spark, per_snr=4, snrs=[30])
    a = F.zip_with("i", "q", lambda p, q: F.sqrt((p * p + q * q).cast("double")))
    mean = F.aggregate(F.col("a"), F.lit(0.0), lambda s, v: s + v) / F.size("a")
    return x.select("class", "family", a.alias("a")).groupBy("class", "family").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(mean), 3).alias("envelope"))


@query()
def synth_verify(spark, sf_dir):
    return waveforms.verify(spark)


@query()
def eight_carrier_plugin(spark, sf_dir):
    """The multi-carrier plugin on two captures: eight carriers, and one."""
    def make(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for k in pdf["id"]:
                x = _carriers(24 * 1024, np.random.default_rng(int(k)), None if k == 0 else [650.0]).reshape(-1, 1024)
                out += [(f"capture{k}", n, w.real.astype(np.float32), w.imag.astype(np.float32)) for n, w in enumerate(x)]
            yield pd.DataFrame(out, columns=["path", "chunk_idx", "i", "q"])

    chunks = spark.range(2).mapInPandas(make, "path string, chunk_idx int, i array<float>, q array<float>")
    return plugins.apply(chunks, "sleipnir_8qpsk").select("path", "pass_overall", "carrier_count", F.round("confidence", 3).alias("confidence"))


_carriers = waveforms.eight_carriers


@query()
def audit_stream(spark, sf_dir):
    """Daily counts of the event log through a stream that reads all there is."""
    e = table(spark, sf_dir, "events")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    expire(spark, root)
    e.select("event_id", "ts", "event_type").write.parquet(f"{root}/in")
    source = audit_log.read(spark, f"{root}/in", spark.read.parquet(f"{root}/in"))
    audit_log.run_available(audit_log.daily_counts(source), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")
