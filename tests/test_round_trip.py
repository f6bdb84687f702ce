"""The round trip of payloads goes through the payloads that were rewritten."""

from pyspark.sql import functions as F

from maskwell.plans import passes

SF_DIR = "/root/testdata/sf0.001"


def test_the_round_trip_reads_the_rewritten_payloads(spark, monkeypatch):
    made = passes._blinded_requests

    def broken(spark, sf_dir):
        blinded, chosen, sent = made(spark, sf_dir)
        # One rewritten payload loses a letter of its first message.
        cut = F.when(F.col("exchange_id") == first, F.regexp_replace("payload", r'(?<="(content|text)":")[A-Za-z]', "")).otherwise(F.col("payload"))
        return blinded.withColumn("payload", cut), chosen, sent

    whole = {r.exchange_id: r.same for r in passes.payload_round_trip(spark, SF_DIR).collect()}
    first = min(whole)
    assert all(whole.values()) and len(whole) == 20
    monkeypatch.setattr(passes, "_blinded_requests", broken)
    found = {r.exchange_id: r.same for r in passes.payload_round_trip(spark, SF_DIR).collect()}
    assert found == whole | {first: False}
