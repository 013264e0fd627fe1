"""Texts of no known language are rejected, held-out documents stay."""

import base64
import random
import string

import pytest

from pyspark.sql import functions as F

from lotlens.llm import decontaminate, langid

IT = "La vita è bella quando il sole sorge sopra le colline e gli uccelli cantano nei boschi vicini. Ogni mattina mia nonna preparava il caffè e raccontava storie di quando era bambina nella campagna toscana. "
PL = "W małym miasteczku na wschodzie mieszkał stary zegarmistrz, który codziennie otwierał swój warsztat o świcie. Ludzie przychodzili do niego z daleka, żeby naprawić zegarki i posłuchać jego opowieści o dawnych czasach. "
FI = "Vanha kalastaja asui yksin pienessä mökissä järven rannalla ja lähti joka aamu soutamaan ennen auringonnousua. Hänen verkkonsa olivat usein tyhjät, mutta hän ei koskaan valittanut kohtalostaan kenellekään. "
GR = "Ο γέρος ψαράς ζούσε μόνος του σε ένα μικρό σπίτι δίπλα στη θάλασσα και κάθε πρωί έβγαινε με τη βάρκα του. "
ZH = "老渔夫独自住在海边的小屋里，每天早上天还没亮就出海打鱼。"


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_strange_texts_go_and_held_out_documents_stay(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    model, draw = langid.fit(docs), random.Random(1)
    letters = " ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randrange(2, 10))) for _ in range(200))
    strange = [letters, base64.b64encode(draw.randbytes(900)).decode(), IT, IT * 5, PL, PL * 5, FI, FI * 5, GR, ZH]
    assert [p[2] for p in model.predict(strange)] == [True] * len(strange)
    assert langid.languages(docs, model).filter("held_out and rejected and lang_pred <> 'und'").count() == 0
    assert (model.bounds[langid.LONG :] < 0.7).all()


def test_sample_is_bounded_for_null_and_repeated_ids(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "one text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    training = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    assert 100 < langid.training_sample(training, 300).count() < 400


def test_names_with_dots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("a.b", F.lit(1))
    assert langid.accepted(docs).columns == docs.columns and langid.accepted(docs).count() > 150
    assert decontaminate.clean(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).columns == docs.columns
