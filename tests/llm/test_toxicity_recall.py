"""What the toxicity scores find among the documents that are held out of their training, on the given labels."""

import pytest

from tessera.llm import toxicity

#: Folder: least share of held-out toxic documents found, most false alarms.
WANTED = {"/root/testdata/sf0.01": (14 / 18, 2), "/root/testdata/sf0.1": (0.72, 16)}


@pytest.mark.parametrize("folder", WANTED)
def test_held_out(spark, folder):
    least, most = WANTED[folder]
    got = toxicity.op9_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic.predicted.mean() >= least - 1e-9
    assert got[got.toxic == 0].predicted.sum() <= most
    print(folder, toxic.predicted.mean(), got[got.toxic == 0].predicted.sum(), len(toxic), (got.toxic == 0).sum())
