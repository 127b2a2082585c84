"""Tables written on the way and what a stage leaves behind."""

import glob

import pyarrow.parquet as pq
from pyspark import Broadcast, SparkContext

from procura.llm import language
from procura.llm.common import written


def test_texts_on_the_way_are_packed_with_zstd(spark):
    rows = spark.createDataFrame([(1, "ein Text " * 50), (2, None)], "doc_id long, text string")
    found = written(rows)
    assert sorted(found.collect()) == sorted(rows.collect())
    files = [f for p in found.inputFiles() for f in glob.glob(p.removeprefix("file://"))]
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files if pq.ParquetFile(f).metadata.num_rows]
    assert groups and {g.column(c).compression for g in groups for c in range(2)} == {"ZSTD"}


def test_accepted_sends_its_tables_once_and_lets_them_go(spark, monkeypatch):
    sent, gone = [], []
    send, destroy = SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(self) or destroy(self, *a))
    words = {"de": "der Hund und die Katze gehen nach Hause", "es": "el perro y la gata van a la casa"}
    docs = spark.createDataFrame([(i, words[lang], lang) for i in range(12) for lang in words], "doc_id long, text string, lang string")
    found = language.accepted(docs)
    assert len(sent) == 1 and gone == sent
    assert sorted(found.collect()) == sorted(docs.collect())
