import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import test_decontaminate
import test_near_dup
import test_repeats

import corpus_pipeline as P
from strandset.llm.tokens import tokenizer_path


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from strandset.llm.toxicity import fit, toxicity

    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity(docs, model).where("predicted = 1").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        order = sorted(before)
        texts = [before[k].text for k in order]
        if name == "toxicity":
            want = {k: before[k].text for k in order if k not in toxic}
        elif name == "near_dup":
            want = {k: t for i, (k, t, (_, c)) in enumerate(zip(order, texts, test_near_dup.brute(texts))) if c == i}
        elif name == "repeats":
            want = dict(zip(order, test_repeats.brute(texts)))
        elif name == "decontaminate":
            want = {k: t for k, t, r in zip(order, texts, test_decontaminate.brute(texts, items)) if not r[4]}
        else:
            from zlib import crc32

            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
            pieces = {}
            for r in after.collect():
                pieces.setdefault(r.doc_id, []).append(r)
            assert pieces.keys() == before.keys()
            for k, t in zip(order, texts):
                data = np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
                own = sorted(pieces[k], key=lambda r: r.start)
                assert [r.ids_crc32 for r in own] == [crc32(data[4 * r.start : 4 * (r.start + r.length)]) for r in own]
                assert sum(r.length for r in own) * 4 == len(data)
            break
        assert after.columns == docs.columns
        got = {r.doc_id: r for r in after.collect()}
        assert {k: r.text for k, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values() if r.text)
        docs, before = after, got


#: Names that operators give to what they add, or use on the way.
CLASHING = ("score", "predicted", "held_out", "removed", "n_units", "n_removed", "n_words", "n_hit", "n_items", "spans", "items", "contaminated", "kept", "component_id", "n_shingles", "id", "clean", "later", "tie", "label", "item_id", "a.b", "length", "start", "sequence_id")


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_clashing_columns_repeated_rows_and_empty_tables(spark, sf, name, stage):
    """Stages keep what extra columns hold, whatever they are called; a repeated row goes or stays as its like does."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0")
    odd = spark.createDataFrame([(None, "no id at all", "en", "x", 12), (-5, None, "en", "x", None), (-6, "", "en", "x", 0)], plain.schema)
    plain = plain.unionAll(odd).unionAll(plain.where("doc_id % 30 = 0"))
    docs = plain.select("*", *[F.concat_ws("-", F.lit(c), "doc_id", "lang").alias(c) for c in CLASHING])
    got, want = stage(spark, docs, sf), stage(spark, plain, sf)
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.count() > 0
    assert stage(spark, docs.where("false"), sf).count() == 0
    if name != "packing":
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        for c in CLASHING:
            assert got.where(~F.col(f"`{c}`").eqNullSafe(F.concat_ws("-", F.lit(c), "doc_id", "lang"))).count() == 0
