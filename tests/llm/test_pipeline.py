import corpus_pipeline
import numpy as np
import pytest

from profuse.llm import components, pii

from . import test_linerules, test_packing, test_simhash
from .conftest import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = str(folder / name)
        stage(spark, docs, SF).write.parquet(out)
        found.append((name, docs, spark.read.parquet(out)))
        docs = found[-1][2]
    return {name: (before, after) for name, before, after in found}


def test_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_quality(stages):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in stages["quality"])
    assert set(after) <= {k for k, t in before.items() if not test_linerules.brute(t)[5]} and len(after) > 0.7 * len(before)
    assert all(set(after[k].split("\n")) <= set(before[k].split("\n")) for k in after)


def test_personal_data(stages):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in stages["personal_data"])
    assert set(before) == set(after)
    clean = {r["doc_id"] for r in pii.find(stages["personal_data"][0]).where("size(spans) = 0").collect()}
    assert all(before[k] == after[k] for k in clean) and all(before[k] != after[k] for k in set(before) - clean)
    assert pii.find(stages["personal_data"][1]).where("size(base) > 0").count() == 0


def test_mixture_and_packing(stages):
    before, after = (x.collect() for x in stages["mixture"])
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) > len(before) / 2
    test_packing_rows = stages["packing"][1].collect()
    assert sum(r["length"] for r in test_packing_rows) == sum(len(x) for x in test_packing.plain_ids([r["text"] for r in after]))


def test_run_and_odd_rows(spark, odd, empty, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()


def test_similar_texts_are_duplicates(stages):
    """Groups link prints within 3 bits and texts whose 5-word sets have a similarity of 0.8 or more."""
    before, after = (x.collect() for x in stages["near_duplicates"])
    sets = [test_simhash.brute_set(r["text"]) for r in before]
    prints = np.array([test_simhash.brute_print(r["text"]) for r in before], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    near |= np.array([[bool(a) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    keys, parent = [r["doc_id"] for r in before], np.arange(len(before))
    components.merge(parent, *np.nonzero(near))
    least = {}
    for k, p in zip(keys, parent):
        least[p] = min(k, least.get(p, k))
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in least.values())
