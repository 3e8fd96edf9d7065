import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

import __spark_entry__ as E
import corpus_pipeline as cp
from fleetstops.llm import byte_bpe, mixing, toxicity
from fleetstops.llm.common import shared_path, table
from tests.llm.conftest import SMALL
from tests.llm.test_simhash import joined, slow_fingerprint
from tests.oracle_check import duck, normalise


def test_stages_against_brute_force(spark):
    """run() gives what plain Python gives from the model's scores on."""
    docs = table(spark, SMALL, "documents")
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    scorer = toxicity.Scorer(model.base, tuple(model.weights.items()))
    rows = [r for r in docs.collect() if scorer.score(r.text) < toxicity.CUT]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    rows = list(first.values())
    fps = [slow_fingerprint(r.text) for r in rows]
    root = joined(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = defaultdict(list)
    for r, k in zip(rows, root, strict=True):
        groups[k].append(r)
    rows = [min(g, key=lambda r: r.doc_id) for g in groups.values()]
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.createDataFrame(rows, docs.schema)).collect()}
    coder, want = byte_bpe.coder(byte_bpe.RANKS), Counter()
    for r in rows:
        if plan[r.doc_id]:
            ids = coder._leaf.encode_ordinary(r.text)
            want[r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(r.text.encode()).hexdigest()] = plan[r.doc_id]
    got = cp.run(spark, SMALL)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    folder = shared_path(spark, "tables")
    spark.createDataFrame([(0, 1), *((k, 0) for k in range(1, 39))], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert (out.count() == 0) == (docs is none)
        assert cp.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_registered_under_their_names():
    names = list(E.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("name", ["op2_mix_sources", "op6_exact_dedup"])
def test_query_matches_duckdb(spark, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    want = duck(SMALL).execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)
