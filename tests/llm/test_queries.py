"""The registered queries over the small tables, and the pipeline against plain versions of its stages."""

from collections import Counter

import brute as B
import pytest
import sentencepiece
from compare import connect, difference
from public_tokenizers import path

import __spark_entry__ as entry
import corpus_pipeline
from newsevidence.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, folder, name):
    assert difference(spark, connect(folder), name, folder) == ""


def test_pipeline(spark, folder, docs):
    good = [(i, t) for i, t in docs if B.quality(t)["kept"]]
    known = B.groups(good)
    once = [(i, t) for i, t in good if known[t][0] == known[t][2] == i]
    cut = [(i, k if n else dict(once)[i]) for i, w, n, k in B.without_repeats(once) if not n or n < w]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    clean = [(i, t) for i, t in cut if not B.contaminated(t, items)]
    assert len(docs) > len(good) > len(once) >= len(cut) > len(clean) > 0
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = Counter((i, len(sp.encode(t)), B.sha(",".join(map(str, sp.encode(t)))), B.sha(sp.decode(sp.encode(t)))) for i, t in clean)
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in rows.collect()) == want


def test_contract_columns(spark, folder, docs):
    got = Counter(tuple(r) for r in QUERIES["op6_window_graph"](spark, folder).collect())
    assert got == Counter((i, w, n, B.sha(k)) for i, w, n, k in B.without_repeats(docs))
    rows = QUERIES["op8_minhash_bands"](spark, folder).collect()
    known = B.groups(docs)
    assert all((r.text_id, r.n_links, r.class_id) == known[t][:3] for r, t in ((r, dict(docs)[r.doc_id]) for r in rows) if t in known)
