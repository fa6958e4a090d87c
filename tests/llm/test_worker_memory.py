"""Python workers outlive their tasks: what an operator remembers must not stay through the stages after it."""

import numpy as np
import pyarrow as pa

from test_llm_helpers import labels_table, mixed_documents
from turnwise.llm import common, minhash, pii, toxicity


def test_words_are_forgotten_between_stages(spark, monkeypatch):
    docs, runs = mixed_documents(spark), []
    index = toxicity.fit(docs, labels_table(spark))
    frame = type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: runs.append(run) or plain(self, run, *a, **b))
    toxicity.score(docs, index)
    minhash.sketch(docs, "doc_id", "text")
    pii.redact_pii(docs)
    assert len(runs) == 3
    for run in runs:
        common.words_of([b"some words of a task before"])
        assert len(common._DIGESTS) and len(common._DIGESTS.data)
        assert not list(run(iter([])))
        assert not len(common._DIGESTS) and not len(common._DIGESTS.data)


def test_words_are_forgotten_after_a_task():
    def run(batches):
        for b in batches:
            common.words_of(b.column(0).cast(pa.binary()).to_pylist())
            assert len(common._DIGESTS)
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c", "d e"])], names=["text"])
    assert list(common.tidied(run)(iter([batch]))) == [batch]
    assert not len(common._DIGESTS)


def test_powers_of_long_chunks_are_right_and_not_kept():
    powers, n = common.Powers(0xD1342543DE82EF95), 300_001
    up, down = powers.upto(n)
    assert len(up) >= n and len(down) >= n
    for i in (0, 1, 65_535, 65_536, 131_073, n - 1):
        assert int(up[i]) == pow(powers.bases[0], i, 1 << 64) and int(up[i]) * int(down[i]) % (1 << 64) == 1
    assert sum(x.nbytes for x in vars(powers).values() if isinstance(x, np.ndarray)) + sum(x.nbytes for x in powers.kept) <= 2 << 20


def test_index_takes_vectors_one_by_one():
    vectors = [{0: 0.6, 2: 0.8}, {1: 1.0}, {2: 0.6, 1: 0.8}]
    whole, single = [toxicity.Index({"a": 0, "b": 1, "c": 2}, np.ones(3), np.arange(3), np.array([1.0, 0.0, 1.0]), 1.0, 0.0) for _ in range(2)]
    whole.build(vectors)
    single.build(v for v in vectors)
    assert single.who.tolist() == whole.who.tolist() == [0, 1, 2, 0, 2] and single.weight.tolist() == whole.weight.tolist() and single.at.tolist() == [0, 1, 3, 5]
    assert single.nearest([{1: 1.0}]) == [[(1.0, 1), (0.8, 2)]]
