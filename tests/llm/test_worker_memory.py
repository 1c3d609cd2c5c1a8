"""What a Python worker keeps from one stage to the next."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from glimmer.llm import near_dedup, quality, vocabulary


class Captured:
    """Stands for a DataFrame; its mapInArrow() gives the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def sketching(monkeypatch):
    monkeypatch.setattr(near_dedup.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    return near_dedup._sent(Captured(), 5, 2, 3)


def viewing(monkeypatch):
    model = quality.Model(np.zeros((len(quality.FIGURES), quality.BINS - 1)), np.zeros(quality.BINS - 1), {name: quality.Target() for name in quality.TARGETS})
    return quality._seen(Captured(), model)


@pytest.mark.parametrize("stage", [sketching, viewing])
def test_stages_after_packing_take_no_memory_for_its_encoder(stage, monkeypatch):
    """The pipeline's workers pack at its end and begin the next run with what they kept of it before."""
    text = pa.array(["a text of its own", None, "another one"])
    ids = vocabulary.encoder(public_tokenizers.path("word_bpe_49k.json")).encode_batch(text)[0].tolist()
    assert vocabulary._encoders
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3]), "key": pa.array([1, 2, 3]), "text": text, "mark": pa.array([4, 5, 6]), "source": text, "lang": text, "length": pa.array([1.0, None, 3.0])})
    assert sum(b.num_rows for b in stage(monkeypatch)(iter([batch]))) > 0
    assert not vocabulary._encoders
    assert vocabulary.encoder(public_tokenizers.path("word_bpe_49k.json")).encode_batch(text)[0].tolist() == ids
