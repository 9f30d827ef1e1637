"""A worker that goes on with other work holds nothing of the encoder's."""

import pyarrow as pa
import pytest

from hindcast.llm import jaccard_join, perplexity
from hindcast.llm.queries import tokenizer_path
from hindcast.llm.tokens import Encoder


@pytest.mark.parametrize("work", [perplexity._count(5), jaccard_join._members(5, 80), jaccard_join._packets(5, 80, 4)])
def test_other_work_forgets_the_words(work):
    Encoder.of(tokenizer_path("word_bpe_49k.json"), "words").encode(["some words of a text"])
    rows = {"doc_id": pa.array([1]), "text": pa.array([" ".join(map(str, range(99)))]), "text_hash": pa.array([1]), "fold": pa.array([0], pa.int32())}
    assert Encoder._made and list(work([pa.record_batch(rows)])) and not Encoder._made
