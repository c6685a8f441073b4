"""What workers remember from task to task, and what they give back."""

import numpy as np
import pandas as pd
import pyarrow as pa

from millrace.llm import language_id, near_copies, sentencepiece_codec
from millrace.llm.queries import SENTENCEPIECE


def test_tasks_of_a_worker_share_a_codec():
    model = sentencepiece_codec.read_model(SENTENCEPIECE)
    first = sentencepiece_codec.kept_codec(model, 50)
    want = [(ids.tolist(), same) for ids, same in sentencepiece_codec.Codec(model).encode(["one two three", "", "two  two"])]
    for _ in range(2):
        codec = sentencepiece_codec.kept_codec(bytes(bytearray(model)), 50)
        assert codec is first
        assert [(ids.tolist(), same) for ids, same in codec.encode(["one two three", "", "two  two"])] == want
    assert len(first.known) == len(first.same) == 4
    assert sentencepiece_codec.kept_codec(model, 3) is not first and len(sentencepiece_codec._KEPT) == 1


def test_large_cells_hand_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(near_copies, "release", lambda: freed.append(1))
    for n, times in ((near_copies.BLOCK // 2, 1), (3, 1)):
        marks = np.arange(n)
        cell = pa.table(
            {
                **{c: np.zeros(n, np.int32) for c in ("pos", "view", "i", "j", "block")},
                "mark": marks,
                "component": marks,
                "n": np.ones(n, np.int32),
                "views": [[int(m)] for m in marks],
                "sketch": [[int(m)] for m in marks],
            }
        )
        assert near_copies._pairs_across(cell, 0.8).num_rows == 0
        assert len(freed) == times


def test_texts_are_hashed_in_bounded_groups():
    seen = []

    class Hashes(near_copies.WordHashes):
        def __call__(self, texts):
            seen.append(sum(map(len, texts)))
            return super().__call__(texts)

    texts = pd.Series([f"{i} " * (near_copies.CHARS // 8) for i in range(9)] + ["", "a b"] * 300)
    found = [own.tolist() for part in near_copies._shingles(texts, Hashes(), 5) for own in part]
    one = near_copies.WordHashes()
    assert found == [near_copies.shingle_hashes(one([t.encode()])[0], 5).tolist() for t in texts]
    assert max(seen) < near_copies.CHARS + max(map(len, texts))


def test_words_are_looked_up_in_bounded_groups():
    scorer = language_id.Scorer(["▁a", "▁b"], ["x", "y"], np.array([[0.8, 0.2], [0.1, 0.7], [0.1, 0.1]]))
    seen, rows = [], scorer.store.rows
    scorer.store.rows = lambda words: (seen.append(len(words)), rows(words))[1]
    texts = ["a " * (language_id.CHARS // 4), "b " * (language_id.CHARS // 4)] * 3
    assert scorer.predict(texts)[0] == ["x", "y"] * 3
    assert max(seen) * 2 <= language_id.CHARS + len(texts[0])


def test_ids_leave_a_worker_in_parts():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(SENTENCEPIECE))
    texts = ["one " * (sentencepiece_codec.CHARS // 8), ""] * 5
    frames = list(sentencepiece_codec._frames(codec, texts))
    assert len(frames) > 1
    assert [x.tolist() for f in frames for x in f["input_ids"]] == [x.tolist() for x, _ in codec.encode(texts)]
