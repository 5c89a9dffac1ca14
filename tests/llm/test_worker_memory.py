import os
import shutil
import tracemalloc

import numpy as np
import pytest
from pyspark import cloudpickle

from askgauge.llm import toxic_kernel
from askgauge.llm.piece_tokens import PieceTokenizer


def test_tasks_share_one_tokenizer(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = str(shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), tmp_path / "own.json"))
    # As a worker gets it: anew with each task.
    task = cloudpickle.dumps(lambda: PieceTokenizer(path))
    first, second = cloudpickle.loads(task)(), cloudpickle.loads(task)()
    assert first.tokenizer is second.tokenizer
    assert first.keys is not second.keys
    os.utime(path, (1, 1))
    assert cloudpickle.loads(task)().tokenizer is not first.tokenizer


def test_toxicity_keeps_kernel_values_of_hits_only():
    rng = np.random.default_rng(4)
    marks = [bytes(rng.integers(1, 27, 6).tolist()) for _ in range(160)]
    landmarks = toxic_kernel.Landmarks.of(marks)
    weights = np.zeros(160)
    weights[0] = 1
    model = toxic_kernel.ToxicModel(landmarks, landmarks.folded(weights).astype(np.float32), -0.9, np.zeros(0))
    hit = "".join(chr(96 + b) for b in marks[0]).encode()
    words = [bytes(rng.integers(97, 123, 8).tolist()) for _ in range(60_000)]
    rows = [b" ".join(words[:30_000]), b" ".join([hit, *words[30_000:], hit]), hit, b""]
    buf, offsets = np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum([0, *[len(r) for r in rows]])
    tracemalloc.start()
    got = model.inputs(buf, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A float for each distinct word and landmark would be 77 MB.
    assert peak < 60_000_000
    assert got[:, :2].tolist() == [[30_000, 0], [30_002, 2], [1, 1], [0, 0]]
    own = landmarks.kernel(toxic_kernel._grams(marks[:1]))[0] ** 4
    assert np.allclose(got[:, 4:], np.array([0, 2, 1, 0])[:, None] * own)
