"""Keys of the similarity join against all pairs of sets."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from recordloom.operators import pairing


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_similar_sets_share_keys_and_others_hardly_do(threshold):
    rng, rows = random.Random(5), np.random.default_rng(5)
    vocabulary = rows.integers(-(2**63), 2**63 - 1, 3_000).tolist()
    rarity = SimpleNamespace(value=rows.integers(0, 50, pairing.COUNTERS).astype(np.int32))
    sets = []
    for _ in range(300):
        new = set(rng.sample(vocabulary, rng.randint(1, rng.choice([3, 12, 60, 400]))))
        if sets and rng.random() < 0.5:
            new = set(rng.choice(sets))
            k = int(len(new) * rng.random() * 0.4)
            new = new - set(rng.sample(sorted(new), k // 2)) | set(rng.sample(vocabulary, k - k // 2))
        sets.append(frozenset(new))
    sets = list(dict.fromkeys(sets))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([sorted(x) for x in sets], pa.list_(pa.int64()))], names=["s", "words"])
    dealt = pa.Table.from_batches(list(pairing.keys(rarity, threshold)([batch.slice(0, 100), batch.slice(100)]))).sort_by("key")
    shared = Counter()
    for found in pairing.meet(threshold)(dealt.to_batches(max_chunksize=777)):
        for a, b, n in zip(*(x.to_pylist() for x in found.columns)):
            shared[a, b] += n
    met = {pair for pair, n in shared.items() if n >= pairing.SHARED}
    near = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(x & y) >= threshold * len(x | y)}
    assert near and near <= met
    assert len(met) < 0.1 * len(sets) ** 2 / 2
