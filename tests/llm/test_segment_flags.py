import numpy as np
import pyarrow as pa
import pytest

from labelloom.llm import substrings, suffix_arrays


def test_flags_reach_their_segments_by_one_sort(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd"), n)) for n in (400, 0, 49, 50, 900)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    kind = substrings.Kind(50, 16, suffix_arrays._read, False, None, None, "")
    found = substrings.segments(kind.read(table), 50, 16, True)
    keys = np.unique(found.key)
    flags = (np.arange(len(keys)) % 2).astype(np.uint8)
    flag = dict(zip(keys.tolist(), flags.tolist(), strict=True))
    kept = {a for a, k in zip(found.start.tolist(), found.key.tolist(), strict=True) if flag[k]}

    def sorted_again(*_, **__):
        raise AssertionError("keys were sorted once more")

    monkeypatch.setattr(np, "unique", sorted_again)
    assert set(substrings._plan(kind, table, flags).found.start.tolist()) == kept and 0 < len(kept) < len(found.key)
    with pytest.raises(ValueError, match="keys differ"):
        substrings._plan(kind, table, flags[1:])
    none = substrings._plan(kind, table.slice(0, 0), flags[:0])
    assert len(none.heads) == 0
