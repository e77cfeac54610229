"""What a task holds of very large groups."""

import numpy as np
import pyarrow as pa
from corvid.llm import ordermin


def test_near_copies_under_many_keys(monkeypatch):
    """Pairs of near copies are held under one of their keys, not under each; the links connect all of them."""
    n, groups = 200, 40
    texts = [" ".join(f"w{i}" for i in range(80)) + f" end{k}" for k in range(n)]
    keys = np.arange(1, groups + 1)
    rows = [(key, k) for key in keys.tolist() for k in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([0] * len(rows), pa.int32()) for c in ("p", "q", "own")},
        "id": pa.array([r[1] for r in rows], pa.int64()), "body": pa.array([texts[r[1]] for r in rows]), "keys": pa.array([keys.tolist()] * len(rows), pa.list_(pa.int64())),
    })
    held = []
    monkeypatch.setattr(ordermin.np, "argsort", lambda a, *args, _sort=np.argsort, **more: held.append(len(a)) or _sort(a, *args, **more))
    links = ordermin._linked(batch, 0.8)
    assert links.num_rows == n - 1
    assert held[-1] == n * (n - 1) // 2
