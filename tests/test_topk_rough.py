"""Top-k scans that screen by single-precision scores give what exact scores give."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.operators.blocked_topk import Limits, _top_scan
from ledgerlens.operators.vector_search import cosine

SCHEMA = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("score", pa.float64())])


def table(vectors):
    return pa.table({"id": np.arange(len(vectors)), "v": pa.array(vectors.tolist(), pa.list_(pa.float64()))})


def found(queries, corpus, scorer, k, floor=-np.inf):
    limits = Limits(queries_per_block=64, cells_per_step=64 * 50)
    scan = _top_scan(table(queries), iter([table(corpus)]), scorer, k, np.full(len(queries), floor), SCHEMA, limits)
    return sorted((r["q"], r["d"], r["score"]) for t in scan for r in t.to_pylist())


@pytest.mark.parametrize("width, k, floor", [(3, 5, -np.inf), (64, 5, -np.inf), (64, 1, 0.3), (300, 7, -np.inf)])
def test_screened_scans_find_the_same(width, k, floor):
    """Copies, vectors that differ from them by less than single precision tells, huge and tiny ones."""
    rng = np.random.default_rng(width)
    queries, corpus = rng.normal(size=(130, width)), rng.normal(size=(3000, width))
    corpus[::7] = queries[rng.integers(0, 130, len(corpus[::7]))]
    corpus[::14] += rng.normal(size=(len(corpus[::14]), width)) * 1e-7
    corpus[1::14] *= 10.0 ** rng.integers(-90, 90, (len(corpus[1::14]), 1))
    exact = found(queries, corpus, lambda q: cosine(q)._replace(rough=None), k, floor)
    assert found(queries, corpus, cosine, k, floor) == exact and exact


def test_few_pairs_are_scored_exactly():
    rng = np.random.default_rng(5)
    queries, corpus = rng.normal(size=(64, 16)), rng.normal(size=(20_000, 16))
    cells = []

    def scorer(q):
        made = cosine(q)
        return made._replace(
            score=lambda rows: cells.append(rows.num_rows * 64) or made.score(rows),
            pairs=lambda rows, row, query: cells.append(len(row)) or made.pairs(rows, row, query),
        )

    assert len(found(queries, corpus, scorer, 5)) == 64 * 5
    assert sum(cells) < 0.2 * 64 * 20_000
