import random
import tracemalloc

import pyarrow as pa
import pytest

from ringfold.llm import minhash, toxicity
from ringfold.llm.common import text_runs, text_slices


def test_near_copies_of_the_sample_are_found_in_arrays():
    """As a plain loop over sets finds them, without an object for each shingle."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(300)]
    texts += [t + " and more" for t in texts[:20]] + ["", "a b", "a b"]
    documents = [(t, i % 2) for i, t in enumerate(texts)]
    seen, expected = set(), []
    for t, label in documents:
        own = set(minhash.shingle_sets([t])[0].tolist())
        if len(own & seen) <= len(own) / 5:
            expected.append((t, label))
        seen |= own
    tracemalloc.start()
    found = toxicity._originals(documents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == expected
    assert peak < 54 * len(seen), peak / len(seen)


def test_runs_of_texts_are_those_of_a_list():
    texts = [None, "a" * 9, "", "é𝄞" * 3, None, "b" * 30, "c"]
    for part in (texts, texts[:-1], texts[:1], []):
        for array in (pa.array(part, pa.string()), pa.array(["x", *part], pa.string())[1:]):
            assert list(text_runs(array, 10)) == [(a, part[a:b]) for a, b in text_slices(part, 10)]


@pytest.mark.parametrize("of", [minhash._sketch, minhash._full_sets])
def test_a_batch_is_not_held_as_strings(of):
    texts = pa.array([chr(97 + i) * (1 << 20) for i in range(26)])
    ids = pa.array(range(26), pa.int64())
    columns = [ids, ids, ids, texts] if of is minhash._sketch else [texts]
    tracemalloc.start()
    found = sum(b.num_rows for b in of(iter([pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 26
    assert peak < 13 << 20, peak
