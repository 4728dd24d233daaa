import random
import tracemalloc

import pyarrow as pa

from spillway.llm import minhash, similar


class Rows:
    """Stands for a DataFrame: keeps the function that a Python worker runs, and its result's columns."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def join(self, *_):
        return self

    select = join


def peak(run, batches):
    tracemalloc.start()
    for _ in run(iter(batches)):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_a_workers_memory_does_not_grow_with_its_rows(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(900)]  # 10 MB
    size = sum(map(len, texts))
    assert size > 8 << 20
    cut = [range(k, k + 50) for k in range(0, 900, 50)]
    docs = [pa.RecordBatch.from_arrays([pa.array(c), pa.array(c), pa.array([texts[k] for k in c])], ["key", "tag", "text"]) for c in cut]
    assert peak(similar.sketched(Rows(), minhash.BANDS, minhash.SHINGLE).run, docs) < 40 << 20
    wanted = [pa.RecordBatch.from_arrays([pa.array([{"class": k, "digest": b""} for k in c]), pa.array([texts[k] for k in c])], ["class", "text"]) for c in cut]
    assert peak(minhash.class_sets(Rows(), Rows(), minhash.SHINGLE, False).run, wanted) < 40 << 20
