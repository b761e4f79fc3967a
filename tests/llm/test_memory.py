"""What a worker holds when a task has ended."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

_HOLDS = """
import re
import pyarrow as pa
from palaver.llm.common import freed

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", f.read()))) // 1024

kept = []

def run(batches):
    for b in batches:
        parts = [bytes(4000) for _ in range(50_000)]
        kept.append(bytes(4000))  # lies above them, so the heap cannot shrink from its end
        yield b

b = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
before = held()
assert list(run([b])) and held() - before > 150
list(freed(run)([b]))
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_a_task_gives_back_what_it_freed():
    root = str(Path(__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", _HOLDS], cwd=root, capture_output=True, text=True, timeout=60, check=True)
    assert int(out.stdout) < 60


def test_a_bounded_memo_counts_the_same():
    from palaver.llm.queries import tokenizer_path
    from palaver.llm.tokens import encoder

    texts = pa.array([" ".join(f"w{i * k}ord, {i}" for i in range(300)) for k in range(1, 40)] + ["", None, "Straße don't #5"])
    whole, _ = encoder(tokenizer_path()).encode(texts, want_ids=False)
    small = encoder(tokenizer_path(), True, max_words=500, batch_bytes=4_000)
    counts, _ = small.encode(texts, want_ids=False)
    assert counts.tolist() == whole.tolist()
    assert small.n < 2_000
