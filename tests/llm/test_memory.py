"""What Python workers hold between tasks."""

import os
import subprocess
import sys

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_CHILD = """
import random, re
import pyarrow as pa
from kgspark.llm import near_duplicates

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", f.read()))) / 1024

def run(texts):
    batches = (pa.RecordBatch.from_pydict({"doc_id": list(range(len(t))), "text": t}) for t in texts)
    return sum(b.num_rows for b in near_duplicates._sketch(5)(batches))

draw = random.Random(7)
words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(20000)]
def batch():
    return [" ".join(draw.choices(words, k=400)) for _ in range(2000)]
run([batch()[:50]])
before = held()
assert run(batch() for _ in range(3)) == 6000
print(held() - before)
"""


def test_a_task_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", _CHILD], capture_output=True, text=True, check=True, cwd=_REPO)
    assert float(out.stdout) < 20
