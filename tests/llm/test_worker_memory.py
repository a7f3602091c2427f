"""What a Python worker holds: blocks are made once, and a block's working memory is gone before the next is read."""
import random
import subprocess
import sys
import weakref
from pathlib import Path

import pyarrow as pa

from emberline.llm.words import blocks, by_block


def batches(n: int, rows: int = 64, width: int = 1024):
    for i in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([f"{i:08d}" * (width // 8)] * rows)], names=["text"])


def test_a_block_is_not_held_twice():
    before = pa.total_allocated_bytes()
    held = [(pa.total_allocated_bytes() - before) / t.nbytes for t in blocks(batches(64), 1 << 20)]
    assert len(held) == 4 and max(held) < 1.5


def test_work_is_let_go_before_the_next_block_is_read():
    alive, seen = [], []

    class Load:
        pass

    def work(t):
        load = Load()
        alive.append(weakref.ref(load))
        return pa.RecordBatch.from_arrays([pa.array([t.num_rows])], names=["n"])

    def source():
        for b in batches(64):
            seen.append(any(r() is not None for r in alive))
            yield b

    assert sum(b["n"][0].as_py() for b in by_block(source(), 1 << 20, work)) == 64 * 64
    assert not any(seen) and len(alive) == 4
    assert list(by_block(iter([]), 1 << 20, work)) == []


PEAK = """
import re, sys, threading, time
import pyarrow as pa
from emberline.llm import packing
class Task:
    partitionId = staticmethod(lambda: 0)
packing.TaskContext = type("Context", (), {"get": staticmethod(lambda: Task)})
texts = [x for x in sys.stdin.read().split(chr(10)) if x]
def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def source():
    for i in range(0, len(texts), 256):
        part = texts[i:i + 256]
        yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int64()), pa.array(part)], names=["doc_id", "text"])
run = packing._pieces(packing.tokenizer_path(), 2048)
packing.word_ids(packing.tokenizer_path())
start, most, over = anon(), [0], []
def watch():
    while not over:
        most[0] = max(most[0], anon())
        time.sleep(0.002)
threading.Thread(target=watch, daemon=True).start()
tokens = sum(sum(b["length"].to_pylist()) for b in run(source()))
over.append(1)
print(tokens, most[0] - start)
"""


def test_packing_worker_stays_small():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij-k0", k=rng.randint(3, 9))) for _ in range(60_000)]
    texts = "\n".join(" ".join(rng.choices(words, k=300)) for _ in range(9_000))
    out = subprocess.run([sys.executable, "-c", PEAK], input=texts, capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    tokens, mb = out.stdout.split()
    assert int(tokens) > 9_000 * 300
    assert float(mb) < 180, mb
