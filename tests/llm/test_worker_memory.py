"""What the tokenizer operators leave in a Python worker's memory."""

import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest

from cohortloom.llm import packing, pieces, simhash_texts

_HELD = """
import random, re
from cohortloom.llm import packing, pieces

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rules = packing.WordRules(True, False, "")
random.seed(1)
cache = pieces.once_per_worker("word ids", (), lambda: pieces.PieceCache(lambda words: [w.encode() * 4 for w in words]))
before = held()
text = lambda: " ".join(f"w{random.getrandbits(24)}" for _ in range(2000))
for _ in range(60):
    for found in packing.encoded_blocks([text() for _ in range(10)], rules, cache):
        pass
full = held() - before
del cache
pieces.forget()
print(full, held() - before)
"""


def _run(code: str) -> list[float]:
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    return [float(x) for x in out.stdout.split()]


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_memory_of_words_is_bounded_and_goes_back():
    full, left = _run(_HELD)
    assert full < 140, full
    assert left < 60, left


class Docs:
    """Hands the task function over instead of running it in a worker."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_texts_become_strings_in_bounded_numbers(monkeypatch, spark):
    seen, plain = [], packing.encoded_blocks
    monkeypatch.setattr(packing, "encoded_blocks", lambda texts, *rest: seen.append(len(texts)) or plain(texts, *rest))
    n = 1500
    batch = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([f"a{i} b" for i in range(n)])})
    run = packing.token_pieces(Docs(), public_tokenizers.path("word_bpe_49k.json"))
    found = [i for b in run(iter([batch])) for i in b.column(0).to_pylist()]
    assert found == list(range(n))
    assert max(seen) <= 512


def test_near_dedup_starts_without_words(spark):
    pieces.once_per_worker("word ids", ("x",), dict)
    assert list(simhash_texts.shingle_sets(Docs(), 5)(iter([]))) == []
    assert not pieces._made
