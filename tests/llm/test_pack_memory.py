import random
import re
import subprocess
import sys
from pathlib import Path
from unittest.mock import MagicMock, patch

import pyarrow as pa

from graphloom.llm import packing

MB = 1 << 20


def cutter():
    """The function that ``cut`` gives to the workers."""
    docs = MagicMock()
    with patch.object(packing, "F"), patch.object(packing, "text_batches"):
        packing.cut(docs)
    return docs.select.return_value.mapInArrow.call_args[0][0]


def status(key):
    return int(re.search(rf"{key}:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def growth():
    """MB that a worker with full tables takes at most while it cuts a batch as large as Spark sends."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(rnd.choices(words, k=600)) for _ in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), texts], ["doc_id", "text"])
    assert 13 * MB < texts.nbytes < 16 * MB
    run = cutter()
    for _ in run(iter([batch])):
        pass
    Path("/proc/self/clear_refs").write_text("5")  # forgets the peak so far
    before = status("VmRSS")
    rows = sum(out.num_rows for out in run(iter([batch])))
    assert rows >= 4000
    return status("VmHWM") - before


def test_a_worker_holds_the_ids_of_some_texts_at_a_time():
    code = "from tests.llm.test_pack_memory import growth; print(growth())"
    took = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2])
    assert took.returncode == 0, took.stderr
    assert float(took.stdout) < 140


def test_pieces_do_not_depend_on_the_size_of_blocks(monkeypatch):
    texts = ["a b. c\nd", None, "", "word " * 1500, "Straße᠎ x", "x" * 40, "word " * 1023, "日本 <|endoftext|>", " lead", "trail "] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(cutter()(iter([batch]))).to_pylist()
    for size in (1, 50, 6000):
        monkeypatch.setattr(packing, "TEXT_BYTES", size)
        assert pa.Table.from_batches(cutter()(iter([batch]))).to_pylist() == whole
