import random
import subprocess
import sys

import numpy as np

from penstroke.llm import toxicity
from tests.llm.test_operators import prose

HELD = """
import random, re
from pathlib import Path
import pyarrow as pa
from pyspark.sql import types as T
from penstroke.llm.toxicity import Field, scored

class Docs:
    columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])
    def mapInArrow(self, run, schema):
        return run

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

def batches(n):
    r = random.Random(4)
    for _ in range(n):
        texts = [" ".join("%x" % r.getrandbits(18) for _ in range(300)) for _ in range(2048)]
        yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

task = scored(Docs(), Field({"=foul": 1.0}, scale=(0.0, 1.0, 1.0, 1.0)))
before = held()
most, rows = 0, 0
for b in task(batches(3)):
    rows, most = rows + b.num_rows, max(most, held())
del b
print(rows, before, most, held())
"""


def test_a_task_that_has_ended_holds_little_memory():
    """What a process holds after a task is near what it held before its first one."""
    run = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    rows, before, most, after = map(float, run.stdout.split())
    assert rows == 3 * 2048
    assert after < before + 50, (before, most, after)


def test_texts_weighed_in_parts_score_as_whole_ones(monkeypatch):
    r = random.Random(8)
    texts = [t + " foulword" * r.randrange(3) for t in prose(60, 13, 1, 90)] + ["", " ", "foulword"]
    model = toxicity.Field({"=foulword": 9.0, "^foul": 1.0}, scale=(-2.0, 1.0, 1.0, 1.0))
    whole, spans = toxicity.Scorer(model).score(texts)
    monkeypatch.setattr(toxicity, "PART", 300)
    by = toxicity.Scorer(model, words=20)  # a table that is emptied between parts
    parts, own = by.score(texts)
    assert np.array_equal(whole, parts) and own == spans and any(spans)
    assert by.score([])[0].shape == (0,)
