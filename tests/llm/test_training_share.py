import subprocess
import sys

from fanweave.llm import recurrent
from fanweave.llm.recurrent import Settings, encoded, fitted, initial, lexicon, token_counts

from .fixtures import plain

SMALL = dict(head_classes=2, class_size=3, suffixes=2, embed=4, hidden=5, window=4, lanes=3, frequent=30, rounds=1)


def test_every_training_document_reaches_the_weights(spark):
    for i in [k for k in range(40) if not recurrent.is_held_out([k])[0]][:6]:  # each alone: none is passed over
        rows, s = plain(spark, ["a b c d"]).selectExpr(
            f"cast({i} as long) AS doc_id", "text"
        ).coalesce(1), Settings(**SMALL)
        lex = lexicon(token_counts(rows, s.suffixes), s)
        before, after = initial(s, lex), fitted(encoded(rows, s, lex), s, lex)
        assert any((before[k] != after[k]).any() for k in before)


def test_windows_reuse_freed_memory():
    """Without that, every window's arrays are mapped anew: some thousands of page faults each."""
    code = """
import resource
import numpy as np
from fanweave.llm.recurrent import Lexicon, Settings, fit_window, initial, keep_heap
keep_heap()
s = Settings()
one = np.ones(0, np.int64)
w = initial(s, Lexicon(one, one, one, 9, 9, 9, np.ones(s.spelled), np.ones(s.classes), np.ones(s.head)))
seen = np.random.default_rng(1).integers(0, s.symbols, (s.window, s.lanes))
run = lambda: fit_window(w, s, seen, seen, np.zeros(seen.shape, bool), np.zeros((s.lanes, s.hidden), np.float32))
for _ in range(4):
    run()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(8):
    run()
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 8)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert int(out) < 500
