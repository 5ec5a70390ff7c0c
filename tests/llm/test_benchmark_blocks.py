"""A benchmark larger than one automaton: several passes, bounded memory, the same hits."""

import random
import subprocess
import sys

from upswell.llm import decontaminate


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_many_passes_give_the_same(spark):
    draw = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    items = [(i, " ".join(draw.choices(words, k=60 if i % 3 else 5))) for i in range(30)] + [(30, None), (31, ""), (5, "again another text of item five")]
    docs = []
    for i in range(60):
        own = draw.choices(words, k=80)
        text = items[i % 30][1].split()
        docs.append((i, " ".join(own[:40] + (text[10:40] if i % 2 else []) + own[40:]), ["x"] * (i % 3)))
    docs += [(0, docs[1][1], []), (None, docs[1][1], []), (7, None, []), (8, "", [])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, items array<string>")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    once = rows(decontaminate.scan(frame, bench))
    assert sum(int(r[3]) > 0 if r[3].isdigit() else False for r in once) >= 20
    for size in (200, 5000):
        assert decontaminate.blocks(bench, 13, size)[0] > 1
        assert rows(decontaminate.scan(frame, bench, block_bytes=size)) == once
    # A single long item is cut, too.
    long = spark.createDataFrame([(1, " ".join(draw.choices(words, k=3000)))], "item_id bigint, text string")
    count, parts = decontaminate.blocks(long, 13, 10_000)
    sizes = [sum(len(w) for w, _ in part) for part in parts]
    assert count == len(sizes) > 10 and max(sizes) < 20_000


def test_a_full_block_fits_a_task():
    """Distinct words only, the worst case: the automaton of a full block stays under 500 MB."""
    code = (
        "import random, resource; from upswell.llm import decontaminate as d\n"
        "draw = random.Random(1); words = [b'%x' % draw.getrandbits(40) for _ in range(80_000)]\n"
        "found, size = [], 0\n"
        "for w in sorted(d.windows(words, 13)):\n"
        "    if size + len(w) + 1 > d.BLOCK_BYTES: break\n"
        "    found.append((w, ['1'])); size += len(w) + 1\n"
        "assert size > 0.95 * d.BLOCK_BYTES\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "d.automaton(found); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert int(found.stdout) < 500, found.stderr
