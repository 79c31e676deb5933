"""Benchmarks of more words than one automaton holds: a block at a time, each pass written before the next."""

import random
import sys
from pathlib import Path

from pyspark import Broadcast

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from slatewise.llm import decontaminate  # noqa: E402


def test_one_block_at_a_time(spark, monkeypatch):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    bench = [(f"i{k}", say(rng.randrange(0, 30))) for k in range(40)] + [("long", say(130)), ("none", None), ("marks", "!! -")]
    rows = [(k, f"{say(9)} {bench[k % 41][1]}, {say(4)}") for k in range(60)] + [(60, None), (61, ""), (5, "x"), (5, "x")]
    items = spark.createDataFrame(bench, "item_id string, text string").repartition(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    alive, most, words = set(), [], []
    make, end = type(spark.sparkContext).broadcast, Broadcast.destroy

    def broadcast(sc, value):
        shipped = make(sc, value)
        alive.add(id(shipped))
        most.append(len(alive))
        words.append(sum(len(decontaminate.words(text)) for _, text in value))
        return shipped

    def destroy(shipped, *a):
        alive.discard(id(shipped))
        end(shipped, *a)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    found = decontaminate.matches(docs, items, window=6, block_words=50)
    assert len(words) > 5 and max(most) == 1 and not alive and max(words) <= 50 + 130
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    got = sorted(((r.id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in found.collect()), key=repr)
    assert got == sorted(brute.contamination(rows, bench, 6), key=repr)
    one = decontaminate.decontaminate(docs, items, window=6).collect()
    many = decontaminate.decontaminate(docs, items, window=6, block_words=50).collect()
    assert sorted(one, key=repr) == sorted(many, key=repr) and 0 < len(one) < len(rows)
