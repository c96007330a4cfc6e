import random

from pyspark.sql import functions as F

from tidemark.operators import rerank


def greedy(rows, limit, caps):
    """The rule in words: take the next that fits the caps of the moment, then fill up with what was passed over."""
    picked, passed = [], []
    for row in rows:
        if len(picked) == limit:
            break
        fits = all(row[k] is None or sum(p[k] == row[k] for p in picked) < (early if len(picked) < 10 else late) for k, (early, late) in caps.items())
        (picked if fits else passed).append(row)
    return [r["item"] for r in (picked + passed)[:limit]]


def test_diverse_heads_follow_the_caps(spark):
    rng = random.Random(4)
    rows = [(u, i, round(rng.random(), 2), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"])) for u in range(12) for i in range(rng.randrange(1, 60))]
    frame = spark.createDataFrame(rows, "user long, item long, score double, source string, topic string")
    caps = {"source": (2, 4), "topic": (3, 5)}
    got = {}
    for r in rerank.diverse(frame, "user", "item", [F.desc("score"), F.asc("item")], 20, caps).orderBy("user", "position").collect():
        got.setdefault(r.user, []).append(r.item)
    for u in range(12):
        mine = sorted(({"item": i, "score": s, "source": a, "topic": t} for v, i, s, a, t in rows if v == u), key=lambda r: (-r["score"], r["item"]))
        assert got[u] == greedy(mine, 20, caps)
