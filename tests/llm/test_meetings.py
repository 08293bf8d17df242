"""Pairs of groups that share tokens: each is met, and at few of the tokens that it shares."""

import random
from itertools import combinations

from waybill.llm import ngram_join


def test_pairs_of_near_copies_are_made_few_times(spark):
    draw = random.Random(7)
    rows, held = [], {}
    for gid in range(24):
        family = gid % 3  # near copies, each without a tenth of its family's tokens
        tokens = sorted(draw.sample(range(family * 100, family * 100 + 50), 45)) + [1000 + draw.randrange(4)]
        comp = None if gid % 5 == 0 else gid // 6
        held[gid] = (set(tokens), comp, {t for k, t in enumerate(tokens) if k < 30 or k == 45})
        rows += [(gid, t, 45, t in held[gid][2], t >= 1000, comp, 1, [gid, 0], 2) for t in tokens]
    placed = spark.createDataFrame(rows, "gid long, token long, n int, early boolean, common boolean, comp long, grown long, bits array<long>, longs int")
    met = ngram_join._meetings(placed, 80).collect()

    def apart(a, b):
        return held[a][1] is None or held[b][1] is None or held[a][1] != held[b][1]

    # the smaller set's token must be early; of equal sizes that of the smaller gid
    plain = {(a, b) for a, b in combinations(held, 2) if apart(a, b) and held[a][2] & held[b][0]}
    assert {(min(r), max(r)) for r in met} == plain
    assert len(plain) > 100 and len(met) < 2 * len(plain)
