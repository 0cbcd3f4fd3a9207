"""The two Kneser-Ney models in memory, against which the library's Spark tables are held."""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.toxicity import ORDER, SHARED, _discount, _shared_chances, _shorter, ngrams


def summarise(counts: DataFrame) -> DataFrame:
    """By order: each n-gram's exact counts (continuation counts below the highest order)."""
    grams, out = counts, []
    for order in range(ORDER, 0, -1):
        out.append(grams.select(F.lit(order).alias("order"), "key", "toxic", "ordinary"))
        if order > 1:
            grams = _shorter(grams, order - 1)
    return reduce(DataFrame.unionByName, out)


class KneserNeyPair:
    """The two models in memory, for few n-grams; ``DifferenceTables`` has the same in Spark tables."""

    def __init__(self, rows):
        """``rows``: a pandas frame of ``summarise``."""
        grams = {}
        for order in range(1, ORDER + 1):
            own = rows[rows["order"] == order].sort_values("key")
            grams[order] = own["key"].to_numpy(np.int64), own[["toxic", "ordinary"]].to_numpy(np.float64)
        both = {order: grams[order][1].sum(1) for order in (1, 2)}
        shared = {order: _discount((n == 1).sum(), (n == 2).sum()) for order, n in both.items()}
        low = dict(zip(grams[2][0].tolist(), _shared_chances({o: grams[o][0] for o in (1, 2)}, both, shared).tolist(), strict=True))
        lower = {key: (p, p) for key, p in low.items()}
        self.seen: dict[int, dict[int, float]] = {}
        self.back: dict[int, dict[int, float]] = {}
        for order in range(SHARED + 1, ORDER + 1):
            keys, n = grams[order]
            discount = [_discount((n[:, k] == 1).sum(), (n[:, k] == 2).sum()) for k in (0, 1)]
            totals: dict[int, np.ndarray] = {}
            for key, own in zip(keys.tolist(), n, strict=True):
                totals.setdefault(key >> 8, np.zeros((2, 2)))
                totals[key >> 8] += [own, own > 0]
            keeps = {c: [discount[k] * t[1, k] / t[0, k] if t[0, k] > 0 else 1.0 for k in (0, 1)] for c, t in totals.items()}
            chance = {}
            for key, own in zip(keys.tolist(), n, strict=True):
                total, keep, below = totals[key >> 8][0], keeps[key >> 8], lower[key & ((1 << (8 * (order - 1))) - 1)]
                chance[key] = tuple(max(own[k] - discount[k], 0) / max(total[k], 1) + keep[k] * below[k] for k in (0, 1))
            self.seen[order] = {key: float(np.log(p + 1e-12) - np.log(q + 1e-12)) for key, (p, q) in chance.items()}
            self.back[order] = {c: float(np.log(p + 1e-6) - np.log(q + 1e-6)) for c, (p, q) in keeps.items()}
            lower = chance

    def differences(self, text: bytes) -> np.ndarray:
        """Of each byte: its toxic less its ordinary log-likelihood."""

        def look(key: int, order: int) -> float:
            if order == SHARED:
                return 0.0
            if key in self.seen[order]:
                return self.seen[order][key]
            return self.back[order].get(key >> 8, 0.0) + look(key & ((1 << (8 * (order - 1))) - 1), order - 1)

        return np.array([look(key, ORDER) for key in ngrams(text).tolist()], np.float64)
