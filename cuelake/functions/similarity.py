"""Fuzzy comparison and merging of two texts; small helpers of the grouped folds."""
from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate, repeat

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_CJK = re.compile(r"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]")


#: Characters of a second text from which SequenceMatcher leaves frequent ones out of its search; bytes of bit rows held at once.
_LONG, _ROWS = 200, 1 << 25


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity as SequenceMatcher(None, a, b).ratio() gives it; the order of the arguments matters.

    Instead of a search for each block that is left, one table serves all: for each length k, the places of a where a
    common run of k ends, with the places of b as bits. Lengths are taken from the largest down, the blocks (pairs of ranges) in
    order; of equally long runs the first in a, then in b, cuts its block in two.
    """
    total = len(a) + len(b)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    common, long = set(a) & set(b), len(b) >= _LONG
    if long:  # runs hold rare characters only and grow by any others around them
        common = {c for c in common if b.count(c) <= len(b) // 100 + 1}
    where = dict.fromkeys(common, 0)
    for i, c in enumerate(b):
        if c in where:
            where[c] |= 1 << i
    row = [*map(where.get, a, repeat(0)), 0]
    runs = [[(i, x) for i, x in enumerate(row) if x]]
    room = _ROWS // (len(b) // 8 + 100) - len(runs[0])
    while runs[-1]:
        runs.append([(i + 1, y) for i, x in runs[-1] if (y := x << 1 & row[i + 1])])
        room -= len(runs[-1])
        if room < 0:
            return SequenceMatcher(None, a, b).ratio()
    blocks, matched = [(0, len(a), 0, len(b))], 0
    for k in range(len(runs) - 1, 0, -1):
        left, found = [], iter(runs[k - 1])
        i, x = next(found)
        for a0, a1, b0, b1 in blocks:
            if a1 - a0 >= k and b1 - b0 >= k:
                first, within = a0 + k - 1, (1 << b1) - (1 << b0 + k - 1)
                while i < a1:
                    if i >= first and (hit := x & within):
                        s, t = i - k + 1, (hit & -hit).bit_length() - k
                        e, f = s + k, t + k
                        if long:
                            while s > a0 and t > b0 and a[s - 1] == b[t - 1]:
                                s, t = s - 1, t - 1
                            while e < a1 and f < b1 and a[e] == b[f]:
                                e, f = e + 1, f + 1
                        matched += e - s
                        if a0 < s and b0 < t:
                            left.append((a0, s, b0, t))
                        a0, b0 = e, f
                        if a1 - a0 < k or b1 - b0 < k:
                            break
                        first, within = a0 + k - 1, (1 << b1) - (1 << b0 + k - 1)
                    i, x = next(found, (len(a), 0))
            if a0 < a1 and b0 < b1:
                left.append((a0, a1, b0, b1))
        blocks = left
    if long:  # a block without a run still has what it begins with
        for a0, a1, b0, b1 in blocks:
            n = 0
            while n < a1 - a0 and n < b1 - b0 and a[a0 + n] == b[b0 + n]:
                n += 1
            matched += n
    return 2.0 * matched / total


def reaches(a: str, b: str, least: float) -> bool:
    """ratio(a, b) >= least. Matches are no more than the shorter length, nor than the common subsequence:
    most pairs are settled by those, and equal texts at once."""
    total = len(a) + len(b)
    if a == b:
        return least <= 1.0
    if 2.0 * min(len(a), len(b)) / total < least or 2.0 * common_subsequence(a, b) / total < least:
        return False
    return ratio(a, b) >= least


def alike(a: str | None, b: str | None, least: float = 0.78) -> bool:
    x, y = (" ".join((t or "").split()).lower() for t in (a, b))
    return x == y if not (x and y) else reaches(x, y, least)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits: a bound on ratio()'s matches."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def closest_border(a: list[str] | str, b: list[str] | str, join: str, least: int, above: float) -> int:
    """Size of the border (end of a, start of b, the same number of units) with the best ratio()
    over `above`, in lower case; the largest of equal ones; 0 if there is none.

    Matches are no more than the common subsequence, and that of a smaller border is no longer:
    sizes that it rules out are passed over, so texts without a border cost a few comparisons.
    """
    best, found = above, 0
    reach = None  # common characters of the last border compared, all larger ones being settled
    most = min(len(a), len(b))
    ends, starts = (list(accumulate((len(u.lower()) for u in units), initial=0)) for units in (a[: len(a) - most - 1 if len(a) > most else None : -1], b[:most]))
    for n in range(most, least - 1, -1):
        # lengths are known before a border is cut out
        if reach is not None and 2.0 * (reach + 2) / (ends[n] + starts[n] + 2 * len(join) * (n - 1)) <= best:  # a cut can change a final sigma at either end
            continue
        x, y = join.join(a[len(a) - n :]).lower(), join.join(b[:n]).lower()
        total = len(x) + len(y)
        reach = common_subsequence(x, y)
        if 2.0 * reach / total <= best:
            continue
        score = ratio(x, y)
        if score > best:
            best, found = score, n
    return found


def exact_border(a: list[str] | str, b: list[str] | str) -> int:
    """Size of the longest end of a that b starts with."""
    if isinstance(a, str):
        n = min(len(a), len(b))
        while n and (n := b.rfind(a[-1], 0, n) + 1) and not a.endswith(b[:n]):  # only at the last character of a
            n -= 1
        return n
    return next((n for n in range(min(len(a), len(b)), 0, -1) if a[len(a) - n :] == b[:n]), 0)


def overlap_merge(first: str | None, second: str | None) -> str:
    """Join two texts at what they share: one in the other, else at their border, sought
    exactly and then by likeness (0.80 for two words or more, 0.85 for three characters or
    more), each in words before characters; without a border, one after the other."""
    a, b = (first or "").strip(), (second or "").strip()
    if not a or not b or b in a or a in b:
        return a if len(a) >= len(b) else b
    in_words = (a.split(), b.split(), " ")
    in_chars = (a, b, "")
    exact = lambda x, y, join: exact_border(x, y)
    like = {" ": lambda x, y, join: closest_border(x, y, join, 2, 0.80), "": lambda x, y, join: closest_border(x, y, join, 3, 0.85)}
    for border, (x, y, join) in ((exact, in_words), (exact, in_chars), (like[" "], in_words), (like[""], in_chars)):
        n = border(x, y, join)
        if n:
            return " ".join(x[: len(x) - n] + y) if join else x + y[n:]
    return a + ("" if _CJK.search(a) or _CJK.search(b) else " ") + b


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _overlap_merge(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_merge(x, y) for x, y in zip(a, b)], dtype="object")


def similarity(a: Column | str, b: Column | str) -> Column:
    """ratio() of two columns, in Arrow batches; null where either is null."""
    return pandas_udf(_similarity, "double")(a, b)


#: Characters that are counted one by one in the bound; all others count together.
COUNTED = " etaoinshrdlucmfpgwybvkxjqz"


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than ratio(a, b), in the JVM: twice the characters that both texts can have in common (each of
    COUNTED for itself, the rest as a whole) over the sum of the lengths; 1 for two empty texts."""
    n = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c)))
    rest = lambda x: F.length(F.translate(x, COUNTED, ""))
    common = reduce(lambda x, y: x + y, [F.least(n(a, c), n(b, c)) for c in COUNTED], F.least(rest(a), rest(b)))
    total = F.length(a) + F.length(b)
    # sums of doubles: 2.0 * M / T with M no more than common
    return F.when(total == 0, 1.0).otherwise(F.lit(2.0) * F.least(common, F.length(a), F.length(b)) / total)


def similarity_from(a: Column, b: Column, least: float) -> Column:
    """ratio(a, b) where it is least or more, else null. Pairs whose bound is lower, and equal texts, are
    settled in the JVM; Python gets the others only."""
    open_ = (a != b) & (ratio_bound(a, b) >= least)

    @pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None or not reaches(p, q, least) else ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    asked = scored(F.when(open_, a), F.when(open_, b))
    return F.when((a == b) & F.lit(least <= 1.0), F.lit(1.0)).when(open_, asked)


def overlap_merged(a: Column | str, b: Column | str) -> Column:
    return pandas_udf(_overlap_merge, "string")(a, b)


def register(spark: SparkSession) -> None:
    """Both functions under their SQL names."""
    spark.udf.register("similarity", pandas_udf(_similarity, "double"))
    spark.udf.register("overlap_merge", pandas_udf(_overlap_merge, "string"))
