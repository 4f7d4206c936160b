"""Hash and shuffle functions that decide assignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32
#: The offset basis and prime of 32-bit FNV-1a, multiplier and increment of the shuffle's generator.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
LCG_MULTIPLIER, LCG_INCREMENT = 1103515245, 12345


def hash32(text: Column) -> Column:
    """The first four bytes of the MD5 digest as an unsigned number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.hex(text.cast("binary"))
    n = F.length(digits) / 2
    octets = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(n > 0, octets).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), lambda h, o: (h.bitwiseXOR(o) * FNV_PRIME) % SPAN)


def short_id(prefix: str, *content: Column, length: int = 8) -> Column:
    """An id that follows from content: a prefix and ``length`` hexadecimal digits, the same each time a task runs."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in content]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length))


def command_id(ts: Column, *content: Column) -> Column:
    """cmd-<time>-<six digits>: commands in the order of their seconds, told apart by content."""
    return F.concat(F.lit("cmd-"), F.date_format(ts, "yyyyMMddHHmmss"), short_id("-", *content, length=6))


def try_count(n: Column) -> Column:
    """How many pending ranges a worker tries before it gives up."""
    n = n.cast("long")
    half = F.least(F.greatest(F.floor(n / 2), F.lit(5)), F.lit(20))
    return F.when(n <= 3, n).when(n <= 10, F.floor((3 * n + 3) / 4)).when(n <= 50, F.floor((n + 1) / 2)).otherwise(half).cast("long")


def seeded_shuffle(items: Column, k: Column, seed: Column) -> Column:
    """The first ``k`` of a Fisher-Yates shuffle (from the last place down) driven by a linear congruential generator; all in order if there are at most ``k``."""
    n = F.size(items)
    places = F.sequence(n - 1, F.lit(1), F.lit(-1))

    def step(state: Column, i: Column) -> Column:
        r = (state["r"] * LCG_MULTIPLIER + LCG_INCREMENT) % SPAN
        j = (r % (i + 1)).cast("int")
        a = state["a"]
        swapped = F.transform(a, lambda x, at: F.when(at == i, F.get(a, j)).when(at == j, F.get(a, i)).otherwise(x))
        return F.struct(r.alias("r"), swapped.alias("a"))

    shuffled = F.aggregate(places, F.struct(seed.cast("long").alias("r"), items.alias("a")), step, lambda s: s["a"])
    return F.when(n <= k, items).otherwise(F.slice(shuffled, 1, k))


def shuffle_places(n: int, k: int, seed: int) -> list[int]:
    """Which places of ``n`` items ``seeded_shuffle`` reads for its first ``k``, without a list of ``n``: the swaps are undone from the last to the first."""
    if n <= k:
        return list(range(n))
    # The generator's state after all n - 1 swaps, by doubling; then it runs backwards.
    r, a, c, left = seed % SPAN, LCG_MULTIPLIER, LCG_INCREMENT, n - 1
    while left:
        if left & 1:
            r = (r * a + c) % SPAN
        a, c, left = a * a % SPAN, (a * c + c) % SPAN, left >> 1
    back = pow(LCG_MULTIPLIER, -1, SPAN)
    holder = {p: p for p in range(k)}  # place now -> place in the end
    for i in range(1, n):
        j = r % (i + 1)
        if i != j and (i in holder or j in holder):
            one, two = holder.pop(i, None), holder.pop(j, None)
            if one is not None:
                holder[j] = one
            if two is not None:
                holder[i] = two
        r = (r - LCG_INCREMENT) * back % SPAN
    return [at for at, _ in sorted(holder.items(), key=lambda x: x[1])]
