"""Pairs of texts that can be alike, without comparing all pairs.

``overlap_candidates`` finds pairs of token sets that share enough tokens. Tokens are in the order of their frequency, the
rarest first. Sets that share ``need`` tokens share their k-th rarest common token among the first ``n - need + k`` tokens
of each. Rows meet by their first common token; a token that few sets have is a short list, whose pairs are candidates. A
longer list is split by the next common token, and again, so that a frequent token costs its rows times a prefix and not
their square. A set that needs no more tokens than a list already stands for cannot be split; such sets, which are tiny, are
paired with one another.

``alike_titles`` holds blocks of titles against one another. All titles of one language share most pairs of letters, so an index
of them lists nearly all pairs, and some of them often; here a pair costs a few operations on bits and nothing is written for it.
Bags of characters come first. What they leave is held against the length of the longest common subsequence, which no matcher's
blocks exceed, by one word of 64 bits a pair, for many pairs at once; most pairs are given up after a third of their characters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import similarity
from briefloom.storage import written

#: Sets of a list whose pairs are listed; longer lists are split by their next common token. It moves work only: to write, shuffle and read
#: the rows of a split costs about as much as to test the pairs of so many sets.
MOST = 1024
#: Occurrences of a character that a title's bits tell apart.
BAGS = 4
#: Words of 64 bits that tell the tokens of two sets apart.
PARITIES = 8
#: What rounding of a bound may cost is left to the comparison.
SLACK = 1e-6
#: At or below this ratio titles are not taken for one event.
LEAST_RATIO = 5 / 6
#: Titles of a block. It moves work only: a title is sent to as many cells as its group has blocks.
BLOCK = 8192
#: Contexts of a block, those of a block of one span of time, and pairs that are listed at once (of one context at least).
CONTEXTS, NEAR, LISTED = 16_384, 32_768, 1 << 21
#: The span of contexts without a time.
ANY_TIME = -(1 << 62)
#: Bits of a word, and characters of the other title that run against them; a longer one is left to the comparison.
WORD, RUN = 64, 256
#: Characters after which pairs that are too far apart already are given up.
STOPS = (16, 20, 24, 32, 48)
#: Pairs that run at once.
AT_ONCE = 1 << 16


def ranked(sets: DataFrame) -> DataFrame:
    """``sets`` with their tokens in the order of the tokens' frequency within the group; a repeat is a token of its own."""
    single = sets.select("grp", "id", F.explode("tokens").alias("token")).groupBy("grp", "id", "token").agg(F.count("*").alias("times"))
    single = single.select("grp", "id", F.explode(F.transform(F.sequence(F.lit(1), "times"), lambda k: F.xxhash64("token", k))).alias("token"))
    counts = single.groupBy("grp", "token").agg(F.count("*").alias("n"))
    lists = single.join(counts, ["grp", "token"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranks"))
    return sets.drop("tokens").join(lists.select("id", F.col("ranks.token").alias("tokens")), "id")


def overlap_candidates(sets: DataFrame, near: Callable[[Column, Column], Column] | None = None, most: int = MOST) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids whose sets (grp, id, tokens, need, known) can share what both need.

    ``need`` is at least 1 and holds for any partner; ids are unique over all groups. ``near`` tests what is ``known`` of two
    sets. Tokens and paths are hashes here: equal ones meet, and different ones hardly ever.
    """
    sets = ranked(sets).where(F.size("tokens") >= F.col("need"))
    sets = written(sets.withColumn("seen", F.struct("id", "need", "known", F.size("tokens").alias("n"), *[p.alias(f"odd{k}") for k, p in enumerate(_parities(F.col("tokens")))])).drop("known"), "sets")
    prefix = F.slice("tokens", 1, F.size("tokens") - F.col("need") + 1)
    rows = sets.select("grp", "seen", F.posexplode(prefix).alias("at", "path"))
    found, depth = None, 1
    while True:
        counts = rows.groupBy("grp", "path").agg(F.count("*").alias("n"), F.max("seen.need").alias("top")).where("n > 1")
        met = written(rows.join(counts, ["grp", "path"]), "lists")
        light = met.where((F.col("n") <= most) | (F.col("seen.need") <= depth))
        pairs = _listed(light, near)
        found = pairs if found is None else found.unionByName(pairs)
        heavy = met.where((F.col("n") > most) & (F.col("top") > depth))
        if heavy.isEmpty():
            return found.distinct()
        depth += 1
        longer = heavy.select("grp", F.col("seen.id").alias("id"), "at", "path").join(sets.select("id", "need", "seen", "tokens"), "id")
        later = F.slice("tokens", F.col("at") + 2, F.greatest(F.size("tokens") - F.col("need") + depth - F.col("at") - 1, F.lit(0)))
        opened = longer.select("grp", "seen", "at", "path", F.posexplode(later).alias("step", "token"))
        rows = opened.select("grp", "seen", (F.col("at") + 1 + F.col("step")).alias("at"), F.xxhash64("path", "token").alias("path"))


def _parities(tokens: Column) -> list[Column]:
    """512 kinds of tokens as bits that say whether a set has an odd number of a kind: a token more or less changes one bit."""
    kind = lambda t: F.pmod(t, F.lit(PARITIES * 64))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), (kind(t) % 64).cast("int"))
    flip = lambda k: lambda bits, t: F.when(F.floor(kind(t) / 64) == k, bits.bitwiseXOR(bit(t))).otherwise(bits)
    return [F.aggregate(tokens, F.lit(0).cast("long"), flip(k)) for k in range(PARITIES)]


def _apart(x: Column, y: Column, names: list[str]) -> Column:
    """Bits in which two structs differ."""
    one, *rest = [F.bit_count(x[name].bitwiseXOR(y[name])) for name in names]
    return sum(rest, one)


def _listed(rows: DataFrame, near: Callable[[Column, Column], Column] | None) -> DataFrame:
    """The pairs within each list of rows that no bound rules out."""
    one = rows.select("grp", "path", F.col("seen").alias("x"))
    x, y = F.col("x"), F.col("y")
    need = F.greatest(x["need"], y["need"])
    fits = (x["id"] < y["id"]) & (_apart(x, y, [f"odd{k}" for k in range(PARITIES)]) <= x["n"] + y["n"] - 2 * need)
    if near is not None:
        fits &= near(x["known"], y["known"])
    met = one.join(one.withColumnRenamed("x", "y"), ["grp", "path"]).where(fits)
    return met.select(x["id"].alias("a"), y["id"].alias("b"))


def alike_titles(titles: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of titles (grp, id, t) of one group that can have a ratio of ``least``; equal titles are left out.

    Empty titles, and titles of one character, are alike to none but their equals. ``least`` is above 5/6. A group is blocks of
    about ``block`` titles, each two blocks are a cell, and a task holds one cell at a time.
    """
    if not LEAST_RATIO < least <= 1:
        raise ValueError("titles of a ratio of 5/6 or less need not share anything that they could meet by")
    long_enough = titles.where(F.length("t") >= 2)
    blocks = long_enough.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sorted_ = long_enough.join(blocks, "grp").select("grp", "id", "blocks", own.alias("block"), F.length("t").alias("size"), F.left("t", F.lit(RUN)).alias("t"), _kinds(F.col("t")).alias("kinds"))
    marks = sorted_.select("*", *[bits.alias(f"bag{k}") for k, bits in enumerate(_bag(F.col("kinds")))]).drop("kinds")
    placed = marks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    kind = titles.schema["id"].dataType.simpleString()
    return cells.repartition(tasks_of(titles), "grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(_alike_in_cell(least), f"a {kind}, b {kind}")


def _alike_in_cell(least: float) -> Callable[[pa.Table], pa.Table]:
    """The pairs of a cell that no bound rules out, one of each block (or both of the only one)."""

    def pairs_of(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("size")
        ids, size, block = (cell[name].to_numpy() for name in ("id", "size", "block"))
        size = size.astype(np.int64)
        bags = [cell[f"bag{k}"].to_numpy().view(np.uint64) for k in range(BAGS)]
        kinds, masks = _characters(cell["t"].to_pylist())
        one, other = (np.flatnonzero(block == cell[name][0].as_py()) for name in "ij")
        single = cell["i"][0].as_py() == cell["j"][0].as_py()
        bags, sizes = [bag[other] for bag in bags], size[other]
        own = [cell[f"bag{k}"].to_numpy().view(np.uint64) for k in range(BAGS)]
        share = least / (2 - least)
        starts, ends = np.searchsorted(sizes, size * share - SLACK), np.searchsorted(sizes, size / share + SLACK, side="right")
        found, waiting, n = [], [], 0
        for at, x in enumerate(one):
            start, end = at + 1 if single else starts[x], ends[x]
            apart = sum(np.bitwise_count(own[k][x] ^ bags[k][start:end]).astype(np.uint16) for k in range(BAGS))
            y = other[start + np.flatnonzero(apart <= (1 - least) * (size[x] + sizes[start:end]) + SLACK)]
            waiting.append((np.full(len(y), x), y))
            n += len(y)
            if n >= AT_ONCE:
                found.append(_subsequent(waiting, size, kinds, masks, least))
                waiting, n = [], 0
        found.append(_subsequent(waiting, size, kinds, masks, least))
        x, y = (ids[np.concatenate([f[k] for f in found])] for k in (0, 1))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return pairs_of


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the kinds of its characters, ended by kind 64, and where in its first 64 characters each kind is, as bits.

    The most frequent characters are kinds of their own and the others share kinds, which makes texts no less alike.
    """
    lengths = np.array([len(t) for t in texts])
    codes, of, times = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True, return_counts=True)
    rank = np.empty(len(codes), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(codes))
    rank = np.where(rank < 48, rank, 48 + rank % 16).astype(np.uint8)
    kinds = np.full((len(texts), lengths.max()), WORD, np.uint8, order="F")
    kinds[np.arange(lengths.max()) < lengths[:, None]] = rank[of]
    masks = np.zeros((len(texts), WORD + 1), np.uint64)
    rows = np.arange(len(texts))
    for at in range(min(WORD, kinds.shape[1])):
        masks[rows, kinds[:, at]] |= np.uint64(1 << at)
    masks[:, WORD] = 0
    return kinds, masks


def _subsequent(waiting: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, kinds: np.ndarray, masks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of places whose longest common subsequence is long enough; of the first text, what is behind 64 characters counts as common.

    Between the first k characters of both texts as many are unmatched as between the whole texts at most, and as many more as their
    lengths differ: where the k-th of one meets another place than the k-th of the other, the way there and the way on both pay for it.
    """
    if not waiting:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
    flat, base, left = masks.reshape(-1), x * (WORD + 1), np.full(len(x), ~np.uint64(0))
    for at in range(min(kinds.shape[1], int(size[y].max(initial=0)))):
        if at in STOPS and len(x):
            unmatched = 2 * at - 2 * np.bitwise_count(~left & np.uint64((1 << at) - 1)).astype(np.int64)
            most = (1 - least) * (size[x] + size[y]) + np.abs(size[x] - size[y]) + SLACK
            near = (np.minimum(size[x], size[y]) < at) | (unmatched <= most)
            x, y, base, left = x[near], y[near], base[near], left[near]
        met = left & flat[base + kinds[:, at][y]]
        left = (left + met) | (left ^ met)
    first = np.minimum(size[x], WORD)
    common = np.bitwise_count(~left & (~np.uint64(0) >> (WORD - first).astype(np.uint64))) + (size[x] - first)
    keep = (size[y] > RUN) | (common >= least / 2 * (size[x] + size[y]) - SLACK)
    return x[keep], y[keep]


def _kinds(text: Column) -> Column:
    """The kinds of a text's characters, of sixty-four, in order."""
    return F.array_sort(F.transform(F.split(text, ""), lambda c: F.pmod(F.xxhash64(c), F.lit(64)).cast("int")))


def _bag(kinds: Column) -> list[Column]:
    """Sixty-four kinds of characters as bits: those that a title has once or more, twice or more, and so on.

    A character more or less changes one bit at most, so titles are apart by at most as many bits as characters are unmatched.
    """
    mark = lambda k: lambda kinds: F.aggregate(F.sequence(F.lit(k), F.greatest(F.size(kinds), F.lit(k + 1)) - 1), F.lit(0).cast("long"), lambda bits, i: F.when(F.get(kinds, i - k) == F.get(kinds, i), bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.get(kinds, i)))).otherwise(bits))
    return [similarity.bound(kinds, mark(k)) for k in range(BAGS)]


def contained_titles(titles: DataFrame, size: int = similarity.LEAST_CONTAINED) -> DataFrame:
    """Pairs (a, b), a < b, of different titles (grp, id, t), of which one has ``size`` characters or more and is within the other.

    A title asks for its rarest run of ``size`` characters, which all titles that hold it have, too.
    """
    hashes = similarity.bound(F.col("t"), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - size + 1), lambda i: F.xxhash64(F.substr(t, i, F.lit(size)))))
    runs = titles.where(F.length("t") >= size).select("grp", "id", F.explode(hashes).alias("run")).distinct()
    counts = runs.groupBy("grp", "run").agg(F.count("*").alias("n"))
    marked = written(runs.join(counts, ["grp", "run"]), "runs")
    # Only a title all of whose runs others have, too, can be within another.
    asked = marked.groupBy("grp", "id").agg(F.min(F.struct("n", "run")).alias("rarest")).where("rarest.n > 1")
    shared = marked.where("n > 1")
    met = asked.select("grp", F.col("id").alias("short"), F.col("rarest.run").alias("run")).join(shared.select("grp", "run", F.col("id").alias("long")), ["grp", "run"]).where("short <> long")
    texts = titles.select("id", "t")
    met = met.select("short", "long").join(texts.select(F.col("id").alias("short"), F.col("t").alias("x")), "short").join(texts.select(F.col("id").alias("long"), F.col("t").alias("y")), "long")
    inside = met.where(F.contains("y", F.col("x")))
    return inside.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()


def similar_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, contained) for pairs of different titles (grp, id, t) that one of the two tests may find alike."""
    alike = alike_titles(titles, least).withColumn("contained", F.lit(False))
    inside = contained_titles(titles).withColumn("contained", F.lit(True))
    return alike.unionByName(inside).groupBy("a", "b").agg(F.max("contained").alias("contained"))


def shared_contexts(contexts: DataFrame, within: int, block: int = CONTEXTS) -> DataFrame:
    """(signal, pool) of contexts (side, class, pairs, names, early, late) of sides 0 and 1 that pass ``similarity.context_match``.

    ``pairs`` and ``names`` are distinct hashes of 64 bits. ``early`` and ``late`` are a class's first and last stamp; classes that
    are more than ``within`` apart are left out, and null is any time. Blocks of both sides make cells, and a task holds one cell.
    """
    sizes = contexts.groupBy("side").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    other = sizes.select((1 - F.col("side")).alias("side"), F.col("blocks").alias("others"))
    placed = contexts.join(F.broadcast(sizes), "side").join(F.broadcast(other), "side")  # two rows each
    cells = placed.withColumns({"own": F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), "over": F.explode(F.sequence(F.lit(0), F.col("others") - 1))})
    cells = cells.withColumns({"i": F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("over")), "j": F.when(F.col("side") == 0, F.col("over")).otherwise(F.col("own"))})
    return cells.drop("blocks", "others", "own", "over").groupBy("i", "j").applyInArrow(_contexts_in_cell(within), "signal string, pool string")


def _contexts_in_cell(within: int) -> Callable[[pa.Table], pa.Table]:
    def pairs_of(cell: pa.Table) -> pa.Table:
        sides = [cell.filter(pyarrow.compute.equal(cell["side"], n)) for n in (0, 1)]
        early, late = ([side[name].fill_null(other).to_numpy() for side in sides] for name, other in (("early", -(1 << 60)), ("late", 1 << 60)))
        near = lambda x, y: (early[0][x] - late[1][y] <= within) & (early[1][y] - late[0][x] <= within)
        x, y = _sharing(sides, near)
        return pa.table({"signal": sides[0]["class"].take(x), "pool": sides[1]["class"].take(y)})

    return pairs_of


def near_contexts(early: DataFrame, late: DataFrame | None, within: int, block: int = NEAR) -> DataFrame:
    """(early, late), numbers of contexts (n, ms, title, pairs, names) that pass ``similarity.context_match`` at most ``within`` apart in time.

    Without ``late`` each pair of ``early`` contexts is listed once, the smaller number first. With it, each of ``late`` is listed with the
    smallest of ``early`` that it matches, if that is below its ``bound`` (null is none). Contexts of one title (a hash, 0 for an empty one) are no
    pairs here. A null time is near any other. Contexts are dealt out by spans of ``within`` and meet in the same span and the next
    one, in cells of two blocks, so that a context is written as often as three spans have blocks.
    """
    whole, alone = max(within, 1), late is None
    span = F.coalesce(F.call_function("div", F.col("ms"), F.lit(whole).cast("long")), F.lit(ANY_TIME))
    right, left = (early if alone else late).withColumn("span", span), early.withColumn("own", span)
    reached = [F.col("own") + k for k in ([0, 1] if alone else [-1, 0, 1])] + ([] if alone else [F.lit(ANY_TIME)])
    timed = left.where(F.col("own") != ANY_TIME).withColumn("span", F.explode(F.array(*reached)))
    timeless = left.where(F.col("own") == ANY_TIME)  # these are near any other
    asking = timed.groupBy("span").agg(F.count("*").alias("n")).join(right.groupBy("span").agg(F.ceil(F.count("*") / block).cast("int").alias("rights")), "span", "right")
    sizes = asking.crossJoin(timeless.agg(F.count("*").alias("more"))).select("span", F.ceil((F.coalesce("n", F.lit(0)) + F.col("more")) / block).cast("int").alias("lefts"), "rights")
    sizes = F.broadcast(written(sizes.where("lefts > 0"), "sizes"))
    at = lambda n: F.pmod(F.xxhash64("n", "ms"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["side", "span", "i", "j", "n", "ms", "title", "pairs", "names", "other"]
    placed = timed.join(sizes, "span").unionByName(timeless.crossJoin(sizes))
    askers = placed.withColumns({"side": F.lit(0), "other": F.col("own"), "i": at("lefts"), "j": every("rights")})
    asked = right.join(sizes, "span").withColumns({"side": F.lit(1), "other": F.lit(0).cast("long") if alone else F.col("bound"), "i": every("lefts"), "j": at("rights")})
    cells = askers.select(*columns).unionByName(asked.select(*columns))
    return cells.repartition(tasks_of(early), "span", "i", "j").groupBy("span", "i", "j").applyInArrow(_near_in_cell(within, alone), "early long, late long")


def tasks_of(df: DataFrame) -> int:
    """As many tasks as cores can share, for work of few bytes, which adaptive plans would join by their bytes."""
    session = df.sparkSession
    return max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def _near_in_cell(within: int, alone: bool) -> Callable[[pa.Table], pa.Table]:
    def pairs_of(cell: pa.Table) -> pa.Table:
        sides = [cell.filter(pyarrow.compute.equal(cell["side"], n)) for n in (0, 1)]
        n, title = ([side[name].to_numpy() for side in sides] for name in ("n", "title"))
        ms, timeless = [side["ms"].fill_null(0).to_numpy() for side in sides], [side["ms"].is_null().to_numpy() for side in sides]
        # Alone, two contexts of one span meet on either side.
        limit = (sides[0]["other"] if alone else sides[1]["other"].fill_null((1 << 63) - 1)).to_numpy()
        here = cell["span"][0].as_py()

        def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            one, other = n[0][x], n[1][y]
            first = (one < other) | ((limit[x] != here) & (one > other)) if alone else one < limit[y]
            near = (np.abs(ms[0][x] - ms[1][y]) <= within) | timeless[0][x] | timeless[1][y]
            return first & near & ((title[0][x] != title[1][y]) | (title[0][x] == 0))

        x, y = _sharing(sides, fits)
        one, other = n[0][x], n[1][y]
        if alone:
            return pa.table({"early": np.minimum(one, other), "late": np.maximum(one, other)})
        order = np.lexsort((one, other))
        late, firsts = np.unique(other[order], return_index=True)
        return pa.table({"early": one[order][firsts], "late": late})

    return pairs_of


def _sharing(sides: list[pa.Table], fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of contexts (pairs, names) of two sides that pass ``similarity.context_match``, of those that ``fits`` lets through."""

    def flat(side: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = side[name].combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)

    if not all(side.num_rows for side in sides):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (codes, ends), (others, their_ends) = (flat(side, "pairs") for side in sides)
    owner = np.repeat(np.arange(len(their_ends) - 1), np.diff(their_ends))
    order = np.argsort(others, kind="stable")
    others, owner = others[order], owner[order]
    names = [flat(side, "names") for side in sides]
    low, high = np.searchsorted(others, codes), np.searchsorted(others, codes, side="right")
    total = np.concatenate(([0], np.cumsum(high - low)))[ends]
    known: dict[int, frozenset] = {}
    found, start = [], 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + LISTED, side="right")) - 1)
        first, times = low[ends[start] : ends[stop]], (high - low)[ends[start] : ends[stop]]
        x = np.repeat(np.repeat(np.arange(start, stop), np.diff(ends[start : stop + 1])), times)
        y = owner[np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)]
        near = fits(x, y)
        met, common = np.unique(x[near] * len(their_ends) + y[near], return_counts=True)
        last, own = -1, frozenset()
        for key, shared in zip(met.tolist(), common.tolist(), strict=True):
            a, b = divmod(key, len(their_ends))
            if a != last:
                last, own = a, frozenset(names[0][0][names[0][1][a] : names[0][1][a + 1]].tolist())
            if b not in known:
                known[b] = frozenset(names[1][0][names[1][1][b] : names[1][1][b + 1]].tolist())
            if len(own & known[b]) >= (2 if shared >= 2 else 4):
                found.append(key)
        start = stop
    return np.divmod(np.array(found, np.int64), len(their_ends))
