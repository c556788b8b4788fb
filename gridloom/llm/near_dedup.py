"""Near-duplicate documents by Order MinHash, verified by a banded alignment.

A document is the sequence of its five-word shingles. Two documents are near copies if that many of
their shingles can be matched *in order* that matched / (all - matched) >= 0.8: shingle resemblance
that, unlike a set's, sees edits and moves.

Sketch: every shingle is labelled with its occurrence number in the document, so repeats count. Each of
BANDS hash functions takes the ROW smallest labelled shingles and keeps them in text order; their
hash is the band's key. Alike sequences share a key in some band (at 0.8 all but 1 in 10,000), texts
with only a passage in common seldom. Documents of at most TINY shingles are keyed by their sequence
without up to two shingles at its ends, which is exact: at 0.8 they cannot differ elsewhere.

Candidates never form all pairs of a bucket. Its members are compared with a leader, the one whose keys are
commonest (the unedited original of a family, as edits make keys rare; ties to the smaller node). Members that
are not alike to it elect another among themselves, ROUNDS times. What is left of a bucket is
compared in blocks: a pair of blocks is one group, which counts common shingles by matrix products, aligns only
pairs that these counts leave possible and are not connected yet, and returns a spanning forest: never more
links than members.

Nothing between two families of a bucket is lost by that. 1 - similarity is a metric (for insertions and deletions
d it is 2 d / (|x| + |y| + d), the Steinhaus form of an edit distance), so a text further than 0.4 from a leader has no
copy within 0.2 of that leader; one at a distance between 0.2 and 0.4 is compared in blocks with those of the
leader's followers that the triangle inequality leaves.

Exact copies meet first, by 128 bits over their words, and only one of each goes further.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm.words import Bag, grams, mix
from gridloom.session import Scratch, lean, lean_group, ship, shuffle_width

SHINGLE, SIMILARITY = 5, 0.8
#: Keys per document, and labelled shingles per key.
BANDS, ROW = 24, 5
#: Documents of up to TINY shingles have end-trimmed keys, those of FULL or more have the bands' keys.
TINY, FULL = 10, 9
#: Equal cells for each shingle up to which an alignment visits only those.
CELLS = 32
#: Leaders that a bucket elects before the rest of it is compared in blocks, and members that a block holds, about.
ROUNDS, BLOCK = 3, 256
#: Similarity to a leader under which a text has no near copy among the leader's followers: twice the distance of a near copy.
FAR = 2 * SIMILARITY - 1
_SEEDS = np.random.default_rng(3).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def _occurrences(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often the same shingle came before in its document, for each shingle."""
    order = np.lexsort((h, owner))
    a, b = h[order], owner[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(h) else np.empty(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), dtype=np.uint64)
    out[order] = np.arange(len(h)) - start
    return out


def _keys(labelled: np.ndarray) -> np.ndarray:
    """One key per band: the ROW smallest labelled shingles of each hash function, in text order."""
    hashed = labelled[None, :] * _SEEDS[:, None]
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0x9FB21C651E98DF25)
    if hashed.shape[1] > ROW:
        at = np.argpartition(hashed, ROW - 1, axis=1)[:, :ROW]
        at.sort(axis=1)
        chosen = labelled[at]
    else:
        chosen = np.broadcast_to(labelled, hashed.shape)
    key = np.zeros(BANDS, dtype=np.uint64)
    for j in range(chosen.shape[1]):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + chosen[:, j])
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _tiny_keys(h: np.ndarray) -> list[int]:
    """Hashes of the sequence without up to two shingles at its ends."""
    out = set()
    for head, tail in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)):
        if len(h) > head + tail:
            key = np.uint64(len(h) - head - tail)
            for x in h[head : len(h) - tail]:
                key = mix(key * np.uint64(0x2545F4914F6CDD1D) + x)
            out.add(int(key.astype(np.int64)))
    return sorted(out)


def sketch(docs: DataFrame) -> DataFrame:
    """node (unique per row), doc_id, two halves of a hash of all words, n_words, the bands' keys and the shingles (4 bytes each).

    Under five words there is no shingle and no key: such texts match only exactly. A null text has no words.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = TaskContext.get().partitionId() << 36
        for pdf in batches:
            size = np.fromiter((len(t or "") for t in pdf["text"]), dtype=np.int64, count=len(pdf))
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(size) // (1 << 20))) + 1):
                if len(part):
                    yield _sketch_part(pdf.iloc[part], node)
                    node += len(part)

    return docs.select("doc_id", "text").mapInPandas(lean(run), "node long, doc_id long, e1 long, e2 long, n_words long, keys array<long>, shingles binary")


@np.errstate(over="ignore")
def _sketch_part(pdf: pd.DataFrame, node: int) -> pd.DataFrame:
    bag = Bag([(t or "").encode() for t in pdf["text"]])
    at = bag.windows(SHINGLE)
    owner = bag.text_of[at]
    h = grams(bag.hashes, SHINGLE)[at]
    labelled = mix(h + _occurrences(h, owner) * np.uint64(0x9E3779B97F4A7C15))
    edge = np.searchsorted(owner, np.arange(len(pdf) + 1))
    # order-aware sums over each text's words
    place = (np.arange(len(bag.starts)) - np.repeat(bag.first, bag.n_words)).astype(np.uint64)
    sums = []
    for salt in (0x9FB21C651E98DF25, 0xA24BAED4963EE407):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(bag.hashes * np.uint64(salt) + mix(place + np.uint64(salt))), dtype=np.uint64)))
        sums.append((total[bag.first + bag.n_words] - total[bag.first]).astype(np.int64))
    keys = []
    for k in range(len(pdf)):
        mine = slice(edge[k], edge[k + 1])
        n = mine.stop - mine.start
        found = _keys(labelled[mine]).astype(np.int64).tolist() if n >= FULL else []
        keys.append(found + (_tiny_keys(h[mine]) if 0 < n <= TINY else []))
    small = h.astype(np.uint32)
    return pd.DataFrame({
        "node": node + np.arange(len(pdf)), "doc_id": pdf["doc_id"].astype("Int64").array, "e1": sums[0], "e2": sums[1], "n_words": bag.n_words,
        "keys": keys, "shingles": [small[edge[k] : edge[k + 1]].tobytes() for k in range(len(pdf))],
    })


def _banded(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> np.ndarray:
    """Insertions plus deletions between padded rows of ``a`` and ``b``, along diagonals -width..width of all pairs at once.

    Exact where the result is at most ``width``, else a value above it.
    """
    n, far = len(a), np.int32(1 << 28)
    span = 2 * width + 1
    shift = np.arange(span, dtype=np.int32)
    # cell (i, i + d - width): cost of the first i of a against the first i + d - width of b
    cost = np.broadcast_to(np.where(shift >= width, shift - width, far), (n, span)).astype(np.int32)
    done = np.full(n, far, dtype=np.int32)
    column = nb - na + width
    ok = (column >= 0) & (column < span)
    at_end = ok & (na == 0)
    done[at_end] = cost[at_end, column[at_end]]
    padded = np.zeros((n, b.shape[1] + 2 * width + 1), dtype=b.dtype)
    padded[:, width : width + b.shape[1]] = b
    limit = nb[:, None]
    for i in range(1, a.shape[1] + 1):
        j = i + shift - width
        same = (padded[:, i - 1 : i - 1 + span] == a[:, i - 1 : i]) & (j >= 1) & (j <= limit)
        up = np.empty_like(cost)
        up[:, :-1] = cost[:, 1:] + 1
        up[:, -1] = far
        cost = np.minimum(np.where(same, cost, far), up)
        cost[:, (j < 0)] = far
        cost = np.minimum.accumulate(cost - shift, axis=1) + shift
        ends = ok & (na == i)
        if ends.any():
            done[ends] = cost[ends, column[ends]]
    return done


def _matched(x: np.ndarray, y: np.ndarray, band: int) -> int | None:
    """Most shingles of ``x`` and ``y`` that an alignment within ``band`` diagonals of the main one matches; None if too many cells of the band are equal.

    Only equal cells of the band are visited: each row's from right to left, so that the longest rising sequence of columns
    is the alignment.
    """
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    low, high = np.searchsorted(ranked, x, side="left"), np.searchsorted(ranked, x, side="right")
    n = high - low
    total = int(n.sum())
    if total > CELLS * (len(x) + len(y)):
        return None
    row = np.repeat(np.arange(len(x)), n)
    column = order[np.repeat(high, n) - 1 - (np.arange(total) - np.repeat(np.cumsum(n) - n, n))]
    ends: list[int] = []
    for j in column[np.abs(column - row) <= band].tolist():
        if not ends or j > ends[-1]:
            ends.append(j)
        else:
            ends[bisect_left(ends, j)] = j
    return len(ends)


def resemblances(left: list[np.ndarray], right: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """In-order shingle resemblance of each pair, or -1 where it is certainly under ``least``."""
    return aligned(left, right, least)[0]


def aligned(left: list[np.ndarray], right: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """In-order shingle resemblance of each pair, or -1 where it is certainly under ``least``; and what it is at most.

    Common heads and tails are matched outright, and the shingles that the rest has in common bound what an alignment can
    match. The band is as wide as ``least`` allows, and only its equal cells are visited; where these are too many (texts that
    repeat themselves), all cells are, in a band that doubles until the distance fits in it. The answer is exact either way.
    """
    n = len(left)
    out, apart = np.full(n, -1.0), np.zeros(n)
    totals = np.asarray([len(x) + len(y) for x, y in zip(left, right)], dtype=np.float64)
    jobs = []
    for k, (x, y) in enumerate(zip(left, right)):
        total = len(x) + len(y)
        # matched / (total - matched) >= least  <=>  distance <= total * (1 - least) / (1 + least)
        most = int(np.floor(total * (1 - least) / (1 + least) + 1e-9))
        apart[k] = abs(len(x) - len(y))
        if total - apart[k] < min(least, FAR) * (total + apart[k]):
            continue
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        head = int(differ[0]) if len(differ) else m
        differ = np.flatnonzero(x[head:][::-1][: m - head] != y[head:][::-1][: m - head])
        tail = int(differ[0]) if len(differ) else m - head
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        distance = len(x) + len(y)
        if len(x) and len(y):
            # no alignment matches more than what either side has in common with the other
            shared = min(np.isin(x, y).sum(), np.isin(y, x).sum())
            apart[k] = max(apart[k], distance - 2 * shared)
            if shared:
                if apart[k] <= most:
                    matched = _matched(x, y, most)
                    if matched is None:
                        jobs.append((k, x, y, total, most))
                    elif distance - 2 * matched <= most:
                        distance -= 2 * matched
                        out[k] = (total - distance) / (total + distance)
                continue
        else:
            apart[k] = distance
        if distance <= most:
            out[k] = (total - distance) / (total + distance)
    width = 16
    while jobs:
        jobs.sort(key=lambda job: len(job[1]))
        again, a = [], 0
        while a < len(jobs):
            longest, b = len(jobs[a][1]), a
            while b < len(jobs) and (b - a) * (len(jobs[b][1]) + 4 * width) < 2_000_000 and len(jobs[b][1]) <= 1.3 * longest + 32:
                b += 1
            part = jobs[a : max(b, a + 1)]
            a += len(part)
            na, nb = np.asarray([len(j[1]) for j in part]), np.asarray([len(j[2]) for j in part])
            pa_, pb_ = np.zeros((len(part), na.max()), dtype=np.uint32), np.zeros((len(part), max(nb.max(), na.max())), dtype=np.uint32)
            for r, j in enumerate(part):
                pa_[r, : na[r]], pb_[r, : nb[r]] = j[1], j[2]
            for d, job in zip(_banded(pa_, pb_, na, nb, width).tolist(), part):
                k, _, _, total, most = job
                if d <= min(width, most):
                    out[k] = (total - d) / (total + d)
                elif width < most:
                    again.append(job)
        jobs, width = again, width * 4
    upper = np.divide(totals - apart, totals + apart, out=np.ones(n), where=totals > 0)
    return out, np.where(out >= 0, out, np.minimum(upper, least))


def _measured(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """node, leader, alike and gap of the pairs (node, leader) whose similarity may be FAR or more.

    gap is 1 - similarity of pairs that are alike, and a lower bound of it, from the shingles in common, of others.

    The leaders' shingles come first, as a leader may be in any number of pairs; a node is in few, so dealing the
    alignments out by node is even.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = np.fromiter((len(x) + len(y) for x, y in zip(pdf["sa"], pdf["sb"])), dtype=np.int64, count=len(pdf))
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(size) // (32 << 20))) + 1):
                p = pdf.iloc[part]
                s, most = aligned([np.frombuffer(x, dtype=np.uint32) for x in p["sa"]], [np.frombuffer(x, dtype=np.uint32) for x in p["sb"]])
                yield pd.DataFrame({"node": p["node"], "leader": p["leader"], "alike": s >= SIMILARITY, "gap": 1 - most})[most >= FAR]

    left = shingles.select("node", F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("leader"), F.col("shingles").alias("sb"))
    dealt = pairs.join(right.hint("merge"), "leader").repartition(shuffle_width(pairs.sparkSession), "node")
    return dealt.join(left.hint("merge"), "node").select("node", "leader", "sa", "sb").mapInPandas(lean(run), "node long, leader long, alike boolean, gap double")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the component's smallest node) of every node of an edge list a, b.

    Each round a node takes the smallest root among its own and its neighbours', then follows that
    root's own root; rounds grow with the logarithm of the longest path. Only counts reach the driver.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = scratch.save(both, "links")
    state = scratch.save(both.groupBy("x").agg(F.min("y").alias("near")).select(F.col("x").alias("node"), F.least("x", "near").alias("root")), "roots")
    while True:
        near = both.join(state, both.y == state.node).groupBy("x").agg(F.min("root").alias("near"))
        step = scratch.save(state.join(near, state.node == near.x).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "step")
        # a root that learned of a smaller one tells those that point to it; they may be many, so both sides are plain tables
        moved = step.where("root < old").select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = scratch.save(step.join(moved, "root", "left").select("node", F.least(F.coalesce("further", "root"), "root").alias("root"), "old"), "roots")
        changed = new.where("root <> old").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state


def _lead(members: DataFrame) -> DataFrame:
    """(key, leader): each bucket's best supported member. An aggregate that every task prepares, so no task holds a bucket."""
    best = members.groupBy("key").agg(F.max(F.struct("support", F.bitwise_not("node").alias("least"))).alias("best"))
    return best.select("key", F.bitwise_not("best.least").alias("leader"))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many distinct shingles each of ``left`` has in common with each of ``right``."""
    docs = [np.unique(x) for x in (*left, *right)]
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    values, place, count = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        lo, hi = np.searchsorted(place, (a, a + step))
        m = np.zeros((len(docs), step), dtype=np.float32)
        m[owner[lo:hi], place[lo:hi] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks: links that connect all its alike texts, one for each text that gets connected."""
    first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    x, y = ([np.frombuffer(v, dtype=np.uint32) for v in part["shingles"]] for part in (first, second))
    if not x or not y:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    nx, ny = np.asarray([len(v) for v in x]), np.asarray([len(v) for v in y])
    dx, dy = (np.asarray([len(v) - len(np.unique(v)) for v in part]) for part in (x, y))
    # repeats of a shingle may match too, but no more than a side has
    matched = _common(x, y) + np.minimum(dx[:, None], dy[None, :])
    total = nx[:, None] + ny[None, :]
    distance = total - 2 * matched
    nodes, place = np.unique(np.concatenate((first["node"].to_numpy(), second["node"].to_numpy())), return_inverse=True)
    pa, pb = place[: len(x)], place[len(x) :]
    possible = (distance <= total * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6) & (pa[:, None] != pb[None, :])
    # a text at a distance of its leader cannot be alike to a follower that is much nearer to it
    possible &= first["gap"].to_numpy()[:, None] <= second["gap"].to_numpy()[None, :] + 1 - SIMILARITY + 1e-6
    i, j = np.nonzero(possible)
    order = np.lexsort((distance[i, j] / total[i, j], i))
    i, j = i[order], j[order]
    root, out, each = np.arange(len(nodes)), [], 1
    while len(i):
        # the most promising pairs of every text, more of them each time
        turn = np.arange(len(i)) - np.searchsorted(i, i) < each
        for k, m, s in zip(i[turn].tolist(), j[turn].tolist(), resemblances([x[k] for k in i[turn]], [y[k] for k in j[turn]])):
            u, v = root[pa[k]], root[pb[m]]
            if s >= SIMILARITY and u != v:
                root[root == v] = u
                out.append((nodes[pa[k]], nodes[pb[m]]))
        left = ~turn & (root[pa[i]] != root[pb[j]])
        i, j, each = i[left], j[left], 2 * each
    return pd.DataFrame({"a": [min(p) for p in out], "b": [max(p) for p in out]}, dtype="int64")


def _blocked(one: DataFrame, other: DataFrame, shingles: DataFrame, twice: bool, scratch: Scratch) -> DataFrame:
    """a, b: links between the texts ``one`` and ``other`` (key, node, gap) of a key, block by block; with ``twice`` they are the same texts."""
    counts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    many = scratch.save(counts(one, "n0").join(counts(other, "n1"), "key"), "blocks")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def dealt(df: DataFrame, side: int, own: str, met: str, low: Column, high: Column) -> DataFrame:
        rows = df.join(many, "key").withColumn(own, place(f"n{side}"))
        return rows.where(low <= high).select("key", "node", "gap", F.lit(side).alias("side"), own, F.explode(F.sequence(low, high)).alias(met))

    zero, n0, n1 = F.lit(0), F.col("n0") - 1, F.col("n1") - 1
    left = dealt(one, 0, "i", "j", F.col("i") if twice else zero, n1)
    right = dealt(other, 1, "j", "i", zero, F.col("j") if twice else n0)
    rows = left.select("key", "i", "j", "side", "node", "gap").unionByName(right).join(shingles.hint("merge"), "node")
    return rows.select("key", "i", "j", "side", "node", "gap", "shingles").groupBy("key", "i", "j").applyInPandas(lean_group(_meet), "a long, b long")


def _links(members: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links that connect all alike nodes of the buckets ``members`` (key, node, support)."""
    active, tested, measured = members, None, None
    for turn in range(ROUNDS):
        lead = scratch.save(_lead(active), f"lead{turn}")
        led = scratch.save(active.join(lead, "key").where("node <> leader"), f"led{turn}")
        pairs = led.select("node", "leader").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["node", "leader"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{turn}")
        found = scratch.save(_measured(pairs, shingles), f"measured{turn}", small=True)
        tested = pairs if tested is None else tested.unionByName(pairs)
        measured = found if measured is None else measured.unionByName(found)
        alike = measured.where("alike").select("node", "leader")
        failed = scratch.save(led.join(alike, ["node", "leader"], "left_anti").select("key", "node", "support"), f"failed{turn}")
        # with nobody else to meet, a failed member is settled
        more = scratch.save(failed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"open{turn}")
        active = scratch.save(failed.join(more, "key"), f"active{turn}")
    assert measured is not None
    loners = active.select("key", "node", F.lit(0.0).alias("gap"))
    links = scratch.save(_blocked(loners, loners, shingles, True, scratch), "rest", small=True)
    followers = measured.where("alike").select(F.col("leader").alias("key"), "node", "gap")
    beside = scratch.save(_blocked(measured.where("NOT alike").select(F.col("leader").alias("key"), "node", "gap"), followers, shingles, False, scratch), "beside", small=True)
    return followers.select(F.col("key").alias("a"), F.col("node").alias("b")).unionByName(links).unionByName(beside).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class) and exact_of.

    Classes are the connected components of all near copies. exact_of is the smallest doc_id with the same
    words. Texts without words (null, empty, blank) are exact copies of each other. Texts under five words match
    only exactly; a very long text is one row that must fit a task. Ties at exactly 0.8 are near copies. Repeated rows and ids
    are exact copies where their words agree; a row with a null doc_id takes no part and has null class_id and exact_of. An
    empty table gives no row. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "near-dedup")
    rows = scratch.save(sketch(docs), "sketch")
    named = rows.where("doc_id IS NOT NULL")
    # of rows with equal words, the one with the smallest doc_id stands for all
    exact = ["e1", "e2", "n_words"]
    reps = scratch.save(named.groupBy(*exact).agg(F.min(F.struct("doc_id", "node")).alias("r")).select(*exact, F.col("r.doc_id").alias("exact_of"), F.col("r.node").alias("node")), "exact")
    banded = scratch.save(named.select("node", "keys").join(reps.select("node").hint("merge"), "node", "left_semi").select("node", F.explode("keys").alias("key")), "keys")
    # joins on a key, a leader or a root read plain tables on both sides, so that Spark can split a key that many rows have
    busy = scratch.save(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "busy")
    met = scratch.save(banded.join(busy.hint("merge"), "key"), "met")
    support = met.groupBy("node").agg(F.sum(F.log2("n")).alias("support"))
    members = scratch.save(met.select("key", "node").join(support, "node"), "members")
    shingles = scratch.save(rows.select("node", "shingles").join(support.select("node").hint("merge"), "node", "left_semi"), "shingles")
    roots = components(scratch.save(_links(members, shingles, scratch), "edges"), scratch)
    placed = scratch.save(reps.join(roots, "node", "left").select(*exact, "exact_of", F.coalesce("root", "node").alias("root")), "placed")
    smallest = scratch.save(placed.groupBy("root").agg(F.min("exact_of").alias("class_id")), "smallest")
    classes = scratch.save(placed.join(smallest, "root").drop("root"), "classes")
    found = named.select("doc_id", *exact).join(classes, exact).select("doc_id", "class_id", "exact_of")
    unnamed = rows.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("exact_of"))
    return found.unionByName(unnamed)


def keep_one(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class, the row with the smallest doc_id.

    Of rows repeated under that doc_id, one stays. Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, scratch)
    stay = found.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
        kept = kept.withColumn("__copy", F.row_number().over(first)).where("__copy = 1").drop("__copy")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
