"""N-gram Jaccard self-join by count-vector R-trees.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least 75 %. A text's *point* is its count vector: shingles are hashed into
``GROUPS`` groups and counted. Two sets share at most the sum over the groups of
the smaller count, and two boxes of points at most the sum of the smaller upper
corners; what can't reach the overlap asked for is never compared. A tree splits
its points between two far apart, down to leaves of ``LEAF`` points or fewer;
every node keeps the upper corner of its points and their least and greatest
size, and two trees are walked together from the top, so whole subtrees go where
their boxes can't meet.

Points of unrelated texts of one length lie near each other, so a single tree
over a corpus would still have to visit very many leaves for each text. Its upper
level is therefore a key and boxes come below:

1. *Root buckets.* Each text lists its shingles with a hash below c / n (n: its
   number of shingles): about 64, all of them for short texts. A shingle that
   two texts list opens a bucket, named by the least text in it, so that copies
   meet in one bucket and not in 64.
2. *Who may enter.* A text with fewer than ``MIN_SHARED`` of its listed shingles
   in other texts has no partner (75 % are expected) and drops out: most of a
   corpus. A shingle in over ``HOT`` texts (a notice, a frequent passage) opens
   no bucket to texts that have over ``COLD_SHARE`` other listed shingles: these
   meet their partners in those. Texts made of hot shingles alone, as in large
   groups of near copies, still enter by them.
3. *Trees.* A bucket of at most ``CHUNK`` texts is one tree, joined with itself
   in one task. A larger one is cut by size class and hash into chunks, each a
   tree; representatives of what is linked in each chunk are linked next; then
   only leaves of different chunks that hold texts not yet linked together, and
   whose boxes can meet, are compared. A group of copies is thus moved a fixed
   number of times, whatever its size.
4. *Verification.* Points that pass the bound are compared by their sets. Pairs
   that other links already tie together are skipped, so a task returns a forest
   of links, never all pairs of a group.

*What can be missed.* The lists are samples by hash. For two texts that link,
the chance that they share no bucket, or that one of them drops out by
``MIN_SHARED``, is below 1e-9 (binomial tail at 64 listed shingles of which 75 %
are shared). ``exact=True`` lists every shingle and lets every text enter every
bucket: then nothing rests on chance but 64-bit hashes, which stand for
shingles and sets throughout.

Texts with equal sets are one node from the start. Components are found by star
contraction over link tables.

Defined results: null or blank text has the empty set, links with nothing and
is its own component; repeated rows share a component; ids may be of any type
that has an order; a null id is never the least of a component that has another
id; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_split, map_texts, packed, quoted, skew_join, small_batches, staged, unpacked
from .graph import components
from .shingles import K, set_identity, shingle_sets

PERCENT = 75
GROUPS = 1024
FOLDED = 4  # groups taken together where point meets point
LISTED = 48  # shingles listed on a text's own account; its list has a third more
HOT = 64
LEAF = 32
LOOSE = 2.0  # a box's corner, in shingles of its largest text
CHUNK = 2048
CHUNK_SHINGLES = 1 << 22
CLASS_RATIO = 0.74  # sizes of a class; texts that link are in the same class or neighbours
MIN_SHARED = 0.3
COLD_SHARE = 0.7
SEEN = 1_000_000


def _digest(k: int, exact: bool):
    def make():
        seen: set[int] = set()

        def digest(texts: list) -> tuple:
            sizes, sigs, lists = [], [], []
            for s in shingle_sets(texts, k):
                n = len(s)
                sig = set_identity(s) if n else None
                sizes.append(n)
                sigs.append(sig)
                if not n or sig in seen:  # the list of an equal set has gone out from this task
                    lists.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                share = LISTED / (0.75 * n)
                own = n if exact or share >= 1 else int(np.searchsorted(s, np.uint64(int(share * 2**64))))
                lists.append(s[:own].view(np.int64))
            return None, [sizes, sigs, lists]

        return digest

    return make


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s for s in shingle_sets(pdf["text"], k) if len(s)]
            yield pd.DataFrame({"sig": np.array([set_identity(s) for s in sets], np.int64), "hashes": [s.tobytes() for s in sets]})

    return run


class Forest:
    """Union-find over the points of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.changed = False

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while self.changed:
            higher = self.up[self.up]
            self.changed = not np.array_equal(higher, self.up)
            self.up = higher
        return self.up

    def tie(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.changed = True
        return a != b


class Points:
    """Sets, their sizes and count vectors, and the forest of what is linked."""

    def __init__(self, sig: np.ndarray, hashes: list[np.ndarray], percent: int = PERCENT, component: np.ndarray | None = None):
        self.sig, self.hashes, self.percent = sig, hashes, percent
        self.size = np.array([len(s) for s in hashes], np.int64)
        self.point = np.stack([np.bincount((s >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in hashes]).astype(np.int32 if self.size.max() > 10_000 else np.int16)
        self.coarse = self.point.reshape(len(sig), -1, FOLDED).sum(axis=2, dtype=self.point.dtype)
        self.forest, self.links = Forest(len(sig)), []
        if component is not None:  # what is known to be linked already
            _, first, group = np.unique(component, return_index=True, return_inverse=True)
            self.forest.up = np.minimum(first[group], np.arange(len(sig)))

    def may_meet(self, most: np.ndarray, size_a, size_b) -> np.ndarray:
        """Whether an overlap of ``most`` is enough for sizes (the least of each side)."""
        return most * (100 + self.percent) >= self.percent * (size_a + size_b)

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Link points of ``left`` with points of ``right``; with itself if they are the same."""
        size, same = self.size, left is right
        x, y = size[left][:, None], size[right][None, :]
        may = (x * 100 >= y * self.percent) & (y * 100 >= x * self.percent)
        if same:
            may = np.triu(may, 1)
        if not may.any():
            return
        most = np.minimum(self.coarse[left][:, None, :], self.coarse[right][None, :, :]).sum(axis=2)
        may &= self.may_meet(most, x, y)
        for k in np.flatnonzero(may.any(axis=1)):
            i, js = left[k], right[may[k]]
            while len(js):
                roots = self.forest.roots()
                js = js[roots[js] != roots[i]]
                part, js = js[:64], js[64:]
                if not len(part):
                    break
                flat = np.concatenate([self.hashes[j] for j in part])
                at = np.searchsorted(self.hashes[i], flat)
                at[at == size[i]] = 0
                both = np.add.reduceat((self.hashes[i][at] == flat).astype(np.int64), np.cumsum([0, *[size[j] for j in part[:-1]]]))
                for j in part[self.may_meet(both, size[part], size[i])]:
                    if self.forest.tie(i, j):
                        self.links.append((int(self.sig[i]), int(self.sig[j])))


class Node:
    """Points of a subtree: their upper corner, least and greatest size, number of leaves."""

    __slots__ = ("rows", "upper", "least", "greatest", "kids", "leaves", "close")

    def __init__(self, points: Points, rows: np.ndarray):
        self.rows, self.kids, self.leaves = rows, (), 1
        self.upper = points.point[rows].max(axis=0)
        self.least, self.greatest = points.size[rows].min(), points.size[rows].max()
        # How many of the points are in boxes not much larger than themselves.
        self.close = len(rows) if self.upper.sum() <= LOOSE * self.greatest else 0


def grow(points: Points, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over ``rows``, split between two points far apart.

    Each point goes with the nearer of the two, so near copies stay together.
    Nodes of ``leaf`` points or fewer with a large box are split further, if that
    leaves most of their points in small boxes.
    """
    root = Node(points, rows)
    order = [root]
    for node in order:
        n = len(node.rows)
        if n <= (leaf if node.close else leaf // 2):
            continue
        inside = points.point[node.rows]
        away = lambda i: np.abs(inside - inside[i]).sum(axis=1)
        first = away(np.argmax(away(0)))
        nearer = first - away(np.argmax(first))  # below 0: nearer to the first
        high = nearer > 0
        if not n // 8 <= high.sum() <= n - n // 8 or not high.any():
            high = np.zeros(n, bool)
            high[np.argsort(nearer, kind="stable")[n // 2 :]] = True
        node.kids = (Node(points, node.rows[~high]), Node(points, node.rows[high]))
        order += node.kids
    for node in reversed(order):
        if node.kids:
            node.close = node.kids[0].close + node.kids[1].close
            node.leaves = node.kids[0].leaves + node.kids[1].leaves
            if len(node.rows) <= leaf and 2 * node.close < len(node.rows):
                node.kids, node.leaves = (), 1
    return root


def join_trees(points: Points, a: Node, b: Node, found: Counter | None = None) -> None:
    """Link the points of two trees (or of one with itself), pruning from the top down.

    ``found`` counts pairs of leaves: pruned by size, pruned by box, tied
    together already, compared.
    """
    found = Counter() if found is None else found
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        if a is b:
            if a.kids:
                waiting += [(a.kids[0], a.kids[1]), (a.kids[1], a.kids[1]), (a.kids[0], a.kids[0])]
            else:
                found["compared"] += 1
                points.compare(a.rows, a.rows)
            continue
        pairs = a.leaves * b.leaves
        if a.greatest * 100 < b.least * points.percent or b.greatest * 100 < a.least * points.percent:
            found["by size"] += pairs
        elif not points.may_meet(np.minimum(a.upper, b.upper).sum(dtype=np.int64), a.least, b.least):
            found["by box"] += pairs
        elif len(np.unique(points.forest.roots()[np.concatenate([a.rows, b.rows])])) == 1:
            found["tied"] += pairs
        elif not a.kids and not b.kids:
            found["compared"] += 1
            points.compare(a.rows, b.rows)
        else:
            longer, other = (a, b) if a.leaves >= b.leaves else (b, a)
            waiting += [(kid, other) for kid in longer.kids]


def _unpacked_sets(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in group["hashes"]]


def _by_group(keys: list[str], solve, columns: list[str]):
    """``solve`` for each run of rows with equal keys; rows come sorted by them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:  # a group may go on in the next batch
            found = []
            key = list(zip(*[pdf[k] for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if last is not None and key[a] != last:
                    found += solve(pd.concat(held, ignore_index=True))
                    held = []
                held.append(pdf.iloc[a:b])
                last = key[a]
            yield pd.DataFrame(found, columns=columns)
        if held:
            yield pd.DataFrame(solve(pd.concat(held, ignore_index=True)), columns=columns)

    return run


def _tree_roots(percent: int, keys: list[str]):
    """Each text of a group with the least text that the group's links tie it to."""

    def solve(group: pd.DataFrame) -> list[tuple]:
        points = Points(group["sig"].to_numpy(np.int64), _unpacked_sets(group), percent)
        tree = grow(points, np.arange(len(group)))
        join_trees(points, tree, tree)
        place = [group[k][0] for k in keys]
        return [(*place, *pair) for pair in zip(points.sig.tolist(), points.sig[points.forest.roots()].tolist(), strict=True)]

    return solve


def _linked_in_groups(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, sig, root) by the trees over ``rows`` (keys, sig, hashes), one tree a key."""
    types = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    sorted_rows = rows.select(*keys, "sig", "hashes").repartition(*keys).sortWithinPartitions(*keys, "sig")
    return sorted_rows.mapInPandas(_by_group(keys, _tree_roots(percent, keys), [*keys, "sig", "root"]), ", ".join([*types, "sig long", "root long"]))


def _buckets(listed: DataFrame, exact: bool) -> DataFrame:
    """(bucket, sig, n) of the texts that may have a partner."""
    lists = listed.select("sig", "n", F.size("listed").alias("z"), F.explode("listed").alias("h"))
    seen = lists.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count(F.lit(1)).alias("found")).filter("lo <> hi")
    seen = staged(seen.select("h", "found"), "shared-shingles")
    may, _ = bitmap_split(lists, "h", seen)
    shared = skew_join(may, seen.withColumn("hot", F.col("found") > HOT), ["h"], "found").select("sig", "n", "z", "h", "hot").distinct()
    shared = staged(shared, "lists")
    if exact:
        entering = shared.select("sig", "n", "h")
    else:
        judged = (
            shared.groupBy("sig")
            .agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("shared"), F.sum(F.col("hot").cast("int")).alias("hots"))
            .filter(F.col("shared") >= F.col("z") * MIN_SHARED)
            .select("sig", (F.col("z") - F.col("hots") < F.col("z") * COLD_SHARE).alias("by_hot"))
        )
        entering = shared.join(judged, "sig").filter(~F.col("hot") | F.col("by_hot")).select("sig", "n", "h")
    entering = staged(entering, "entering")
    # The bucket's name: the least text that enters. Summed up before it is moved.
    names = entering.groupBy("h").agg(F.min("sig").alias("bucket"), F.max("sig").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("bucket <> hi").select("h", "bucket", "rows")
    return skew_join(entering, names, ["h"], "rows").select("bucket", "sig", "n").distinct()


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a chunk number: at most about CHUNK rows and CHUNK_SHINGLES each."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    sums = sums.withColumn("chunks", F.greatest(F.ceil(F.col("rows") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int"))
    return skew_join(rows, sums.drop("shingles"), keys, "rows").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")).drop("chunks")


LEAF_ROWS = "bucket long, class int, chunk int, leaf int, sig long, component long, hashes binary, box array<int>, top array<int>, least long, greatest long, one long, top_least long, top_greatest long, top_one long"


def _leaves(percent: int):
    """Leaf numbers of a chunk's rows; the first row of a leaf and of a chunk has its box."""

    def solve(group: pd.DataFrame) -> list[tuple]:
        points = Points(group["sig"].to_numpy(np.int64), _unpacked_sets(group), percent)
        component = group["component"].to_numpy(np.int64)
        place = (int(group["bucket"][0]), int(group["class"][0]), int(group["chunk"][0]))
        # Texts linked together stay together: leaves of one component need no look at each other.
        rows, top, waiting, leaves = [], grow(points, np.arange(len(group))), [], []
        waiting.append(top)
        while waiting:
            node = waiting.pop()
            if node.kids:
                waiting += node.kids
            else:
                leaves += [node.rows[component[node.rows] == c] for c in np.unique(component[node.rows])] if len(node.rows) > 1 else [node.rows]
        alone = [r[0] for r in leaves if len(r) == 1]
        leaves = [r for r in leaves if len(r) > 1] + [np.array(alone[i : i + LEAF]) for i in range(0, len(alone), LEAF)]
        one = lambda rows: int(component[rows[0]]) if len(set(component[rows])) == 1 else None
        for leaf, members in enumerate(leaves):
            node = Node(points, np.asarray(members))
            for k, i in enumerate(members):
                box = (node.upper.tolist(), top.upper.tolist() if leaf == k == 0 else None, int(node.least), int(node.greatest), one(members), int(top.least), int(top.greatest), one(top.rows))
                rows.append((*place, leaf, int(points.sig[i]), int(component[i]), points.hashes[i].tobytes(), *(box if k == 0 else (None,) * 8)))
        return rows

    return solve


def _may_meet(a: str, b: str, percent: int):
    """Whether boxes a and b (columns box, least, greatest, one) can hold a link that is still missing."""
    most = F.aggregate(F.zip_with(f"{a}.box", f"{b}.box", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = (c(a, "greatest") * 100 >= c(b, "least") * percent) & (c(b, "greatest") * 100 >= c(a, "least") * percent)
    return sizes & ~F.coalesce(c(a, "one") == c(b, "one"), F.lit(False)) & (most * (100 + percent) >= (c(a, "least") + c(b, "least")) * percent)


def _across_chunks(rows: DataFrame, percent: int) -> DataFrame:
    """Links between texts of different chunks of a bucket that aren't linked together yet."""
    several = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi").select("bucket", "rows")
    open_rows = skew_join(rows, several, ["bucket"], "rows", "left_semi")
    keys = ["bucket", "class", "chunk"]
    arranged = open_rows.select(*keys, "sig", "component", "hashes").repartition(*keys).sortWithinPartitions(*keys, "sig")
    names = [x.split()[0] for x in LEAF_ROWS.split(", ")]
    leaves = staged(arranged.mapInPandas(_by_group(keys, _leaves(percent), names), LEAF_ROWS), "leaves")
    tops = leaves.filter("top is not null").select(*keys, F.col("top").alias("box"), F.col("top_least").alias("least"), F.col("top_greatest").alias("greatest"), F.col("top_one").alias("one"))
    boxes = leaves.filter("box is not null").select(*keys, "leaf", "box", "least", "greatest", "one")
    a, b = tops.alias("a"), tops.alias("b")
    later = F.struct("a.class", "a.chunk") < F.struct("b.class", "b.chunk")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & later & (F.col("b.class") - F.col("a.class") <= 1)).filter(_may_meet("a", "b", percent))
    pairs = pairs.select(F.col("a.bucket").alias("bucket"), F.col("a.class").alias("class_a"), F.col("a.chunk").alias("chunk_a"), F.col("b.class").alias("class_b"), F.col("b.chunk").alias("chunk_b"))
    on = lambda t, s: (F.col("p.bucket") == F.col(f"{t}.bucket")) & (F.col(f"p.class_{s}") == F.col(f"{t}.class")) & (F.col(f"p.chunk_{s}") == F.col(f"{t}.chunk"))
    met = pairs.alias("p").join(boxes.alias("a"), on("a", "a")).join(boxes.alias("b"), on("b", "b")).filter(_may_meet("a", "b", percent))
    met = staged(met.select("p.*", F.col("a.leaf").alias("leaf_a"), F.col("b.leaf").alias("leaf_b")), "leaf-pairs")
    pair = [*pairs.columns, "leaf_a", "leaf_b"]
    sides = [met.alias("p").join(leaves.alias("l"), on("l", s) & (F.col(f"p.leaf_{s}") == F.col("l.leaf"))).select(*[F.col(f"p.{c}") for c in pair], "l.sig", "l.component", "l.hashes", F.lit(s == "a").alias("left")) for s in ("a", "b")]
    work = sides[0].unionByName(sides[1]).repartition(*pair).sortWithinPartitions(*pair, "left", "sig")

    def solve(group: pd.DataFrame) -> list[tuple[int, int]]:
        points = Points(group["sig"].to_numpy(np.int64), _unpacked_sets(group), percent, group["component"].to_numpy(np.int64))
        left = group["left"].to_numpy(bool)
        points.compare(np.flatnonzero(left), np.flatnonzero(~left))
        return points.links

    return work.mapInPandas(_by_group(pair, solve, ["a", "b"]), "a long, b long")


def jaccard_links(docs: DataFrame, digest: DataFrame, k: int = K, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """Links (a, b) between set identities: a forest with the components of all links.

    ``docs``: id and text; ``digest``: id, n, sig and listed of every row.
    """
    listed = digest.filter(F.col("listed").isNotNull() & (F.size("listed") > 0)).select("sig", "n", "listed")
    members = staged(_buckets(listed, exact), "buckets")
    known = members.select("sig").distinct()
    # Copies of one text are many rows of one set: they are summed up before the join.
    wanted = digest.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("id").alias("id"), F.count("id").alias("named")).join(known, "sig", "left_semi")
    # One text for each set; sets without any named text are read by their rows.
    named = staged(wanted.filter("named > 0").select("id", F.xxhash64("id").alias("key")), "wanted")
    may, _ = bitmap_split(docs.withColumn("key", F.xxhash64("id")), "key", named)
    texts = may.select("id", "text").join(named, "id", "left_semi")
    nameless = docs.filter(F.col("id").isNull())
    sets = texts.unionByName(nameless).select("text").mapInPandas(_sets(k), "sig long, hashes binary").groupBy("sig").agg(F.first("hashes").alias("hashes"))
    sums = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    fits = (F.col("rows") <= CHUNK) & (F.col("shingles") <= CHUNK_SHINGLES)
    members = skew_join(members, sums.select("bucket", "rows", fits.alias("fits")), ["bucket"], "rows")
    full = staged(members.join(sets, "sig"), "members")
    as_links = lambda roots: roots.filter("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b"))
    links = as_links(_linked_in_groups(full.filter("fits"), ["bucket"], percent))
    # Buckets that one task can't hold.
    size_class = F.floor(F.log("n") / -float(np.log(CLASS_RATIO))).cast("int")
    large = _cut(full.filter("not fits").select("bucket", "sig", "n", "hashes", size_class.alias("class")), ["bucket", "class"])
    large = staged(large, "chunks")
    roots = staged(_linked_in_groups(large, ["bucket", "class", "chunk"], percent), "roots")
    chosen = roots.filter("sig = root").select("bucket", "sig").join(large.select("bucket", "sig", "n", "hashes"), ["bucket", "sig"])
    further = staged(_linked_in_groups(_cut(chosen, ["bucket"]), ["bucket", "chunk"], percent), "further-roots").select("bucket", F.col("sig").alias("root"), F.col("root").alias("component"))
    tied = staged(large.join(roots.join(further, ["bucket", "root"]).select("bucket", "sig", "component"), ["bucket", "sig"]), "tied")
    links = links.unionByName(as_links(roots)).unionByName(as_links(further.select(F.col("root").alias("sig"), F.col("component").alias("root"))))
    return links.unionByName(_across_chunks(tied, percent))


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).cast("string").alias("text"))
    digest = staged(map_texts(plain, ["id"], "text", {"n": "long", "sig": "long", "listed": "array<long>"}, _digest(k, exact)), "digest")
    links = jaccard_links(plain, digest, k, percent, exact)
    groups = components(links)
    # Least id of each set, then of each component.
    sets = digest.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    named = sets.join(groups, sets["sig"] == groups["node"], "left").select("sig", "least", "rows", F.coalesce("component", "sig").alias("component"))
    named = staged(named, "sets")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("sets")).filter("all_rows > 1")
    # Rows alone in their component keep their own id and need no join.
    grouped = skew_join(named, least, ["component"], "sets").select("sig", "component_id", "rows")
    out = digest.select("id", "n", "sig")
    return skew_join(out, staged(grouped, "grouped"), ["sig"], "rows", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_per_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component its least id stays.

    Of repeated rows of that id one stays. Rows without an id can't be named as
    anyone's copy; of these, one row of each text stays.
    """
    found = ngram_components(docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).alias("text")), "id", "text", k, percent)
    rows = found.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("first"))
    # Ids that go or come more than once; rows of all others stay where they are.
    special = staged(rows.filter((F.col("first") != F.col("id")) | (F.col("rows") > 1)).withColumn("key", F.xxhash64("id")), "leaving")
    keyed = docs.select(packed(docs.columns), F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).alias("text"), F.xxhash64(F.col(quoted(id_column))).alias("key"))
    may, rest = bitmap_split(keyed.filter(F.col("id").isNotNull()), "key", special)
    tested = may.join(special.select("id", "first"), "id", "left")
    single = tested.filter(F.col("first").isNull())
    often = tested.filter(F.col("first") == F.col("id")).dropDuplicates(["id"])
    nameless = keyed.filter(F.col("id").isNull()).dropDuplicates(["text"])
    out = rest.select("kept")
    for part in (single, often, nameless):
        out = out.unionByName(part.select("kept"))
    return out.select(*unpacked(docs.columns))
