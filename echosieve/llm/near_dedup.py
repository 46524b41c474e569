"""Near-duplicate links and groups by a chosen-path set similarity join.

A document is its set of distinct word shingles (64-bit hashes), embedded as ``MINHASHES``
minwise tokens.  In each of several independent trees, a node passes a document on to one
child per chosen token; a hash of (node, token) chooses each token with probability
1 / (similarity * MINHASHES), so two documents above the similarity stay together in one child
or more on average, and unlike ones part.  Documents of a node of at most ``SMALL`` are compared
exhaustively.  Documents of larger nodes are first compared with a few leaders of their node, in
``LEADER_ROUNDS`` rounds.  A node whose documents are one group then is done.  In others, the
documents alike to the node's centre are taken out: they are compared with the whole node, by
their full sets.  The rest, unlike the centre, branches on, at any depth.

* Equal sets are one class from the start, represented by its least id.
* Comparing means: sizes, then 64 four-bit sketches (a true link is lost here with a chance of
  about 1e-5, at any similarity), then the exact sets.
* Links are only needed to join groups: pairs within a known group are never compared, and of a
  document's candidates the most alike is tried first.  A large group of near copies is joined
  in a few linear rounds, not by its pairs.
* Nodes of several trees with one and the same largest group are one family, which is compared
  once.  Its tiles, bounded blocks of alike documents against blocks of the whole family, compare
  sets on the spot and return only links that join two groups: no pair leaves a task otherwise.
  The sets go there as 31-bit hashes, straight from the texts; what is found is confirmed on the
  full sets, and if any of it fails, all tiles are compared again by those.
  What grows with the square of a family is the arithmetic in its tiles, where texts of a family
  are only just not alike; neither rows nor memory do.
* At the threshold, a tree finds a pair in its first level with a chance of 1 - 1/e, and the
  number of trees is what misses at most 1 - ``RECALL`` of such pairs.  Each level below draws
  ``DRAWS`` times, so that a pair stays together with a chance of 1 - e ** -DRAWS.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echosieve.llm.common import ascii_lower, few_tasks, let, may_broadcast, same
from echosieve.llm.components import LABEL_BYTES, components
from echosieve.workspace import Workspace

SHINGLE, PERCENT = 3, 85
RECALL, MINHASHES, SMALL, DRAWS = 0.99999, 64, 16, 2
LEADERS, LEADER_ROUNDS = 2, 3
SMALL_TILE = 512  # documents of an open node that are all compared
# Similarity, of the one that is sought, from which a document is alike to a centre.  Below it
# fewer than one of a pair's DRAWS / share children are shared, so branching ends.
ALIKE_SHARE = 0.45
SKETCH_LOSS = 1.5e-5  # chance that the sketches of a pair at the threshold rule it out
BLOCK_SHINGLES = 1 << 19  # of alike documents in a tile; of the family it holds four times that
NARROW = 0x7FFFFFFF  # of a shingle's hash, the bits that are sent to a tile
BROADCAST_BYTES = 16 << 20
SPACES = r"[\x20\x09-\x0D]+"
ROWS = "node long, id long, n int, s0 long, s1 long, s2 long, s3 long"
SKETCH = ["s0", "s1", "s2", "s3"]
# Bytes of a row: a node's, a document's with its signature, one of a few numbers, two sets.
ROW_BYTES, SIGNED_BYTES, NARROW_BYTES, SETS_BYTES = 80, 300, 24, 8 << 10


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Sorted distinct shingle hashes; with fewer words than ``size`` all words as one."""
    low = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES)

    def hashed(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(
            F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)])
        )
        short = F.lit(None)
        for k in range(1, size):
            short = F.when(n == k, F.array(F.xxhash64(*[w[i] for i in range(k)]))).otherwise(short)
        none = F.array().cast("array<bigint>")
        return F.when(n >= size, F.sort_array(F.array_distinct(full))).otherwise(
            F.coalesce(short, none)
        )

    return let(F.filter(low, lambda w: w != ""), hashed)


def _signatures(batches: Iterator) -> Iterator:
    """Replace the shingle hashes ``sh`` by ``sig``: the minwise tokens as 32-bit numbers.

    An empty set has the greatest number for each token.
    """
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    slab = 1 << 18
    for batch in batches:
        sets = batch.column("sh")
        flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(np.diff(sets.offsets.to_numpy()))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        sig = np.empty((len(sets), MINHASHES), np.uint32)
        row = 0
        while row < len(sets):  # whole documents, about ``slab`` hashes at a time
            last = max(row + 1, int(np.searchsorted(ends, starts[row] + slab, "right")))
            part = flat[starts[row]:ends[last - 1]]
            filled = np.flatnonzero(ends[row:last] > starts[row:last])
            at = starts[row:last][filled] - starts[row]
            sig[row:last] = np.iinfo(np.uint32).max
            for k in range(MINHASHES if len(at) else 0):
                mixed = ((part * factors[k]) >> np.uint64(32)).astype(np.uint32)
                sig[row + filled, k] = np.minimum.reduceat(mixed, at)
            row = last
        names = [f.name for f in batch.schema if f.name != "sh"]
        raw = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(4 * MINHASHES), len(sets), [None, pa.py_buffer(sig.tobytes())]
        ).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], raw], [*names, "sig"]
        )


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trees_for(recall: float) -> int:
    """How many trees find a pair at the threshold in their first level with this chance."""
    return max(1, ceil(log(1 / (1 - recall))))


def _branch(trees: int, percent: int):
    """Function for ``mapInArrow``: the children of each row ``(id, n, sig[, node])``.

    Without ``node`` the rows are at the root of ``trees`` trees, else each node draws so often.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bound = np.uint64(2.0**64 * 100 / (percent * MINHASHES))
        places = np.arange(MINHASHES, dtype=np.uint64) << np.uint64(32)
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                raw = b"".join(batch.column("sig").to_pylist())
                sig = np.frombuffer(raw, np.uint32).reshape(-1, MINHASHES)
                nibbles = (sig & 15).astype(np.uint64).reshape(-1, 4, 16)
                packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(
                    axis=2, dtype=np.uint64
                ).view(np.int64)
                tokens = sig.astype(np.uint64) + places
                roots = _mix(np.arange(1, trees + 1, dtype=np.uint64))
                if "node" in batch.schema.names:
                    own = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                    parents = [own ^ r for r in roots]
                else:
                    parents = [np.full(len(sig), r) for r in roots]
                for parent in parents:
                    draw = _mix(tokens ^ _mix(parent)[:, None])
                    rows, cols = np.nonzero(draw < bound)
                    node = _mix(draw[rows, cols] + np.uint64(1)).view(np.int64)
                    picked = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node), batch.column("id").take(picked),
                         batch.column("n").take(picked),
                         *[pa.array(packed[rows, k]) for k in range(4)]],
                        ["node", "id", "n", *SKETCH],
                    )

    return run


def _differing(left: str, right: str) -> Column:
    """How many of the sketches differ."""
    ones = F.lit(0x1111111111111111).cast("long")
    differing = F.lit(0)
    for s in SKETCH:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        for shift in (1, 2):  # any bit of a nibble, into its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(x.bitwiseAND(ones))
    return differing


def least_agreeing(percent: int) -> int:
    """How many of ``MINHASHES`` sketches must agree: a pair at ``percent`` similarity has fewer
    with a chance of at most ``SKETCH_LOSS``.  Unlike minima share their four bits 1 in 16 times.
    """
    agree = percent / 100 + (1 - percent / 100) / 16
    below = 0.0
    for k in range(MINHASHES):
        below += comb(MINHASHES, k) * agree**k * (1 - agree) ** (MINHASHES - k)
        if below > SKETCH_LOSS:
            return k
    return MINHASHES


def _alike(left: str, right: str, percent: int) -> Column:
    """Sizes and sketches allow a link."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    return sizes & (_differing(left, right) <= MINHASHES - least_agreeing(percent))


def _pairs(joined: DataFrame) -> DataFrame:
    """``(a, b, off)`` of joined rows x and y: the ids and how many sketches differ."""
    return joined.select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"),
        _differing("x", "y").alias("off"),
    )


def _exhaustive(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one (small) node that may be links between groups."""
    wanted = (
        (F.col("x.node") == F.col("y.node")) & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.component") != F.col("y.component"))
    )
    return _pairs(rows.alias("x").join(rows.alias("y"), wanted & _alike("x", "y", percent)))


def _with_company(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` plus ``company``: how many documents a row's document meets over all its nodes."""
    met = rows.withColumn("company", F.sum("cnt").over(Window.partitionBy("id")))
    return few_tasks(met, count, ROW_BYTES)


def _with_leaders(
    rows: DataFrame, count: int, percent: int, turn: int, most: int, work: Workspace
) -> DataFrame:
    """``(b, a)``: for each of the ``count`` rows of large nodes, the most alike of the leaders
    it meets.

    In the first ``turn`` a node's leader is the document with the most company over all its
    nodes: of a group of edited copies that is the text they were made from, as it alone has
    no token of its own.  Later a hash draws about ``LEADERS`` leaders per node.
    """
    if turn == 0:
        leaders = few_tasks(_with_company(rows, count).groupBy("node").agg(F.max(
            F.struct("company", F.xxhash64("id").alias("h"), "id", "n", "component", *SKETCH)
        ).alias("lead")).select("node", "lead.*"), count, ROW_BYTES)
    else:
        draw = F.pmod(F.xxhash64(F.lit(turn), "node", "id"), F.lit(1 << 30))
        leaders = rows.filter(draw * F.col("cnt") < F.lit(LEADERS << 30))
    # Sent while they are few, so that a large node is not brought into one task.
    sent = may_broadcast(work.table(
        leaders.select("node", "id", "n", "component", *SKETCH), "leaders"
    ), 72, most)
    met = rows.alias("x").join(sent.alias("y"), "node").filter(
        (F.col("x.component") != F.col("y.component")) & _alike("x", "y", percent)
    )
    best = met.groupBy(F.col("x.id").alias("b")).agg(
        F.min_by(F.col("y.id"), F.struct(_differing("x", "y"), F.col("y.id"))).alias("a")
    )
    return few_tasks(best, count, NARROW_BYTES)


def _centred(
    still: DataFrame, count: int, percent: int, most: int, work: Workspace
) -> DataFrame:
    """The ``count`` rows of open nodes with ``alike``: whether they are like the centre of their node, the
    document of its largest group that has the most company over all nodes, or in a small one."""
    centres = few_tasks(_with_company(still, count).filter("component = top").groupBy("node").agg(
        F.max(F.struct("company", F.xxhash64("id").alias("h"), "n", *SKETCH)).alias("c")
    ).select("node", "c.n", *[f"c.{s}" for s in SKETCH]), count, ROW_BYTES)
    share = ALIKE_SHARE * percent / 100
    near = int(MINHASHES * (1 - share) * 15 / 16)  # differing sketches of such a pair on average
    sent = may_broadcast(work.table(centres, "centres"), 64, most)
    return still.alias("x").join(sent.alias("y"), "node").select(
        "x.*", ((F.col("cnt") <= SMALL_TILE) | (_differing("x", "y") <= near)).alias("alike")
    )


def _tiles(family: DataFrame, count: int, most: int, work: Workspace) -> DataFrame:
    """``(id, places)``: the tiles that a document goes to, as structs ``(top, p, q, component,
    alike, alike_side)``.

    ``family``: ``(top, id, component, alike, n)``, of ``count`` rows.  A family is dealt into blocks of about
    ``BLOCK_SHINGLES`` shingles of alike documents, and of four times that of all of them.
    """
    sizes = family.groupBy("top").agg(
        F.ceil(F.sum(F.when(F.col("alike"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES)
        .cast("int").alias("ps"),
        F.ceil(F.sum("n") / (4 * BLOCK_SHINGLES)).cast("int").alias("qs"),
    ).filter("ps > 0")
    sizes = few_tasks(sizes, count, NARROW_BYTES)
    dealt = family.join(may_broadcast(work.table(sizes, "family-sizes"), 24, most), "top")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["top", "id", "component", "alike"]
    # In a family of one tile the alike documents are there already.
    left = dealt.filter("alike and not (ps = 1 and qs = 1)").withColumn("q", every("qs")).select(
        *columns, block("ps").alias("p"), "q", F.lit(True).alias("alike_side")
    )
    right = dealt.withColumn("p", every("ps")).select(
        *columns, "p", block("qs").alias("q"), F.lit(False).alias("alike_side")
    )
    places = F.struct("top", "p", "q", "component", "alike", "alike_side")
    of_id = left.unionByName(right).groupBy("id").agg(F.collect_list(places).alias("places"))
    return few_tasks(of_id, count, ROW_BYTES)


def _verified(percent: int):
    """Function for ``applyInArrow`` on a tile: links that join two of its groups, ``(a, b)``."""

    def run(tile):
        import numpy as np
        import pyarrow as pa

        ids = tile.column("id").to_numpy()
        groups = tile.column("component").to_numpy()
        alike = tile.column("alike").to_numpy(zero_copy_only=False).astype(bool)
        side = tile.column("alike_side").to_numpy(zero_copy_only=False).astype(bool)
        in_top = groups == tile.column("top")[0].as_py()
        sets = tile.column("sh").combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        _, flat = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        whole = np.flatnonzero(~side)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        of_whole = np.concatenate([flat[starts[j]:starts[j + 1]] for j in whole]) if len(whole) else flat[:0]
        begins = np.concatenate([[0], np.cumsum(sizes[whole])[:-1]]).astype(np.int64)
        there = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        # Groups of the tile, joined as links are found.
        _, group = np.unique(groups, return_inverse=True)
        found = []
        for i in np.flatnonzero(side if side.any() else alike):
            fits = np.minimum(sizes[whole], sizes[i]) * 100 >= np.maximum(sizes[whole], sizes[i]) * percent
            wanted = fits & (group[whole] != group[i])
            # Two alike documents meet once, and those of the largest group only others.
            if in_top[i]:
                wanted &= ~alike[whole]
            else:
                wanted &= ~alike[whole] | in_top[whole] | (ids[whole] > ids[i])
            if not wanted.any():
                continue
            own = flat[starts[i]:starts[i + 1]]
            there[own] = True
            common = np.add.reduceat(there[of_whole], begins, dtype=np.int64)
            there[own] = False
            links = np.flatnonzero(
                wanted & (common * 100 >= (sizes[whole] + sizes[i] - common) * percent)
            )
            for j in whole[links]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    found.append((int(ids[i]), int(ids[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sized(rows: DataFrame, about: float, work: Workspace) -> DataFrame:
    """Of ``about`` so many rows those of nodes with two documents or more, with the node's
    count ``cnt``."""
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
    return work.table(few_tasks(rows.join(nodes, "node"), ceil(about), ROW_BYTES), "nodes")


def _labelled(rows: DataFrame, labels: DataFrame | None, key: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: the group of ``key``, itself as long as it has no link."""
    if labels is None:
        return rows.withColumn(out, F.col(key))
    known = labels.select(F.col("id").alias("_k"), F.col("component").alias("_c"))
    return rows.join(known, F.col(key) == F.col("_k"), "left").withColumn(
        out, F.coalesce("_c", key)
    ).drop("_k", "_c")


class _Join:
    """The groups found so far, and what adds to them."""

    def __init__(self, texts: DataFrame, shingle: int, percent: int, most: int, work: Workspace):
        self.texts, self.shingle, self.percent = texts, shingle, percent
        self.most, self.work = most, work
        self.labels: DataFrame | None = None

    def grouped(self, rows: DataFrame) -> DataFrame:
        return _labelled(rows, self.labels, "id", "component")

    def open(self, rows: DataFrame, count: int) -> DataFrame:
        """Of the ``count`` rows those of the nodes that hold more than one group, with their ``component``, the
        node's largest one, ``top``, and the number of rows ``outside`` it."""
        grouped = self.grouped(rows)
        groups = grouped.groupBy("node", "component").agg(F.count(F.lit(1)).alias("own"))
        nodes = few_tasks(groups, count, NARROW_BYTES).groupBy("node").agg(
            F.max_by("component", F.struct("own", "component")).alias("top"),
            (F.sum("own") - F.max("own")).alias("outside"),
        ).filter("outside > 0")
        nodes = few_tasks(nodes, count, NARROW_BYTES)
        sent = may_broadcast(self.work.table(nodes, "open"), 24, self.most)
        return self.work.table(grouped.join(sent, "node"), "open-nodes")

    def apart(self, pairs: DataFrame) -> DataFrame:
        both = _labelled(_labelled(pairs, self.labels, "a", "ca"), self.labels, "b", "cb")
        return both.filter("ca != cb").drop("ca", "cb")

    def sets(self, ids: DataFrame) -> DataFrame:
        """``(id, sh)`` of the texts with one of ``ids``, which may repeat."""
        wanted = may_broadcast(ids, 16, self.most)
        return self.work.table(self.texts.join(wanted, "id", "left_semi").select(
            "id", shingles(F.col("text"), self.shingle).alias("sh")
        ), "sets")

    def compare(self, centred: DataFrame, count: int) -> None:
        """In ``count`` rows, join the groups of open nodes whose alike documents link to any of their node."""
        family = self.work.table(few_tasks(centred.groupBy("top", "id").agg(
            F.first("component").alias("component"), F.max("alike").alias("alike"),
            F.first("n").alias("n"),
        ), count, ROW_BYTES), "families")
        count = family.count()
        places = self.work.table(_tiles(family, count, self.most, self.work), "places")
        links = self.work.table(few_tasks(
            self.linked(places, narrow=True).distinct(), count, NARROW_BYTES
        ), "links")
        if links.isEmpty():
            return
        if self.verify(links) < links.count():  # unlike shingles share their narrow hash
            self.merge(self.work.table(self.linked(places, narrow=False), "links"))

    def linked(self, places: DataFrame, narrow: bool) -> DataFrame:
        """Links ``(a, b)`` that join groups within a tile.  ``narrow``: by 31 bits of the hashes.

        Narrow hashes halve what is shuffled.  They can only add to what two sets share, so no
        link is lost as long as all that are found hold on the full sets.
        """
        sh = shingles(F.col("text"), self.shingle)
        if narrow:
            sh = F.transform(sh, lambda x: x.bitwiseAND(F.lit(NARROW)).cast("int"))
        sent = may_broadcast(places, 64, self.most)
        # Hashed where the text lies, once, and dealt to the tiles from there.
        tiles = self.texts.join(sent, "id").select("id", sh.alias("sh"), "places").select(
            "id", "sh", F.explode("places").alias("place")
        ).select("id", "sh", "place.*")
        return tiles.groupBy("top", "p", "q").applyInArrow(
            _verified(self.percent), "a long, b long"
        )

    def verify(self, pairs: DataFrame) -> int:
        """Join the groups of the written pairs ``(a, b)`` that are links on their full sets;
        returns how many are."""
        sets = self.sets(
            pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
        )
        right = sets.select(F.col("id").alias("b"), F.col("sh").alias("sb"))
        left = sets.select(F.col("id").alias("a"), F.col("sh").alias("sa"))
        joined = pairs.join(right, "b").join(left, "a").select(
            "a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"),
            (F.size("sa") + F.size("sb")).alias("both"),
        )
        found = joined.filter(
            F.col("common") * 100 >= (F.col("both") - F.col("common")) * self.percent
        ).select("a", "b").distinct()
        links = self.work.table(few_tasks(found, pairs.count(), SETS_BYTES), "links")
        self.merge(links)
        return links.count()

    def merge(self, links: DataFrame) -> None:
        """Contract ``links`` to links between groups, and join those groups."""
        both = _labelled(_labelled(links, self.labels, "a", "ca"), self.labels, "b", "cb")
        between = self.work.table(both.filter("ca != cb").select(
            F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")
        ), "group-links")
        if between.isEmpty():
            return
        found = components(between, self.work, self.most)
        if self.labels is None:
            self.labels = may_broadcast(found, LABEL_BYTES, self.most)
            return
        found = may_broadcast(found, LABEL_BYTES, self.most)
        moved = self.labels.join(
            found.select(F.col("id").alias("component"), F.col("component").alias("_to")),
            "component", "left",
        ).select("id", F.coalesce("_to", "component").alias("component"))
        fresh = found.join(self.labels.select("id"), "id", "left_anti")
        groups = self.work.table(moved.unionByName(fresh), "groups")
        self.labels = may_broadcast(groups, LABEL_BYTES, self.most)

    def settle(self, pairs: DataFrame, about: int) -> None:
        """Verify ``about`` so many ``pairs(a, b, off)``: each document's most alike first, then
        all still apart."""
        pairs = self.work.table(few_tasks(
            pairs.groupBy("a", "b").agg(F.min("off").alias("off")), about, NARROW_BYTES
        ), "pairs")
        either = pairs.select("a", "b", "off").unionAll(pairs.select("b", "a", "off"))
        best = self.work.table(few_tasks(either.groupBy("b").agg(
            F.min_by("a", F.struct("off", "a")).alias("a")
        ), 2 * pairs.count(), NARROW_BYTES), "best")
        if best.isEmpty():
            return
        self.verify(best)
        rest = self.work.table(self.apart(pairs), "apart")
        if not rest.isEmpty():
            self.verify(rest)


def near_duplicates(
    docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL,
    small: int = SMALL, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    ``component_id`` is the least id in reach over links of ``percent`` similarity, the own id
    without any; ``kept`` is ``doc_id = component_id``.  Null and empty texts have no shingles
    and no links.  Rows with an id of their own are expected; rows that repeat an id share its
    links.  A row with a null id is kept unless it copies another's set.  Other columns are
    ignored.
    """
    hashed = docs.select(
        F.col(doc_id).cast("long").alias("id"), shingles(F.col(text), shingle).alias("sh")
    ).select(
        "id", F.size("sh").alias("n"), F.xxhash64("sh").alias("k1"),
        F.xxhash64(F.lit(1), "sh").alias("k2"), "sh",
    )
    base = work.table(
        hashed.mapInArrow(_signatures, "id long, n int, k1 long, k2 long, sig binary"),
        "signatures",
    )
    keys = ["n", "k1", "k2"]
    classes = work.table(few_tasks(
        base.filter("n > 0").groupBy(*keys)
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig")),
        base.count(), SIGNED_BYTES,
    ), "classes")
    members = classes.select(F.col("rep").alias("id"), "n", "sig").filter("id is not null")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    join = _Join(texts, shingle, percent, broadcast_bytes, work)

    def leaves(nodes: DataFrame) -> None:
        few = nodes.filter(F.col("cnt") <= small)
        join.settle(_exhaustive(join.grouped(few), percent), few.count() * small // 2)

    each = 100 / percent  # children of a document in a tree
    trees = trees_for(recall)
    nodes = _sized(
        members.mapInArrow(_branch(trees, percent), ROWS), classes.count() * trees * each, work
    )
    rows = nodes.filter(F.col("cnt") > small)
    leaves(nodes)
    rounds = LEADER_ROUNDS
    while True:
        count = rows.count()
        for turn in range(rounds):
            best = work.table(_with_leaders(
                join.grouped(rows), count, percent, turn, broadcast_bytes, work
            ), "led")
            if best.isEmpty():
                break
            join.verify(best)
        still = join.open(rows, count)
        count = still.count()
        if count == 0:
            break
        centred = work.table(_centred(still, count, percent, broadcast_bytes, work), "centred")
        join.compare(centred, count)
        # The centre itself is alike, so a node loses one document at least.
        unlike = centred.filter("not alike").select("id", "node")
        count = unlike.count()
        signed = few_tasks(unlike.join(members, "id"), count, SIGNED_BYTES)
        nodes = _sized(
            signed.mapInArrow(_branch(DRAWS, percent), ROWS), count * DRAWS * each, work
        )
        if nodes.isEmpty():
            break
        rows, rounds = nodes.filter(F.col("cnt") > small), 1
        leaves(nodes)

    copies = classes.filter("copies > 1").select(*keys, "rep")
    placed = base.drop("sig").join(copies, keys, "left").withColumn(
        "rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    )
    return _labelled(placed, join.labels, "rep", "component").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        same(F.col("id"), F.col("component")).alias("kept"),
    )
