"""Operator 7: near duplicates by chosen-path similarity join, confirmed on full sets.

1. Texts with one shingle set are one node, named by 64 bits of a hash of the set; every node gets 128 minwise tokens.
2. Trees branch nodes by chosen minwise tokens, one token a level: the root into one child a token for each of ``trees``
   tokens, and every branch of more than ``small`` nodes again on two or one further tokens in turn. Branches of at most
   ``small`` nodes are compared exhaustively by their tokens, with a margin of five standard deviations below the
   threshold. The number of trees is such that a pair at the threshold is missed with probability ``miss`` at most,
   whatever the number of levels. In large branches every node is compared with a few pivots first: nodes near the main
   pivots are in one cluster and needn't meet each other; only what lies apart goes on, with those that are not so near
   to a main pivot that all their partners must have met it as well.
3. What has met forms clusters. A cluster reads one whole text of each of its nodes, and links are confirmed on full
   sets: counts of one document against all others at a time, for all documents outside the largest component, so
   that no pair of different components stays uncompared, and copies aren't expanded into pairs. Clusters beyond a
   bounded number of shingles do the same in blocks.

Result: one row per document with its set size and component. Nulls: a null text has an empty set, like a text without
words, and is linked with nothing. Documents link by their texts, whatever their ids: those that share an id or have
none are linked like others. A component is named by its smallest id that isn't null, and by null only if it has no
other. Repeated rows (id and text) are one document. Ties: of a component's documents under the smallest id, the one
with the smallest text key stands for it. An empty table gives no rows. Other columns are not read. A text of any
length is held whole, with eight bytes a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, anti_join, arrow_schema, components, drop_stored, held, map_groups, mix, slices, stored, table, text_key, windows, word_hash

TOKENS = 128
SKETCH = "doc_id bigint, tie bigint, n_shingles bigint, node bigint, sig binary, nodes array<bigint>"
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_MUL = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of fewer words the whole sequence is one."""
    memo = held("neardup", lambda: Memo(word_hash))
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return mix(windows(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows(h, k))


def sketch(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """Per document (doc_id, tie, text): set size, its node, minwise tokens of 8 bits each, and its branch in each tree."""
    out = arrow_schema(docs.sparkSession, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows, 1 << 20):
                part = batch.slice(lo, hi - lo)
                sets = [shingles(t, k) for t in part.column(2).to_pylist()]
                size = np.array([len(s) for s in sets])
                has = np.flatnonzero(size)
                sig = np.zeros((len(sets), TOKENS), np.uint8)
                nodes: list = [[] for _ in sets]
                if len(has):
                    flat = np.concatenate([sets[i] for i in has])
                    first = np.r_[0, np.cumsum(size[has])[:-1]]
                    least = np.empty((TOKENS, len(has)), np.uint64)
                    for t in range(TOKENS):
                        least[t] = np.minimum.reduceat((flat ^ _XOR[t]) * _MUL[t], first)
                    least = mix(least)
                    sig[has] = (least & np.uint64(255)).astype(np.uint8).T
                    keys = mix(least[np.arange(trees) % TOKENS] + np.arange(1, trees + 1, dtype=np.uint64)[:, None])
                    for i, row in zip(has.tolist(), np.ascontiguousarray(keys.T).view(np.int64).tolist()):
                        nodes[i] = row
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([*part.columns[:2], pa.array(size, pa.int64()), pa.array(node), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], schema=out)

    return docs.select("doc_id", "tie", "text").mapInArrow(run, SKETCH)


def close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, similarity: float, estimates: bool = False):
    """Matrix: whether rows of a and b may be similar, by tokens and by set sizes (and the estimates). Compared in blocks.

    A similarity of 0 leaves the sizes out.
    """
    same = np.empty((len(a), len(b)), np.int16)
    for lo in range(0, len(a), 32):
        same[lo : lo + 32] = (a[lo : lo + 32, None, :] == b[None, :, :]).sum(-1, dtype=np.int16)
    est = (same / TOKENS - 1 / 256) / (1 - 1 / 256)
    ratio = np.minimum(na[:, None], nb[None]) / np.maximum(na[:, None], nb[None])
    near = (est >= least) & (ratio >= similarity - 1e-9)
    return (near, est) if estimates else near


class Union:
    """Disjoint sets over 0 .. n - 1; the least member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least member of its component."""
    lab = np.arange(len(near))
    while True:
        new = np.minimum(lab, np.where(near, lab[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def tokens_of(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), TOKENS)


LINKS = "a bigint, b bigint"


def meet_all(rows: DataFrame, key: str, least: float, similarity: float) -> DataFrame:
    """All pairs of small branches (key, id, n, sig): links (a, b) that span what may be similar.

    Whole branches are compared in bulk: neighbours at distance 1, 2, 3 .. of the sorted rows, as far as branches reach.
    """
    out = arrow_schema(rows.sparkSession, LINKS)
    need = int(np.ceil(TOKENS * (least * (1 - 1 / 256) + 1 / 256) - 1e-9))  # equal tokens

    def spans(key: np.ndarray, ids: np.ndarray, n: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        a, b, d = [], [], 1
        at = np.flatnonzero(key[1:] == key[:-1])
        while len(at):
            for lo in range(0, len(at), 1 << 15):
                i = at[lo : lo + (1 << 15)]
                x, y = n[i], n[i + d]
                i = i[np.minimum(x, y) >= (similarity - 1e-9) * np.maximum(x, y)]
                i = i[np.add.reduce(sig[i] == sig[i + d], axis=1, dtype=np.uint8) >= need]
                a.append(i)
                b.append(i + d)
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        root = np.arange(len(key))
        while True:  # the least member of each row's component
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = np.flatnonzero(root != np.arange(len(key)))
        return pa.record_batch([pa.array(ids[hit]), pa.array(ids[root[hit]])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None
        for batch in batches:
            got = [*(batch.column(i).to_numpy() for i in range(3)), tokens_of(batch.column(3).to_pylist())]
            got = [np.concatenate(x) for x in zip(rest, got)] if rest else got
            if not len(got[0]):
                continue
            open_at = int(np.searchsorted(got[0], got[0][-1]))
            if open_at:
                yield spans(*(x[:open_at] for x in got))
            rest = [x[open_at:] for x in got]
        if rest:
            yield spans(*rest)

    return rows.select(key, "id", "n", "sig").repartition(key).sortWithinPartitions(key).mapInArrow(run, LINKS)


LEVELS = 24


def branching(level: int) -> int:
    """Children of a large branch: two and one in turn.

    With one child each level would lose pairs; with two at every level documents that share less than the threshold
    would multiply. Two every other level keep a pair at a similarity of 0.71 or more alive at any depth.
    """
    return 2 - level % 2


def together(similarity: float, levels: int = LEVELS) -> float:
    """The probability that a pair of a large branch is still together in some branch after all levels."""
    p = 1.0
    for level in reversed(range(levels)):
        p = 1 - (1 - similarity * p) ** branching(level)
    return p


def candidates(reps: DataFrame, similarity: float, *, small: int = 1024, pivots: int = 8, levels: int = LEVELS, blocks: int = 4) -> DataFrame:
    """Links (a, b) between nodes (id, n, sig, nodes) that may be similar; reps must be a stored frame.

    Comparisons of all levels are left to the job that reads the result; its ``scratch`` are the frames it reads.
    """
    sigma = math.sqrt(similarity * (1 - similarity) / TOKENS)
    least = similarity - 5 * sigma
    plain = reps.select("id", "n", "sig")
    members = reps.select("id", F.explode("nodes").alias("node"))
    found: list[DataFrame] = []
    scratch: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        scratch.append(stored(df, what))
        return scratch[-1]

    for level in range(levels + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        members = keep(members.join(sizes.hint("merge"), "node"), "branches")
        found.append(meet_all(members.where(F.col("size") <= small).join(plain, "id"), "node", least, similarity))
        # from level 2 on what makes a few blocks is compared block by block, and so is what has not split at last
        whole = 0 if level < 2 else blocks * small if level < levels else 1 << 62
        many = members.where(F.col("size") > small)
        largest = many.agg(F.max("size")).first()[0] or 0
        if largest > small and whole:
            found.append(in_blocks(many.where(F.col("size") <= whole).join(plain, "id"), small, least, similarity))
        if largest <= max(small, whole):
            break
        # pivots: the least hash in each of a few classes of hashes, found with a map-side combine
        many = keep(many.where(F.col("size") > whole).withColumn("k", F.ceil(F.col("size") / CELL).cast("bigint")).join(plain, "id"), "large-branches")
        h = F.xxhash64("id", "node")
        chosen = many.groupBy("node", F.pmod(h, F.lit(pivots)).alias("p")).agg(F.min_by(F.struct("id", "n", "sig", "k"), h).alias("x")).select("node", "x.*")
        met = keep(against_pivots(many, chosen, least, similarity), "met-pivots")
        found.append(met.select("a", F.explode("bs").alias("b")))
        # what is near the branch's main pivots has met; what isn't has to meet all that isn't settled
        apart = met.where("not main").groupBy("node").agg(F.count("*").alias("apart"))
        rest = keep(met.where("not settled").join(apart.hint("merge"), "node").select(F.col("a").alias("id"), "node", "n", "sig", "k", "main", "apart"), "unsettled")
        last = rest.where(F.col("apart") <= small)
        found.append(against_pivots(last, last.where("not main"), least, similarity, similarity).select("a", F.explode("bs").alias("b")))
        child = rest.where(F.col("apart") > small).select("id", "node", "sig", F.explode(F.sequence(F.lit(0), F.lit(branching(level) - 1))).alias("j"))
        # children of one branch differ in their token
        place = F.pmod(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(TOKENS)) + 43 * F.col("j"), F.lit(TOKENS)).cast("int") + 1
        members = child.select("id", F.xxhash64("node", "j", F.lit(level), F.col("sig").substr(place, F.lit(1))).alias("node"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = out.distinct()
    out.scratch = scratch
    return out


#: Members of a large branch that one group takes, together with the branch's pivots.
CELL = 2048


def against_pivots(members: DataFrame, pivots: DataFrame, least: float, similarity: float, ratio: float = 0.0) -> DataFrame:
    """Each member of a large branch and, as ``bs``, one pivot of each group of linked pivots that it may be similar to.

    Groups that a member of the cell has linked are one group to the members after it, so a cell's links span what has met
    and are fewer than its members and pivots together, however many groups each member is near to.
    Both have (id, node, n, sig, k); a branch's members are dealt to k cells and its pivots to each of them, where they
    come first. main: it may be similar to one of the branch's main pivots, the largest group of pivots that are linked with each
    other, so all main members are in one cluster. settled: it is so near to a main pivot that whatever may be linked
    with it is near that pivot as well (distances add up at most), so both are in the pivot's cluster. That says nothing
    of set sizes, so these may prune (``ratio``) only where rows meet all that they may be linked with.
    """
    schema = "a bigint, node bigint, n bigint, sig binary, k bigint, bs array<bigint>, main boolean, settled boolean"
    out = arrow_schema(members.sparkSession, schema)
    sure = min(1.0, least + (1 - similarity) + 0.12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell, held, ready = None, [], None  # the cell that is being read, its pivots so far, and these prepared
        for batch in batches:
            cell, member, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sig = tokens_of(batch.column(4).to_pylist())
            main, settled, bs = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.empty(len(ids), object)
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (member[1:] != member[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                if cell[lo] != open_cell:
                    open_cell, held, ready = cell[lo], [], None
                if not member[lo]:
                    held.append((ids[lo:hi], n[lo:hi].astype(float), sig[lo:hi]))
                    continue
                if ready is None:
                    names, size, p = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(names)
                    names, size, p = names[order], size[order], p[order]
                    root = linked(close(p, p, size, size, least, ratio))
                    ready = names, size, p, root, root == np.bincount(root).argmax(), Union(len(names))
                names, size, p, root, is_main, met = ready
                for at in range(lo, hi, 1024):
                    part = slice(at, min(at + 1024, hi))
                    near, est = close(sig[part], p, n[part].astype(float), size, least, ratio, True)
                    main[part] = (near & is_main).any(1)
                    settled[part] = (near & is_main & (est >= sure)).any(1)
                    for i, hit in enumerate(near, at):
                        groups = sorted({met.find(g) for g in np.unique(root[hit]).tolist()})
                        bs[i] = [b for b in names[groups].tolist() if b != ids[i]]
                        for g in groups[1:]:
                            met.join(groups[0], g)
            mine = np.flatnonzero(member)
            if len(mine):
                kept = batch.take(pa.array(mine))
                yield pa.record_batch([kept.column(2), kept.column(5), kept.column(3), kept.column(4), kept.column(6), pa.array(bs[mine].tolist(), out.types[5]), pa.array(main[mine]), pa.array(settled[mine])], schema=out)

    rest = ["id", "n", "sig", "node", "k"]
    dealt = members.select(F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(3)), F.col("k"))).alias("cell"), F.lit(True).alias("member"), *rest)
    each = pivots.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select(F.xxhash64("node", "c").alias("cell"), F.lit(False).alias("member"), *rest)
    return dealt.union(each).repartition("cell").sortWithinPartitions("cell", "member").mapInArrow(run, schema)


def in_blocks(many: DataFrame, small: int, least: float, similarity: float) -> DataFrame:
    """All pairs of blocks of a branch, each pair of blocks in a group of its own."""
    k = F.ceil(F.col("size") / small).cast("bigint")
    mine = many.withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")))
    cells = mine.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("node", F.least("c", "o"), F.greatest("c", "o")))
    return meet_all(cells, "cell", least, similarity)


def confirm(sets: list[np.ndarray], percent: int, todo: np.ndarray | None = None) -> Union:
    """Links on full sets: 100 * intersection >= percent * union; sets are sorted and distinct.

    ``todo`` marks the sets that have to meet all others; without it the sets outside the largest component do.
    """
    n = np.array([len(s) for s in sets])
    u = Union(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (n.sum() - both):
            u.join(0, 1)
        return u
    flat = np.concatenate(sets)
    first = np.r_[0, np.cumsum(n)[:-1]]
    names, token = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(names), np.int32)

    def meet(i: int) -> None:
        mine = token[first[i] : first[i] + n[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[token], first)
        mark[mine] = 0
        for j in np.flatnonzero(100 * both.astype(np.int64) >= percent * (n[i] + n - both)).tolist():
            u.join(i, j)

    if todo is not None:
        for i in np.flatnonzero(todo).tolist():
            meet(i)
        return u
    often = np.bincount(token)
    central = np.add.reduceat(often[token].astype(float), first) / np.maximum(n, 1)
    done = np.zeros(len(sets), bool)
    nxt = int(central.argmax())
    while True:
        meet(nxt)
        done[nxt] = True
        root = np.array([u.find(i) for i in range(len(sets))])
        largest = np.bincount(root).argmax()
        left = np.flatnonzero((root != largest) & ~done)
        if not len(left):
            return u
        nxt = int(left[central[left].argmax()])


def confirm_groups(rows: DataFrame, key: str, k: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that span each group's components. rows: key, id, todo, text."""

    def f(_, cols):
        ids, todo, texts = cols
        if len(ids) < 2:
            return []
        flags = np.array(todo)
        u = confirm([shingles(t, k) for t in texts], percent, None if not flags.any() else flags == 2)
        return [(ids[i], ids[u.find(i)]) for i in range(len(ids)) if u.find(i) != i]

    return map_groups(rows.select(key, "id", "todo", "text"), key, f, LINKS, unique="id")


def confirmed(clusters: DataFrame, texts: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Confirmed links. clusters: stored (id, cluster, n, doc_id, tie); most: shingles that one group may hold."""
    weight = clusters.groupBy("cluster").agg(F.sum("n").alias("weight"))
    sized = stored(clusters.join(weight, "cluster"), "clusters")
    who = ["id", "doc_id", "tie"]
    named = texts.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "text").hint("merge")
    # a merge join at every size: the ids grow with the input, and one shuffle of texts is what it costs
    with_text = lambda df: df.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))
    whole = sized.where(F.col("weight") <= most).select(F.col("cluster").alias("cell"), *who, F.lit(0).alias("todo"))
    large = sized.where(F.col("weight") > most)
    if not large.limit(1).count():
        return stored(confirm_groups(with_text(whole), "cell", k, percent), "confirmed")
    # one shuffle of texts for the whole clusters and the first blocks of the large ones
    chunks = F.ceil(F.col("weight") * 2 / most).cast("bigint")
    large = large.withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("id", F.lit(7)), F.col("k")))
    first = large.select(F.xxhash64("cluster", "c").alias("cell"), *who, F.lit(0).alias("todo"))
    h = F.xxhash64("id", F.lit(11))
    pivots = large.groupBy("cluster", F.pmod(h, F.lit(8)).alias("p")).agg(F.min_by(F.struct(*who, "k"), h).alias("x")).select("cluster", "x.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("x.k") - 1)).alias("c"))
    first = first.union(pivots.select(F.xxhash64("cluster", "c").alias("cell"), *who, F.lit(0).alias("todo"))).distinct()
    links = stored(confirm_groups(with_text(whole.union(first)), "cell", k, percent), "confirmed")
    # then whatever is outside its cluster's largest component meets all of the cluster, block by block
    comp = components(links)
    named_now = stored(large.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "components")
    count = named_now.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    top = count.groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("top"))
    outside = named_now.join(top, "cluster").where("component != top")
    if not outside.limit(1).count():
        return links
    outside = stored(outside, "outside")
    # blocks of the outside documents, by their own weight
    own = outside.groupBy("cluster").agg(F.sum("n").alias("w")).select("cluster", F.ceil(F.col("w") * 2 / most).cast("bigint").alias("b"))
    each = outside.join(own, "cluster").withColumn("o", F.pmod(F.xxhash64("id", F.lit(13)), F.col("b")))
    left = each.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select("cluster", "o", "c", *who, F.lit(2).alias("todo"))
    right = named_now.join(own, "cluster").withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1))).select("cluster", "o", "c", *who, F.lit(1).alias("todo"))
    cells = left.union(right).groupBy(F.xxhash64("cluster", "o", "c").alias("cell"), *who).agg(F.max("todo").alias("todo"))
    return links.union(stored(confirm_groups(with_text(cells), "cell", k, percent), "confirmed"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-6, most: int = 400_000) -> DataFrame:
    """doc_id, tie (the text's key), n_shingles, component_id, kept, stands: components of documents whose sets have
    ``percent`` of their union in common. kept: the id names the component; stands: the document (id and text) that
    stands for it, which exists in every component, without an id as well."""
    similarity = percent / 100
    trees = math.ceil(math.log(miss) / math.log(1 - similarity * together(similarity)))
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("tie"), text.alias("text"))
    rows = stored(sketch(texts, words, trees), "sketches")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    reps = rows.where("n_shingles > 0").groupBy("node").agg(F.min(who).alias("who"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    reps = stored(reps.withColumnRenamed("node", "id"), "sets")
    met = candidates(reps, similarity)
    clusters = components(met)
    drop_stored(*met.scratch)
    clusters = stored(clusters.withColumnRenamed("component", "cluster").join(reps.select("id", "n", "who.doc_id", "who.tie"), "id"), "clusters")
    comp = components(confirmed(clusters, texts, words, percent, most))
    named = reps.select("id", "who").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min("who").alias("first"))
    named = stored(named.join(first, "component").select(F.col("id").alias("node"), "first"), "named")
    found = rows.select("doc_id", "tie", "n_shingles", "node").join(named, "node", "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stands = empty | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    return found.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), stands.alias("stands"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their component; all columns as they were. Texts without words stay."""
    return anti_join(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("not stands"), id_col, text_col)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("tie", "stands")


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: The same rows in DuckDB: pairs that share a shingle, then the transitive closure of their links.
ORACLE_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
    g AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
    least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(least.r, n.doc_id) AS component_id, coalesce(least.r, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN least ON least.doc_id = n.doc_id"""
