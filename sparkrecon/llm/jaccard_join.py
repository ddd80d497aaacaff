"""N-gram Jaccard self-join at 0.75 and its components, skipping by set relations.

1. Equal texts become one *set* first; a third of all rows may be copies.
2. Every shingle of every set is counted, packed into blobs by hash range. A shingle
   of one set only can link nothing, so a set with less than three quarters of its
   shingles in other sets is done. Most sets are.
3. The rest are indexed: a shingle's list holds the sets with it among their first
   ones, rare shingles first (prefix filter: linked sets share one of those).
4. A list's sets are compared with one pivot of the list, and sets similar to a
   pivot take over its component: what the pivot's component answers, they need not
   ask again. A list whose sets are all in one component is skipped whole. A few
   rounds with other pivots leave little.
5. Lists that still hold several components are joined in full. A set's position in
   a list bounds the size of its partners there: sets without a possible size leave
   the list, the others meet only the blocks of sizes up to that bound, and of these
   only pairs whose marks, a parity per hash of a shingle, differ in few enough bits.
6. All links lie within components. Each set's partners there follow from those of a
   similar set, its pivot: the pivot's numbers of common shingles, corrected by the
   lists of the shingles that only one of the two has. Large components are cut into
   blocks of sets, and each pair of blocks is counted in a task of its own.

All links are verified on whole sets, so none is lost; pairs of near copies stand in
packed lists, a row per set and block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.common import parts_for, semi_join_rows, staged
from sparkrecon.llm.components import components
from sparkrecon.llm.shingles import CHUNK, shingles

#: Least Jaccard similarity as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Bytes of compressed input whose shingles are counted in one task.
COUNT_BYTES = 6 << 20
#: Rounds with pivots at most, and pairs per indexed set that the full join may take
#: over from them.
PIVOT_ROUNDS, LEFT_PAIRS = 4, 20
#: Longs of a set's mark, blocks of sizes up to a factor of 4/3, and rows of a list that
#: one task of the full join takes on one side.
MARK_LONGS, SIZE_BLOCKS, LIST_ROWS = 8, 8, 1024
#: Sets and shingles of a block of a component, about.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 20
#: Small components in one group of the step that counts links, by their shingles.
GROUP_TOKENS = 1 << 19
#: Bits of a shingle's hash within its range.
LOW_BITS = 40

_LOW = np.uint64((1 << LOW_BITS) - 1)


def node_of(text: Column) -> Column:
    """The number of a text, 64 bits of its digest: equal texts share it."""
    return F.xxhash64(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _low_bytes(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    width = LOW_BITS // 8
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8")


_BLOBS = "range int, nodes binary, sizes binary, counts binary, tokens binary"


def _shingle_blobs(ranges: int):
    """Batches of ``(node, text)`` to blobs: per range of hashes and some texts their
    nodes, how many tokens each has there, and the tokens. ``sizes`` gives a set's
    whole size in the first range it has tokens in, else 0."""
    names = [field.split()[0] for field in _BLOBS.split(", ")]

    def blobs(nodes: list[int], texts: list[bytes]) -> pa.RecordBatch:
        owner, hashes = shingles(texts)
        rows: list[tuple] = []
        at = _range_of(hashes, ranges).astype(np.int64)
        sizes = np.bincount(owner, minlength=len(nodes))
        ids = np.array(nodes, "<i8")
        order = np.argsort(at, kind="stable")  # texts stay in order within a range
        at, owner, tokens = at[order], owner[order], hashes[order] & _LOW
        cuts = np.flatnonzero(np.diff(at)) + 1
        told = np.zeros(len(nodes), bool)
        for first, last in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if first == last:
                continue
            texts_here, counts = np.unique(owner[first:last], return_counts=True)
            rows.append(
                (
                    int(at[first]), ids[texts_here].tobytes(),
                    np.where(told[texts_here], 0, sizes[texts_here]).astype("<u4").tobytes(),
                    counts.astype("<u4").tobytes(), _low_bytes(tokens[first:last]),
                )
            )
            told[texts_here] = True
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, texts, size = [], [], 0
        for batch in batches:
            data = batch.column("text").cast(pa.binary())
            for node, text in zip(batch.column("node").to_pylist(), data, strict=True):
                nodes.append(node)
                texts.append(text.as_py() or b"")
                size += len(texts[-1]) + 1
                if size >= CHUNK:
                    yield blobs(nodes, texts)
                    nodes, texts, size = [], [], 0
        if nodes:
            yield blobs(nodes, texts)

    return run


_SHARED = "home int, nodes binary, sizes binary, counts binary, tokens binary, uses binary"


def _shared_tokens(homes: int):
    """A range's blobs to its tokens that several sets have, with how many have them,
    packed by the home (a hash range of nodes) of each set."""
    names = [field.split()[0] for field in _SHARED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        nodes = np.frombuffer(b"".join(rows["nodes"]), "<i8")
        sizes = np.frombuffer(b"".join(rows["sizes"]), "<u4")
        counts = np.frombuffer(b"".join(rows["counts"]), "<u4")
        tokens = _from_low_bytes(b"".join(rows["tokens"]))
        place = np.repeat(np.arange(len(nodes)), counts)
        _, which, uses = np.unique(tokens, return_inverse=True, return_counts=True)
        uses = uses[which]
        tokens = tokens | (np.uint64(rows["range"][0]) << np.uint64(LOW_BITS))
        keep = uses > 1
        place, tokens, uses = place[keep], tokens[keep], uses[keep]
        kept = np.bincount(place, minlength=len(nodes))
        home = (nodes.view(np.uint64) % np.uint64(homes)).astype(np.int64)
        wanted = np.flatnonzero((kept > 0) | (sizes > 0))
        wanted = wanted[np.argsort(home[wanted], kind="stable")]
        first_token = np.concatenate([[0], np.cumsum(kept)])
        found: list[tuple] = []
        cuts = np.flatnonzero(np.diff(home[wanted])) + 1
        for part in np.split(wanted, cuts) if len(wanted) else []:
            at = np.concatenate(
                [np.arange(first_token[i], first_token[i + 1]) for i in part]
            ).astype(np.int64)
            found.append(
                (
                    int(home[part[0]]), nodes[part].tobytes(), sizes[part].tobytes(),
                    kept[part].astype("<u4").tobytes(), tokens[at].astype("<u8").tobytes(),
                    uses[at].astype("<u4").tobytes(),
                )
            )
        columns = list(zip(*found, strict=True)) or [[]] * 6
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    return run


_SETS = "node long, n int, tokens array<long>, mark array<long>"


def _sets(table: pa.Table) -> pa.Table:
    """A home's sets: size, and for sets that may have a partner the shared tokens,
    rarest first (ties by token), and their mark, in which each token turns the bit of
    its lowest bits over; null for the others."""
    rows = table.to_pydict()
    nodes = np.frombuffer(b"".join(rows["nodes"]), "<i8")
    sizes = np.frombuffer(b"".join(rows["sizes"]), "<u4").astype(np.int64)
    counts = np.frombuffer(b"".join(rows["counts"]), "<u4")
    tokens = np.frombuffer(b"".join(rows["tokens"]), "<u8").view(np.int64)
    uses = np.frombuffer(b"".join(rows["uses"]), "<u4")
    known, which = np.unique(nodes, return_inverse=True)
    n = np.bincount(which, sizes, len(known)).astype(np.int64)
    shared = np.bincount(which, counts, len(known)).astype(np.int64)
    owner = np.repeat(which, counts)
    may = shared * DENOMINATOR >= NUMERATOR * n
    keep = may[owner]
    owner, tokens, uses = owner[keep], tokens[keep], uses[keep]
    order = np.lexsort((tokens, uses, owner))
    tokens = tokens[order]
    ends = np.cumsum(np.where(may, shared, 0))
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens, pa.int64()),
        mask=pa.array(~may),
    )
    bits = tokens.view(np.uint64)
    marks = np.zeros((len(known), MARK_LONGS), np.uint64)
    at = (owner[order], (bits % np.uint64(MARK_LONGS)).astype(np.int64))
    np.bitwise_xor.at(marks, at, np.uint64(1) << (bits // np.uint64(MARK_LONGS)) % np.uint64(64))
    marks = pa.ListArray.from_arrays(
        pa.array(np.arange(len(known) + 1, dtype=np.int32) * MARK_LONGS),
        pa.array(marks.reshape(-1).view(np.int64)), mask=pa.array(~may),
    )
    return pa.Table.from_arrays(
        [pa.array(known, pa.int64()), pa.array(n, pa.int32()), lists, marks],
        names=["node", "n", "tokens", "mark"],
    )


def sets_of(texts: DataFrame, ranges: int) -> DataFrame:
    """Sets ``(node, n, tokens, mark)`` of distinct ``(node, text)`` rows; a text without
    words has no row."""
    blobs = texts.mapInArrow(_shingle_blobs(ranges), _BLOBS)
    shared = blobs.groupBy("range").applyInArrow(_shared_tokens(ranges), _SHARED)
    return shared.groupBy("home").applyInArrow(_sets, _SETS)


def _needed(n: Column) -> Column:
    """Least number of common shingles of a set of n with any partner."""
    return F.ceil(n * NUMERATOR / DENOMINATOR).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are links."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    common = F.size(F.array_intersect("at", "bt"))
    union = F.col("an") + F.col("bn") - common
    return (
        pairs.join(left, "a").join(right, "b").where(common * DENOMINATOR >= union * NUMERATOR)
        .select("a", "b")
    )


def _sizes_fit(n: str, m: str) -> Column:
    small, large = F.least(n, m), F.greatest(n, m)
    return small * DENOMINATOR >= large * NUMERATOR


def _labelled(postings: DataFrame, labels: DataFrame | None, marks: DataFrame | None = None) -> DataFrame:
    """Postings with their sets' component, the rows of their list and, if given, the
    columns of ``marks``; lists of one component are left out."""
    found = postings if marks is None else postings.join(marks, "node")
    if labels is None:
        with_label = found.withColumn("component", F.col("node"))
    else:
        found = found.join(labels, "node", "left")
        with_label = found.withColumn("component", F.coalesce("component", "node"))
    least, most = F.min("component").alias("x"), F.max("component").alias("y")
    several = (
        with_label.groupBy("token").agg(least, most, F.count("*").alias("list_rows"))
        .where("x != y").select("token", "list_rows")
    )
    return staged(with_label.join(several, "token"))


def _pairs_left(postings: DataFrame) -> int:
    """Pairs of sets of different components over all lists."""
    sizes = postings.groupBy("token", "component").agg(F.count("*").cast("double").alias("c"))
    lists = sizes.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return int(lists.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0] or 0)


def _pivot_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """Each set with the pivot of its lists: the set of lowest hash, a new one in
    each round, if their sizes and components allow a new link."""
    mark = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "component")
    pivots = postings.groupBy("token").agg(F.min(mark).alias("pivot"))
    return (
        postings.join(pivots, "token")
        .where("component != pivot.component")
        .select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), "n", F.col("pivot.n").alias("m"))
        .where(_sizes_fit("n", "m")).select("a", "b").distinct()
    )


def _size_block(n: Column) -> Column:
    """The block of a size; it never falls as the size grows."""
    width = F.log(F.lit(DENOMINATOR / NUMERATOR)) / SIZE_BLOCKS
    return F.floor(F.log(n.cast("double")) / width).cast("int")


def _all_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of different components in a list that sizes, positions and marks allow.

    Links have |x & y| >= 3/7 (|x| + |y|). What stands from a set's position on bounds
    |x & y|, and so the size ``most`` of a partner. Each set meets the blocks of sizes
    that are not larger than its own; a long list is dealt over several tasks."""
    both = NUMERATOR + DENOMINATOR
    most = F.floor(((F.col("n") - F.col("place")) * both - F.col("n") * NUMERATOR) / NUMERATOR)
    rows = postings.withColumn("most", most.cast("int")).where(F.col("most") >= _needed(F.col("n")))
    salts = F.ceil(F.col("list_rows") / LIST_ROWS).cast("int")
    n = F.col("n")
    blocks = F.sequence(_size_block(_needed(n)), _size_block(F.least("n", "most")))
    left = rows.select(
        "token", F.explode(blocks).alias("block"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"),
        *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "most", "component", "k", "mark")),
    )
    right = rows.where("most >= n").select(
        "token", _size_block(n).alias("block"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
        *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "most", "component", "k", "mark")),
    )
    differ = sum(
        (F.bit_count(F.get("a_mark", F.lit(i)).bitwiseXOR(F.get("b_mark", F.lit(i)))) for i in range(MARK_LONGS)),
        F.lit(0),
    )
    # Twice |x & y| is at most the tokens of both less the bits that differ.
    enough = (F.col("a_k") + F.col("b_k") - differ) * both >= (F.col("a_n") + F.col("b_n")) * (2 * NUMERATOR)
    smaller = F.expr("b_n < a_n or (b_n = a_n and b_node < a_node)")
    fits = F.expr("b_n <= a_most and a_n <= b_most and a_component != b_component")
    joined = left.join(right, ["token", "block", "salt"])
    joined = joined.where(smaller & fits & _sizes_fit("a_n", "b_n") & enough)
    return joined.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only links between components count, and only the
    components they touch are looked at."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = (
        links.join(of_a, "a", "left").join(of_b, "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = components(between)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(moved, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )
    fresh = merged.join(labels, "node", "left_anti").select("node", "component")
    return staged(known.unionByName(fresh))


def linked_components(sets: DataFrame) -> DataFrame | None:
    """``(node, component)`` of the sets that are linked with others."""
    indexed = staged(sets.where("tokens is not null").select("node", "n", "tokens", "mark"))
    total = indexed.count()
    if total < 2:
        return None
    first = F.size("tokens") - _needed(F.col("n")) + 1
    head = indexed.select("node", "n", F.size("tokens").alias("k"), F.posexplode(F.slice("tokens", F.lit(1), first)).alias("at", "token"))
    postings = staged(
        head.select("token", "node", "n", (F.col("n") - F.col("k") + F.col("at")).alias("place"))
    )
    labels = None

    def joined(pairs: DataFrame) -> DataFrame:
        new = _verified(pairs, indexed)
        return components(new) if labels is None else _merged(labels, new)

    for turn in range(PIVOT_ROUNDS):
        left = _labelled(postings, labels)
        pairs = _pairs_left(left)
        if not pairs:
            return labels
        if pairs <= LEFT_PAIRS * total:
            break
        labels = joined(_pivot_pairs(left, turn))
    marks = indexed.select("node", F.size("tokens").alias("k"), "mark")
    return joined(_all_pairs(_labelled(postings, labels, marks)))


def _positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several slices, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of ``left`` how many tokens it shares with each of ``right``. A set
    takes the counts of the pivot, a set before it, and looks only at the lists of
    tokens that one of the two has; if that is more than its own lists, it is counted
    from these and becomes the pivot."""
    sizes = np.array([len(x) for x in right])
    known, which = np.unique(np.concatenate(right), return_inverse=True)
    lists = np.repeat(np.arange(len(right)), sizes)[np.argsort(which, kind="stable")]
    lengths = np.bincount(which, minlength=len(known))
    starts = np.cumsum(lengths) - lengths

    def counted(tokens: np.ndarray) -> np.ndarray:
        found = lists[_positions(starts[tokens], lengths[tokens])]
        return np.bincount(found, minlength=len(right))

    pivot, answers = None, None
    of_pivot, of_own = np.zeros(len(known), bool), np.zeros(len(known), bool)
    for tokens in left:
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        own = at[known[at] == tokens]
        if pivot is not None:
            of_own[own] = True
            more, less = own[~of_pivot[own]], pivot[~of_own[pivot]]
            of_own[own] = False
            if lengths[more].sum() + lengths[less].sum() < lengths[own].sum():
                yield answers + counted(more) - counted(less)
                continue
            of_pivot[pivot] = False
        pivot, answers = own, counted(own)
        of_pivot[own] = True
        yield answers


_PARTNERS = "node long, partners array<long>, other_rows long"


def _partners(table: pa.Table) -> pa.Table:
    """Sets of whole components, or of one or two blocks of one, to the partners each has
    among them (in the other block if there are two) and the rows these stand for."""
    nodes, n, copies, component, block = (
        table.column(c).to_numpy() for c in ("node", "n", "copies", "component", "block")
    )
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    lists = table.column("tokens").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    tokens = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = np.argsort(component, kind="stable")
    own, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for members in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        left, right = members[block[members] == i], members[block[members] == j]
        if not len(left) or not len(right):
            continue
        counts = _common_counts([tokens[x] for x in left], [tokens[x] for x in right])
        for x, common in zip(left, counts, strict=True):
            linked = common * (NUMERATOR + DENOMINATOR) >= (n[x] + n[right].astype(np.int64)) * NUMERATOR
            found = right[linked & (right != x)]
            own.append(np.full(len(found), x))
            other.append(found)
    own, other = np.concatenate(own), np.concatenate(other)
    if i != j:
        own, other = np.concatenate([own, other]), np.concatenate([other, own])
    order = np.argsort(own, kind="stable")
    own, other = own[order], other[order]
    having, numbers = np.unique(own, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(numbers)])
    rows = np.bincount(own, copies[other], len(nodes)).astype(np.int64)
    partners = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(nodes[other]))
    return pa.Table.from_arrays(
        [pa.array(nodes[having]), partners, pa.array(rows[having])],
        names=["node", "partners", "other_rows"],
    )


def partners_of(sets: DataFrame, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """Lists ``(node, partners, other_rows)`` of the linked sets: all partners of a set
    stand in one or several rows, each partner once. ``copies`` has the number of rows
    of each node, and ``other_rows`` is their sum over the list."""
    members = sets.where("tokens is not null").join(labels, "node").join(copies, "node")
    members = staged(members.select("node", "n", "tokens", "component", "copies"))
    size = F.sum(F.size("tokens"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, size / BLOCK_TOKENS)).cast("int")
    # At most a component for each BLOCK_SETS sets or BLOCK_TOKENS shingles: a few.
    large = members.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1")
    total = members.agg(size).first()[0] or 0
    groups = int(total // GROUP_TOKENS) + 1
    dealt = (
        members.join(F.broadcast(large), "component", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    small = F.col("blocks") == 1
    group = F.when(small, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component"))
    cells = dealt.select(
        "node", "n", "tokens", "component", "copies", "block", small.alias("small"),
        group.alias("cell"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
    )
    return cells.groupBy("small", "cell", "i", "j").applyInArrow(_partners, _PARTNERS)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, partner_id)`` per pair of different texts that are linked, each pair
    once and each text by the smallest id that has it."""
    rows, _, sets, labels = _classes(docs, id_col, text_col)
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    if labels is None:
        return firsts.where("false").select(F.col("first").alias("doc_id"), F.col("first").alias("partner_id"))
    found = partners_of(sets, labels, firsts.select("node", "copies"))
    pairs = found.select("node", F.explode("partners").alias("partner")).where("node < partner")
    left = firsts.select("node", F.col("first").alias("doc_id"))
    right = firsts.select(F.col("node").alias("partner"), F.col("first").alias("partner_id"))
    return pairs.join(left, "node").join(right, "partner").select("doc_id", "partner_id")


def join_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` per row.

    ``component_id`` is the smallest id reachable by links, the row's own included,
    and ``n_links`` the number of other rows that the row is linked with.
    Texts without words (null, empty, blank) have no shingles and are linked with
    nothing: their component is their own id. Equal texts with words are linked, and
    so are repeated rows. A null id takes part but never names a component of
    others."""
    rows, known, sets, labels = _classes(docs, id_col, text_col)
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"))
    known = known.join(copies, "node").withColumn("n_links", F.col("copies") - 1)
    if labels is not None:
        found = partners_of(sets, labels, copies).groupBy("node").agg(F.sum("other_rows").alias("others"))
        known = known.join(found, "node", "left").withColumn(
            "n_links", F.col("n_links") + F.coalesce("others", F.lit(0))
        )
    return _named(rows, known).select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The row of the smallest id of each component, with all its columns. Repeated rows
    give one; a component without any id keeps a row per text."""
    classed = _named(*_classes(docs, id_col, text_col)[:2])
    first = F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    kept = classed.where(first).select("doc_id", F.col("node").alias("mark")).distinct()
    return semi_join_rows(docs, id_col, node_of(F.col(text_col)), kept)


def _classes(docs: DataFrame, id_col: str, text_col: str):
    """Rows ``(doc_id, node)``, classes ``(node, n, component_id)`` of texts with words,
    the sets, and the labels of linked ones if any."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), node_of(text).alias("node"))
    texts = (
        docs.select(node_of(text).alias("node"), F.coalesce(text, F.lit("")).alias("text"))
        .groupBy("node").agg(F.min("text").alias("text"))
    )
    ranges = parts_for(docs.select(id_col, text_col), COUNT_BYTES)
    sets = staged(sets_of(texts, ranges))
    labels = linked_components(sets)
    sized = sets.select("node", "n")
    if labels is None:
        sized = sized.withColumn("component", F.col("node"))
    else:
        sized = sized.join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
    sized = staged(sized)
    rows = staged(rows)
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = (
        sized.join(firsts, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    )
    known = staged(sized.join(named, "component").select("node", "n", "component_id"))
    return rows, known, sets, labels


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with what is known of their texts; texts without words get defaults."""
    return rows.join(known, "node", "left").select(
        "doc_id",
        "node",
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(c for c in known.columns if c == "n_links"),
    )
